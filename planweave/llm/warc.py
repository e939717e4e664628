"""WARC archives with a two-level capture index.

Writing: each task streams its pages into archives of its own, one gzip member per
record; pages whose payload equals that of a page with a smaller id become revisit
records that refer to it. Archives and index live in a folder of the shared file
system (any that pyarrow knows); a task's files have names of their own per attempt,
so a task that is run again never touches what another has written.

Index: captures sorted by reversed-host key and page are packed into compressed
blocks of LINES lines; a sparse directory beside each index file holds every block's
first key and place. Reading finds a key's index file and block by binary search,
range-reads the block, finds the capture, and range-reads the record; of a revisit it
looks up the record referred to in the same way, and length and digest are of the
payload found there.

A null html is an empty payload, a null url an empty key; pages without page_id are
always responses, as are those below `least` bytes. Rows that share page_id and
payload with the response are responses too; repeated rows are archived as often as
they occur. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.session import shared_folder, stored, until_exit

from .common import text_slices

LINES = 1000
#: Archive bytes that a reading task is given at most, and at least while there are fewer tasks than cores.
MOST_READ, LEAST_READ = 128 << 20, 1 << 20
#: Payloads whose length and digest a reader keeps.
KNOWN = 100_000
ARCHIVE_BYTES = 1 << 30
DATE = "2000-01-01T00:00:00Z"
CAPTURE = "page_id {kind}, urlkey string, file string, offset long, length long"
FOUND = "page_id {kind}, record_type string, refers_to {kind}, payload_bytes long, payload_digest string, url string"


def surt(url: str | None) -> str:
    """The key by which captures are sorted: host labels reversed, then path and query; no scheme, user, default port or fragment."""
    rest = (url or "").strip().partition("#")[0]
    scheme, mark, tail = rest.partition("://")
    tail = tail if mark else rest
    cut = min((at for at in (tail.find("/"), tail.find("?")) if at >= 0), default=len(tail))
    host, path = tail[:cut].rpartition("@")[2].lower(), tail[cut:] or "/"
    name, colon, port = host.partition(":")
    if port and port == {"http": "80", "https": "443"}.get(scheme.lower()):
        colon = port = ""
    key = ",".join(reversed(name.split("."))) + colon + port + ")" + path
    return quote(key, safe="".join(map(chr, range(33, 127))))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, with the payload's length, and leaves the payload out. Its field Refers-To-Key has the index key of the record referred to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {quote(refers_url, safe=''.join(map(chr, range(33, 127))))}")
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"Refers-To-Key: {surt(refers_url)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    head += [f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode().split("\r\n")[1:]
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}


def parsed(data: bytes) -> dict:
    """A record's page, type, reference, and its payload's length and digest (computed where the payload is there, else as recorded)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    said = _headers(head)
    block = rest[: int(said["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(said[name][len("<urn:page:") : -1]) if said.get(name, "<urn:page:>") != "<urn:page:>" else None
    out = {"page_id": page("warc-record-id"), "record_type": said["warc-type"], "refers_to": page("warc-refers-to"), "url": said.get("warc-target-uri")}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": int(_headers(http)["content-length"]), "payload_digest": said["warc-payload-digest"].removeprefix("sha1:"), "refers_key": said["refers-to-key"]}
    return out | {"payload_bytes": len(payload), "payload_digest": digest_of(payload), "payload": payload}


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _packed(data: bytes) -> bytes:
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def _task_file(folder: str, suffix: str) -> str:
    from pyspark import TaskContext

    return f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}{suffix}"


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha, refers_to and refers_url of the pages whose payload a smaller page_id has."""
    shas = pages.select("page_id", "url", F.octet_length("payload").alias("n"), F.sha1("payload").alias("sha")).filter(F.col("n") >= least).select("page_id", "url", "sha")
    # written and read back, so that both sides of the join are shuffled and a payload that many pages share can be split
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    shared = shas.groupBy("sha").agg(first, F.max("page_id").alias("last")).filter("first.page_id < last")
    shared = stored(shared.select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")), "payloads")
    return shas.select("page_id", "sha").join(shared, "sha").filter("page_id > refers_to").distinct()


def archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the archives; returns the captures: page_id, urlkey, file, offset, length."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    same = revisits(rows, least).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "refers_to", "refers_url")
    rows = rows.join(same, (F.col("page_id") == F.col("_page")) & (F.sha1("payload") == F.col("_sha")), "left").select("page_id", "url", "refers_to", "refers_url", "payload")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        store, root = _open(folder)
        for batch in text_slices(batches):
            rows = []
            for page_id, url, refers_to, refers_url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    store.create_dir(f"{root}/archives", recursive=True)
                    name, at = f"archives/{_task_file(folder, '.warc.gz')}", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = _packed(record(page_id, url, payload, refers_to, refers_url))
                out.write(data)
                rows.append((page_id, surt(url), name, at, len(data)))
                at += len(data)
            columns = list(zip(*rows, strict=True))
            kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "urlkey", "file", "offset", "length"])
        if out:
            out.close()

    return stored(rows.mapInArrow(write, CAPTURE.format(kind=kind)), "captures")


def index(captures: DataFrame, folder: str, lines: int = LINES) -> list[tuple[str, str]]:
    """Write the index; returns its top level, the first key and the name of each index file (one a task)."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        held, directory, at, out, name = [], [], 0, None, ""

        def flush() -> None:
            nonlocal at
            data = zlib.compress("\n".join(held).encode(), 6)
            out.write(data)
            directory.append(f"{held[0].rpartition('\t')[0].rpartition('\t')[0].rpartition('\t')[0]}\t{at}\t{len(data)}")
            at += len(data)
            held.clear()

        for batch in batches:
            for page_id, key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(f"{root}/index", recursive=True)
                    name = f"index/{_task_file(folder, '.idx')}"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                held.append(f"{key}\t{_sortable(page_id)}\t{file}\t{offset}\t{length}")
                if len(held) == lines:
                    flush()
        if out is None:
            return
        if held:
            flush()
        out.close()
        with store.open_output_stream(f"{root}/{name}.dir", compression=None) as beside:
            beside.write("\n".join(directory).encode())
        first = directory[0].rpartition("\t")[0].rpartition("\t")[0]
        yield pa.RecordBatch.from_pydict({"first": [first], "name": [name]})

    return sorted(tuple(r) for r in _by_key(captures).mapInArrow(write, "first string, name string").collect())


def _sortable(page_id: int | None) -> str:
    """Ids as text that sorts as they do, nulls first."""
    return "" if page_id is None else f"{page_id + (1 << 63):020d}"


def _by_key(rows: DataFrame, *parts: int) -> DataFrame:
    """Sorted by key and page over all partitions (so many, if said); a key that many pages share is divided between them."""
    return rows.repartitionByRange(*parts, "urlkey", F.col("page_id").asc_nulls_first()).sortWithinPartitions("urlkey", F.col("page_id").asc_nulls_first())


class Reader:
    """Looks captures up in the index and reads their records, keeping the last directory, block and archive open."""

    def __init__(self, folder: str, top: list[tuple[str, str]]):
        self.store, self.root = _open(folder)
        self.firsts, self.names = [a for a, _ in top], [b for _, b in top]
        self.kept: dict[str, tuple] = {}
        self.payloads: dict[tuple[int, str], int] = {}

    def once(self, what: str, key, load):
        if self.kept.get(what, (None,))[0] != key:
            self.kept[what] = (key, load())
        return self.kept[what][1]

    def file(self, name: str, what: str):
        return self.once(what, name, lambda: self.store.open_input_file(f"{self.root}/{name}"))

    def directory(self, name: str) -> tuple[list[str], list[tuple[int, int]]]:
        def load():
            with self.store.open_input_file(f"{self.root}/{name}.dir") as f:
                rows = [x.rsplit("\t", 2) for x in f.read().decode().split("\n")]
            return [r[0] for r in rows], [(int(a), int(b)) for _, a, b in rows]

        return self.once("directory", name, load)

    def block(self, name: str, k: int) -> list[str]:
        def load():
            offset, length = self.directory(name)[1][k]
            return zlib.decompress(self.file(name, "index").read_at(length, offset)).decode().split("\n")

        return self.once("block", (name, k), load)

    def captures(self, urlkey: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture of the key and page."""
        wanted = f"{urlkey}\t{_sortable(page_id)}"
        at = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        for name in self.names[at : at + 2]:
            firsts = self.directory(name)[0]
            for k in range(max(0, bisect.bisect_left(firsts, wanted) - 1), len(firsts)):
                if firsts[k] > wanted:
                    break
                lines = self.block(name, k)
                for line in lines[bisect.bisect_left(lines, wanted + "\t") :]:
                    if not line.startswith(wanted + "\t"):
                        break
                    file, offset, length = line[len(wanted) + 1 :].split("\t")
                    yield file, int(offset), int(length)

    def read(self, file: str, offset: int, length: int) -> dict:
        return parsed(zlib.decompress(self.file(file, f"archive {hash(file) % 32}").read_at(length, offset), 31))

    def resolved(self, found: dict) -> dict:
        """A record as read, or for a revisit with what the record referred to has."""
        if found["record_type"] != "revisit":
            return found
        key = (found["refers_to"], found["payload_digest"])
        if key not in self.payloads:
            if len(self.payloads) >= KNOWN:
                self.payloads.clear()
            for place in self.captures(found["refers_key"], found["refers_to"]):
                there = self.read(*place)
                if there["record_type"] == "response" and there["payload_digest"] == key[1]:
                    self.payloads[key] = there["payload_bytes"]
                    break
            else:
                raise ValueError(f"page {found['page_id']} refers to page {key[0]}, which has no record of digest {key[1]}")
        return found | {"payload_bytes": self.payloads[key]}


def read_back(captures: DataFrame, folder: str, top: list[tuple[str, str]]) -> DataFrame:
    """The records of the captures (urlkey, page_id; by their `length`s tasks get like shares), found through the index."""
    kind = captures.schema["page_id"].dataType.simpleString()
    names = [x.split()[0] for x in FOUND.format(kind=kind).split(", ")]

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, top)
        for batch in batches:
            rows = []
            for key, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [[found[n] for n in names] for found in (reader.resolved(reader.read(*c)) for c in reader.captures(key, page_id))]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            id_kind = batch.schema.field(1).type
            kinds = (id_kind, pa.string(), id_kind, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    total = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(-(-total // MOST_READ), min(-(-total // LEAST_READ), 2 * captures.sparkSession.sparkContext.defaultParallelism), 1)
    return _by_key(captures.select("urlkey", "page_id").distinct(), parts).mapInArrow(look, FOUND.format(kind=kind))


def report(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive, index, and read every page back."""
    folder = f"{shared_folder(pages.sparkSession)}/planweave-warc-{uuid.uuid4().hex}"
    captures = archive(pages.select("page_id", "url", "html"), folder, least)
    until_exit(pages.sparkSession, folder)
    top = index(captures, folder)
    return read_back(captures, folder, top).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
