"""The queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, fingerprints, lm, manifest, packing, pieces, quality, search, secrets, simhash, toxicity, warc
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's relational lattice on a unigram table: every distinct word of the documents with its count and best path."""
    return pieces.word_paths(table(spark, sf_dir, "documents", "doc_id", "text"), pieces.unigram_table(spark))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.report(table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_toxicity": op3_toxicity,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_language_model": op7_language_model,
        "op8_secret_scan": op8_secret_scan,
        "op9_warc": op9_warc,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_bpe": op11_bpe,
        "op12_ranked_search": op12_ranked_search,
        "op13_merkle_manifest": op13_merkle_manifest,
        "sentencepiece_lattice": sentencepiece_lattice,
    }


OP9 = """
with page as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) || '0' hex from pages),
first as (select hex, min(page_id) as first_id from page group by hex)
select page_id, payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || rpad(substr(hex, cast(1 + (5*i) // 4 as bigint), 3), 3, '0'))::int) >> cast(7 - (5*i) % 4 as int)) & 31), 1) for i in range(32)], 'string_agg', '') payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end record_type,
  case when page_id > first_id then first_id end refers_to
from page join first using (hex)"""


TERMS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{search.UPPER}', '{search.LOWER}'), '{search.BETWEEN}'), lambda t: t <> '')"
OP12 = f"""
with doc as (select doc_id, {TERMS} t from documents),
totals as (select count(*) filter (len(t) > 0) docs, cast(sum(len(t)) as bigint) words from doc),
posting as (select doc_id, n, term, count(*) tf from (select doc_id, len(t) n, unnest(t) term from doc) group by all),
spread as (select term, count(*) df from posting group by term),
asked as (select item_id, term, count(*) times from (select item_id, unnest({TERMS}) term from benchmark) group by all),
weighted as (select item_id, term, times * cast(floor(1000 * ln((2*docs + 2) / (2*df + 1))) as bigint) w from asked join spread using (term) cross join totals),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000*tf + 8*(100 - 75 + (75*n*docs) // words)))) as bigint) score
  from weighted join posting using (term) cross join totals group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from scored where score > 0 qualify rank <= 10"""

FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
# the checksum byte by byte, each bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda crc, c: list_reduce(list_prepend(xor(crc, c), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
OP13 = f"""
with recursive leaves as (
  select doc_id, lang, {LEAF.format("n_chars")} leaf, {LEAF.format("(n_chars + 1)")} other, {CRC32} % 7 = 0 hit,
   row_number() over (partition by lang order by doc_id) - 1 pos, count(*) over (partition by lang) n from documents),
node(tree, level, pos, n, h) as (
  select coalesce('l' || lang, ''), 0, pos, n, leaf from leaves union all
  select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from node where n > 1 group by tree, level, pos // 2, n),
subroot as (select tree, h, row_number() over (order by tree) - 1 pos, count(*) over () n from node where n = 1),
upper_node(level, pos, n, h) as (
  select 0, pos, n, h from subroot union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from upper_node where n > 1 group by level, pos // 2, n),
steps as (
  select doc_id, list(x order by level) found from (
    select l.doc_id, k.level, {{'before': case when k.pos % 2 = 1 then s.h else '' end, 'after': case when k.pos % 2 = 0 then coalesce(s.h, '') else '' end}} x
    from leaves l join node k on k.tree = coalesce('l' || l.lang, '') and k.pos = l.pos >> k.level and k.n > 1 left join node s on s.tree = k.tree and s.level = k.level and s.pos = xor(k.pos, 1)
    union all
    select l.doc_id, 100 + k.level, {{'before': case when k.pos % 2 = 1 then s.h else '' end, 'after': case when k.pos % 2 = 0 then coalesce(s.h, '') else '' end}}
    from leaves l join subroot r on r.tree = coalesce('l' || l.lang, '') join upper_node k on k.pos = r.pos >> k.level and k.n > 1 left join upper_node s on s.level = k.level and s.pos = xor(k.pos, 1)) group by doc_id)
select doc_id, leaf, r.h subroot, top.h root, sha256(list_aggregate(list_transform(coalesce(found, []), lambda s: s.before || s.after), 'string_agg', '')) proof_sha256,
 list_reduce(list_prepend({{'before': '', 'after': coalesce(case when hit then other end, leaf)}}, coalesce(found, [])), lambda a, s: {{'before': '', 'after': sha256(s.before || a.after || s.after)}}).after folded_root,
 folded_root = root verified
from leaves l left join steps using (doc_id) join subroot r on r.tree = coalesce('l' || l.lang, '') cross join (select h from upper_node where n = 1) top"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": OP9, "op12_ranked_search": OP12, "op13_merkle_manifest": OP13}
