"""Random spanning trees of long graphs, layer by layer: the law of Wilson's walks without their length.

A walk needs as many steps as the square of a graph's length. Here the layers of nodes equally
far from the root are eliminated from the last to the first, so what lies beyond a layer becomes
weights between its nodes; then the tree is drawn from the first layer to the last. Given the tree's
edges so far, the pieces that they join are one node each, and the rest of the tree is one of the
small graph of these pieces and the next layer: Wilson's walks draw that one, and an edge that stands
for what lies beyond is dropped again, as the next layer draws it.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right

import numpy as np

#: Weights between the nodes of layers (8 bytes each): that may be needed at once, and that are kept so as not to be worked out twice.
MOST, KEPT = 1 << 26, 1 << 24
#: Nodes, about, whose layers' edges are looked at together.
SPAN = 1 << 14


def layers_of(start: np.ndarray, to: np.ndarray, inside: np.ndarray, root: int) -> list[np.ndarray]:
    """The marked nodes that `root` reaches over marked ones, by their distance to it."""
    seen, now, out, place = ~inside, np.array([root], to.dtype), [], np.zeros(len(inside), np.int32)
    seen[root] = True
    while len(now):
        out.append(now)
        first = start[now]
        many = start[now + 1] - first
        until = many.cumsum()
        near = to[(first - until + many).repeat(many) + np.arange(until[-1])]
        near = near[~seen[near]]
        at = np.arange(len(near))
        place[near] = at
        now = near[place[near] == at]  # each once
        now.sort()
        seen[now] = True
    return out


def walked(reach: list[list[float]], draws, root: int = 0) -> list[int]:
    """Wilson's tree of a small graph, given by the running sums of each node's weights to all: parents. Any root will do; walks to a heavy one are short."""
    n = len(reach)
    parent, exits, joined = [-1] * n, [0] * n, [False] * n
    joined[root] = True
    for begin in range(n):
        at = begin
        while not joined[at]:
            to = reach[at]
            onward = bisect_right(to, next(draws) * to[-1])
            exits[at] = at = onward if onward < n else n - 1
        at = begin
        while not joined[at]:
            joined[at], parent[at] = True, exits[at]
            at = exits[at]
    return parent


class Layered:
    """The edges between marked nodes by layer, and whether walks would take longer than going by layers.

    Beside the graph there are two small numbers a node; edges are put in order for one block of layers at a time.
    """

    def __init__(self, start: np.ndarray, to: np.ndarray, pull: np.ndarray, inside: np.ndarray, layers: list[np.ndarray]):
        self.start, self.to, self.pull, self.layers = start, to, pull, layers
        self.wide = np.array([len(x) for x in layers])
        before, nodes = np.cumsum(self.wide) - self.wide, np.concatenate(layers)
        self.level, self.place = np.full(len(inside), -1, np.int32), np.zeros(len(inside), np.int32)
        self.level[nodes] = np.repeat(np.arange(len(layers), dtype=np.int32), self.wide)
        self.place[nodes] = np.arange(len(nodes), dtype=np.int32) - np.repeat(before.astype(np.int32), self.wide)
        begins = np.flatnonzero(np.diff(before // SPAN, prepend=-1)).tolist()
        #: First layers of the blocks, and of what is after each.
        self.blocks = list(zip(begins, [*begins[1:], len(layers)], strict=True))
        within, crossing = 0.0, [np.empty(0)]
        for b in range(len(self.blocks)):
            own, back = self._edges(b)
            within += own[1].sum()
            at = back[2][1 if b == 0 else 0 : -1]
            crossing.append(np.add.reduceat(back[1], at) if len(at) else np.empty(0))
        crossing = np.concatenate(crossing) if len(layers) > 1 else np.ones(1)
        #: About the steps of Wilson's walks: all weights, times the resistance from the first layer to the last.
        self.steps = (within + 2 * crossing.sum() * (len(layers) > 1)) * (1 / crossing).sum()

    def shorter(self) -> bool:
        squares = self.wide.astype(float) ** 2
        at_once = max(squares[lo:hi].sum() for lo, hi in self.blocks), sum(squares[hi - 1] for _, hi in self.blocks)
        return max(at_once) <= MOST and self.steps > 400 * len(self.layers) + squares.sum() / 30

    def _edges(self, b: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A block's edges within layers and to the layer before: places of both ends as one number, weights, and where each layer's edges begin."""
        lo, hi = self.blocks[b]
        nodes = np.concatenate(self.layers[lo:hi])
        first = self.start[nodes]
        many = self.start[nodes + 1] - first
        until = many.cumsum()
        which = (first - until + many).repeat(many) + np.arange(until[-1])
        to, pull, layer = self.to[which], self.pull[which], self.level[nodes].repeat(many)
        mine, width, there = self.place[nodes].astype(np.int64).repeat(many), self.wide[layer], self.level[to]

        def kept(marks: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return flat[marks], pull[marks], np.searchsorted(layer[marks], np.arange(lo, hi + 1))

        return kept(there == layer, mine * width + self.place[to]), kept((layer > 0) & (there == layer - 1), self.place[to] * width + mine)

    def _weights(self, of: tuple[np.ndarray, np.ndarray, np.ndarray], i: int, b: int, rows: int) -> np.ndarray:
        flat, pull, at = of
        i, w = i - self.blocks[b][0], self.wide[i]
        part = slice(at[i], at[i + 1])
        return np.bincount(flat[part], pull[part], rows * w).reshape(rows, w)

    def _ways_back(self, b: int, back: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], list[float], list[int]]:
        """Edges to the layer before, by layer, node and place there: the places there, the nodes', the weights; the first and the last as lists, and where each node's edges begin."""
        flat, pull, at = back
        wide, count = self.wide[slice(*self.blocks[b])], np.diff(at)
        width = wide.repeat(count)
        node = (np.cumsum(wide) - wide).repeat(count) + flat % width
        order = np.lexsort((flat // width, node))
        there, here, pull = (flat // width)[order], (flat % width)[order], pull[order]
        return there, here, pull, there.tolist(), pull.tolist(), np.searchsorted(node[order], np.arange(wide.sum() + 1)).tolist()

    def _beyond(self, b: int, last: np.ndarray) -> list[np.ndarray]:
        """For the layers of a block and the one before it, but not the first of all, last layer first, the weights between its nodes that stand for all later layers; those of the block's last layer are given."""
        (lo, hi), (within, before), out = self.blocks[b], self._edges(b), [last]
        for i in range(hi - 1, max(lo, 2) - 1, -1):
            own, back = self._weights(within, i, b, self.wide[i]) + out[-1], self._weights(before, i, b, self.wide[i - 1])
            pivot = -own
            pivot.flat[:: len(own) + 1] += own.sum(axis=1) + back.sum(axis=0)
            left = back @ np.linalg.solve(pivot, back.T)
            left = np.maximum((left + left.T) / 2, 0)
            left.flat[:: len(left) + 1] = 0
            out.append(left)
        return out

    def _all_beyond(self):
        """`_beyond` of each block, first block first. It is known from the last on: blocks that `KEPT` has no room for are worked out again."""
        last, kept, size = [np.zeros((w, w)) for w in self.wide[-1:]], {}, 0
        for b in range(len(self.blocks) - 1, -1, -1):
            kept[b] = self._beyond(b, last[-1])
            last.append(kept[b][-1])
            size += sum(x.size for x in kept[b])
            while size > KEPT and len(kept) > 1:
                size -= sum(x.size for x in kept.pop(next(iter(kept))))
        last.pop()
        for b in range(len(self.blocks)):
            given = last.pop()
            yield kept.pop(b) if b in kept else self._beyond(b, given)

    def tree(self, rng: np.random.Generator) -> np.ndarray:
        """The edges (pairs of nodes) of a random spanning tree, as likely as the product of its weights."""

        def numbers():
            while True:
                yield from rng.random(1024).tolist()

        draws, piece, now, k, found = numbers(), [0], self.layers[0].tolist(), 1, [np.empty((0, 2), np.int32)]
        for b, beyond in enumerate(self._all_beyond()):
            (lo, hi), (within, before) = self.blocks[b], self._edges(b)
            there, here, pull, to, weight, first = self._ways_back(b, before)
            starts, ends, begin = [], [], 0  # of the layer's nodes, among the block's by layer
            for i in range(lo, hi):
                if i == 0:
                    begin = int(self.wide[0])
                    continue
                last, now, w = now, self.layers[i].tolist(), int(self.wide[i])
                own, part = self._weights(within, i, b, w), slice(first[begin], first[begin + w])
                small = np.zeros((k + w, k + w))
                np.add(own, beyond[hi - 1 - i], out=small[k:, k:])
                small[:k, k:] = np.bincount(np.array(piece)[there[part]] * w + here[part], pull[part], k * w).reshape(k, w)
                small[k:, :k] = small[:k, k:].T
                label = list(range(k + w))  # of what final edges join, a forest of labels

                def top(x: int, label: list[int] = label) -> int:
                    while label[x] != x:
                        label[x] = x = label[label[x]]
                    return x

                reach = small.cumsum(axis=1)
                for x, y in enumerate(walked(reach.tolist(), draws, int(reach[:k, -1].argmax()))):
                    if y < 0:
                        continue
                    low, high = (x, y) if x < y else (y, x)
                    if low < k:
                        node = begin + high - k
                        ways = [e for e in range(first[node], first[node + 1]) if piece[to[e]] == low]
                        e = ways[0]
                        if len(ways) > 1:
                            left = next(draws) * sum([weight[e] for e in ways])
                            for e in ways:
                                left -= weight[e]
                                if left < 0:
                                    break
                        end = last[to[e]]
                    elif next(draws) * small[low, high] < own[low - k, high - k]:
                        end = now[low - k]
                    else:
                        continue
                    starts.append(end)
                    ends.append(now[high - k])
                    label[top(x)] = top(y)
                tops = [top(k + j) for j in range(w)]
                number = {t: n for n, t in enumerate(sorted(set(tops)))}
                piece, k, begin = [number[t] for t in tops], len(number), begin + w
            found.append(np.array([starts, ends], np.int32).T)
        return np.concatenate(found)


def rooted(edges: np.ndarray, root: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a tree's edges: (parents among n nodes, the tree's nodes, each after its parent)."""
    both = np.concatenate([edges, edges[:, ::-1]])
    by = np.argsort(both[:, 0], kind="stable")
    at, to = numbers_of(np.searchsorted(both[by, 0], np.arange(n + 1))), numbers_of(both[by, 1])
    del both, by
    parent, order = numbers_of(np.full(n, -1)), array("i", [root])
    for node in order:
        for other in to[at[node] : at[node + 1]]:
            if other != parent[node]:
                parent[other] = node
                order.append(other)
    return np.frombuffer(parent, np.int32), np.frombuffer(order, np.int32)


def numbers_of(values: np.ndarray) -> array:
    """For loops over single numbers: 4 or 8 bytes each, a tenth of a list's; a node's number fits into 4."""
    out = array("d" if values.dtype.kind == "f" else "i")
    out.frombytes(values.astype(out.typecode).tobytes())
    return out
