"""Exact Jaccard join of documents on word n-grams.

Documents are sets of 64-bit shingle hashes; equal sets are one node. The join finds all pairs of nodes whose similarity reaches
the threshold, but for those that verified links already connect:

1. Tiles. Two linked sets share k shingles among the first n - ceil(t * n) + k of each in one common order, here rare shingles
   first; k grows with the sets. Prefix shingles are dealt to shards, frequent ones in bands of size; a tile is the nodes of one prefix shingle
   in the order of their sizes. Only nodes that have a partner, by sizes and places, in at least k tiles go on, each with its tiles.
2. Leaders. Of the nodes that go on, those that share a minimum of a hash function pass in the order of their sizes, and each is paired
   with one of the last few that came before it and are like none before them. That is at most one pair for each node and function,
   and connects nearly all of a family of near copies.
3. Bitmaps. A node's bitmap has at least two bits a shingle, in which every shingle toggles one bit. The bits in which two
   bitmaps differ are at most the symmetric difference, so that their count bounds the overlap from above. The nodes of a tile
   that have different labels (of components so far) meet in a task, large tiles in pairs of blocks; pairs that sizes, places and bitmaps allow
   are candidates.
4. What is left is intersected exactly, as sorted arrays.

In the first passes over the tiles a task gives a spanning forest of its candidates, the most similar first: fewer pairs than it has
nodes, whatever a family's size. Nodes with pairs that were held back meet again under their new labels; the last pass gives every pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import Scratch, fresh, giving_back, giving_back_group, shard_count, text_blocks, written
from weirflow.llm.linkage import components

#: Buckets in which tasks count shingles, and the frequent ones that a task reports and that are kept.
BUCKETS, REPORT, FREQUENT = 1 << 20, 2_048, 65_536
#: Hash functions whose minima are compared, and nodes that others of a minimum are compared with.
LEADERS, HELD = 4, 8
#: Nodes for which the rows of one minimum are dealt to one more task.
SALT = 4_000_000
WORD_CACHE = 100_000
#: Sets that a task remembers, so that copies of one give their prefix once.
SEEN = 500_000
#: Rows of an id table that may be broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Bytes of prefix entries in a shard, and nodes of a tile that meet in one task.
SHARD_BYTES, BLOCK = 4 << 20, 8_192
#: Passes over the tiles: all but the last give forests.
PASSES = 3
#: Shingles for each one more that two prefixes must share.
SHARED = 40
#: Places that an entry looks ahead for its partners before all in reach are taken to be some.
LOOK = 64
#: Pairs that a task holds before it thins them out; a quarter of that is looked at together, in some ten arrays.
HOLD = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEEDS = [np.uint64(0xA24BAED4963EE407 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(LEADERS + 2)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles; of its whole sequence if it has fewer words; none without words."""
    words = text.encode().lower().split()  # bytes: only A-Z change, and only ASCII white space separates
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    total = np.full(len(codes) - width + 1, np.uint64(width))
    for k in range(width):
        total = mix(total * _ODD + codes[k : k + len(total)])
    return np.unique(total)


def set_id(values: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    digest = xxhash.xxh3_64_intdigest(values.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def bitmap(values: np.ndarray) -> np.ndarray:
    """Words of a bitmap of at least two bits a value, at most 2 ** 16 bits; each value toggles one bit."""
    bits = 64
    while bits < min(1 << 16, 2 * len(values)):
        bits *= 2
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def overlap_bound(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> int:
    """An upper bound of two sets' overlap from their bitmaps; the longer one is folded, which keeps parities."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return (size_a + size_b - int(np.bitwise_count(a ^ b).sum())) // 2


def brief(bits: np.ndarray) -> np.ndarray:
    """A bitmap folded to a quarter, but not below 512 bits."""
    for _ in range(2):
        if len(bits) > 8:
            bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def similar(overlap: int, size_a: int, size_b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (size_a + size_b - overlap)


_SETS = "kind int, doc_id long, row long, n_shingles long, sid long, bucket long, count long"


def _sets(n: int):
    """A row for each document (kind 0), and a task's frequent buckets (kind 1)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(BUCKETS, np.int64)
        names = ["kind", "doc_id", "row", "n_shingles", "sid", "bucket", "count"]
        kinds = [pa.int32()] + [pa.int64()] * 6
        for batch in text_blocks(batches):
            sets = [shingle_set(text or "", n, hashes) for text in batch.column("text").to_pylist()]
            seen = [v for v in sets if len(v)]
            if seen:
                counts += np.bincount((np.concatenate(seen) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS)
            none = pa.nulls(len(sets), pa.int64())
            columns = ([0] * len(sets), batch.column("doc_id"), batch.column("row"), [len(v) for v in sets], [set_id(v) if len(v) else None for v in sets], none, none)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)
        top = np.argsort(counts)[-REPORT:]
        top = top[counts[top] > 8 * counts.mean() + 16]
        none = pa.nulls(len(top), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(top), pa.int32()), none, none, none, none, pa.array(top), pa.array(counts[top])], names)

    return run


#: A node in a tile: the tile, the set's size, the shingle's place in its order, the side of a pair of blocks (0: any), the set.
_ENTRY = np.dtype([("tile", "<u4"), ("size", "<u4"), ("place", "<u4"), ("side", "u1"), ("sid", "<i8")])


def shared_least(size, percent: int):
    """How many shingles two linked sets share in their prefixes at least, if the smaller one has this size (a number or an array)."""
    return np.minimum(1 + size // SHARED, -(-percent * size // 100))


def prefix_length(size: int, percent: int) -> int:
    """size - ceil(t * size) and the shingles that are shared: those of the overlap that come first in the order lie in both prefixes."""
    return size + (-percent * size) // 100 + int(shared_least(size, percent))


def size_band(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Bands of sizes, a little wider than similar sets can differ: those are in the same one or in neighbours."""
    return np.floor(np.log(sizes) / (-1.001 * math.log(min(0.99, percent / 100)))).astype(np.int64)


def _prefixes(n: int, percent: int, shards: int, frequent):
    """Blobs of prefix entries by shard. Copies of a set in a task count once."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, level, known = WordHashes(), np.zeros(BUCKETS, np.uint8), set()
        if len(frequent.value):
            level[frequent.value[:, 0]] = np.minimum(255, 4 * np.log2(frequent.value[:, 1] + 1)).astype(np.uint8)
        for batch in text_blocks(batches):
            shingles, sizes, sids, common = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text or "", n, hashes)
                sid = set_id(values) if len(values) else None
                if sid is None or sid in known:
                    continue
                if len(known) < SEEN:
                    known.add(sid)
                rank = level[(values >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)]
                order = np.lexsort((mix(values), rank))[: prefix_length(len(values), percent)]
                shingles.append(values[order]), common.append(rank[order] > 0), sizes.append(len(values)), sids.append(sid)
            if not shingles:
                continue
            lengths = np.array([len(s) for s in shingles])
            spread, common = mix(np.concatenate(shingles)), np.concatenate(common)
            entries = np.zeros(len(spread), _ENTRY)
            entries["size"], entries["sid"] = np.repeat(np.array(sizes), lengths), np.repeat(np.array(sids), lengths)
            entries["place"] = np.arange(len(spread)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            # The nodes of a frequent shingle are dealt by their band of sizes, and meet those of the next band there.
            band = size_band(entries["size"][common].astype(float), percent).astype(np.uint64)
            again = entries[common]
            twice = mix(spread[common] + band + np.uint64(1))
            spread_of = np.concatenate([spread, mix(spread[common] + band + np.uint64(2))])
            spread_of[: len(spread)][common] = twice
            entries = np.concatenate([entries, again])
            entries["tile"] = (spread_of & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            shard = ((spread_of >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            parts = np.split(entries[order], cuts)
            yield pa.RecordBatch.from_arrays([pa.array(shard[order][np.r_[0, cuts]]), pa.array([p.tobytes() for p in parts], pa.binary())], ["shard", "blob"])

    return run


def in_order(entries: np.ndarray) -> np.ndarray:
    """The order by tile, size and set."""
    return np.lexsort((entries["sid"], entries["size"], entries["tile"]))


def _near(tile: np.ndarray, size: np.ndarray, at: np.ndarray, to: np.ndarray, percent: int) -> np.ndarray:
    return (tile[at] == tile[to]) & (100 * size[at] >= percent * size[to])


def _allowed(entries: np.ndarray, label: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of entries of one tile can be similar by their places, and are asked for.

    A tile has to give a pair only if its shingle is one of the first that both share: what precedes it holds fewer of the overlap than that.
    """
    size, place, side = entries["size"].astype(np.int64), entries["place"].astype(np.int64), entries["side"]
    rest = np.minimum(size[a] - place[a], size[b] - place[b]) + shared_least(np.minimum(size[a], size[b]), percent) - 1
    fine = (label[a] != label[b]) & (100 * rest >= percent * (size[a] + size[b] - rest))
    return fine & ((side[a] == 0) | (side[a] != side[b]))


def allowed_pairs(entries: np.ndarray, label: np.ndarray, percent: int, look: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of sorted entries with different labels which sizes and places allow to be similar, in blocks.

    In each tile the entries of its most frequent label are not compared with one another: the others are, and each of them with those of
    that label whose sizes are in reach. With look, others are compared that many places ahead; pairs further away are given unchecked, in part.
    """
    if not len(entries):
        return
    tile, size = entries["tile"], entries["size"].astype(np.int64)
    # The most frequent label of each tile.
    order = np.lexsort((label, tile))
    run = np.flatnonzero(np.r_[True, (tile[order][1:] != tile[order][:-1]) | (label[order][1:] != label[order][:-1])])
    count = np.diff(np.r_[run, len(order)])
    tiles, of = np.unique(tile[order][run], return_inverse=True)
    best = np.lexsort((count, of))
    best = best[np.flatnonzero(np.r_[of[best][1:] != of[best][:-1], True])]
    main = np.zeros(len(entries), bool)
    main[order] = np.repeat(np.isin(np.arange(len(run)), best), count)
    others, mains = np.flatnonzero(~main), np.flatnonzero(main)
    # Others with the main label's, found by their sizes.
    if len(others):
        key = (tile[mains].astype(np.uint64) << np.uint64(32)) | size[mains].astype(np.uint64)
        head = tile[others].astype(np.uint64) << np.uint64(32)
        low = np.searchsorted(key, head | ((percent * size[others] + 99) // 100).astype(np.uint64))
        high = np.searchsorted(key, head | np.minimum(100 * size[others] // percent, (1 << 32) - 1).astype(np.uint64), "right")
        width = high - low
        ends = np.cumsum(width)
        begin, together = 0, max(1, HOLD // 4)
        while begin < len(others):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + together, "right")))
            for part in range(0, int(width[begin:end].max(initial=0)), together):  # one entry's pairs may be more than that
                w = np.clip(width[begin:end] - part, 0, together)
                a = np.repeat(others[begin:end], w)
                b = mains[np.repeat(low[begin:end] + part, w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)]
                fine = _allowed(entries, label, a, b, percent)
                yield a[fine], b[fine]
            begin = end
    # Others among themselves. Sizes rise in a tile: once a partner is too large for an entry, all later ones are.
    at = np.arange(len(others))
    for lag in range(1, len(others)):
        at = at[at + lag < len(others)]
        at = at[_near(tile, size, others[at], others[at + lag], percent)]
        if not len(at):
            return
        a, b = others[at], others[at + lag]
        if look is not None and lag > look:
            yield a, b
            continue
        fine = _allowed(entries, label, a, b, percent)
        yield a[fine], b[fine]


def with_partner(entries: np.ndarray, label: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sorted entries may have a partner with another label in their tile."""
    out = np.zeros(len(entries), bool)
    for a, b in allowed_pairs(entries, label, percent, LOOK):
        out[a] = out[b] = True
    return out


def blocks(entries: np.ndarray, percent: int, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted entries with the number of a part (0 for all of the small tiles): of a large tile, two blocks that sizes allow to meet."""
    if not len(entries):
        return
    heads = np.flatnonzero(np.r_[True, entries["tile"][1:] != entries["tile"][:-1]])
    lengths = np.diff(np.r_[heads, len(entries)])
    small = entries[np.repeat(lengths <= size, lengths)]
    if len(small):
        yield 0, small
    number = 0
    for head, length in zip(heads[lengths > size].tolist(), lengths[lengths > size].tolist()):
        cut = [entries[at : min(at + size, head + length)] for at in range(head, head + length, size)]
        for i, x in enumerate(cut):
            for j in range(i, len(cut)):
                y = cut[j]
                if i < j and 100 * int(x["size"][-1]) < percent * int(y["size"][0]):
                    break
                number += 1
                if i == j:
                    yield number, x
                else:
                    both = np.concatenate([x, y])
                    both["side"] = np.repeat([1, 2], [len(x), len(y)])
                    yield number, both


def _by_node(part: int, entries: np.ndarray, shard: int) -> pa.Table:
    """Entries in a row for each node."""
    entries = entries[np.argsort(entries["sid"], kind="stable")]
    heads = np.flatnonzero(np.r_[True, entries["sid"][1:] != entries["sid"][:-1]])
    parts = np.split(entries, heads[1:])
    ones = np.ones(len(heads), np.int64)
    return pa.table({"shard": shard * ones, "part": part * ones, "sid": entries["sid"][heads], "blob": pa.array([x.tobytes() for x in parts], pa.binary())})


_NODE = "shard long, part long, sid long, blob binary"
_NO_NODES = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("sid", pa.int64()), ("blob", pa.binary())]).empty_table()


def _partners(percent: int):
    """Of a shard, the nodes that may have a partner, each with its entries."""

    @giving_back_group
    def run(group: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in group.column("blob").combine_chunks()])
        entries = entries[in_order(entries)]
        # Copies of a set from several tasks.
        entries = entries[np.r_[True, (entries["tile"][1:] != entries["tile"][:-1]) | (entries["sid"][1:] != entries["sid"][:-1])]]
        entries = entries[with_partner(entries, entries["sid"], percent)]
        return _by_node(0, entries, group.column("shard")[0].as_py()) if len(entries) else _NO_NODES

    return run


def _apart(percent: int):
    """Of a shard's nodes (shard, part, sid, label, blob), those that may have a partner with another label, large tiles in pairs of blocks."""

    @giving_back_group
    def run(group: pa.Table) -> pa.Table:
        entries, node = _entries(group)
        order = in_order(entries)
        entries, label = entries[order], group.column("label").to_numpy()[node[order]]
        entries = entries[with_partner(entries, label, percent)]
        shard = group.column("shard")[0].as_py()
        found = [_by_node(part, own, shard) for part, own in blocks(entries, percent)]
        return pa.concat_tables(found) if found else _NO_NODES

    return run


def _entries(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a group's blobs, and the row of each."""
    parts = [np.frombuffer(x.as_buffer(), _ENTRY) for x in group.column("blob").combine_chunks()]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])


class Bitmaps:
    """Bitmaps of a group's nodes, in a matrix for each width."""

    def __init__(self, bitmaps: list[bytes]):
        self.width = np.array([len(b) // 8 for b in bitmaps])
        self.row = np.zeros(len(bitmaps), np.int64)
        self.matrix: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.matrix[w] = np.frombuffer(b"".join(bitmaps[i] for i in own.tolist()), np.uint64).reshape(len(own), w)

    def differing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bits differ in each pair, the wider bitmap folded to the other's width."""
        out = np.zeros(len(a), np.int64)
        kinds = self.width[a] * (1 << 32) + self.width[b]
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            wide, narrow = kind >> 32, kind & 0xFFFFFFFF
            step = max(1, (1 << 20) // max(wide, narrow))
            for begin in range(0, len(at), step):
                part = at[begin : begin + step]
                x, y = self.matrix[wide][self.row[a[part]]], self.matrix[narrow][self.row[b[part]]]
                while x.shape[1] > y.shape[1]:
                    x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                while y.shape[1] > x.shape[1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        return out


class Forest:
    """Candidates of a task, thinned to a forest over labels; entries whose pairs were held back are marked."""

    def __init__(self, sid: np.ndarray, label: np.ndarray, thin: bool):
        self.sid, self.label, self.thin = sid, label, thin
        self.held = np.zeros(len(sid), bool)
        self.a = self.b = np.zeros(0, np.int64)
        self.bound = np.zeros(0)

    def add(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> None:
        turn = self.sid[a] > self.sid[b]
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        self.a, self.b, self.bound = np.concatenate([self.a, a]), np.concatenate([self.b, b]), np.concatenate([self.bound, bound])
        if len(self.a) > HOLD:
            self.settle()

    def _keep(self, rows: np.ndarray) -> None:
        self.a, self.b, self.bound = self.a[rows], self.b[rows], self.bound[rows]

    def settle(self) -> None:
        """One row for each pair of nodes; if thin, the best ones that join labels."""
        order = np.lexsort((self.sid[self.b], self.sid[self.a], -self.bound))
        self._keep(order)
        pair = np.stack([self.sid[self.a], self.sid[self.b]], axis=1)
        self._keep(np.sort(np.unique(pair, axis=0, return_index=True)[1]))
        if not self.thin:
            return
        names, ends = np.unique(np.stack([self.label[self.a], self.label[self.b]]), return_inverse=True)
        ends = ends.reshape(2, -1)
        _, first = np.unique(np.sort(ends, axis=0), axis=1, return_index=True)
        root, chosen = list(range(len(names))), np.zeros(len(self.a), bool)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in np.sort(first).tolist():  # the most similar first
            x, y = find(int(ends[0, i])), find(int(ends[1, i]))
            if x != y:
                root[x] = y
                chosen[i] = True
        self.held[self.a[~chosen]] = self.held[self.b[~chosen]] = True
        self._keep(np.flatnonzero(chosen))


_FOUND = "a long, b long, u long, v long, " + _NODE


def _tiles(percent: int, thin: bool):
    """Candidates (a, b) of a group's nodes (sid, label, bits, blob) with their labels (u, v), and the nodes whose pairs are held back."""

    @giving_back_group
    def run(group: pa.Table) -> pa.Table:
        entries, node = _entries(group)
        order = in_order(entries)
        entries, node = entries[order], node[order]
        label, size = group.column("label").to_numpy()[node], entries["size"].astype(np.int64)
        bitmaps, forest = Bitmaps(group.column("bits").to_pylist()), Forest(entries["sid"], label, thin)
        for a, b in allowed_pairs(entries, label, percent):
            both = size[a] + size[b]
            bound = (both - bitmaps.differing(node[a], node[b])) // 2
            fine = 100 * bound >= percent * (both - bound)
            if fine.any():
                forest.add(a[fine], b[fine], (bound / np.maximum(1, both - bound))[fine])
        forest.settle()
        pairs = pa.table({"a": forest.sid[forest.a], "b": forest.sid[forest.b], "u": label[forest.a], "v": label[forest.b]})
        pairs = pa.table([*pairs.columns, *[pa.nulls(len(pairs), f.type) for f in _NO_NODES.schema]], [*pairs.schema.names, *_NO_NODES.schema.names])
        if not forest.held.any():
            return pairs
        back = _by_node(group.column("part")[0].as_py(), entries[forest.held], group.column("shard")[0].as_py())
        back = pa.table([*[pa.nulls(len(back), pa.int64())] * 4, *back.columns], pairs.schema.names)
        return pa.concat_tables([pairs, back])

    return run


_MARKS = "sid long, size long, bits binary, short binary, leaders array<long>, data binary"


def _marks(n: int):
    """Bitmaps, minima and sorted arrays of the sets asked for (columns text, sid)."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in text_blocks(batches, 1 << 20):
            rows = []
            for text, sid in zip(batch.column("text").to_pylist(), batch.column("sid").to_pylist()):
                values = shingle_set(text or "", n, hashes)
                if len(values) and set_id(values) == sid:  # else another row with this key
                    bits = bitmap(values)
                    rows.append((sid, len(values), bits.tobytes(), brief(bits).tobytes(), [int(mix(values ^ s).min().astype(np.int64)) for s in _SEEDS[:LEADERS]], values.tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["sid", "size", "bits", "short", "leaders", "data"])

    return run


def _folded(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits ^ (bits >> width)) & ((1 << width) - 1)
    return bits


def _led(percent: int):
    """Pairs (a, b) of rows (key, salt, size, sid, short) in this order: each with the likest of the leaders that a key has so far."""

    def likest(size: int, width: int, bits: int, leaders: list[tuple]) -> tuple | None:
        best, most = None, -1.0
        for leader in leaders:
            narrow = min(width, leader[1])
            differ = (_folded(bits, width, narrow) ^ _folded(leader[2], leader[1], narrow)).bit_count()
            bound = (size + leader[0] - differ) // 2
            if similar(bound, size, leader[0], percent) and bound / max(1, size + leader[0] - bound) > most:
                best, most = leader, bound / max(1, size + leader[0] - bound)
        return best

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leaders = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            new = np.r_[last != (key[0], salt[0]), (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
            last = key[-1], salt[-1]
            # The last row may go on in the next batch; others that are alone have no one to meet.
            rows = np.flatnonzero(~(new & np.r_[new[1:], False]))
            part = batch.take(pa.array(rows))
            a, b = [], []
            for fresh_key, sid, size, short in zip(new[rows].tolist(), part.column("sid").to_pylist(), part.column("size").to_pylist(), part.column("short").to_pylist()):
                width, bits = 8 * len(short), int.from_bytes(short, "little")
                leaders = [] if fresh_key else [x for x in leaders if 100 * x[0] >= percent * size]
                found = likest(size, width, bits, leaders)
                if found:
                    a.append(found[3]), b.append(sid)
                else:
                    leaders = [*leaders, (size, width, bits, sid)][-HELD:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


_LINK = "a long, b long, u long, v long"


def _verified(percent: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("data_a"), batch.column("data_b")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                keep.append(similar(int((b[np.minimum(at, len(b) - 1)] == a).sum()), len(a), len(b), percent))
            yield batch.select(["a", "b", "u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(marks: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, u, v) of a written table that are similar, by exact intersection of the sorted arrays."""
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    arrays = marks.select("sid", "data").join(_small(wanted), "sid", "left_semi")
    half = lambda s: arrays.select(F.col("sid").alias(s), F.col("data").alias(f"data_{s}"))
    return pairs.join(half("a"), "a").join(half("b"), "b").mapInArrow(_verified(percent), _LINK)


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast only if it was counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _relabelled(known: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """known (sid, label) with one label for all labels that links (u, v) connect."""
    found = components(links.select("u", "v"), scratch)
    new = known.join(found.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left")
    return scratch.replaced(new.select("sid", F.coalesce("new", "label").alias("label")), "known")


def row_key() -> Column:
    """A 64-bit key of a row with doc_id and text: rows share it only if they agree in doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text").cast("string"))


def linked(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    documents needs doc_id and text; other columns are ignored. Words are split at ASCII white space after A-Z are lower-cased; a
    document's set holds the hashes of its distinct shingles of words words, or of its whole sequence if that is shorter. Two
    documents link when 100 * overlap >= percent * union; component_id is the smallest doc_id that links reach, its own included.
    A null or empty text has no shingles and links with nothing. A null doc_id takes part, but is smallest only where all are
    null; rows that repeat are linked like other equal texts. An empty table gives an empty result.
    """
    return _linked(documents, words, percent).select("doc_id", "n_shingles", "component_id")


def _labels(docs: DataFrame, sets: DataFrame, nodes: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """sid, label of the nodes that may have a partner: the smallest sid that links reach."""
    spark = docs.sparkSession
    top = sets.where("kind = 1").groupBy("bucket").agg(F.sum("count").alias("n")).orderBy(F.col("n").desc(), "bucket").limit(FREQUENT)
    frequent = spark.sparkContext.broadcast(np.array([(r.bucket, r.n) for r in top.collect()], np.int64).reshape(-1, 2))
    # 1. Tiles. Shards have a bounded size, so that their number follows the data.
    share = (100 - percent) / 100 + 1 / SHARED
    volume = nodes.agg(F.sum(F.col("n_shingles") * share + 1), F.count(F.lit(1))).first()
    shards = max(shard_count(spark, 1), int(volume[0] or 0) * _ENTRY.itemsize // SHARD_BYTES)
    blobs = docs.select("text").mapInArrow(_prefixes(words, percent, shards, frequent), "shard long, blob binary")
    partners = scratch.written(blobs.groupBy("shard").applyInArrow(_partners(percent), _NODE), "partners")
    # Bitmaps, minima and arrays are made only for nodes that have a partner in tiles enough.
    tiles = partners.groupBy("sid").agg(F.sum(F.octet_length("blob") / _ENTRY.itemsize).alias("tiles"))
    smaller = F.ceil(F.col("n_shingles") * percent / 100)
    enough = F.least(1 + F.floor(smaller / SHARED), F.ceil(smaller * percent / 100))
    rows = scratch.written(nodes.join(tiles, "sid").where(F.col("tiles") >= enough).select("sid", "row"), "rows")
    texts = docs.join(_small(rows), "row").select("text", "sid")
    # Several rows may share the key: all columns follow from the set, so that any of them will do.
    made = texts.mapInArrow(_marks(words), _MARKS).groupBy("sid").agg(*[F.first(c).alias(c) for c in ("size", "bits", "short", "leaders", "data")])
    marks = scratch.written(made, "marks")
    # 2. Leaders.
    salts = 1 + int(volume[1] or 0) // SALT
    keyed = marks.select(F.explode("leaders").alias("key"), F.pmod(F.xxhash64("sid"), F.lit(salts)).alias("salt"), "size", "sid", "short")
    keyed = keyed.repartition("key", "salt").sortWithinPartitions("key", "salt", "size", "sid")
    pairs = keyed.mapInArrow(_led(percent), "a long, b long").distinct().select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = scratch.written(pairs, "pairs")
    known = scratch.written(marks.select("sid", F.col("sid").alias("label")), "known")
    known = _relabelled(known, _links(marks, pairs, percent), scratch)
    # 3 and 4. Passes over the tiles, until no pair is held back.
    now = scratch.written(partners.join(known, "sid").groupBy("shard").applyInArrow(_apart(percent), _NODE), "apart")
    for number in range(PASSES):
        met = now.join(marks.select("sid", "bits"), "sid").join(known, "sid")
        thin = number < PASSES - 1
        found = scratch.written(met.groupBy("shard", "part").applyInArrow(_tiles(percent, thin), _FOUND), "found")
        pairs = scratch.written(found.where("a is not null").groupBy("a", "b").agg(F.min("u").alias("u"), F.min("v").alias("v")), "pairs")
        if not pairs.isEmpty():
            known = _relabelled(known, _links(marks, pairs, percent), scratch)
        now = found.where("blob is not null").select("shard", "part", "sid", "blob")
        if not thin or now.isEmpty():
            break
    return known


def _linked(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """linked() with the key of each row and that of the row that stands for its component (its own where it has no shingles)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    sets = written(docs.mapInArrow(_sets(words), _SETS), "sets")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")
    with Scratch(documents.sparkSession) as scratch:
        # A set stands in the row of its least doc_id, of least key where several rows have that; null is last.
        nodes = sets.where("kind = 0 and sid is not null").groupBy("sid").agg(least, F.min("n_shingles").alias("n_shingles"))
        nodes = scratch.written(nodes.select("sid", "least.doc_id", "least.row", "n_shingles"), "nodes")
        known = _labels(docs, sets, nodes, words, percent, scratch).withColumnRenamed("label", "root")
        stands = nodes.join(known, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        # Sets without a partner stand for themselves: only components of several are put together.
        several = stands.groupBy("root").agg(least, F.count(F.lit(1)).alias("n")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("stand"))
        final = written(stands.select("sid", "root").join(several, "root").select("sid", "component_id", "stand"), "stands")
    rows = sets.where("kind = 0").select("doc_id", "row", "n_shingles", "sid")
    own = lambda mine, name: F.when(F.col("sid").isNull(), F.col(mine)).otherwise(F.col(name)).alias(name)
    return rows.join(final, "sid", "left").select("doc_id", "row", "sid", "n_shingles", own("doc_id", "component_id"), own("row", "stand"))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of documents for each component, all its columns, and all rows without shingles.

    The row with the component's smallest doc_id stays (null last; of several the one with the least key of doc_id and text). Rows
    are told apart by that key, so that other texts under the same or a null doc_id stay. Of rows that agree in doc_id and text the
    least by all columns stays.
    """
    key, least = fresh(documents, "key"), fresh(documents, "least")
    found = _linked(documents, words, percent).where("sid is not null").groupBy("row").agg(F.min("stand").alias("stand"), F.count(F.lit(1)).alias("n"))
    gone = written(found.where("row <> stand or n > 1").select(F.col("row").alias(key), (F.col("row") == F.col("stand")).alias("stands")), "gone")
    out = documents.join(_small(gone.select(key)), row_key() == F.col(key), "left_anti")
    repeated = gone.where("stands").select(key)
    if repeated.isEmpty():
        return out
    once = documents.join(_small(repeated), row_key() == F.col(key), "left_semi").groupBy(row_key()).agg(F.min(F.struct(*documents.columns)).alias(least))
    return out.unionByName(once.select(f"{least}.*"))
