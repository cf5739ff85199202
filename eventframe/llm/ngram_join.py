"""Exact Jaccard join of documents on word n-grams, and its classes.

1. Each text becomes a sorted array of hashed shingles; equal arrays are one
   node. A bitmap signature holds the parity of how many shingles fall on each
   bit; two bitmaps differ in no more bits than their sets in elements.
2. Sets that can link share a shingle among the first of each, in one order
   that is the same for all: shingles of crowded cells of a fixed-size count
   sketch come last, so passages that many documents share hardly ever meet.
   This is exact: any order finds every pair.
3. Of each key's nodes, those of a size band are compared with one of them,
   which joins most copies in one step. A key whose nodes are not all joined
   by then belongs to the class that most of them are in, and all nodes of a
   class's keys form one block. A block is cut into tiles; in a tile, nodes of
   neighbouring size bands are compared, twice. First with their signatures
   alone: bit counts bound the overlap from above, and nodes that can't link
   with any go. The others come again with their sorted arrays, whose
   intersections settle what the bounds leave. A tile returns a spanning forest
   of its links, so that it never has more rows than members.
4. Connected components are merged by alternating stars.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import MASK, Memo, alone, batch, blocks, combined, dropped, fields, hash64, in_buckets, mixed, shared_dir, shuffle_partitions, stored, trimmed, unused

WORDS, PERCENT = 5, 75
#: Bits of a signature: a power of two of at least twice the set, between these.
LEAST_BITS, MOST_BITS = 64, 1 << 17
#: Leaders of keys that a node is compared with in the first step; the tiles settle all that are not joined by then.
LEADERS = 3
#: Cells of the count sketch, whatever the data; it is merged and sent in parts.
SKETCH_CELLS, SKETCH_PARTS = 1 << 22, 64
#: Bits of the filter that tells which documents a step needs; more documents only let more pass.
NEED_BITS = 1 << 23
#: Sets that a task knows to be done, and keys that it holds before it hands them on.
SETS_KEPT, KEYS_HELD = 100_000, 500_000
#: Nodes, and bytes of their arrays, at each side of a tile.
TILE, TILE_BYTES = 4096, 1 << 24
#: Entries of the sketch from which on a shingle's nodes are dealt to several tasks, by node.
HOT = 1 << 16


def shingle_sets(texts: list[bytes], memo: Memo, n: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text; a text of fewer words is one shingle, one of none has none."""
    words = [t.lower().split() for t in texts]
    hashes = np.fromiter(map(memo.__getitem__, (w for ws in words for w in ws)), np.uint64, sum(map(len, words)))
    shingles = combined([hashes[k : len(hashes) - n + 1 + k] for k in range(n)], n) if len(hashes) >= n else hashes[:0]
    out, at = [], 0
    for ws in words:
        if len(ws) >= n:
            out.append(np.unique(shingles[at : at + len(ws) - n + 1]))
        else:
            out.append(combined([hashes[at + k : at + k + 1] for k in range(len(ws))], len(ws)) if ws else hashes[:0])
        at += len(ws)
    return out


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))
    return h - (1 << 64) if h >> 63 else h


def signature(shingles: np.ndarray, bits: int | None = None) -> bytes:
    if bits is None:
        bits = LEAST_BITS
        while bits < min(2 * len(shingles), MOST_BITS):
            bits *= 2
    at = (mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sig: bytes, size: int) -> np.ndarray:
    """A signature brought down to ``size`` bytes: halves added bit by bit."""
    x = np.frombuffer(sig, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.uint64)


def may_link(sizes: np.ndarray, differing: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets whose sizes add up to ``sizes`` can link, if their signatures differ in so many bits."""
    return (100 + percent) * (sizes - differing) >= 2 * percent * sizes


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact condition, by intersection of the sorted arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def band_of(n: int, percent: int = PERCENT) -> int:
    """Size band: sets that link are in one band or in neighbouring ones."""
    return int(log(n) / log(100 / percent) + 1e-9)


# ---- step 1: sets, signatures and the count sketch ----------------------------------------------

_INFO, _INFO_ARROW = fields("row:long doc_id:long n:long node:long sig:binary part:int cells:binary")


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone("ngrams")
    memo, cells, seen = Memo(hash64), np.zeros(SKETCH_CELLS, np.uint32), False
    for b in batches:
        at = 0
        for block in blocks(b.column(2)):
            sets = shingle_sets(block, memo)
            rows = [(len(s), node_of(s), signature(s)) if len(s) else (0, None, None) for s in sets]
            n, node, sig = zip(*rows)
            every = np.concatenate(sets)
            if len(every):
                seen = True
                np.add.at(cells, (every % np.uint64(SKETCH_CELLS)).astype(np.int64), np.uint32(1))
            yield batch(_INFO_ARROW, *[b.column(k).slice(at, len(block)) for k in (0, 1)], n, node, sig, [None] * len(n), [None] * len(n))
            at += len(block)
    if seen:
        packed = [zlib.compress(c.tobytes(), 1) for c in np.split(cells, SKETCH_PARTS)]
        none = [None] * SKETCH_PARTS
        yield batch(_INFO_ARROW, none, none, none, none, none, range(SKETCH_PARTS), packed)


_PART, _PART_ARROW = fields("part:int cells:binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held[part] = held.get(part, 0) + np.frombuffer(zlib.decompress(cells), np.uint32).astype(np.uint64)
    for part, counts in held.items():
        yield batch(_PART_ARROW, [part], [zlib.compress(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)])


@dataclass
class Crowding:
    """Of each cell of the sketch, how full it is; of each such level, among how many tasks a shingle's nodes are dealt."""

    level: np.ndarray
    tasks: np.ndarray


def crowding(info: DataFrame) -> Crowding:
    """Levels are quarters of a standard deviation from four below the mean up, then by magnitude."""
    parts = info.where("part is not null").select("part", "cells").repartition(SKETCH_PARTS // 4, "part")
    packed = {r["part"]: r["cells"] for r in parts.mapInArrow(_summed, _PART).collect()}
    counts = lambda part: np.frombuffer(zlib.decompress(packed[part]), np.uint32)  # noqa: E731  one part unpacked at a time
    mean = sum(int(counts(part).sum(dtype=np.uint64)) for part in packed) / SKETCH_CELLS
    level, most = np.zeros((SKETCH_PARTS, SKETCH_CELLS // SKETCH_PARTS), np.uint8), np.zeros(256, np.int64)
    for part in packed:
        c = counts(part)
        away = (c - mean) / max(1.0, np.sqrt(mean))
        level[part] = np.clip(np.floor(8 * (np.minimum(away, 12) + 4)) + 8 * np.log2(np.maximum(away, 12) / 12), 0, 255)
        np.maximum.at(most, level[part], c.astype(np.int64))
    packed.clear()
    trimmed()
    return Crowding(level.ravel(), np.maximum(1, -(-most // HOT)))


# ---- step 2: keys ----------------------------------------------------------------------------------

_BUCKET, _BUCKET_ARROW = fields("bucket:int entries:binary")
_ENTRY = np.dtype([("key", "<u8"), ("node", "<i8"), ("band", "u1"), ("dealt", "u1")])
_KEYED, _KEYED_ARROW = fields("key:long node:long leader:long other:long dealt:boolean")


def _keys(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("ngrams")
        crowded, memo = shared.value, Memo(hash64)
        done: set[int] = set()
        places, entries, held = [], [], 0

        def packed() -> pa.RecordBatch:
            parts = list(in_buckets(np.concatenate(places), np.concatenate(entries), buckets))
            return batch(_BUCKET_ARROW, [p for p, _ in parts], [e for _, e in parts])

        for b in batches:
            for block in blocks(b.column(0)):
                for s in shingle_sets(block, memo):
                    if not len(s) or (node := node_of(s)) in done:
                        continue
                    if len(done) > SETS_KEPT:
                        done.clear()
                    done.add(node)
                    level = crowded.level[(s % np.uint64(SKETCH_CELLS)).astype(np.int64)]
                    chosen = np.argsort(level, kind="stable")[: prefix_length(len(s))]
                    first, tasks = s[chosen], crowded.tasks[level[chosen]]
                    own = np.empty(len(first), _ENTRY)
                    own["key"], own["node"], own["band"], own["dealt"] = first, node, band_of(len(s)), tasks > 1
                    places.append(mixed(first) + np.uint64(0x9E3779B97F4A7C15) * (np.uint64(node & MASK) % tasks.astype(np.uint64)))
                    entries.append(own)
                    held += len(first)
                if held > KEYS_HELD:
                    yield packed()
                    places, entries, held = [], [], 0
        if held:
            yield packed()
        places, entries = [], []
        trimmed()

    return run


def _met_in(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of one bucket: entries whose key another node has too, each with two leaders, of its band or of the one below."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    same = rows["key"][1:] == rows["key"][:-1]
    rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (rows["dealt"] > 0)]
    if not len(rows):
        return
    key, node, band, dealt = np.ascontiguousarray(rows["key"]), rows["node"], rows["band"].astype(np.int64), rows["dealt"] > 0
    order = np.lexsort((node, band, key))
    key, node, band, dealt = key[order], node[order], band[order], dealt[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (node[1:] != node[:-1])])
    key, node, band, dealt = key[new], node[new], band[new], dealt[new]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (band[1:] != band[:-1])]))
    size, least = np.diff(np.append(first, len(key))), node[first]
    group = np.repeat(np.arange(len(first)), size)
    below = np.concatenate([[False], (key[first[1:]] == key[first[:-1]]) & (band[first[1:]] == band[first[:-1]] + 1)])
    above = np.append(below[1:], False)
    leader = np.where(below, np.minimum(least, np.concatenate([[0], least[:-1]])), least)
    other = node[np.append(first[1:], len(key)) - 1]
    keep = ((size > 1) | below | above)[group] | dealt
    columns = (key[keep].view(np.int64), node[keep], leader[group][keep], other[group][keep], dealt[keep])
    for at in range(0, len(columns[0]), 100_000):
        yield batch(_KEYED_ARROW, *[c[at : at + 100_000] for c in columns])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: one bucket is held at a time."""
    bucket, held = None, []
    for b in batches:
        for own, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if own != bucket and held:
                yield from _met_in(np.frombuffer(b"".join(held), _ENTRY))
                held = []
            bucket = own
            held.append(e)
    if held:
        yield from _met_in(np.frombuffer(b"".join(held), _ENTRY))
    held = []
    trimmed()


# ---- step 3: exact verification ---------------------------------------------------------------------

_SET, _SET_ARROW = fields("node:long shingles:binary")


def _fetched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("ngrams")
        needed, memo = shared.value, Memo(hash64)
        done: set[int] = set()
        for b in batches:
            bit = b.column(0).to_numpy()
            wanted = (needed[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
            for block in blocks(b.column(1).filter(pa.array(wanted))):
                sets = {node_of(s): s for s in shingle_sets(block, memo) if len(s)}
                sets = {n: s for n, s in sets.items() if n not in done}
                if len(done) > SETS_KEPT:
                    done.clear()
                done.update(sets)
                yield batch(_SET_ARROW, list(sets), [s.tobytes() for s in sets.values()])

    return run


def _need_bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(NEED_BITS))


@F.arrow_udf(T.BooleanType())
def _bound(n_a: pa.Array, n_b: pa.Array, sig_a: pa.Array, sig_b: pa.Array) -> pa.Array:
    out = []
    for n, m, s, t in zip(n_a.to_pylist(), n_b.to_pylist(), sig_a.to_pylist(), sig_b.to_pylist()):
        size = min(len(s), len(t))
        out.append(bool(may_link(n + m, int(np.bitwise_count(folded(s, size) ^ folded(t, size)).sum()))))
    return pa.array(out, pa.bool_())


@F.arrow_udf(T.BooleanType())
def _links(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _sets(wanted: DataFrame, docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """node and shingles of at least the nodes of documents ``wanted`` (doc_id), made again from their texts; and what to destroy when they have been read."""
    bits = wanted.select(_need_bit(F.col("doc_id")).alias("bit")).groupBy(F.floor(F.col("bit") / 32).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("on")).toArrow()
    needed = np.zeros(NEED_BITS // 32, np.uint32)
    needed[bits["at"].to_numpy()] = bits["on"].to_numpy().astype(np.uint32)
    shared = wanted.sparkSession.sparkContext.broadcast(needed)
    return docs.select(_need_bit(F.col("doc_id")).alias("bit"), "text").mapInArrow(_fetched(shared), _SET).dropDuplicates(["node"]), shared


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, folder: str, name: str) -> DataFrame:
    """Pairs (a, b) of nodes that link, stored; only the sets of nodes in pairs are made again and moved."""
    sets, shared = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), docs)
    whole = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    found = stored(whole.where(_links("x", "y")).select("a", "b"), folder, name)
    shared.destroy()
    return found


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures leave a link possible."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    return pairs.where(_bound("n_a", "n_b", "sig_a", "sig_b")).select("a", "b")


_PAIR, _PAIR_ARROW = fields("a:long b:long")


class Tile:
    """Nodes of one tile, with their sorted arrays side by side and their signatures by width."""

    def __init__(self, rows: pa.Table):
        self.asks, self.stays, self.node, self.n = (rows[c].to_numpy() for c in ("asks", "stays", "node", "n"))
        names, self.label = np.unique(rows["label"].to_numpy(), return_inverse=True)
        #: The class that each label is in by now.
        self.joined = np.arange(len(names))
        self.band = np.array([band_of(n) for n in self.n.tolist()])
        if "shingles" in rows.column_names:
            arrays = rows["shingles"].to_pylist()
            self.shingles = np.frombuffer(b"".join(arrays), np.uint64)
            self.ends = np.cumsum([len(x) // 8 for x in arrays])
        sigs = rows["sig"].to_pylist()
        self.width = np.array([len(x) for x in sigs])
        self.places = {int(w): np.flatnonzero(self.stays & (self.width == w)) for w in np.unique(self.width)}
        self.bits = {w: np.frombuffer(b"".join(sigs[i] for i in at), np.uint64).reshape(len(at), w // 8) for w, at in self.places.items()}
        self.sigs = sigs

    def set_of(self, i: int) -> np.ndarray:
        return self.shingles[self.ends[i] - self.n[i] : self.ends[i]]

    def candidates(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Members in other classes whose signatures leave a link with ``p`` possible, and by how many bits each pair differs."""
        found, apart = [], []
        for width, at in self.places.items():
            use = (np.abs(self.band[at] - self.band[p]) <= 1) & (self.joined[self.label[at]] != self.joined[self.label[p]])
            if not use.any():
                continue
            at, bits, size = at[use], self.bits[width][use], min(width, int(self.width[p]))
            while bits.shape[1] * 8 > size:
                half = bits.shape[1] // 2
                bits = bits[:, :half] ^ bits[:, half:]
            differing = np.bitwise_count(bits ^ folded(self.sigs[p], size)).sum(1, dtype=np.int64)
            may = may_link(self.n[at] + self.n[p], differing)
            found.append(at[may])
            apart.append(differing[may])
        return (np.concatenate(found), np.concatenate(apart)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def near(self) -> np.ndarray:
        """Nodes that may link with one of another class."""
        out = np.zeros(len(self.node), bool)
        for p in np.flatnonzero(self.asks):
            others, _ = self.candidates(p)
            if len(others):
                out[p] = True
                out[others] = True
        return np.unique(self.node[out])

    def linked(self, p: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` link with ``p``, by intersecting the sorted arrays."""
        own, sizes = self.set_of(p), self.n[others]
        starts = np.cumsum(sizes) - sizes
        every = self.shingles[np.repeat(self.ends[others] - sizes - starts, sizes) + np.arange(int(sizes.sum()))]
        hits = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        both = np.add.reduceat(hits.astype(np.int64), starts)
        return 100 * both >= PERCENT * (sizes + len(own) - both)

    def forest(self) -> list[tuple[int, int]]:
        """Links that join all classes that any link of an asking node and a member joins; at most one less than there are nodes."""
        out = []
        for p in np.flatnonzero(self.asks):
            others, apart = self.candidates(p)
            for hopeful in (True, False):  # the likeliest of each class first: mostly that settles it
                others, apart = (x[self.joined[self.label[others]] != self.joined[self.label[p]]] for x in (others, apart))
                if not len(others):
                    break
                tried = others
                if hopeful:
                    order = np.lexsort((apart, self.joined[self.label[others]]))
                    tried = others[order][np.unique(self.joined[self.label[others]][order], return_index=True)[1]]
                for q in tried[self.linked(p, tried)]:
                    mine, its = self.joined[self.label[p]], self.joined[self.label[q]]
                    if mine != its:
                        out.append((int(self.node[p]), int(self.node[q])))
                        self.joined[self.joined == its] = mine
        return out


_NEAR, _NEAR_ARROW = fields("block:long node:long")


def _near(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    nodes = Tile(pa.Table.from_batches(held)).near()
    return batch(_NEAR_ARROW, np.full(len(nodes), held[0].column(0)[0].as_py()), nodes)


def _forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    links = Tile(pa.Table.from_batches(held)).forest()
    return batch(_PAIR_ARROW, [a for a, _ in links], [b for _, b in links])


def _tiles(settled: Callable[[list[pa.RecordBatch]], pa.RecordBatch]):
    """What ``settled`` makes of each tile, of rows sorted by tile; one tile is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            tile = np.stack([b.column(c).to_numpy() for c in ("block", "row", "col")])
            new = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(0)) + 1
            cuts = [0, *new.tolist(), b.num_rows]
            for k, (at, end) in enumerate(zip(cuts, cuts[1:])):
                if held and (k or [held[-1].column(c)[-1].as_py() for c in ("block", "row", "col")] != tile[:, 0].tolist()):
                    yield settled(held)
                    held = []
                if end > at:
                    held.append(b.slice(at, end - at))
        if held:
            yield settled(held)
        held = []
        trimmed()

    return run


def _open_members(keyed: DataFrame, labels: DataFrame) -> DataFrame:
    """block, node, label, asks: the nodes of all keys whose nodes are in several classes, in the block of the class that most are in.

    Any two nodes of such a key meet in its block; if their classes differ,
    one of them is not of the block's class, and asks. Keys of one group of
    near copies mostly agree on the block, so a node is in few.
    """
    rows = keyed.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per = rows.groupBy("key", "label").agg(F.count("*").alias("alike"))
    keys = per.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("alike", "label"))["label"].alias("block")).where("classes > 1")
    members = rows.join(keys.select("key", "block"), "key").groupBy("block", "node").agg(F.max("label").alias("label"))
    return members.withColumn("asks", F.col("label") != F.col("block"))


def _tiled(members: DataFrame, nodes: DataFrame, carried: DataFrame, width: Column) -> DataFrame:
    """Rows of all tiles of all blocks, sorted by tile: members with what they carry (by node; ``width``: its bytes, of ``n``).

    An asking node stays in one row of tiles and asks in all columns; any other
    stays in one column of all rows.
    """
    sized = members.join(nodes.select("node", "n"), "node").withColumn("width", width)
    count = lambda which: F.greatest(F.ceil(F.count(F.when(which, 1)) / TILE), F.ceil(F.sum(F.when(which, F.col("width"))) / TILE_BYTES), F.lit(1)).cast("int")
    grids = sized.groupBy("block").agg(count(F.col("asks")).alias("rows"), count(F.lit(True)).alias("cols"))
    lot = F.xxhash64("node")
    row, col = F.pmod(lot, F.col("rows")).cast("int"), F.pmod(lot, F.col("cols")).cast("int")
    place = lambda r, c, asks, stays: F.struct(r.alias("row"), c.alias("col"), asks.alias("asks"), stays.alias("stays"))
    stays = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: place(r, col, F.col("asks") & (r == row), F.lit(True)))
    asks = F.transform(F.filter(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: c != col), lambda c: place(row, c, F.lit(True), F.lit(False)))
    placed = sized.join(grids, "block").select("block", "node", "label", "n", F.explode(F.when(F.col("asks"), F.concat(stays, asks)).otherwise(stays)).alias("t"))
    placed = placed.select("block", "t.*", "node", "label", "n").join(carried, "node")
    return placed.repartition(4 * shuffle_partitions(members.sparkSession), "block", "row", "col").sortWithinPartitions("block", "row", "col")


def _block_links(members: DataFrame, nodes: DataFrame, docs: DataFrame, folder: str) -> DataFrame:
    """Links of nodes of one block that are in different classes, stored: enough of them to join all classes that any link joins."""
    sigs = nodes.select("node", "sig")
    tiles = _tiled(members, nodes, sigs, F.col("n") / 4).select("block", "row", "col", "asks", "stays", "node", "label", "n", "sig")
    near = stored(tiles.mapInArrow(_tiles(_near), _NEAR), folder, "near").distinct()
    members = stored(members.join(near, ["block", "node"], "left_semi"), folder, "near_members")
    sets, shared = _sets(members.select("node").distinct().join(nodes, "node"), docs)
    tiles = _tiled(members, nodes, sets.join(sigs, "node"), F.col("n") * 8).select("block", "row", "col", "asks", "stays", "node", "label", "n", "sig", "shingles")
    links = stored(tiles.mapInArrow(_tiles(_forest), _PAIR), folder, "links2")
    shared.destroy()
    return links


# ---- step 4: components ------------------------------------------------------------------------------


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Node and smallest node of its component, of all nodes in ``edges`` (a, b), by alternating stars.

    Each round is a stored table; rounds grow with the logarithm of a component's size.
    """
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select("b", "a")) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        moved = joined.where("b > a") if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (out if large else out.union(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct()

    now, state, turn = edges.where("a <> b").select("a", "b").distinct(), None, 0
    while True:
        now = stored(stars(stars(now, True), False), folder, f"stars{turn}")
        turn += 1
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def _classes(docs: DataFrame, row: Column, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, n_shingles, node, root and component_id of each row of ``docs``."""
    spark = docs.sparkSession
    folder, parts = shared_dir(spark), shuffle_partitions(spark)
    slim = docs.select(row.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    info = stored(slim.mapInArrow(_described, _INFO), folder, "info")
    own = info.where("part is null")
    nodes = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = stored(nodes, folder, "nodes")
    crowded = spark.sparkContext.broadcast(crowding(info))
    entries = slim.select("text").mapInArrow(_keys(crowded, 4 * parts), _BUCKET).repartition(parts, "bucket").sortWithinPartitions("bucket")
    keyed = stored(entries.mapInArrow(_met, _KEYED), folder, "keyed")
    crowded.destroy()
    texts = slim.select("doc_id", "text")
    leading = keyed.select("node", F.explode(F.array("leader", "other")).alias("a"))
    # of a key that was dealt to several tasks, the leaders meet too
    heads = keyed.where("dealt").select("key", F.col("leader").alias("node")).distinct()
    leading = leading.union(heads.join(heads.groupBy("key").agg(F.min("node").alias("a")), "key").select("node", "a"))
    votes = leading.where("a <> node").groupBy("node", "a").agg(F.count("*").alias("shared"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "a"))
    chosen = votes.withColumn("place", best).where(F.col("place") <= LEADERS).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    first = _verified(stored(_bounded(chosen, nodes), folder, "chosen"), nodes, texts, folder, "links1")
    labels = components(first, f"{folder}/first").withColumnRenamed("root", "label")
    members = stored(_open_members(keyed, labels), folder, "members")
    second = _block_links(members, nodes, texts, folder)
    roots = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(second), f"{folder}/last")
    rooted = nodes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, folder, "rooted")
    dropped(spark, folder, "nodes", "keyed", "chosen", "links1", "members", "near", "near_members", "links2", "first", "last")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.join(least, "root").select("node", "root", "component_id")
    rows = own.select("row", "doc_id", F.col("n").alias("n_shingles"), "node").join(classes, "node", "left")
    return rows.select("row", "doc_id", "n_shingles", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def similarity_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A null or empty text, or one of white space, has no shingles and is its
    own component. Rows with equal sets are one node, so any number of copies
    costs one comparison. Ids may repeat: each row's own text counts. A
    component's id is its smallest non-null doc_id.
    """
    return _classes(docs, F.lit(None).cast("long"), doc_id, text).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their components, with all their columns.

    Of a component the row with the smallest id stays (null ids last; of rows
    with one id, the first in the table). Rows without shingles all stay.
    ``docs`` must read the same each time, as a Parquet table does.
    """
    folder, mark = shared_dir(docs.sparkSession), unused("row", docs)
    numbered = stored(docs.withColumn(mark, F.monotonically_increasing_id()), folder, "numbered")
    found = _classes(numbered, F.col(mark), doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    stay = found.where("root is not null").groupBy("root").agg(F.min(order)["row"].alias("stays"))
    gone = found.join(stay, "root").where("row <> stays").select(F.col("row").alias(mark))
    # those that go are fewer than those that stay, and stored their size is known: Spark sends them around while they are few
    gone = stored(gone, folder, "gone")
    return numbered.join(gone, mark, "left_anti").drop(mark)


#: Brute force in SQL: distinct shingles, all pairs that share one, components by recursion.
ORACLE_SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end sh
  from d),
n as (select doc_id, sh, len(sh) n from s),
t as (select hash(sh) h, min(doc_id) rep, any_value(sh) sh, any_value(n) n from (select doc_id, list_sort(sh) sh, n from n where n > 0) group by hash(sh)),
o as (select doc_id, rep from (select doc_id, hash(list_sort(sh)) h from n where n > 0) join t using (h)),
x as (select rep, n, unnest(sh) g from t),
r as (select g from x group by g having count(*) > 1),
y as (select x.* from x join r using (g)),
p as (
  select a.rep a, b.rep b from y a join y b on a.g = b.g and a.rep < b.rep and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e as (select a, b from p union all select b, a from p),
c as (select rep node, rep root from t union select e.b, c.root from c join e on e.a = c.node),
m as (select node, min(root) root from c group by node)
select n.doc_id, cast(n.n as bigint) n_shingles, coalesce(m.root, n.doc_id) component_id
from n left join o using (doc_id) left join m on m.node = o.rep
"""
