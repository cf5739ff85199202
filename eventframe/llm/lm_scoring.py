"""Language-model scores from a log-frequency Bloom filter.

Training counts every word and every pair of adjacent words exactly; words and
pairs are told apart by 64-bit hashes. Counts of pairs are quantised to powers
of the square root of two and held in Bloom filters that have one entry per
pair and step: the steps are probed upwards until one is missing, which gives
the count back. The filter is cut into buckets, each built by one task and
sized by its own entries, so it grows with the corpus and nothing that grows
is broadcast: texts send their pairs to the buckets, in packed rows, and get
sums back.

Probabilities are smoothed by a Dirichlet prior: a word b after a has
(count(a b) + PRIOR share(b)) / (count(a) + PRIOR). The logarithm is a sum of
a term of b alone, a term of a alone and, for pairs that the filter holds,
log(1 + count(a b) / (PRIOR share(b))). Terms of the most frequent words, and
counts of the most frequent pairs, are broadcast, which keeps heavy keys out of
the shuffle. A pair goes to the bucket of its second word if that one isn't
broadcast, where its exact count is, and else to the bucket of the pair.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import MASK, batch, blocks, combined, dropped, fields, hash64, in_buckets, mixed, shared_dir, shuffle_partitions, stored

#: Words, and pairs of them, whose exact counts are broadcast; those of rarer ones are looked up in the buckets.
FREQUENT = 1 << 19
#: Counts from which on a pair may be broadcast; rarer ones are in the filter alone.
LEAST_PAIR = 4
#: Bits per entry and probes per entry of the filter; blocks are a power of two of 64-bit words.
BITS_PER_ENTRY, PROBES = 10, 6
BLOCK_WORDS = 1 << 12
PLACE_BITS = (64 * BLOCK_WORDS - 1).bit_length()
PER_DRAW = 64 // PLACE_BITS
#: Blocks whose bits are set as one byte each before they are packed.
SPREAD = 64
#: How many tokens after a word the shares of words are worth beside the counts of its pairs.
PRIOR = 16.0
#: Pending tokens, or pairs, that a training task holds before it counts them together.
PENDING = 4_000_000
#: Pairs that a scoring task holds before it sends them.
SENT = 1_000_000
#: Bytes of words up to which they are hashed together, eight bytes of all at a time; longer ones are few and hashed alone.
LONG = 64
#: Stand for the end of a text, and for what is before its first word; no word can hold a space.
END, START = b" end", b" start"
BASE = 2.0**0.5


#: What a word's hash starts from, by its length, and masks of the first bytes of eight.
_SEEDS = mixed(np.arange(1, LONG + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts, lower-cased words and one end each, and the number of tokens of each text."""
    joined = b" ".join([b"", *texts, b" " * 8]).lower()
    codes = np.frombuffer(joined, np.uint8)
    space = (codes == 32) | (codes - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # what begins at each byte
    hashes = mixed(_SEEDS[np.minimum(size, LONG)] ^ (eight[begin] & _FIRST[np.minimum(size, 8)]))
    live, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(live):
        left = size[live] - at
        hashes[live] = mixed((hashes[live] + np.uint64(0x9E3779B97F4A7C15)) ^ (eight[begin[live] + at] & _FIRST[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG):
        hashes[i] = hash64(joined[begin[i] : begin[i] + size[i]])
    words = np.diff(np.searchsorted(begin, np.cumsum([1, *(len(t) + 1 for t in texts)])))
    return np.insert(hashes, np.cumsum(words), np.uint64(hash64(END))), words + 1


def steps_of(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 1 for 1, and one more for each factor of ``BASE``."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(steps: np.ndarray) -> np.ndarray:
    """The middle of what a step stands for; 0 for no step."""
    return np.where(steps == 0, 0.0, np.where(steps == 1, 1.0, BASE ** (steps - 0.5)))


class LogFrequencyFilter:
    """A blocked Bloom filter whose entries are (n-gram, step) pairs."""

    def __init__(self, n_blocks: int):
        self.n_blocks = n_blocks
        self.words = np.zeros(n_blocks * BLOCK_WORDS, np.uint64)

    @staticmethod
    def _drawn(keys: np.ndarray, step: int, k: int) -> np.ndarray:
        """Random bits, which give the places of probe ``k`` and those after it, ``PER_DRAW`` in all."""
        return mixed(keys + np.uint64(0x9E3779B97F4A7C15 * (31 * step + k + 1) & MASK))

    @staticmethod
    def _places(drawn: np.ndarray, k: int) -> np.ndarray:
        """Bit numbers inside a block."""
        return drawn >> np.uint64(k % PER_DRAW * PLACE_BITS) & np.uint64(64 * BLOCK_WORDS - 1)

    @classmethod
    def of(cls, bits: bytes) -> LogFrequencyFilter:
        out = cls(0)
        out.words = np.frombuffer(bits, np.uint64)
        out.n_blocks = len(out.words) // BLOCK_WORDS
        return out

    def block_of(self, keys: np.ndarray) -> np.ndarray:
        """Drawn anew: ``mixed`` alone tells a key's bucket, so its remainders are not free there."""
        return (self._drawn(keys, 0, 0) % np.uint64(self.n_blocks)).astype(np.int64)

    def insert(self, keys: np.ndarray, steps: np.ndarray) -> None:
        block = self.block_of(keys)
        order = np.argsort(block)
        keys, steps, block = keys[order], steps[order], block[order]
        ends = np.searchsorted(block, np.arange(0, self.n_blocks + SPREAD, SPREAD))
        for n, (i, j) in enumerate(zip(ends, ends[1:])):
            words = self.words[n * SPREAD * BLOCK_WORDS : (n + 1) * SPREAD * BLOCK_WORDS]
            bits = np.zeros(64 * len(words), bool)
            own, left, start = keys[i:j], steps[i:j], (block[i:j] - n * SPREAD) * (64 * BLOCK_WORDS)
            for s in itertools.count(1):
                use = left >= s
                own, left, start = own[use], left[use], start[use]
                if not len(own):
                    break
                for k in range(PROBES):
                    if k % PER_DRAW == 0:
                        drawn = self._drawn(own, s, k)
                    bits[start + self._places(drawn, k).astype(np.int64)] = True
            words |= np.packbits(bits, bitorder="little").view("<u8")

    def steps(self, keys: np.ndarray) -> np.ndarray:
        """The highest step up to which all are present."""
        out = np.zeros(len(keys), np.int64)
        live, s = np.arange(len(keys)), 0
        block = self.block_of(keys) * BLOCK_WORDS
        while len(live) and s < 128:  # no count of 64 bits has more
            s += 1
            for k in range(PROBES):
                if k % PER_DRAW == 0:
                    drawn = self._drawn(keys, s, k)
                bit = self._places(drawn, k)
                there = (self.words[block + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                if not there.all():
                    live, keys, block, drawn = live[there], keys[there], block[there], drawn[there]
                if not len(live):
                    break
            out[live] = s
        return out


@dataclass
class Model:
    """What is broadcast; its size depends on the parameters alone."""

    words: np.ndarray  # hashes of frequent words, of START and of END, ascending
    low: np.ndarray  # log10 of their shares
    rest: np.ndarray  # log10 of what a history leaves to shares: PRIOR over its count and PRIOR
    pairs: np.ndarray  # keys of frequent pairs, ascending
    held: np.ndarray  # their quantised counts
    total: int  # training tokens
    distinct: int
    buckets: int


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return combined([before, after], 2)


class Places:
    """Where keys stand among ascending hashes; the first bits of a key tell where to begin."""

    def __init__(self, among: np.ndarray):
        self.n, bits = len(among), max(1, len(among).bit_length())
        self.among, self.shift = np.append(among, np.uint64(MASK)), np.uint64(64 - bits)
        held = np.bincount((among >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.cumsum(held) - held

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = self.first[(keys >> self.shift).astype(np.int64)]
        seen = self.among[at]
        live = np.flatnonzero(seen < keys)
        while len(live):
            at[live] += 1
            seen[live] = self.among[at[live]]
            live = live[seen[live] < keys[live]]
        return np.where((seen == keys) & (at < self.n), at, -1)


_BUCKET, _BUCKET_ARROW = fields("bucket:int entries:binary")
_COUNT, _COUNT_ARROW = fields("word:long count:long")


def packed_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys with counts as bytes; a count of 1 takes no room."""
    one = counts == 1
    return np.array([one.sum()], np.uint64).tobytes() + keys[one].tobytes() + keys[~one].tobytes() + counts[~one].astype(np.uint64).tobytes()


def unpacked_counts(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(packed, np.uint64)
    ones = int(numbers[0])
    more = (len(numbers) - 1 - ones) // 2
    return numbers[1 : 1 + ones + more], np.concatenate([np.ones(ones, np.uint64), numbers[1 + ones + more :]])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys)).astype(np.uint64)


def _added(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal keys added up."""
    parts = [unpacked_counts(p) for p in packed]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _buckets(places: np.ndarray, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys with counts, dealt to buckets by ``places``."""
    rows = np.stack([keys, counts.astype(np.uint64)], 1)
    parts = [(b, np.frombuffer(e, np.uint64).reshape(-1, 2)) for b, e in in_buckets(places, rows, buckets)]
    return batch(_BUCKET_ARROW, [b for b, _ in parts], [packed_counts(e[:, 0], e[:, 1]) for _, e in parts])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """bucket, keys and counts, of rows sorted by bucket; one bucket is held at a time."""
    bucket, held = None, []
    for b in batches:
        for own, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if own != bucket and held:
                yield bucket, *_added(held)
                held = []
            bucket = own
            held.append(e)
            if len(held) >= 64:  # what was added up takes no more room than its distinct keys
                held = [packed_counts(*_added(held))]
    if held:
        yield bucket, *_added(held)


def _word_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0

        def packed() -> pa.RecordBatch:
            keys, counts = counted(np.concatenate(pending))
            return _buckets(mixed(keys), keys, counts, buckets)

        for b in batches:
            for block in blocks(b.column(0)):
                pending.append(token_hashes(block)[0])
                held += len(pending[-1])
                if held >= PENDING:
                    yield packed()
                    pending, held = [], 0
        if held:
            yield packed()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, keys, counts in _by_bucket(batches):
        for at in range(0, len(keys), 100_000):
            yield batch(_COUNT_ARROW, keys[at : at + 100_000].view(np.int64), counts[at : at + 100_000].astype(np.int64))


def word_counts(texts: DataFrame) -> DataFrame:
    """Exact counts of all tokens of a one-column frame, by 64-bit hash: word, count."""
    parts = shuffle_partitions(texts.sparkSession)
    return texts.mapInArrow(_word_counts(4 * parts), _BUCKET).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merged, _COUNT)


def _histories(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hash before each token; a text's first token follows START."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.cumsum(lengths) - lengths] = hash64(START)
    return before


def _pair_places(keys: np.ndarray, after: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What deals pairs to buckets: the second word if it isn't frequent, else the pair."""
    return mixed(np.where(place < 0, after, keys))


def _pair_counts(shared, buckets: int):
    number = np.uint16 if buckets <= 1 << 16 else np.int64  # short ones are sorted by radix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = Places(shared.value)
        pending, held = [], 0

        def packed() -> pa.RecordBatch:
            keys, bucket = (np.concatenate(x) for x in zip(*pending))
            keys, ends = keys[np.argsort(bucket, kind="stable")], np.cumsum(np.bincount(bucket, minlength=buckets))
            parts = [(b, packed_counts(*counted(keys[i:j]))) for b, (i, j) in enumerate(zip([0, *ends], ends)) if i < j]
            return batch(_BUCKET_ARROW, [b for b, _ in parts], [p for _, p in parts])

        for b in batches:
            for block in blocks(b.column(0)):
                after, lengths = token_hashes(block)
                keys = pair_keys(_histories(after, lengths), after)
                pending.append((keys, (_pair_places(keys, after, frequent.of(after)) % np.uint64(buckets)).astype(number)))
                held += len(keys)
                if held >= PENDING:
                    yield packed()
                    pending, held = [], 0
        if held:
            yield packed()

    return run


_PAIRS, _PAIRS_ARROW = fields("bucket:int bits:binary key:long count:long")


def _merged_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: its filter, in one row, and its pairs that may be frequent."""
    for bucket, keys, counts in _by_bucket(batches):
        yield batch(_PAIRS_ARROW, [bucket], [filter_of(keys, counts).words.tobytes()], [None], [None])
        keys, counts = keys[counts >= LEAST_PAIR], counts[counts >= LEAST_PAIR]
        for at in range(0, len(keys), 100_000):
            n = len(keys[at : at + 100_000])
            yield batch(_PAIRS_ARROW, [bucket] * n, pa.nulls(n, pa.binary()), keys[at : at + 100_000].view(np.int64), counts[at : at + 100_000].astype(np.int64))


def filter_of(keys: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
    """A filter of keys with counts, as large as they need."""
    steps = steps_of(counts)
    out = LogFrequencyFilter(max(1, -(-int(steps.sum()) * BITS_PER_ENTRY // (64 * BLOCK_WORDS))))
    out.insert(keys, steps)
    return out


def frequent_rows(counts: DataFrame, most: int) -> tuple[Column, pa.Table]:
    """The most frequent rows, ``most`` at the utmost: those from a step of the count on. Also the condition that tells them.

    Steps are 256 to a power of two, so their table is bounded; the step is
    the lowest from which on no more than ``most`` rows are left.
    """
    step = F.floor(F.log2(F.col("count").cast("double")) * 256).cast("int")
    held = {r["step"]: r["n"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    least, total = max(held, default=0) + 1, 0
    for s in sorted(held, reverse=True):
        total += held[s]
        if total > most:
            break
        least = s
    return step >= least, counts.where(step >= least).toArrow()


def _hashes(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


@dataclass
class Tables:
    """What grows with the corpus, as stored tables."""

    words: DataFrame  # of words that are not frequent: word, count
    filters: DataFrame  # bucket, bits


def trained(texts: DataFrame) -> tuple[Model, Tables]:
    """The model of a one-column frame of training texts, and its tables."""
    spark = texts.sparkSession
    folder, parts = shared_dir(spark), shuffle_partitions(spark)
    counts = stored(word_counts(texts), folder, "counts")
    end = F.col("word") == int(np.uint64(hash64(END)).astype(np.int64))
    total, distinct, n_texts = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(end, F.col("count"))), F.lit(0))).first()
    is_frequent, top = frequent_rows(counts.where(~end), FREQUENT)
    marks = np.array([hash64(START), hash64(END)], np.uint64)
    words, count = np.append(_hashes(top["word"]), marks), np.append(top["count"].to_numpy().astype(np.float64), [0.0, n_texts])
    after = np.append(count[:-2], [n_texts, 0.0])  # how often each is a history
    order = np.argsort(words)
    words, count, after = words[order], count[order], after[order]
    shared = spark.sparkContext.broadcast(words)
    packed = texts.mapInArrow(_pair_counts(shared, parts), _BUCKET).repartition(parts, "bucket").sortWithinPartitions("bucket")
    pairs = stored(packed.mapInArrow(_merged_pairs, _PAIRS), folder, "pairs")
    shared.destroy()
    _, common = frequent_rows(pairs.where("key is not null").select("key", "count"), FREQUENT)
    keys = np.argsort(_hashes(common["key"]))
    model = Model(
        words, np.log10(count + 0.5) - np.log10(total + 0.5 * (distinct + 1)), np.log10(PRIOR / (after + PRIOR)).astype(np.float32), _hashes(common["key"])[keys],
        count_of(steps_of(common["count"].to_numpy().astype(np.int64)[keys])).astype(np.float32), int(total), int(distinct), parts,
    )
    return model, Tables(counts.where(~end & ~is_frequent), pairs.where("bits is not null").select("bucket", "bits"))


#: What goes to a bucket, in this order: its filter, its rare words, pairs whose second word is frequent, rare words with the pairs that they end, texts' own sums.
BITS, WORDS, PAIRS, RARE, TEXT = range(5)
_SENT, _SENT_ARROW = fields("bucket:int kind:int first:long uid:long payload:binary n_tokens:long n_known:long base:double own:double")
_SUMS, _SUMS_ARROW = fields("first:long uid:long payload:binary n_tokens:long n_known:long base:double own:double")


def _row(schema: pa.Schema, n: int, extra: pa.Field, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns that aren't given are null."""
    schema = schema.append(extra)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed(kind: int, parts: list[tuple[int, bytes]], extra: pa.Field, first: int = 0) -> pa.RecordBatch:
    n = len(parts)
    return _row(_SENT_ARROW, n, extra, bucket=[b for b, _ in parts], kind=[kind] * n, first=[first] * n, payload=[e for _, e in parts])


def _columns(rows: np.ndarray) -> bytes:
    """A structured array column by column, which compresses better."""
    return b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names)


def _split(payload: bytes, kind: np.dtype) -> dict[str, np.ndarray]:
    n, at, out = len(payload) // kind.itemsize, 0, {}
    for name in kind.names:
        out[name] = np.frombuffer(payload, kind[name], n, at)
        at += n * kind[name].itemsize
    return out


_WORD = np.dtype([("word", "<u8"), ("count", "<u8")])
#: ``doc``: place after the first text of the row's batch; ``x``: PRIOR times the share of the pair's second word.
_PAIR = np.dtype([("key", "<u8"), ("x", "<f4"), ("doc", "<u4")])
_LOOKUP = np.dtype([("key", "<u8"), ("word", "<u8"), ("doc", "<u4")])
_SUM = np.dtype([("doc", "<u4"), ("known", "<u4"), ("base", "<f8"), ("own", "<f8")])


def _dealt(rows: np.ndarray, places: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    return [(b, _columns(np.frombuffer(e, rows.dtype))) for b, e in in_buckets(places, rows, buckets)]


def _sent_filters(extra: pa.Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _row(_SENT_ARROW, b.num_rows, extra, bucket=b.column(0), kind=[BITS] * b.num_rows, payload=b.column(1))

    return run


def _sent_words(buckets: int, extra: pa.Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros(b.num_rows, _WORD)
            rows["word"], rows["count"] = _hashes(b.column(0)), b.column(1).to_numpy()
            yield _packed(WORDS, _dealt(rows, mixed(_hashes(b.column(0))), buckets), extra)

    return run


def _sent_texts(shared, extra: pa.Field):
    """Texts (uid, doc_id, text) to their sums over frequent words and pairs, and to what must be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        words, pairs = Places(m.words), Places(m.pairs)
        start = words.of(np.array([hash64(START)], np.uint64))[0]
        for b in batches:
            uids, first = b.column(0).to_numpy(), int(b.column(0)[0].as_py()) if b.num_rows else 0
            probes, lookups, waiting, at = [], [], 0, 0

            def flush() -> Iterator[pa.RecordBatch]:
                for kind, rows, key in ((PAIRS, probes, "key"), (RARE, lookups, "word")):
                    if rows:
                        whole = np.concatenate(rows)
                        yield _packed(kind, _dealt(whole, mixed(np.ascontiguousarray(whole[key])), m.buckets), extra, first)
                        rows.clear()

            for block in blocks(b.column(2)):
                own, lengths = token_hashes(block)
                place = words.of(own)
                starts = np.cumsum(lengths) - lengths
                back = np.empty_like(place)
                back[1:] = place[:-1]
                back[starts] = start
                known = place >= 0
                low = np.where(known, m.low[place], 0.0)
                logs = low + np.where(back >= 0, m.rest[back], 0.0)
                keys = pair_keys(_histories(own, lengths), own)
                hit = np.full(len(own), -1)
                hit[known] = pairs.of(keys[known])
                there = hit >= 0
                logs[there] += np.log10(1 + m.held[hit[there]] / (PRIOR * 10.0 ** low[there]))
                docs = np.repeat((uids[at : at + len(block)] - first).astype(np.uint32), lengths)
                left, rare = known & ~there, ~known
                probe, lookup = np.empty(int(left.sum()), _PAIR), np.empty(int(rare.sum()), _LOOKUP)
                probe["key"], probe["x"], probe["doc"] = keys[left], PRIOR * 10.0 ** low[left], docs[left]
                lookup["key"], lookup["word"], lookup["doc"] = keys[rare], own[rare], docs[rare]
                probes.append(probe)
                lookups.append(lookup)
                n = len(block)
                sums = [np.add.reduceat(v, starts) for v in (known.astype(np.int64), low, logs)]
                mine = uids[at : at + n]
                columns = dict(bucket=(mine % m.buckets).astype(np.int32), kind=[TEXT] * n, first=[first] * n, uid=mine, n_tokens=lengths, n_known=sums[0], base=sums[1], own=sums[2])
                yield _row(_SENT_ARROW, n, extra, **columns, doc_id=b.column(1).slice(at, n))
                at += n
                waiting += len(probe) + len(lookup)
                if waiting >= SENT:
                    yield from flush()
                    waiting = 0
            yield from flush()

    return run


class Bucket:
    """One bucket's filter and rare words, and what they tell of texts."""

    def __init__(self, log_all: float):
        self.log_all, self.filter, self.parts, self.words = log_all, LogFrequencyFilter(1), [], None

    def rare(self, words: np.ndarray) -> np.ndarray:
        """Exact counts."""
        if self.words is None:
            parts = [_split(p, _WORD) for p in self.parts]
            words_, counts = (np.concatenate([np.zeros(0, np.uint64), *[p[c] for p in parts]]) for c in ("word", "count"))
            order = np.argsort(words_)
            self.words, self.counts, self.parts = Places(words_[order]), np.append(counts[order], 0).astype(np.float64), []
        return self.counts[self.words.of(words)]

    def pairs(self, payload: bytes) -> np.ndarray:
        rows = _split(payload, _PAIR)
        gain = np.log10(1 + count_of(self.filter.steps(rows["key"])) / rows["x"].astype(np.float64))
        return self._sums(rows["doc"], np.zeros(len(gain)), np.zeros(len(gain)), gain)

    def lookups(self, payload: bytes) -> np.ndarray:
        rows = _split(payload, _LOOKUP)
        count = self.rare(rows["word"])
        base = np.log10(count + 0.5) - self.log_all
        held = np.where(count > 0, count_of(self.filter.steps(rows["key"])), 0.0)  # an unseen word has no pairs: any is a chance hit
        own = base + np.log10(1 + held / (PRIOR * 10.0**base)) + np.log10(PRIOR / (count + PRIOR))  # the word is the next token's history too
        return self._sums(rows["doc"], count > 0, base, own)

    @staticmethod
    def _sums(doc: np.ndarray, known: np.ndarray, base: np.ndarray, own: np.ndarray) -> np.ndarray:
        there = (own != 0) | (base != 0)
        at, back = np.unique(doc[there], return_inverse=True)
        out = np.empty(len(at), _SUM)
        out["doc"] = at
        for name, x in (("known", known), ("base", base), ("own", own)):
            out[name] = np.bincount(back, x[there], len(at))
        return out


def _looked_up(log_all: float, extra: pa.Field):
    """Rows sorted by bucket and kind, to sums of texts: packed ones by batch of texts, and the texts' own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Bucket(log_all)
        for b in batches:
            texts = b.filter(pa.compute.equal(b.column(1), TEXT))
            if texts.num_rows:
                yield _row(_SUMS_ARROW, texts.num_rows, extra, **{c: texts.column(c) for c in ("first", "uid", "n_tokens", "n_known", "base", "own", "doc_id")})
            found = []
            for bucket, kind, first, payload in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "first", "payload"))):
                if bucket != at:
                    at, held = bucket, Bucket(log_all)
                if kind == BITS:
                    held.filter = LogFrequencyFilter.of(payload)
                elif kind == WORDS:
                    held.parts.append(payload)
                elif kind in (PAIRS, RARE):
                    rows = (held.pairs if kind == PAIRS else held.lookups)(payload)
                    if len(rows):
                        found.append((first, _columns(rows)))
            if found:
                yield _row(_SUMS_ARROW, len(found), extra, first=[f for f, _ in found], payload=[p for _, p in found])

    return run


def _added_up(extra: pa.Field):
    """Rows sorted by batch of texts, the texts first: one row a text, with all its sums."""
    schema = pa.schema([_SUMS_ARROW.field(c) for c in ("n_tokens", "n_known", "base", "own")]).append(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts, sums = None, [], None

        def whole() -> pa.RecordBatch:
            rows = pa.Table.from_batches(texts).combine_chunks()
            doc, held = rows["uid"].to_numpy() - at, sums or {k: np.zeros(int(rows["uid"].to_numpy().max()) - at + 1) for k in ("known", "base", "own")}
            columns = {c: rows[c].to_numpy() + held[k][doc].astype(np.int64 if c == "n_known" else np.float64) for k, c in (("known", "n_known"), ("base", "base"), ("own", "own"))}
            return _row(pa.schema(list(schema)[:-1]), len(doc), extra, n_tokens=rows["n_tokens"].combine_chunks(), doc_id=rows["doc_id"].combine_chunks(), **columns)

        for b in batches:
            firsts, payloads = b.column(0).to_numpy(), b.column(2)
            packed = payloads.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((firsts[1:] != firsts[:-1]) | (packed[1:] != packed[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
                if i == j:
                    continue
                if firsts[i] != at:
                    if texts:
                        yield whole()
                    at, texts, sums = int(firsts[i]), [], None
                if not packed[i]:
                    texts.append(b.slice(i, j - i))
                    continue
                rows = [_split(p, _SUM) for p in payloads.slice(i, j - i).to_pylist()]
                if sums is None:
                    n = max(int(t.column(1).to_numpy().max()) for t in texts) - at + 1
                    sums = {k: np.zeros(n) for k in ("known", "base", "own")}
                for r in rows:
                    for k in sums:
                        sums[k][r["doc"]] += r[k]
        if texts:
            yield whole()

    return run


def lm_scores(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all whole texts by a model of the rows where ``training`` (a condition on ``docs``) holds.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score and score, one
    row per row of ``docs``. A null or empty text is one end token. Without
    training texts the shares are those of an empty corpus. Both scores are
    log10 probabilities.
    """
    spark: SparkSession = docs.sparkSession
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    model, tables = trained(docs.where(training).select(content.alias("text")))
    shared, parts = spark.sparkContext.broadcast(model), model.buckets
    log_all = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), content.alias("text"))
    kind = rows.schema["doc_id"]
    extra = pa.field("doc_id", to_arrow_type(kind.dataType))
    sent, sums = (T.StructType([*x.fields, T.StructField("doc_id", kind.dataType)]) for x in (_SENT, _SUMS))
    every = tables.filters.mapInArrow(_sent_filters(extra), sent).union(tables.words.mapInArrow(_sent_words(parts, extra), sent)).union(rows.mapInArrow(_sent_texts(shared, extra), sent))
    found = every.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_looked_up(log_all, extra), sums)
    found = found.repartition(parts, "first").sortWithinPartitions("first", F.col("payload").isNotNull())
    per = found.mapInArrow(_added_up(extra), T.StructType([f for f in sums.fields if f.name not in ("first", "uid", "payload")]))
    return per.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.least("own", F.lit(0.0)).alias("score"))
