"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket
boundaries with the least padding. Inside each bucket, rows are numbered and
cut into batches that hold a budget of padded words.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stored, word_count

BUCKETS, BUDGET = 12, 65_536
#: Parts in which a bucket's rows are numbered, by their hash: whatever the session's partitions, so that batches don't depend on them.
CHUNKS = 1 << 14


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries of at most ``buckets`` buckets with the least padding, in whole numbers.

    ``lengths``: the different lengths, ascending. ``best[j]``: the least
    padded total of the first ``j`` lengths; padding is that less the constant
    sum of lengths. Ending a bucket at length j after one that ended before i
    costs best[i] + (rows below j - rows below i) * length: of j's length, a
    line for each i. Slopes fall with i and lengths rise with j, so the lines
    that are lowest somewhere stand in a queue and each bucket takes one pass.
    """
    n = len(lengths)
    longest, below = [int(x) for x in lengths], [0]
    for c in counts:
        below.append(below[-1] + int(c))
    best: list[int | None] = [0] + [None] * n
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut, lines = list(best), [-1] * (n + 1), deque()
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                i, b, m = j - 1, best[j - 1], -below[j - 1]
                while len(lines) > 1 and (b - lines[-2][1]) * (lines[-2][2] - lines[-1][2]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][2] - m):
                    lines.pop()
                lines.append((i, b, m))
            x = longest[j - 1]
            while len(lines) > 1 and lines[1][1] + lines[1][2] * x <= lines[0][1] + lines[0][2] * x:
                lines.popleft()
            if lines and (new[j] is None or lines[0][1] + lines[0][2] * x + below[j] * x < new[j]):
                new[j], cut[j] = lines[0][1] + lines[0][2] * x + below[j] * x, lines[0][0]
        best = new
        cuts.append(cut)
    ends, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            ends.append(longest[j - 1])
            j = cut[j]
    return ends[::-1]


def length_histogram(rows: DataFrame, length: str) -> tuple[np.ndarray, np.ndarray]:
    """The different lengths, ascending, and how many rows have each.

    It has a row for each different length: their number grows at most with the
    square root of all words, and no further than the longest text.
    """
    found = rows.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n")).toArrow()
    lengths, counts = (found[c].to_numpy().astype(np.int64) for c in ("length", "n"))
    order = np.argsort(lengths)
    return lengths[order], counts[order]


def pack(rows: DataFrame, key: str = "doc_id", length: str = "n_words", content: str | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``rows`` (slim ones: id, length and a hash of the content) with bucket, bucket_length, batch and batch_row.

    A batch holds ``max(1, budget // bucket_length)`` rows of one bucket; only
    the last of a bucket may hold fewer. Row numbers come in two steps, over
    chunks of rows by hash and over the chunks' counts, so that no task sees a
    whole bucket; the same rows get the same numbers whatever their order and
    partitions. Rows of length 0 (null or empty texts) form the first bucket's
    start; one longer than the budget is a batch of its own. Rows alike in key,
    length and content are interchangeable and share a chunk. ``rows`` is read
    three times: it should be stored.
    """
    ends = best_boundaries(*length_histogram(rows, length), buckets)
    own = [key, length, *([content] if content else [])]
    bucket = F.lit(0)
    for e in ends[:-1]:
        bucket = bucket + F.when(F.col(length) > e, 1).otherwise(0)
    pad = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends or [0]]), F.col("bucket") + 1)
    spread = rows.select(F.struct(*own).alias("row"), bucket.cast("int").alias("bucket"), F.pmod(F.xxhash64(*own), F.lit(CHUNKS)).cast("int").alias("chunk"))
    sizes = spread.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket", "chunk").orderBy("row")
    ranked = spread.withColumn("rank", F.row_number().over(inside)).join(sizes, ["bucket", "chunk"]).withColumn("bucket_length", pad)
    place = F.col("ahead") + F.col("rank") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    return ranked.select(f"row.{key}", f"row.{length}", "bucket", "bucket_length", F.floor(place / room).cast("long").alias("batch"), F.pmod(place, room).cast("int").alias("batch_row"))


def packed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Bucket and batch of each document: doc_id, n_words, bucket, bucket_length, batch, batch_row.

    Texts are read once, into a stored table of slim rows.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), word_count(F.col(f"`{text}`")).alias("n_words"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("content"))
    return pack(stored(slim, shared_dir(docs.sparkSession), "lengths"), "doc_id", "n_words", "content", **how)
