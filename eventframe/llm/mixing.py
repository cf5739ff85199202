"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected copies rise with
its length, so that a source's documents differ in their odds; they add up to
the target exactly. Whole copies are certain. For what is left, documents are
ranked by random odds divided by inclusion odds and taken in that order until
the remaining words are reached. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, stored, unused, word_count

WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES = 1.5, 2
#: Length scores are size / (size + HALF_SIZE); expected copies are tilted by up to TILT times a score's distance from the mean.
HALF_SIZE, TILT = 256, 0.5
#: Ranks are summed in two steps: over this many slices of a source, then inside each slice.
SLICES = 4096
SEED = "mix-1"


def uniform(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the key's and the text's content and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(text.cast("string").cast("binary")), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def length_score(size: Column) -> Column:
    """Thousandths of size / (size + HALF_SIZE), a whole number, so that sums don't depend on their order."""
    return F.floor(size * 1000 / (size + HALF_SIZE)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources from rows (source, size): source, source_size, target.

    Sources by code point, null last, take the weights in turn. A target stops
    at ``most`` times its source; the excess goes to the others by weight. In
    order of room per weight, the first sources are full and the others share
    what is left: the level rises up to the first source that isn't full, and falls
    after it.
    One row a source: the windows see no documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    )
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))).over(every)
    target = F.coalesce(F.least(F.col("room"), level * F.col("weight")), F.col("room"))
    return per.select("source", "source_size", target.alias("target"))


def expected_copies(size: Column) -> Column:
    """Copies of a document, of rows with their source's source_size, target and mean_score.

    target / source_size, tilted by the length score's distance from the
    source's mean (by words): so sizes times copies add up to the target. The
    tilt is held so low that no document passes MOST_COPIES.
    """
    rate = F.col("target") / F.col("source_size")
    tilt = F.least(F.lit(TILT), (F.lit(float(MOST_COPIES)) - rate) / rate)
    return rate * (F.lit(1.0) + tilt * (length_score(size) / F.lit(1000.0) - F.col("mean_score")))


def _ratio(chance: Column) -> Column:
    """Random odds divided by inclusion odds."""
    return F.col("u") / (F.lit(1.0) - F.col("u")) / (chance / (F.lit(1.0) - chance))


def _ranked(sizes: DataFrame, per: DataFrame) -> DataFrame:
    """Rows (source, size, u, uid) with what their source has in ``per`` (of), whole copies and, of those with a chance of one more, the ratio."""
    rows = sizes.join(per, F.col("source").eqNullSafe(F.col("of")))
    has = (F.col("size") > 0) & (F.col("target") > 0)
    copies = F.when(has, expected_copies(F.col("size"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("copies", copies).withColumn("whole", F.floor("copies").cast("long"))
    chance = F.col("copies") - F.col("whole")
    return rows.withColumn("ratio", F.when(chance > 0, _ratio(chance)))


def source_cuts(sizes: DataFrame, folder: str, **how) -> DataFrame:
    """Of each source in rows (uid, source, size, u): of, source_size, target, mean_score, cut and last, stored.

    A document is taken once more if its ratio is below ``cut`` (null: all
    are), the ratio at which the remaining words are reached; of those at the
    cut, as many as bring the words nearest to the target: rows up to uid
    ``last`` (null: none). Words are summed over slices of the ratio first,
    then over the ratios inside the slice where the target falls, so that no
    task holds a source; rows alike in id and text, which share a ratio, are
    counted per input partition, so that no task holds them either. Each step
    is a stored table of a row or a few per source, which keeps plans short.
    """
    per = source_targets(sizes.select("source", "size"), **how).withColumnRenamed("source", "of")
    scores = sizes.groupBy(F.col("source").alias("scored")).agg(F.sum(length_score(F.col("size")) * F.col("size")).alias("score"))
    per = per.join(scores, F.col("of").eqNullSafe(F.col("scored"))).withColumn("mean_score", F.when(F.col("source_size") > 0, F.col("score") / (F.col("source_size") * F.lit(1000.0))))
    per = stored(per.select("of", "source_size", "target", "mean_score"), folder, "per")
    ranked = _ranked(sizes, per)
    rest = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"))
    rows = ranked.where("ratio is not null").select("source", "size", "ratio", "uid", F.floor(F.col("ratio") / (F.col("ratio") + 1) * SLICES).cast("int").alias("slice"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("source", "slice").agg(F.sum("size").alias("words")).withColumn("ahead", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    cells = cells.join(rest.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).where(F.col("ahead") + F.col("words") > F.col("rest"))
    cells = stored(cells.groupBy("of").agg(F.min("slice").alias("in_slice"), F.min_by("ahead", "slice").alias("ahead"), F.max("rest").alias("rest")), folder, "cells")
    near = rows.join(cells, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("in_slice")))
    near = near.groupBy("source", "ratio").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("ahead").alias("ahead"), F.max("rest").alias("rest"))
    lower = Window.partitionBy("source").orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("words").over(lower), F.lit(0))).where(F.col("ahead") + F.col("words") > F.col("rest"))
    first = F.min(F.struct("ratio", ((F.col("rest") - F.col("ahead")) * F.col("n") / F.col("words")).alias("take"), "n"))
    cuts = near.groupBy(F.col("source").alias("at")).agg(first.alias("f")).select("at", F.col("f.ratio").alias("cut"), F.least(F.floor(F.col("f.take") + 0.5), F.col("f.n")).alias("take"))
    cuts = stored(cuts, folder, "reached")
    alike = rows.join(cuts.where("take > 0"), F.col("source").eqNullSafe(F.col("at")) & (F.col("ratio") == F.col("cut"))).withColumn("part", F.shiftright("uid", 33))
    parts = alike.groupBy("source", "part").agg(F.count("*").alias("n"), F.max("take").alias("take"))
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.where((F.col("before") < F.col("take")) & (F.col("before") + F.col("n") >= F.col("take"))).select(F.col("source").alias("of"), F.col("part").alias("in_part"), "before")
    inside = alike.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    inside = inside.withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("source").orderBy("uid")))
    last = stored(inside.where("place = take").select(F.col("source").alias("ends"), F.col("uid").alias("last")), folder, "last")
    per = per.join(cuts.select("at", "cut"), F.col("of").eqNullSafe(F.col("at")) & F.col("cut").isNotNull(), "left")
    per = per.join(last, F.col("of").eqNullSafe(F.col("ends")) & F.col("last").isNotNull(), "left")
    return stored(per.select("of", "source_size", "target", "mean_score", "cut", "last"), folder, "cuts")


def _taken(sizes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of ``sizes`` with their source's figures and the number of times that each is taken."""
    more = F.col("ratio").isNotNull() & (F.col("cut").isNull() | (F.col("ratio") < F.col("cut")) | ((F.col("ratio") == F.col("cut")) & F.coalesce(F.col("uid") <= F.col("last"), F.lit(False))))
    return _ranked(sizes, cuts).withColumn("times", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int"))


def _slim(docs: DataFrame, doc_id: Column, text: Column, source: Column) -> list[Column]:
    return [doc_id.alias("id"), source.cast("string").alias("source"), word_count(text).alias("size"), uniform(doc_id, text).alias("u"), F.monotonically_increasing_id().alias("uid")]


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``doc_id``, size, source_size, target and taken words of each row.

    Null text has size 0 and is never taken; null sources are one source, last
    in order. Rows alike in id and text are ranked alike, and told apart at the
    cut only. No rows, no result. Texts are read once, into a stored table of
    slim rows.
    """
    folder = shared_dir(docs.sparkSession)
    sizes = stored(docs.select(*_slim(docs, *(F.col(f"`{c}`") for c in (doc_id, text, source)))), folder, "sizes")
    rows = _taken(sizes, source_cuts(sizes, folder, **how))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, with its columns.

    The documents are stored once with their sizes and random numbers; only
    the table of sources meets them, and they aren't shuffled when it is small.
    """
    folder = shared_dir(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = stored(rows.select("doc", *_slim(rows, *(F.col(f"doc.`{c}`") for c in (doc_id, text, source)))), folder, "rows")
    taken = _taken(rows, source_cuts(rows.drop("doc"), folder, **how))
    return taken.where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")


ORACLE_SQL = f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size,
    (cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || coalesce(md5(text), 'null')), 1, 12) as bigint) + 0.5) / 281474976710656.0::double u
  from documents),
p as (select source, cast(sum(size) as bigint) source_size, cast(sum((size * 1000 // (size + {HALF_SIZE})) * size) as bigint) score from d group by source),
w as (select *, [3.0::double, 1.0, 2.0][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] weight, source_size * 2.0::double room from p),
o as (
  select *, (sum(source_size) over ())::double * 1.5::double total,
    coalesce(sum(room) over (q rows between unbounded preceding and 1 preceding), 0) "full",
    sum(weight) over () - coalesce(sum(weight) over (q rows between unbounded preceding and 1 preceding), 0) "open"
  from w window q as (order by room / weight, encode(source) nulls last)),
l as (select max((total - "full") / "open") lev from o where (total - "full") / "open" * weight <= room),
t as (select source, source_size, score / (source_size * 1000.0::double) mean_score, coalesce(least(room, lev * weight), room) target from o, l),
j as (select d.*, t.source_size, t.target, t.mean_score, t.target / t.source_size rate from d join t on d.source is not distinct from t.source),
k as (
  select *, case when size > 0 and target > 0
    then rate * (1.0::double + least({TILT}::double, (2.0::double - rate) / rate) * ((size * 1000 // (size + {HALF_SIZE})) / 1000.0::double - mean_score)) else 0.0::double end copies
  from j),
h as (select *, cast(floor(copies) as bigint) whole, copies - floor(copies) chance from k),
r as (select *, case when chance > 0 then u / (1.0::double - u) / (chance / (1.0::double - chance)) end ratio, target - sum(whole * size) over (partition by source) rest from h),
c as (select *, coalesce(sum(size) over (partition by source order by ratio, doc_id rows between unbounded preceding and 1 preceding), 0) ahead from r where ratio is not null),
x as (select source, min((ratio, case when rest - ahead >= size / 2.0::double then 1 else 0 end)) m from c where ahead + size > rest group by source)
select r.doc_id, r.size, r.source_size, r.target,
  cast(r.size * (r.whole + case when r.ratio is not null and (x.source is null and x.m is null or r.ratio < x.m[1] or r.ratio = x.m[1] and x.m[2] = 1) then 1 else 0 end) as bigint) taken
from r left join x on r.source is not distinct from x.source
"""
