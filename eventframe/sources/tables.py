"""Tables to frames, with entry numbers where they have an order."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENTRY, FILE = "__entry", "__file"
#: Entries through which a keyed join carries the last match in one task.
CARRIED = 1 << 16


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def open_source(source, *args, entry: str | None = None, spark: SparkSession | None = None) -> tuple[DataFrame, str | None]:
    """A DataFrame and the name of its entry number, of whatever a frame can stand on.

    A DataFrame; a number of entries; a path, a list of paths; named arrays.
    """
    if isinstance(source, DataFrame):
        if entry and entry != ENTRY:
            source = source.withColumn(ENTRY, F.col(entry).cast("long"))
        return source, ENTRY if entry else None
    if isinstance(source, int):
        return session(spark).range(source).withColumnRenamed("id", ENTRY), ENTRY
    if isinstance(source, str) or isinstance(source, Sequence) and source and all(isinstance(s, str) for s in source):
        paths = [source] if isinstance(source, str) else list(source)
        return parquet(session(spark), *paths), ENTRY
    if isinstance(source, (Mapping, pd.DataFrame, pa.Table)):
        return columns(session(spark), source), ENTRY
    raise TypeError(f"no frame over {type(source).__name__}")


def _plain_path(uri: str) -> str:
    """A path as its file system names it: local ones without a scheme, nothing escaped."""
    return re.sub("^file:/+", "/", unquote(uri))


def _files_of(spark: SparkSession, path: str) -> re.Pattern:
    """What matches the files of one argument: a file, a folder, or a glob of either."""
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    whole = _plain_path(named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toString()).rstrip("/")
    signs = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|", "[": "[", "]": "]"}
    deep, out = 0, ""
    for c in whole:
        deep += (c in "{[") - (c in "}]")
        out += signs[c] if c in signs and (c != "," or deep) else c if deep and c in "-^" else re.escape(c)
    return re.compile(f"{out}(?:/.*)?")


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files end to end: entry numbers count over the files in the order of the arguments, and of names inside one.

    The offset of each file comes from counts per file, which Parquet answers
    from its footers; rows keep their places inside the file.
    """
    df = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias("__row"))
    counts = df.groupBy(FILE).agg((F.max("__row") + 1).alias("n")).collect()
    patterns = [_files_of(spark, p) for p in paths]

    def rank(r):
        path = _plain_path(r[FILE])
        return next((i for i, p in enumerate(patterns) if p.fullmatch(path)), len(patterns)), r[FILE]

    offset, ahead = F.lit(0).cast("long"), 0
    ordered = sorted(counts, key=rank)
    if len(ordered) <= 64:
        for r in ordered:
            offset = F.when(F.col(FILE) == r[FILE], F.lit(ahead).cast("long")).otherwise(offset)
            ahead += r["n"]
        return df.withColumn(ENTRY, F.col("__row") + offset).drop("__row")
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in ordered])])[:-1]
    offsets = spark.createDataFrame(pa.table({"__of": [r[FILE] for r in ordered], "__ahead": starts}))
    return df.join(offsets, F.col(FILE) == F.col("__of")).withColumn(ENTRY, F.col("__row") + F.col("__ahead")).drop("__row", "__of", "__ahead")


def columns(spark: SparkSession, arrays) -> DataFrame:
    """Named arrays of one length, in order."""
    if isinstance(arrays, pa.Table):
        table = arrays
    else:
        named = {str(k): arrays[k] for k in arrays}
        table = pa.table({k: pa.array(v.tolist() if isinstance(v, np.ndarray) and v.dtype == object else v) for k, v in named.items()})
    return spark.createDataFrame(table.append_column(ENTRY, pa.array(np.arange(len(table)), pa.int64())))


def trivial(spark: SparkSession, n: int, odd: bool = False) -> DataFrame:
    """``col0`` is the entry number, of the odd ones only if wanted."""
    df = spark.range(n).select(F.col("id").alias("col0"))
    return df.where("col0 % 2 = 1") if odd else df


def chain(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    """Tables end to end; their columns and types must agree. Entry numbers go on from part to part."""
    first = parts[0]
    for p in parts[1:]:
        if dict(p.dtypes) != dict(first.dtypes):
            raise ValueError("the parts of a chain must have the same columns and types")
    return patched(spark, parts)


def patched(spark: SparkSession, parts: Sequence[DataFrame]) -> DataFrame:
    """Tables end to end with whatever columns they have: what a part lacks is missing (null) there."""
    out, ahead = None, 0
    for p in parts:
        if ENTRY in p.columns:
            p = p.withColumn(ENTRY, F.col(ENTRY) + ahead)
            ahead += p.count()
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def positional_friend(main: DataFrame, friend: DataFrame, alias: str, strict: bool = False) -> DataFrame:
    """``friend``'s columns as ``alias_name`` beside the entry of the same number; missing beyond its end.

    ``strict`` refuses tables of different lengths.
    """
    if strict and main.count() != friend.count():
        raise ValueError("a friend must have as many entries")
    named = friend.select(F.col(ENTRY).alias("__friend"), *[F.col(c).alias(f"{alias}_{c}") for c in friend.columns if c not in (ENTRY, FILE)])
    return main.join(named, F.col(ENTRY) == F.col("__friend"), "left").drop("__friend")


def indexed_friend(main: DataFrame, friend: DataFrame, alias: str, major: str, minor: str | int = 0) -> DataFrame:
    """``friend``'s columns beside entries with equal keys; of several matches the first entry, of none missing.

    Keys are whole numbers, named alike on both sides; a number stands for itself.
    """
    def keys(df: DataFrame, tag: str) -> DataFrame:
        own = [F.col(k).cast("long") if isinstance(k, str) else F.lit(k).cast("long") for k in (major, minor)]
        return df.withColumns({f"__{tag}{i}": k for i, k in enumerate(own)})

    named = keys(friend, "f")
    content = F.struct(*[F.col(c).alias(f"{alias}_{c}") for c in friend.columns if c not in (ENTRY, FILE)])
    first = named.groupBy("__f0", "__f1").agg(F.min_by(content, ENTRY).alias("__match"))
    joined = keys(main, "m").join(first, (F.col("__m0") == F.col("__f0")) & (F.col("__m1") == F.col("__f1")), "left")
    fields = [F.col(f"__match.{alias}_{c}").alias(f"{alias}_{c}") for c in friend.columns if c not in (ENTRY, FILE)]
    return joined.select(*main.columns, *fields)


def build_index(df: DataFrame, major: str, minor: str | int = 0) -> DataFrame:
    """First entry of each key pair: major, minor, entry."""
    minor = F.col(minor) if isinstance(minor, str) else F.lit(minor)
    return df.groupBy(F.col(major).cast("long").alias("major"), minor.cast("long").alias("minor")).agg(F.min(ENTRY).alias("entry"))


def keyed_join(primary: DataFrame, auxiliary: DataFrame, alias: str, fields: Sequence[str] = ()) -> DataFrame:
    """Left equi-join: of several matches the last entry. Without fields, by entry number.

    An entry without a match shows what the last one before it that matched showed.
    """
    if not fields:
        return positional_friend(primary, auxiliary, alias)
    names = [c for c in auxiliary.columns if c not in (ENTRY, FILE)]
    last = auxiliary.groupBy(*[F.col(f).alias(f"__{f}") for f in fields]).agg(F.max_by(F.struct(*names), ENTRY).alias("__match"))
    joined = primary.join(last, [F.col(f) == F.col(f"__{f}") for f in fields], "left").withColumn("__part", F.floor(F.col(ENTRY) / CARRIED))
    # carried on from part to part first, and inside a part then: no task holds the table
    parts = joined.groupBy("__part").agg(F.max_by("__match", F.when(F.col("__match").isNotNull(), F.col(ENTRY))).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("__part").alias("__of"), before.alias("__before"))
    inside = F.last("__match", ignorenulls=True).over(Window.partitionBy("__part").orderBy(ENTRY).rowsBetween(Window.unboundedPreceding, 0))
    joined = joined.withColumn("__held", inside).join(parts, F.col("__part") == F.col("__of")).withColumn("__held", F.coalesce("__held", "__before"))
    return joined.select(*primary.columns, *[F.col(f"__held.{n}").alias(f"{alias}_{n}") for n in names])


def select_entries(df: DataFrame, entries: Sequence[int] | DataFrame, keep_order: bool = True) -> DataFrame:
    """Rows by entry number, in the order asked for; a number beyond the table is refused."""
    if isinstance(entries, DataFrame):
        return df.join(entries, ENTRY, "left_semi")
    entries = [int(e) for e in entries]
    n = df.count()
    if any(not 0 <= e < n for e in entries):
        raise IndexError(f"an entry is not among the {n} there are")
    wanted = df.sparkSession.createDataFrame(pa.table({"__place": list(range(len(entries))), "__wanted": entries}))
    found = df.join(F.broadcast(wanted) if len(entries) < 100_000 else wanted, F.col(ENTRY) == F.col("__wanted"))
    return (found.orderBy("__place") if keep_order else found).drop("__place", "__wanted")


def with_samples(spark: SparkSession, samples: Mapping[str, tuple[Sequence[str], Mapping[str, float | int | str]]]) -> DataFrame:
    """Samples of files, each with a name and metadata columns, end to end."""
    parts = []
    for name, (paths, metadata) in samples.items():
        df = parquet(spark, *paths).withColumn("sample", F.lit(name))
        parts.append(df.withColumns({k: F.lit(v) for k, v in metadata.items()}))
    return patched(spark, parts)


def tail(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries."""
    return df.where(F.col(ENTRY) >= df.count() - n)


def lazy(spark: SparkSession, results: Mapping[str, object]) -> DataFrame:
    """Columns from booked ``Take`` results, which run when the table is made."""
    return columns(spark, {name: list(r) for name, r in results.items()})


def sample_info(df: DataFrame) -> DataFrame:
    """Per source file: its path, first entry and the one after its last."""
    return df.groupBy(F.col(FILE).alias("file")).agg(F.min(ENTRY).alias("begin"), (F.max(ENTRY) + 1).alias("end"))


class DatasetSpec:
    """Samples of files with metadata, friends over all of them, and a range of entries."""

    def __init__(self):
        self.samples: dict[str, tuple[list[str], dict]] = {}
        self.friends: dict[str, list[str]] = {}
        self.range: tuple[int, int | None] = (0, None)

    @classmethod
    def of(cls, spec: Mapping) -> DatasetSpec:
        """From a plain description: samples (files, metadata), friends, range."""
        out = cls()
        for name, s in spec["samples"].items():
            out.with_sample(name, s["files"], s.get("metadata", {}))
        for alias, files in spec.get("friends", {}).items():
            out.with_friend(alias, files)
        return out.with_range(*spec["range"]) if "range" in spec else out

    def with_sample(self, name: str, files: Sequence[str], metadata: Mapping[str, float | int | str] | None = None) -> DatasetSpec:
        self.samples[name] = (list(files), dict(metadata or {}))
        return self

    def with_friend(self, alias: str, files: Sequence[str]) -> DatasetSpec:
        self.friends[alias] = list(files)
        return self

    def with_range(self, begin: int, end: int | None = None) -> DatasetSpec:
        self.range = (begin, end)
        return self

    def metadata(self, sample: str, key: str, default=None):
        """A value of a sample; without a default, a missing one is an error."""
        held = self.samples[sample][1]
        return held[key] if default is None else held.get(key, default)

    def table(self, spark: SparkSession) -> DataFrame:
        out = with_samples(spark, self.samples)
        for alias, files in self.friends.items():
            out = positional_friend(out, parquet(spark, *files), alias)
        begin, end = self.range
        out = out.where(F.col(ENTRY) >= begin) if begin else out
        return out.where(F.col(ENTRY) < end) if end is not None else out
