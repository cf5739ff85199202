"""CSV with rules of its own for quoting, padding and types, and tables by SQL."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from eventframe.sources.tables import ENTRY

#: Letters of column types: whole number, decimal, truth value, text.
TYPES = {"L": T.LongType(), "D": T.DoubleType(), "O": T.BooleanType(), "T": T.StringType()}
SAMPLE = 11


@dataclass
class CsvOptions:
    headers: bool = True
    delimiter: str = ","
    left_trim: bool = False
    right_trim: bool = False
    skip_first: int = 0
    skip_last: int = 0
    comment: str = ""
    names: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)


def split_line(line: str, delimiter: str = ",") -> list[str]:
    """Fields of a line: quotes keep delimiters, doubled ones stand for one; nothing is ``nan``, after a final delimiter too."""
    out, at, n = [], 0, len(line)
    while True:
        text, quoted = [], False
        while at < n and (quoted or line[at] != delimiter):
            if line[at] == '"':
                if quoted and at + 1 < n and line[at + 1] == '"':
                    text.append('"')
                    at += 1
                else:
                    quoted = not quoted
            else:
                text.append(line[at])
            at += 1
        out.append("".join(text) or "nan")
        if at >= n:
            return out
        at += 1
        if at == n:
            return [*out, "nan"]


def inferred(values: list[str]) -> str:
    """Type of the first value that isn't ``nan``; of none, decimal."""
    for v in values:
        if v == "nan":
            continue
        if re.fullmatch(r"[+-]?\d+", v):
            return "L"
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v):
            return "D"
        return "O" if v in ("true", "false") else "T"
    return "D"


def _fields(line: Column, delimiter: str) -> Column:
    """``split_line`` as a column."""
    d = re.escape(delimiter)
    ready = F.concat(line, F.lit(delimiter))
    found = F.regexp_extract_all(ready, F.lit(f'((?:"(?:[^"]|"")*"|[^"{d}])*){d}'), F.lit(1))

    def plain(x: Column) -> Column:
        y = F.regexp_replace(F.regexp_replace(x, '""', "\u0001"), '"', "")
        y = F.regexp_replace(y, "\u0001", '"')
        return F.when(x.isin("", '""'), "nan").otherwise(y)

    return F.transform(found, plain)


def _converted(x: Column, kind: str) -> Column:
    if kind == "D":
        return F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|nan)", 1).try_cast("double")
    if kind == "L":
        return F.when(x == "nan", F.lit(0)).otherwise(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("long")).cast("long")
    if kind == "O":
        return x == "true"
    return x


def csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> DataFrame:
    """A CSV file as a table with entry numbers. Short rows are padded with ``nan``; long ones are an error.

    ``nan`` is 0 in a column of whole numbers and false in one of truth values.
    """
    o = options or CsvOptions()
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    if o.comment:
        lines = lines.where(~F.col("value").startswith(o.comment))
    text = F.col("value")
    text = F.ltrim(text) if o.left_trim else text
    text = F.rtrim(text) if o.right_trim else text
    lines = lines.select(text.alias("value"), "__at").where(F.length("value") > 0)
    head = [r["value"] for r in lines.orderBy("__at").limit(o.skip_first + int(o.headers) + SAMPLE).collect()][o.skip_first :]
    names = o.names or (split_line(head[0], o.delimiter) if o.headers else [f"Col{k}" for k in range(len(split_line(head[0], o.delimiter)))])
    body = head[1:] if o.headers else head
    sample = [split_line(x, o.delimiter) for x in body[:SAMPLE]]
    types = [o.types.get(n) or inferred([r[k] for r in sample if k < len(r)]) for k, n in enumerate(names)]
    rows = _numbered(lines).where(F.col(ENTRY) >= o.skip_first + int(o.headers)).withColumn(ENTRY, F.col(ENTRY) - o.skip_first - int(o.headers))
    if o.skip_last:
        rows = rows.where(F.col(ENTRY) < rows.count() - o.skip_last)
    rows = rows.withColumn("f", _fields(F.col("value"), o.delimiter))
    long = F.size("f") > len(names)
    pick = lambda k: F.when(long, F.raise_error(F.concat(F.lit("too many fields: "), F.col("value")))).otherwise(F.coalesce(F.get("f", F.lit(k)), F.lit("nan")))
    return rows.select(ENTRY, *[_converted(pick(k), t).alias(n) for k, (n, t) in enumerate(zip(names, types))])


def _numbered(lines: DataFrame) -> DataFrame:
    """Entry numbers of rows whose ``__at`` counts up inside partitions: starts of partitions come from their counts."""
    part = F.shiftright(F.col("__at"), 33)
    counts = {r["p"]: r["n"] for r in lines.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy(part).orderBy("__at")) - 1
    offset, ahead = F.lit(0).cast("long"), 0
    for p in sorted(counts):
        offset = F.when(part == p, F.lit(ahead).cast("long")).otherwise(offset)
        ahead += counts[p]
    return lines.withColumn(ENTRY, rank + offset).drop("__at")


def read_file(spark: SparkSession, path: str, descriptor: str, delimiter: str = " ") -> DataFrame:
    """Text columns by a leaf list such as ``x/D:n/I:name/C``."""
    kinds = {"D": "double", "F": "float", "I": "int", "L": "long", "S": "short", "B": "byte", "O": "boolean", "C": "string"}
    leaves = [x.split("/") for x in descriptor.split(":")]
    parts = F.split(F.trim("value"), r"\s+" if delimiter == " " else re.escape(delimiter))
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.length(F.trim("value")) > 0)).select("value")
    kind, out = "F", []
    for k, leaf in enumerate(leaves):
        kind = leaf[1] if len(leaf) > 1 else kind
        out.append(F.get(parts, F.lit(k)).cast(kinds[kind]).alias(leaf[0]))
    return lines.select(*out)


def from_sql(spark: SparkSession, query: str, **views: DataFrame) -> DataFrame:
    """The result of a query over named tables."""
    return spark.sql(query, **views)


def sqlite(spark: SparkSession, file: str, query: str) -> DataFrame:
    """The result of a query that SQLite itself runs, in its order; one task reads it, in batches.

    Types follow the columns' declared ones, and the first row where a column
    has none. The file must be where all workers reach it.
    """
    import sqlite3

    import pandas as pd

    with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as con:
        names = [d[0] for d in con.execute(f"select * from ({query}) limit 0").description]
        kinds = con.execute(f"select {', '.join(f'typeof([{n}])' for n in names)} from ({query}) limit 1").fetchone() or ["text"] * len(names)
    spark_kinds = {"integer": "long", "real": "double", "blob": "binary"}

    def rows(batches):
        for _ in batches:
            with sqlite3.connect(f"file:{file}?mode=ro", uri=True) as own:
                found, at = own.execute(query), 0
                while part := found.fetchmany(10_000):
                    yield pd.DataFrame(part, columns=names).assign(**{ENTRY: range(at, at + len(part))})
                    at += len(part)

    schema = ", ".join([f"`{n}` {spark_kinds.get(k, 'string')}" for n, k in zip(names, kinds)] + [f"{ENTRY} long"])
    return spark.range(1, numPartitions=1).mapInPandas(rows, schema)
