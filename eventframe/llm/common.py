"""What the operators of this subpackage share: words, hashes, shared tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java regex of a word: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step holds unpacked at a time.
BLOCK_BYTES = 1 << 21
#: Rows that go to a Python worker at once while a table is stored: texts are long, and batches stand outside of the heap.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Entries of a worker's memo before it starts afresh; memory stays bounded.
MEMO_ENTRIES = 100_000

MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the master is local (tests, a single
    machine) a temporary folder of this machine is taken; a cluster must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="eventframe-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/eventframe-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts lineage: lost executors cost a reread, no recomputation.
    """
    path, conf = f"{folder}/{name}", df.sparkSession.conf
    before = conf.get(BATCH_SETTING, "10000")
    conf.set(BATCH_SETTING, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(BATCH_SETTING, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dropped(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Words of a text as a JVM expression; null has none. Each word becomes one letter, white space goes, letters are counted."""
    letters = F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id gives -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Texts as UTF-8 bytes in lists of at most ``limit`` bytes, or of one text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield [x or b"" for x in texts.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += int(n)
    if start < len(texts):
        yield [x or b"" for x in texts.slice(start).to_pylist()]


def trimmed() -> None:
    """Give free memory back to the system: a process that lives on doesn't hold what one step needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: How to drop what each operator keeps in a worker, and which one worked there last.
_KEPT: dict[str, Callable[[], None]] = {}
_LAST = [""]


def keeps(operator: str, drop: Callable[[], None]) -> None:
    _KEPT[operator] = drop


def alone(operator: str) -> None:
    """Workers serve one operator after the other: what the others keep (tokenisers, memos) goes when this one comes."""
    if _LAST[0] != operator:
        for other, drop in _KEPT.items():
            if other != operator:
                drop()
        trimmed()
        _LAST[0] = operator


class Memo(dict):
    """A bounded cache of a function of one argument: half of it fresh, half of it from before, which comes back when it is asked for."""

    def __init__(self, f: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.f, self.entries, self.before = f, entries, {}

    def __missing__(self, key):
        value = self.before.get(key)
        return self.put(key, self.f(key) if value is None else value)

    def put(self, key, value):
        if 2 * len(self) >= self.entries:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value

    def known(self, key) -> bool:
        return key in self or key in self.before


def hash64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combined(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash of each row of equally long columns of hashes; their order matters."""
    acc = np.full(len(parts[0]), seed, np.uint64)
    for part in parts:
        acc = mixed((acc + np.uint64(0x9E3779B97F4A7C15)) ^ part)
    return acc


def in_buckets(keys: np.ndarray, entries: np.ndarray, count: int) -> Iterator[tuple[int, bytes]]:
    """Entries split by ``keys % count``, each part as bytes: few large rows to shuffle, not many small ones."""
    bucket = (keys % np.uint64(count)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    entries, ends = entries[order], np.searchsorted(bucket[order], np.arange(count + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), entries[ends[b] : ends[b + 1]].tobytes()


_KINDS = {"long": (T.LongType(), pa.int64()), "int": (T.IntegerType(), pa.int32()), "double": (T.DoubleType(), pa.float64()), "boolean": (T.BooleanType(), pa.bool_()), "string": (T.StringType(), pa.string()), "binary": (T.BinaryType(), pa.binary()), "longs": (T.ArrayType(T.LongType()), pa.list_(pa.int64()))}


def fields(text: str) -> tuple[T.StructType, pa.Schema]:
    """Spark's and Arrow's schema of ``name:kind name:kind ...``."""
    pairs = [x.split(":") for x in text.split()]
    return T.StructType([T.StructField(n, _KINDS[k][0]) for n, k in pairs]), pa.schema([(n, _KINDS[k][1]) for n, k in pairs])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of columns given in the schema's order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
