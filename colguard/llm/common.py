"""Shared helpers of the corpus operators: durable scratch tables, distributed running sums, word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separates words: space and \t \n \v \f \r, nothing else.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="colguard-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


_MADE: list[str] = []


def clean_up(spark: SparkSession) -> None:
    """Deletes every scratch folder that this process has made; results that still read from one are lost."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _MADE:
        p = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        p.getFileSystem(conf).delete(p, True)


class Scratch:
    """Tables written to the shared checkpoint folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        _MADE.append(self.root)
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def running(scratch: Scratch, df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in sums, the sum of that expression over all rows before this one in `order`.

    Rows are range-partitioned, each partition adds up its own rows, and only one total for each partition
    is put together; no task sees more than its range. Rows equal in `order` follow each other in any order.
    """
    held = {f"__s{i}": e for i, e in enumerate(sums.values())}
    keys = {f"__o{i}": c for i, c in enumerate(order)}
    ranged = df.withColumns(held | keys).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
    ranged = scratch.put(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    by_part = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(k).alias(k) for k in held])
    starts = totals.select("__part", *[F.coalesce(F.sum(k).over(by_part), F.lit(0)).alias(f"{k}b") for k in held])
    inside = Window.partitionBy("__part").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "__part")  # one row for each partition of the range exchange
    for name, k in zip(sums, held, strict=True):
        out = out.withColumn(name, F.col(f"{k}b") + F.coalesce(F.sum(k).over(inside), F.lit(0)))
    return out.drop("__part", *held, *keys, *[f"{k}b" for k in held])


#: At most so many keys count as hot, and none with fewer rows
HOT_KEYS, HOT_ROWS = 100_000, 1000


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """__hot, __parts: the keys that more than max(HOT_ROWS, total / HOT_KEYS) of `total` rows share, so HOT_KEYS at most,
    and into how many parts their rows are to be dealt."""
    most = max(HOT_ROWS, total // HOT_KEYS)
    return counts.where(F.col(n) > most).select(F.col(key).alias("__hot"), F.ceil(F.col(n) / most).cast("int").alias("__parts"))


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salt: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on key, by merge; a hot key's rows on the left are dealt into parts by the columns `salt`,
    and its rows on the right (few) are given to each part."""
    hot = F.broadcast(hot)  # HOT_KEYS rows at most
    salted = left.join(hot, left[key] == hot["__hot"], "left").withColumn("__salt", F.pmod(F.xxhash64(*salt), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__hot", "__parts")
    copies = right.join(hot, right[key] == hot["__hot"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__hot", "__parts")
    return salted.join(copies.hint("merge"), [key, "__salt"], how).drop("__salt")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def slices(batch: pa.RecordBatch, column: str, most: int = 24 << 20):
    """Parts of a record batch with at most about `most` bytes in a column (one row at least), copied: pyarrow's
    ascii_lower goes wrong on arrays that begin inside their buffers."""
    arr = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.fill_null(pc.binary_length(arr), 0), dtype=np.int64)
    if size.sum() <= most:
        yield batch
        return
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > most:
            yield batch.take(pa.array(range(at, i)))
            at, total = i, 0
        total += n
    yield batch.take(pa.array(range(at, len(batch))))


def release() -> None:
    """Gives memory that Arrow and numpy are done with back to the system; else it stays with the Python worker."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


class Words:
    """The words of a batch of texts: `ids` index `uniq` (pyarrow strings); row r has ids[start[r]:start[r + 1]]."""

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if texts.offset:
            texts = texts.take(pa.array(range(len(texts))))
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        flat, offsets = lists.values, np.asarray(lists.offsets).astype(np.int64)
        flat, offsets = flat.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]
        coded = flat.dictionary_encode()
        ids, self.uniq = np.asarray(coded.indices), coded.dictionary
        blank = pc.index(self.uniq, pa.scalar("", self.uniq.type)).as_py()
        if blank >= 0:  # white space at either end leaves empty pieces
            keep = ids != blank
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            ids = ids[keep]
        self.ids, self.start = ids, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed invertible mixing of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def hash_words(uniq: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in uniq.to_pylist()), dtype=np.uint64, count=len(uniq))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a rule: the mixed counter."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)
