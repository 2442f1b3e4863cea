"""Tables, folds, bounded samples and shared storage for the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths that cut() has written and nobody has deleted yet, by application.
_LIVE: dict[str, set[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that all executors see: the cluster's spark.checkpoint.dir, or one of our own where it is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_fieldgrain_shared", None) or tempfile.mkdtemp(prefix="fieldgrain-")
        spark._fieldgrain_shared = base
    return base.rstrip("/")


#: Bytes that a file is worth, and tasks that have to share one before a small table is dealt out again to have fewer files.
FILE_BYTES, FILE_TASKS = 4 << 20, 16


def few_files(df: DataFrame, of: DataFrame | None, times: int = 1) -> DataFrame:
    """df, dealt out evenly to a few tasks that write it if it can't be large: not larger than `of`, a table that cut() wrote, so many times.

    For each file on a local file system an executor starts two processes (chmod), which share its memory until they run and so seem to double it.
    """
    spark, path = df.sparkSession, getattr(of, "_fieldgrain_path", None)
    if not path:
        return df
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    files = max(spark.sparkContext.defaultParallelism, -(-size * times // FILE_BYTES))
    return df.repartition(files) if files * FILE_TASKS <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/fieldgrain-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fieldgrain_path = path
    _LIVE.setdefault(df.sparkSession.sparkContext.applicationId, set()).add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _LIVE.get(spark.sparkContext.applicationId, set()).discard(path)


def drop(*tables: DataFrame) -> None:
    """Delete what cut() wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_fieldgrain_path", None):
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished plans deleted now: Spark does so when the driver's JVM finds that nothing refers to them, which on a roomy heap is late."""
    gc.collect()
    spark._jvm.System.gc()


def thrifty(each):
    """The function over batches, after which a Python worker gives back what it has freed: workers live on, and would hold it all stages long."""

    @wraps(each)
    def run(batches):
        try:
            yield from each(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return run


def sweep(spark: SparkSession) -> int:
    """Delete all tables of this application that are left, once its results have been written: results are lazy and read the last of them."""
    paths = list(_LIVE.get(spark.sparkContext.applicationId, ()))
    for p in paths:
        _delete(spark, p)
    return len(paths)


def fold(col: str, mod: int) -> Column:
    """crc32(id as text) mod `mod`; a null id falls into fold -1, which is never held out nor learnt from."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % mod, F.lit(-1))


def some_ids(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows in the order of a hash of their key: a repeatable sample of bounded size. Of a large table only rows below a cut-off of that hash, about twice as many as wanted, are put in order."""
    total = df.count()
    if total > 4 * most:
        span = 1 << 40
        df = df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(span)) < F.lit(int(span * (2 * most + 100) / total)))
    return df.orderBy(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)), F.col(key)).limit(most)


def one_each(df: DataFrame, key: str = "id") -> DataFrame:
    """Of the rows of one key the same one each time, by a hash of all columns: for samples that a table with repeated keys was joined to."""
    rest = [c for c in df.columns if c != key]
    chosen = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("r")
    return df.groupBy(key).agg(chosen).select(key, *[F.col("r")[c].alias(c) for c in rest])


#: Rows are looked up by a hash of their key first: at most so many values are broadcast.
SLOTS = 1 << 20


def _slot(key: str) -> Column:
    return F.xxhash64(F.col(key)).bitwiseAND(F.lit(SLOTS - 1))


def may_hold(df: DataFrame, keys: DataFrame, key: str, kind: str = "left_semi") -> DataFrame:
    """Rows whose key may be (or, by left_anti, can't be) among `keys`, without a shuffle of df: a table of at most SLOTS hash values is broadcast."""
    mark = F.broadcast(keys.select(_slot(key).alias("__fg_slot")).distinct())
    return df.withColumn("__fg_slot", _slot(key)).join(mark, "__fg_slot", kind).drop("__fg_slot")


def without(df: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is null or not among the column of that name in `keys`; only rows whose hash is among theirs are shuffled."""
    return may_hold(df, keys, key, "left_anti").union(may_hold(df, keys, key).join(keys.select(key), key, "left_anti").select(df.columns))


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join of two tables of any size: both are dealt out by key. Left to itself Spark broadcasts a side by its estimate, which takes no account of an explode and of what parquet packs."""
    return side.hint("merge")


def join_hot(many: DataFrame, one: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """many joined to one, which has a row a key: keys that hold a `share`-th of many's rows or more, so at most `share` of them, are joined by broadcast, and no task gets a whole group of them."""
    total = many.count()
    hot = cut(many.groupBy(key).count().where(F.col("count") >= max(2, total // share)).select(key).repartition(1), "hot")
    crowd = many.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(one.join(F.broadcast(hot), key, "left_semi")), key)
    return crowd.union(many.join(F.broadcast(hot), key, "left_anti").join(dealt(one), key).select(crowd.columns))


def locate(model: str) -> str:
    """The place of a tokenizer's file: a path, or the name of one of the installed public files."""
    if os.sep in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)
