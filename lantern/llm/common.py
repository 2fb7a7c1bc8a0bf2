"""Shared plumbing of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_FOLDER = "lantern-tables"

#: Longs of the bitmap that tells which rows a join can concern; it is broadcast, and no larger whatever the input.
FILTER_ROWS = 1 << 19

_own: dict[str, str] = {}
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Only a local session without one (a test) gets a folder of its own: on a
    cluster, a temporary folder would be another one on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lantern-shared-")
    return _own[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of files, never a
    recomputation of the stages before them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{TABLE_FOLDER}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _places[out] = path
    _made.append(path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing will read again."""
    for df in tables:
        if (place := _places.pop(df, None)) is not None:
            _removed(df.sparkSession, place)
            if place in _made:
                _made.remove(place)


def sweeper(spark: SparkSession) -> Callable[[], None]:
    """A call of the result removes all tables that :func:`written` made since, but for the last one."""
    start = len(_made)

    def sweep() -> None:
        for place in _made[start:-1]:
            _removed(spark, place)
        del _made[start:-1]

    return sweep


def _removed(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_tables(spark: SparkSession) -> None:
    """Remove every table that :func:`written` left in the shared folder."""
    _removed(spark, f"{shared_dir(spark)}/{TABLE_FOLDER}")
    _made.clear()


def has_rows(df: DataFrame) -> bool:
    return bool(df.limit(1).take(1))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file; the default of path parameters."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def sifted(df: DataFrame, key: Column, keys: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` may be among ``own`` of ``keys``, and rows whose key isn't.

    A bitmap of ``FILTER_ROWS`` longs over the keys' hashes decides, so the
    second part of a large table can stay where it lies.  More keys than the
    bitmap can tell apart only make the first part larger; an exact join of it
    must follow.  A null counts as a key like any other.
    """
    h = F.xxhash64(own)
    bit = F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))")
    bits = keys.select(h.alias("h")).select(F.col("h").bitwiseAND(F.lit(FILTER_ROWS - 1)).alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    bits = F.broadcast(bits)  # at most FILTER_ROWS rows of two longs
    h = F.xxhash64(key)
    hit = (h.bitwiseAND(F.lit(FILTER_ROWS - 1)) == bits["slot"]) & (F.getbit(bits["bits"], F.shiftright(h, 32).bitwiseAND(F.lit(63)).cast("int")) == 1)
    return df.join(bits, hit, "left_semi"), df.join(bits, hit, "left_anti")


def without(df: DataFrame, key: Column, keys: DataFrame, own: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is none of ``keys[own]``; most of them stay where they lie."""
    maybe, rest = sifted(df, key, keys, F.col(own))
    return maybe.join(keys, key == F.col(own), "left_anti").unionByName(rest)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``mapInArrow`` for rows that may hold long texts.

    Spark's 10,000 rows make batches of tens of megabytes, on both sides of the
    pipe and in both directions, so a session that has that default gets 1,000.
    What a task freed goes back to the system when it ends, since workers live on.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":
        conf.set(BATCH_ROWS, "1000")

    def tidy(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    return df.mapInArrow(tidy, schema)


def quoted(name: str) -> str:
    """A column's name as expressions take it, with dots and quotes in it."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: names that no expression or Python worker stumbles over."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def kept_columns(df: DataFrame, f: Callable, more: tuple[T.StructField, ...] = ()) -> DataFrame:
    """``in_arrow`` with all of ``df``'s columns under numbers on the way, and their own names after it.

    ``f`` gets and returns them by place, and adds the columns ``more``.
    """
    plain = numbered(df)
    shape = T.StructType([*(T.StructField(x.name, x.dataType) for x in plain.schema.fields), *more])
    return in_arrow(plain, f, shape).toDF(*df.columns, *(x.name for x in more))


def without_last(df: DataFrame) -> DataFrame:
    """``df`` without its last column, whatever the others are called."""
    names = df.columns[:-1]
    return numbered(df).select(*(f"c{k}" for k in range(len(names)))).toDF(*names)


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
