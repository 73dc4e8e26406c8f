"""What the operators of this subpackage share: scratch tables, word rules and global ranks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vocab import forget_other_stages

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset a local session takes a temporary folder; on a cluster, whose machines would
    each see a folder of their own, that is an error.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/corpuslake-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation of its source."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """All words of a text, in order; none for null."""
    core = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the 1-based rank of each row in its group by ``(bucket, *order)``; ``bucket`` must not fall as the order rises.

    Rows are sorted within (group, bucket) only, and each bucket starts after the rows of the
    buckets before it, so no group meets in one task. ``df`` is read twice: pass a cut one.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [ranked[k].eqNullSafe(starts[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = ranked.join(starts, same)
    return joined.select(*(ranked[c] for c in df.columns), (F.col("_start") + F.col("_rank")).alias(name))


def copy_numbers(rows: DataFrame, alike: Sequence[str]) -> DataFrame | None:
    """``rows`` with ``copy``, which counts rows alike in the named columns from 0; None where there are none alike.

    ``rows`` is a stored table with ``row`` from ``monotonically_increasing_id``. Its upper bits, the
    partition that a row was written from, split a crowd of rows alike: they are numbered within
    each partition, after those of the partitions before.
    """
    keyed = rows.withColumn("_alike", F.xxhash64(*alike)).withColumn("_from", F.shiftright("row", 33))
    if keyed.groupBy("_alike").count().where("count > 1").isEmpty():
        return None
    before = Window.partitionBy("_alike").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("_alike", "_from").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_alike", "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_alike", "_from").orderBy("row")))
    return numbered.join(starts, ["_alike", "_from"]).select(*(numbered[c] for c in rows.columns), (F.col("_start") + F.col("_nth") - 1).alias("copy"))


def map_batches(df: DataFrame, columns: Sequence[str], fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over the named columns only, so that the scan reads no others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_other_stages()
        return fn(batches)

    return df.select(*columns).mapInArrow(task, schema)
