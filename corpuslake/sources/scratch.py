"""Tables computed once and kept in the shared folder, for plans that read them several times."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one takes a temporary folder, a cluster without one is an error."""
    context = df.sparkSession.sparkContext
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared)
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder.

    The files go once nothing refers to them, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again; the table stays until the folder is cleared."""
    path = f"{shared_folder(df)}/corpuslake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
