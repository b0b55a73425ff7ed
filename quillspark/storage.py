"""Tables and folders that an operator writes on the way, where driver and executors both reach them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which a cluster must name; a local session without one takes a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        sc = spark.sparkContext
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not hasattr(sc, "_quill_scratch"):
            sc._quill_scratch = tempfile.mkdtemp(prefix="quill-scratch-")
            atexit.register(shutil.rmtree, sc._quill_scratch, ignore_errors=True)
        root = f"file://{sc._quill_scratch}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: what several later steps read is computed once, and a lost executor costs one step."""
    path, schema = scratch(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
