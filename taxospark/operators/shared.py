"""Tables in the folder that driver and executors share: cuts of the lineage that outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Only a local session may lack that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="taxospark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to shared storage and read from there."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it, such that df has no such column."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def observed(seen: Observation) -> dict:
    """What was observed; nothing where Spark saw beforehand that there are no rows to observe."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def quoted(name: str) -> str:
    """A column's name as it can be selected whatever it holds, dots too."""
    return "`" + name.replace("`", "``") + "`"
