"""Tables in the folder that driver and executors share, for results that several plans or rounds read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local runs without it, a folder of the session's own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="cytoplane-"))
    return f"{found.rstrip('/')}/{sc.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet and read again: it is computed once, and a lost executor costs no more than its tasks. Columns
    of nulls without a type, which Parquet has not, are made anew."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    kept = df.drop(*(f.name for f in df.schema if f.dataType.typeName() == "void"))
    kept.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(kept.schema).parquet(path)
    return back if len(kept.columns) == len(df.columns) else back.select(*(F.col(c) if c in kept.columns else F.lit(None).alias(c) for c in df.columns))


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
