"""Tables in the shared folder that cut lineage between the rounds of an iterative query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors and the driver share.

    Where that is unset, a session on one machine (master ``local``) gets a folder of its own; a cluster does not.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="weftline-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return f"{conf.rstrip('/')}/weftline/{spark.sparkContext.applicationId}"


def drop(df: DataFrame) -> None:
    """Removes the folders of materialized tables that ``df`` reads directly."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/weftline/{spark.sparkContext.applicationId}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder if "://" in root else folder.removeprefix("file://"))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read back; a fresh folder for each call.

    Survives the loss of any executor and gives later plans true sizes.  The tables go with the application's
    folder (see ``shared_dir``); ``drop`` removes one earlier.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
