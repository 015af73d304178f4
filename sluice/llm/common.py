"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text: runs of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row: inside a lambda a plain expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(df: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` with its columns renamed ``c0``, ``c1``, ..., so that no helper column clashes, and the new column of an old name."""
    names = [c.lower() for c in df.columns]
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain, lambda name: F.col(f"c{names.index(name.lower())}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session that runs in one process (tests) uses its warehouse folder; on a cluster that is an
    error, as a folder of the driver's machine can't be read elsewhere.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/cut-tables"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut` wrote and nothing reads any more, through the Hadoop file system they lie on."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._cut_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
