"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as the inside of a character class.
BLANKS = r"\x20\x09-\x0D"
#: A column name prefix that input tables are not expected to use.
OWN = "__llm_"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the cluster's ``spark.checkpoint.dir``; a temporary folder is made
    only where that setting is empty, as on a laptop.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder; they cut lineage durably.

    Tables are removed by ``drop`` once nothing reads them, and at the end of
    the application otherwise.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._fs().deleteOnExit(self._path(self.root))

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.option("compression", codec).mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs().delete(self._path(f"{self.root}/{name}"), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``docs`` with its columns after an Arrow kernel; columns are numbered for it, so any name will do."""
    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def words_of(text):
    """Array of the words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANKS}]+"), lambda w: w != "")
