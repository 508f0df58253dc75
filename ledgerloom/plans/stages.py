"""Stage tables: what a job has worked out is written once, and all that follows reads it."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors reach.

    Only in local mode, where a session may name none, is a temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/stages-{uuid.uuid4().hex}"


#: The longest method, in bytes, that the JVM compiles; longer ones it interprets.
COMPILED = 8000


def compiled(spark: SparkSession) -> None:
    """Lets stages whose generated method the JVM would only interpret go without it, several times faster; a session that names a limit keeps it.

    The setting stays in the session, as plans read it when they run.
    """
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 65_534:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of files at path; null if there is none yet. Any store that Spark reaches will do."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(jvm.org.apache.hadoop.fs.Path(where, "[!_.]*"))
    return spark.read.parquet(path) if found is not None and len(found) else None


@dataclass(frozen=True)
class Stage:
    """A stage's rows as written, and their number."""

    rows: DataFrame
    n: int


class Stages:
    """Tables of one job, by name. Lineage ends at each: a lost executor costs the tasks that it ran."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or shared_folder(spark)).rstrip("/")

    def put(self, name: str, rows: DataFrame, *by: str) -> Stage:
        """rows written under name, in parts by the columns named; counted on the way."""
        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write
        path = f"{self.folder}/{name}"
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return Stage(self.spark.read.schema(rows.schema).parquet(path), seen.get["n"])
