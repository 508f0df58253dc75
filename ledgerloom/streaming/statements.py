"""Statements as they arrive: a stream of files parsed batch by batch into a table that holds each statement once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.layouts import parse_documents, rows_of, statements_of
from ..plans.stages import stored
from ..sources import BINARY_FILES, decoded


def job_id(docs: DataFrame) -> DataFrame:
    """docs with job_id: a digest of file and text, so the same input has the same one."""
    return docs.withColumn("job_id", F.sha2(F.concat_ws("\n", F.coalesce("source_file", F.lit("")), F.coalesce("text", F.lit(""))), 256))


class Intake:
    """Two tables in a folder: documents (as parse_documents, with sent_id and read_error, by batch), and jobs (job_id, by the first signs of it and batch).

    A document's doc_id here is its job id, as the numbers it is sent with (sent_id) may be the same in two batches.

    A batch is committed under its number: running it again, as a stream does after a stop, replaces what it wrote. A
    statement whose job id another batch has committed is left out, so a file that comes twice is there once. Ids are
    looked up only in the slices of jobs that the batch's own fall into. No batch rewrites another one's files.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, table: str) -> DataFrame | None:
        return stored(self.spark, f"{self.folder}/{table}")

    def commit(self, docs: DataFrame, batch_id: int) -> None:
        """docs: doc_id, source_file, text, and error_code if there is one."""
        if "error_code" not in docs.columns:
            docs = docs.withColumn("error_code", F.lit(None).cast("string"))
        docs = job_id(docs).dropDuplicates(["job_id"]).withColumn("slice", F.concat(F.lit("s"), F.substring("job_id", 1, 2))).persist()
        try:
            jobs = self._read("jobs")
            if jobs is not None:
                slices = [r["slice"] for r in docs.select("slice").distinct().collect()]  # 256 at most
                known = jobs.where(F.col("slice").isin(slices) & (F.col("batch") != batch_id)).select("job_id")
                new = docs.join(known, "job_id", "left_anti")
            else:
                new = docs
            job = F.col("job_id").alias("doc_id")
            parsed = parse_documents(new.select(job, "source_file", "text"))
            told = parsed.join(new.select(job, F.col("doc_id").alias("sent_id"), F.col("error_code").alias("read_error")), "doc_id").withColumn("batch", F.lit(batch_id))
            self._put(told, "documents", "batch")
            self._put(new.select("job_id", "slice", F.lit(batch_id).alias("batch")), "jobs", "slice", "batch")
        finally:
            docs.unpersist()

    def _put(self, rows: DataFrame, table: str, *by: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.folder}/{table}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Parses a stream of documents into the tables. trigger: as DataStreamWriter.trigger takes it."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.commit(batch, number)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def documents(self) -> DataFrame | None:
        """parse_documents' columns, sent_id and read_error of all that is committed; null before the first batch."""
        found = self._read("documents")
        return None if found is None else found.drop("batch")

    def rows(self) -> DataFrame:
        return rows_of(self.documents())

    def statements(self) -> DataFrame:
        return statements_of(self.documents())


def arriving(spark: SparkSession, folder: str, most_files: int | None = None) -> DataFrame:
    """Files of a folder as a stream of documents, each once. most_files: of one batch."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", True)
    return decoded((reader.option("maxFilesPerTrigger", most_files) if most_files else reader).load(folder))
