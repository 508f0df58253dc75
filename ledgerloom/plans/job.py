"""The staged job: classify, look the schema up, extract, normalise, validate, answer. Each stage is a table that the next ones read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import bind
from ..operators import classify as K
from ..operators import ledger as L
from ..operators import metadata as M
from ..operators import normalize as N
from ..operators import segment as S
from ..operators import validate as V
from .layouts import block_rows, block_text, standard_rows
from .stages import Stages

PREVIEW = 2000
OWN = "standard_bank_statement"


@dataclass(frozen=True)
class Job:
    """jobs: a row per document; statements, transactions, issues and summaries of those that were parsed. All are tables of the job's folder; counts: their rows by name."""

    jobs: DataFrame
    statements: DataFrame
    transactions: DataFrame
    issues: DataFrame
    summaries: DataFrame
    counts: dict[str, int]


def _tagged_lines(docs: DataFrame) -> DataFrame:
    """kind, doc_id, line_no, line, start, end, job: a line `job` for each document with what its whole text says, and lines of those that are parsed, by the layout that reads them. One narrow step."""
    t = F.col("text")
    started = K.job_status(K.classify(docs)).withColumns({"job_id": F.sha2(F.concat_ws("\n", F.coalesce("source_file", F.lit("")), F.coalesce("text", F.lit(""))), 256), "preview": F.substring("text", 1, PREVIEW), "header": F.struct(*M.statement_fields(t)), "mended_o": M.mended_opening(t), "mended_c": M.mended_closing(t)})
    live, own = F.col("status") == "completed", F.col("document_subtype") == OWN
    # All layouts but one are read as dated blocks.
    kind = F.when(~live, "job").when(own, "standard").otherwise("blocks")
    body = F.when(live, F.when(own, t).otherwise(block_text(t)))
    job = F.struct(*(c for c in started.columns if c not in ("doc_id", "text")))
    told = started.select("doc_id", kind.alias("kind"), job.alias("job"), F.concat(F.array(F.lit(None).cast("string")), F.coalesce(S.text_lines(body), F.array().cast("array<string>"))).alias("lines"))
    edge = lambda c: bind(F.col(f"job.header.{c}"), dates.period_date)
    own = F.col("kind") == "standard"
    edges = told.withColumns({"start": F.when(own, edge("period_start")), "end": F.when(own, edge("period_end")), "period_end": F.when(own, F.col("job.header.period_end"))})
    lines = edges.select("doc_id", "kind", "job", "start", "end", "period_end", F.posexplode("lines").alias("line_no", "line"))
    top = F.col("line_no") == 0
    return lines.where(top | (F.col("line") != "")).withColumns({"kind": F.when(top, "job").otherwise(F.col("kind")), "job": F.when(top, F.col("job"))})


def run_parse_job(docs: DataFrame, default_year: int = 2026, folder: str | None = None) -> Job:
    """docs: doc_id, source_file, text. A job's id is a digest of its file and text, so the same input has the same one.

    Runs when it is called, in three steps, each of which writes tables that the next ones read: the texts, scanned once,
    as lines by layout and a line for each document; rows; statements with what is wrong with them. folder: where the
    tables go, by default a new folder among the shared ones.
    """
    stages = Stages(docs.sparkSession, folder)
    lines = stages.put("lines", _tagged_lines(docs), "kind").rows
    heads = lines.where("kind = 'job'").select("doc_id", "job.*")
    live = heads.where("status = 'completed'")
    of = lambda kind: lines.where(F.col("kind") == kind)
    own = standard_rows(of("standard").drop("kind", "job"), keep=["period_end"])
    own = N.standard_rows(own, F.col("period_end"), default_year).drop("period_end")
    rows = stages.put("transactions", own.unionByName(N.plain_rows(block_rows(of("blocks").select("doc_id", "line_no", "line")))))
    edges = L.totals(rows.rows).select("doc_id", F.col("opening_c").alias("rows_o"), F.col("closing_c").alias("rows_c"))
    joined = live.select("doc_id", "source_file", "document_subtype", "header.*", "mended_o", "mended_c").join(edges, "doc_id", "left")
    is_own = F.col("document_subtype") == OWN
    opening, closing = L.balances(F.when(is_own, F.coalesce("mended_o", "opening_c")).otherwise(F.col("opening_c")), F.when(is_own, F.coalesce("mended_c", "closing_c")).otherwise(F.col("closing_c")), F.col("rows_o"), F.col("rows_c"), is_own)
    statements = stages.put("statements", N.statement_envelope(joined.withColumns({"opening_c": opening, "closing_c": closing, "bank_name": F.col("document_subtype")})))
    found = stages.put("issues", V.issues(statements.rows, rows.rows))
    summaries = stages.put("summaries", V.summary(statements.rows, found.rows))
    done = heads.drop("header", "mended_o", "mended_c").join(summaries.rows.select("doc_id", F.col("status").alias("validation_status"), "score"), "doc_id", "left")
    jobs = stages.put("jobs", done.withColumn("status", F.when(F.col("validation_status") == "failed", "failed").otherwise(F.col("status"))))
    tables = {"jobs": jobs, "statements": statements, "transactions": rows, "issues": found, "summaries": summaries}
    return Job(**{name: t.rows for name, t in tables.items()}, counts={name: t.n for name, t in tables.items()})


def period_of(statements: DataFrame) -> DataFrame:
    """doc_id with its period as dates."""
    return statements.select("doc_id", dates.period_date(F.col("period_start")).alias("start"), dates.period_date(F.col("period_end")).alias("end"))
