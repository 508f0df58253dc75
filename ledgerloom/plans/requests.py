"""Requests: files of users parsed if their plans allow it, with what each one did to its user."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import entitle as E
from .layouts import parse_documents, rows_of, statements_of
from .stages import Stages

ACTION = "parse_statement"
#: What a refusal or a failure is answered with.
STATUS = {"OK": 200, "NO_FILE_UPLOADED": 400, "UNSUPPORTED_BANK": 400, "UNKNOWN_BANK": 400, "PARSER_ERROR": 500, "PARSE_FAILED_OR_EMPTY": 422, "UNAUTHORIZED": 401}
REFUSED = 403


@dataclass(frozen=True)
class Run:
    """answers: a row for each request (outcome, status, n_files, n_transactions, credits_deducted); transactions: rows of those that are OK; usage_log: their log; users: their counters afterwards."""

    answers: DataFrame
    transactions: DataFrame
    usage_log: DataFrame
    users: DataFrame


def status(outcome: Column) -> Column:
    out = F
    for code, number in STATUS.items():
        out = out.when(outcome == code, number)
    return out.otherwise(REFUSED)


def handle(requests: DataFrame, files: DataFrame, users: DataFrame, now: Column, folder: str | None = None) -> Run:
    """requests: request_id, user_id, ts; files: request_id, file_no, source_file, text; users: as entitle.access needs them.

    A request is refused by its user's plan before its files are looked at; then its first file that can't be read, in
    order, says why it failed; else it is OK and takes a credit (FREE: a lifetime use; no limit: nothing). A user's
    requests are taken in order of (ts, request_id), and only OK ones count, so what is left for one is what earlier ones
    that could be parsed have left: a count in a window, not a loop. Texts are scanned once: what was read from them, and the answers, are tables in folder
    (a new one among the shared ones by default), which the results read.
    """
    stages = Stages(files.sparkSession, folder)
    docs = files.select(F.struct("request_id", "file_no").alias("doc_id"), "source_file", "text")
    parsed = stages.put("parsed", parse_documents(docs)).rows
    told = statements_of(parsed).select(F.col("doc_id.request_id").alias("request_id"), F.col("doc_id.file_no").alias("file_no"), "error_code", "n_transactions")
    read = told.groupBy("request_id").agg(F.count("*").alias("n_files"), F.min_by(F.col("error_code"), F.when(F.col("error_code").isNotNull(), F.col("file_no"))).alias("file_error"), F.sum("n_transactions").alias("n_transactions"))
    asked = requests.join(read, "request_id", "left").withColumn("could", F.when(F.col("n_files").isNull(), "NO_FILE_UPLOADED").otherwise(F.coalesce(F.when(F.col("file_error") == "NO_TRANSACTIONS", "PARSE_FAILED_OR_EMPTY").otherwise(F.col("file_error")), F.lit("OK"))))
    # A user without a row is none. FREE users have lifetime uses left, those with credits have these, the others any number.
    plan = F.col("plan_code")
    quota = F.when(plan == "FREE", E.FREE_LIMIT - E.zero("lifetime_parses_used")).when(plan.isin("PAYG_10", "MONTHLY_25"), E.zero("credits_remaining"))
    known = users.withColumns({"gate": E.access(now), "quota": quota, "known": F.lit(True)})
    joined = asked.join(known, "user_id", "left")
    counts = (F.col("gate") == "OK") & (F.col("could") == "OK")
    before = F.coalesce(F.sum(counts.cast("long")).over(Window.partitionBy("user_id").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spent = F.coalesce(before >= F.col("quota"), F.lit(False))
    outcome = (
        F.when(F.col("known").isNull(), "UNAUTHORIZED").when(F.col("gate") != "OK", F.col("gate"))
        .when(spent, F.when(plan == "FREE", "FREE_LIMIT_REACHED").otherwise("CREDITS_EXHAUSTED")).otherwise(F.col("could"))
    )
    judged = joined.withColumn("outcome", outcome).withColumn("status", status(F.col("outcome")))
    ok = F.col("outcome") == "OK"
    answers = stages.put("answers", judged.select("request_id", "user_id", "ts", "plan_code", "outcome", "status", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.when(ok, F.col("n_transactions")).otherwise(0).alias("n_transactions"), F.when(ok & (plan != "PRO_YEAR_UNLIMITED"), 1).otherwise(0).alias("credits_deducted"))).rows
    good = answers.where("outcome = 'OK'")
    rows = rows_of(parsed).select(F.col("doc_id.request_id").alias("request_id"), F.col("doc_id.file_no").alias("file_no"), "*").drop("doc_id")
    transactions = rows.join(good.select("request_id"), "request_id", "left_semi")
    log = good.select("request_id", "user_id", F.lit(ACTION).alias("action"), "plan_code", "credits_deducted", "ts")
    used = good.groupBy("user_id").agg(F.sum("credits_deducted").alias("taken"))
    taken = F.coalesce("taken", F.lit(0))
    left = users.join(used, "user_id", "left").withColumns({
        "lifetime_parses_used": F.when(plan == "FREE", E.zero("lifetime_parses_used") + taken).otherwise(F.col("lifetime_parses_used")).cast("int"),
        "credits_remaining": F.when(plan.isin("PAYG_10", "MONTHLY_25"), E.zero("credits_remaining") - taken).otherwise(F.col("credits_remaining")).cast("int"),
    }).drop("taken")
    return Run(answers, transactions, log, left)
