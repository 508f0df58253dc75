"""Ledgers as CSV text, files and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import plain_text
from ..plans.stages import stored


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _amount(c: Column) -> Column:
    """Cents as the shortest decimal text, as 1234.5 or 12; null as nothing."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(plain_text(c), r"(\.\d*?)0+\z", "$1"), r"\.\z", ""), F.lit(""))


def _documents(rows: DataFrame, line: Column, head: str) -> DataFrame:
    """doc_id, csv: the lines of each document in row order under a head. One shuffle; a document's lines are one value."""
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", line.alias("line")))).alias("lines"))
    return grouped.select("doc_id", F.concat_ws("\n", F.lit(head), F.array_join("lines.line", "\n")).alias("csv"))


def csv_documents(rows: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, csv with Date, Description, Amount, Balance. docs: documents without rows get the head alone."""
    head = "Date,Description,Amount,Balance"
    line = F.concat_ws(",", F.coalesce("date", F.lit("")), quoted(F.col("description")), _amount(F.coalesce("amount_c", F.lit(0))), _amount(F.coalesce("balance_c", F.lit(0))))
    out = _documents(rows, line, head)
    return out if docs is None else docs.select("doc_id").join(out, "doc_id", "left").withColumn("csv", F.coalesce("csv", F.lit(head)))


def csv_statements(rows: DataFrame, statements: DataFrame, currency: str = "ZAR") -> DataFrame:
    """doc_id, csv with a head of statement fields, and Date, Description, Debit, Credit, Fee, Balance."""
    line = F.concat_ws(",", F.coalesce("date", F.lit("")), quoted(F.col("description")), *(_amount(F.col(c)) for c in ("debit_c", "credit_c", "fee_c", "balance_c")))
    body = _documents(rows, line, "Date,Description,Debit,Credit,Fee,Balance")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat_ws(
        "\n", F.concat(F.lit("Account Holder,"), text("client_name")), F.concat(F.lit("Bank,"), text("bank_name")), F.concat(F.lit("Account Number,"), text("account_number")),
        F.concat(F.lit("Period,"), text("period_start"), F.lit(" to "), text("period_end")), F.lit(f"Currency,{currency}"), F.lit(""),
    )
    return statements.join(body, "doc_id", "left").select("doc_id", F.concat_ws("\n", head, F.coalesce("csv", F.lit("Date,Description,Debit,Credit,Fee,Balance"))).alias("csv"))


def csv_table(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Any columns as one CSV text per key, in the order of the columns; the first row names them. A whole table is written by write_csv."""
    order = F.struct(*columns)
    line = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("l"))
    return out.select(key, F.concat_ws("\n", F.lit(",".join(columns)), F.array_join("l.line", "\n")).alias("csv"))


def json_documents(rows: DataFrame) -> DataFrame:
    """doc_id, json: an array of rows in order."""
    row = F.struct(F.col("date"), F.col("description"), plain_text(F.col("amount_c")).alias("amount"), plain_text(F.col("balance_c")).alias("balance"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", row.alias("r")))).alias("l")).select("doc_id", F.to_json("l.r").alias("json"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a table of files; none is rewritten."""
    rows.write.mode("append").parquet(path)


class KeyedTable:
    """A table of files with at most one row for each key, in parts by the key's hash: an upsert reads and rewrites only the parts that its keys fall into.

    order: the columns by which the last of several rows of a key stays; of equal ones it must not matter which. A part
    is replaced when all of its new files are written, so readers see it as it was or as it is; an upsert that was
    stopped is run again, and running it twice changes nothing. One writer at a time. The number of parts stays as it is.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str], parts: int = 64):
        self.spark, self.path, self.key, self.order, self.parts = spark, path, key, tuple(order), parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def read(self) -> DataFrame | None:
        """The table; null before the first upsert."""
        found = stored(self.spark, self.path)
        return None if found is None else found.drop("part")

    def upsert(self, new: DataFrame) -> list[int]:
        """Puts rows in, or in the place of their key's if they are not before it by order. The parts that were written."""
        new = new.withColumn("part", self._part())
        touched = sorted(r.part for r in new.select("part").distinct().collect())  # numbers of parts
        if not touched:
            return []
        found = stored(self.spark, self.path)
        both = new if found is None else found.where(F.col("part").isin(touched)).unionByName(new, allowMissingColumns=True)
        w = Window.partitionBy("part", self.key).orderBy(*(F.col(c).desc() for c in self.order))
        # Rows of a part meet in its files' task by the exchange that the window needs.
        merged = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").repartition("part")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        return touched


def upsert(existing: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """existing with rows of new put in or replaced by key; of rows of one key the last by order stays. Running it twice changes nothing."""
    from ..operators.entitle import latest

    return latest(existing.unionByName(new), key, *order)
