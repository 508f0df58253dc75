"""Line dedup [native]: lines that many documents hold stay in one of them.

Each text is cut at line ends; a line's key is the line without white space at both ends and with A-Z in lower case.
Keys of enough characters are hashed (two 64-bit hashes; of N different keys a share of about N / 2^128 is mistaken) and
the hashes are written once, with document, text and position. From this narrow table come the keys in enough distinct
documents and the largest document of each; all positions of such a key in other documents are dropped, and each text is
put together again from the positions that are left.

Only hashes and positions are shuffled, and each text once, to meet the positions it loses. Counting is pre-aggregated, so a line of all documents is no hot key;
where its rows meet their count, the side of the rows can be split. One document's positions meet in one row, as its text does.

Defined results: a null or empty text is one empty line; a null id is one document, smaller than all others; rows of one
id are one document for counting, and each keeps its own lines; very long texts take time linear in their lines; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty

#: What is stripped from both ends of a line: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """line stripped, with A-Z in lower case; lower() does the same where all characters are ASCII, in a fraction of the time."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_lines (before), n_dropped: one row per row of docs.

    A key of at least min_chars characters in at least min_docs documents stays in the largest of them alone.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    texts = docs.select(F.struct(F.col(id_col).alias("id")).alias("doc"), text_or_empty(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
    with Workspace(docs.sparkSession) as work:
        lines = texts.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        # A key has no more characters than its line, so most short lines need no key.
        keyed = lines.where(F.char_length("line") >= min_chars).select("doc", "version", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
        held = work.saved(keyed.select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")))
        # Rows with such a key: at least as many as documents with it, so no key is missed. Few are left for the exact count.
        # Counts are tables before they are joined: each side of a join then has an exchange of its own, and Spark can split the rows of a key that very many hold.
        often = work.saved(held.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2"))
        frequent = work.saved(held.join(often, ["h1", "h2"]))
        spread = work.saved(frequent.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last"))
        gone = frequent.join(spread, ["h1", "h2"]).where(F.col("doc") < F.col("last"))
        # A set: equal rows lose the same positions.
        lost = work.saved(gone.groupBy(F.col("doc").alias("of"), F.col("version").alias("of_version")).agg(F.collect_set("pos").alias("lost")), keep=True)
    # The same join at every size: texts meet their positions by an exchange, once.
    both = texts.join(lost.hint("merge"), (F.col("doc") == F.col("of")) & (F.col("version") == F.col("of_version")), "left")
    cut = both.select("doc.id", F.split("text", "\n").alias("lines"), F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    # array_except hashes, so that a text of very many lines takes linear time.
    left = cut.withColumn("left", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost"))
    return left.select(
        F.col("id").alias("doc_id"),
        F.array_join(F.when(F.size("lost") == 0, F.col("lines")).otherwise(F.transform("left", lambda k: F.get("lines", k))), "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_dropped"),
    )


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs, 3, 20).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op12_line_dedup": r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT keyed.*, held.key IS NOT NULL AND doc_id <> last AS gone FROM keyed LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
