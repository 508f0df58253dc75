"""Streams against their batch versions: files in several batches, late and missing events, stops and repeats."""

import datetime
import os
import random
import shutil
import time

from pyspark.sql import functions as F

from ledgerloom import sinks, streaming
from ledgerloom.operators import entitle
from ledgerloom.plans import layouts
from ledgerloom.streaming.statements import arriving

AT = datetime.datetime(2024, 1, 1)


def minutes(m):
    return AT + datetime.timedelta(minutes=m)


def run(df, path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/{name}").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def files(spark, path, batches, schema):
    """A file for each batch, in order; read one at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{k}")
    os.makedirs(f"{path}/all")
    for k in range(len(batches)):
        part = next(f for f in os.listdir(f"{path}/b{k}") if f.endswith(".parquet"))
        shutil.copyfile(f"{path}/b{k}/{part}", f"{path}/all/{k:03}.parquet")
        os.utime(f"{path}/all/{k:03}.parquet", (time.time() + k, time.time() + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all")


HITS = "event_id long, client string, ts timestamp"


def windows_plain(rows, limit):
    out, state = [], {}
    for i, client, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        start, n = state.get(client, (None, 0))
        if start is None or (at - start).total_seconds() >= 900:
            start, n = at, 0
        state[client] = (start, n + 1)
        out.append((i, client, at, start, n + 1 > limit))
    return sorted(out)


def test_first_hits_in_batch(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), minutes(rng.choice([rng.randrange(3000), rng.randrange(60)])) + datetime.timedelta(microseconds=rng.choice([0, 1, 999_999]))) for i in range(900)]
    rows += [(1000 + i, "busy", minutes(i / 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, HITS)
    got = streaming.first_hit_windows(df, "client", 3)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == windows_plain(rows, 3)


def test_limits_forget(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"c{rng.randrange(30)}", minutes(m)) for i, m in enumerate(sorted(rng.uniform(0, 200) for _ in range(400)))]
    rows.append((1000, "last", minutes(1000)))
    batches = [rows[k : k + 67] for k in range(0, len(rows), 67)] + [[(1001, "last", minutes(2000))], [(1002, "last", minutes(3000))]]
    q = run(streaming.limited_stream(files(spark, str(tmp_path), batches, HITS), "client", 2), tmp_path, "forgetting")
    whole = [r for b in batches for r in b]
    assert sorted(map(tuple, spark.table("forgetting").collect())) == windows_plain(whole, 2)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(kept) > 20 and kept[-1] <= 4, kept


def test_payments_as_they_happen(spark, tmp_path):
    rng = random.Random(5)
    created = [(k, minutes(k * 3)) for k in range(60)]
    delays = {k: rng.choice([0, 5, 14, 15, 16, 40, 300, None, None]) for k in range(60)}
    completed = [(k, minutes(k * 3 + d)) for k, d in delays.items() if d is not None]
    completed += [(k, minutes(k * 3 + d + 1)) for k, d in delays.items() if d is not None and k % 7 == 0]  # a second notice changes nothing
    end = [(900, minutes(5000)), (901, minutes(9000)), (902, minutes(13000))]
    by_time = lambda rows, at: [r for r in rows if at <= r[1] < at + datetime.timedelta(minutes=90)]
    spans = [minutes(m) for m in range(0, 540, 90)]
    streams = []
    for name, rows, column in (("made", sorted(created, key=lambda r: r[1]), "created"), ("done", sorted(completed, key=lambda r: r[1]), "completed")):
        batches = [by_time(rows, at) or [(-1 - i, at)] for i, at in enumerate(spans)] + [[e] for e in end]
        streams.append(files(spark, f"{tmp_path}/{name}", batches, f"reference long, {column} timestamp"))
    run(streaming.payment_outcomes(*streams, watermark="10 minutes"), tmp_path, "outcomes")
    got = {r.reference: r.outcome for r in streaming.payment_state(spark.table("outcomes").where("reference between 0 and 59")).collect()}
    # The batch rules on the same notices, when all payments are old.
    batch = spark.createDataFrame([(k, at, at + datetime.timedelta(minutes=delays[k]) if delays[k] is not None else None) for k, at in created], "reference long, created timestamp, completed timestamp")
    now = F.lit(minutes(4000)).cast("timestamp")
    rows = batch.select("reference", entitle.late_completion(F.col("created"), F.col("completed")).alias("done"), entitle.pending_state(F.col("created"), F.when(F.col("completed").isNull(), "Pending").otherwise("Complete"), now).alias("pending"))
    assert got == {r.reference: r.pending if r.done == "open" else r.done for r in rows.collect()}
    expired = {r.reference for r in spark.table("outcomes").where("outcome = 'Expired' and reference between 0 and 59").collect()}
    assert expired == {k for k, d in delays.items() if d is None or d > 15}  # late ones had expired first
    tables = streaming.payment_outcomes(spark.createDataFrame(created, "reference long, created timestamp"), spark.createDataFrame(completed, "reference long, completed timestamp"))
    assert {r.reference: r.outcome for r in streaming.payment_state(tables).collect()} == got


CAPITEC = "Capitec Bank Limited\nUnique Document No.: ab-{0}\nTransaction History\n01/02/2025 A{0} 5.00 10.00\n02/02/2025 B 7.00\n* Includes VAT"


def test_statements_as_they_arrive(spark, tmp_path):
    texts = {f"s{k}.txt": CAPITEC.format(k).encode() for k in range(7)} | {"odd.txt": b"First National Bank \xe9", "none.txt": b"a letter"}
    folder, names = tmp_path / "in", sorted(texts)
    folder.mkdir()
    intake = streaming.Intake(spark, str(tmp_path / "out"))

    def arrive(some, copy=""):
        for n in some:
            (folder / copy).mkdir(exist_ok=True)
            (folder / copy / n).write_bytes(texts[n])
        q = intake.start(arriving(spark, str(folder), 2), str(tmp_path / "check"), availableNow=True)
        q.awaitTermination(300)
        assert q.exception() is None

    arrive(names[:3])
    arrive(names[3:6])
    arrive(names[6:])
    arrive(names[2:5], copy="again")  # the same files in another place
    want = spark.createDataFrame([(n, n, t.decode("utf8", "replace")) for n, t in texts.items()], "doc_id string, source_file string, text string")
    columns = ["source_file", "date", "description", "amount_c", "balance_c", "statement_id", "bank_name"]
    table = lambda df, c: sorted(map(str, df.select(c).collect()))
    assert table(intake.rows(), columns) == table(layouts.parse_statements(want), columns)
    told = ["source_file", "bank_name", "n_transactions", "closing_c", "error_code"]
    before = table(intake.statements(), told)
    assert before == table(layouts.statements(want), told) and len(before) == 9
    # A stop after the tables were written, but before the stream noted it: the batch comes again.
    first = [r.source_file for r in spark.read.parquet(str(tmp_path / "out" / "documents")).where("batch = 0").collect()]
    assert len(first) == 2
    again = spark.createDataFrame([(1, n, texts[n].decode("utf8", "replace")) for n in first], "doc_id long, source_file string, text string")
    intake.commit(again, 0)
    assert table(intake.statements(), told) == before
    new = spark.createDataFrame([(1, "new.txt", "x"), (2, "new.txt", "x"), (3, names[0], texts[names[0]].decode())], "doc_id long, source_file string, text string")
    for _ in range(2):
        intake.commit(new, 99)
        assert len(table(intake.statements(), told)) == 10 and intake.documents().where("read_error is not null").count() == 0


def test_upsert_of_one_key_writes_one_part(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, k % 5, f"v{k}") for k in range(300)]
    schema = "reference long, ts long, value string"
    keyed = sinks.KeyedTable(spark, path, "reference", ["ts", "value"], parts=8)
    assert keyed.read() is None and keyed.upsert(spark.createDataFrame([], schema)) == []
    assert len(keyed.upsert(spark.createDataFrame(rows, schema))) == 8

    def written():
        return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    old = written()
    one = spark.createDataFrame([(7, 9, "new"), (7, 8, "older")], schema)
    assert len(keyed.upsert(one)) == 1
    changed = {os.path.dirname(f) for f, _ in set(old.items()) ^ set(written().items())}
    assert len(changed) == 1
    state = sorted(map(tuple, keyed.read().select("reference", "ts", "value").collect()))
    assert state == sorted((7, 9, "new") if r[0] == 7 else r for r in rows)
    keyed.upsert(one)
    keyed.upsert(spark.createDataFrame([(7, 1, "late")], schema))
    assert sorted(map(tuple, keyed.read().select("reference", "ts", "value").collect())) == state
    whole = sinks.upsert(spark.createDataFrame(rows, schema), one, "reference", F.col("ts"), F.col("value"))
    assert sorted(map(tuple, whole.select("reference", "ts", "value").collect())) == state
