"""Plans, quotas, payments and rate limits on customers and events. "Now" is fixed, so results are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sinks, streaming
from ..operators import entitle as E
from ..plans.stages import shared_folder
from .base import table

NOW = "2024-01-20 00:00:00"
_PLANS = ("FREE", "PAYG_10", "MONTHLY_25", "PRO_YEAR_UNLIMITED", "OTHER")


def now():
    return F.lit(NOW).cast("timestamp")


def users(spark, d) -> DataFrame:
    """Customers as users, everything by their number."""
    c = F.col("c_custkey")
    nothing = F.lit(None).cast("int")
    return table(spark, d, "customer").select(
        c.alias("user_id"), F.element_at(F.array(*map(F.lit, _PLANS)), (c % 5 + 1).cast("int")).alias("plan_code"), F.when(c % 7 == 0, nothing).otherwise((c % 6).cast("int")).alias("credits_remaining"), (c % 18).cast("int").alias("lifetime_parses_used"),
        F.when(c % 3 == 0, "expired").otherwise("active").alias("subscription_status"), F.timestamp_seconds(F.lit(1_704_067_200) + (c % 40) * 86400).alias("renewal_date"), F.timestamp_seconds(F.lit(1_704_067_200) + (c % 31) * 86400).alias("billing_cycle_end"),
        (c % 11 != 0).alias("is_verified"), F.timestamp_seconds(F.lit(1_702_000_000) + (c % 40) * 86400).alias("created_at"),
    )


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def payments(spark, d) -> DataFrame:
    """Events as payment notices: a reference for every three, a state by kind."""
    status = F.when(F.col("event_type") == "purchase", "Complete").when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "click", "Cancelled").otherwise("Pending")
    return events(spark, d).select("event_id", "ts", "user_id", F.floor(F.col("event_id") / 3).alias("reference"), status.alias("status"), F.floor(F.col("value") * 100).cast("long").alias("amount"))


def access_decision(spark, d) -> DataFrame:
    s = E.billing_status(now())
    return users(spark, d).select("user_id", E.access(now()).alias("access"), E.billing_gate(now()).alias("gate"), *(c.alias(n) for n, c in s.items()))


def low_credit(spark, d) -> DataFrame:
    return users(spark, d).select("user_id", E.low_credit().alias("low"), E.token_state(F.when(F.col("user_id") % 4 != 0, F.col("renewal_date")), now()).alias("token"))


def plan_terms(spark, d) -> DataFrame:
    u = users(spark, d).withColumn("plan_code", F.when(F.col("user_id") % 9 != 0, F.col("plan_code")))
    return E.with_plan(u).select("user_id", "plan_code", "kind", "credits", "price_cents", "unlimited")


def usage_by_period(spark, d) -> DataFrame:
    return E.usage(events(spark, d), users(spark, d))


def usage_rows(spark, d) -> DataFrame:
    """Usage of users of even number exists; periods of all others are added without uses."""
    used = E.usage(events(spark, d), users(spark, d))
    return E.missing_periods(used, used.where("user_id % 2 = 0").select("user_id", "period_key", "used"))


def quota_accept(spark, d) -> DataFrame:
    e = events(spark, d).join(users(spark, d).select("user_id", "plan_code"), "user_id")
    quota = F.when(F.col("plan_code") == "FREE", 15).when(F.col("plan_code") == "PAYG_10", 10).when(F.col("plan_code") == "MONTHLY_25", 25)
    return E.accepted(e, quota).select("event_id", F.col("nth").cast("long").alias("nth"), "accepted")


def deduction_machine(spark, d) -> DataFrame:
    uses = events(spark, d).select("user_id", "ts", "event_id", (F.col("event_id") % 37 == 0).alias("cycle_over"), (F.col("event_id") % 5 != 0).alias("live"))
    return E.deductions(uses, users(spark, d))


def usage_log_rows(spark, d) -> DataFrame:
    return E.usage_log(events(spark, d), users(spark, d), "PARSE")


def plan_effects(spark, d) -> DataFrame:
    p = events(spark, d).where("event_type = 'purchase'").withColumn("plan_code", F.element_at(F.array(*map(F.lit, _PLANS[1:4])), (F.col("event_id") % 3 + 1).cast("int")))
    out = E.plan_effects(p)
    return out.select("user_id", "plan_code", F.coalesce("credits_remaining", F.lit(-1)).alias("credits_remaining"), F.to_date("renewal_date").cast("string").alias("renewal_date"))


def latest_per_key(spark, d) -> DataFrame:
    return E.latest(events(spark, d), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


def idempotent_upsert(spark, d) -> DataFrame:
    """Payments upserted by reference, then all of them once more."""
    p = payments(spark, d)
    once = sinks.upsert(p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1"), "reference", F.col("ts"), F.col("event_id"))
    return sinks.upsert(once, p, "reference", F.col("ts"), F.col("event_id")).select("reference", "event_id", "status", "amount")


def payment_status_case(spark, d) -> DataFrame:
    s = E.payment_states(payments(spark, d))
    return s.select("reference", "status", "amount", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at"), "paid", "n_notices")


def processed_once(spark, d) -> DataFrame:
    p = payments(spark, d)
    done = E.processed_at(F.col("status"), F.col("ts"), F.when(F.col("event_id") % 4 == 0, F.lit("2020-01-01 00:00:00").cast("timestamp")))
    return p.select("event_id", F.date_format(done, "yyyy-MM-dd HH:mm:ss").alias("processed_at"))


def pending_expiry(spark, d) -> DataFrame:
    return payments(spark, d).select("event_id", E.pending_state(F.col("ts"), F.col("status"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("state"))


def late_completion(spark, d) -> DataFrame:
    p = payments(spark, d).groupBy("reference").agg(F.min("ts").alias("created"), F.min(F.when(F.col("status") == "Complete", F.col("ts"))).alias("completed"))
    return p.select("reference", E.late_completion(F.col("created"), F.col("completed")).alias("honoured"), E.late_completion(F.col("created"), F.col("completed"), honour=False).alias("strict"))


def admin_metrics(spark, d) -> DataFrame:
    return E.metrics(users(spark, d), payments(spark, d).withColumnRenamed("ts", "created_at"), now())


def point_lookup(spark, d) -> DataFrame:
    return E.lookup(table(spark, d, "customer"), "c_custkey", 7).select("c_custkey", "c_name")


def rate_windows(spark, d) -> DataFrame:
    out = streaming.rate_windows(events(spark, d).withColumn("client", F.col("event_type")), "client", 2)
    return out.select("client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "hits", "refused")


def first_hit_windows(spark, d) -> DataFrame:
    out = streaming.first_hit_windows(events(spark, d).withColumn("client", F.col("event_type")), "client", 2)
    return out.select("event_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "refused")


def keyed_upsert(spark, d) -> DataFrame:
    """Payments put into a table by parts of its key in three steps, the last of which repeats the one before."""
    p = payments(spark, d)
    kept = sinks.KeyedTable(spark, shared_folder(spark), "reference", ["ts", "event_id"], parts=8)
    for step in (p.where("event_id % 2 = 0"), p.where("event_id % 2 = 1"), p.where("event_id % 2 = 1")):
        kept.upsert(step)
    return kept.read().select("reference", "event_id", "status", "amount")


def payment_outcomes(spark, d) -> DataFrame:
    """The plan of the streams on tables: each reference is made with its first notice and done with its completions."""
    p = payments(spark, d)
    made = p.groupBy("reference").agg(F.min("ts").alias("created"))
    out = streaming.payment_outcomes(made, p.where("status = 'Complete'").select("reference", F.col("ts").alias("completed")), minutes=15, late_minutes=60)
    return out.select("reference", "outcome", F.date_format("completed", "yyyy-MM-dd HH:mm:ss").alias("completed"))


def once_per_reference(spark, d) -> DataFrame:
    """The first notice of each reference."""
    return streaming.once(payments(spark, d), "reference", order=("ts", "event_id")).select("reference", "event_id", "status", "amount")


QUERIES = {f.__name__: f for f in (
    access_decision, low_credit, plan_terms, usage_by_period, usage_rows, quota_accept, deduction_machine, usage_log_rows, plan_effects, latest_per_key, idempotent_upsert, payment_status_case, processed_once, pending_expiry,
    late_completion, keyed_upsert, payment_outcomes, admin_metrics, point_lookup, rate_windows, first_hit_windows, once_per_reference,
)}

_USERS = """users AS (SELECT c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'FREE' WHEN 1 THEN 'PAYG_10' WHEN 2 THEN 'MONTHLY_25' WHEN 3 THEN 'PRO_YEAR_UNLIMITED' ELSE 'OTHER' END AS plan, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 6 AS INT) END AS credits,
    CAST(c_custkey % 18 AS INT) AS used, c_custkey % 3 <> 0 AS live, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 40) AS renewal, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (c_custkey % 31) AS cycle_end, c_custkey % 11 <> 0 AS verified,
    make_timestamp(1702000000000000) + INTERVAL 1 DAY * (c_custkey % 40) AS created FROM customer)"""
_NOW = f"TIMESTAMP '{NOW}'"
_PAYMENTS = "payments AS (SELECT event_id, ts, user_id, event_id // 3 AS reference, CASE event_type WHEN 'purchase' THEN 'Complete' WHEN 'error' THEN 'Failed' WHEN 'click' THEN 'Cancelled' ELSE 'Pending' END AS status, CAST(floor(value * 100) AS BIGINT) AS amount FROM events)"
_USAGE = f"""{_USERS}, usage_ AS (SELECT e.user_id, CASE plan WHEN 'FREE' THEN 'lifetime' WHEN 'PAYG_10' THEN 'credit_bucket' WHEN 'OTHER' THEN NULL ELSE strftime(ts, '%Y-%m') END AS period_key, count(*) AS used,
    CASE plan WHEN 'FREE' THEN 15 WHEN 'PAYG_10' THEN 10 WHEN 'MONTHLY_25' THEN 25 END AS allowed FROM events e JOIN users u USING (user_id) GROUP BY e.user_id, period_key, plan)"""
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

ORACLES = {
    "access_decision": f"""WITH {_USERS} SELECT user_id, CASE WHEN NOT verified THEN 'EMAIL_NOT_VERIFIED' WHEN plan = 'PRO_YEAR_UNLIMITED' THEN CASE WHEN live AND renewal > {_NOW} THEN 'OK' ELSE 'SUBSCRIPTION_EXPIRED' END
        WHEN plan IN ('MONTHLY_25', 'PAYG_10') THEN CASE WHEN coalesce(credits, 0) > 0 THEN 'OK' ELSE 'CREDITS_EXHAUSTED' END WHEN plan = 'FREE' THEN CASE WHEN used < 15 THEN 'OK' ELSE 'FREE_LIMIT_REACHED' END ELSE 'INVALID_PLAN' END AS access,
        CASE WHEN NOT verified THEN 'EMAIL_NOT_VERIFIED' WHEN plan = 'PRO_YEAR_UNLIMITED' THEN CASE WHEN live AND renewal >= {_NOW} THEN 'OK' ELSE 'SUBSCRIPTION_EXPIRED' END WHEN plan = 'MONTHLY_25' THEN CASE WHEN cycle_end >= {_NOW} THEN 'OK' ELSE 'SUBSCRIPTION_EXPIRED' END
        WHEN plan IN ('FREE', 'PAYG_10') THEN 'OK' ELSE 'INVALID_PLAN' END AS gate, CASE WHEN plan IN ('PAYG_10', 'MONTHLY_25') THEN credits END AS credits_left, CASE WHEN plan = 'FREE' THEN greatest(0, 15 - used) END AS lifetime_left,
        NOT (plan = 'MONTHLY_25' AND cycle_end < {_NOW} OR plan = 'PRO_YEAR_UNLIMITED' AND (renewal < {_NOW} OR NOT live)) AS active FROM users""",
    "low_credit": f"""WITH {_USERS} SELECT user_id, plan <> 'PRO_YEAR_UNLIMITED' AND (plan = 'FREE' AND used >= 13 OR coalesce(credits, 0) <= 3) AS low, CASE WHEN user_id % 4 = 0 THEN 'INVALID' WHEN renewal < {_NOW} THEN 'EXPIRED' ELSE 'VALID' END AS token FROM users""",
    "plan_terms": f"""WITH {_USERS}, p AS (SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 'FREE' ELSE plan END AS plan_code FROM users) SELECT user_id, plan_code, CASE plan_code WHEN 'FREE' THEN 'lifetime' WHEN 'PAYG_10' THEN 'credits' WHEN 'OTHER' THEN NULL ELSE 'subscription' END AS kind,
        CASE plan_code WHEN 'FREE' THEN 15 WHEN 'PAYG_10' THEN 10 WHEN 'MONTHLY_25' THEN 25 END AS credits, CAST(CASE plan_code WHEN 'FREE' THEN 0 WHEN 'PAYG_10' THEN 2950 WHEN 'MONTHLY_25' THEN 4850 WHEN 'PRO_YEAR_UNLIMITED' THEN 48500 END AS BIGINT) AS price_cents,
        CASE WHEN plan_code <> 'OTHER' THEN plan_code = 'PRO_YEAR_UNLIMITED' END AS unlimited FROM p""",
    "usage_by_period": f"WITH {_USAGE} SELECT user_id, period_key, used, allowed, coalesce(used > allowed, false) AS over FROM usage_",
    "usage_rows": f"WITH {_USAGE} SELECT user_id, period_key, CASE WHEN user_id % 2 = 0 THEN used ELSE 0 END AS used FROM usage_ WHERE user_id % 2 = 0 OR period_key IS NOT NULL",
    "quota_accept": f"""WITH {_USERS}, n AS (SELECT event_id, plan, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS nth FROM events e JOIN users USING (user_id))
        SELECT event_id, nth, nth <= CASE plan WHEN 'FREE' THEN 15 WHEN 'PAYG_10' THEN 10 WHEN 'MONTHLY_25' THEN 25 ELSE 1000000000 END AS accepted FROM n""",
    "deduction_machine": f"""WITH RECURSIVE {_USERS}, uses AS (SELECT user_id, event_id % 37 = 0 AS over_, event_id % 5 <> 0 AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        fold AS (
          SELECT user_id, plan, CAST(0 AS BIGINT) AS n, CAST(coalesce(credits, 0) AS INT) AS c, CAST(used AS INT) AS u, 0 AS n_ok FROM users WHERE user_id IN (SELECT user_id FROM uses)
          UNION ALL
          SELECT user_id, plan, n, CASE WHEN ok AND plan IN ('PAYG_10', 'MONTHLY_25') THEN c - 1 ELSE c END, CASE WHEN ok AND plan = 'FREE' THEN u + 1 ELSE u END, n_ok + CAST(ok AS INT) FROM (
            SELECT *, CASE WHEN plan = 'FREE' THEN u < 15 WHEN plan IN ('PAYG_10', 'MONTHLY_25') THEN c > 0 WHEN plan = 'PRO_YEAR_UNLIMITED' THEN up ELSE false END AS ok FROM (
              SELECT f.user_id, f.plan, x.n, CASE WHEN f.plan = 'MONTHLY_25' AND over_ THEN 25 ELSE f.c END AS c, f.u, f.n_ok, x.up FROM fold f JOIN uses x ON x.user_id = f.user_id AND x.n = f.n + 1))
        ) SELECT user_id, arg_max(c, n) AS credits, arg_max(u, n) AS used, arg_max(n_ok, n) AS n_ok, CAST(max(n) - arg_max(n_ok, n) AS INT) AS n_refused FROM fold GROUP BY user_id""",
    "usage_log_rows": f"WITH {_USERS} SELECT event_id, e.user_id, 'PARSE' AS action, plan AS plan_code, CASE WHEN plan IN ('PAYG_10', 'MONTHLY_25') THEN 1 ELSE 0 END AS credits_deducted FROM events e JOIN users USING (user_id)",
    "plan_effects": """WITH RECURSIVE p AS (SELECT user_id, ts, event_id % 3 AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
        fold AS (
          SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS k, CAST(NULL AS INT) AS c, CAST(NULL AS DATE) AS r FROM p
          UNION ALL
          SELECT f.user_id, p.n, p.k, CASE p.k WHEN 0 THEN coalesce(f.c, 0) + 10 WHEN 1 THEN 25 END, CASE p.k WHEN 1 THEN CAST(CAST(p.ts AS DATE) + INTERVAL 1 MONTH AS DATE) WHEN 2 THEN CAST(CAST(p.ts AS DATE) + INTERVAL 12 MONTH AS DATE) ELSE f.r END FROM fold f JOIN p ON p.user_id = f.user_id AND p.n = f.n + 1
        ) SELECT user_id, CASE k WHEN 0 THEN 'PAYG_10' WHEN 1 THEN 'MONTHLY_25' ELSE 'PRO_YEAR_UNLIMITED' END AS plan_code, coalesce(c, -1) AS credits_remaining, CAST(r AS VARCHAR) AS renewal_date FROM fold WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""",
    "latest_per_key": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "idempotent_upsert": f"WITH {_PAYMENTS} SELECT reference, event_id, status, amount FROM payments QUALIFY row_number() OVER (PARTITION BY reference ORDER BY ts DESC, event_id DESC) = 1",
    "keyed_upsert": f"WITH {_PAYMENTS} SELECT reference, event_id, status, amount FROM payments QUALIFY row_number() OVER (PARTITION BY reference ORDER BY ts DESC, event_id DESC) = 1",
    "payment_outcomes": f"""WITH {_PAYMENTS}, p AS (SELECT reference, min(ts) AS a, min(ts) FILTER (WHERE status = 'Complete') AS b FROM payments GROUP BY reference)
        SELECT reference, CASE WHEN b <= a + INTERVAL 15 MINUTE THEN 'credited' ELSE 'Expired' END AS outcome, CASE WHEN b <= a + INTERVAL 15 MINUTE THEN {_STAMP.format('b')} END AS completed FROM p
        UNION ALL SELECT reference, 'credited_late', {_STAMP.format('b')} FROM p WHERE b > a + INTERVAL 15 MINUTE AND b <= a + INTERVAL 60 MINUTE""",
    "payment_status_case": f"""WITH {_PAYMENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY reference ORDER BY ts, event_id) AS n FROM payments), f AS (SELECT reference, arg_min(status, n) AS s, min(ts) AS t FROM o WHERE status <> 'Pending' GROUP BY reference)
        SELECT o.reference, arg_max(status, n) AS status, arg_max(amount, n) AS amount, {_STAMP.format('any_value(t)')} AS processed_at, coalesce(any_value(s) = 'Complete', false) AS paid, count(*) AS n_notices FROM o LEFT JOIN f USING (reference) GROUP BY o.reference""",
    "processed_once": f"WITH {_PAYMENTS} SELECT event_id, {_STAMP.format('x')} AS processed_at FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2020-01-01' WHEN status <> 'Pending' THEN ts END AS x FROM payments)",
    "pending_expiry": f"WITH {_PAYMENTS} SELECT event_id, CASE WHEN status = 'Pending' THEN CASE WHEN ts <= TIMESTAMP '2024-01-15 11:45:00' THEN 'Expired' ELSE 'Blocking' END END AS state FROM payments",
    "late_completion": f"""WITH {_PAYMENTS}, p AS (SELECT reference, min(ts) AS a, min(ts) FILTER (WHERE status = 'Complete') AS b FROM payments GROUP BY reference)
        SELECT reference, CASE WHEN b IS NULL THEN 'open' WHEN b > a + INTERVAL 15 MINUTE THEN 'credited_late' ELSE 'credited' END AS honoured, CASE WHEN b IS NULL THEN 'open' WHEN b > a + INTERVAL 15 MINUTE THEN 'skipped' ELSE 'credited' END AS strict FROM p""",
    "admin_metrics": f"""WITH {_USERS}, {_PAYMENTS}, b AS (SELECT {_NOW} - INTERVAL 14 DAY AS recent, {_NOW} - INTERVAL 28 DAY AS before)
        SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM users, b WHERE created >= recent) AS signups_last_14_days, (SELECT count(*) FROM users, b WHERE created >= before AND created < recent) AS signups_previous_14_days,
          (SELECT count(*) FROM payments, b WHERE status = 'Complete' AND ts >= recent) AS successful_payments_last_14_days, (SELECT count(*) FROM users WHERE plan = 'FREE') AS free_users, (SELECT count(*) FROM users WHERE plan = 'PAYG_10') AS payg_users,
          (SELECT count(*) FROM users WHERE plan = 'MONTHLY_25') AS monthly_users, (SELECT count(*) FROM users WHERE plan = 'PRO_YEAR_UNLIMITED') AS pro_year_unlimited_users FROM b""",
    "point_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 7 LIMIT 1",
    "rate_windows": f"""SELECT event_type AS client, {_STAMP.format("time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')")} AS window_start, count(*) AS hits, greatest(0, count(*) - 2) AS refused FROM events GROUP BY ALL""",
    "first_hit_windows": f"""WITH RECURSIVE o AS (SELECT event_id, event_type AS c, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
        fold AS (
          SELECT c, event_id, n, ts AS s, 1 AS h FROM o WHERE n = 1
          UNION ALL
          SELECT o.c, o.event_id, o.n, CASE WHEN o.ts >= f.s + INTERVAL 15 MINUTE THEN o.ts ELSE f.s END, CASE WHEN o.ts >= f.s + INTERVAL 15 MINUTE THEN 1 ELSE f.h + 1 END FROM fold f JOIN o ON o.c = f.c AND o.n = f.n + 1
        ) SELECT event_id, {_STAMP.format('s')} AS window_start, h > 2 AS refused FROM fold""",
    "once_per_reference": f"WITH {_PAYMENTS} SELECT reference, event_id, status, amount FROM payments QUALIFY row_number() OVER (PARTITION BY reference ORDER BY ts, event_id) = 1",
}
