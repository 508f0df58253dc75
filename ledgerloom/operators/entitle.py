"""Plans, quotas and payments as pure functions of user rows and event tables. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The plans (code, kind, credits in all or per cycle, price in cents, unlimited, recurring) and limits.
PLANS = (
    ("FREE", "lifetime", 15, 0, False, False),
    ("PAYG_10", "credits", 10, 2950, False, False),
    ("MONTHLY_25", "subscription", 25, 4850, False, True),
    ("PRO_YEAR_UNLIMITED", "subscription", None, 48500, True, True),
)
FREE_LIMIT, FREE_WARNING, CREDIT_WARNING = 15, 13, 3
PENDING_MINUTES = 15
# End of fixed values.


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan_code string, kind string, credits int, price_cents long, unlimited boolean, recurring boolean")


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def access(now: Column) -> Column:
    """OK, or why a user may not use the service."""
    live = (F.col("subscription_status") == "active") & (F.col("renewal_date") > now)
    return (
        F.when(~F.coalesce("is_verified", F.lit(False)), "EMAIL_NOT_VERIFIED")
        .when(F.col("plan_code") == "PRO_YEAR_UNLIMITED", F.when(live, "OK").otherwise("SUBSCRIPTION_EXPIRED"))
        .when(F.col("plan_code").isin("MONTHLY_25", "PAYG_10"), F.when(zero("credits_remaining") > 0, "OK").otherwise("CREDITS_EXHAUSTED"))
        .when(F.col("plan_code") == "FREE", F.when(zero("lifetime_parses_used") < FREE_LIMIT, "OK").otherwise("FREE_LIMIT_REACHED"))
        .otherwise("INVALID_PLAN")
    )


def billing_gate(now: Column) -> Column:
    """As access, by billing cycles only; credits are not looked at."""
    return (
        F.when(~F.coalesce("is_verified", F.lit(False)), "EMAIL_NOT_VERIFIED")
        .when(F.col("plan_code") == "PRO_YEAR_UNLIMITED", F.when((F.col("subscription_status") == "active") & (F.col("renewal_date") >= now), "OK").otherwise("SUBSCRIPTION_EXPIRED"))
        .when(F.col("plan_code") == "MONTHLY_25", F.when(F.col("billing_cycle_end") >= now, "OK").otherwise("SUBSCRIPTION_EXPIRED"))
        .when(F.col("plan_code").isin("FREE", "PAYG_10"), "OK").otherwise("INVALID_PLAN")
    )


def low_credit() -> Column:
    """Whether a user should be warned; users without limit never are."""
    return F.coalesce((F.col("plan_code") != "PRO_YEAR_UNLIMITED") & (((F.col("plan_code") == "FREE") & (zero("lifetime_parses_used") >= FREE_WARNING)) | (zero("credits_remaining") <= CREDIT_WARNING)), F.lit(False))


def billing_status(now: Column) -> dict[str, Column]:
    """credits_left, lifetime_left and active as a user sees them."""
    plan = F.col("plan_code")
    expired = ((plan == "MONTHLY_25") & (F.col("billing_cycle_end") < now)) | ((plan == "PRO_YEAR_UNLIMITED") & (F.col("renewal_date").isNull() | (F.col("renewal_date") < now) | F.coalesce(F.col("subscription_status") != "active", F.lit(True))))
    return {
        "credits_left": F.when(plan.isin("PAYG_10", "MONTHLY_25"), F.col("credits_remaining")),
        "lifetime_left": F.when(plan == "FREE", F.greatest(F.lit(0), FREE_LIMIT - zero("lifetime_parses_used"))),
        "active": ~F.coalesce(expired, F.lit(False)),
    }


def token_state(expires: Column, now: Column) -> Column:
    return F.when(expires.isNull(), "INVALID").when(expires < now, "EXPIRED").otherwise("VALID")


def with_plan(users: DataFrame) -> DataFrame:
    """users with their plan's terms, FREE where they have none. The plans are four rows: broadcast."""
    return users.withColumn("plan_code", F.coalesce("plan_code", F.lit("FREE"))).join(F.broadcast(plans(users.sparkSession)), "plan_code", "left")


def period_key(kind: Column, at: Column) -> Column:
    """What a use counts against: the lifetime, a bucket of credits or a month."""
    return F.when(kind == "lifetime", "lifetime").when(kind == "credits", "credit_bucket").when(kind == "subscription", F.date_format(at, "yyyy-MM"))


def usage(events: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, period_key, used, allowed, over: what each user used in each period, against the plan's limit (none: never over)."""
    joined = events.join(with_plan(users).select("user_id", "kind", "credits", "unlimited"), "user_id").withColumn("period_key", period_key(F.col("kind"), F.col("ts")))
    return joined.groupBy("user_id", "period_key").agg(F.count("*").alias("used"), F.max("credits").alias("allowed")).withColumn("over", F.coalesce(F.col("used") > F.col("allowed"), F.lit(False)))


def missing_periods(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """existing with a row of zero uses for each (user_id, period_key) wanted that it lacks."""
    new = wanted.where("period_key IS NOT NULL").select("user_id", "period_key").distinct().join(existing, ["user_id", "period_key"], "left_anti")
    return existing.select("user_id", "period_key", "used").unionByName(new.withColumn("used", F.lit(0).cast("long")))


def accepted(events: DataFrame, quota: Column, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """events with nth and accepted: the first `quota` events of each key, in order (null: all)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("nth", nth).withColumn("accepted", F.coalesce(F.col("nth") <= quota, F.lit(True)))


def deduction(plan: Column, credits: Column, used: Column, cycle_over: Column, live: Column) -> Column:
    """What one use does: outcome, credits and lifetime uses after it, credits deducted. A month that is over starts anew with its credits."""
    start = F.when((plan == "MONTHLY_25") & cycle_over, F.lit(25)).otherwise(credits)
    paid = plan.isin("PAYG_10", "MONTHLY_25")
    outcome = (
        F.when(plan == "FREE", F.when(used >= FREE_LIMIT, "FREE_LIMIT_REACHED").otherwise("OK"))
        .when(paid, F.when(start <= 0, "CREDITS_EXHAUSTED").otherwise("OK"))
        .when(plan == "PRO_YEAR_UNLIMITED", F.when(live, "OK").otherwise("SUBSCRIPTION_EXPIRED")).otherwise("INVALID_PLAN")
    )
    taken = ((outcome == "OK") & paid).cast("int")
    return F.struct(outcome.alias("outcome"), (start - taken).alias("credits"), (used + ((outcome == "OK") & (plan == "FREE")).cast("int")).alias("used"), taken.alias("deducted"))


def deductions(uses: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, n_ok, n_refused, credits, used after all uses of each user, in order. uses: user_id, ts, event_id, cycle_over, live.

    As deduction() says for each use, but told by counts, so that a user of very many uses is many tasks': each day of a
    user is cut where a month is over; the first piece takes what credits there are, each later one up to 25 anew. A day
    is then one row, and a user's days are gone through in order.
    """
    day = F.to_date("ts")
    piece = F.sum(F.col("cycle_over").cast("int")).over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    pieces = uses.withColumn("day", day).withColumn("piece", piece).groupBy("user_id", "day", "piece").agg(F.count("*").alias("n"), F.count_if(F.coalesce("live", F.lit(False))).alias("live"))
    later = F.col("piece") > 0
    days = pieces.groupBy("user_id", "day").agg(
        F.sum("n").alias("n"), F.sum("live").alias("live"), F.coalesce(F.sum(F.when(~later, F.col("n"))), F.lit(0)).alias("first"),
        F.max_by(F.when(later, F.col("n")), F.when(later, F.col("piece"))).alias("last"), F.coalesce(F.sum(F.when(later, F.least(F.lit(25), F.col("n")))), F.lit(0)).alias("renewed"),
    )
    packed = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "n", "live", "first", "last", "renewed"))).alias("days")).join(users.select("user_id", "plan_code", "credits_remaining", "lifetime_parses_used"), "user_id")
    plan = F.col("plan_code")
    start = F.struct(*(c.cast("long").alias(n) for n, c in (("credits", zero("credits_remaining")), ("used", zero("lifetime_parses_used")), ("n_ok", F.lit(0)), ("n", F.lit(0)))))

    def step(acc: Column, d: Column) -> Column:
        nothing = F.lit(0).cast("long")
        left = F.greatest(acc["credits"], nothing)
        monthly = F.least(left, d["first"])
        ok = (
            F.when(plan == "FREE", F.least(F.greatest(FREE_LIMIT - acc["used"], nothing), d["n"])).when(plan == "PAYG_10", F.least(left, d["n"]))
            .when(plan == "MONTHLY_25", monthly + d["renewed"]).when(plan == "PRO_YEAR_UNLIMITED", d["live"]).otherwise(nothing)
        )
        credits = F.when(plan == "PAYG_10", acc["credits"] - ok).when(plan == "MONTHLY_25", F.when(d["last"].isNotNull(), 25 - F.least(F.lit(25), d["last"])).otherwise(acc["credits"] - monthly)).otherwise(acc["credits"])
        used = F.when(plan == "FREE", acc["used"] + ok).otherwise(acc["used"])
        return F.struct(credits.cast("long").alias("credits"), used.cast("long").alias("used"), (acc["n_ok"] + ok).cast("long").alias("n_ok"), (acc["n"] + d["n"]).alias("n"))

    r = packed.select("user_id", F.aggregate("days", start, step).alias("r"))
    return r.select("user_id", *(c.cast("int").alias(n) for n, c in (("credits", F.col("r.credits")), ("used", F.col("r.used")), ("n_ok", F.col("r.n_ok")), ("n_refused", F.col("r.n") - F.col("r.n_ok")))))


def usage_log(events: DataFrame, users: DataFrame, action: str) -> DataFrame:
    """Log rows of events: user_id, action, plan_code, credits_deducted (FREE and unlimited plans: 0)."""
    return events.join(users.select("user_id", "plan_code"), "user_id").select("event_id", "user_id", F.lit(action).alias("action"), "plan_code", F.col("plan_code").isin("PAYG_10", "MONTHLY_25").cast("int").alias("credits_deducted"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key by order; which of equal ones is for the order to say."""
    w = Window.partitionBy(key).orderBy(*(o.desc() for o in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def processed_at(status: Column, at: Column, before: Column) -> Column:
    """When a payment is done with: kept once set, set by a final status."""
    return F.when(status.isin("Complete", "Cancelled", "Failed", "Error"), F.coalesce(before, at)).otherwise(before)


def payment_states(notices: DataFrame) -> DataFrame:
    """One row per reference from its notices (reference, status, amount, ts, event_id): the last state, when it was first final, and whether it was paid.

    A second Complete changes nothing; a completion after an earlier final state counts only where it is the first final one.
    """
    final = F.col("status").isin("Complete", "Cancelled", "Failed", "Error")
    order = F.struct("ts", "event_id")
    return notices.groupBy("reference").agg(
        F.max_by("status", order).alias("status"), F.max_by("amount", order).alias("amount"), F.min(F.when(final, F.col("ts"))).alias("processed_at"),
        (F.min_by(F.when(final, F.col("status")), F.when(final, order)) == "Complete").alias("paid"), F.count("*").alias("n_notices"),
    ).withColumn("paid", F.coalesce("paid", F.lit(False)))


def pending_state(created: Column, status: Column, now: Column, minutes: int = PENDING_MINUTES) -> Column:
    """Expired, blocking (one still runs) or null, of an unprocessed payment."""
    open_ = status.isin("Pending", "Initiated")
    old = created <= now - F.expr(f"INTERVAL {minutes} MINUTES")
    return F.when(open_ & old, "Expired").when(open_, "Blocking")


def late_completion(created: Column, completed: Column, honour: bool = True, minutes: int = PENDING_MINUTES) -> Column:
    """What a completion does: credited; or, after the time allowed, credited late (honour) or skipped."""
    late = completed > created + F.expr(f"INTERVAL {minutes} MINUTES")
    return F.when(completed.isNull(), "open").when(late, "credited_late" if honour else "skipped").otherwise("credited")


def plan_effects(payments: DataFrame) -> DataFrame:
    """user_id, plan_code, credits_remaining, renewal_date after all payments (user_id, plan_code, ts, event_id).

    Pay-as-you-go adds ten credits, a month sets 25, a year makes them unlimited (null). So credits are what the last
    month or year set, and ten for each later bucket. Sums and maxima only: no fold.
    """
    order = F.struct("ts", "event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sets = F.when(F.col("plan_code").isin("MONTHLY_25", "PRO_YEAR_UNLIMITED"), 1).otherwise(0)
    spans = payments.withColumn("span", F.sum(sets).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    renewal = F.when(F.col("plan_code") == "MONTHLY_25", F.add_months("ts", 1)).when(F.col("plan_code") == "PRO_YEAR_UNLIMITED", F.add_months("ts", 12))
    by_span = spans.groupBy("user_id", "span").agg(F.min_by("plan_code", order).alias("first_plan"), F.max_by("plan_code", order).alias("plan_code"), F.count_if(F.col("plan_code") == "PAYG_10").alias("buckets"), F.max(renewal).alias("renewal_date"))
    last = by_span.groupBy("user_id").agg(F.max_by(F.struct("first_plan", "plan_code", "buckets"), "span").alias("l"), F.max_by("renewal_date", F.when(F.col("renewal_date").isNotNull(), F.col("span"))).alias("renewal_date"))
    start = F.when(F.col("l.first_plan") == "MONTHLY_25", 25).otherwise(0)
    return last.select("user_id", F.col("l.plan_code").alias("plan_code"), F.when((F.col("l.first_plan") == "PRO_YEAR_UNLIMITED") & (F.col("l.buckets") == 0), None).otherwise(start + 10 * F.col("l.buckets")).cast("int").alias("credits_remaining"), "renewal_date")


def metrics(users: DataFrame, payments: DataFrame, now: Column) -> DataFrame:
    """Eight counts as one row, each table read once. users: created_at, plan_code; payments: created_at, status."""
    recent, before = now - F.expr("INTERVAL 14 DAYS"), now - F.expr("INTERVAL 28 DAYS")
    created = F.col("created_at")
    of_plan = lambda code: F.count_if(F.col("plan_code") == code)
    a = users.agg(
        F.count("*").alias("total_users"), F.count_if(created >= recent).alias("signups_last_14_days"), F.count_if((created >= before) & (created < recent)).alias("signups_previous_14_days"),
        of_plan("FREE").alias("free_users"), of_plan("PAYG_10").alias("payg_users"), of_plan("MONTHLY_25").alias("monthly_users"), of_plan("PRO_YEAR_UNLIMITED").alias("pro_year_unlimited_users"),
    )
    b = payments.agg(F.count_if((F.col("status") == "Complete") & (created >= recent)).alias("successful_payments_last_14_days"))
    # Both sides are one row.
    return a.crossJoin(b)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, at most one."""
    return rows.where(F.col(key) == F.lit(value)).limit(1)
