"""Payment references, digests and form payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_REFERENCE = r"^([^_]*)_(.*)_[^_]*\z"


def reference_user(c: Column) -> Column:
    """What stands before the first underscore; null unless there are two."""
    return F.when(c.rlike(_REFERENCE), F.regexp_extract(c, _REFERENCE, 1))


def reference_plan(c: Column) -> Column:
    """What stands between the first and the last underscore."""
    return F.when(c.rlike(_REFERENCE), F.regexp_extract(c, _REFERENCE, 2))


def new_reference(user: Column, plan: Column, at_ms: Column) -> Column:
    return F.concat_ws("_", user.cast("string"), plan, at_ms.cast("string"))


def bank_reference(at_ms: Column, prefix: str) -> Column:
    """A prefix and the last ten digits of a time."""
    return F.concat(F.lit(prefix), F.right(at_ms.cast("string"), F.lit(10)))


def price_text(price_cents: Column) -> Column:
    return (price_cents.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def payload_hash(parts: Sequence[Column], secret: Column, lower: bool) -> Column:
    """SHA-512 of all parts and a secret in a row, null as nothing. Requests are lower-cased first (lower), notifications are not."""
    whole = F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts), secret)
    return F.sha2(F.lower(whole) if lower else whole, 512)


def token_digest(c: Column) -> Column:
    return F.sha2(c, 256)


def form_fields(body: Column) -> Column:
    """A URL-encoded form as a map."""
    raw = F.str_to_map(body, F.lit("&"), F.lit("="))
    return F.transform_values(raw, lambda k, v: F.try_url_decode(F.coalesce(v, F.lit(""))))
