"""First events, elapsed days and status, as pure queries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a trial; a fixed value.
DAYS = 7


def parse_record(record: Column) -> Column:
    """(started_at, fingerprint) of "seconds|fingerprint" or bare seconds; null where the seconds are no number (F16)."""
    at = F.split_part(record, F.lit("|"), F.lit(1)).try_cast("long")
    rest = F.when(F.instr(record, "|") > 0, F.substring(record, F.instr(record, "|") + 1, F.length(record))).otherwise(F.lit(""))
    return F.when(at.isNotNull(), F.struct(at.alias("started_at"), rest.alias("fingerprint")))


def same_machine(a: Column, b: Column) -> Column:
    """Equal fingerprints, or one unknown."""
    return (a == "") | (b == "") | (a == b)


def elapsed_days(started: Column, now: Column) -> Column:
    """Whole days since a start, never below 0."""
    return F.floor(F.greatest(now - started, F.lit(0)) / 86400)


def status(licensed: Column, started: Column, now: Column) -> Column:
    """licensed, trialing with the days left, or expired."""
    used = elapsed_days(started, now)
    name = F.when(licensed, "licensed").when(started.isNull() | (used >= DAYS), "expired").otherwise("trialing")
    return F.struct(name.alias("status"), F.when(~licensed & started.isNotNull() & (used < DAYS), (DAYS - used).cast("int")).alias("days_left"))


def may_write(enforced: Column, state: Column) -> Column:
    return ~enforced | (state != "expired")


def accepts(product: Column, accepted: list[str]) -> Column:
    """Whether a receipt's product is among those accepted, by exact case."""
    return product.isin(*accepted)


def allowed(url: Column, prefixes: list[str]) -> Column:
    """Whether an address begins with one of the allowed prefixes."""
    return reduce(or_, [url.startswith(p) for p in prefixes], F.lit(False))


def first_start(records: DataFrame, keys: list[str], machine: Column, now: Column) -> DataFrame:
    """The earliest start among a key's records of this machine, now if there is none."""
    fits = same_machine(F.col("fingerprint"), machine)
    return records.groupBy(*keys).agg(F.coalesce(F.min(F.when(fits, F.col("started_at"))), F.max(now)).alias("started_at"))
