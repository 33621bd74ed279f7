"""Date and money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewatch.functions.text import strip


def as_date(s: Column) -> Column:
    """The date an ISO text starts with, else NULL."""
    head = F.substring(s.cast("string"), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")).when(
        head.rlike(r"^\d{8}$"), F.try_to_date(head, "yyyyMMdd")
    )


def general_election_date(cycle: Column) -> Column:
    """The Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(cycle, F.lit(10), F.lit(31)), "MON"), 1)


def retry_after_seconds(value: Column, now: Column) -> Column:
    """A Retry-After header (seconds or HTTP date) as seconds from ``now``."""
    text = strip(value)
    stamp = r"(\d{1,2}) (\w{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) (GMT|UTC|[+-]\d{4})"
    part = [F.regexp_extract(text, stamp, i) for i in range(1, 6)]
    zone = F.when(part[4].isin("GMT", "UTC"), "+0000").otherwise(part[4])
    at = F.try_to_timestamp(F.concat_ws(" ", *part[:4], zone), F.lit("d MMM yyyy HH:mm:ss xx"))
    until = at.cast("double") - now.cast("timestamp").cast("double")
    seconds = F.coalesce(text.try_cast("double"), F.when(part[0] != "", until))
    return F.when(seconds.isNotNull(), F.greatest(F.lit(0.0), seconds))


def plain_number(x: Column, digits: int) -> Column:
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def money_compact(amount: Column) -> Column:
    x = amount.cast("double")
    return (
        F.when(x >= 1e9, F.concat(F.lit("$"), plain_number(x / 1e9, 1), F.lit("B")))
        .when(x >= 1e6, F.concat(F.lit("$"), plain_number(x / 1e6, 1), F.lit("M")))
        .when(x >= 1e3, F.concat(F.lit("$"), plain_number(x / 1e3, 0), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))
    )


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")
