"""What a fetcher needs to know of stored responses: which to try again, when, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retryable_status(code: Column) -> Column:
    """408, 429, and 500 and above but 501."""
    return code.isin(408, 429) | ((code >= 500) & (code != 501))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for: a number, or a date after now; 0 for others."""
    seconds = value.try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = date.cast("double") - now.cast("double")
    return F.greatest(F.coalesce(seconds, wait, F.lit(0.0)), F.lit(0.0))


def fetch_schedule(requests: DataFrame, rps: float = 2.0, burst: int = 4, delays: DataFrame | None = None, host_col: str = "host", order_col: str = "seq") -> DataFrame:
    """requests with start_s, when a token bucket for each host would let each one go.

    A host's first `burst` requests go at once and the others every 1 / rps
    seconds, or its delay (host, delay_s) where that is longer. The rows of a
    host are ordered in one task; a host's share of a crawl is bounded by its
    page budget.
    """
    place = F.row_number().over(Window.partitionBy(host_col).orderBy(order_col)) - 1
    rows = requests.withColumn("_place", place)
    even = F.greatest(F.col("_place") - (burst - 1), F.lit(0)) / F.lit(float(rps))
    if delays is None:
        return rows.withColumn("start_s", even).drop("_place")
    waits = delays.select(F.col("host").alias("_host"), F.col("delay_s").alias("_delay"))
    joined = rows.join(waits, rows[host_col] == waits["_host"], "left")
    return joined.withColumn("start_s", F.greatest(even, F.col("_place") * F.coalesce("_delay", F.lit(0.0)))).drop("_place", "_host", "_delay")
