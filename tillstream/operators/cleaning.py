"""Event cleaning, de-duplication and run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions import iso_timestamp, iso_timestamp_or_null, number_or_zero, whole_or_null
from tillstream.operators.ranking import first_per_key

# The columns and fill-ins of the cleaning rules.
REQUIRED = ["event_id", "session_id", "customer_id", "event_type"]
NUMERIC = ["product_price_vnd", "product_price_usd", "quantity", "line_total_vnd", "line_total_usd"]
FILL = {
    "utm_source": "unknown",
    "utm_medium": "unknown",
    "utm_campaign": "unknown",
    "referrer": "direct",
}


def is_valid() -> Column:
    """Row test on raw columns: keys present, price and quantity not negative."""
    keys = F.lit(True)
    for name in REQUIRED:
        keys = keys & F.col(name).isNotNull()
    return keys & (number_or_zero(F.col("product_price_vnd")) >= 0) & (number_or_zero(F.col("quantity")) >= 0)


def clean_events(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Parse times, drop invalid rows, fill gaps and coerce the numeric columns.

    ``strict`` raises on a malformed timestamp; otherwise such rows are left out
    here and listed by :func:`malformed_events`.
    """
    parse = iso_timestamp if strict else iso_timestamp_or_null
    kept = raw.filter(is_valid()).withColumn("timestamp", parse(F.col("timestamp")))
    if not strict:
        kept = kept.filter(F.col("timestamp").isNotNull())
    return kept.withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            **{c: number_or_zero(F.col(c)) for c in NUMERIC if c in raw.columns},
            **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in FILL.items() if c in raw.columns},
        }
    )


def malformed_events(raw: DataFrame) -> DataFrame:
    """Rows whose timestamp cannot be read."""
    return raw.filter(F.col("timestamp").isNotNull() & iso_timestamp_or_null(F.col("timestamp")).isNull())


def dedup_events(events: DataFrame) -> DataFrame:
    """Keep the first copy of every event in ingest order."""
    return first_per_key(events, ["event_id"], ["ingest_ord"])


def prepared_events(raw: DataFrame) -> DataFrame:
    """Clean, then de-duplicate: an invalid first copy hides no valid later one."""
    return dedup_events(clean_events(raw))


def new_events(events: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Events whose id is not stored yet; ids are never broadcast, however small their files look."""
    return events.join(stored_ids.select("event_id").hint("merge"), "event_id", "left_anti")


def run_statistics(raw: DataFrame) -> DataFrame:
    """Processed / invalid / duplicate / kept counters and coverage, in one pass."""
    valid = is_valid()
    first = F.struct("session_id", "customer_id", F.to_date(iso_timestamp(F.col("timestamp"))).alias("date"))
    per_id = raw.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(valid).alias("valid"),
        F.min(F.when(valid, F.struct("ingest_ord", first.alias("first")))).alias("kept"),
    )
    return per_id.agg(
        F.sum("seen").alias("processed_events"),
        (F.sum("seen") - F.sum("valid")).alias("invalid_events"),
        (F.sum("valid") - F.count("kept")).alias("duplicate_events"),
        F.count("kept").alias("cleaned_events"),
        F.count_distinct("kept.first.session_id").alias("unique_sessions"),
        F.count_distinct("kept.first.customer_id").alias("unique_customers"),
        F.min("kept.first.date").alias("first_date"),
        F.max("kept.first.date").alias("last_date"),
    )


def typed_events(raw: DataFrame) -> DataFrame:
    """Uncleaned events with a parsed time and nullable whole-number amounts.

    The cart operators work on these: guests and repeated events stay in.
    """
    return raw.withColumns(
        {
            "event_time": iso_timestamp(F.col("timestamp")),
            "quantity": whole_or_null(F.col("quantity")),
            "product_price_vnd": whole_or_null(F.col("product_price_vnd")),
            "line_total_vnd": whole_or_null(F.col("line_total_vnd")),
        }
    )
