"""Aggregate metrics over cleaned events and session rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.functions import count_map, ratio, weekday_name
from tillstream.operators.ranking import exact_median, one_row, top_k


def _rows(name: str, counted: bool = False):
    """Number of rows; ``counted`` rows stand for ``n`` each."""
    return (F.sum("n") if counted else F.count(F.lit(1))).alias(name)


def daily_summary(events: DataFrame) -> DataFrame:
    """Per date: events, distinct sessions and customers, event type -> count."""
    totals = events.groupBy("date").agg(
        F.count("event_id").alias("total_events"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("customer_id").alias("unique_customers"),
    )
    by_type = events.groupBy("date", "event_type").agg(_rows("n"))
    maps = by_type.groupBy("date").agg(count_map("event_type", "n").alias("event_type_distribution"))
    return totals.join(maps, "date", "left")


def session_duration_stats(sessions: DataFrame) -> DataFrame:
    """Mean, median, min, max, sample deviation of session length; one row."""
    d = F.col("session_duration_seconds")
    plain = sessions.agg(
        F.avg(d).alias("average_duration_seconds"),
        F.min(d).alias("min_duration_seconds"),
        F.max(d).alias("max_duration_seconds"),
        F.stddev_samp(d).alias("std_duration_seconds"),
        _rows("total_sessions"),
    )
    median = exact_median(sessions, "session_duration_seconds", 60.0).withColumnRenamed(
        "session_duration_seconds", "median_duration_seconds"
    )
    return one_row(plain, median).withColumns(
        {
            "average_duration_minutes": F.col("average_duration_seconds") / 60,
            "median_duration_minutes": F.col("median_duration_seconds") / 60,
        }
    )


def purchase_intent_sessions(events: DataFrame) -> DataFrame:
    """Per session: size and whether it has several events and ends by adding to the cart.

    Ending with an add implies that the session contains one.
    """
    adds = F.col("event_type") == "add_to_cart"
    return events.groupBy("session_id").agg(
        F.count("event_id").alias("event_count"),
        F.max(F.struct("timestamp", "ingest_ord", adds.alias("adds"))).alias("last"),
    ).select(
        "session_id",
        "event_count",
        ((F.col("event_count") >= 2) & F.col("last.adds")).alias("has_purchase_intent"),
    )


def purchase_intent(events: DataFrame | None, per_session: DataFrame | None = None) -> DataFrame:
    return (purchase_intent_sessions(events) if per_session is None else per_session).agg(
        _rows("total_sessions"),
        F.count_if("has_purchase_intent").alias("sessions_with_purchase_intent"),
    ).withColumn(
        "purchase_intent_rate",
        ratio(F.col("sessions_with_purchase_intent") * F.lit(100.0), F.col("total_sessions")),
    )


def event_stats(events: DataFrame) -> DataFrame:
    return events.agg(
        _rows("total_events"),
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("product_id").alias("unique_products"),
    ).withColumn("average_events_per_session", F.try_divide("total_events", "unique_sessions"))


def event_stats_of_counts(kinds: DataFrame, days: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """The same from counts by kind, by day and session, by customer and by product."""
    return one_row(
        kinds.agg(_rows("total_events", True)),
        days.agg(F.count_distinct("session_id").alias("unique_sessions")),
        customers.agg(F.count("customer_id").alias("unique_customers")),
        products.agg(F.count("product_id").alias("unique_products")),
    ).withColumn("average_events_per_session", F.try_divide("total_events", "unique_sessions"))


def distribution(events: DataFrame, column: str, counted: bool = False) -> DataFrame:
    """Counts per value with the share of all events; missing values are left out of the list only."""
    counts = events.groupBy(column).agg(_rows("events", counted))
    share = F.col("events") * F.lit(100.0) / F.sum("events").over(W.partitionBy())
    return counts.withColumn("percentage", share).filter(F.col(column).isNotNull())


def journey_length(events: DataFrame | None, sizes: DataFrame | None = None) -> DataFrame:
    """Over the events' sessions, or the ``n`` of one row for each session."""
    sizes = events.groupBy("session_id").agg(_rows("n")) if sizes is None else sizes
    return sizes.agg(
        F.avg("n").alias("average_journey_length"),
        F.max("n").alias("max_journey_length"),
        F.min("n").alias("min_journey_length"),
    )


def events_by_date(events: DataFrame, counted: bool = False) -> DataFrame:
    return events.groupBy("date").agg(_rows("events", counted))


def events_by_hour(events: DataFrame, counted: bool = False) -> DataFrame:
    return events.groupBy("hour").agg(_rows("events", counted))


def events_by_weekday(events: DataFrame, counted: bool = False) -> DataFrame:
    return events.groupBy(weekday_name(F.col("date")).alias("day_of_week")).agg(_rows("events", counted))


def sessions_by_date(events: DataFrame) -> DataFrame:
    return events.groupBy("date").agg(F.count_distinct("session_id").alias("sessions"))


def conversion_by_source(events: DataFrame) -> DataFrame:
    return events.filter("source is not null").groupBy("source").agg(
        F.count_distinct("session_id").alias("unique_sessions"),
        F.count_if(F.col("event_type") == "add_to_cart").alias("add_to_cart_events"),
    )


def longest_sessions(sessions: DataFrame, k: int = 10) -> DataFrame:
    return top_k(sessions, "session_duration_seconds", k, ["session_id"])
