"""Numbers inside keys of any size: hot keys are dealt over many tasks, with the same results."""

from __future__ import annotations

from statistics import median

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.operators import cart, ranges, sessions
from tillstream.operators.ranking import numbered_in_segments

ORDER = ["at", "ord"]


def _rows(spark, n=6000):
    """One key with two thirds of the rows (many at one moment), small ones, and a missing one."""
    key = "case when id % 3 < 2 then 'hot' when id % 51 = 2 then null else concat('k', id % 40) end"
    return spark.range(n).selectExpr(f"{key} as key", "cast(id * 7919 % 17 as int) as at", "id * 104729 % 1000003 as ord", "id as other")


def _expected(rows):
    return rows.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(*ORDER)))


@pytest.mark.parametrize("hot_rows, listed", [(10**9, 10), (500, 10), (60, 2), (1, 0)])
def test_numbers_equal_a_plain_window(spark, hot_rows, listed):
    rows = _rows(spark)
    got = ranges.numbered_in_order(rows, ["key"], ORDER, "n", hot_rows, listed)
    assert got.columns == [*rows.columns, "n"]
    assert sorted(map(str, got.collect())) == sorted(map(str, _expected(rows).collect()))


def test_no_rows(spark):
    assert ranges.numbered_in_order(_rows(spark).limit(0), ["key"], ORDER, "n").count() == 0


def test_one_hot_hour_is_dealt_evenly(spark):
    """A million events of one session in one hour: no range has twice the rows of the median one."""
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        events = spark.range(1_000_000).selectExpr("'bot' as session_id", "cast(id * 7919 % 3600 as int) as at", "id as ord")
        placed = ranges.in_ranges(events, ["session_id", *ORDER])
        sizes = [r["count"] for r in placed.groupBy("_range").count().collect()]
        assert len(sizes) == 16 and sum(sizes) == 1_000_000
        assert max(sizes) <= 2 * median(sizes)
        ends = placed.groupBy("_range").agg(F.min(F.struct(*ORDER)).alias("lo"), F.max(F.struct(*ORDER)).alias("hi"), F.max("_place").alias("last"))
        ends = ends.orderBy("_range").collect()
        assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(ends, ends[1:]))
        numbered = ranges.numbered_in_order(events, ["session_id"], ORDER, "n")
        assert numbered.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()[:] == (1_000_000, 1, 1_000_000)
        plain = events.select("ord", F.row_number().over(W.partitionBy("session_id").orderBy(*ORDER)).alias("want"))
        assert numbered.join(plain, "ord").where("n != want").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture
def bot_events(spark):
    return spark.range(4000).selectExpr(
        "concat('e', id) as event_id", "id * 104729 % 1000003 as ingest_ord", "if(id % 4 = 0, concat('s', id % 12), 'bot') as session_id",
        "id % 5 as customer_id", "'web' as source", "'desktop' as device",
        "timestamp_ntz '2025-01-01' + make_dt_interval(0, 0, 0, id * 7919 % 7000) as timestamp",
        "element_at(array('scroll', 'search', 'add_to_cart', 'remove_from_cart', 'update_quantity'), cast(id * 31 % 5 as int) + 1) as event_type",
        "id % 3 as product_id", "concat('p', id) as product_name", "id as product_price_vnd", "id % 4 as quantity",
    )


@pytest.mark.parametrize("hot_rows", [50, 900])
def test_sessions_and_carts_of_hot_keys(spark, bot_events, monkeypatch, hot_rows):
    moves = bot_events.withColumnRenamed("timestamp", "event_time")

    def results():
        return [
            sorted(map(str, df.collect()))
            for df in (
                sessions.session_metrics(bot_events),
                sessions.enrich_events(bot_events),
                sessions.event_sequence(bot_events),
                sessions.journey_parts(bot_events, 100),
                cart.cart_items(moves, 70),
                numbered_in_segments(bot_events, ["session_id"], F.lit(1), ["timestamp", "ingest_ord"], "n"),
            )
        ]

    want = results()
    monkeypatch.setattr(ranges, "HOT_ROWS", hot_rows)
    assert results() == want


def test_enrichment_without_journeys(bot_events):
    slim = sessions.enrich_events(bot_events, journey=False)
    full = sessions.enrich_events(bot_events)
    assert set(full.columns) - set(slim.columns) == {"event_journey"}
    assert sorted(map(str, slim.collect())) == sorted(map(str, full.drop("event_journey").collect()))
