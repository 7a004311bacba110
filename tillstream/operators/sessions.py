"""Session metrics and per-event session columns.

A session may hold a large part of all events, so nothing here groups or sorts a
whole session's events in one task. Events are split by (session, time segment)
and, inside a segment, into pieces of bounded length; each piece is reduced to
one row. A segment with very many events is numbered over many tasks (``ranges``). Only those rows meet per session. The journey column is always the whole
text: one value for each session, as long as the session; ``journey_parts`` has the
same in ordered parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.functions import epoch_seconds, seconds_between
from tillstream.operators.ranges import numbered_in_order
from tillstream.operators.ranking import numbered_in_segments

SEGMENT_SECONDS = 3600
PIECE_EVENTS = 10_000

_ORDER = ["timestamp", "ingest_ord"]
_PIECE = ["session_id", "segment", "piece"]


def _segment() -> Column:
    """The hour; events without a time are in a segment of their own, before all others."""
    return F.coalesce(F.floor(epoch_seconds(F.col("timestamp")) / SEGMENT_SECONDS), F.lit(-(1 << 62)))


def _in_segments(events: DataFrame) -> DataFrame:
    """``events`` with their segment and the number of each within it."""
    return numbered_in_order(events.withColumn("segment", _segment()), ["session_id", "segment"], _ORDER, "_local")


def _order_only(events: DataFrame) -> DataFrame:
    return events.select("session_id", *_ORDER, "event_type")


def session_pieces(events: DataFrame, piece_events: int = PIECE_EVENTS) -> DataFrame:
    """One row per (session, segment, piece), all from a single exchange of the events
    (segments of more than ``ranges.HOT_ROWS`` events take one more).

    Everything about sessions follows from these rows. A job that needs several of the
    session tables writes them once and hands them to the functions below.
    """

    def earliest(name: str) -> Column:
        return F.min(F.when(F.col(name).isNotNull(), F.struct(*_ORDER, name))).alias(f"first_{name}")

    firsts = [c for c in ("customer_id", "source", "device") if c in events.columns]
    steps = F.sort_array(F.collect_list(F.struct(*_ORDER, "event_type")))
    pieces = (
        _in_segments(events.select("session_id", *_ORDER, "event_type", *firsts))
        .withColumn("piece", F.floor((F.col("_local") - 1) / piece_events))
        .groupBy(*_PIECE)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("timestamp").alias("first_time"),
            F.max("timestamp").alias("last_time"),
            F.bool_or(F.col("event_type") == "purchase").alias("purchased"),
            steps["event_type"].alias("types"),
            *([F.collect_set("customer_id").alias("customers")] if "customer_id" in firsts else []),
            *[earliest(c) for c in firsts],
        )
    )
    return pieces


def _earlier() -> Column:
    """Events of the session before this piece."""
    before = W.partitionBy("session_id").orderBy("segment", "piece").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(before), F.lit(0))


def _collected_types(*order: str) -> Column:
    return F.collect_list(F.struct(*order, "types"))


def _journey(collected: str, separator: str = ",") -> Column:
    return F.array_join(F.flatten(F.transform(F.sort_array(collected), lambda p: p["types"])), separator)


def _duration() -> Column:
    return seconds_between(F.col("session_start"), F.col("session_end")).alias("session_duration_seconds")


def session_metrics(events: DataFrame | None, pieces: DataFrame | None = None) -> DataFrame:
    """One row per session: span, size, journey and first known customer, source, device."""
    firsts = ("customer_id", "source", "device")
    pieces = session_pieces(events) if pieces is None else pieces
    per_session = pieces.groupBy("session_id").agg(
        F.sum("n").alias("total_events"),
        F.min("first_time").alias("session_start"),
        F.max("last_time").alias("session_end"),
        _collected_types("segment", "piece").alias("parts"),
        F.bool_or("purchased").alias("has_purchase_event"),
        *[F.min(f"first_{c}").alias(f"first_{c}") for c in firsts],
    )
    return per_session.select(
        "session_id",
        "session_start",
        "session_end",
        "total_events",
        _journey("parts").alias("event_journey"),
        *[F.col(f"first_{c}")[c].alias(c) for c in firsts],
        _duration(),
        # always false in the data model; the real signal is the column after it
        F.lit(False).alias("has_purchase"),
        "has_purchase_event",
    )


def _spans(pieces: DataFrame, journey: bool, table: DataFrame | None = None) -> DataFrame:
    """Per (session, segment): number of earlier events, with the session's own columns, out of the
    session table where there is one already."""
    places = pieces.select(*_PIECE, "n").withColumn("earlier", _earlier()).filter("piece = 0").drop("piece", "n")
    names = ["session_id", "session_start", "session_end", "total_events", "session_duration_seconds", *(["event_journey"] if journey else [])]
    if table is not None:
        return places.join(table.select(*names), "session_id")
    whole = pieces.groupBy("session_id").agg(
        F.min("first_time").alias("session_start"),
        F.max("last_time").alias("session_end"),
        F.sum("n").alias("total_events"),
        *([_collected_types("segment", "piece").alias("parts")] if journey else []),
    )
    whole = whole.withColumn("session_duration_seconds", _duration())
    return places.join((whole.withColumn("event_journey", _journey("parts")) if journey else whole).select(*names), "session_id")


def enrich_events(
    events: DataFrame, pieces: DataFrame | None = None, journey: bool = True, table: DataFrame | None = None
) -> DataFrame:
    """Every event with its number in the session and the session's columns.

    The wide rows are exchanged once, on (session, segment); the span rows join
    on the same keys, so a session with a third of the events stays spread out.
    With ``journey`` every row has its session's whole journey, so a session's rows
    grow with the square of its length; without, the session table alone has it.
    ``table`` is the written session table of these pieces: then sessions aren't put together again.
    """
    numbered = _in_segments(events)
    pieces = session_pieces(_order_only(events)) if pieces is None else pieces
    return (
        numbered.join(_spans(pieces, journey, table), ["session_id", "segment"])
        .withColumn("event_sequence_num", F.col("earlier") + F.col("_local"))
        .drop("segment", "_local", "earlier")
    )


def event_sequence(events: DataFrame) -> DataFrame:
    """Only the number of each event within its session."""
    return numbered_in_segments(
        events.select("event_id", "session_id", *_ORDER), ["session_id"], _segment(), _ORDER, "event_sequence_num"
    ).select("event_id", "session_id", "event_sequence_num")


def journey_parts(
    events: DataFrame | None, piece_events: int = PIECE_EVENTS, pieces: DataFrame | None = None
) -> DataFrame:
    """Whole journeys of any length as ordered parts of bounded size.

    Positions come from the pieces' counts alone; the texts join them piece by piece
    and never gather per session.
    """
    pieces = session_pieces(_order_only(events), piece_events) if pieces is None else pieces
    in_order = W.partitionBy("session_id").orderBy("segment", "piece")
    places = pieces.select(
        *_PIECE,
        F.row_number().over(in_order).cast("bigint").alias("part_no"),
        (_earlier() + 1).alias("first_sequence_num"),
    )
    texts = pieces.select(*_PIECE, F.col("n").alias("events"), F.array_join("types", ",").alias("journey_part"))
    return texts.join(places, _PIECE).drop("segment", "piece")


def journey_patterns(events: DataFrame | None, k: int = 20, separator: str = " -> ", pieces: DataFrame | None = None) -> DataFrame:
    """The ``k`` most frequent journeys, compared by their whole text."""
    pieces = session_pieces(_order_only(events)) if pieces is None else pieces
    sessions = pieces.groupBy("session_id").agg(_collected_types("segment", "piece").alias("parts"))
    counts = sessions.groupBy(_journey("parts", separator).alias("journey_pattern")).agg(F.count(F.lit(1)).alias("sessions"))
    return counts.orderBy(F.desc("sessions"), "journey_pattern").limit(k)
