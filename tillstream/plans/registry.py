"""Named metrics over the pipeline's two tables.

A metric is a function ``(events, sessions) -> DataFrame``. Adding one is a call of
:func:`metric`; transformations are ordinary functions for ``DataFrame.transform``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.operators import metrics, sessions as session_ops
from tillstream.plans.shared import Shared

Metric = Callable[[DataFrame, DataFrame], DataFrame]
METRICS: dict[str, Metric] = {}


def metric(name: str):
    def register(fn: Metric) -> Metric:
        METRICS[name] = fn
        return fn

    return register


metric("session_duration_stats")(lambda events, sessions: metrics.session_duration_stats(sessions))
metric("purchase_intent")(lambda events, sessions: metrics.purchase_intent(events))
metric("event_stats")(lambda events, sessions: metrics.event_stats(events))
metric("event_type_distribution")(lambda events, sessions: metrics.distribution(events, "event_type"))
metric("source_distribution")(lambda events, sessions: metrics.distribution(events, "source"))
metric("device_distribution")(lambda events, sessions: metrics.distribution(events, "device"))
metric("journey_length")(lambda events, sessions: metrics.journey_length(events))
metric("journey_patterns")(lambda events, sessions: session_ops.journey_patterns(events))
metric("events_by_date")(lambda events, sessions: metrics.events_by_date(events))
metric("events_by_hour")(lambda events, sessions: metrics.events_by_hour(events))
metric("events_by_day_of_week")(lambda events, sessions: metrics.events_by_weekday(events))
metric("sessions_by_date")(lambda events, sessions: metrics.sessions_by_date(events))

#: The same metrics from the shared aggregates.
SHARED: dict[str, Callable[[Shared], DataFrame]] = {
    "purchase_intent": lambda s: metrics.purchase_intent(None, s.sessions),
    "event_stats": lambda s: metrics.event_stats_of_counts(s.counts("kinds"), s.counts("days"), s.counts("customers"), s.counts("products")),
    "event_type_distribution": lambda s: metrics.distribution(s.counts("kinds"), "event_type", True),
    "source_distribution": lambda s: metrics.distribution(s.counts("kinds"), "source", True),
    "device_distribution": lambda s: metrics.distribution(s.counts("kinds"), "device", True),
    "journey_length": lambda s: metrics.journey_length(None, s.sessions.select(F.col("event_count").alias("n"))),
    "journey_patterns": lambda s: session_ops.journey_patterns(None, pieces=s.pieces),
    "events_by_date": lambda s: metrics.events_by_date(s.counts("hours"), True),
    "events_by_hour": lambda s: metrics.events_by_hour(s.counts("hours"), True),
    "events_by_day_of_week": lambda s: metrics.events_by_weekday(s.counts("hours"), True),
    "sessions_by_date": lambda s: metrics.sessions_by_date(s.counts("days")),
}


def run_metrics(events: DataFrame, sessions: DataFrame, names: list[str] | None = None, shared: Shared | None = None) -> dict[str, DataFrame]:
    """The named metrics, or all. With ``shared`` the standard ones read its aggregates; metrics
    registered by others get the events and sessions."""
    return {
        name: SHARED[name](shared) if shared and name in SHARED else METRICS[name](events, sessions)
        for name in (names or METRICS)
    }
