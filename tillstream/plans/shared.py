"""What the standard metrics share: one aggregate of the events, one of the sessions' pieces."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.operators.sessions import session_pieces
from tillstream.session import materialise

#: Each set is counted in the one pass; the metrics sum up what they need of it.
SETS = {
    "kinds": ["event_type", "source", "device"],
    "hours": ["date", "hour"],
    "days": ["date", "session_id"],
    "customers": ["customer_id"],
    "products": ["product_id"],
}


class Shared:
    """Counts of the events by all sets of ``SETS``, and the sizes and last steps of sessions.

    Both are written once when first asked for. With the pieces of a finished run the events are
    read once; without, the pieces are made from them first.
    """

    def __init__(self, events: DataFrame, pieces: DataFrame | None = None):
        self.events, self._pieces = events, pieces

    @cached_property
    def _counts(self) -> DataFrame:
        columns = list(dict.fromkeys(c for s in SETS.values() for c in s))
        sets = self.events.groupingSets([[F.col(c) for c in s] for s in SETS.values()], *columns)
        counted = sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
        # grouping_id has one bit per column, set where the column isn't in the set
        bits = {name: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s) for name, s in SETS.items()}
        name = F.create_map(*[F.lit(x) for pair in bits.items() for x in reversed(pair)])
        return materialise(counted.withColumn("set", name[F.col("gid").cast("int")]).drop("gid"), "event-counts")

    def counts(self, name: str) -> DataFrame:
        """The columns of the set, and n."""
        return self._counts.where(F.col("set") == name).select(*SETS[name], "n")

    @cached_property
    def pieces(self) -> DataFrame:
        return materialise(session_pieces(self.events), "pieces") if self._pieces is None else self._pieces

    @cached_property
    def sessions(self) -> DataFrame:
        """session_id, event_count, has_purchase_intent."""
        last = F.max(F.struct("segment", "piece", F.element_at("types", -1).alias("kind")))["kind"]
        per_session = self.pieces.groupBy("session_id").agg(F.sum("n").alias("event_count"), last.alias("last"))
        intent = (F.col("event_count") >= 2) & (F.col("last") == "add_to_cart")
        return materialise(per_session.select("session_id", "event_count", intent.alias("has_purchase_intent")), "session-sizes")
