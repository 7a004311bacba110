"""The store of seen ids: exact, and read only where its filters point."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tillstream.streaming.idstore import IdStore


def _ids(spark, lo, hi):
    return spark.range(lo, hi).select(F.concat(F.lit("e"), "id").alias("id"))


def _bytes(paths):
    return sum(os.path.getsize(p.removeprefix("file://").removeprefix("file:")) for p in paths)


@pytest.mark.parametrize("buckets, bits", [(8, 1 << 16), (1, 64)])
def test_seen_ids_are_exact(spark, tmp_path, buckets, bits):
    store, known = IdStore(spark, str(tmp_path / "ids"), buckets, bits), set()
    for batch, (lo, hi) in enumerate([(0, 0), (0, 300), (200, 500), (1000, 1200), (0, 1500)]):
        ids = _ids(spark, lo, hi)
        want = {r.id for r in ids.collect()}
        seen = {r.id for r in store.seen(ids, batch).collect()}
        assert seen == want & known
        fresh = ids.where(~F.col("id").isin(list(seen))) if seen else ids
        store.add(fresh, batch)
        known |= want
    assert {r.id for r in store.stored(99).collect()} == known
    # a replay of a batch asks as of the one before it, and its ids are stored once
    assert {r.id for r in store.seen(_ids(spark, 200, 500), 2).collect()} == {f"e{i}" for i in range(200, 300)}
    store.add(_ids(spark, 300, 500), 2)
    assert store.stored(99).count() == len(known)


def test_a_batch_reads_the_same_however_many_came_before(spark, tmp_path):
    """New ids, and some of the last batch again: the filters, and a bucket for each of those."""
    store = IdStore(spark, str(tmp_path / "ids"), buckets=64, bits=1 << 20)
    filters, buckets = [], []
    for batch in range(10):
        ids = _ids(spark, batch * 500, batch * 500 + 500)
        again = _ids(spark, max(0, batch * 500 - 2), batch * 500)
        likely = store.likely(ids.unionByName(again), batch).collect()
        assert {r.id for r in again.collect()} <= {r.id for r in likely}
        buckets.append(len({r.bucket for r in likely}))
        named = sorted({r.bucket for r in likely})
        if named:
            read = store.stored(batch, named)
            assert "PartitionFilters" in read._jdf.queryExecution().explainString(read._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            assert {r.bucket for r in read.select("bucket").distinct().collect()} <= set(named)
        if batch:
            filters.append(_bytes(store._filters(batch)[0].inputFiles()))
        store.add(ids, batch)
    assert max(buckets) <= 4  # two repeated ids, and hardly a false hit
    assert max(filters) < 3 * (1 << 20) // 8  # bounded by their bits, not by ids


def _plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_stored_ids_are_exchanged_not_broadcast(spark, tmp_path):
    """Their files are small beside their rows; a broadcast of them is built in the driver's memory."""
    store = IdStore(spark, str(tmp_path / "ids"), buckets=4, bits=1 << 12)
    store.add(_ids(spark, 0, 500), 0)
    for asked in (store.likely(_ids(spark, 400, 600), 1), store.seen(_ids(spark, 400, 600), 1)):
        asked.collect()
        assert "SortMergeJoin" in _plan(asked) and "Broadcast" not in _plan(asked)
