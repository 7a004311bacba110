"""Deep pages read the ranges they touch; converted batches are folders."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from tillstream.operators import pages
from tillstream.sources import readers

ORDER = [("day", False), ("ord", True)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = spark.range(5000).selectExpr("id * 7919 % 40 as day", "id * 104729 % 1000003 as ord", "id % 3 as kind")
    path = str(tmp_path_factory.mktemp("pages"))
    pages.write_pages(rows, ORDER, path, 20)
    plain = sorted(((r.day, r.ord, r.kind) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    return path, plain


@pytest.mark.parametrize("offset, limit", [(0, 10), (250, 1), (4321, 100), (4990, 50), (5000, 10), (0, 5000)])
def test_pages_by_offset(spark, stored, offset, limit):
    path, plain = stored
    got = pages.read_page(spark, path, ORDER, limit, offset)
    assert [(r.day, r.ord, r.kind) for r in got.collect()] == plain[offset : offset + limit]


def test_a_page_reads_its_range_only(spark, stored):
    path, _ = stored
    page = pages.read_page(spark, path, ORDER, 10, 4500)
    explained = page._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[.*_range", explained)
    assert page.count() == 10


def test_cursor_and_filter(spark, stored):
    path, plain = stored
    for at in (0, 17, 2500, 4999):
        cursor = {"day": plain[at][0], "ord": plain[at][1]}
        got = pages.read_page(spark, path, ORDER, 25, after=cursor)
        assert [(r.day, r.ord, r.kind) for r in got.collect()] == plain[at + 1 : at + 26]
        some = pages.read_page(spark, path, ORDER, 25, after=cursor, where=F.col("kind") == 1)
        assert [(r.day, r.ord, r.kind) for r in some.collect()] == [r for r in plain[at + 1 :] if r[2] == 1][:25]
    first = pages.read_page(spark, path, ORDER, 5, where=F.col("kind") == 2)
    assert [(r.day, r.ord, r.kind) for r in first.collect()] == [r for r in plain if r[2] == 2][:5]
    with pytest.raises(ValueError):
        pages.read_page(spark, path, ORDER, 5, 10, where=F.col("kind") == 2)


def test_converted_batches_are_folders(spark, tmp_path):
    for n in range(3):
        rows = [{"id": n * 10 + i, "full_name": f"N{i}", "city": None if i else "H\"é"} for i in range(4)]
        (tmp_path / f"customers_batch_{n}.json").write_text(json.dumps(rows))
    out = str(tmp_path / "out")
    readers.convert_batched(spark, "customers", str(tmp_path), out)
    assert {r.id for r in readers.read_converted(spark, out).collect()} == {n * 10 + i for n in range(3) for i in range(4)}
    one = readers.read_converted(spark, out, 2)
    assert sorted(r.id for r in one.collect()) == [20, 21, 22, 23]
    explained = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(batch" in explained
    assert one.where("city is not null").first().city == 'H"é'


def test_one_converted_batch_lists_its_folder_only(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.range(40).selectExpr("id", "if(id < 4, null, id div 4) as batch").write.partitionBy("batch").parquet(out)
    one = readers.read_converted(spark, out, 2)
    assert {f.rsplit("/", 2)[1] for f in one.inputFiles()} == {"batch=2"}
    assert {(r.id, r.batch) for r in one.collect()} == {(i, 2) for i in range(8, 12)}
    assert one.schema == readers.read_converted(spark, out).schema
    assert readers.read_converted(spark, out, 77).count() == 0
    assert readers.read_converted(spark, out).count() == 40


def test_many_folders_are_listed_by_fewer_tasks(spark, tmp_path):
    folder, context = str(tmp_path / "in"), spark.sparkContext
    for n in range(250):
        (tmp_path / "in" / f"name=customers_batch_{n}.json").mkdir(parents=True)
        (tmp_path / "in" / f"name=customers_batch_{n}.json" / "part.txt").write_text(json.dumps([{"id": n}]))
    try:
        context.setJobGroup("listing", "listing")
        rows = readers.read_batched(spark, "customers", folder)
        tracker = context.statusTracker()
        stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
        tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    finally:
        context._jsc.clearJobGroup()
    assert max(tasks, default=0) <= 200
    assert rows.where("id = batch").count() == 250
