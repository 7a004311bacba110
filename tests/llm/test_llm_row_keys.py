"""Missing and repeated ids: every row counts for itself in bounds, targets and results."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from tillstream.llm import blocks, decontaminate, language_id, line_dedup, mixing, quality, substring_dedup, training
from tillstream.llm.oracles import ORACLES
from tillstream.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def _third_without_ids(n=600):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = rng.choice(["ab", "cd", "ef", "gh"], int(rng.integers(1, 30)))
        rows.append((None if i % 3 == 0 else 7 if i % 3 == 1 and i < 200 else i, " ".join(words), "en" if i % 2 else "de", ["a", "b", None][i % 3]))
    return [*rows, *[(None, "same size here", "en", "a")] * 300, (None, None, None, "a"), (7, "", "en", "b")]


DDL = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_third_without_ids(), DDL)


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    taken, target, longest = Counter(), {}, max(r.size for r in rows)
    for r in rows:
        assert r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - t) <= longest for s, t in target.items())
    mixed = mixing.mix(docs)
    size = lambda t: len((t or "").split())
    assert sum(size(r.text) for r in mixed.collect()) == sum(taken.values())
    most = Counter(tuple(r) for r in docs.collect())
    assert all(n <= 2 * most[tuple(r)] for r, n in Counter(mixed.collect()).items())


def test_mix_of_repeated_ids_matches_sql(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = connect(SF_DIR)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert difference(QUERIES["op1_mix_sources"](spark, str(tmp_path)), con, ORACLES["op1_mix_sources"]) is None


def test_samples_are_bounded_by_rows(spark, docs, monkeypatch):
    sizes = []

    def gathered(sample, fit):
        sizes.append(Counter(r.label for r in sample.select("label").collect()))

    monkeypatch.setattr(quality, "fit_in_one_task", gathered)
    monkeypatch.setattr(language_id, "fit_in_one_task", gathered)
    labels = spark.createDataFrame([(7, 1), (None, 0), (None, 1), *[(i, i % 2) for i in range(300, 600)]], "doc_id bigint, quality int")
    quality.train(docs, labels, per_label=20)
    language_id.train(docs, per_label=20)
    assert sizes == [Counter({0: 20, 1: 20}), Counter({"de": 20, "en": 20})]


def test_labels_without_id_label_nothing(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "sample_rows", lambda keys, rows, n: seen.append(Counter((r.id, r.label) for r in keys.collect())) or training.sample_rows(keys, rows, n))
    labels = spark.createDataFrame([(None, 1), (7, 1), (301, 0), (301, 0), (302, 2), (302, None)], "doc_id bigint, quality int")
    quality.train(docs, labels)
    ids = Counter(r[0] for r in _third_without_ids())
    assert seen == [Counter({(7, 1): ids[7], (301, 0): ids[301]})]


def test_every_contaminated_row_is_reported(spark):
    leak = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, leak)], "item_id bigint, text string")
    rows = [(None, leak), (None, "x " + leak), (None, leak + " y"), (3, leak), (3, leak), (None, "clean")]
    got = decontaminate.contamination_report(spark.createDataFrame(rows, "doc_id bigint, text string"), bench)
    assert Counter(r.doc_id for r in got.collect()) == Counter({None: 3, 3: 2})


def _lines():
    shared = ["a line that is held by many", "another line held by many", "short"]
    rows = [(None, f"{shared[i % 2]}\nown line number {i} here\nshort") for i in range(60)]
    rows += [(i, f"own start {i} of text\n{shared[0]}") for i in range(20)] + [(4, "second text of four\n" + shared[1]), (None, None), (30, "")]
    return rows


def test_lines_of_rows_without_id(spark):
    """Rows without id are one document, the last; what each loses is found by its own text."""
    rows = _lines()
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line) >= 10:
                holders.setdefault(line, set()).add(2**63 if i is None else i)
    lost = lambda i, line: len(holders.get(line, ())) > 1 and min(holders[line]) != (2**63 if i is None else i)
    want = Counter((i, "\n".join(x for x in (t or "").split("\n") if not lost(i, x))) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = line_dedup.LineIndex().insert(docs)
    assert Counter((None if r.id == 2**63 - 1 else r.id, r.kept_text) for r in index.clean(docs).collect()) == want
    assert max(len(r["keys"]) for r in index.dropped().collect()) <= 2


def test_line_query_depends_on_its_filters(spark, monkeypatch):
    """A filter that misses keys makes the query's result wrong: later batches go through it."""
    con = connect(SF_DIR)
    query = QUERIES["op3_line_dedup"]
    assert difference(query(spark, SF_DIR), con, ORACLES["op3_line_dedup"]) is None

    def blind(keys, stored):
        return keys.assign(maybe=False)

    monkeypatch.setattr(line_dedup, "_probe", blind)
    assert difference(query(spark, SF_DIR), con, ORACLES["op3_line_dedup"]) is not None


def test_line_filters_grow_with_their_keys(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i} {j} of text" for j in range(5))) for i in range(60)], "doc_id bigint, text string")
    index = line_dedup.LineIndex(keys_per_shard=20).insert(docs.where("doc_id < 2"))
    assert (index.shards, index.keys) == (1, 10)
    grown = index.insert(docs.where("doc_id >= 2"))
    assert (grown.shards, grown.keys) == (16, 300)
    assert grown.filters.count() == 16
    less = grown.delete(docs.where("doc_id >= 30"))
    assert less.keys == 150
    assert less.insert(docs.where("doc_id >= 30")).keys == 300


def test_blocks_of_rows_without_id_are_even(spark):
    rows = [(None if i % 3 else i, f"text number {i} " * 5) for i in range(3000)]
    packed = blocks.Blocks(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", block_bytes=20_000)
    sizes = Counter()
    for row in packed.rows.collect():
        for ids, *_ in packed.reader()([pa.scalar(bytes(row.payload), pa.binary())]):
            sizes[row.block] += len(ids)
    assert sum(sizes.values()) == 3000 and len(sizes) == packed.count
    assert max(sizes.values()) <= 2 * np.median(list(sizes.values()))


def test_repeats_of_rows_without_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(None, f"a{i} b{i} {passage} c{i}") for i in range(40)] + [(5, passage), (5, "x " + passage), (9, "clean text")]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    kept = Counter((r.id, r.kept_text) for r in got)
    want = Counter((2**63 - 1, f"a{i} b{i} c{i}") for i in range(40)) + Counter({(5, passage): 1, (5, "x " + passage): 1, (9, "clean text"): 1})
    assert kept == want


def test_language_and_quality_of_rows_without_id(spark, docs):
    assert language_id.language_report(docs).count() == docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(300, 600)], "doc_id bigint, quality int")
    got = quality.quality_report(docs, labels)
    assert got.count() == docs.count() and got.where(F.col("held_out") & F.col("doc_id").isNull()).count() == 0
