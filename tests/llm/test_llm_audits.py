"""Toxicity, source audit and whitening against brute force, on small tables with awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillstream.llm import source_audit, toxicity, whitening
from tillstream.llm import words as tw
from tillstream.llm.queries import QUERIES

DDL = "doc_id bigint, text string, lang string, source string, n bigint, slice string, value double"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


# --- source audit


def audit_rows():
    rng = np.random.default_rng(5)
    spelt = ["the", "The", "cat", "éa", "É", "語", "zz", "a-b", "x1y", *[f"w{c}" for c in "abcdefgh"]]
    rows = [(i, " ".join(rng.choice(spelt, int(rng.integers(0, 25)))), ["en", "de", None, ""][i % 4], ["s1", "s2", None, "s3", "é"][i % 5], i, "x", 0.5) for i in range(90)]
    rows += [(None, None, None, None, None, None, None), (1, "", "en", "only empty", 1, "", 1.0), (2, "9 _ 9", "xx", "s1", 1, "", 1.0), (3, "once", "xx", "s2", 1, "", 1.0)]
    return [*rows, rows[3], rows[3], (4, "cat " * 300, "en", "s1", 1, "", 1.0)]


def expected_audit(rows, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        terms = [lowered(t) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    found = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        own = [s for g, s in groups if g == lang]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in own}
        whole = {t: sum(n[s][t] for s in own) for t in kept}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p, q = {s: shares(n[s]) for s in own}, shares(whole)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(listed)]
    return sorted(found)


@pytest.mark.parametrize("block, slice_rows, fan, top", [(256, 100_000, 32, 200), (2, 7, 2, 3)])
def test_audit_matches_brute_force(spark, monkeypatch, block, slice_rows, fan, top):
    monkeypatch.setattr(source_audit, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(source_audit, "FAN", fan)
    pairs = source_audit.Audit.pair_divergence
    monkeypatch.setattr(source_audit.Audit, "pair_divergence", lambda self: pairs(self, block))
    rows = audit_rows()
    got = source_audit.audit_report(spark.createDataFrame(rows, DDL), top=top)
    assert sorted(map(tuple, got.collect())) == expected_audit(rows, top)


def test_audit_of_nothing(spark):
    assert source_audit.audit_report(spark.createDataFrame([], DDL)).count() == 0
    alone = spark.createDataFrame([(1, "a b", "en", "s", 1, "", 1.0)], DDL)
    assert source_audit.audit_report(alone).count() == 0


def test_long_text_is_counted_whole(monkeypatch):
    text = "Ab é語 cd9 " * 400 + "z" * 3000
    found = lambda: {(int(r), t.as_py(), int(n)) for row, term, count in source_audit._terms(pa.array(["x", text, "y"])) for r, t, n in zip(row, term, count)}
    whole = found()
    monkeypatch.setattr(tw, "RUN_BYTES", 256)
    pieces = found()
    assert whole == pieces == {(0, "x", 1), (2, "y", 1), (1, "ab", 400), (1, "é語", 400), (1, "cd", 400), (1, "z" * 3000, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), max_size=60), st.integers(1, 4), st.sampled_from([1, 3, 512]))
def test_skyband_keeps_what_fewer_than_k_dominate(pairs, k, block):
    n, lang_n = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    names = [f"t{(i * 37) % 61:02d}" for i in range(len(pairs))]
    want = {
        i
        for i in range(len(pairs))
        if sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and names[j] < names[i] for j in range(len(pairs))) < k
    }
    assert set(source_audit.skyband(n, lang_n, pa.array(names, pa.string()), k, block).tolist()) == want


@given(st.integers(0, 10**12), st.integers(1, 9 * 10**15))
def test_shares_are_exact(count, total):
    count = min(count, total - 1)
    assert int(source_audit.share(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


# --- whitening

VECTORS = "vec_id bigint, embedding array<double>, label int, y string, i int, value double"


def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, [1, 0.3, 2, 0.01], 4).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(150)]  # copies count once
    rows += [(700, None), (701, [1.0, None, 2.0, 3.0]), (702, [float("nan")] * 4), (703, [float("inf"), 0.0, 0.0, 0.0]), (704, [1.0]), (705, []), (None, rows[1][1]), (5, rows[2][1])]
    return [(i, v, 0, "y", 1, 0.5) for i, v in rows]


def expected_whitening(rows):
    kept = [(i, [int(np.floor(64 * c)) + 10**6 for c in v]) for i, v, *_ in rows if v and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), 4
    sums = [sum(x[j] for x in fit) for j in range(d)]
    cov = np.array([[float(sum((Fraction(x[a]) - Fraction(sums[a], n)) * (Fraction(x[b]) - Fraction(sums[b], n)) for x in fit) / n) for b in range(d)] for a in range(d)])
    value, vector = np.linalg.eigh(cov)
    out = []
    for i, x in kept:
        off = np.array([float(Fraction(x[j]) - Fraction(sums[j], n)) for j in range(d)])
        for c in range(d):
            out.append((i, c + 1, n, sum((n * x[j] - sums[j]) ** 2 for j in range(d)), abs(off @ vector[:, -1 - c]) / np.sqrt(value[-1 - c]), value[-1 - c] / np.trace(cov)))
    return out


def test_whitening_matches_brute_force(spark):
    rows = vector_rows()
    got = whitening.whitening_report(spark.createDataFrame(rows, VECTORS)).collect()
    want = expected_whitening(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4]
        assert abs(abs(g[4]) - w[4]) < 1e-9 and abs(g[5] / w[5] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for r in got:  # one sign for all rows of a component
        signs.setdefault((r.component, round(abs(r.whitened), 9)), set()).add(r.whitened > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_directions(spark):
    def report(rows):
        return whitening.whitening_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()

    assert report([]) == report([(1, None)]) == report([(1, [])]) == report([(1, [1.0, 2.0])] * 3) == []
    line = report([(i, [float(i), 5.0, -float(i)]) for i in range(5)])
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12


def test_whitening_of_huge_entries(spark):
    rows = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.5, 3.0])]
    got = whitening.whitening_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r.deviation is None for r in got if r.vec_id < 2)
    assert all(np.isfinite(r.whitened) for r in got)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3).flatmap(lambda d: st.lists(st.lists(st.integers(-(2**62), 2**62) | st.integers(-50, 50), min_size=d, max_size=d), min_size=1, max_size=70)))
def test_cross_products_are_exact(rows):
    sums, cross = whitening.cross_products(np.array(rows, np.int64))
    d = len(rows[0])
    assert [int(v) for v in sums] == [sum(r[i] for r in rows) for i in range(d)]
    assert [[int(v) for v in row] for row in cross] == [[sum(r[i] * r[j] for r in rows) for j in range(d)] for i in range(d)]


# --- toxicity


def ngrams(text):
    points = [c.lower() if len(c.lower()) == 1 else c for c in text or ""]
    return {(n, "".join(points[i : i + n])) for n in toxicity.GRAMS for i in range(len(points) - n + 1)}


def test_features_are_the_distinct_ngrams(monkeypatch):
    texts = [None, "", "ab", "Abc abc", "é語 é語x", "idiot " * 50, "no " + "xyz語" * 300]
    bags = list(toxicity.presence(pa.array(texts)))
    assert [len(b) for b in bags] == [len(ngrams(t)) for t in texts]
    names = {}
    for text, bag in zip(texts, bags):  # the same n-gram is the same feature in every text
        for gram in ngrams(text):
            single = next(iter(toxicity.presence(pa.array([gram[1]]))))
            names.setdefault(gram, single[np.isin(single, bag)])
            assert len(names[gram])
    monkeypatch.setattr(tw, "RUN_BYTES", 64)  # all but the shortest in windows
    for a, b in zip(bags, toxicity.presence(pa.array(texts))):
        assert a.tolist() == b.tolist()


def toxic_rows():
    rng = np.random.default_rng(2)
    calm = ["river", "stone", "walks", "under", "grass", "light", "house", "paper"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        said = list(rng.choice(calm, 30))
        if bad:
            said[int(rng.integers(30))] = ["nitwit", "dimwit"][i % 8 // 4]
        rows.append((i, " ".join(said), "en", None, 1, "label", 0.5))
        labels.append((i, int(bad), "text"))
    return rows, labels


LABELS = "doc_id bigint, toxic int, text string"


def test_toxicity_finds_marked_words_and_little_else(spark):
    rows, labels = toxic_rows()
    # rows without id, repeated ids of other text, labels without id and of both kinds
    rows += [(None, "grass light paper", None, None, None, None, None)] * 130 + [(7002, "under paper stone nitwit walks", None, None, None, None, None), (7002, "under paper stone walks", None, None, None, None, None), (7000, None, "", "", 0, "", 0.0), (7001, "", "", "", 0, "", 0.0)]
    labels += [(None, 1, "x"), (3, 1, "x"), (7001, 2, "x"), (None, None, None)]
    docs, marks = spark.createDataFrame(rows, DDL), spark.createDataFrame(labels, LABELS)
    got = toxicity.toxicity_report(docs, marks).collect()
    assert len(got) == len(rows)
    assert sum(r.doc_id is None for r in got) == 130 and not any(r.predicted for r in got if r.doc_id is None)
    truth = {r[0]: "wit" in (r[1] or "") for r in rows if r[0] not in (None, 7002)}
    assert {r.doc_id: bool(r.predicted) for r in got if r.doc_id in truth} == truth
    assert sorted(r.predicted for r in got if r.doc_id == 7002) == [0, 1]
    assert all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id for r in docs.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    assert {r.doc_id for r in got if r.held_out} == held


def test_labelled_rows_and_counts(spark):
    rows, labels = toxic_rows()
    rows += [(2, "second text of two", None, None, None, None, None), (None, "no id", None, None, None, None, None)]
    labels += [(0, 0, "both kinds"), (None, 1, "no id"), (5, 0, "again")]
    found = toxicity.labelled_rows(spark.createDataFrame(rows, DDL), spark.createDataFrame(labels, LABELS), "doc_id", "text", "toxic")
    truth = dict((i, t) for i, t, _ in labels[:400])
    want = Counter((r[1], truth[r[0]]) for r in rows if r[0] not in (None, 0))
    assert Counter((r.text, r.label) for r in found.collect()) == want
    counts, total = toxicity.label_counts(found)
    assert total.tolist() == [sum(c for (_, l), c in want.items() if l == x) for x in (0, 1)]
    plain = np.zeros((2, 1 << toxicity.BITS), int)
    for (text, label), c in want.items():
        plain[label][next(iter(toxicity.presence(pa.array([text]))))] += c
    assert (plain == counts).all()
    ratios = toxicity.log_count_ratios(counts)
    at = int(np.flatnonzero(counts.sum(0) >= toxicity.LEAST_ROWS)[0])
    p, q = (counts[1] + 1) / (counts[1] + 1).sum(), (counts[0] + 1) / (counts[0] + 1).sum()
    assert abs(ratios[at] - np.log(p[at] / q[at])) < 1e-12 and not ratios[counts.sum(0) < toxicity.LEAST_ROWS].any()


def test_fit_is_bounded(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(toxicity, "fit_in_one_task", lambda sample, fit: sizes.append(sample.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("features") / 4).alias("f")).collect()) or toxicity.pickle.dumps(1.0))
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([r for r in rows for _ in range(3)], DDL)  # ids repeat
    for bounds in ({"per_label": 40}, {"fit_features": 4000}):
        toxicity.train(docs, spark.createDataFrame(labels, LABELS), **bounds)
    assert all(r.n == 40 for r in sizes[0])
    assert all(0 < r.f <= 2000 for r in sizes[1])


def test_toxicity_gradient():
    rng = np.random.default_rng(1)
    model = toxicity.RidgeLogistic(rng.normal(size=9), penalty=0.1)
    feature, before, truth = rng.integers(0, 9, 20), np.array([0, 4, 4, 11, 20]), np.array([0.0, 1.0, 1.0, 0.0])
    w = rng.normal(size=10)
    value, g = model.loss(w, feature, before, truth)
    for k in range(10):
        w2 = w.copy()
        w2[k] += 1e-6
        assert abs((model.loss(w2, feature, before, truth)[0] - value) / 1e-6 - g[k]) < 1e-4
    best = model.fit(feature, before, truth)
    assert np.abs(model.loss(best, feature, before, truth)[1]).max() < 1e-2


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 1, "", 0.0), (2, "abc", "en", "s", 1, "", 0.0)], DDL)
    for labels, want in (([], 0.0), ([(2, 0, "")], 0.0), ([(2, 1, "")], 1.0)):
        got = toxicity.toxicity_report(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert [r.score for r in got] == [want] * 2 and [r.predicted for r in got] == [int(want)] * 2
    assert toxicity.toxicity_report(docs.where("false"), spark.createDataFrame([], LABELS)).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op11_toxicity"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    assert rows.where("held_out").select(F.avg(F.expr("int(toxic = predicted)"))).first()[0] > 0.9
