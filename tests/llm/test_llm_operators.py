"""The operators against brute force and SQL, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pytest
from compare import connect, difference
from pyspark.sql import functions as F

from tillstream.llm import chat_format, decontaminate, exact_dedup, jaccard_join, language_id, line_dedup, mixing, quality, sharding, substring_dedup
from tillstream.llm.components import components
from tillstream.llm.oracles import ORACLES
from tillstream.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ALPHABET = [f"w{i}" for i in range(12)]
DDL = "doc_id bigint, text string, lang string, source string, id string, block int, size string"


def texts():
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(ALPHABET, 60)) for _ in range(8)]
    long = " ".join(f"t{i}" for i in range(3000))
    near = base[0].replace("w1 ", "W1 ", 2) + " more"
    return [None, "", " \t\n", "one", "one two", *base, base[0], base[0], near, base[1] + "\n" + base[2], long, long + " end", "ÉÀ ß 語 " * 9, "shared line here\nown a", "x\n  Shared LINE here \ny"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, ["en", None, "fr"][i % 3], ["b", None, "a"][i % 3], "x", 1, "y") for i, t in enumerate(texts())]
    rows += [rows[5], rows[-1], (None, texts()[6], None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def by_id(rows):
    return {r["id"] if "id" in r else r["doc_id"]: r.asDict() for r in (x for x in rows)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_mix_takes_near_targets(docs, empty):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.taken <= 2 * r.size for r in rows)
    longest = max(r.size for r in rows)
    for target, group in itertools.groupby(sorted(rows, key=lambda r: r.target), key=lambda r: r.target):
        assert abs(sum(r.taken for r in group) - target) <= longest
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text or "")) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_report(empty).count() == mixing.mix(empty).count() == 0


def test_jaccard_components(docs, empty):
    sets = {}
    for i, t in enumerate(texts()):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i * 3] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 90 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_report(docs, words=3, similarity="0.9").collect()}
    assert got.pop(None) == (len(sets[18]), root[18])
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}
    kept = jaccard_join.drop_near_duplicates(docs, words=3, similarity="0.9")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in root.items() if i == r}
    assert jaccard_join.join_report(empty).count() == jaccard_join.drop_near_duplicates(empty).count() == 0


def test_jaccard_keeps_rows_without_own_id_apart(spark):
    def text(name, edit=""):
        return " ".join(f"{name}{i}" for i in range(80)) + edit

    rows = [(5, text("a")), (9, text("b")), (None, text("a", " x")), (None, text("b", " x")), (None, text("c")), (None, text("c", " x")), (None, text("d"))]
    rows += [(7, text("e")), (7, text("f")), (7, text("a", " y")), (8, text("f", " x")), (8, text("g")), (3, text("h")), (3, text("h")), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = {"a": 5, "b": 9, "c": None, "d": None, "e": 7, "f": 7, "g": 8, "h": 3}
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_report(docs).collect()]
    want = [(i, len(t.split()) - 4, first[t[0]]) if t else (i, 0, i) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text) for r in jaccard_join.drop_near_duplicates(docs).collect()]
    assert [r for r in kept if not r[1]] and sum(not r[1] for r in kept) == 2  # nothing is like a text without words
    kept = sorted((t[0], i) for i, t in kept if t)
    assert kept == sorted(first.items())


def test_jaccard_finds_all_links_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    rows, sets = [], {}
    for family in range(6):
        base = [f"f{family}x{i}" for i in range(int(rng.integers(20, 400)))]
        for _ in range(12):
            words = [w if rng.random() > 0.02 else f"r{rng.integers(1 << 30)}" for w in base]
            words = words[: len(words) - int(rng.integers(0, 6))]
            sets[len(rows)] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
            rows.append((len(rows), " ".join(words)))
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.join_report(docs).collect()}
    assert got == root


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[20:], rng.integers(0, 2**63, 15).astype(np.uint64)]))
        x, y = jaccard_join.dense_sketch(a), jaccard_join.dense_sketch(b)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


def brute_lines(rows):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    lost = lambda i, line: len(holders.get(key(line), ())) > 1 and min(holders[key(line)]) != i
    return {i: "\n".join(line for line in (t or "").split("\n") if not lost(i, line)) for i, t in rows}


def test_lines_inserted_and_deleted(spark, empty):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")

    def cleaned(index, some):
        return {r.id: r.kept_text for r in index.clean(some).collect()}

    one = line_dedup.LineIndex(keys_per_shard=2).insert(first)
    both = one.insert(second)
    assert cleaned(both, docs) == brute_lines(rows)
    back = both.delete(second.select("doc_id"))
    assert cleaned(back, first) == cleaned(one, first) == brute_lines([r for r in rows if r[0] % 2 == 0])
    assert cleaned(back.insert(second), docs) == brute_lines(rows)
    assert line_dedup.line_report(empty).count() == 0


def test_line_report_with_nulls(docs):
    rows = [r for r in line_dedup.line_report(docs).collect()]
    assert len(rows) == docs.count()
    assert {r.n_lines for r in rows if r.doc_id == 0} == {1}


def test_cuckoo_filter_never_misses():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    table = line_dedup.CuckooFilter.sized(len(keys))
    assert table.add(keys)
    assert table.has(keys).all()
    table.remove(keys[:2500])
    assert table.has(keys[2500:]).all()
    assert table.has(keys[:2500]).mean() < 0.01


def test_shards_are_balanced_and_contiguous(docs, empty):
    rows = sharding.shard_report(docs, 4).collect()
    assert len(rows) == docs.count()
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(4):
        mine = [r for r in rows if r.shard == s]
        assert abs(sum(r.size for r in mine) - total / 4) <= most
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    whole = sharding.shard(docs, 4)
    assert whole.columns == [*docs.columns, "shard", "slot"]
    assert sorted((r.shard, r.slot) for r in whole.collect()) == sorted((r.shard, r.slot) for r in rows)
    assert sharding.shard_report(empty).count() == sharding.shard(empty).count() == 0


def test_languages(spark, empty):
    rows = QUERIES["op5_language_id"](spark, SF_DIR).alias("p").join(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id")
    assert rows.where("held_out").select(F.avg(F.expr("int(lang = lang_pred)"))).first()[0] > 0.9
    mixed = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, None), (4, " 12 ", "en")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_report(mixed).collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.language_report(empty).count() == 0


def test_chat_round_trip(spark):
    texts = ["a", None, "", "<|im_end|>", "\\<|", "<\\|\\\\n", "é語\n<|im_start|>user\nx"]
    rows = [(c, t, role, text) for c, (t, role, text) in itertools.product(range(3), [(i, ["user", "assistant", None][i % 3], x) for i, x in enumerate(texts)])]
    rows += [(2, 9, "assistant", "only here"), (7, 0, "ro\nle", "z" * 5000), (None, None, None, None), (1, 0, "user", "a")]
    talks = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for size in (64, 100_000):
        packs = chat_format.pack_conversations(talks, max_tokens=size)
        got = {r.id: r for r in chat_format.read_back(packs).collect()}
        for c in (0, 1, 2, 7):
            want = sorted(((t, r, x) for k, t, r, x in rows if k == c), key=lambda v: (v[0], v[1] or "", v[1] is not None, v[2] or ""))
            assert list(zip(got[c].roles, got[c].texts)) == [(r or "", x or "") for _, r, x in want]
            assert got[c].loss_text == "".join(x or "" for _, r, x in want if r == "assistant")
    one = chat_format.pack_conversations(talks.where("conv_id in (0, 2)"), max_tokens=100_000).collect()
    if len(one) == 1:
        assert len(one[0].node_start) == len(texts) + 1  # the shared turns are there once
    assert chat_format.read_back(chat_format.pack_conversations(talks.where("false"))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "\\\\|<|\\n", "<\\|", "a<|b|>\\"])
def test_escape_round_trip(text):
    assert "<|" not in chat_format.escape(text)
    assert chat_format.unescape(chat_format.escape(text)) == text


def test_decontamination(spark, docs, empty):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(int(rng.integers(6, 60))))) for i in range(12)] + [(50, "Two words"), (51, None), (52, "")]
    rows = [(i, f"noise {' '.join(rng.choice(ALPHABET, 3000))} {text or ''} tail") for i, text in items]
    rows += [(100, "half " + items[3][1][: len(items[3][1]) // 3]), (101, None), (102, "two WORDS"), (103, items[4][1].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    pages = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(i, i) for i in range(12)} | {(50, 50), (102, 50), (103, 4)}
    for size in (1_000_000, 40):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(pages, bench, part_shingles=size).collect()}
        assert got == want
    assert {r.doc_id for r in decontaminate.decontaminate(pages, bench).collect()} == {51, 52, 100, 101}
    assert decontaminate.contamination_report(pages, bench.where("false")).count() == 0
    assert decontaminate.decontaminate(empty, bench).count() == 0


def test_decontamination_judges_each_row_by_its_text(spark):
    leak = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, leak), (2, "other item " * 9)], "item_id bigint, text string")
    rows = [(None, "say " + leak), (None, "clean one"), (None, "clean two"), (None, None), (4, leak + " end"), (4, "clean too"), (4, "clean too"), (5, leak)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted((r for r in rows if leak not in (r[1] or "")), key=str)
    for size in (1_000_000, 10):
        got = [tuple(r) for r in decontaminate.decontaminate(docs, bench, part_shingles=size).collect()]
        assert sorted(got, key=str) == want


@pytest.mark.parametrize("fingerprint", [exact_dedup.content_hash, lambda t: F.substring(t, 1, 1).cast("binary")])
@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(docs, keep, fingerprint):
    rows = exact_dedup.duplicate_groups(docs, keep=keep, fingerprint=fingerprint).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(2**63 - 1 if r.doc_id is None else r.doc_id)
    want = sorted((i, {"smallest": min, "largest": max}[keep](g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((r.id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want


def test_exact_dedup_keeps_one_row(docs, empty):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.text or "" for r in docs.collect()})
    assert exact_dedup.dedup_report(empty).count() == exact_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("length", [1, 4, 13])
def test_repeats(docs, empty, length):
    rows = [(i * 3, t) for i, t in enumerate(texts())]
    first, words = {}, {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for j in range(len(w) - length + 1):
            first.setdefault(tuple(w[j : j + length]), i)
    want = {}
    for i, w in words.items():
        gone = {j + k for j in range(len(w) - length + 1) if first[tuple(w[j : j + length])] < i for k in range(length)}
        want[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = {r.id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, length=length).collect()}
    missing = got.pop(2**63 - 1)
    assert missing[0] == missing[1]  # a copy of an earlier text
    assert got == want
    assert substring_dedup.repeats_report(empty).count() == 0


def test_quality(spark, empty):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = QUERIES["op10_quality"](spark, SF_DIR).join(labels, "doc_id")
    assert rows.select(F.avg(F.expr("int(quality = predicted)"))).first()[0] > 0.9
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "doc_id bigint, text string")
    got = quality.quality_report(docs, labels.where("false")).collect()
    assert [r.score for r in got] == [0.5] * 3
    assert quality.quality_report(empty, labels).count() == 0
    assert quality.keep_good(docs, labels.where("false")).count() == 3


def test_attention_gradients():
    model = quality.AttentionModel(quality.WIDTH, hidden=5, gate=3)
    rng = np.random.default_rng(0)
    x, before, truth = rng.random((7, quality.WIDTH)), np.array([0, 3, 4, 7]), np.array([0.0, 1.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-model.forward(x, before)[0]))
        return -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean()

    for name, g in model.gradients(x, before, truth).items():
        at = tuple(0 for _ in g.shape)
        kept = model.p[name].copy()
        model.p[name][at] += 1e-6
        up = loss()
        model.p[name] = kept
        assert abs((up - loss()) / 1e-6 - g[at]) < 1e-4
