"""Divergence of sources: which words a source of a language uses more than the others do.

Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in at
least ``LEAST_DOCS`` of its documents. A group is a language and a source; it gives each kept term the
smoothed share ``share`` in parts of a billion, and the difference from another share q counts
floor((p - q)^2 / q). Two questions are answered, in whole numbers only: how far each source lies from
every other of its language (``pair_divergence``), and which terms set a source apart from its language
(``leading_terms``).

Leading terms come from a dominance skyband. A term with a higher count in the group, a lower count in
the language and an earlier spelling ranks before another whatever the totals are, so a term that
``k`` others dominate is not among the ``k`` first. Every partition keeps the terms dominated by fewer
than ``k`` of its own, partitions are merged by the same rule, and the few terms left are ranked exactly.

Pairs of sources are summed over the terms that occur in slices of the vocabulary; all other terms add
the same amount each. Where a language has more than ``BLOCK`` sources, pairs of blocks of sources are
summed apart, so a task never holds more than sums for twice ``BLOCK`` sources.

Null text, language and source count as empty. Repeated rows are documents of their own. A group without
terms has the smallest share of every kept term. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.llm import words as tw
from tillstream.session import materialise

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Sources whose pairs are summed together.
BLOCK = 256
#: (text, term) pairs of a task put together before they are sent on.
HELD = 4_000_000
#: Rows of (language, source, term) in a slice of the vocabulary.
SLICE_ROWS = 100_000
#: Partitions whose skybands are merged at a time.
FAN = 32

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[128:] = np.arange(128, 256)
_CLEAN[97:123] = _CLEAN[65:91] = np.arange(97, 123)


def _row_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, term, occurrences) of a run of texts, each row's terms once."""
    clean = _CLEAN[data]
    starts, ends, before = tw.word_spans(clean, offsets)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spelt = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(clean[clean != 32]))
    coded = spelt.dictionary_encode()
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    size = max(1, len(coded.dictionary))
    keys, n = np.unique(rows * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return keys // size, coded.dictionary.take(pa.array(keys % size)), n


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in pieces that end between terms."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + tw.RUN_BYTES)
        while hi < len(data) and _CLEAN[data[hi]] != 32:
            hi += 1
        yield data[lo:hi]
        lo = hi


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(row, term, occurrences) of a column of texts, each row's terms once."""
    for lo, _, data, offsets in tw.text_runs(column):
        if len(data) <= tw.RUN_BYTES:
            row, term, n = _row_terms(data, offsets)
            yield row + lo, term, n
        else:  # one text
            parts = [_row_terms(part, np.array([0, len(part)])) for part in _pieces(data)]
            _, term, n, _ = _summed(np.concatenate([p[0] for p in parts]), [p[1] for p in parts], np.concatenate([p[2] for p in parts]))
            yield np.full(len(n), lo), term, n


def _summed(of: np.ndarray, terms: list[pa.Array], n: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(of, term, sum of n, rows) for each pair of ``of`` and term."""
    coded = pa.chunked_array(terms, pa.large_string()).combine_chunks().dictionary_encode()
    width = max(1, len(coded.dictionary))
    keys = of * width + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat(n[order], first) if len(keys) else n
    keys = keys[first]
    return keys // width, coded.dictionary.take(pa.array(keys % width)), sums, np.diff(np.append(first, len(order)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it), counted before they are exchanged.

    Dealt by language and term alone, so what follows can count a term over its language's sources.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
            width = max(1, len(source.dictionary))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width + source.indices.to_numpy(zero_copy_only=False)
            held, size = [], 0
            for found in chain(_terms(batch["text"]), [None]):
                if found:
                    held.append(found)
                    size += len(found[0])
                if held and (found is None or size > HELD):
                    rows, terms, n = zip(*held)
                    of, term, sums, docs = _summed(group[np.concatenate(rows)], list(terms), np.concatenate(n))
                    held, size = [], 0
                    arrays = [lang.dictionary.take(pa.array(of // width)), source.dictionary.take(pa.array(of % width)), term.cast(pa.string()), pa.array(sums), pa.array(docs)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    found = docs.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals under 9e15: long division by thousands."""
    rest, found = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


def _share(count: str, total: str) -> Column:
    """The same as a column; 1 where the total is 0."""
    return F.expr(f"1 + coalesce(cast({count} + 1 as decimal(20, 0)) * {SCALE} div nullif(cast({total} as decimal(20, 0)), 0), 0)")


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def skyband(n: np.ndarray, lang_n: np.ndarray, term: pa.Array, k: int, block: int = 512) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate.

    Of a term's dominators, those kept are enough to count: the first ``k`` of them in the order used
    here have fewer than ``k`` dominators themselves.
    """
    spelling = np.empty(len(n), np.int32)
    spelling[pc.sort_indices(term).to_numpy()] = np.arange(len(n))
    lang_n = np.unique(lang_n, return_inverse=True)[1].astype(np.int32)  # only their order matters
    order = np.lexsort((spelling, lang_n, -n))
    # Of terms with equal counts only the k first spellings can stay.
    new = np.ones(len(order), bool)
    new[1:] = (n[order][1:] != n[order][:-1]) | (lang_n[order][1:] != lang_n[order][:-1])
    first = np.flatnonzero(new)
    order = order[np.arange(len(order)) - first[np.cumsum(new) - 1] < k]
    kept = np.empty(0, np.int64)
    for lo in range(0, len(order), block):
        some = order[lo : lo + block]
        dominators = np.zeros(len(some), np.int64)
        able = kept[(lang_n[kept] <= lang_n[some].max()) & (spelling[kept] < spelling[some].max())]
        for at in range(0, len(able), 4096):
            old = able[at : at + 4096]
            dominators += np.count_nonzero((lang_n[old] <= lang_n[some][:, None]) & (spelling[old] < spelling[some][:, None]), 1)
        some, dominators = some[dominators < k], dominators[dominators < k]
        earlier = np.arange(len(some)) < np.arange(len(some))[:, None]
        dominators = dominators + (earlier & (lang_n[some] <= lang_n[some][:, None]) & (spelling[some] < spelling[some][:, None])).sum(1)
        kept = np.concatenate([kept, some[dominators < k]])
    return kept


class Audit:
    """The counts both questions share, each written once in the shared folder.

    ``kept``: lang, source, term, n, lang_n of the kept terms, and first, once for each term of a
    language; ``groups``: lang, source, total (of the group's counts), own_terms (that it has),
    kept_terms and lang_total (of the language).
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS):
        def known(name, alias):
            return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)

        rows = docs.select(known(lang_col, "lang"), known(source_col, "source"), known(text_col, "text"))
        term = W.partitionBy("lang", "term")  # as they are dealt; a row for each source
        counts = term_counts(rows).withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term)})
        first = F.row_number().over(term.orderBy("source")) == 1
        kept = counts.withColumn("first", first).where(F.col("lang_docs") >= least_docs)
        self.kept = materialise(kept.select("lang", "source", "term", "n", "lang_n", "first"), "kept")
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own_terms"))
        langs = self.kept.where("first").groupBy("lang").agg(F.count("*").alias("kept_terms"), F.sum("lang_n").alias("lang_total"))
        groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        self.groups = materialise(groups.na.fill(0, ["total", "own_terms", "kept_terms", "lang_total"]), "groups")
        sizes = self.groups.agg(F.sum("own_terms").alias("all"), F.max("own_terms").alias("most")).first()
        self.slices, self.most_slices = (1 + (size or 0) // SLICE_ROWS for size in sizes)

    def pair_divergence(self, block: int = BLOCK) -> DataFrame:
        """lang, source, item (another source of the language), value: the sum over all kept terms."""
        no = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1
        numbered = self.groups.withColumn("no", no)
        last = numbered.groupBy("lang").agg((F.max("no") / block).cast("int").alias("last_block"))
        numbered = materialise(numbered.join(last, "lang").withColumn("block", (F.col("no") / block).cast("int")), "sources")
        other = F.explode(F.sequence(F.lit(0), F.col("last_block"))).alias("other")
        pair = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
        here = F.pmod(F.xxhash64("term"), F.lit(self.slices)).cast("int").alias("slice")
        every = F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("slice")
        key = ["lang", "lo", "hi", "slice"]
        rows = self.kept.join(numbered, ["lang", "source"]).select("lang", "term", "n", F.col("no").alias("member"), "block", other, here)
        rows = rows.select(*[k for k in key if k not in ("lo", "hi")], *pair, "term", "n", "member")
        sources = numbered.select("lang", "no", "block", "total", "kept_terms", other).select("lang", "no", "block", "total", "kept_terms", *pair)
        sources = sources.select("*", every)

        def sums(terms: pa.Table, sources: pa.Table) -> pa.Table:
            order = np.argsort(sources["no"].to_numpy())
            number, of = sources["no"].to_numpy()[order], sources["block"].to_numpy()[order]
            every = np.maximum(1, (sources["total"].to_numpy() + sources["kept_terms"].to_numpy())[order])
            absent, width = share(np.zeros(1, np.int64), every), len(number)
            between = (absent[:, None] - absent) ** 2 // absent
            found = np.zeros((width, width), np.int64)
            coded = terms["term"].combine_chunks().dictionary_encode()
            at, n = np.searchsorted(number, terms["member"].to_numpy()), terms["n"].to_numpy()
            term = coded.indices.to_numpy(zero_copy_only=False)
            by_term = np.argsort(term, kind="stable")
            step = max(1, (1 << 20) // max(1, width))
            for lo in range(0, len(coded.dictionary), step):
                a, b = np.searchsorted(term[by_term], [lo, lo + step])
                some = by_term[a:b]
                counts = np.zeros((min(step, len(coded.dictionary) - lo), width), np.int64)
                counts[term[some] - lo, at[some]] = n[some]
                p = share(counts, every)
                for i in range(width):
                    q = p[:, i : i + 1]
                    found[:, i] += ((p - q) ** 2 // q).sum(0) - len(p) * between[:, i]
            # both directions of a pair; within a block all, else only from one block to the other
            wanted = ~np.eye(width, dtype=bool) & ((of[:, None] != of) | (of[0] == of[-1]))
            i, j = np.nonzero(wanted)
            lang = pa.array([sources["lang"][0].as_py()] * len(i), pa.string())
            return pa.table({"lang": lang, "of": pa.array(number[i], pa.int32()), "at": pa.array(number[j], pa.int32()), "part": pa.array(found[i, j])})

        def run(key, terms, sources):
            return sums(terms, sources)

        parts = rows.groupBy(*key).cogroup(sources.groupBy(*key)).applyInArrow(run, "lang string, of int, at int, part bigint")
        totals = parts.groupBy("lang", "of", "at").agg(F.sum("part").alias("part"))
        one = numbered.select("lang", F.col("no").alias("of"), "source", "kept_terms", F.expr("total + kept_terms").alias("_p"))
        two = numbered.select("lang", F.col("no").alias("at"), F.col("source").alias("item"), F.expr("total + kept_terms").alias("_q"))
        both = totals.join(one, ["lang", "of"]).join(two, ["lang", "at"])
        both = both.withColumns({"p": _share("0", "_p"), "q": _share("0", "_q")})
        return both.select("lang", "source", "item", (F.col("part") + F.col("kept_terms") * _difference("p", "q")).alias("value"))

    def leading_terms(self, k: int = TOP) -> DataFrame:
        """lang, source, item (a term with more than its share), value; every one of the ``k`` first is among them."""

        def keep(table: pa.Table) -> pa.Table:
            return table.take(pa.array(skyband(table["n"].to_numpy(), table["lang_n"].to_numpy(), table["term"].combine_chunks(), k)))

        sizes = self.groups.select("lang", "source", F.expr(f"1 + own_terms div {SLICE_ROWS}").alias("slices"))
        slice_ = F.pmod(F.xxhash64("term"), "slices").alias("slice")
        rows = self.kept.join(sizes, ["lang", "source"]).select("lang", "source", slice_, "term", "n", "lang_n")
        schema, left = "lang string, source string, slice bigint, term string, n bigint, lang_n bigint", self.most_slices
        rows = rows.groupBy("lang", "source", "slice").applyInArrow(keep, schema)
        while left > 1:
            rows = rows.withColumn("slice", (F.col("slice") / FAN).cast("bigint"))
            left = -(-left // FAN)
            rows = rows.groupBy("lang", "source", "slice").applyInArrow(keep, schema)
        placed = rows.join(self.groups, ["lang", "source"])
        placed = placed.withColumns({"_p": F.expr("total + kept_terms"), "_q": F.expr("lang_total + kept_terms")})
        placed = placed.withColumns({"p": _share("n", "_p"), "q": _share("lang_n", "_q")}).where("p > q")
        return placed.select("lang", "source", F.col("term").alias("item"), _difference("p", "q").alias("value"))


def audit_report(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources, and the ``top`` leading terms, of every group."""
    audit = Audit(docs, **options)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = audit.pair_divergence().withColumn("rank", rank)
    terms = audit.leading_terms(top).withColumn("rank", rank).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
