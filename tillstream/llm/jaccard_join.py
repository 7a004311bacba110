"""Near-duplicate documents by Jaccard similarity of word shingles: a parity-sketch join.

Shingles are XOR-hashed into sketches: each flips one bit, so the Hamming distance of two sketches
is at most the size of the sets' symmetric difference, and that is at most
D = (|A| + |B|) (1 - t) / (1 + t) for a similarity of t or more.

1. *Classes.* Documents with equal shingle sets form a numbered class; its row with the smallest id
   stands for it. Numbers, not ids, go through the steps, so rows of missing or repeated id and other
   text are never taken for one. Ids are only the labels at the end.
2. *Size bands.* Sets as similar as t lie in one band of sizes or in neighbouring ones; a set joins
   its own band, and the next if it can have partners there. A band has one D.
3. *Pigeonhole join.* The band's sketch is cut into D + q parts. Similar sets agree in q parts at
   least, and so in one of the D + 1 first parts of both, in one order for all (parts without bits
   last). These are the join keys; a part's bits are a sparse word of 2^64, named by the XOR of the
   codes of its bits. No similar pair is missed.
4. *Verify.* First each set with the partner it shares most keys with; the confirmed links give
   components. Then, in every bucket that still holds several components, all pairs across them, in
   pieces of bounded size. Pairs pass a Hamming test on dense sketches of about two bits for each
   shingle before their sets are compared. Pairs within one component need no comparison, so the
   copies of a text are never expanded to all pairs.

The result is exact up to collisions of 64-bit shingle hashes within a pair. A document with fewer
words than a shingle is one shingle of its whole sequence; null, empty and wordless texts link with
nothing, not with each other either, and stay. A missing id is later than all others; rows that
repeat id and text have equal results, and one of them stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tillstream.llm import words as tw
from tillstream.llm.blocks import Blocks
from tillstream.llm.components import components
from tillstream.llm.frames import NO_ID, id_back
from tillstream.session import materialise

#: Members of a bucket that one task compares with as many others.
PIECE = 512


class Bands:
    """Size bands and join keys for a similarity."""

    def __init__(self, similarity: Fraction):
        self.similarity = similarity
        ratio = 1 / similarity**2
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * ratio)))

    def difference(self, total: int) -> int:
        """Largest symmetric difference of similar sets with ``total`` elements together."""
        t = self.similarity
        return total * (t.denominator - t.numerator) // (t.denominator + t.numerator)

    def keys(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        """Join keys of a set, for each band that it joins."""
        n = len(hashes)
        band = int(np.searchsorted(self.lows, n, "right")) - 1
        joins = [band]
        if int(n / self.similarity) >= self.lows[band + 1]:
            joins.append(band + 1)
        for b in joins:
            most = self.difference(2 * (self.lows[b + 1] - 1))
            if not most:
                continue  # only equal sets are as similar, and they are one class
            parts = most + 1 + -(-35 * most // 100)
            with np.errstate(over="ignore"):
                part = ((tw.mixed(hashes, 21) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                sketch = np.zeros(parts, np.uint64)
                np.bitwise_xor.at(sketch, part.astype(np.int64), tw.mixed(hashes, 22))
                key = tw.mixed(sketch ^ (np.uint64(b) << np.uint64(40)) ^ np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 23)
            yield key[np.lexsort((key, sketch == 0))][: most + 1]


def dense_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity bits, a power of two of at least 64 and at least two for each element, packed."""
    bits = 1 << max(6, (2 * len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((tw.mixed(hashes, 5) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def _fold(sketch: np.ndarray, length: int) -> np.ndarray:
    """The same set's sketch with fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(*sketch.shape[:-1], -1, length), axis=-2)


class Sets:
    """Shingle sets of packed documents."""

    def __init__(self, blocks: Blocks, words: int):
        self.blocks, self.words = blocks, words

    def _reader(self):
        read, words = self.blocks.reader(), self.words

        def sets(payloads, wanted: dict[tuple[int, int], int] | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
            """id, mark and set of all rows, or class number, mark and set of one row for each ``wanted`` id and mark."""
            wanted_marks = np.array([m for _, m in wanted or ()], np.int64)
            for ids, marks, texts, _ in read(payloads):
                if wanted is not None:
                    found = [(i, wanted.pop((int(ids[i]), int(marks[i])), None)) for i in np.flatnonzero(np.isin(marks, wanted_marks))]
                    at = np.array([i for i, node in found if node is not None], np.int64)
                    ids = np.array([node for _, node in found if node is not None], np.int64)
                    marks, texts = marks[at], texts.take(pa.array(at))
                for lo, hi, data, offsets in tw.text_runs(texts):
                    grams, before = tw.shingles(data, offsets, words)
                    for row in range(hi - lo):
                        yield int(ids[lo + row]), int(marks[lo + row]), grams[before[row] : before[row + 1]]

        return sets

    def sizes(self) -> DataFrame:
        """block, id, mark, n, c1, c2: size and 128-bit hash of every row's set."""
        sets = self._reader()
        schema = pa.schema([("block", pa.int32()), *((c, pa.int64()) for c in ("id", "mark", "n", "c1", "c2"))])

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [[] for _ in schema]
                for block, payload in zip(batch["block"].to_pylist(), batch["payload"]):
                    for id_, mark, grams in sets([payload]):
                        rows[0].append(block), rows[1].append(id_), rows[2].append(mark), rows[3].append(len(grams))
                        rows[4].append(tw.mixed(grams, 11).sum(dtype=np.uint64).view(np.int64))
                        rows[5].append(np.bitwise_xor.reduce(tw.mixed(grams, 12), initial=np.uint64(0)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)

        return self.blocks.rows.mapInArrow(emit, "block int, id bigint, mark bigint, n bigint, c1 bigint, c2 bigint")

    def _of(self, classes: DataFrame, make, ddl: str) -> DataFrame:
        """What ``make`` gives for the sets of ``classes`` (node, block, id, mark); the documents stay in their blocks."""
        sets = self._reader()
        wanted = classes.select("node", "block", "id", "mark")

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            mine = {(i, m): node for i, m, node in zip(*(right[c].to_pylist() for c in ("id", "mark", "node")))}
            return make((node, grams) for node, _, grams in sets(left["payload"], mine)) if mine else make(iter(()))

        return self.blocks.rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(both, ddl)

    def keys(self, classes: DataFrame, bands: Bands) -> DataFrame:
        def make(sets) -> pa.Table:
            keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for node, grams in sets:
                for key in bands.keys(grams):
                    keys.append(key), owners.append(np.full(len(key), node))
            return pa.table({"key": pa.array(np.concatenate(keys).view(np.int64)), "node": pa.array(np.concatenate(owners))})

        return self._of(classes, make, "key bigint, node bigint")

    def sketches(self, classes: DataFrame) -> DataFrame:
        def make(sets) -> pa.Table:
            rows = [(i, len(g), dense_sketch(g).tobytes()) for i, g in sets]
            i, n, bits = zip(*rows) if rows else ((), (), ())
            return pa.table({"node": pa.array(i, pa.int64()), "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.binary())})

        return self._of(classes, make, "node bigint, n bigint, bits binary")

    def hashes(self, classes: DataFrame) -> DataFrame:
        def make(sets) -> pa.Table:
            rows = [(i, g.tobytes()) for i, g in sets]
            i, grams = zip(*rows) if rows else ((), ())
            return pa.table({"node": pa.array(i, pa.int64()), "grams": pa.array(grams, pa.binary())})

        return self._of(classes, make, "node bigint, grams binary")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    left = table.select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = table.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(left, "a").join(right, "b")


def _near(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """Pairs that sizes and sketches leave possible."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch[c].to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                length = min(len(x), len(y))
                apart = int(np.bitwise_count(_fold(x, length) ^ _fold(y, length)).sum())
                keep.append(max(apart, abs(na - nb)) <= bands.difference(na + nb))
            yield pa.RecordBatch.from_pydict({c: batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    return _with_both(pairs, sketches, ["n", "bits"]).mapInArrow(test, "a bigint, b bigint")


def _linked(pairs: DataFrame, classes: DataFrame, sets: Sets, similarity: Fraction) -> DataFrame:
    """Pairs whose sets are similar, by the sets themselves."""
    p, q = similarity.numerator, similarity.denominator

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["grams_a"].to_pylist(), batch["grams_b"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * (p + q) >= p * (len(x) + len(y)))
            yield pa.RecordBatch.from_pydict({c: batch[c].filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    hashes = materialise(sets.hashes(classes.join(_nodes(pairs), "node")), "sets")
    return _with_both(pairs, hashes, ["grams"]).mapInArrow(test, "a bigint, b bigint")


def _across(members: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of different components in a bucket that sizes and sketches leave possible.

    ``members``: key, node, component. A bucket is numbered and cut into pieces; every two pieces are
    compared in a group of their own, so no group is larger than two pieces.
    """
    numbered = members.withColumn("piece", F.floor((F.row_number().over(W.partitionBy("key").orderBy("node")) - 1) / PIECE))
    numbered = materialise(numbered, "bucket-members")
    pieces = materialise(numbered.groupBy("key").agg(F.max("piece").alias("last")), "buckets")
    spread = numbered.join(pieces, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
    spread = spread.select("key", "node", "component", "piece", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"))
    spread = spread.join(sketches, "node")

    def compare(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        nodes, comp, n, piece = (table[c].to_numpy() for c in ("node", "component", "n", "piece"))
        raw = [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]
        length = min(len(x) for x in raw)
        bits = np.stack([_fold(x, length) for x in raw])
        found: list[tuple[int, int]] = []
        left, right = np.flatnonzero(piece == low), np.flatnonzero(piece == high)
        for i in left:
            total = n[i] + n[right]
            t = bands.similarity
            most = total * (t.denominator - t.numerator) // (t.denominator + t.numerator)
            apart = np.bitwise_count(bits[i] ^ bits[right]).sum(1)
            near = (comp[i] != comp[right]) & (np.maximum(apart, np.abs(n[i] - n[right])) <= most)
            found += [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for j in right[near] if low != high or nodes[i] < nodes[j]]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return spread.groupBy("key", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(blocks: Blocks, words: int = 5, similarity: str = "0.8") -> DataFrame:
    """block, id, mark, n_shingles, first of every packed row: ``first`` is the id, mark and block of the
    smallest row reachable by links, missing where a row has no words."""
    bands, sets = Bands(Fraction(similarity)), Sets(blocks, words)
    sizes = materialise(sets.sizes(), "set-sizes")
    content = ["n", "c1", "c2"]
    classes = sizes.where("n > 0").groupBy(*content).agg(F.min(F.struct("id", "mark", "block")).alias("rep"))
    # Numbered in order of rep: a bucket's center is its earliest row, which the others are mostly copies of.
    classes = classes.orderBy("rep").select(F.monotonically_increasing_id().alias("node"), "rep", "rep.*", *content)
    classes = materialise(classes, "classes")

    keys = sets.keys(classes, bands)
    ordered = W.partitionBy("key").orderBy("node")
    met = keys.select(
        "key", "node", F.first("node").over(ordered).alias("center"), F.lag("node").over(ordered).alias("_lag"), F.lead("node").over(ordered).alias("_lead")
    )
    members = materialise(met.where("_lag is not null or _lead is not null").drop("_lag", "_lead"), "members")
    sketches = materialise(sets.sketches(classes.join(members.select("node").distinct(), "node")), "sketches")

    stars = members.where("node != center").groupBy(F.col("center").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    tried = materialise(_near(best, sketches, bands), "near-pairs")
    links = materialise(_linked(tried, classes, sets, bands.similarity), "confirmed")
    found = materialise(components(links).withColumnRenamed("id", "node"), "components")

    placed = members.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = materialise(placed, "placed")
    open_ = placed.groupBy("key").agg(F.min("component").alias("_c"), F.max("component").alias("_d")).where("_c != _d").select("key")
    rest = _across(placed.join(materialise(open_, "open-buckets"), "key"), sketches, bands)
    rest = materialise(rest.join(tried, ["a", "b"], "anti"), "near-pairs")
    if not rest.isEmpty():
        more = materialise(_linked(rest, classes, sets, bands.similarity), "confirmed")
        found = materialise(components(links.unionByName(more)).withColumnRenamed("id", "node"), "components")

    linked = materialise(found.join(classes.select("node", "rep"), "node"), "linked")
    firsts = materialise(linked.groupBy("component").agg(F.min("rep").alias("first")), "firsts")
    linked = materialise(linked.join(firsts, "component").select("node", "first"), "labels")
    of = classes.join(linked, "node", "left").select(*[F.col(c).alias(f"_{c}") for c in content], F.coalesce("first", "rep").alias("first"))
    of = materialise(of, "classes")
    joined = sizes.join(of, (sizes["n"] == of["_n"]) & (sizes["c1"] == of["_c1"]) & (sizes["c2"] == of["_c2"]), "left")
    return joined.select("block", "id", "mark", F.col("n").alias("n_shingles"), "first")


def join_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: str = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the row's component) of every row."""
    found = near_duplicates(Blocks(docs, id_col, text_col), words, similarity)
    return found.select(id_back("doc_id"), "n_shingles", F.nullif(F.coalesce("first.id", "id"), F.lit(NO_ID)).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: str = "0.8") -> DataFrame:
    """The rows of ``docs`` that stay: of each component one with its smallest id."""
    blocks = Blocks(docs, id_col, text_col, whole=True)
    found = near_duplicates(blocks, words, similarity).where("first is not null")
    found = found.withColumn("stays", F.col("first") == F.struct("id", "mark", "block"))
    found = found.groupBy("block", "id", "mark", "stays").agg(F.count("*").alias("rows")).where("not stays or rows > 1")
    read, docs_schema = blocks.reader(), to_arrow_schema(docs.schema)

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        judged = {(i, m): stays for i, m, stays in zip(*(right[c].to_pylist() for c in ("id", "mark", "stays")))}
        judged_marks = right["mark"].to_numpy()
        parts = []
        for ids, marks, _, content in read(left["payload"]):
            stay = np.ones(len(ids), bool)
            for i in np.flatnonzero(np.isin(marks, judged_marks)):
                row = int(ids[i]), int(marks[i])
                if row in judged:
                    stay[i], judged[row] = judged[row], False  # of equal rows the first at most
            parts.append(pa.RecordBatch.from_struct_array(content.filter(pa.array(stay))))
        return pa.Table.from_batches(parts) if parts else docs_schema.empty_table()

    return blocks.rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(keep, docs.schema)
