"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short, documents long, so the question is containment: which share of an item's
word shingles a document holds. Items are partitioned by size; in a partition every item is sketched
by its k smallest shingle hashes, k one more than the largest number of shingles that an item of
this size may miss. A document with the wanted containment then holds at least one of the k, so the
search misses nothing, however long the document is. Each document that holds a hash of a sketch is
verified against the item's whole shingle set, in the same task: documents are read once and not
shuffled.

The index of the test items goes to all tasks in parts of at most ``part_shingles`` shingles; a
larger benchmark is searched in several passes over the documents.

Words are lower-cased A-Z. An item with fewer words than ``words`` is one shingle of its whole
sequence. Null, empty and wordless items and documents match nothing; repeated items match each by
itself, repeated documents likewise. An empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.llm import words as tw
from tillstream.llm.frames import NO_ID, id_back, id_column
from tillstream.session import materialise

#: Shingles of test items held by a task at once, 16 bytes each.
PART_SHINGLES = 1_000_000


def _grams(data, offsets, length):
    """Hash at every place where ``length`` words of one text begin, and the text's row."""
    starts, ends, before = tw.word_spans(data, offsets)
    counts = np.diff(before)
    rows = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(starts)) - before[rows]
    at = np.flatnonzero(place + length <= counts[rows])
    return tw.sequences(tw.word_hashes(data, starts, ends, lower=True), length)[at] if len(at) else np.empty(0, np.uint64), rows[at]


def item_sets(items: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, length (words in a shingle), n, shingles (hashes, ascending) of the items that have words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, sizes, sets = [], [], [], []
            for lo, hi, data, offsets in tw.text_runs(batch["text"]):
                _, _, before = tw.word_spans(data, offsets)
                for row in range(hi - lo):
                    length = min(words, int(before[row + 1] - before[row]))
                    if length:
                        part = data[offsets[row] : offsets[row + 1]]
                        grams = np.unique(_grams(part, np.array([0, len(part)]), length)[0])
                        ids.append(batch["item_id"][lo + row].as_py()), lengths.append(length)
                        sizes.append(len(grams)), sets.append(grams.tobytes())
            columns = [pa.array(ids, pa.int64()), pa.array(lengths, pa.int32()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "length", "n", "shingles"])

    rows = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(emit, "item_id bigint, length int, n bigint, shingles binary")


class ItemIndex:
    """Sketches of a bounded number of items, partitioned by shingle length and by size."""

    def __init__(self, rows, containment: Fraction):
        self.ids = [r["item_id"] for r in rows]
        self.sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        self.need = [-(-len(s) * containment.numerator // containment.denominator) for s in self.sets]
        partitions: dict[tuple[int, int], list[int]] = {}
        for i, r in enumerate(rows):
            partitions.setdefault((r["length"], int(r["n"]).bit_length()), []).append(i)
        #: by shingle length: sketch hashes in order, and the item of each
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        parts: dict[int, list] = {}
        for (length, size), members in partitions.items():
            largest = (1 << size) - 1
            k = largest - -(-largest * containment.numerator // containment.denominator) + 1
            for i in members:
                sketch = self.sets[i][:k]  # its smallest hashes
                parts.setdefault(length, []).append((sketch, np.full(len(sketch), i)))
        for length, pairs in parts.items():
            hashes, owners = (np.concatenate(x) for x in zip(*pairs))
            order = np.argsort(hashes, kind="stable")
            self.sketches[length] = hashes[order], owners[order]

    def search(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) for the rows that hold enough of an item."""
        for length, (hashes, owners) in self.sketches.items():
            grams, rows = _grams(data, offsets, length)
            place = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            hit = np.flatnonzero(hashes[place] == grams)
            found: dict[int, set[int]] = {}
            for i in hit:
                lo = place[i]
                hi = np.searchsorted(hashes, grams[i], "right")
                found.setdefault(int(rows[i]), set()).update(owners[lo:hi].tolist())
            for row, items in found.items():
                own = grams[np.searchsorted(rows, row) : np.searchsorted(rows, row, "right")]
                for item in sorted(items):
                    shared = int(np.isin(self.sets[item], own).sum())
                    if shared >= self.need[item]:
                        yield row, item, shared


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    containment: str = "0.8",
    part_shingles: int = PART_SHINGLES,
    also: Sequence[Column] = (),
) -> DataFrame:
    """id, item_id, n_item_shingles, n_shared, and the document's columns ``also``: every document and the items it holds."""
    least = Fraction(containment)
    sets = materialise(item_sets(items, words, item_id_col, item_text_col), "items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    passes = 1 + total // part_shingles
    rows = docs.select(id_column(id_col), F.col(text_col).alias("text"), *also)
    carried = rows.schema.fields[2:]
    ddl = ", ".join(["id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in carried)])
    found = None
    for part in range(passes):
        mine = sets.where(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(passes)) == part)
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(mine.collect(), least))  # part_shingles at most, about

        def emit(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [(lo + row, *rest) for lo, _, data, offsets in tw.text_runs(batch["text"]) for row, *rest in index.value.search(data, offsets)]
                at, item, shared = zip(*hits) if hits else ((), (), ())
                arrays = [
                    batch["id"].take(pa.array(at, pa.int64())),
                    pa.array([index.value.ids[i] for i in item], pa.int64()),
                    pa.array([len(index.value.sets[i]) for i in item], pa.int64()),
                    pa.array(shared, pa.int64()),
                    *(batch[f.name].take(pa.array(at, pa.int64())) for f in carried),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "item_id", "n_item_shingles", "n_shared", *(f.name for f in carried)])

        one = rows.mapInArrow(emit, ddl)
        found = one if found is None else found.unionByName(one)
    return found


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of every match."""
    found = contaminated(docs, items, **options)
    share = (F.col("n_shared") / F.col("n_item_shingles")).alias("containment")
    return found.select(id_back("doc_id"), "item_id", "n_item_shingles", "n_shared", share)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no item, each judged by its own text: the key is the id and a 128-bit hash of the text."""
    marks = {f"_mark{seed}": F.xxhash64(F.lit(seed), docs[text_col]) for seed in (1, 2)}
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, also=[c.alias(n) for n, c in marks.items()], **options)
    bad = materialise(bad.select(F.col("id").alias("_bad"), *marks).distinct(), "contaminated")
    same_row = F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)) == bad["_bad"]
    for name, mark in marks.items():
        same_row = same_row & (mark == bad[name])
    return docs.join(bad, same_row, "anti")
