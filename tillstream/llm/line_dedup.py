"""Incremental line dedup that can be undone: exact reference counts behind sharded cuckoo filters.

An index is a snapshot of tables in the shared folder:

* ``refs``    one row per line key and text that holds it, with the number of its lines;
* ``shared``  for the keys held by two or more documents: their number and the smallest id;
* ``filters`` for each shard of the keys a cuckoo filter of all keys with references.

``insert`` asks the filters which keys of a batch may be known; only those are looked up in the
exact tables, all others are new for certain. ``delete`` takes documents out again: references
go, counts are redone for the keys concerned, and keys without references leave the filters. Both
give a new snapshot and leave the old one as it was. A filter may say "known" for a new key, which
costs a lookup and nothing else.

A line's key is the line without white space at both ends, A-Z lower-cased, told apart by a 128-bit
hash. Keys shorter than ``min_chars`` code points are never dropped. A key held by several documents
loses its lines in all but the document with the smallest id. Null texts count as empty and have
one empty line; a missing id is larger than all others; rows that repeat an id are one document, and
what each of them loses is found by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.frames import id_back, id_column
from tillstream.session import materialise

KEYS_PER_SHARD = 200_000
BUCKET = 4  # fingerprints in a bucket
_SPACE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ---- cuckoo filter ------------------------------------------------------------------------------


def _places(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (16 bits, never 0) and the two buckets of every key; buckets is a power of two."""
    mask = np.uint64(buckets - 1)
    mark = (keys >> np.uint64(48)).astype(np.uint64) | np.uint64(1)
    first = keys & mask
    with np.errstate(over="ignore"):
        second = first ^ ((mark * np.uint64(0x5BD1E995)) & mask)
    return mark.astype(np.uint16), first.astype(np.int64), second.astype(np.int64)


class CuckooFilter:
    """Set of 64-bit keys with deletion; ``has`` never misses a key that was added."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (0.8 * BUCKET)))))
        return cls(np.zeros((buckets, BUCKET), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, BUCKET).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        mark, first, second = _places(keys, len(self.table))
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; False where a bucket was full."""
        done = np.zeros(len(mark), bool)
        for slot in range(BUCKET):
            rest = np.flatnonzero(~done & (self.table[bucket, slot] == 0))
            at, pick = np.unique(bucket[rest], return_index=True)  # one for each free slot
            self.table[at, slot] = mark[rest[pick]]
            done[rest[pick]] = True
        return done

    def add(self, keys: np.ndarray) -> bool:
        """False if the table is too full; it is then spoilt and must be built larger."""
        mark, first, second = _places(keys, len(self.table))
        left = np.arange(len(keys))
        for bucket in (first, second, first, second):
            left = left[~self._settle(mark[left], bucket[left])]
        state = 12345
        for i in left:  # the few whose buckets are both full push others to their other bucket
            m, b = mark[i], int(first[i])
            for _ in range(500):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = m
                    break
                state = (state * 1103515245 + 12345) & 0x7FFFFFFF
                slot = (state >> 8) % BUCKET
                m, self.table[b, slot] = self.table[b, slot], m
                b ^= (int(m) * 0x5BD1E995) & (len(self.table) - 1)
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added."""
        for m, a, b in zip(*_places(keys, len(self.table)), strict=True):
            for bucket in (a, b):
                slots = np.flatnonzero(self.table[bucket] == m)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break


# ---- lines --------------------------------------------------------------------------------------


def _line_keys(text: bytes, min_chars: int) -> list[tuple[int, int] | None]:
    """Key of every line, None for lines that are too short."""
    keys: list[tuple[int, int] | None] = []
    for line in text.translate(_LOWER).split(b"\n"):
        line = line.strip(_SPACE)
        long_enough = len(line) >= min_chars and (len(line) >= 4 * min_chars or line.isascii() or len(line.decode("utf-8", "replace")) >= min_chars)
        if long_enough:
            h = xxhash.xxh3_128_intdigest(line)
            keys.append((h >> 64, h & (2**64 - 1)))
        else:
            keys.append(None)
    return keys


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def references(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """hi, lo, id, mark, n: a row for each key and row of ``docs``; ``mark`` is a hash of its text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, ids, marks, n = [], [], [], [], []
            for doc, mark, text in zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), batch["text"]):
                counts: dict[tuple[int, int], int] = {}
                for key in _line_keys(text.as_buffer().to_pybytes() if text.is_valid else b"", min_chars):
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
                for (a, b), c in counts.items():
                    hi.append(a), lo.append(b), ids.append(doc), marks.append(mark), n.append(c)
            arrays = [_signed(hi), _signed(lo), *(pa.array(x, pa.int64()) for x in (ids, marks, n))]
            yield pa.RecordBatch.from_arrays(arrays, names=["hi", "lo", "id", "mark", "n"])

    return _rows(docs, id_col, text_col).mapInArrow(emit, "hi bigint, lo bigint, id bigint, mark bigint, n bigint")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(id_column(id_col), F.xxhash64(text).alias("mark"), text.alias("text"))


def _counts(refs: DataFrame) -> DataFrame:
    documents = refs.select("hi", "lo", "id").distinct()
    return documents.groupBy("hi", "lo").agg(F.count("*").alias("docs"), F.min("id").alias("first_id"))


# ---- filters as rows: shard, filter --------------------------------------------------------------


def _values(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["lo"].to_numpy(np.int64).view(np.uint64)


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.col("hi"), F.lit(shards)).cast("int"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    values, room = _values(pdf), 2 * len(pdf)
    filled = CuckooFilter.sized(room)
    while not filled.add(values):
        room *= 2
        filled = CuckooFilter.sized(room)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [filled.dump()]})


def _probe(keys: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
    maybe = CuckooFilter.load(stored["filter"].iloc[0]).has(_values(keys)) if len(stored) and len(keys) else np.zeros(len(keys), bool)
    return keys.assign(maybe=maybe)


def _change(deleting: bool):
    def change(keys: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(stored):
            return _build(keys).assign(full=False)
        table, fits = CuckooFilter.load(stored["filter"].iloc[0]), True
        if deleting:
            table.remove(_values(keys))
        elif len(keys):
            fits = (table.table > 0).sum() + len(keys) <= 0.9 * table.table.size and table.add(_values(keys))
        return pd.DataFrame({"shard": [int(stored["shard"].iloc[0])], "filter": [table.dump()], "full": [not fits]})

    return change


def _filters(keys: DataFrame, shards: int) -> DataFrame:
    return materialise(_sharded(keys.select("hi", "lo"), shards).groupBy("shard").applyInPandas(_build, "shard int, filter binary"), "filters")


# ---- the index ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    """A snapshot; ``insert`` and ``delete`` give the next one."""

    refs: DataFrame | None = None
    shared: DataFrame | None = None
    filters: DataFrame | None = None
    shards: int = 1
    keys: int = 0  # that have references
    min_chars: int = 10
    keys_per_shard: int = KEYS_PER_SHARD

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With the lines of ``docs``, whose ids are not in the index yet."""
        batch = materialise(references(docs, id_col, text_col, self.min_chars), "line-refs")
        keys = materialise(_counts(batch), "line-keys")
        if self.refs is None:
            total = keys.count()
            shards = 1 + total // self.keys_per_shard
            shared = materialise(keys.where("docs > 1"), "shared-lines")
            return replace(self, refs=batch, shared=shared, filters=_filters(keys, shards), shards=shards, keys=total)
        schema = "shard int, hi bigint, lo bigint, docs bigint, first_id bigint"
        asked = _sharded(keys, self.shards).select("shard", "hi", "lo", "docs", "first_id").groupBy("shard")
        asked = materialise(asked.cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, schema + ", maybe boolean"), "asked")
        maybe = asked.where("maybe").select("hi", "lo")
        known = materialise(_counts(self.refs.join(maybe, ["hi", "lo"], "semi")), "known-lines")
        refs = self.refs.unionByName(batch)  # both written
        both = keys.unionByName(known).groupBy("hi", "lo").agg(F.sum("docs").alias("docs"), F.min("first_id").alias("first_id"))
        shared = self.shared.join(keys, ["hi", "lo"], "anti").unionByName(both.where("docs > 1").join(keys, ["hi", "lo"], "semi"))
        shared = materialise(shared, "shared-lines")
        fresh = materialise(keys.join(known, ["hi", "lo"], "anti"), "new-lines")
        total = self.keys + fresh.count()
        if total > 2 * self.keys_per_shard * self.shards:  # more shards, before one grows too large for a task
            shards = 1 + total // self.keys_per_shard
            filters = _filters(refs.select("hi", "lo").distinct(), shards)
            return replace(self, refs=refs, shared=shared, filters=filters, shards=shards, keys=total)
        return replace(self, refs=refs, shared=shared, filters=self._changed(fresh, refs, deleting=False), keys=total)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents whose ids are in ``ids``."""
        gone = ids.select(id_column(id_col)).distinct()
        touched = materialise(self.refs.join(gone, "id", "semi").select("hi", "lo").distinct(), "touched-lines")
        refs = materialise(self.refs.join(gone, "id", "anti"), "line-refs")
        left = materialise(_counts(refs.join(touched, ["hi", "lo"], "semi")), "known-lines")
        shared = self.shared.join(touched, ["hi", "lo"], "anti").unionByName(left.where("docs > 1"))
        shared = materialise(shared, "shared-lines")
        lost = materialise(touched.join(left, ["hi", "lo"], "anti"), "lost-lines")
        return replace(self, refs=refs, shared=shared, filters=self._changed(lost, refs, deleting=True), keys=self.keys - lost.count())

    def _changed(self, keys: DataFrame, refs: DataFrame, deleting: bool) -> DataFrame:
        groups = _sharded(keys.select("hi", "lo"), self.shards).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        changed = materialise(groups.applyInPandas(_change(deleting), "shard int, filter binary, full boolean"), "filters")
        if changed.where("full").isEmpty():
            return changed.drop("full")
        return _filters(refs.select("hi", "lo").distinct(), self.shards)

    def dropped(self) -> DataFrame:
        """id, mark, keys: of every text that loses lines, their keys."""
        # Written tables: adaptive execution splits a key that very many documents hold.
        lost = self.refs.join(self.shared, ["hi", "lo"]).where("id != first_id")
        return lost.groupBy("id", "mark").agg(F.collect_set(F.struct("hi", "lo")).alias("keys"))  # lines of one text

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, kept_text, n_lines, n_dropped of every row of ``docs``, all of which are in the index."""
        least = self.min_chars

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, total, lost = [], [], []
                for text, keys in zip(batch["text"], batch["keys"].to_pylist()):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    lines = raw.split(b"\n")
                    if keys:
                        drop = {(k["hi"] & (2**64 - 1), k["lo"] & (2**64 - 1)) for k in keys}
                        stay = [line for line, key in zip(lines, _line_keys(raw, least), strict=True) if key not in drop]
                    else:
                        stay = lines
                    kept.append(b"\n".join(stay)), total.append(len(lines)), lost.append(len(lines) - len(stay))
                arrays = [batch["id"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "kept_text", "n_lines", "n_dropped"])

        rows = _rows(docs, id_col, text_col)
        drops = materialise(self.dropped(), "dropped-lines").withColumnsRenamed({"id": "_id", "mark": "_mark"})
        rows = rows.join(drops, (F.col("id") == F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
        return rows.select("id", "text", "keys").mapInArrow(emit, "id bigint, kept_text string, n_lines bigint, n_dropped bigint")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row.

    The documents come in three batches; the last is then deleted and inserted again.
    """
    part = F.pmod(F.xxhash64(id_column(id_col)), F.lit(8))
    batches = [docs.where(w) for w in (part < 4, (part >= 4) & (part < 7), part == 7)]
    index = LineIndex(min_chars=min_chars)
    for batch in batches:
        index = index.insert(batch, id_col, text_col)
    index = index.delete(batches[-1], id_col).insert(batches[-1], id_col, text_col)
    cleaned = index.clean(docs, id_col, text_col)
    return cleaned.select(id_back("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
