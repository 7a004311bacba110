"""Documents packed into blocks of a few MB and bucketed by block.

Several steps of an operator need whole texts together with what an earlier step found out about
them. Packed once into a bucketed table, the documents stay where they are: each step shuffles only
its findings, keyed by block. Ids may be missing or repeated, so a row is told from others by its
block, id and mark, a hash of its text. A document's block follows from its id, so no key makes a block hot.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import words as tw
from tillstream.llm.frames import id_column
from tillstream.session import scratch_path

BLOCK_BYTES = 4 << 20


class Blocks:
    """The packed documents: ``rows`` (block, payload), and sizes to choose shards by."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, whole: bool = False, block_bytes: int = BLOCK_BYTES):
        """``whole`` packs all columns, for :func:`whole_rows`; else only id and text."""
        spark = docs.sparkSession
        self.schema, self.text_col, self.whole = docs.schema, text_col, whole
        self.bytes = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
        self.count = max(1, math.ceil(self.bytes / block_bytes))
        content = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if whole else F.col(text_col).cast("string")
        mark = F.xxhash64(F.col(text_col).cast("string")).alias("mark")
        keyed = docs.select(id_column(id_col), mark, content.alias("content"))
        keyed = keyed.select(F.pmod(F.xxhash64("id", "mark"), F.lit(self.count)).cast("int").alias("block"), "id", "mark", "content")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        packed = keyed.mapInArrow(_pack, "block int, payload binary").repartition(buckets, "block")
        name = f"blocks_{uuid.uuid4().hex}"
        packed.write.bucketBy(buckets, "block").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
        self.rows = spark.table(name)

    def shards(self, shard_bytes: int) -> int:
        return max(1, math.ceil(self.bytes / shard_bytes))

    def reader(self):
        """Function for executors: (ids, marks, texts, contents) of each payload of a column."""
        whole, text_col = self.whole, self.text_col

        def read(payloads) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]]:
            for payload in payloads:
                batch = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks().to_batches()[0]
                content = batch["content"]
                texts = content.field(content.type.get_field_index(text_col)).cast(pa.string()) if whole else content
                if whole and content.offset:
                    texts = texts.slice(content.offset, len(content))
                yield batch["id"].to_numpy(), batch["mark"].to_numpy(), texts, content

        return read


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for batch in batches:
        block = batch["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist()
        blocks, payloads = [], []
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            part = pa.RecordBatch.from_pydict({n: batch[n].take(pa.array(order[lo:hi])) for n in ("id", "mark", "content")})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            blocks.append(int(block[order[lo]])), payloads.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(payloads, pa.binary())], names=["block", "payload"])


def text_runs(read, payloads) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of runs of texts in packed payloads."""
    for ids, _, texts, _ in read(payloads):
        for lo, hi, data, offsets in tw.text_runs(texts):
            yield ids[lo:hi], data, offsets


def cut_by(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order that sorts by key, and (key, start, end) of each key in that order."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, int)
    return order, [(int(ordered[a]), int(a), int(b)) for a, b in zip(cuts, np.append(cuts[1:], len(keys)))]


def low_bytes(values: np.ndarray, n: int) -> bytes:
    """The ``n`` low bytes of each 64-bit value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()
