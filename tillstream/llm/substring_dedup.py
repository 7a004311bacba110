"""Substring dedup: windows of words that an earlier document has are removed.

1. *Candidates.* Every window has an anchor, the smallest hash among its runs of ``ANCHOR`` words.
   Equal windows have equal anchors, and neighbouring windows mostly share one, so there are about
   a fifth as many. Anchors are counted in shards; only windows with a recurring one go on.
2. *Confirmed passages.* Candidate windows, told apart by 96-bit hashes, meet in shards by hash.
   Each block of documents contributes a window once, with its smallest id, however often the
   block holds it; so a passage of very many documents costs a row for each block at most. The
   answer to each block: which of its windows have an earlier document, and the smallest id.
3. *Automata.* For each block, runs of such windows become phrases. They are compiled into an
   Aho-Corasick automaton over word numbers, one automaton for each block, and all documents of the
   block stream through it, which locates every occurrence. An occurrence counts in documents
   later than every first holder of the phrase's windows.

Documents are read whole; null and empty texts have no words. A missing id is later than all
others; rows that repeat an id never remove each other's words. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import words as tw
from tillstream.llm.blocks import Blocks, cut_by, from_low_bytes, low_bytes, text_runs
from tillstream.llm.frames import id_back
from tillstream.session import materialise

ANCHOR = 5
SHARD_BYTES = 16 << 20  # of text, for a shard of windows
_SHORT = np.uint64((1 << 48) - 1)


class _Windows:
    """Words and windows of a run of texts."""

    def __init__(self, data, offsets, length: int):
        self.starts, self.ends, self.before = tw.word_spans(data, offsets)
        self.words = tw.word_hashes(data, self.starts, self.ends)
        counts = np.diff(self.before)
        self.row = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(self.words)) - self.before[self.row]
        self.at = np.flatnonzero(place + length <= counts[self.row])
        self.length = length

    def anchors(self) -> np.ndarray:
        """48-bit anchor of every window."""
        size = min(ANCHOR, self.length)
        least, width, wanted = tw.sequences(self.words, size, 3), 1, self.length - size + 1
        grams = least
        while 2 * width <= wanted:
            least, width = np.minimum(least[:-width], least[width:]) if width < len(least) else least[:0], 2 * width
        more = wanted - width
        if more and len(least) > more:
            least = np.minimum(least[:-more], least[more:])
        return (least[self.at] if len(self.at) else grams[:0]) & _SHORT

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.at):
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        return (
            tw.sequences(self.words, self.length, 5)[self.at],
            (tw.sequences(self.words, self.length, 6)[self.at] >> np.uint64(32)).astype(np.uint32),
        )


def _table(schema: pa.Schema, *columns) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _recurring_anchors(blocks: Blocks, length: int, shards: int) -> DataFrame:
    """block, found: anchors of the block that recur, 6 bytes each."""
    read = blocks.reader()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"]):
                all_ = [np.empty(0, np.uint64)]
                for _, data, offsets in text_runs(read, [payload]):
                    seen = _Windows(data, offsets, length)
                    anchors, row = seen.anchors(), seen.row[seen.at]
                    new = np.ones(len(anchors), bool)
                    new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                    all_.append(anchors[new])
                anchors = np.concatenate(all_)
                order, parts = cut_by(anchors % np.uint64(shards))
                anchors = anchors[order]
                rows = [(s, block, low_bytes(anchors[a:b], 6)) for s, a, b in parts]
                if rows:
                    yield _table(schema, *zip(*rows)).to_batches()[0]

    found = pa.schema([("block", pa.int32()), ("found", pa.binary())])

    def meet(table: pa.Table) -> pa.Table:
        raw = table["anchors"].to_pylist()
        anchors = from_low_bytes(b"".join(raw), 6)
        ordered = np.sort(anchors)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        place = np.minimum(np.searchsorted(again, anchors), max(0, len(again) - 1))
        recurs = again[place] == anchors if len(again) else np.zeros(len(anchors), bool)
        rows, at = [], 0
        for block, x in zip(table["block"].to_pylist(), raw):
            mine = anchors[at : at + len(x) // 6][recurs[at : at + len(x) // 6]]
            if len(mine):
                rows.append((block, low_bytes(mine, 6)))
            at += len(x) // 6
        return _table(found, *zip(*rows)) if rows else found.empty_table()

    sent = blocks.rows.mapInArrow(emit, "shard int, block int, anchors binary")
    return sent.groupBy("shard").applyInArrow(meet, "block int, found binary")


def _earlier_windows(blocks: Blocks, anchors: DataFrame, length: int, shards: int) -> DataFrame:
    """block, hashes (8 bytes each), firsts (compressed ids): windows of the block with an earlier document."""
    read = blocks.reader()
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("windows", pa.binary()), ("ids", pa.binary())])

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        recurring = np.unique(np.concatenate([from_low_bytes(x, 6) for x in right["found"].to_pylist()]))
        one, two, owner = [], [], []
        for ids, data, offsets in text_runs(read, left["payload"]):
            seen = _Windows(data, offsets, length)
            go = np.isin(seen.anchors(), recurring)
            first, second = seen.hashes()
            one.append(first[go]), two.append(second[go]), owner.append(ids[seen.row[seen.at[go]]])
        one, two, owner = np.concatenate(one), np.concatenate(two), np.concatenate(owner)
        order = np.lexsort((owner, two, one))
        one, two, owner = one[order], two[order], owner[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(one)) - 1
        several = owner[start] != owner[end] if len(start) else np.empty(0, bool)
        one, two, owner = one[start], two[start], owner[start]
        order, parts = cut_by(one % np.uint64(shards))
        one, two, owner, several = one[order], two[order], owner[order], several[order]
        squeeze, block = zstandard.ZstdCompressor(1).compress, left["block"][0].as_py()
        rows = [(s, block, one[a:b].tobytes() + two[a:b].tobytes(), squeeze(owner[a:b].tobytes() + several[a:b].tobytes())) for s, a, b in parts]
        return _table(schema, *zip(*rows)) if rows else schema.empty_table()

    answer = pa.schema([("block", pa.int32()), ("hashes", pa.binary()), ("firsts", pa.binary())])

    def meet(table: pa.Table) -> pa.Table:
        squeeze, open_ = zstandard.ZstdCompressor(1).compress, zstandard.ZstdDecompressor().decompress
        raw = table["windows"].to_pylist()
        counts = [len(x) // 12 for x in raw]
        one = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(raw, counts)])
        two = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(raw, counts)])
        ids = [open_(x) for x in table["ids"].to_pylist()]
        owner = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(ids, counts)])
        several = np.concatenate([np.frombuffer(x, bool, n, 8 * n) for x, n in zip(ids, counts)])
        order = np.lexsort((two, one))
        new = np.ones(len(one), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        group = np.cumsum(new) - 1
        first = np.empty(len(one), np.int64)
        first[order] = np.minimum.reduceat(owner[order], np.flatnonzero(new))[group]
        tell = several | (first < owner)
        rows, at = [], 0
        for block, n in zip(table["block"].to_pylist(), counts):
            mine = np.flatnonzero(tell[at : at + n]) + at
            if len(mine):
                rows.append((block, one[mine].tobytes(), squeeze(first[mine].tobytes())))
            at += n
        return _table(answer, *zip(*rows)) if rows else answer.empty_table()

    sent = blocks.rows.groupBy("block").cogroup(anchors.groupBy("block"))
    sent = sent.applyInArrow(candidates, "shard int, block int, windows binary, ids binary")
    return sent.groupBy("shard").applyInArrow(meet, "block int, hashes binary, firsts binary")


class PhraseBook:
    """Aho-Corasick automaton of one block's phrases.

    A word is its number among the phrases' words, spelt as digits of which each place has symbols of
    its own. So a state has few successors, which the automaton searches one by one, and an
    occurrence always begins with a word's first digit.
    """

    def __init__(self, shortest: int):
        self.shortest = shortest
        self.phrases: dict[bytes, int] = {}  # word hashes -> smallest id that an occurrence must exceed
        self.words = np.empty(0, np.uint64)
        self.automaton = None

    def add(self, words: np.ndarray, after: int) -> None:
        key = words.tobytes()
        self.phrases[key] = min(after, self.phrases.get(key, after))

    def _spelt(self, numbers: np.ndarray) -> str:
        out = np.empty((len(numbers), self.digits), np.uint8)
        for i in range(self.digits):
            numbers, out[:, i] = np.divmod(numbers, self.base)
            out[:, i] += i * self.base
        return out.tobytes().decode("latin-1")

    def compile(self) -> None:
        if not self.phrases:
            return
        sequences = [np.frombuffer(p, np.uint64) for p in self.phrases]
        self.words = np.unique(np.concatenate(sequences))
        self.digits = next(d for d in range(1, 64) if (256 // d) ** d >= len(self.words))
        self.base = 256 // self.digits
        self.automaton = ahocorasick.Automaton()
        for words, after in zip(sequences, self.phrases.values()):
            self.automaton.add_word(self._spelt(np.searchsorted(self.words, words)), (len(words), after))
        self.automaton.make_automaton()

    def covered(self, words: np.ndarray, own: int) -> np.ndarray:
        """Which words of a document lie in occurrences of phrases whose first holders are earlier."""
        depth = np.zeros(len(words) + 1, np.int64)
        if self.automaton is not None and len(words):
            place = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            known = np.zeros(len(words) + 2, np.int8)
            known[1:-1] = self.words[place] == words
            # A word that no phrase has ends every match: the document streams in the stretches between.
            begin, end = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
            for lo, hi in zip(begin.tolist(), end.tolist()):
                if hi - lo >= self.shortest:
                    for last, (length, after) in self.automaton.iter(self._spelt(place[lo:hi])):
                        if own > after:
                            stop = lo + last // self.digits + 1
                            depth[stop - length] += 1
                            depth[stop] -= 1
        return np.cumsum(depth[:-1]) > 0


def _kept(blocks: Blocks, earlier: DataFrame, length: int) -> DataFrame:
    read = blocks.reader()
    schema = pa.schema([("id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        hashes = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right["hashes"].to_pylist())])
        firsts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(open_(x), np.int64) for x in right["firsts"].to_pylist())])
        order = np.argsort(hashes)
        hashes, firsts = hashes[order], firsts[order]
        book = PhraseBook(length)
        if len(hashes):
            for ids, data, offsets in text_runs(read, left["payload"]):
                seen = _Windows(data, offsets, length)
                found, _ = seen.hashes()
                place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                hit = np.flatnonzero((hashes[place] == found) & (firsts[place] < ids[seen.row[seen.at]]))
                at, first = seen.at[hit], firsts[place[hit]]
                breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(seen.row[at]) != 0)) + 1
                for run, who in zip(np.split(at, breaks), np.split(first, breaks)):
                    if len(run):
                        book.add(seen.words[run[0] : run[-1] + length], int(who.max()))
        book.compile()
        out = [[], [], [], []]
        for ids, data, offsets in text_runs(read, left["payload"]):
            starts, ends, before = tw.word_spans(data, offsets)
            words = tw.word_hashes(data, starts, ends)
            for row, own in enumerate(ids.tolist()):
                lo, hi = before[row], before[row + 1]
                gone = book.covered(words[lo:hi], own)
                out[0].append(own), out[1].append(_joined(data, starts[lo:hi][~gone], ends[lo:hi][~gone]))
                out[2].append(int(hi - lo)), out[3].append(int(gone.sum()))
        out[1] = pa.array(out[1], pa.binary()).cast(pa.string())
        return _table(schema, *out)

    kept = blocks.rows.groupBy("block").cogroup(earlier.groupBy("block"))
    return kept.applyInArrow(remove, "id bigint, kept_text string, n_words bigint, n_removed bigint")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words joined by one space."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    source = np.repeat(starts - first, lengths) + np.arange(total)
    out = data[np.minimum(source, len(data) - 1)]
    out[np.cumsum(lengths) - 1] = 32
    return out[:-1].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """id, kept_text, n_words, n_removed of every row: without the windows that an earlier document has."""
    blocks = Blocks(docs, id_col, text_col)
    shards = blocks.shards(SHARD_BYTES)
    anchors = materialise(_recurring_anchors(blocks, length, shards), "anchors")
    earlier = materialise(_earlier_windows(blocks, anchors, length, shards), "windows")
    return _kept(blocks, earlier, length)


def repeats_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    kept = remove_repeats(docs, **options)
    return kept.select(id_back("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
