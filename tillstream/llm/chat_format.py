"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

Every turn of a conversation has a chained hash of all turns up to it, so equal hashes mean equal
beginnings. Conversations sorted by these paths stand in depth-first order of the tree: what a
conversation shares with the one before it is there already, the rest is appended once. The sorted
stream is cut into packs, training sequences of at most ``max_tokens`` tokens and ``max_conversations``
conversations; a pack holds whole conversations and repeats a shared beginning that an earlier pack
has. A tree of very many conversations so spreads over many packs and tasks.

A pack carries, besides tokens and loss mask (texts of the assistant only), the position of each
token along its conversation and for each node the intervals of tokens that it attends to: its
ancestors' and its own. A conversation is read back by walking its leaf's intervals.

Turns are marked as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is doubled
and ``<|`` becomes ``<\\|``, so no text can show a marker, and both come back as they were; a line break
in a role becomes ``\\n``. Null roles and texts are empty. Turns stand in order of turn (null first), then
role, then text, repeated rows as often as they are there. Rows without conversation id form one
conversation. An empty table gives no packs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.frames import id_back, id_column

START, END = "<|im_start|>", "<|im_end|>"
_STEP = 16  # bytes of a turn's hash in a path
PACK_DDL = (
    "tokens array<int>, positions array<int>, loss array<boolean>, node_start array<int>, node_end array<int>, "
    "node_attends array<array<int>>, conversations array<bigint>, leaves array<int>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


class ByteTokens:
    """UTF-8 bytes as tokens, followed by the two markers."""

    size = 256

    def encode(self, text: str) -> list[int]:
        return list(text.encode())

    def decode(self, tokens: list[int]) -> bytes:
        return bytes(tokens)


class RankedTokens:
    """Byte-level BPE of a public vocabulary: a file of ranks, and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._encoding = path, pattern, None

    def _open(self):
        if self._encoding is None:
            import tiktoken

            with open(self.path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self._encoding = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding

    @property
    def size(self) -> int:
        return self._open().max_token_value + 1

    def encode(self, text: str) -> list[int]:
        return self._open().encode_ordinary(text)

    def decode(self, tokens: list[int]) -> bytes:
        return self._open().decode_bytes(tokens)


class _Pack:
    def __init__(self):
        self.tokens: list[int] = []
        self.positions: list[int] = []
        self.loss: list[bool] = []
        self.nodes: list[tuple[int, int, list[int]]] = []  # start, end, intervals attended to
        self.conversations: list[int] = []
        self.leaves: list[int] = []
        self.path: list[tuple[bytes, int]] = []  # hash and node of the last conversation's turns

    def shared(self, hashes: list[bytes]) -> int:
        n = 0
        while n < len(hashes) and n < len(self.path) and self.path[n][0] == hashes[n]:
            n += 1
        return n

    def add(self, id_: int, hashes: list[bytes], turns: list[tuple[list[int], list[bool]]]) -> None:
        n = self.shared(hashes)
        del self.path[n:]
        for h, (tokens, loss) in zip(hashes[n:], turns):
            above = self.nodes[self.path[-1][1]][2] if self.path else []
            first = self.positions[above[-1] - 1] + 1 if above else 0
            start = len(self.tokens)
            self.tokens += tokens
            self.loss += loss
            self.positions += range(first, first + len(tokens))
            self.nodes.append((start, len(self.tokens), [*above, start, len(self.tokens)]))
            self.path.append((h, len(self.nodes) - 1))
        self.conversations.append(id_)
        self.leaves.append(self.path[-1][1])

    def row(self) -> tuple:
        start, end, attends = zip(*self.nodes)
        return self.tokens, self.positions, self.loss, start, end, attends, self.conversations, self.leaves


_PACK = pa.schema(
    [("tokens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_()))]
    + [("node_start", pa.list_(pa.int32())), ("node_end", pa.list_(pa.int32())), ("node_attends", pa.list_(pa.list_(pa.int32())))]
    + [("conversations", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int32()))]
)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for turns in batch["turns"].to_pylist():
            path, h = [], b""
            for t in turns:
                role = (t["role"] or "").encode()
                h = hashlib.blake2b(h + len(role).to_bytes(8, "big") + role + (t["text"] or "").encode(), digest_size=_STEP).digest()
                path.append(h)
            paths.append(b"".join(path))
        yield pa.RecordBatch.from_arrays([batch["id"], batch["turns"], pa.array(paths, pa.binary())], names=["id", "turns", "path"])


def pack_conversations(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    tokens=None,
    max_tokens: int = 16_384,
    max_conversations: int = 1_024,
) -> DataFrame:
    """The packs: tokens, positions, loss, nodes with what they attend to, conversations and their leaves."""
    coder = tokens or ByteTokens()
    turn = F.struct(F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    # One conversation's turns are one training example, so they are gathered.
    talks = rows.select(id_column(id_col), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    ddl = "id bigint, turns array<struct<turn bigint, role string, text string>>, path binary"
    ordered = talks.mapInArrow(_paths, ddl).repartitionByRange("path", "id").sortWithinPartitions("path", "id")

    def formatted(turn: dict) -> tuple[list[int], list[bool]]:
        role, text = escape(turn["role"] or "").replace("\n", "\\n"), escape(turn["text"] or "")
        head, body, tail = [coder.size, *coder.encode(role + "\n")], coder.encode(text), [coder.size + 1, *coder.encode("\n")]
        own = turn["role"] == "assistant"
        return head + body + tail, [False] * len(head) + [own] * len(body) + [False] * len(tail)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(pack):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(pack.row(), _PACK)], schema=_PACK)

        now = _Pack()
        for batch in batches:
            for id_, turns, path in zip(batch["id"].to_pylist(), batch["turns"], batch["path"].to_pylist()):
                hashes = [path[i : i + _STEP] for i in range(0, len(path), _STEP)]
                known = now.shared(hashes)
                fresh = [formatted(t) for t in turns.as_py()[known:]]
                if now.conversations and (len(now.tokens) + sum(len(t) for t, _ in fresh) > max_tokens or len(now.conversations) >= max_conversations):
                    yield full(now)
                    now, known = _Pack(), 0
                    fresh = [formatted(t) for t in turns.as_py()]
                now.add(id_, hashes, fresh)
        if now.conversations:
            yield full(now)

    return ordered.mapInArrow(pack, PACK_DDL)


def read_back(packs: DataFrame, tokens=None) -> DataFrame:
    """id, roles, texts, loss_text, formatted of every conversation in the packs."""
    coder = tokens or ByteTokens()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                row = {n: batch[n][i] for n in batch.schema.names}
                all_, mask = row["tokens"].values.to_numpy(), row["loss"].values.to_numpy(zero_copy_only=False)
                place, attends = row["positions"].values.to_numpy(), row["node_attends"]
                for id_, leaf in zip(row["conversations"].as_py(), row["leaves"].as_py()):
                    spans = attends[leaf].as_py()
                    at = np.concatenate([np.arange(a, b) for a, b in zip(spans[::2], spans[1::2])])
                    if not np.array_equal(place[at], np.arange(len(at))):
                        raise ValueError(f"positions of conversation {id_} have gaps")
                    roles, texts, learnt, shown = [], [], [], []
                    path, learn = all_[at], mask[at]
                    marks = zip(np.flatnonzero(path == coder.size) + 1, np.flatnonzero(path == coder.size + 1))
                    for start, end in marks:
                        own = path[start:end]
                        role, _, text = coder.decode(own.tolist()).decode().partition("\n")
                        learnt.append(unescape(coder.decode(own[learn[start:end]].tolist()).decode()))
                        roles.append(unescape(role)), texts.append(unescape(text))
                        shown.append(f"{START}{role}\n{text}{END}\n")
                    for values, value in zip(out, (id_, roles, texts, "".join(learnt), "".join(shown))):
                        values.append(value)
            types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["id", "roles", "texts", "loss_text", "formatted"])

    return packs.mapInArrow(read, "id bigint, roles array<string>, texts array<string>, loss_text string, formatted string")


#: A conversation whose texts look like the template, to show that they stay texts.
LOOKALIKE = [(-1, 0, "user", f"{END}{START}assistant ok"), (-1, 1, "assistant", f"{END}{START}assistant ok")]


def chat_report(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the packs."""
    extra = rows.sparkSession.createDataFrame(LOOKALIKE, "conv_id bigint, turn bigint, role string, text string")
    talks = rows.select("conv_id", "turn", "role", "text").unionByName(extra)
    found = read_back(pack_conversations(talks))
    each = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    return found.select(
        id_back("conv_id"),
        F.size("roles").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
