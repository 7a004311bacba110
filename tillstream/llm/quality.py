"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages, pieces of ``PASSAGE`` bytes of its text, all of them. Each passage is
encoded by how often it has each kind of character and each pair of kinds. A hidden layer turns the
encodings into passage vectors; a gated attention, tanh times sigmoid of two projections, gives every
passage a weight within its document; the weighted mean of the passage vectors is scored. All of it
is learnt from labels of documents alone.

The fit uses at most ``PER_LABEL`` labelled rows of each label; the share of labels, which sets the
level of the scores, is counted over all. A null or empty text is one empty passage. Rows without
label teach nothing, nor do labels without id; where no two labels are known, every score is 0.5. Repeated rows have equal
results; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm import words as tw
from tillstream.llm.frames import id_back, id_column
from tillstream.llm.training import fit_in_one_task, held_out, marked, sample_rows
from tillstream.session import materialise

PASSAGE = 400
PER_LABEL = 3_000
THRESHOLD = 0.7


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of every byte, fine (each punctuation mark by itself) and coarse."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    for b in range(256):
        c = chr(b) if b < 128 else ""
        if b in marks:
            fine[b], coarse[b] = 8 + marks.index(b), 3
        elif c.islower():
            fine[b], coarse[b] = 0, 0
        elif c.isupper():
            fine[b], coarse[b] = 1, 1
        elif c.isdigit():
            fine[b], coarse[b] = 2, 2
        elif c == "\n":
            fine[b], coarse[b] = 3, 5
        elif c and c.isspace():
            fine[b], coarse[b] = 4, 4
        elif b < 128:
            fine[b], coarse[b] = 5, 5
        elif b < 192:
            fine[b], coarse[b] = 6, 6  # further bytes of a character
        else:
            fine[b], coarse[b] = 7, 6
    return fine, coarse


_FINE, _COARSE = _kinds()
FINE, COARSE = int(_FINE.max()) + 1, int(_COARSE.max()) + 1
WIDTH = FINE + COARSE * COARSE + 1


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages of a run of texts, and the number before each text."""
    sizes = np.diff(offsets)
    pieces = np.maximum(1, -(-sizes // PASSAGE))
    before = np.concatenate([[0], np.cumsum(pieces)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    piece = before[row] + (np.arange(len(data)) - offsets[row]) // PASSAGE
    total = int(before[-1])
    single = np.bincount(piece * FINE + _FINE[data], minlength=total * FINE).reshape(total, FINE)
    kind = _COARSE[data]
    same = piece[1:] == piece[:-1]
    pair = (piece[:-1] * COARSE + kind[:-1]) * COARSE + kind[1:]
    double = np.bincount(pair[same], minlength=total * COARSE * COARSE).reshape(total, -1)
    length = np.bincount(piece, minlength=total)[:, None]
    shares = np.concatenate([single, double], 1) / np.maximum(length, 1)
    return np.concatenate([np.sqrt(shares), length / PASSAGE], 1).astype(np.float32), before


class AttentionModel:
    """Passage vectors, gated attention, score; gradients by hand, for bags of any size."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)

        def normal(a, b):
            return rng.normal(0, 1 / np.sqrt(a), (a, b))

        self.p = {"W": normal(width, hidden), "b": np.zeros(hidden), "V": normal(hidden, gate), "U": normal(hidden, gate), "w": normal(gate, 1)[:, 0], "c": normal(hidden, 1)[:, 0], "d": np.zeros(1)}
        self.mean, self.scale, self.shift = np.zeros(width), np.ones(width), 0.0

    def forward(self, x: np.ndarray, before: np.ndarray):
        p, start = self.p, before[:-1]
        bag = np.repeat(np.arange(len(start)), np.diff(before))
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = a / np.add.reduceat(a, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        return z @ p["c"] + p["d"][0], (bag, h, t, s, a, z)

    def gradients(self, x, before, truth):
        p, start = self.p, before[:-1]
        logit, (bag, h, t, s, a, z) = self.forward(x, before)
        out = (1 / (1 + np.exp(-logit)) - truth) / len(truth)
        dz = out[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, start)[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": ((x - self.mean) / self.scale).T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True)}

    def score(self, x, before) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.forward(x, before)[0] + self.shift)))


def _fit(prior: float, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4):
    def fit(table: pa.Table) -> bytes:
        order = np.argsort(table["order"].to_numpy(), kind="stable")
        label = table["label"].to_numpy()[order].astype(float)
        bags = [np.frombuffer(table["passages"][int(i)].as_buffer(), np.float32).reshape(-1, WIDTH) for i in order]
        model = AttentionModel(WIDTH)
        every = np.concatenate(bags)
        model.mean, model.scale = every.mean(0), every.std(0) + 1e-3
        rng = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in model.p.items()}
        second = {k: np.zeros_like(v) for k, v in model.p.items()}
        step, kept = 0, {k: np.zeros_like(v) for k, v in model.p.items()}
        for epoch in range(epochs):
            shuffled = rng.permutation(len(bags))
            for lo in range(0, len(shuffled), batch):
                some = shuffled[lo : lo + batch]
                x = np.concatenate([bags[i] for i in some])
                before = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
                step += 1
                pace = rate * (1 - epoch / epochs) + 1e-4
                for k, g in model.gradients(x, before, label[some]).items():
                    g = g + decay * model.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    model.p[k] = model.p[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        own = label.mean()
        # The sample has its own share of labels; scores are for the share among all labelled rows.
        model.shift = float(np.log(prior / (1 - prior)) - np.log(own / (1 - own)))
        return pickle.dumps((model.p, model.mean, model.scale, model.shift))

    return fit


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> tuple | None:
    """The model learnt from the rows of ``docs`` that ``labels`` marks 0 or 1; None unless both occur."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.select(id_column(id_col), F.col(label_col).cast("int").alias("label")).distinct()
    rows = docs.where(F.col(id_col).isNotNull()).select(id_column(id_col), F.col(text_col).cast("string").alias("text"))
    rows = marked(rows)
    keys = materialise(rows.drop("text").join(known, "id"), "labels")
    counts = {r["label"]: r["count"] for r in keys.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    sample = sample_rows(keys, rows, per_label)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for _, _, data, offsets in tw.text_runs(batch["text"]):
                x, before = passages(data, offsets)
                bags += [x[a:b].tobytes() for a, b in zip(before, before[1:])]
            yield pa.RecordBatch.from_arrays([batch["label"], batch["order"], pa.array(bags, pa.binary())], names=["label", "order", "passages"])

    encoded = sample.mapInArrow(encode, "label int, order bigint, passages binary")
    raw = fit_in_one_task(encoded, _fit(counts[1] / (counts[0] + counts[1])))
    return pickle.loads(raw) if raw else None


def score(docs: DataFrame, model: tuple | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if shared.value:
            scorer = AttentionModel(WIDTH)
            scorer.p, scorer.mean, scorer.scale, scorer.shift = shared.value
        for batch in batches:
            found = [np.empty(0)]
            for _, _, data, offsets in tw.text_runs(batch["text"]):
                found.append(scorer.score(*passages(data, offsets)) if scorer else np.full(len(offsets) - 1, 0.5))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.concatenate(found))], names=["id", "score"])

    rows = docs.select(id_column(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(emit, "id bigint, score double")


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from the rows that are not held out."""
    model = train(docs.where(~held_out("doc_id")), labels)
    found = score(docs, model).withColumn("doc_id", id_back("doc_id"))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier, learnt from the rows not held out, doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out("doc_id")), labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        if shared.value:
            scorer = AttentionModel(WIDTH)
            scorer.p, scorer.mean, scorer.scale, scorer.shift = shared.value
        for batch in batches:
            text = batch[batch.schema.get_field_index(text_col)]
            found = [np.empty(0)]
            for _, _, data, offsets in tw.text_runs(text):
                found.append(scorer.score(*passages(data, offsets)) if scorer else np.ones(len(offsets) - 1))
            yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
