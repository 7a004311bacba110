"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased; their n-grams of two and three are hashed into ``1 << BITS`` features. A
feature weighs its share among the text's n-grams times its inverse document frequency, which is
counted over all documents to learn from. Weights are learnt by follow-the-regularised-leader with
an elastic-net penalty, which leaves most of them at zero, and the scores are then calibrated by one
temperature on rows the weights have not seen.

The fit uses at most ``PER_LABEL`` rows of each language, and at most ``MAX_ROWS`` together. All
texts are read whole, and predicted from their text alone. A null text, or one without letters, is
``und`` with score 0; so is every text where nothing could be learnt. Rows without a language teach
nothing. Repeated rows have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import words as tw
from tillstream.llm.frames import id_back, id_column
from tillstream.llm.training import fit_in_one_task, held_out, marked, sample_rows

BITS = 16
GRAMS = (2, 3)
PER_LABEL = 1_500
MAX_ROWS = 12_000
SCALE = 30.0  # of the features, so that they are of the order of one

_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x590)], np.uint32)
_LETTER = np.array([chr(c).isalpha() for c in range(0x590)])


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a run of texts, lower-cased, and where each text begins among them."""
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    small = points < len(_LOWER)
    points[small] = _LOWER[points[small]]
    return points, first[offsets]


def _letters(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    letter = np.zeros(len(points), bool)
    small = points < len(_LETTER)
    letter[small] = _LETTER[points[small]]
    for i in np.flatnonzero(~small):
        letter[i] = chr(points[i]).isalpha()
    total = np.concatenate([[0], np.cumsum(letter)])
    return total[begin[1:]] > total[begin[:-1]]


def _features(points: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the feature at every place, and the places from and to which each text's go."""
    wide = points.astype(np.uint64)
    for n in GRAMS:
        size = max(0, len(wide) - n + 1)
        h = np.full(size, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[i : i + size] * np.uint64(0xBF58476D1CE4E5B9))
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        start = np.minimum(begin[:-1], size)
        yield (h >> np.uint64(64 - BITS)).astype(np.int32), start, np.maximum(start, np.minimum(begin[1:] - n + 1, size))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each feature (a vector of fixed length), and of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in tw.text_runs(batch["text"]):
                points, begin = _characters(data, offsets)
                parts = list(_features(points, begin))
                for row in range(len(begin) - 1):
                    seen = np.zeros(1 << BITS, bool)
                    for feature, start, end in parts:
                        seen[feature[start[row] : end[row]]] = True
                    df += seen
                total += len(begin) - 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], total))], names=["feature", "n"])

    rows = docs.mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << BITS, np.int64)
    total = 0
    for feature, n in rows:
        if feature < 0:
            total = n
        else:
            df[feature] = n
    return df, total


class Ftrl:
    """Multinomial logistic regression, one sparse row at a time."""

    def __init__(self, labels: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(((1 << BITS) + 1, labels))
        self.n = np.zeros_like(self.z)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _fit(idf: np.ndarray, epochs: int = 3):
    def fit(table: pa.Table) -> bytes:
        order = np.argsort(table["order"].to_numpy(), kind="stable")
        names = table["label"].to_pylist()
        labels = sorted(set(names))
        rows = []
        features, counts = table["features"].to_pylist(), table["counts"].to_pylist()
        for i in order:
            at, c = np.frombuffer(features[i], np.int32), np.frombuffer(counts[i], np.int32)
            if len(at):
                x = SCALE * c / c.sum() * idf[at]
                rows.append((np.append(at, 1 << BITS), np.append(x, 1.0), labels.index(names[i])))
        learn, rest = [r for i, r in enumerate(rows) if i % 5], rows[::5]
        model = Ftrl(len(labels))
        for _ in range(epochs):
            for at, x, label in learn:
                model.learn(at, x, label)
        weights = model.weights(slice(None))
        logits = np.array([x @ weights[at] for at, x, _ in rest]).reshape(-1, len(labels))
        truth = np.array([label for *_, label in rest], int)

        def loss(t):
            return -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() if len(truth) else 0.0

        temperature = min(np.geomspace(0.05, 20, 121), key=loss) if len(truth) else 1.0
        some = np.flatnonzero((weights[:-1] != 0).any(1)).astype(np.int32)
        table_ = (SCALE * idf[some, None] * weights[some] / temperature).astype(np.float32)
        return pickle.dumps({"labels": labels, "at": some, "table": table_, "bias": weights[-1] / temperature})

    return fit


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LABEL) -> dict | None:
    """The model learnt from all rows of ``docs`` that have a label; None without such rows."""
    rows = docs.where(F.col(label_col).isNotNull())
    rows = rows.select(id_column(id_col), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    df, total = document_frequency(rows.select("text"))
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, counts = [], []
            for _, _, data, offsets in tw.text_runs(batch["text"]):
                points, begin = _characters(data, offsets)
                parts = list(_features(points, begin))
                for row in range(len(begin) - 1):
                    at, n = np.unique(np.concatenate([f[s[row] : e[row]] for f, s, e in parts]), return_counts=True)
                    features.append(at.astype(np.int32).tobytes()), counts.append(n.astype(np.int32).tobytes())
            arrays = [batch["label"], batch["order"], pa.array(features, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "order", "features", "counts"])

    labels = max(1, rows.select("label").distinct().count())
    rows = marked(rows)
    sample = sample_rows(rows.drop("text"), rows.drop("label"), min(per_label, max(20, MAX_ROWS // labels)))  # MAX_ROWS rows
    raw = fit_in_one_task(sample.mapInArrow(count, "label string, order bigint, features binary, counts binary"), _fit(idf))
    return pickle.loads(raw) if raw else None


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # as many numbers as features times languages

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model:
            table = np.zeros((len(model["labels"]), 1 << BITS), np.float32)
            table[:, model["at"]] = model["table"].T
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in tw.text_runs(batch["text"]):
                points, begin = _characters(data, offsets)
                known = _letters(points, begin)
                if model is None:
                    known[:] = False
                else:
                    total, logits = np.zeros(len(known)), np.zeros((len(known), len(table)))
                    for feature, start, end in _features(points, begin):
                        total += end - start
                        for label, weights in enumerate(table):
                            sums = np.concatenate([[0.0], np.cumsum(weights[feature], dtype=np.float64)])
                            logits[:, label] += sums[end] - sums[start]
                    logits = logits / np.maximum(total, 1)[:, None] + model["bias"]
                    chance = softmax(logits)
                    best = chance.argmax(1)
                for row, ok in enumerate(known.tolist()):
                    names.append(model["labels"][best[row]] if ok else "und")
                    scores.append(float(chance[row, best[row]]) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(id_column(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(emit, "id bigint, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows that are not held out."""
    model = train(docs.where(~held_out("doc_id")))
    found = predict(docs, model).withColumn("doc_id", id_back("doc_id"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
