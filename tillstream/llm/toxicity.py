"""Toxicity of documents: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Characters are lower-cased; a text's features are which of its n-grams of ``GRAMS`` characters it has,
hashed into ``1 << BITS``. Over all labelled rows, those with and without the mark are counted for every
feature; the logarithm of the two shares' ratio is the feature's scale. A logistic regression with
ridge penalty is then fitted to the scaled features, so a feature must both tell the labels apart by
itself and be of use beside the others.

The regression uses at most ``PER_LABEL`` rows of each label, with at most ``FIT_FEATURES`` features
together; the ratios and the share of labels, which sets the level of the scores, are counted over all
labelled rows. Texts are read whole, long ones in windows. A null or empty text has no features and is
scored by the level alone. A label without id labels nothing, one id with both labels neither; repeated
rows each count. Where one label is known, or none, every score is the share of label 1. An empty table
gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillstream.llm import words as tw
from tillstream.llm.frames import id_back, id_column
from tillstream.llm.language_id import _characters as characters
from tillstream.llm.training import fit_in_one_task
from tillstream.session import materialise

BITS = 18
GRAMS = (3, 4, 5)
PER_LABEL = 2_000
FIT_FEATURES = 6_000_000
THRESHOLD = 0.5
#: Logarithm of the number of bits that tell likely labelled rows before they are exchanged.
ID_BITS = 24
#: Labelled rows a feature must be found in to be used.
LEAST_ROWS = 3


def kept_back(id_col: str) -> Column:
    """Rows kept back from learning: a fifth, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the feature at every place, and the places from and to which each text's go."""
    points, begin = characters(data, offsets)
    wide, found = points.astype(np.uint64), []
    for n in GRAMS:
        size = max(0, len(wide) - n + 1)
        h = np.full(size, n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = (h ^ wide[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
        start = np.minimum(begin[:-1], size)
        found.append(((tw.mixed(h, n) >> np.uint64(64 - BITS)).astype(np.int32), start, np.maximum(start, np.minimum(begin[1:] - n + 1, size))))
    return found


def _windows(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in pieces as long as a run, each with the first n-grams of the next."""
    for lo in range(0, len(data), tw.RUN_BYTES):
        hi = min(len(data), lo + tw.RUN_BYTES + 4 * (max(GRAMS) + 1))
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        yield data[lo:hi]


def presence(column: pa.Array) -> Iterator[np.ndarray]:
    """Of every row the features it has, ascending."""
    seen = np.zeros(1 << BITS, bool)
    for lo, hi, data, offsets in tw.text_runs(column):
        if len(data) > tw.RUN_BYTES:  # one text
            for piece in _windows(data):
                for feature, _, end in _grams(piece, np.array([0, len(piece)])):
                    seen[feature[: end[0]]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found
            continue
        grams = _grams(data, offsets)
        for row in range(hi - lo):
            for feature, start, end in grams:
                seen[feature[start[row] : end[row]]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


def _likely(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id has its bit set among those of ``ids``, so that few others are exchanged.

    The bits, 64 to a word, are broadcast: ``ID_BITS`` of them, however many ids there are.
    """
    place = f"pmod(xxhash64(id), {1 << ID_BITS}L)"
    word, bit = F.expr(f"{place} div 64"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))")
    words = ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = rows.withColumns({"_word": word, "_bit": bit})
    return marked.join(F.broadcast(words), F.col("_word") == F.col("word")).where(F.col("bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """label, order (random, the same in every run), row, text of the labelled rows, written once."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    marked = marked.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("most"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = materialise(marked.where("label = most").drop("most"), "marked")
    found = _likely(rows, marked).join(marked.hint("merge"), "id")
    return materialise(found.select("label", F.xxhash64("id", "text").alias("order"), F.monotonically_increasing_id().alias("row"), "text"), "labelled")


def label_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of each label the rows with each feature, and all rows."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows_of = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch["label"].to_numpy()
            rows_of += np.bincount(label, minlength=2)
            for of, features in zip(label, presence(batch["text"])):
                counts[of][features] += 1
        some = np.flatnonzero(counts.any(0))
        arrays = [np.append(some, -1), *(np.append(counts[c, some], rows_of[c]) for c in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["feature", "n0", "n1"])

    found = rows.select("label", "text").mapInArrow(tally, "feature bigint, n0 bigint, n1 bigint")
    # at most one row a feature, and one for all rows
    found = found.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    at, pairs = found["feature"].to_numpy(), np.array([found["n0"].to_numpy(), found["n1"].to_numpy()])
    counts, total = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    counts[:, at[at >= 0]] = pairs[:, at >= 0]
    total[:] = pairs[:, at < 0].sum(1)
    return counts, total


def log_count_ratios(counts: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Logarithm of the ratio of a feature's share among rows of label 1 and among those of label 0."""
    share = counts + smoothing
    share = share / share.sum(1, keepdims=True)
    return np.where(counts.sum(0) >= LEAST_ROWS, np.log(share[1] / share[0]), 0.0)


class RidgeLogistic:
    """Logistic regression on rows of present features, fitted by a limited-memory quasi-Newton method."""

    def __init__(self, scale: np.ndarray, penalty: float = 1e-3, steps: int = 60, memory: int = 8):
        self.scale, self.penalty, self.steps, self.memory = scale, penalty, steps, memory

    def loss(self, w: np.ndarray, feature: np.ndarray, before: np.ndarray, truth: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss with penalty and its gradient; the last weight is the level."""
        sums = np.concatenate([[0.0], np.cumsum((w[:-1] * self.scale)[feature])])
        logit = sums[before[1:]] - sums[before[:-1]] + w[-1]
        value = np.logaddexp(0, logit) - truth * logit
        out = (1 / (1 + np.exp(-logit)) - truth) / len(truth)
        g = np.bincount(feature, np.repeat(out, np.diff(before)), len(self.scale)) * self.scale
        return value.mean() + self.penalty / 2 * (w[:-1] @ w[:-1]), np.append(g + self.penalty * w[:-1], out.sum())

    def fit(self, feature: np.ndarray, before: np.ndarray, truth: np.ndarray) -> np.ndarray:
        w = np.zeros(len(self.scale) + 1)
        value, g = self.loss(w, feature, before, truth)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(self.steps):
            direction, kept = g.copy(), []
            for s, y in reversed(pairs):
                a = (s @ direction) / (s @ y)
                direction -= a * y
                kept.append(a)
            if pairs:
                s, y = pairs[-1]
                direction *= (s @ y) / (y @ y)
            else:
                direction /= max(1.0, np.linalg.norm(direction))
            for (s, y), a in zip(pairs, reversed(kept)):
                direction += s * (a - (y @ direction) / (s @ y))
            pace, slope = 1.0, -(g @ direction)
            while True:
                fresh = w - pace * direction
                fresh_value, fresh_g = self.loss(fresh, feature, before, truth)
                if fresh_value <= value + 1e-4 * pace * slope or pace < 1e-8:
                    break
                pace /= 2
            s, y = fresh - w, fresh_g - g
            done = value - fresh_value < 1e-7
            w, value, g = fresh, fresh_value, fresh_g
            if done:
                break
            if s @ y > 1e-12:
                pairs = [*pairs, (s, y)][-self.memory :]
        return w


def _fit(ratios: np.ndarray, prior: float):
    def fit(table: pa.Table) -> bytes:
        order = np.argsort(table["order"].to_numpy(), kind="stable")
        truth = table["label"].to_numpy()[order].astype(float)
        bags = [np.frombuffer(table["features"][int(i)].as_buffer(), np.int32) for i in order]
        before = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
        feature = np.concatenate(bags)
        del bags
        w = RidgeLogistic(ratios).fit(feature, before, truth)
        own = truth.mean()
        # The sample has its own share of labels; scores are for the share among all labelled rows.
        level = w[-1] + np.log(prior / (1 - prior)) - np.log(own / (1 - own))
        return pickle.dumps(((w[:-1] * ratios).astype(np.float32), float(level)))

    return fit


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL, fit_features: int = FIT_FEATURES) -> tuple[np.ndarray, float] | float:
    """Weight of every feature and the level; or only the share of label 1, where both labels aren't known."""
    rows = labelled_rows(docs, labels, id_col, text_col, label_col)
    counts, total = label_counts(rows)
    if not total.all():
        return float(total[1] / max(1, total.sum()))
    ratios = log_count_ratios(counts)
    used = docs.sparkSession.sparkContext.broadcast(ratios != 0)  # a bit a feature
    nth = F.row_number().over(W.partitionBy("label").orderBy("order", "row"))
    chosen = rows.select("label", "order", "row").withColumn("nth", nth).where(F.col("nth") <= per_label)
    chosen = materialise(chosen.select(F.col("row").alias("of")), "sample")
    picked = rows.join(F.broadcast(chosen), F.col("row") == F.col("of"))  # twice per_label rows

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [features[used.value[features]].astype(np.int32).tobytes() for features in presence(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["label"], batch["order"], batch["row"], pa.array(bags, pa.binary())], names=["label", "order", "row", "features"])

    encoded = materialise(picked.select("label", "order", "row", "text").mapInArrow(encode, "label int, order bigint, row bigint, features binary"), "encoded")
    # Of rows with very many features fewer are used. The window sees numbers of twice per_label rows.
    running = F.sum(F.length("features") / 4).over(W.partitionBy("label").orderBy("order", "row"))
    fits = encoded.select("row", running.alias("upto")).where(F.col("upto") <= fit_features // 2).select(F.col("row").alias("of"))
    sample = encoded.join(F.broadcast(fits), F.col("row") == F.col("of")).drop("row", "of")
    raw = fit_in_one_task(sample, _fit(ratios, total[1] / total.sum()))
    return pickle.loads(raw)


def score(docs: DataFrame, model: tuple[np.ndarray, float] | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a feature

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if isinstance(model, float):
                found = np.full(batch.num_rows, model)
            else:
                weights, level = model
                logit = np.array([weights[features].sum(dtype=np.float64) for features in presence(batch["text"])], float) + level
                found = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found)], names=["id", "score"])

    rows = docs.select(id_column(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(emit, "id bigint, score double")


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from the rows that are not held out."""
    model = train(docs.where(~kept_back("doc_id")), labels)
    found = score(docs, model).withColumn("doc_id", id_back("doc_id"))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return found.select("doc_id", kept_back("doc_id").alias("held_out"), "score", predicted)
