"""Quality scores: random Fourier features of document statistics, ridge, isotonic calibration.

Statistics of every whole text are computed once. Labelled rows (a hash sample of at most
about ``MAX_LABELLED``, none of them held out) give the scaling, then each partition sums its
normal equations by fold and the driver adds those small matrices. Out-of-fold scores are
calibrated by isotonic regression; the model of all folds scores all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out

#: Labelled rows to learn from; more are thinned out by the hash of their id.
MAX_LABELLED = 40_000
COSINES, WIDTH, RIDGE, FOLDS = 256, 0.35, 1e-3, 4
THRESHOLD = 0.3

_SYMBOL_END = re.compile(r"[^\w\s.,;:!?'\"()-]{2,}")
_URL = re.compile(r"https?://|www\.|[\w.+-]+@[\w-]+\.")
_END = re.compile(r"[.!?]")
NAMES = (
    "log_words", "word_length", "long_words", "short_words", "bar_words", "symbol_words", "repeats", "distinct", "top_share", "line_length", "line_repeats",
    "capitals", "digits", "other", "enders", "links", "accents", "pressed", "one_word_lines", "log_lines",
)


def statistics(text: str | None) -> list[float]:
    """The numbers named by ``NAMES``, over the whole text; of no text, those of no words."""
    text = text or ""
    words, n_chars = text.split(), max(len(text), 1)
    n = max(len(words), 1)
    lengths = [len(w) for w in words]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    line_counts = Counter(lines)
    raw = text.encode("utf-8", "surrogatepass")
    upper = sum(map(str.isupper, map(lambda w: w[:1], words)))
    ascii_letters = sum(raw.count(bytes([c])) for c in b"etaonirsh")
    return [
        np.log1p(len(words)),
        sum(lengths) / n,
        sum(k > 12 for k in lengths) / n,
        sum(k <= 3 for k in lengths) / n,
        counts.get("|", 0) / n,
        len(_SYMBOL_END.findall(text)) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        len(counts) / n**0.8,
        max(counts.values(), default=0) / n,
        np.log1p(len(words) / len(lines)),
        1 - len(line_counts) / len(lines),
        upper / n,
        sum(raw.count(bytes([c])) for c in b"0123456789") / n_chars,
        (n_chars - ascii_letters - text.count(" ")) / n_chars,
        len(_END.findall(text)) / n,
        min(1.0, 10 * len(_URL.findall(text)) / n),
        (len(raw) - len(text)) / n_chars,
        len(zlib.compress(raw, 1)) / max(len(raw), 1),
        sum(" " not in x for x in lines) / len(lines),
        np.log1p(len(lines)),
    ]


def measured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [statistics(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")


def fourier(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosines that approximate a Gaussian kernel, the scaled statistics, and a constant."""
    rng = np.random.default_rng(7)
    z = np.clip((x - scale[0]) / scale[1], -6, 6)
    w = rng.normal(0, WIDTH, (x.shape[1], COSINES))
    return np.hstack([np.cos(z @ w + rng.uniform(0, 2 * np.pi, COSINES)) * (2 / COSINES) ** 0.5, z / 10, np.ones((len(x), 1))])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing means by pooled adjacent violators: (score, mean) at the blocks' ends."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order].astype(float)
    blocks: list[list[float]] = []
    for a, b in zip(s, y, strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    x, v = [], []
    for total, n, a, z in blocks:
        x += [a, z]
        v += [total / n] * 2
    return np.array(x), np.array(v)


class Model:
    def __init__(self, scale, weights, curve):
        self.scale, self.weights, self.curve = scale, weights, curve

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = fourier(x, self.scale) @ self.weights
        # the slight slope orders documents that calibration puts in one block
        return np.clip(0.98 * np.interp(raw, *self.curve) + 0.02 * np.clip(raw, 0, 1), 0, 1)


def fit(labelled: DataFrame, label: str) -> Model | None:
    """``labelled``: (x, label, fold), at most about MAX_LABELLED rows. None without rows."""
    rows = labelled.where(F.col(label).isNotNull())
    size = len(NAMES)
    moments = rows.select(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(size)), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(size))).first()
    if moments["m0"] is None:
        return None
    scale = np.array([moments[f"m{i}"] for i in range(size)]), np.array([max(moments[f"s{i}"], 1e-6) for i in range(size)])

    def sums(batches):
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64)
            y, fold = np.array(batch.column(1).to_pylist(), dtype=np.float64), np.array(batch.column(2).to_pylist())
            z = fourier(x, scale) if len(x) else np.zeros((0, 1))
            for f in np.unique(fold):
                zf, yf = z[fold == f], y[fold == f]
                a, b = held.setdefault(int(f), [0.0, 0.0])
                held[int(f)] = [a + zf.T @ zf, b + zf.T @ yf]
        for f, (a, b) in held.items():
            yield pa.RecordBatch.from_pydict({"fold": pa.array([f], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()]})

    # a row of fixed size per partition and fold
    parts = rows.select("x", F.col(label).cast("double"), "fold").coalesce(16).mapInArrow(sums, "fold int, a binary, b binary").collect()
    side = COSINES + size + 1
    a, b = np.zeros((FOLDS, side, side)), np.zeros((FOLDS, side))
    for r in parts:
        a[r["fold"]] += np.frombuffer(r["a"]).reshape(side, side)
        b[r["fold"]] += np.frombuffer(r["b"])

    def solve(a, b):
        return np.linalg.solve(a + RIDGE * max(a[-1, -1], 1) * np.eye(side), b)

    sample = rows.select("x", F.col(label).cast("double").alias("y"), "fold").collect()  # bounded by MAX_LABELLED
    x, y, fold = np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample]), np.array([r["fold"] for r in sample])
    z, raw = fourier(x, scale), np.zeros(len(x))
    for f in range(FOLDS):
        if (fold == f).any():
            raw[fold == f] = z[fold == f] @ solve(a.sum(0) - a[f], b.sum(0) - b[f])
    return Model(scale, solve(a.sum(0), b.sum(0)), isotonic(raw, y))


def trained(docs: DataFrame, labels: DataFrame, label: str) -> Model | None:
    """The model of the labelled documents; None if there are none."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    share = min(1.0, MAX_LABELLED / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)).withColumnRenamed("doc_id", "_id")
    # at most about MAX_LABELLED rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    stats = measured(sample.select("doc_id", "text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return fit(scratch.write(stats.select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")), "labelled"), "y")


def scores_of(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return model.score(np.array([statistics(x) for x in texts], dtype=np.float64))


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Labels of held-out documents, null labels and labels without document are not learned
    from. A null text counts as empty. Without any label every score is 0.5. Repeated rows
    are scored each; a null doc_id is scored and not held out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, label))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores_of(sent.value, part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text reaches the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, label))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array(scores_of(sent.value, part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
