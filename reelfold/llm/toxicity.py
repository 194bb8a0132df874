"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled rows. Segments (words) are weighed
by the number of different contexts, the word before and the word after, in which each class uses them,
so that copies of a document count once. Both dictionaries end with the segments that ordinary text uses
most. Before these, the toxic one has the segments that toxic text uses far more often than ordinary text
does, and the ordinary one the next usual ones of the same size, so that ordinary text is compressed
alike. Every window of whole words is compressed with both; one that the toxic dictionary shortens is
closer to toxic text. The differences of all windows of a text (their sum for each byte, the largest, how
many reach a threshold) go through a logistic function that is calibrated on the sample, with the classes
weighted as they occur among all labelled rows.

Scoring is one pass over whole texts without a shuffle. Rows: a null or empty text has no difference and
its score is the calibrated one for that; without labelled rows of both classes every score is 0; rows
without id are not learnt from and not held out; a document with several labels counts as toxic if one of
them does; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reelfold.llm.tables import in_batches
from reelfold.llm.samples import labelled_sample

WINDOW = 48  # bytes; a window ends with the word that reaches them
LEVEL = 9
ORDINARY_BYTES = 16_384
TOXIC_BYTES = 8_192
PER_CLASS = 2000
MIN_EVIDENCE = 12.0  # log-likelihood ratio of a segment's use by the two classes
MIN_RATIO = 8.0  # how much more often toxic text uses it


def _contexts(texts: list[str], number: dict[bytes, int]) -> np.ndarray:
    """For each word of ``number``, which grows, in how many different contexts it stands."""
    seen = []
    for text in texts:
        words = text.lower().encode().split()
        ids = np.fromiter(
            (number.setdefault(w, len(number)) for w in words), np.uint64, len(words)
        ) + np.uint64(1)
        padded = np.r_[np.uint64(0), ids, np.uint64(0)]
        # 24 bits of the word, 20 of each neighbour
        seen.append(ids << np.uint64(40) | (padded[:-2] & np.uint64(0xFFFFF)) << np.uint64(20) | padded[2:] & np.uint64(0xFFFFF))
    different = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
    return np.bincount((different >> np.uint64(40)).astype(np.int64), minlength=len(number) + 1)[1:]


def _filled(words: list[bytes], size: int) -> bytes:
    """The first words that fit; the best come last, where references are shortest."""
    taken, used = [], 0
    for w in words:
        used += len(w) + 1
        if used > size:
            break
        taken.append(w)
    return b" ".join(reversed(taken))


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and of the ordinary dictionary."""
    number: dict[bytes, int] = {}
    a = _contexts(toxic, number).astype(float)
    b = _contexts(ordinary, number).astype(float)
    a = np.r_[a, np.zeros(len(b) - len(a))]
    words = list(number)
    of_a, of_b = max(a.sum(), 1.0), max(b.sum(), 1.0)
    share = of_a / (of_a + of_b)
    both = a + b
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (
            np.where(a > 0, a * np.log(a / (both * share)), 0)
            + np.where(b > 0, b * np.log(b / (both * (1 - share))), 0)
        )
    ratio = (a / of_a) / ((b + 0.5) / of_b)
    marked = (evidence >= MIN_EVIDENCE) & (ratio >= MIN_RATIO)
    weight = a * np.log(np.maximum(ratio, 1e-9))
    order = lambda key: sorted(range(len(words)), key=lambda i: (-key[i], words[i]))
    strong = _filled([words[i] for i in order(weight) if marked[i]], TOXIC_BYTES)
    ordinary_words = [words[i] for i in order(b) if not marked[i] and b[i] > 1]
    usual = _filled(ordinary_words, ORDINARY_BYTES)
    next_ones = _filled(ordinary_words[len(usual.split()) :], len(strong) + 1)
    return strong + b" " + usual, next_ones + b" " + usual


def windows(text: str) -> list[bytes]:
    """Whole words in lower case, about ``WINDOW`` bytes together; a text without words has one."""
    out: list[bytes] = []
    held: list[bytes] = []
    size = 0
    for word in text.lower().encode().split():
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            out.append(b" %b " % b" ".join(held))
            held, size = [], 0
    if held or not out:
        out.append(b" %b " % b" ".join(held))
    return out


class Model:
    def __init__(self, toxic: list[str], ordinary: list[str], toxic_share: float):
        self.dictionaries = train_dictionaries(toxic, ordinary)
        x = np.array([self.features(t) for t in toxic + ordinary])
        y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
        weight = np.where(y > 0, toxic_share / len(toxic), (1 - toxic_share) / len(ordinary))
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = _logistic((x - self.center) / self.scale, y, weight * len(y))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}

    def _compressors(self):
        if not hasattr(self, "_tools"):
            import zstandard

            def tool(content: bytes):
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False,
                    write_dict_id=False,
                ).compress

            self._tools = [tool(c) for c in self.dictionaries]
        return self._tools

    def features(self, text: str) -> list[float]:
        toxic, ordinary = self._compressors()
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)])
        total, n = float(saved.sum()), max(len(text), 1)
        return [
            100 * total / n, total / math.sqrt(n), float(saved.max()), float(saved.mean()), math.log(n),
            *[100 * float((saved >= t).sum()) / n for t in (1, 2, 3, 4, 5)],
        ]

    def score(self, texts: list[str]) -> np.ndarray:
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one the constant) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fold(id_col: str, of: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def fit(
    docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS,
) -> Model | None:
    """A model of at most ``per_class`` labelled rows of each class, none of the fold ``held_out``."""
    marks = (
        labels.filter(F.col(label_col).isNotNull() & (fold(id_col, folds) != held_out))
        .groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_toxic"))
    )
    counts = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    sample = labelled_sample(docs, "_toxic", id_col, text_col, per_class, marks=marks)
    toxic, ordinary = ([t for _, t, y in sample if y == mark] for mark in (1, 0))
    if not toxic or not ordinary:
        return None
    return Model(toxic, ordinary, counts[1] / (counts[0] + counts[1]))


def toxicity(
    docs: DataFrame, model: Model | None, held_out: int = 0, folds: int = 5, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its text alone."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            scores = model.score(texts) if model and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                    pa.array((scores >= 0.5).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    ])
    held = F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("_held_out")
    return docs.select(F.col(id_col), held, F.col(text_col)).transform(in_batches, predict, schema)
