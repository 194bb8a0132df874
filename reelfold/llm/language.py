"""Language identification in two steps: the family first, then the language within it.

Texts become counts of hashed character trigrams, square-rooted and scaled to length one. Linear support
vector machines, one for each pair of families and one for each pair of languages of a family, are fitted
on a bounded sample of labelled rows. A text gets the family that wins most of its pairs and then the
language of that family that wins most, so closely related languages are told apart by machines that saw
only them. Prediction is one pass over whole texts without a shuffle.

Rows: a null text, or one without a letter, is ``und`` with score 0; without any labelled row every text
is. Repeated rows get equal answers; rows without id are not learnt from and not held out; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reelfold.llm.tables import in_batches
from reelfold.llm.samples import labelled_sample

UNKNOWN = "und"
DIMS = 4096
PER_LANGUAGE = 400
#: ISO 639-1 codes by family. A language not listed makes a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz",
    "celtic": "ga cy gd br", "indic": "hi mr ne bn pa gu", "dravidian": "ta te kn ml",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32  # one mark for all that is no letter
_SPACES = None


def trigrams(text: str) -> np.ndarray:
    """Scaled counts of the whole text's trigrams."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), "<u4").astype(np.uint32)
    low = codes < 128
    codes[low] = _PLAIN[codes[low]]
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77) ^ codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(20), minlength=DIMS).astype(np.float64)
    counts[_blank()] = 0  # runs of marks say nothing
    counts = np.sqrt(counts)
    size = np.linalg.norm(counts)
    return counts / size if size else counts


def _blank() -> int:
    global _SPACES
    if _SPACES is None:
        s = np.full(1, 32, np.uint32)
        mixed = s * np.uint32(0x9E3779B1) ^ s * np.uint32(0x85EBCA77) ^ s * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        _SPACES = int(mixed[0] >> np.uint32(20))
    return _SPACES


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one the constant) of a linear support vector machine, y of -1 and 1.

    Dual coordinate descent on the squared hinge loss, rows of the rarer class weighing more.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * weight)
    square = (x * x).sum(axis=1) + diagonal
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (x[i] @ w) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                largest = max(largest, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if largest < 1e-3:
            break
    return w


class Duels:
    """One machine for each pair of classes."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        machines = []
        for a, b in self.pairs:
            of_a, of_b = labels == self.classes[a], labels == self.classes[b]
            rows = of_a | of_b
            machines.append(linear_svm(x[rows], np.where(of_a[rows], 1.0, -1.0)))
        self.weights = np.array(machines).reshape(len(self.pairs), x.shape[1] + 1)

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The class of each row that wins most duels (ties: by the sum of margins), and how surely: the
        closest of its duels on a scale of 0 to 1."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n = len(self.classes)
        wins, sums, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            for c, m in ((a, margins[:, k]), (b, -margins[:, k])):
                wins[:, c] += m > 0
                sums[:, c] += m
                least[:, c] = np.minimum(least[:, c], m)
        best = np.argmax(wins + np.tanh(sums / 1000) / 2, axis=1)
        sure = 1 / (1 + np.exp(-2 * np.minimum(least[np.arange(len(x)), best], 50)))
        return [self.classes[c] for c in best], sure


class Model:
    """Families, then languages within each."""

    def __init__(self, texts: list[str], languages: list[str], families: dict[str, str] = _FAMILY):
        x = np.array([trigrams(t) for t in texts])
        langs = np.array(languages, object)
        kinds = np.array([families.get(c, c) for c in languages], object)
        self.families = Duels(x, kinds)
        self.within = {f: Duels(x[kinds == f], langs[kinds == f]) for f in self.families.classes}

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.zeros(0)
        x = np.array([trigrams(t) for t in texts])
        families, sure = self.families.decide(x)
        names = [""] * len(texts)
        for family in set(families):
            rows = np.flatnonzero([f == family for f in families])
            found, within = self.within[family].decide(x[rows])
            sure[rows] *= within
            for row, name in zip(rows, found):
                names[row] = name
        return names, sure


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fold(id_col: str, of: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def fit(
    docs: DataFrame, held_out: int = 2, folds: int = 4, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", per_language: int = PER_LANGUAGE,
) -> Model | None:
    """A model of at most ``per_language`` labelled rows a language, none of the fold ``held_out``."""
    rows = docs.select(id_col, text_col, lang_col).filter(fold(id_col, folds) != held_out)
    sample = [
        (t, lang) for _, t, lang in labelled_sample(rows, lang_col, id_col, text_col, per_language)
        if has_letter(t)
    ]
    return Model([t for t, _ in sample], [lang for _, lang in sample]) if sample else None


def identify(
    docs: DataFrame, model: Model | None, held_out: int = 2, folds: int = 4, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, from its text alone."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for at in range(0, len(rows), 500):
                part = rows[at : at + 500]
                found, sure = model.predict([texts[i] for i in part])
                scores[part] = sure
                for i, name in zip(part, found):
                    names[i] = name
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    ])
    held = F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("_held_out")
    return docs.select(F.col(id_col), held, F.col(text_col)).transform(in_batches, predict, schema)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language can't be told."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            rows = [i for i, t in enumerate(texts) if model and has_letter(t)]
            names: list[str] = []
            for at in range(0, len(rows), 500):
                names += model.predict([texts[i] for i in rows[at : at + 500]])[0]
            kept = [i for i, name in zip(rows, names) if name != UNKNOWN]
            yield batch.take(pa.array(kept, pa.int64()))

    return docs.transform(in_batches, keep, docs.schema)
