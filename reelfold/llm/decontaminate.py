"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of neighbouring texts of about ``SHARD_CHARS`` characters, read and indexed where it
lies; nothing is shuffled. Its words become symbols: the benchmark's words, and one separator for all
others. Stretches of benchmark words shorter than the shortest phrase can't hold one and are left out;
every separator is unique, so suffixes end there. The suffixes are sorted, the symbols before them stand
in a wavelet tree, and a phrase is searched backwards: each word narrows its range of suffixes by two rank
queries. All phrases of a shard are searched at once. Occurrences are located by walking to a suffix whose
position is stored (every ``SAMPLE``-th and the first of a stretch), and overlapping ones are merged to
spans.

The benchmark is collected in blocks of ``BLOCK_BYTES``, so a task holds the phrases of one block at a
time however long the benchmark is; the blocks are passed one after another in the same stage.

Rows: null text has no words; a text without words has none either and is clean; repeated rows are
repeated; a benchmark item without words has no phrase, several rows of one item count as one item, and an
item without id is named by the empty string; other columns are not read. An empty benchmark leaves all
clean; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reelfold.llm.tables import in_batches
from reelfold.llm.tokens import text_runs

WINDOW = 10
SHARD_CHARS = 12_000_000
SAMPLE = 16
BLOCK_BYTES = 8_000_000
_LOCATE_AT_ONCE = 1 << 19
# ASCII letters and digits and all other characters make words; A-Z count as a-z
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


# --- phrases ------------------------------------------------------------------------------------


@dataclass
class Phrases:
    """Windows of a block of items, grouped by length, and the items that each one comes from."""

    symbol: dict[bytes, int]  # from 1
    windows: list[np.ndarray]  # one matrix of symbols for each length
    items: list[list[list[str]]]  # for each row of each matrix

    @property
    def shortest(self) -> int:
        return min(w.shape[1] for w in self.windows)


def phrases(rows: list[tuple[str, str | None]], window: int = WINDOW) -> Phrases | None:
    """Windows of ``window`` words of (item, text) rows; a shorter item is one window. None: no words."""
    symbol: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in rows:
        symbols = [symbol.setdefault(w, len(symbol) + 1) for w in words_of(text)]
        for at in range(max(1, len(symbols) - window + 1) if symbols else 0):
            found.setdefault(tuple(symbols[at : at + window]), set()).add(item)
    if not found:
        return None
    lengths = sorted({len(w) for w in found})
    by_length = [[w for w in found if len(w) == n] for n in lengths]
    return Phrases(
        symbol, [np.array(g, np.int64) for g in by_length], [[sorted(found[w]) for w in g] for g in by_length]
    )


# --- index --------------------------------------------------------------------------------------


class _Bits:
    """A bit vector with rank: set bits before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class FmIndex:
    """Index of ``text``: symbols from 1, and 0 for separators, each of them different from the others.

    ``text`` begins and ends with a separator. Positions count from 0.
    """

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        n = len(text)
        suffixes = _sorted_suffixes(text)
        self.n = n
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols + 1))]
        before = text[suffixes - 1]  # the suffix at 0 is a separator, and so is the symbol at the end
        # wavelet tree, one bit of the symbols a level, symbols with a clear bit first in the next
        self.levels: list[tuple[int, _Bits, int]] = []
        for shift in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bit = (before >> shift & 1).astype(bool)
            self.levels.append((shift, _Bits(bit), int(n - bit.sum())))
            before = np.r_[before[~bit], before[bit]]
        # stored positions: of every sample-th symbol of a stretch, from its first
        gaps = np.flatnonzero(text == 0)
        into = np.arange(n) - gaps[np.searchsorted(gaps, np.arange(n), "right") - 1] - 1
        kept = (into % sample == 0)[suffixes]
        self.kept = _Bits(kept)
        self.positions = suffixes[kept]

    def _place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the first ``at`` suffixes."""
        return self._place(symbol, at) - self._place(symbol, np.zeros_like(at))

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``windows`` that occur, and the range of suffixes that begin with each."""
        rows = np.arange(len(windows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n)
        for column in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[rows, column]
            low = self.first[symbol] + self.rank(symbol, low)
            high = self.first[symbol] + self.rank(symbol, high)
            some = low < high
            rows, low, high = rows[some], low[some], high[some]
        return rows, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes that begin within a stretch."""
        at = at.copy()
        steps = np.zeros(len(at), np.int64)
        todo = np.flatnonzero(self.kept.get(at) == 0)
        while len(todo):
            i, symbol = at[todo], np.zeros(len(todo), np.int64)
            for _, bits, zeros in self.levels:
                bit, ones = bits.get(i), bits.rank(i)
                symbol = symbol << 1 | bit
                i = np.where(bit, zeros + ones, i - ones)
            at[todo] = self.first[symbol] + i - self._place(symbol, np.zeros_like(i))
            steps[todo] += 1
            todo = todo[self.kept.get(at[todo]) == 0]
        return self.positions[self.kept.rank(at)] + steps


def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; ranks by 1, 2, 4 ... symbols until all differ."""
    n = len(text)
    gap = text == 0
    rank = np.where(gap, np.cumsum(gap) - 1, text + int(gap.sum()) - 1).astype(np.int64)
    width = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        if width < n:
            ahead[: n - width] = rank[width:]
        key = rank * (int(rank.max()) + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        steps = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        width *= 2


# --- shards -------------------------------------------------------------------------------------


def _stretches(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The text to index: stretches of non-zero symbols of ``shortest`` or more between separators, and
    the place of each symbol in ``symbols``."""
    edge = np.diff(np.r_[0, symbols != 0, 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= shortest
    starts, sizes = starts[long], (ends - starts)[long]
    text = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int64)
    place = np.full(len(text), -1, np.int64)
    first = np.cumsum(sizes + 1) - sizes  # where each stretch begins in the text
    inside = np.repeat(first, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place[inside] = np.repeat(starts, sizes) + inside - np.repeat(first, sizes)
    text[inside] = symbols[place[inside]]
    return text, place


def search_texts(
    texts: list[str | None], found: Phrases
) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: its number of words, merged spans of occurring phrases in words, and their items."""
    get = found.symbol.get
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = words_of(text)
        sizes[i] = len(words)
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        parts.append(np.zeros(1, np.int64))  # no phrase goes from one text to the next
    symbols = np.concatenate(parts)
    starts = np.cumsum(sizes + 1) - sizes - 1
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    text, place = _stretches(symbols, found.shortest)
    if len(text) < 2:
        return sizes, spans, items
    index = FmIndex(text, len(found.symbol))
    edges = np.zeros(len(symbols) + 1, np.int64)
    for windows, names in zip(found.windows, found.items):
        rows, low, high = index.search(windows)
        counts = high - low
        ends = np.cumsum(counts)
        at = 0
        while at < len(rows):  # so many windows that their occurrences fit
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _LOCATE_AT_ONCE, "right")))
            n = counts[at:stop]
            suffix = np.repeat(low[at:stop], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            where = place[index.locate(suffix)]
            np.add.at(edges, where, 1)
            np.add.at(edges, where + windows.shape[1], -1)
            doc = np.searchsorted(starts, where, "right") - 1
            for key in np.unique(doc * len(windows) + np.repeat(rows[at:stop], n)).tolist():
                items[key // len(windows)].update(names[key % len(windows)])
            at = stop
    covered = np.diff(np.r_[0, np.cumsum(edges) > 0, 0])
    begins, stops = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    doc = np.searchsorted(starts, begins, "right") - 1
    for d, a, b in zip(doc.tolist(), (begins - starts[doc]).tolist(), (stops - starts[doc]).tolist()):
        spans[d].append((a, b))
    return sizes, spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Phrases]:
    rows = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = math.ceil(size / BLOCK_BYTES)
    for n in range(count):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == n)
        found = phrases([tuple(r) for r in part.collect()], window)  # BLOCK_BYTES on average
        if found:
            yield found


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, spans, items): merged spans [start, end) in words, and the items that occur."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def search(found: Phrases | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                sizes, spans, items = [], [], []
                for a, b in text_runs([t or "" for t in texts], SHARD_CHARS):
                    if found is None:
                        sizes += [len(words_of(t)) for t in texts[a:b]]
                        spans += [[] for _ in range(a, b)]
                        items += [set() for _ in range(a, b)]
                        continue
                    n, s, i = search_texts(texts[a:b], found)
                    sizes += n.tolist()
                    spans += s
                    items += i
                for i, old in enumerate(old_spans):
                    if old:
                        spans[i] = _merged(spans[i], [(o["start"], o["end"]) for o in old])
                        items[i].update(old_items[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], span),
                        pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text", "n_words", "spans", "items"],
                )

        return run

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        ]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ])
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.lit(None).cast("bigint").alias("n_words"),
        F.array().cast(schema["spans"].dataType).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    blocks = list(_blocks(benchmark, item_col, item_text_col, window)) or [None]
    for block in blocks:
        rows = rows.transform(in_batches, search(block), schema)
    return rows.drop("text")


def digest(found: DataFrame) -> DataFrame:
    """Words hit and a hash of the items, for every document."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text"
) -> DataFrame:
    """``docs`` without the rows in which a phrase of the benchmark occurs, in one pass without a shuffle."""

    def keep(found: Phrases):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                clean = []
                for a, b in text_runs([t or "" for t in texts], SHARD_CHARS):
                    spans = search_texts(texts[a:b], found)[1]
                    clean += [a + i for i, s in enumerate(spans) if not s]
                yield batch.take(pa.array(clean, pa.int64()))

        return run

    for block in _blocks(benchmark, "item_id", "text", window):
        docs = docs.transform(in_batches, keep(block), docs.schema)
    return docs
