"""Token ids in files, compressed by a Re-Pair grammar for each segment.

Documents are dealt into shards by ascending id (a range shuffle), sorted, tokenised and written. A
shard is a run of segments of about ``SEGMENT_IDS`` ids that end at document ends. A segment holds a
grammar: frequent neighbouring ids are replaced by a new symbol (a nonterminal), round after round,
until no pair occurs ``MIN_COUNT`` times without overlap, from where on a rule pays for its own bytes.
A round takes up to ``ROUND_RULES`` of the most frequent pairs at once; of two overlapping occurrences the
more frequent pair's is replaced, and pairs that lost too many to others wait for a later round. A round
counts the pairs that may have changed since the last one, not the whole segment, and symbols know their
neighbours, so that the segment is copied only when much of it is gone. The rules, the length that each rule
expands to and the position at every ``STEP``-th symbol are stored, so any range of ids is decoded without the rest.

The files are rows of a Parquet table (shard, segment, before, doc_ids, sizes, grammar), written
through Spark's committer: a task that is run again replaces its own rows only. Bytes of ``grammar``,
all little-endian: magic ``RPG2``; unsigned 32-bit integers first nonterminal, rules, rounds,
symbols, bytes a symbol (2 or 4), STEP; unsigned 64-bit number of ids; then rules of each round
(unsigned 32-bit); left and right side of each rule (as wide as symbols) and its expanded length
(unsigned 32-bit); positions (unsigned 64-bit); symbols.

Rows: null text counts as empty and has its end id; repeated ids are ordered by a hash of their text,
equal rows stand side by side; null ids come first; other columns are not read. An empty table gives
an empty file table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from reelfold.llm.tables import in_batches, stored, totals_before
from reelfold.llm.tokens import encoder, taken

SEGMENT_IDS = 500_000
ROUND_RULES = 1 << 16
MIN_COUNT = 5  # a rule takes 8 bytes at two bytes a symbol, and each use of it saves 2
STEP = 256
RUN_CHARS = 8_000_000  # at most so many characters, or one text, are tokenised together
RUN_ROWS = 20_000
SHORT = 64  # rules of up to so many ids are expanded once for all their uses
_HEAD = struct.Struct("<4s6IQ")
_HASH_BITS = 18
_FEW = 1 << 15  # pairs that are sorted without hashing them first


# --- one grammar --------------------------------------------------------------------------------


def _slots(pairs: np.ndarray) -> np.ndarray:
    mixed = pairs * -0x61C8864680B583EB
    return (mixed >> (64 - _HASH_BITS)) + (1 << (_HASH_BITS - 1))


def _second(pairs: np.ndarray, meet: np.ndarray) -> np.ndarray:
    """Which pairs overlap one of their kind: in a run of one symbol every second one."""
    again = np.zeros(len(pairs), bool)
    again[1:] = (pairs[1:] == pairs[:-1]) & meet
    if not again.any():
        return again
    places = np.arange(len(pairs))
    return (places - np.maximum.accumulate(np.where(again, 0, places))) % 2 == 1


def _order(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Places of pairs in ascending order; sides of ``bits`` bits leave room to sort pair and place in one."""
    room = len(pairs).bit_length()
    if 2 * bits + room > 63:
        return np.argsort(pairs)
    packed = ((pairs >> 32 << bits) | (pairs & 0xFFFFFFFF)) << room | np.arange(len(pairs))
    packed.sort()
    return packed & ((1 << room) - 1)


def _round(
    symbols: np.ndarray, after: np.ndarray, live: np.ndarray, bits: int, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Up to ``most`` pairs (left << 32 | right), the positions to replace and the index of each one's pair.

    ``after`` is the position of the next symbol, ``bits`` what a symbol takes. Only pairs that begin at ``live``
    positions are looked at; those that occur too seldom are taken out of it for good, since no occurrence
    of two old symbols is ever added.
    """
    at = np.flatnonzero(live)
    following = after[at]
    key = symbols[at] << 32 | symbols[following]
    if len(at) > _FEW:
        slot = _slots(key)
        live[at] = often = (np.bincount(slot, minlength=1 << _HASH_BITS) >= MIN_COUNT)[slot]
        full = np.flatnonzero(often)
        at, key, following = at[full], key[full], following[full]
    if not len(at):
        return None
    second = _second(key, at[1:] == following[:-1])
    order = _order(key, bits)
    ordered = key[order]
    begins = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(begins, append=len(ordered))
    counts = sizes - np.add.reduceat(second[order], begins, dtype=np.int64) if second.any() else sizes
    pays = counts >= MIN_COUNT
    pairs, counts = ordered[begins[pays]], counts[pays]
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.where(pays, np.cumsum(pays) - 1, -1), sizes)
    live[at] = paid = group >= 0
    # the rank of a pair: where two overlap, the more frequent one is replaced
    ranked = np.argsort(counts, kind="stable")
    rank = np.empty(len(pairs), np.int64)
    rank[ranked] = np.arange(len(pairs))
    free = np.flatnonzero(paid & ~second)
    at, group, following = at[free], group[free], following[free]
    if most < len(pairs):
        free = np.flatnonzero(rank[group] >= len(pairs) - most)
        at, group, following = at[free], group[free], following[free]
    if not len(at):
        return None
    strength = rank[group]
    meet, left = at[1:] == following[:-1], strength[1:] < strength[:-1]
    wins = np.ones(len(at), bool)
    wins[1:] &= ~(meet & left)
    wins[:-1] &= ~(meet & ~left)
    wins = np.flatnonzero(wins)
    at, group = at[wins], group[wins]
    kept = np.bincount(group, minlength=len(pairs)) >= MIN_COUNT  # the most frequent pair always is
    stay = np.flatnonzero(kept[group])
    return pairs[kept], at[stay], (np.cumsum(kept) - 1)[group[stay]]


def _neighbours(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions before and after each of ``n`` symbols, -1 and ``n`` at the ends; the latter has one before it, too."""
    return np.arange(-1, n), np.arange(1, n + 1)


def compress(ids: np.ndarray, round_rules: int = ROUND_RULES) -> bytes:
    """The grammar of ``ids`` (unsigned 32-bit integers below 2**31) in the format above."""
    symbols = ids.astype(np.int64)
    first = int(symbols.max()) + 1 if len(symbols) else 0
    lefts, rights, per_round = [], [], []
    n_rules = 0
    live = np.ones(len(symbols), bool)  # the pair that begins here may still pay for a rule
    live[-1:] = False
    stays = np.ones(len(symbols), bool)
    n_gone = 0
    before, after = _neighbours(len(symbols))
    while (found := _round(symbols, after, live, (first + n_rules).bit_length(), round_rules)) is not None:
        pairs, at, number = found
        lefts.append(pairs >> 32)
        rights.append(pairs & 0xFFFFFFFF)
        gone = after[at]
        symbols[at] = first + n_rules + number
        live[gone] = stays[gone] = False
        after[at] = following = after[gone]
        before[following] = at
        live[at] = following < len(symbols)
        previous = before[at]
        live[previous[previous >= 0]] = True
        n_gone += len(gone)
        if 8 * n_gone > len(symbols):
            symbols, live = symbols[stays], live[stays]
            stays = np.ones(len(symbols), bool)
            n_gone = 0
            before, after = _neighbours(len(symbols))
        per_round.append(len(pairs))
        n_rules += len(pairs)
    symbols = symbols[stays]
    left = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    right = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    sizes = np.ones(n_rules, np.int64)

    def lengths(of: np.ndarray) -> np.ndarray:
        found = np.ones(len(of), np.int64)
        rule = of >= first
        found[rule] = sizes[of[rule] - first]
        return found

    start = 0
    for n in per_round:  # a rule's sides come from earlier rounds
        part = slice(start, start + n)
        sizes[part] = lengths(left[part]) + lengths(right[part])
        start += n
    ends = np.cumsum(lengths(symbols)) if len(symbols) else np.zeros(0, np.int64)
    positions = np.r_[0, ends][:-1][::STEP] if len(symbols) else ends
    width = 2 if first + n_rules <= 1 << 16 else 4
    return b"".join([
        _HEAD.pack(b"RPG2", first, n_rules, len(per_round), len(symbols), width, STEP, len(ids)),
        np.array(per_round, "<u4").tobytes(), left.astype(f"<u{width}").tobytes(),
        right.astype(f"<u{width}").tobytes(), sizes.astype("<u4").tobytes(),
        positions.astype("<u8").tobytes(), symbols.astype(f"<u{width}").tobytes(),
    ])


class Grammar:
    """A grammar read back; ``ids(start, size)`` expands only the symbols that cover the range."""

    def __init__(self, data: bytes):
        magic, self.first, rules, rounds, n, width, self.step, self.n_ids = _HEAD.unpack_from(data)
        if magic != b"RPG2":
            raise ValueError("not a grammar")
        at = _HEAD.size

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.rounds = take(rounds, "<u4").astype(np.int64)
        sides = f"<u{width}"
        self.left, self.right = take(rules, sides).astype(np.int64), take(rules, sides).astype(np.int64)
        self.sizes = take(rules, "<u4").astype(np.int64)
        self.positions = take(-(-n // self.step), "<u8").astype(np.int64)
        self.symbols = take(n, f"<u{width}")

    def _expand(self, symbols: np.ndarray, longer: int = 0) -> np.ndarray:
        """Symbols with their rules of more than ``longer`` ids replaced."""
        stop = self.first + len(self.left)
        for n in self.rounds[::-1]:
            low = stop - int(n)
            at = np.zeros(0, np.int64)
            if (self.sizes[low - self.first : stop - self.first] > longer).any():
                at = np.flatnonzero((symbols >= low) & (symbols < stop))
                at = at[self.sizes[symbols[at] - self.first] > longer]
            if len(at):
                number = symbols[at] - self.first
                symbols = np.insert(symbols, at + 1, self.right[number])
                symbols[at + np.arange(len(at))] = self.left[number]
            stop = low
        return symbols

    def ids(self, start: int = 0, size: int | None = None) -> np.ndarray:
        size = self.n_ids - start if size is None else size
        if not 0 <= start <= start + size <= self.n_ids:
            raise IndexError(f"{start}, {size} of {self.n_ids} ids")
        if not size:
            return np.zeros(0, "<u4")
        low = int(np.searchsorted(self.positions, start, "right")) - 1
        high = int(np.searchsorted(self.positions, start + size, "left"))
        symbols = self.symbols[low * self.step : high * self.step].astype(np.int64)
        skip = start - int(self.positions[low])
        # long rules part by part, short ones copied from one list of what they stand for
        if (self.sizes > SHORT).any():
            symbols = self._expand(symbols, SHORT)
        short = np.flatnonzero(self.sizes <= SHORT) if len(symbols) > len(self.sizes) else None
        if short is None:
            return self._expand(symbols)[skip : skip + size].astype("<u4")
        begins = np.zeros(len(self.sizes), np.int64)
        begins[short] = len(symbols) + np.cumsum(self.sizes[short]) - self.sizes[short]
        begin, sizes = np.arange(len(symbols)), np.ones(len(symbols), np.int64)
        rules = np.flatnonzero(symbols >= self.first)
        number = symbols[rules] - self.first
        begin[rules], sizes[rules] = begins[number], self.sizes[number]
        pool = np.concatenate([symbols, self._expand(self.first + short)]).astype("<u4")
        return taken(pool, begin, sizes)[skip : skip + size]


# --- files --------------------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], pa.DataType]]:
    """Keys, texts and the keys' type of neighbouring rows, across batches, to be tokenised together."""
    keys, texts, held, kind = [], [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if texts and (held + len(text) > RUN_CHARS or len(texts) >= RUN_ROWS):
                yield keys, texts, kind
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
    if texts:
        yield keys, texts, kind


def file_rows(
    docs: DataFrame, vocabulary: str, end_id: int = 0, shards: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """The rows of the file table; ``shards`` None takes Spark's number of shuffle partitions."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        words = encoder(vocabulary)
        doc_ids: list = []
        ids: list[bytes] = []
        held = 0
        kind = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()), pa.array([segment], pa.int32()),
                    pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                    pa.array([doc_ids], pa.list_(kind)),
                    pa.array([[len(i) // 4 for i in ids]], pa.list_(pa.int64())),
                    pa.array([compress(np.frombuffer(b"".join(ids), "<u4"))], pa.binary()),
                ],
                names=[f.name for f in schema.fields],
            )

        for keys, texts, kind in _runs(batches):
            for key, found in zip(keys, words.encode(texts)):
                size = len(found) // 4 + 1
                if held and held + size > segment_ids:
                    yield row()
                    segment, before, held = segment + 1, before + held, 0
                    doc_ids, ids = [], []
                doc_ids.append(key)
                ids.append(found + end)
                held += size
        if held:
            yield row()

    schema = T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()),
        T.StructField("before", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("grammar", T.BinaryType()),
    ])
    order = ["_id", "_hash"]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    dealt = rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).select("_id", "_text").transform(in_batches, encode, schema)


def write_files(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write the file table below the shared folder and read it back."""
    return stored(file_rows(docs, vocabulary, **options), "grammar-files")


def read_documents(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row for each document of a file table: its ids decoded, and where they start in the corpus."""
    bases = totals_before(files, "shard", {"base": "n_ids"})
    placed = files.join(F.broadcast(bases), "shard").select(
        (F.col("base") + F.col("before")).alias("at"), "doc_ids", "sizes", "grammar"
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.column(0)[row].as_py()
                doc_ids = batch.column(1)[row].values
                sizes = np.array(batch.column(2)[row].as_py(), np.int64)
                data = memoryview(Grammar(batch.column(3)[row].as_py()).ids().tobytes())
                starts = np.cumsum(sizes) - sizes
                parts = [data[4 * s : 4 * (s + n)] for s, n in zip(starts.tolist(), sizes.tolist())]
                columns = {
                    "doc_id": doc_ids, "start": pa.array(at + starts), "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = T.StructType(
        [T.StructField("doc_id", files.schema["doc_ids"].dataType.elementType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )
    return placed.transform(in_batches, decode, schema)
