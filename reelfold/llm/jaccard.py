"""Jaccard join of shingle sets by signature trees.

Sets are compared inside families. Two sets whose similarity reaches 85 % differ in at most 15/185 of
their sizes together, so if hash ranges cut the shingle space into more sections than that, a section
with shingles in it is the same in both. Each set has keys of its fullest sections, just enough of them (a
set near the upper end of its size class has those of the next class as well), and sets with a key in
common form a family; keys meet as two integers, in one shuffle, and each key hands on one link a set. Sets that are no family never
leave the place they were read at.

A family is searched with a signature tree. Its leaves hold a bitmap of the set's shingles, as far as
another set of the family has them, and the set's size; the nodes above hold the OR of their bitmaps and
the range of their sizes. A dual traversal from the top drops a pair of nodes, with all pairs below, where
the sizes or the largest overlap their bitmaps allow are out of reach, or where everything below is
connected already. Bitmaps are exact while they fit ``BITMAPS`` bytes; folded beyond, with the shingles
that fell together counted as possible overlap and the pairs that come through compared shingle by shingle.

A family of more than ``BLOCK`` shingles is dealt to blocks. Each is searched together with the first one,
which connects a true family. Only if it stays in several components, the sets outside the largest meet
the other blocks, block by block. Equal sets are one set, and no pair of a family is ever written.

Rows: texts without words, and null ones, have no shingles and are linked with nothing; a text of fewer
words than a shingle is one shingle. Repeated rows are one document, and so are rows of one id with
different texts: what any of them is linked with, all are, each with the size of its own set. Rows without id link
nothing; they get the component of the documents with the same set, null if there are none. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reelfold.llm.graph import components
from reelfold.llm.simhash import _union, shingle_digests
from reelfold.llm.tables import in_batches, stored
from reelfold.operators.skew import join_unique

SHINGLE = 4
PERCENT = 85
BLOCK = 1_000_000  # shingles of a block
BITMAPS = 1 << 25  # bytes of the leaves' bitmaps of a block
_RATIO = 1.5  # of a size class's bounds
_FAN = 8
_WORDS_AT_ONCE = 1 << 20  # of bitmaps compared
_TOKENS_AT_ONCE = 1 << 20  # of sets keyed together


# --- sets and their section keys ----------------------------------------------------------------


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, each once, in order."""
    return np.unique(shingle_digests(text, shingle).view(">u8").ravel().astype(np.uint64))


def digest(hashes: np.ndarray) -> bytes:
    """Equal for equal sets."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=16).digest()


def _class_bounds() -> list[int]:
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * _RATIO)))
    return bounds


_BOUNDS = _class_bounds()


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers scrambled (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def most_different(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that are in one of two linked sets only, for the sum of their sizes."""
    return (100 - percent) * sizes // (100 + percent)


def _classes(size: int, percent: int) -> list[int]:
    """Size classes whose section keys a set has: its own, and the one above if that has partners."""
    own = bisect_right(_BOUNDS, size) - 1
    return [own, own + 1] if size * 100 // percent >= _BOUNDS[own + 1] else [own]


def section_keys(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the set of each): two sets that reach ``percent`` have a key in common.

    A set that may differ from a partner in d sections has keys of its fullest ones only: of all that hold
    t or more shingles, with the largest t that leaves more than d of them. One of those is the same in the
    partner. Of two sets with different t, the larger t holds for both.
    """
    owners, numbers = [], []
    for i, s in enumerate(sets):
        for number in _classes(len(s), percent) if len(s) else []:
            owners.append(i)
            numbers.append(number)
    if not owners:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    largest = np.array([_BOUNDS[c + 1] - 1 for c in numbers], np.int64)
    sections = most_different(2 * largest, percent)
    sections += 2 + sections * 15 // 100  # some to spare, so that thin ones can be left out
    sizes = np.array([len(sets[i]) for i in owners], np.int64)
    differ = most_different(sizes + np.minimum(largest, sizes * 100 // percent), percent)
    entry = np.repeat(np.arange(len(owners)), sizes)
    tokens = np.concatenate([sets[i] for i in owners])
    section = ((tokens >> np.uint64(32)) * sections[entry].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, (entry[1:] != entry[:-1]) | (section[1:] != section[:-1])])
    content = np.add.reduceat(_mixed(tokens), starts)
    held = np.diff(np.r_[starts, len(tokens)])
    entry, section = entry[starts], section[starts]
    filled = np.bincount(entry, minlength=len(owners))
    fullest = held[np.lexsort((-held, entry))]  # of each entry from the fullest section down
    enough = filled > differ
    at = np.minimum(np.cumsum(filled) - filled + differ, len(held) - 1)
    least = np.where(enough, fullest[at], 0)
    kept = held >= least[entry]
    entry, section, content = entry[kept], section[kept], content[kept]
    # sets that might differ in every section that is not empty have keys of their empty ones, too
    for e in np.flatnonzero(~enough).tolist():
        blank = np.setdiff1d(np.arange(sections[e]), section[entry == e])
        entry = np.r_[entry, np.full(len(blank), e)]
        section = np.r_[section, blank]
        content = np.r_[content, np.zeros(len(blank), np.uint64)]
    place = np.array(numbers, np.int64)[entry] << 32 | section
    keys = _mixed(content ^ _mixed(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return keys, np.array(owners, np.int64)[entry]


def _chunks(sets: list[np.ndarray]) -> Iterator[slice]:
    start, held = 0, 0
    for i, s in enumerate(sets):
        held += len(s)
        if held >= _TOKENS_AT_ONCE:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sets):
        yield slice(start, len(sets))


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.ListArray:
    """``values`` as one list for each row; ``owner`` in order."""
    ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def keyed_sets(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, size, keys, links) of every row.

    Rows of a batch that share a key are linked at once, and only the one of smallest id keeps it, so a key
    that much of the table has leaves each batch once.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sets = [shingle_set(t, shingle) for t in batch.column(1).to_pylist()]
            known = [i for i, (d, s) in enumerate(zip(ids, sets)) if d is not None and len(s)]
            found = [section_keys([sets[i] for i in known[c]], percent) for c in _chunks([sets[i] for i in known])]
            at = np.cumsum([0] + [c.stop - c.start for c in _chunks([sets[i] for i in known])])
            key = np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)])
            row = np.concatenate([o + a for (_, o), a in zip(found, at)] or [np.zeros(0, np.int64)])
            row = np.array(known, np.int64)[row] if len(row) else row
            number = np.array([0 if d is None else d for d in ids], np.int64)
            order = np.lexsort((number[row], key)) if len(row) else np.zeros(0, np.int64)
            key, row = key[order], row[order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            first = row[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else row
            pairs = np.unique(np.stack([row, number[first]])[:, number[row] != number[first]], axis=1)
            held = np.argsort(row[new], kind="stable")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), pa.array([digest(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    _lists(key[new][held].view(np.int64), row[new][held], len(sets)),
                    _lists(pairs[1], pairs[0], len(sets)),
                ],
                names=["doc_id", "digest", "size", "keys", "links"],
            )

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).transform(
        in_batches, compute, "doc_id bigint, digest binary, size bigint, keys array<bigint>, links array<bigint>"
    )


def family_links(keyed: DataFrame) -> DataFrame:
    """(u, v): every document with the one of smallest id for each of its keys."""
    of_key = Window.partitionBy("key")
    met = keyed.select(F.explode("keys").alias("key"), F.col("doc_id").alias("u"))
    met = met.withColumn("v", F.min("u").over(of_key)).filter(F.col("u") != F.col("v")).select("u", "v")
    return met.unionByName(keyed.select(F.col("doc_id").alias("u"), F.explode("links").alias("v")))


# --- the tree of one family ---------------------------------------------------------------------


def tree_labels(sets: list[np.ndarray], labels: np.ndarray, percent: int = PERCENT, bitmaps: int = BITMAPS) -> np.ndarray:
    """For each set the smallest index that links of ``percent`` and ``labels`` (indices of sets that are
    connected already) lead to."""
    full = _union(np.arange(len(sets)), np.arange(len(sets)), labels)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, token, count = np.unique(tokens, return_inverse=True, return_counts=True)
    common = count >= 2  # a shingle of one set alone is in no overlap
    row = np.repeat(np.arange(len(sets)), sizes)[common[token]]
    bit = (np.cumsum(common) - 1)[token[common[token]]]
    held = np.bincount(row, minlength=len(sets))
    able = np.flatnonzero((100 * held >= percent * sizes) & (sizes > 0))
    if len(able) < 2:
        return full
    # similar sets side by side: by their smallest hashes
    starts = np.r_[0, np.cumsum(held)]
    low, next_low = bit[starts[able]], bit[np.minimum(starts[able] + 1, len(bit) - 1)]
    able = able[np.lexsort((sizes[able], next_low, low))]
    place = np.full(len(sets), -1)
    place[able] = np.arange(len(able))
    row, bit = place[row], bit[place[row] >= 0]
    row = row[row >= 0]
    n, width = len(able), int(common.sum())
    exact = n * width <= 8 * bitmaps
    if not exact:
        width = max(64, 8 * bitmaps // n)
        bit = bit % width
    words = -(-width // 64)
    leaves = np.zeros((n, words), np.uint64)
    np.bitwise_or.at(leaves, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    size = sizes[able]
    spare = held[able] - np.bitwise_count(leaves).sum(axis=1, dtype=np.int64)
    levels = [(leaves, size, size, spare)]  # bitmap, smallest and largest size, shingles that fell together
    while len(levels[-1][1]) > 1:
        maps, least, most, more = levels[-1]
        at = np.arange(0, len(least), _FAN)
        levels.append((
            np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(least, at),
            np.maximum.reduceat(most, at), np.maximum.reduceat(more, at),
        ))
    mine = _union(np.arange(n), np.arange(n), _first_of(full[able]))
    ranges: list[tuple[np.ndarray, np.ndarray]] = []

    def look_up_labels() -> None:
        ranges[:] = [(mine, mine)]
        for _ in levels[1:]:
            at = np.arange(0, len(ranges[-1][0]), _FAN)
            ranges.append((np.minimum.reduceat(ranges[-1][0], at), np.maximum.reduceat(ranges[-1][1], at)))

    def possible(level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a pair of sets below the nodes can be linked and is not connected yet."""
        maps, least, most, more = levels[level]
        first, last = ranges[level]
        good = (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
        good &= (100 * most[i] >= percent * least[j]) & (100 * most[j] >= percent * least[i])
        at = np.flatnonzero(good)
        overlap = np.bitwise_count(maps[i[at]] & maps[j[at]]).sum(axis=1, dtype=np.int64)
        overlap += np.minimum(more[i[at]], more[j[at]])
        good[at] = (100 + percent) * overlap >= percent * (least[i[at]] + least[j[at]])
        return good

    look_up_labels()
    step = np.arange(_FAN)
    at_once = max(1, _WORDS_AT_ONCE // (words * _FAN * _FAN))  # pairs of nodes looked into together
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, left, right = todo.pop()
        if level == 0:
            left, right = left[mine[left] != mine[right]], right[mine[left] != mine[right]]
            if not exact:
                kept = []
                for k, (a, b) in enumerate(zip(able[left], able[right])):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if (100 + percent) * both >= percent * (len(sets[a]) + len(sets[b])):
                        kept.append(k)
                left, right = left[kept], right[kept]
            if len(left):
                mine = _union(mine, left, right)
                look_up_labels()
            continue
        if len(left) > at_once:
            todo += [(level, left[at_once:], right[at_once:]), (level, left[:at_once], right[:at_once])]
            continue
        children = len(levels[level - 1][1])
        i = np.repeat(left[:, None] * _FAN + step, _FAN, axis=1).ravel()
        j = np.tile(right[:, None] * _FAN + step, _FAN).ravel()
        real = (i < children) & (j < children) & ((i < j) if level == 1 else (i <= j))
        i, j = i[real], j[real]
        near = possible(level - 1, i, j)
        i, j = i[near], j[near]
        within = i == j
        for part in (~within, within):  # a node with itself first: what that connects need not meet again
            if part.any():
                todo.append((level - 1, i[part], j[part]))
    return _union(full, able, able[mine])


def _first_of(values: np.ndarray) -> np.ndarray:
    """For each value the index of its first occurrence."""
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    return first[which]


# --- families over the cluster ------------------------------------------------------------------


def _distinct_in_batches(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without what a batch repeats, so a row that much of the table repeats does
    not meet itself in one task."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            ids, texts = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return in_batches(docs, compute, "doc_id bigint, text string")


def _with_texts(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """A merge join at every size: texts of a hot id are split, and cells are as many as near copies."""
    return texts.join(cells.hint("merge"), "doc_id")


def _search(cells: DataFrame, shingle: int, percent: int, bitmaps: int) -> DataFrame:
    """(u, v) links that connect what is linked within each cell of (family, cell, label, doc_id, digest,
    text); rows of a cell with equal ``label`` are connected already."""

    def links(ids: list[int], labels: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        known = _first_of(np.array(labels, np.int64))
        found = tree_labels(sets, known, percent, bitmaps)
        number = np.array(ids, np.int64)
        new = np.flatnonzero(found != np.arange(len(found)))
        return pa.RecordBatch.from_arrays(
            [pa.array(number[new]), pa.array(number[found[new]])], names=["u", "v"]
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, last, ids, labels, sets = None, None, [], [], []
        for batch in batches:
            for family, number, label, i, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (family, number) != cell:
                    if len(ids) > 1:
                        yield links(ids, labels, sets)
                    cell, last, ids, labels, sets = (family, number), None, [], [], []
                if mark == last:
                    continue
                found = shingle_set(text, shingle)
                if digest(found) == mark:  # not another text of the same id
                    last = mark
                    ids.append(i)
                    labels.append(label)
                    sets.append(found)
        if len(ids) > 1:
            yield links(ids, labels, sets)

    return (
        cells.repartition("family", "cell").sortWithinPartitions("family", "cell", "digest")
        .select("family", "cell", "label", "doc_id", "digest", "text")
        .transform(in_batches, search, "u bigint, v bigint")
    )


def _sets_of_one_id(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): ids that have several sets, with the document that stands for each."""
    known = keyed.filter(F.col("doc_id").isNotNull() & (F.col("size") > 0)).select("doc_id", "digest")
    several = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    rows = known.join(several.filter("a <> b").select("doc_id"), "doc_id", "left_semi").distinct()
    return rows.join(sets.select("digest", F.col("doc_id").alias("v")), "digest").select(F.col("doc_id").alias("u"), "v")


def _members(sets: DataFrame, families: DataFrame, block: int) -> DataFrame:
    """(family, doc_id, digest, size, blocks, block): the different sets of every family that has two."""
    rows = sets.join(families.withColumnsRenamed({"node": "doc_id", "root": "family"}), "doc_id")
    totals = rows.groupBy("family").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("shingles"))
    totals = totals.filter(F.col("sets") > 1).select(
        "family", F.ceil(F.col("shingles") / block).cast("int").alias("blocks")
    )
    rows = join_unique(rows, totals, "family", "inner")
    return rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))


def _across_blocks(members: DataFrame, links: DataFrame, block: int) -> DataFrame | None:
    """(family, cell, label, doc_id, digest): the cells of families that ``links`` leave in several
    components, each of a block of the sets outside the largest and a block of all."""
    large = members.filter(F.col("blocks") > 1)
    if large.isEmpty():
        return None
    found = components(links).withColumnRenamed("node", "doc_id")
    rows = stored(
        large.join(found, "doc_id", "left").withColumn("label", F.coalesce("root", "doc_id")).drop("root"),
        "sets-of-large-families",
    )
    parts = rows.groupBy("family", "label").agg(F.sum("size").alias("shingles"))
    main = parts.groupBy("family").agg(
        F.max_by("label", F.struct("shingles", "label")).alias("main"),
        F.ceil((F.sum("shingles") - F.max("shingles")) / block).cast("int").alias("outside"),
    )
    main = stored(main.filter(F.col("outside") > 0), "families-in-parts")
    if main.isEmpty():
        return None
    rows = join_unique(rows, main, "family", "inner")
    own = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("outside")).cast("int")
    outside = rows.filter(F.col("label") != F.col("main")).withColumn("cell", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: own * F.col("blocks") + b)
    ))
    every = rows.withColumn("cell", F.explode(
        F.transform(F.sequence(F.lit(0), F.col("outside") - 1), lambda o: o * F.col("blocks") + F.col("block"))
    ))
    columns = ["family", F.col("cell").cast("bigint").alias("cell"), "label", "doc_id", "digest"]
    return stored(outside.select(*columns).unionByName(every.select(*columns)), "cells")


def similar_sets(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
    text_col: str = "text", block: int = BLOCK, bitmaps: int = BITMAPS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id that links of ``percent`` Jaccard similarity
    lead to from a row's set, its own included."""
    keyed = stored(keyed_sets(docs, shingle, percent, id_col, text_col), "keyed-sets")
    sets = (
        keyed.filter(F.col("doc_id").isNotNull() & (F.col("size") > 0))
        .groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"))
    )
    sets = stored(sets, "different-sets")
    families = components(family_links(keyed))
    members = stored(_members(sets, families, block), "family-members")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = _distinct_in_batches(texts.filter(F.col("doc_id").isNotNull()))
    # block 0 of a large family goes to each of its cells
    cell = F.when(
        F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)
    ).otherwise(F.array("block"))
    cells = members.select(
        "family", F.explode(cell.cast("array<bigint>")).alias("cell"), F.col("doc_id").alias("label"), "doc_id", "digest"
    )
    links = stored(_search(_with_texts(cells, texts), shingle, percent, bitmaps), "links-in-blocks")
    others = _across_blocks(members, links, block)
    if others is not None:
        found = stored(_search(_with_texts(others, texts), shingle, percent, bitmaps), "links-across-blocks")
        links = links.unionByName(found)
    linked = components(links.unionByName(_sets_of_one_id(keyed, sets))).withColumnRenamed("node", "doc_id")
    named = stored(
        sets.join(linked, "doc_id", "left").select("digest", F.coalesce("root", "doc_id").alias("component")),
        "set-components",
    )
    rows = keyed.select("doc_id", "digest", "size")
    # a set of many copies is split by Spark: both sides of this join come from a shuffle
    return rows.join(named, "digest", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
