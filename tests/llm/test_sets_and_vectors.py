"""Whitening, set join and hard negatives against plain versions of their definitions."""

import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelfold.llm import jaccard, negatives, whitening

from llm_helpers import ODD, components, low, odd_documents, rows_of


# --- op11 ---------------------------------------------------------------------------------------


def integers(vectors, dims):
    good = [
        v for v in vectors
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)
    ]
    return [[math.floor(1024 * c) + 100_000 for c in v] for v in good]


def check_whitening(df, vectors, dims, wanted):
    """The rows against numpy's eigenvalues of the exact covariance."""
    x = integers(vectors, dims)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    apart = [[n * c - s for c, s in zip(row, sums)] for row in x]
    v = np.array([
        [float(Fraction(sum(row[i] * row[j] for row in apart), n**3)) for j in range(dims)] for i in range(dims)
    ])
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    got = df.collect()
    assert len(got) == n * wanted and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(sum(c * c for c in row) for row in apart)
    for k in range(1, wanted + 1):
        rows = [r for r in got if r["component"] == k]
        assert rows[0]["explained"] == pytest.approx(values[k - 1] / v.trace(), rel=1e-9)
        mine = np.array(apart, float) / n @ directions[:, k - 1] / math.sqrt(values[k - 1])
        found = np.sort([r["whitened"] for r in rows])
        assert min(np.abs(found - np.sort(s * mine)).max() for s in (1, -1)) < 1e-7
    assert max(r["identity_error"] for r in got) < 1e-9


def test_whitening_against_eigenvalues(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 50).astype(np.float32).tolist()
    odd = [None, [], [1.0] * 5 + [None], [1.0] * 5 + [float("nan")], [float("inf")] * 6, [1.0, 2.0], vectors[0]]
    rows = [(i, v, 0, "x", None) for i, v in enumerate(vectors + odd)] + [(None, vectors[1], None, "x", None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, deviation string, n string")
    check_whitening(whitening.whiten(df, 4), [r[1] for r in rows], 6, 4)


def test_whitening_of_given_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check_whitening(whitening.whiten(df), [r["embedding"] for r in df.select("embedding").collect()], 64, 8)


def test_whitening_without_rank(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], schema)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    large = spark.createDataFrame([(i, [2.0**39 + i, 1.0 * (i % 2)]) for i in range(50)] + [(99, [1e300, 0.0])], schema)
    assert whitening.whiten(large).filter("abs(whitened) < 10").count() == 100


def test_factor_and_rotation():
    rng = np.random.default_rng(1)
    for rank in (1, 4, 7):
        a = rng.normal(size=(7, rank))
        factor = whitening.pivoted_cholesky(a @ a.T)
        assert factor.shape == (7, rank) and np.allclose(factor @ factor.T, a @ a.T)
        rotated = whitening.one_sided_jacobi(factor)
        assert np.allclose(rotated @ rotated.T, a @ a.T)
        assert np.allclose(rotated.T @ rotated, np.diag((rotated**2).sum(axis=0)), atol=1e-12)


# --- op12 ---------------------------------------------------------------------------------------


def words_set(text, size=4):
    w = re.findall("[^\x20\x09-\x0d]+", low(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(a, b):
    both = len(a & b)
    return bool(both) and 100 * both >= 85 * (len(a) + len(b) - both)


def check_sets(spark, rows, **limits):
    sets = {i: words_set(t) for i, t in rows}
    want = components(sets, lambda a, b: similar(sets[a], sets[b]))
    docs = odd_documents(spark, rows).repartition(3)
    got = rows_of(jaccard.similar_sets(docs, **limits), "doc_id", "n_shingles", "component_id")
    assert got == sorted(((i, len(sets[i]), want[i]) for i, _ in rows), key=repr)
    return want


def edited(rng, words, edits):
    words = list(words)
    for at in rng.integers(0, len(words), edits):
        words[at] = f"e{rng.integers(10**9)}"
    return " ".join(words)


LIMITS = [{}, {"block": 300}, {"block": 300, "bitmaps": 64}]


@pytest.mark.parametrize("limits", LIMITS)
def test_similar_sets_against_all_pairs(spark, limits):
    """Families of near copies at, above and below the limit; small blocks make many cells a family."""
    rng = np.random.default_rng(12)
    rows = []
    for n in (1, 3, 4, 6, 9, 11, 25, 60, 130):
        for _ in range(2):
            words = [f"w{x}" for x in rng.integers(0, 10**6, n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words).upper())]
            for edits in (0, 1, 1, 1, 2, 2, 3, 4):
                rows.append((len(rows), edited(rng, words, edits)))
            rows += [(len(rows), " ".join([*words, "more"])), (len(rows) + 1, " ".join(words[1:]))]
    rows += [(i + 1000, t) for i, t in ODD if i not in (None, 7)]
    want = check_sets(spark, rows, **limits)
    assert len(set(want.values())) < len(want) - 50


@pytest.mark.parametrize("limits", LIMITS)
def test_family_below_the_limit(spark, limits):
    """A template whose copies are all about as similar as the limit, so that many pairs are just below."""
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = [(i, edited(rng, words, 2)) for i in range(120)]
    want = check_sets(spark, rows, **limits)
    assert 1 < len(set(want.values())) < 120


def test_random_sentences_of_a_template(spark):
    """Each text holds a random 87 % of a template's sentences: no two need be linked, all could be."""
    rng = np.random.default_rng(8)
    sentences = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(60)]
    rows = [(i, " ".join(s for s in sentences if rng.random() < 0.87)) for i in range(90)]
    check_sets(spark, rows)


def test_section_keys_meet(spark):
    """Sets at the limit share a key, whatever their sizes."""
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 200, 1000, 3000]:
        for _ in range(5):
            whole = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            both = n
            apart = 15 * both // 85  # in one of the two only
            own = int(rng.integers(0, apart + 1))
            a = np.unique(whole[: both + own])
            b = np.unique(np.r_[whole[:both], whole[both + own : both + apart]])
            assert 100 * both >= 85 * (both + apart)
            keys, owner = jaccard.section_keys([a, b])
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (n, own, apart)


def test_similar_sets_of_odd_rows(spark):
    rows = ODD + [(7, "another text of the same id, which has nothing in common with the first"), (20, ODD[6][1])]
    got = jaccard.similar_sets(odd_documents(spark, rows))
    found = rows_of(got, "doc_id", "n_shingles", "component_id")
    assert len(found) == len(rows)
    assert (7, 13, 6) in found and (20, 13, 6) in found and (7, 11, 6) in found  # an id is one document
    assert (0, 0, 0) in found and (2, 0, 2) in found and (3, 1, 3) in found
    assert [r for r in found if r[0] is None] == [(None, 1, None)] * 2
    assert jaccard.similar_sets(odd_documents(spark, [])).count() == 0


def test_hot_set(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same words in each of these many copies"))
        .otherwise(F.concat_ws(" ", *[F.sha2(F.concat(F.lit(str(k)), F.col("id").cast("string")), 256) for k in range(9)])).alias("text"),
    )
    keyed = jaccard.keyed_sets(docs, 4, 85, "doc_id", "text")
    assert keyed.filter("doc_id % 3 = 0 and size(keys) > 0").count() <= 16  # one a batch
    found = jaccard.similar_sets(docs)
    assert found.filter("component_id = 0").count() == 1000 and found.count() == 3000


# --- op13 ---------------------------------------------------------------------------------------


def plain_negatives(rows, anchor_of=50):
    """(anchor, positive, rank, negative, scores) from all pairs; rows of (id, label, vector)."""
    good = [
        (i, y, [math.floor(256 * c) for c in v]) for i, y, v in rows
        if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for a, label, q in good:
        if a % anchor_of:
            continue
        scored = [
            (-sum(x * y for x, y in zip(q, v)), i, y) for i, y, v in good if i != a and len(v) == len(q)
        ]
        for minus, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            p = -minus
            fits = sorted(s for s in scored if s[2] != label and 50 * p <= -100 * s[0] <= 95 * p)[:3]
            out += [(a, positive, k, i, p, -s) for k, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def found_negatives(spark, rows, **sizes):
    df = spark.createDataFrame(
        [(i, y, v, None, None) for i, y, v in rows],
        "vec_id bigint, label int, embedding array<double>, rank string, part string",
    )
    got = negatives.hard_negatives(df.repartition(3), F.col("vec_id") % 50 == 0, F.col("label"), **sizes)
    return sorted(tuple(r[c] for c in COLUMNS) for r in got.collect())


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 8 * 3 * 300, "anchors": 5}])
def test_negatives_against_all_pairs(spark, sizes):
    """Few components, so scores tie often; odd rows; several blocks."""
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 4)), (rng.integers(-40, 120, 3) / 256).tolist()) for i in range(900)]
    rows += [
        (1000, None, [1.0, 1.0, 1.0]), (1050, 1, None), (1100, 1, []), (1150, 1, [1.0, None, 1.0]),
        (1200, 1, [float("nan")] * 3), (1250, 1, [float("inf")] * 3), (1300, 1, [0.0] * 3), (1350, 1, [0.5, 0.5]),
        (1351, 1, [0.6, 0.6]), (1352, 2, [0.4, 0.4]), (None, 2, [0.4, 0.4, 0.4]),
    ]
    want = plain_negatives(rows)
    assert len(want) > 100 and any(w[0] == 1350 for w in want)
    assert found_negatives(spark, rows, **sizes) == want


def test_negatives_of_equal_and_large_vectors(spark):
    """A third of all rows are one vector; components beyond what floats hold exactly."""
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [1.0, 1.0] if i % 3 == 0 else rng.random(2).tolist()) for i in range(400)]
    assert found_negatives(spark, rows) == plain_negatives(rows)
    large = [(i, i % 2, (rng.random(2) * 2.0**21).tolist()) for i in range(120)]
    assert found_negatives(spark, large) == plain_negatives(large)


def test_negatives_of_empty_table(spark):
    df = spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>")
    assert negatives.hard_negatives(df, F.lit(True), F.col("label")).count() == 0


def test_boxes_drop_only_what_cannot_be_found():
    rng = np.random.default_rng(0)
    data = rng.integers(-50, 50, (500, 4)).astype(float)
    labels, ids = rng.integers(0, 3, 500), np.arange(500)
    order = negatives.str_order(labels, data, 8)
    assert sorted(order.tolist()) == list(range(500))
    tree = negatives.Tree(ids[order], labels[order], data[order], 8)
    anchors = data[:20]
    bounds = tree.bounds(anchors)
    for level, (most, least) in enumerate(bounds):
        step = 8 ** (level + 1)
        scores = anchors @ data[order].T
        for box in range(most.shape[1]):
            inside = scores[:, box * step : (box + 1) * step]
            assert (inside.max(axis=1) <= most[:, box]).all() and (inside.min(axis=1) >= least[:, box]).all()
