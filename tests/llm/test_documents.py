"""The operators on documents against plain versions of their definitions, odd rows included."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelfold.llm import decontaminate, packing, repair, secrets, sharding, simhash
from reelfold.llm.tokens import Encoder, vocabulary_path
from reelfold.session import scratch_path

from llm_helpers import (
    ODD, components, contamination, crc_of_ids, fingerprint, odd_documents, rows_of, secret_spans,
)

VOCABULARIES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def empty(spark):
    return odd_documents(spark, [])


# --- op1 ----------------------------------------------------------------------------------------


def ledger_digest(spark, docs):
    return secrets.digest(secrets.scan_versions(docs, scratch_path(spark, "ledger")))


@pytest.mark.parametrize("which", ["odd", "real"])
def test_secret_spans(spark, request, which):
    docs = request.getfixturevalue(which)
    want = []
    for r in docs.select("doc_id", "text").collect():
        spans = secret_spans(r["text"])
        counts = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
        want.append((r["doc_id"], *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    got = ledger_digest(spark, docs)
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)


def test_failing_match_consumes_text():
    rules = [(r, r.compiled()) for r in secrets.RULES]
    assert secrets.find_spans("password: secret: abcdefghij", rules) == []
    assert secrets.find_spans("API_KEY='abcdefgh'", rules) == [("assign", 0, 17)]
    assert secrets.find_spans("ſecret=abcdefgh", rules) == []  # not an ASCII letter in another case


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = scratch_path(spark, "ledger")
    one = spark.createDataFrame([(1, "a" * 40), (2, "a" * 40), (3, "plain")], "doc_id bigint, text string")
    secrets.scan_versions(one, ledger).collect()
    assert secrets.read_ledger(spark, ledger).count() == 2
    two = one.unionByName(spark.createDataFrame([(4, "b" * 33)], "doc_id bigint, text string"))
    found = rows_of(secrets.digest(secrets.scan_versions(two, ledger)), "doc_id", "n_hex")
    assert found == [(1, 1), (2, 1), (3, 0), (4, 1)]
    assert secrets.read_ledger(spark, ledger).count() == 3
    other = (secrets.Rule("digits", "[0-9]+", least=2),)
    secrets.scan_versions(two, ledger, other).collect()
    assert secrets.read_ledger(spark, ledger).count() == 6  # a rule version of its own


def test_redact(spark, odd):
    got = {r["doc_id"]: r for r in secrets.redact(odd, scratch_path(spark, "ledger")).collect() if r["doc_id"]}
    assert got[13]["text"] == "[assign]' [access] [hex]" and got[13]["n_chars"] == len(got[13]["text"])
    assert got[9]["text"] == dict(ODD)[9] and set(got[13].asDict()) == set(odd.columns)


def test_redact_keeps_rows(spark, odd):
    assert secrets.redact(odd, scratch_path(spark, "ledger")).count() == len(ODD)


# --- op2 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "real"])
def test_simhash_components(request, which):
    docs = request.getfixturevalue(which)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    fps = {t: fingerprint(t, 3) for _, t in rows}
    near = components(fps.values(), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            least[near[fps[t]]] = min(i, least.get(near[fps[t]], i))
    want = sorted(((i, fps[t], least[near[fps[t]]]) for i, t in rows if i is not None), key=repr)
    got = simhash.near_duplicates(docs, 3, 2).filter("doc_id is not null").collect()
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=repr) == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_with_large_groups(spark, radius):
    """Groups over the limit are dealt again; components stay the same."""
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 8)).astype(np.uint64)
    fps = np.unique((base[:, None] ^ flips ^ np.roll(flips, 1, axis=1)).ravel()).view(np.int64)
    df = spark.createDataFrame([(int(f), int(f)) for f in fps], "fp bigint, node bigint")
    want = components(fps.tolist(), lambda a, b: ((a ^ b) % 2**64).bit_count() <= radius)
    from reelfold.llm.graph import components as spark_components

    for group in (3, 16_384):
        found = {r["node"]: r["root"] for r in spark_components(simhash.links(df, radius, group)).collect()}
        assert {f: found.get(f, f) for f in fps.tolist()} == want


def test_gray_rank():
    codes = np.array([i ^ (i >> 1) for i in range(1000)], np.uint64)
    assert simhash.gray_rank(codes).tolist() == list(range(1000))


# --- one document of each group (pipeline stage) ------------------------------------------------


def first_of_groups(rows):
    """(doc_id, text) rows that stay, by comparing all fingerprints."""
    fps = {t: fingerprint(t, 3) for _, t in rows}
    root = components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i, t in rows:
        if i is not None:
            key = root[fps[t]]
            first[key] = min(first.get(key, (i, fps[t])), (i, fps[t]))
    return sorted(i for i, _ in first.values())


def test_keep_first_against_all_pairs(real):
    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    kept = simhash.keep_first(real)
    assert kept.dtypes == real.dtypes
    assert sorted(r["doc_id"] for r in kept.collect()) == first_of_groups(rows)


def test_keep_first_of_odd_rows(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == first_of_groups(ODD)
    assert ids.count(None) == 2



# --- op3 ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("which,shards", [("odd", 4), ("real", 40), ("odd", 40)])
def test_shards(request, which, shards):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    got = sharding.shard_by_bytes(docs, shards).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(
        ((i, len(t) + 16, zlib.crc32(t)) for i, t in rows), key=repr
    )
    in_order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [key(r["doc_id"]) for r in in_order] == sorted(key(i) for i, _ in rows)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(shards):
        mine = [r for r in in_order if r["shard"] == s]
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / shards) <= largest
    assert all(0 <= r["shard"] < shards for r in got)


# --- tokens, op8, op9 ---------------------------------------------------------------------------


@pytest.mark.parametrize("name", VOCABULARIES)
@pytest.mark.parametrize("memory", [0, 100, 100_000])
def test_encoder_gives_the_tokenizer_ids(name, memory, real):
    path = vocabulary_path(name)
    whole, mine = Tokenizer.from_file(path), Encoder(path, memory)
    texts = [t or "" for _, t in ODD] + [r["text"] for r in real.limit(100).collect()]
    texts += ["a\nb", "\n\nx", " lead", "trail ", "é́ x", "a.'s b", "x  y", "it's,don't. (no)", "AB'S 'T"]
    for _ in range(2):  # from an empty and from a full memory
        for text, ids in zip(texts, mine.encode(texts)):
            want = whole.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]


@pytest.mark.parametrize("which", ["odd", "real"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    path = vocabulary_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = packing.pack(docs, path, end_id=1, length=64).collect()
    taken = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for sequence, offset, size in taken:  # one after another: only the last sequence may have room
        assert (sequence, offset) == divmod(at, 64) and 0 < size <= 64 - offset
        at += size
    pieces = {}
    for r in got:
        assert crc_of_ids(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"]
        pieces.setdefault(r["sequence_id"] * 64 + r["offset"] - r["start"], []).append(r)
    texts = []
    for group in pieces.values():
        group.sort(key=lambda r: r["start"])
        ids = np.frombuffer(b"".join(r["ids"] for r in group), "<u4").tolist()
        assert [r["start"] for r in group] == [sum(x["length"] for x in group[:k]) for k in range(len(group))]
        assert {r["doc_tokens"] for r in group} == {len(ids)}
        texts.append((group[0]["doc_id"], tuple(ids)))
    want = [
        (r["doc_id"], (*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1))
        for r in docs.select("doc_id", "text").collect()
    ]
    assert sorted(texts, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("which,segment", [("odd", 50), ("odd", 500_000), ("real", 20_000)])
def test_grammar_files(request, which, segment):
    docs = request.getfixturevalue(which)
    path = vocabulary_path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    files = repair.write_files(docs, path, end_id=0, segment_ids=segment, shards=3)
    got = sorted(repair.read_documents(files).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and crc_of_ids(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"]
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = [
        (r["doc_id"], (*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0))
        for r in docs.select("doc_id", "text").collect()
    ]
    assert sorted(((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got), key=repr) == sorted(
        want, key=repr
    )


def test_grammar_leaves_no_pair_that_pays():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 900, 700)
    for ids in (
        np.zeros(5000), rng.integers(0, 3, 4000), rng.zipf(1.3, 20_000) % 5000,
        np.concatenate([np.r_[passage, rng.integers(0, 900, 50)] for _ in range(30)]),
        np.tile([1, 1, 1, 1, 1, 1, 2], 5), np.repeat(rng.integers(0, 40, 900), rng.integers(1, 9, 900)),
    ):
        ids = ids.astype("<u4")
        for batch in (2048, 3):
            grammar = repair.Grammar(repair.compress(ids, round_rules=batch))
            assert (grammar.ids() == ids).all()
            counts, last = {}, {}
            symbols = grammar.symbols.tolist()
            for at, pair in enumerate(zip(symbols, symbols[1:])):
                if last.get(pair) != at - 1:
                    counts[pair], last[pair] = counts.get(pair, 0) + 1, at
            assert max(counts.values(), default=0) < repair.MIN_COUNT
    # a passage that is repeated folds into one symbol
    whole = repair.Grammar(repair.compress(np.tile(passage, 30).astype("<u4")))
    assert whole.sizes.max() >= 700


def test_the_more_frequent_of_two_overlapping_pairs_is_replaced():
    ids = np.r_[np.tile([1, 2, 3], 10), np.ravel([[2, 3, 9 + n] for n in range(10)])].astype("<u4")
    grammar = repair.Grammar(repair.compress(ids))
    assert (grammar.ids() == ids).all()
    rules = set(zip(grammar.left.tolist(), grammar.right.tolist()))
    assert (2, 3) in rules and (1, 2) not in rules


def test_long_and_short_rules_are_expanded():
    rng = np.random.default_rng(5)
    long, short = rng.integers(0, 70_000, 500), rng.integers(0, 70_000, 9)
    ids = np.concatenate([p for n in range(40) for p in (long, short, [n], short, np.full(n, 3))]).astype("<u4")
    grammar = repair.Grammar(repair.compress(ids))
    assert grammar.sizes.max() > repair.SHORT and (grammar.ids() == ids).all()
    for start in range(0, len(ids), 997):
        assert (grammar.ids(start, min(600, len(ids) - start)) == ids[start : start + 600]).all()


@pytest.mark.parametrize("name", VOCABULARIES)
def test_words_are_remembered_without_their_marks(name):
    words = Encoder(vocabulary_path(name))
    text = "so tree trees, tree. tree!? tree; Tree d'or d', don't (tree) x2\nend. end\nend, \xc9t\xe9s. \xc9t\xe9s"
    whole = Tokenizer.from_file(vocabulary_path(name))
    for _ in range(2):
        assert words.encode([text, "", text])[2] == np.array(
            whole.encode(text, add_special_tokens=False).ids, "<u4"
        ).tobytes()
    assert not {"trees,", "tree.", "tree;", "tree!?"} & set(words._known)


def test_grammar_random_access():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 1000, 5000):
        for symbols in (1, 2, 5, 300, 2**31 - 1):
            ids = rng.integers(0, symbols, n).astype("<u4")
            grammar = repair.Grammar(repair.compress(ids))
            assert (grammar.ids() == ids).all()
            for _ in range(20):
                start = int(rng.integers(0, n + 1))
                size = int(rng.integers(0, n - start + 1))
                assert (grammar.ids(start, size) == ids[start : start + size]).all()
    words = rng.integers(0, 50, (40, 12))
    ids = words[rng.integers(0, 40, 2000)].ravel().astype("<u4")
    assert len(repair.compress(ids)) < ids.nbytes / 4
    with pytest.raises(IndexError):
        repair.Grammar(repair.compress(ids)).ids(1, len(ids))


# --- op10 ---------------------------------------------------------------------------------------


def items_hash(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


@pytest.mark.parametrize("blocks", [1, 5])
def test_contamination(spark, monkeypatch, blocks):
    rng = np.random.default_rng(blocks)
    words = ["é1", "A", "b9", "ß", "x-y", "the", "12"]
    text = lambda n: "".join(words[int(i)] + str(rng.choice([" ", ", ", "\n", "--"])) for i in rng.integers(0, 7, n))
    items = [(k, text(int(n))) for k, n in enumerate(rng.choice([1, 3, 9, 10, 11, 30], 12))]
    items += [(90, None), (91, ""), (92, "!!"), (2, text(12))]
    docs = [(k, text(60) + (items[k % 12][1] or "") * (k % 3) + text(3)) for k in range(40)] + ODD
    docs += [(99, (items[5][1] + " ") * 300)]
    size = sum(len((t or "").encode()) for _, t in items)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size // blocks + 1)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.digest(decontaminate.contamination(odd_documents(spark, docs), benchmark))
    want = []
    for i, t in docs:
        n, hit, found = contamination(t, items)
        want.append((i, n, hit, len(found), items_hash(found), hit > 0))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(got, *columns) == sorted(want, key=repr)


def test_contamination_of_given_tables(spark, sf_dir, real):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    found = decontaminate.contamination(real, benchmark).filter("size(spans) > 0").collect()
    texts = {r["doc_id"]: r["text"] for r in real.collect()}
    for r in found:
        n, hit, names = contamination(texts[r["doc_id"]], items)
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), set(r["items"])) == (n, hit, names)
    assert found


def test_empty_benchmark(spark, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(odd, none).filter("size(spans) > 0").count() == 0
    assert decontaminate.keep_clean(odd, none).count() == len(ODD)


# --- empty tables -------------------------------------------------------------------------------


def test_empty_tables(spark, empty):
    words, letters = (vocabulary_path(v) for v in VOCABULARIES)
    benchmark = spark.createDataFrame([(1, "x y")], "item_id bigint, text string")
    for df in (
        secrets.scan_versions(empty, scratch_path(spark, "ledger")),
        secrets.redact(empty, scratch_path(spark, "ledger")), simhash.near_duplicates(empty),
        simhash.keep_first(empty), sharding.shard_by_bytes(empty, 4), packing.pack(empty, words),
        repair.read_documents(repair.write_files(empty, letters)),
        decontaminate.contamination(empty, benchmark), decontaminate.keep_clean(empty, benchmark),
    ):
        assert df.count() == 0


def test_hot_groups(spark):
    """A third of all rows are copies of one text."""
    docs = spark.range(900).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("token = 'abcdefgh12345678' in each of these copies"))
        .otherwise(F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 256))).alias("text"),
    )
    found = simhash.near_duplicates(docs, 3, 2)
    assert found.filter("component_id = 0").count() >= 300
    assert secrets.digest(secrets.scan_versions(docs, scratch_path(spark, "ledger"))).filter("n_assign > 0").count() == 300
    assert simhash.keep_first(docs).count() == 601
