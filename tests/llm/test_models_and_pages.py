"""Nearest neighbours, pages and classifiers: brute force, hand-made pages, held-out accuracy."""

import importlib.util
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelfold.llm import ann, language, pages, toxicity
from reelfold.llm.queries import NEIGHBOURS, ORACLES, QUERIES

from llm_helpers import LONG, ODD, odd_documents, rows_of

VECTORS = "vec_id bigint, embedding array<float>, label int, rank int, score double, part int"


def brute_nearest(rows, is_query, k):
    good = [
        (i, [float(x) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for i, v in good:
        if is_query(i):
            scores = []
            for j, w in good:
                if j != i and len(w) == len(v):
                    total = 0.0
                    for a, b in zip(v, w):
                        total += a * b
                    scores.append((-total, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0.0, 0) for i, v in rows], VECTORS)


@pytest.mark.parametrize("blocks", [(2, 3), (2048, 8192)])
def test_nearest_of_odd_rows(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(size=5).astype(np.float32).tolist()) for i in range(40)]
    rows += [(100 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] + [1.0] * 4)]
    rows += [(204, [float("inf")] * 5), (205, []), (206, [1.0, 2.0]), (207, [3.0, 4.0]), (None, [1.0] * 5)]
    rows += [(208, [float(np.float32(1e-30))] * 5), (209, [float(np.float32(1e18))] * 5), (11, rows[11][1])]
    found = ann.nearest(vectors(spark, rows), F.col("vec_id") % 2 == 0, 6, query_block=blocks[0], candidate_block=blocks[1])
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == sorted(
        brute_nearest(rows, lambda i: i % 2 == 0, 6), key=repr
    )


def test_nearest_of_given_vectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute_nearest(rows, lambda i: i % 20 == 0, NEIGHBOURS)
    got = QUERIES["op4_block_join"](spark, sf_dir).collect()
    assert sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "score")) for r in got) == want


def test_sql_oracles(spark, sf_dir):
    from compare import compare, connect

    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), sql) == [], name


def test_no_vectors(spark):
    assert ann.nearest(vectors(spark, []), F.lit(True), 3).count() == 0
    assert ann.nearest(vectors(spark, [(1, [1.0])]), F.lit(True), 3).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="page with-sidebar"><header><h1>Site name</h1><nav><ul><li>Home<li>News</ul></nav></header>
<div class="cookie-notice">We use cookies, as everyone does, to please you.</div>
<div id="wrap"><article><h1>Fish &amp; chips</h1><p>First paragraph, long enough to count, with   white
space. Really.<p>Second one<br>after a break; it&nbsp;has <b>bold</b> and <a href="x>y">a link</a>, too.
<ul><li>one, two</li><li>three</ul><div class="advert">Buy this now!</div><!-- <p>comment</p> -->
<blockquote>Quoted, at length, by somebody.</blockquote></article>
<aside><p>An aside, with commas, and text.</p></aside>
<section id="comments"><p>I, a reader, think so, too. Yes, really, I do.</p></section>
<form><label>Mail</label><button>Send</button></form></div><footer>&copy; us</footer></body></html>"""
TEXT = (
    "Fish & chips\n\nFirst paragraph, long enough to count, with white space. Really.\n\n"
    "Second one after a break; it has bold and a link, too.\n\none, two\n\nthree\n\n"
    "Quoted, at length, by somebody."
)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\n\nb"), (PAGE, TEXT),
    (PAGE.replace("article>", "div>"), TEXT), ("<p>5 &lt; 6 &#233; &amp;amp; &bogus;</p>", "5 < 6 é &amp; &bogus;"),
    ("<body><nav>menu</nav></body>", ""), ("<div><p>open <b>bold<p>next</div>", "open bold\n\nnext"),
    ("<script>x<y</script>only", "only"), ("a < b and c > d", "a < b and c > d"),
])
def test_main_text(page, text):
    assert pages.main_text(page) == text


def test_long_and_broken_pages_take_linear_time():
    for part in ("<", "<p ", '<a href="', "<div>", "</div>", "<!--", "<p>word, ", "&#x", "<script>"):
        pages.main_text(part * 30_000)


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>hi", "y"), (2, "v", "<p>" + LONG, "z")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = rows_of(pages.extract(df), "page_id", "url", "text", "n_chars")
    long = " ".join(LONG.split())
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "hi", 2), (2, "v", long, len(long))], key=repr)
    assert pages.extract(df.limit(0)).count() == 0


def test_pages_of_given_table(spark, sf_dir):
    got = QUERIES["op5_tag_paths"](spark, sf_dir).collect()
    assert all(r["text"] and r["n_chars"] == len(r["text"]) and "<" not in r["text"] for r in got)


def test_language_held_out(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op6_family_duels"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(spark, sf_dir):
    model = language.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs = odd_documents(spark)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert len(got) == len({i for i, _ in ODD})
    for i in (0, 1, 2, 11):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
    assert all(got[i]["lang_pred"] != "und" for i in (3, 6, 9, 12)) and got[None]["held_out"] is False
    kept = language.keep_identified(docs, model)
    assert kept.count() == len(ODD) - 4 and kept.columns == docs.columns
    assert language.fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_svm_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0, 1, 0.5] + 0.3 > 0, 1.0, -1.0)
    w = language.linear_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def toxic_rows(n=600):
    rng = np.random.default_rng(5)
    usual = [f"{a}{b}" for a in ("ma", "lo", "ti", "ser", "bron") for b in ("ken", "dal", "vi", "rost", "une")]
    bad = ["grumphead", "snotfool", "vilescum"]
    rows = []
    for i in range(n):
        words = rng.choice(usual, 80).tolist()
        toxic = int(i % 6 == 0)
        for at in rng.integers(0, 80, 4 * toxic):
            words[at] = str(rng.choice(bad))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_of_odd_rows(spark):
    rows = toxic_rows(200)
    docs = odd_documents(spark, [(1000 + i, t) for i, t, _ in rows] + ODD)
    labels = spark.createDataFrame(
        [(1000 + i, y) for i, _, y in rows] + [(1000, 0), (1000, 1), (3, None), (None, 1)], "doc_id bigint, toxic int"
    )
    model = toxicity.fit(docs, labels)
    got = toxicity.toxicity(docs, model)
    assert got.count() == len(rows) + len(ODD) and got.filter("score is null or isnan(score)").count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.toxicity(docs, None).filter("score <> 0").count() == 0
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


# --- the pipeline ------------------------------------------------------------------------------

pipeline = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


@pipeline
def test_pipeline_against_plain_stages(spark, tmp_path):
    import re

    from tokenizers import Tokenizer

    import corpus_pipeline
    from llm_helpers import components, contamination, fingerprint, secret_spans, write_tables
    from reelfold.llm.tokens import vocabulary_path

    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ma", "lo", "ti", "ser") for b in ("ken", "dal", "vi", "rost", "une", "x")]
    text = lambda n: " ".join(rng.choice(words, n).tolist())
    items = [(k, text(12)) for k in range(5)]
    rows = [(i, text(60)) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    rows += [(110 + i, rows[i][1].replace(rows[i][1].split()[30], "edit", 1)) for i in range(5)]
    rows += [(120 + i, text(30) + " " + items[i][1] + " " + text(10)) for i in range(5)]
    rows += [(130 + i, text(40) + f" token = 'k{i}abcdefghijk' " + "0f" * 20) for i in range(5)]
    rows += [(140, None), (141, ""), (142, "123 !!"), (143, "one"), (9, rows[9][1])]
    docs = spark.createDataFrame(
        [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    folder = write_tables(
        spark, tmp_path, documents=docs, benchmark=spark.createDataFrame(items, "item_id bigint, text string")
    )
    got = corpus_pipeline.run(spark, folder).collect()

    kept = [(i, t) for i, t in rows if t and re.search("[a-z]", t)]
    by_id = dict(kept)
    fps = {i: fingerprint(t, 3) for i, t in by_id.items()}
    root = components(by_id, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    kept = [(i, by_id[i]) for i in by_id if root[i] == i]
    kept = [(i, t) for i, t in kept if not contamination(t, items)[1]]
    whole = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    want = {}
    for i, t in kept:
        out, at = "", 0
        for s in secret_spans(t):
            kind, start, end = s.split(":")
            if int(start) >= at:
                out += t[at : int(start)] + f"[{kind}]"
            at = max(at, int(end))
        want[i] = len(whole.encode(out + t[at:], add_special_tokens=False).ids) + 1
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    assert sum(r["length"] for r in got) == sum(want.values())
    assert set(range(120, 125)).isdisjoint(want) and set(range(100, 105)).isdisjoint(want)


@pipeline
def test_stages_return_the_columns_of_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes, name
