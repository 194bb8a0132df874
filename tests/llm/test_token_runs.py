"""Texts are tokenised in few calls, and segments are not copied in every round of a grammar."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reelfold.llm import repair
from reelfold.llm.tokens import Encoder, vocabulary_path

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", VOCABULARIES)
def test_odd_pieces_go_to_the_library_together(name, monkeypatch):
    words = Encoder(vocabulary_path(name))
    calls = []
    alone = words._ids
    monkeypatch.setattr(words, "_ids", lambda text: calls.append(text) or alone(text))
    text = "so " + " ".join(f"x{n}y {n}-{n}\nend" for n in range(300))
    whole = Tokenizer.from_file(vocabulary_path(name))
    assert words.encode([text])[0] == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(calls) < 10


@pytest.mark.parametrize("name", VOCABULARIES)
@pytest.mark.parametrize("memory", [0, 5, 250_000])
def test_ids_do_not_depend_on_what_is_remembered(name, memory):
    words = Encoder(vocabulary_path(name), memory)
    whole = Tokenizer.from_file(vocabulary_path(name))
    wide = "".join(chr(c) for c in range(0xC0, 0x100))
    texts = ["a tree, \xc3\xc4 \xc3\xa9t\xc3 tree.", f"so {wide} {wide[::-1]} x"]
    texts += ["", "a  b\n\nc ​ d", "so tree x9 x9\ntree", "1"]
    for k in range(4):
        for run in (texts[k:], texts[:k], [texts[k]]):
            want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in run]
            assert words.encode(run) == want
    assert len(words._known) <= memory
    if memory > 5:
        words.encode(["so tree, tree. tree"])
        known = set(words._known.to_pylist())
        assert "tree" in known and not {"tree,", "tree."} & known


def batches(rows, size):
    for k in range(0, len(rows), size):
        keys, texts = zip(*rows[k : k + size])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], ["_id", "_text"])


def test_runs_reach_across_batches(monkeypatch):
    rows = [(k if k % 7 else None, None if k % 5 == 0 else "x" * (k % 40)) for k in range(100)]
    rows.insert(50, (3, "y" * 500))

    def runs():
        found = list(repair._runs(batches(rows, 9)))
        assert [r for keys, texts, _ in found for r in zip(keys, texts)] == [(k, t or "") for k, t in rows]
        assert {kind for _, _, kind in found} == {pa.int64()}
        return [(len(texts), sum(map(len, texts))) for _, texts, _ in found]

    assert len(runs()) == 1
    monkeypatch.setattr(repair, "RUN_CHARS", 300)
    assert all(size <= 300 or n == 1 for n, size in runs())
    monkeypatch.setattr(repair, "RUN_ROWS", 10)
    assert all(n <= 10 for n, _ in runs())
    assert list(repair._runs(iter([]))) == []


def test_late_rounds_do_not_copy_the_segment(monkeypatch):
    rng = np.random.default_rng(7)
    passage = rng.integers(0, 60_000, 256)
    ids = np.concatenate([rng.integers(0, 60_000, 40_000), np.tile(passage, 6), rng.integers(0, 60_000, 40_000)])
    copies = []
    neighbours = repair._neighbours
    monkeypatch.setattr(repair, "_neighbours", lambda n: copies.append(n) or neighbours(n))
    grammar = repair.Grammar(repair.compress(ids.astype("<u4")))
    assert (grammar.ids() == ids).all()
    assert len(grammar.rounds) >= 8 and len(copies) == 1
