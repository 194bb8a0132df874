"""Tokenising whole texts with a bounded memory of the pieces already seen.

A text is cut before every space or line feed that follows a character which is no white space. No token of either
public vocabulary starts in text and ends in white space, so the ids of a text are the ids of its
pieces one after another. Words repeat, so most pieces come from the memory of the worker and only new
ones reach the tokenizers library. A text in which such a cut is not safe goes to it whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY_PIECES = 250_000  # pieces remembered by one Python worker
RUN_CHARS = 3_000_000  # texts of about so many characters are tokenised together
# White space to str.isspace but not to the tokenizers, or the other way about.
_UNSURE = frozenset("\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff")
# Latin-1 letters, then ASCII marks: after a letter these begin a new token in both vocabularies, but for
# the apostrophe.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "\xaa\xb5\xba")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
_STOPS = re.compile(r"(?:[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for every byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


class Encoder:
    """Ids of whole texts, each text as bytes of little-endian unsigned 32-bit integers.

    Exactly ``Tokenizer.encode(text, add_special_tokens=False).ids``, special tokens written out in a
    text included. An empty text has no ids.
    """

    def __init__(self, path: str, memory: int = MEMORY_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        self._limit = memory
        self._letters = _byte_letters()
        # a letter beyond ASCII in the model's letters; the first is the only one that others are spelt with
        wide = sorted((c for c in _LETTERS if not c.isascii()), key=lambda c: c != "\xc3")
        self._spelling = {c: "".join(self._letters[b] for b in c.encode()) for c in wide}
        self._drops_space = not self._ids(" ")
        self._lowers = self._ids("A") == self._ids("a")
        # the same model, for words that are spelt in its letters already
        self._words = Tokenizer(self._whole.model)
        self._words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self._whole.get_vocab()
        self._edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end, or else begin, a word
        edge = str.endswith if self._drops_space else str.startswith
        mark = "</w>" if self._drops_space else self._letters[ord(" ")]
        self._edge[[i for token, i in vocabulary.items() if edge(token, mark)]] = True
        self._known = pa.array([], pa.large_string())  # pieces, without the space that they follow
        self._known_ids = _Stretches.of([])  # the ids of each
        self._stops: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word_ids(self, words: list[str]) -> _Stretches:
        """Ids of words of Latin-1 letters after a space: one pre-token each, so the model alone."""
        if not words:
            return _Stretches.of([])
        spelt = "\n".join(words)
        spelt = spelt.lower() if self._lowers else spelt
        if not spelt.isascii():
            for letter, letters in self._spelling.items():
                spelt = spelt.replace(letter, letters)
        if not self._drops_space:
            space = self._letters[ord(" ")]
            spelt = space + spelt.replace("\n", "\n" + space)
        lines = spelt.split("\n")
        parts = ["\n".join(lines[k : k + 200]) for k in range(0, len(lines), 200)]
        found = self._words.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        edges = np.flatnonzero(self._edge[ids])
        if len(edges) != len(words):
            return _Stretches.of([self._ids(" " + w) for w in words])
        begins = np.r_[0, edges[:-1] + 1] if self._drops_space else edges
        return _Stretches(ids, begins, np.diff(begins, append=len(ids)))

    def _stop_ids(self, stops: str) -> bytes:
        if stops not in self._stops:
            if len(self._stops) > 1000:
                self._stops.clear()
            self._stops[stops] = self._ids("a" + stops)[len(self._ids("a")) :]
        return self._stops[stops]

    def _odd_text(self, piece: str) -> str | None:
        """What has the ids of a piece after a space that is no plain word; None where the text must not be cut there."""
        if not _UNSURE.isdisjoint(piece):
            return None
        if self._drops_space:
            return " " + piece
        if not piece or piece[-1].isspace() or piece[1 if piece[0] == "\n" else 0].isspace():
            return None
        return piece if piece[0] == "\n" else " " + piece

    def _odd_ids(self, pieces: list[str]) -> tuple[_Stretches, np.ndarray]:
        """Ids of pieces that are no plain words, and which of them must not be cut off."""
        texts = [self._odd_text(p) for p in pieces]
        uncut = np.array([t is None for t in texts], bool)
        found = self._whole.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        return _Stretches.of([np.array(e.ids, "<u4").tobytes() for e in found]), uncut

    def _piece_ids(self, pieces: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after another, the number of each one's, and which must not be cut off.

        A piece is a word and marks, remembered apart, or odd and remembered whole.
        """
        marks = pc.utf8_ltrim(pieces, characters=_LETTERS).dictionary_encode()
        tails = _strings(marks.dictionary)
        ending = np.array([bool(_STOPS.fullmatch(t)) for t in tails], bool)
        tail = _numbers(marks.indices)
        word = pc.utf8_rtrim(pieces, characters=_MARKS)
        plain = ending[tail] & (_numbers(pc.binary_length(word)) > 0)
        named = pc.if_else(pa.array(plain), pc.utf8_lower(word) if self._lowers else word, pieces).dictionary_encode()
        names, name = named.dictionary, _numbers(named.indices)
        entry = _numbers(pc.index_in(names, value_set=self._known).fill_null(-1))
        gap = entry < 0
        a_word = np.zeros(len(names), bool)
        a_word[name] = plain
        spelt, odd = np.flatnonzero(gap & a_word), np.flatnonzero(gap & ~a_word)
        new = np.r_[spelt, odd]
        odd_ids, odd_uncut = self._odd_ids(_strings(names.take(pa.array(odd))))
        new_ids = self._word_ids(_strings(names.take(pa.array(spelt)))).and_then(odd_ids)
        uncut = np.zeros(len(names), bool)
        uncut[odd] = odd_uncut
        entry[new] = len(self._known) + np.arange(len(new))
        used = np.zeros(len(tails), bool)
        used[tail[plain]] = True
        stops = [self._stop_ids(t) if t and u else b"" for t, u in zip(tails, used.tolist())]
        known_ids = self._known_ids.and_then(new_ids)
        found = known_ids.and_then(_Stretches.of([*stops, b""]))
        after = len(known_ids.sizes) + np.where(plain, tail, len(tails))
        both = np.stack([entry[name], after], 1).ravel()
        sizes = found.sizes[both]
        self._remember(names, new, new_ids, uncut, np.bincount(name, counts, len(names)))
        return taken(found.pool, found.begins[both], sizes), sizes.reshape(-1, 2).sum(1), uncut[name]

    def _remember(
        self, names: pa.Array, new: np.ndarray, ids: _Stretches, uncut: np.ndarray, often: np.ndarray
    ) -> None:
        """Keep the new pieces, ``often`` of all names telling how many times each came."""
        if often[new].sum() > 0.4 * often.sum():  # other texts than before, or the first ones
            self._known, self._known_ids = self._known[:0], _Stretches.of([])
        if len(self._known) >= self._limit:
            return
        # the second half of the memory is for pieces that come more than once
        least = 1 if len(self._known) < self._limit // 2 else 2
        kept = np.flatnonzero((often[new] >= least) & ~uncut[new])
        kept = kept[: self._limit - len(self._known)]
        self._known = pa.concat_arrays([self._known, names.take(pa.array(new[kept]))])
        pool = taken(ids.pool, ids.begins[kept], ids.sizes[kept])
        sizes = ids.sizes[kept]
        self._known_ids = self._known_ids.and_then(_Stretches(pool, np.cumsum(sizes) - sizes, sizes))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in the order given."""
        if not texts:
            return []
        lines = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " " if self._drops_space else " \n")
        rows = pc.split_pattern(lines, " ")
        starts = _numbers(rows.offsets)
        first = starts[:-1]
        coded = rows.values.dictionary_encode()
        which = _numbers(coded.indices)
        later = np.ones(len(which), bool)
        later[first] = False
        counts = np.bincount(which[later], minlength=len(coded.dictionary))
        used = np.flatnonzero(counts)
        ids, sizes, uncut = self._piece_ids(coded.dictionary.take(pa.array(used)), counts[used])
        # texts that go to the library whole, and the heads of the others
        unsafe = np.zeros(len(counts), bool)
        unsafe[used] = uncut
        whole = np.logical_or.reduceat(unsafe[which] & later, first)
        heads = _strings(rows.values.take(pa.array(first)))
        whole |= [not _UNSURE.isdisjoint(h) or not h or h[-1].isspace() for h in heads]
        cut = np.flatnonzero(~whole)
        opened = self._whole.encode_batch_fast([heads[k] for k in cut], add_special_tokens=False)
        opened = [np.array(e.ids, "<u4") for e in opened]
        begins, sizes = np.r_[0, np.cumsum(sizes)][:-1], np.r_[sizes, [len(i) for i in opened], 0].astype(np.int64)
        begins = np.r_[begins, len(ids) + np.cumsum(sizes[len(begins):]) - sizes[len(begins):]]
        place = np.zeros(len(counts), np.int64)
        place[used] = np.arange(len(used))
        entry = place[which]
        entry[first[cut]] = len(used) + np.arange(len(cut))
        entry[np.repeat(whole, np.diff(starts))] = len(sizes) - 1
        ends = 4 * np.r_[0, np.cumsum(sizes[entry])][starts]
        view = memoryview(taken(np.concatenate([ids, *opened]), begins[entry], sizes[entry]).tobytes())
        out = [bytes(view[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
        for k in np.flatnonzero(whole).tolist():
            out[k] = self._ids(texts[k]) if texts[k] else b""
        return out


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def taken(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of the pool, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
    source = np.repeat((begins - (ends - sizes)).astype(kind), sizes)
    source += np.arange(total, dtype=kind)
    return pool[source]


class _Stretches(NamedTuple):
    """Many short arrays of ids: stretches of a pool."""

    pool: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, values: list[bytes]) -> _Stretches:
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        return cls(np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes, sizes)

    def and_then(self, more: _Stretches) -> _Stretches:
        return _Stretches(
            np.concatenate([self.pool, more.pool]),
            np.concatenate([self.begins, len(self.pool) + more.begins]),
            np.concatenate([self.sizes, more.sizes]),
        )


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_runs(texts: list[str], max_chars: int = RUN_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of about ``max_chars`` together, to bound memory."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > max_chars:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
