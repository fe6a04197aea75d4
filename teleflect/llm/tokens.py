"""Token ids of whole texts through the tokenizers library, each distinct word encoded once per worker.

The word-level BPE tokenizers served here drop white space and never let a token cross it, so the ids of a text are
the ids of its white-space-separated words in order. Two rewrites that change no id make words repeat more often: a
trailing run of plain punctuation after an ASCII letter is a token group of its own and becomes a word; ASCII capitals
are lowered, as the tokenizer lowers them (not in a text where a combining mark could compose with them, or with what
may be a special token). The library encodes every distinct word.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np

from .words import Block, Lookup, blocks, class_of, worker_table

#: Punctuation that no contraction pattern and no special token contains.
_TAIL = class_of(b".,;:!?%&*$#")
_LETTER = class_of(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _plain(text: str | None) -> bytes:
    t = (text or "").encode()
    return t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()


class WordEncoder:
    """encode(texts) gives the ids of each text. Memory is bounded: the table of words restarts after `most` of them."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known, self.check = Lookup(), np.zeros(0, np.uint64)
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """All ids and the number for each word. Plain lower-case words go straight to the BPE model: the normaliser leaves them alone."""
        model, by_word = self.tokenizer.model, [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if w.isalpha() and w.islower():
                by_word[i] = [t.id for t in model.tokenize(w.decode())]
            else:
                rest.append(i)
        found = self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)
        for i, e in zip(rest, found, strict=True):
            by_word[i] = e.ids
        return [x for ids in by_word for x in ids], [len(ids) for ids in by_word]

    def _learn(self, keys: np.ndarray, check: np.ndarray, words: list[bytes]) -> None:
        ids, sizes = self._ids(words)
        self.known.add(keys)
        self.check = np.concatenate([self.check, check])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.array(sizes, np.int64))])

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        b = Block(texts)
        tail = _TAIL[b.bytes]
        last = np.maximum.accumulate(np.where(tail, 0, np.arange(len(tail))))[b.ends - 1]  # the last byte before the tail
        cut = last[(last >= b.starts) & (last < b.ends - 1) & _LETTER[b.bytes[last]]] + 1
        starts, ends = np.sort(np.concatenate([b.starts, cut])), np.sort(np.concatenate([b.ends, cut]))
        keys, at, code_of = np.unique(b.hashes(starts, ends), return_index=True, return_inverse=True)
        check = b.hashes(starts[at], ends[at], 1)
        codes = self.known.find(keys)
        if len(self.known) + np.sum(codes < 0) > self.most:
            self._clear()
            codes = self.known.find(keys)
        if len(new := np.flatnonzero(codes < 0)):
            codes[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn(keys[new], check[new], [b.data[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        if not np.array_equal(self.check[codes][code_of], b.hashes(starts, ends, 1)):  # two words share a hash: leave the table aside
            found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.array([x for ids in found for x in ids], np.uint32), np.cumsum([0, *map(len, found)])
        first, sizes = self.ends[codes][code_of], (self.ends[codes + 1] - self.ends[codes])[code_of]
        done = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(first - done[:-1], sizes) + np.arange(done[-1])
        return self.flat[take], done[np.searchsorted(starts, b.texts_at)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null text has none."""
        for block in blocks(map(_plain, texts)):
            ids, ends = self._encode(block)
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield ids[a:b]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return worker_table(("tokens", path), lambda: WordEncoder(path))
