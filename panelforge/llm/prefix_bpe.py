"""Byte-pair encoding by prefix dynamic programming, with a public vocabulary file given by its path.

For every prefix of a byte string there is exactly one token that can end its encoding. The table of these tokens is filled from left
to right: the last token of a prefix is the one suffix token that may follow the last token of what precedes it. Appending bytes
extends the table; an edit refills it from the edit on, until it runs in step with the old table again.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from panelforge.session import ship_package

#: Folder of the public vocabulary files; a parameter wherever it is used.
TOKENIZER_DIR = "/opt/tokenizers"
#: White space as the vocabulary's splitter sees it (the Unicode property; control characters 1c-1f are not in it).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: how the vocabulary splits text before the merges, with white space spelt out.
_SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_WS}\\p{{L}}\\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: White space and what follows it. No token crosses from other characters into white space, so these pieces encode independently.
_PIECE = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Pieces kept by a worker, and the longest that is kept.
CACHE_PIECES, CACHE_CHARS = 400_000, 160


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and which token may follow which."""

    def __init__(self, tokens: dict[bytes, int], parts: dict[int, tuple[int, int]]):
        self.ids = tokens
        self.parts = parts  # token -> the two tokens it is merged from
        self.merged = {pair: t for t, pair in parts.items()}
        self.suffixes = {t[k:] for t in tokens for k in range(len(t))}
        self.longest = max(map(len, tokens))
        self.follows: dict[tuple[int, int], bool] = {}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}

    @classmethod
    def from_json(cls, raw: bytes) -> Vocabulary:
        """From a tokenizer file with a byte-level vocabulary and its merges; merge ranks must follow token ids, as they do in these files."""
        model = json.loads(raw)["model"]
        letters = _byte_letters()
        vocab = model["vocab"]
        text = lambda s: bytes(letters[c] for c in s)
        parts = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            parts[vocab[a + b]] = (vocab[a], vocab[b])
        tokens = {text(s): i for s, i in vocab.items() if i in parts or len(s) == 1}
        return cls(tokens, parts)

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens on the inner edge as merging proceeds backwards, each with the token whose creation ends its life."""
        out, until = [(token, float("inf"))], token
        while until in self.parts:
            child = self.parts[until][side]
            out.append((child, until))
            until = child
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b yields a, b: no merge across the border may come before either is complete.

        Of equal merges the left one goes first: one inside a precedes one across the border, which precedes one inside b.
        """
        known = self.follows.get((a, b))
        if known is not None:
            return known
        right = self._right.get(a) or self._right.setdefault(a, self._spine(a, 1))
        left = self._left.get(b) or self._left.setdefault(b, self._spine(b, 0))
        ok = True
        for x, x_ends in right:
            for y, y_ends in left:
                m = self.merged.get((x, y))
                if m is not None and m < x_ends and m <= y_ends:
                    ok = False
                    break
            if not ok:
                break
        if len(self.follows) > CACHE_PIECES:
            self.follows.clear()
        self.follows[a, b] = ok
        return ok


class PrefixTable:
    """The bytes of one pre-token and the last token of each of its prefixes."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last, self.width = vocab, b"", [], []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: prefixes already in the table keep their last tokens."""
        start = len(self.data)
        self.data += more
        self._fill(start, len(self.data))

    def _fill(self, start: int, stop: int) -> None:
        data, last, width, ids, suffixes, may = self.data, self.last, self.width, self.vocab.ids, self.vocab.suffixes, self.vocab.may_follow
        for i in range(start + 1, stop + 1):
            found = None
            for n in range(1, i + 1):
                s = data[i - n : i]
                if s not in suffixes:
                    break
                t = ids.get(s)
                if t is not None and (n == i or may(last[i - n - 1], t)):
                    found = t, n
                    if n == i:
                        break
            last.append(found[0])
            width.append(found[1])

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes start..stop and re-encode near the edit; returns how many prefixes were recomputed.

        Behind the edit the old table is taken over as soon as as many successive last tokens as the longest token has bytes agree.
        """
        old_last, old_width, tail = self.last[stop:], self.width[stop:], self.data[stop:]
        self.data = self.data[:start] + new + tail
        del self.last[start:], self.width[start:]
        at = start + len(new)
        self._fill(start, at)
        agreed = 0
        while len(self.last) < len(self.data):
            i = len(self.last)
            self._fill(i, i + 1)
            k = i - at
            agreed = agreed + 1 if (self.last[i], self.width[i]) == (old_last[k], old_width[k]) else 0
            if agreed >= self.vocab.longest:
                self.last += old_last[k + 1 :]
                self.width += old_width[k + 1 :]
                return i + 1 - start
        return len(self.last) - start

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i - 1])
            i -= self.width[i - 1]
        return out[::-1]


class Encoder(dict):
    """Texts to ids. As a dictionary it holds the packed ids of pieces met before."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.split = regex.compile(_SPLIT)
        self.words: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        known = self.words.get(w)
        if known is None:
            known = PrefixTable(self.vocab, w.encode()).tokens()
            if len(w) <= CACHE_CHARS:
                if len(self.words) >= CACHE_PIECES:
                    self.words.clear()
                self.words[w] = known
        return known

    def __missing__(self, piece: str) -> bytes:
        ids: list[int] = []
        for w in self.split.findall(piece):
            ids += self.word(w)
        packed = np.array(ids, np.int32).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def packed(self, text: str | None) -> bytes:
        """Ids as little-endian int32; none for a null or empty text."""
        return b"".join([self[p] for p in _PIECE.findall(text)]) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


_loaded: dict[int, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """The encoder of a vocabulary file's content, built once in each worker."""
    key = zlib.crc32(raw)
    if key not in _loaded:
        _loaded[key] = Encoder(Vocabulary.from_json(raw))
    return _loaded[key]


def vocabulary_file(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> bytes:
    return (Path(folder) / f"{name}.json").read_bytes()


def encode_corpus(docs: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, counts_only: bool = False) -> DataFrame:
    """(key, ids) of every row; with ``counts_only`` (key, n_tokens).

    Whole texts, no special tokens; a special token's string in a text is ordinary text. An empty or null text has the empty list. Rows
    stay in their partitions, so there is no shuffle and no skew; the vocabulary (a fixed file of under 2 MB) is sent to the workers
    once. Repeated rows and null keys come out as they went in; an empty table gives no rows; other columns are never looked at.
    """
    ship_package(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary_file(tokenizer, folder))
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for b in batches:
            packed = [enc.packed(t) for t in b.column(1).to_pylist()]
            sizes = np.array([len(x) // 4 for x in packed], np.int64)
            if counts_only:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes)], names=[key, "n_tokens"])
                continue
            # lists of one batch stay below 2 ** 31 ids, whatever the texts' lengths
            start = 0
            while start < len(packed):
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), 50_000_000, side="right")))
                flat = np.frombuffer(b"".join(packed[start:stop]), np.int32)
                offsets = np.r_[0, np.cumsum(sizes[start:stop])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])
                start = stop

    result = f"`{key}` {key_type}, " + ("n_tokens long" if counts_only else "ids array<int>")
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, result)
