"""Byte-pair encoding by longest matches with backtracking, and decoding.

A word is cut at once into tokens instead of merging pairs step by step: an
Aho-Corasick automaton gives the longest token at each place, a token is
accepted if merging would keep the boundary to the token before it, and a dead
end steps back to a shorter token. Each place is given up at most once, so the
work is linear in the word. Boundaries are judged from the merge ranks. Tokens
are decoded by slices of one buffer with an offset table.

The vocabulary file is named by a path that every executor can read.

Nulls, empty and odd input: a null text is empty and has no token; strings of
special tokens in a text become those tokens, as in the library whose files
are read; texts of any length are encoded whole; rows are independent, so null
or repeated ids and further columns do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from airtrace.llm.arrow import map_texts
from airtrace.llm.common import require

END = "</w>"
#: Added to the last character of a word, so that word ends are symbols of their own.
END_SHIFT = 0x400
#: White space as the tokenizer's normalizer sees it.
BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Python splits at these as well, the tokenizer does not.
EXTRA_BLANKS = re.compile("[\x1c-\x1f]")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Words whose tokens a task remembers; the memory is emptied when full.
REMEMBERED = 1 << 17
NEVER = 1 << 30


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if visible, else one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Encoder:
    """The tables made of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols: dict[int, str] = {}  # a token as a string of symbols
        for letter in self.letters:
            self.symbols[vocab[letter]] = letter
            self.symbols[vocab[letter + END]] = chr(ord(letter) + END_SHIFT)
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = (rank, both)
            self.parts.setdefault(both, (rank, a, b))
            self.symbols.setdefault(both, self.symbols[a] + self.symbols[b])
        self.ids = {s: i for i, s in self.symbols.items()}
        self.automaton = ahocorasick.Automaton()
        for symbols, token in self.ids.items():
            self.automaton.add_word(symbols, token)
        self.automaton.make_automaton()
        self.lengths = [len(self.symbols.get(i, "")) for i in range(max(self.symbols) + 1)]
        self.ends = {letter: chr(ord(letter) + END_SHIFT) for letter in self.letters}
        self.shorter: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        table = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.sizes = np.array([len(t) for t in table], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.buffer = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token, or -1."""
        if token not in self.shorter:
            symbols = self.symbols[token]
            self.shorter[token] = next((self.ids[symbols[:n]] for n in range(len(symbols) - 1, 0, -1) if symbols[:n] in self.ids), -1)
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the boundary between two finished tokens alone.

        The merges of both tokens are undone, latest first. If at some moment the
        two pieces at the boundary could merge before either grows on, it fails.
        A tie goes to the merge further left.
        """
        left_grows = right_grows = NEVER
        while True:
            across = self.merged.get((left, right))
            if across is not None and across[0] < left_grows and across[0] <= right_grows:
                return False
            left_rank = self.parts[left][0] if left in self.parts else -1
            right_rank = self.parts[right][0] if right in self.parts else -1
            if left_rank == right_rank == -1:
                return True
            if left_rank > right_rank:
                left_grows, left = left_rank, self.parts[left][2]
            else:
                right_grows, right = right_rank, self.parts[right][1]

    def fit(self, left: int, right: int) -> bool:
        """``compatible``, remembered: words share most of their boundaries."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.compatible(left, right)
        return known

    def piece(self, piece: str) -> list[int]:
        """The tokens of one word of the pre-tokenizer."""
        symbols = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode()])
        symbols = symbols[:-1] + self.ends[symbols[-1]]
        size = len(symbols)
        longest = [-1] * (size + 1)
        for end, token in self.automaton.iter(symbols):
            longest[end - self.lengths[token] + 1] = token  # a later end is a longer match
        lengths, fit = self.lengths, self.fit
        open_at = [True] * (size + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            end = at + lengths[token]
            if open_at[end] and (not tokens or fit(tokens[-1], token)):
                tokens.append(token)
                at = end
                token = longest[at]
                continue
            token = self.next_shorter(token)
            if token < 0:
                open_at[at] = False  # no token fits here: step back and try a shorter one
                token = tokens.pop()
                at -= lengths[token]
        return tokens

    def word(self, word: str) -> bytes:
        """The packed tokens of a run without blanks."""
        known, out = self.pieces, []
        for piece in ASCII_PIECES.findall(word) if word.isascii() else PIECES.findall(word):
            packed = known.get(piece)
            if packed is None:
                ids = array("I", self.piece(piece))  # 32 bits on every platform Spark runs on
                if sys.byteorder == "big":
                    ids.byteswap()
                packed = ids.tobytes()
                if len(known) >= REMEMBERED:
                    known.clear()
                known[piece] = packed
            out.append(packed)
        return b"".join(out)

    def plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        words = BLANKS.split(text) if EXTRA_BLANKS.search(text) else text.split()
        known, out = self.words, []
        for word in words:
            packed = known.get(word)
            if packed is None:
                packed = self.word(word.replace("Σ", "σ").lower()) if word else b""
                if len(known) >= REMEMBERED:
                    known.clear()
                known[word] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        parts = self.cut.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self.plain(p) for p in parts)

    def decode(self, packed: bytes) -> bytes:
        """The UTF-8 bytes of the tokens' texts joined by blanks."""
        ids = np.frombuffer(packed, dtype="<u4")
        out = []
        for start in range(0, len(ids), 65_536):  # so that the index of a very long text stays small
            part = ids[start:start + 65_536]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            at = np.repeat(self.offsets[part] - (ends - sizes), sizes) + np.arange(ends[-1])
            out.append(self.buffer[at].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


ENCODED = StructType([
    StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
TOKENS = StructType([*ENCODED.fields, StructField("ids", ArrayType(IntegerType()))])


def _digests(coder: Encoder, packed: list[bytes]) -> dict[str, list]:
    return {
        "n_tokens": [len(p) // 4 for p in packed],
        "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
        "decoded_sha256": [hashlib.sha256(coder.decode(p)).hexdigest() for p in packed],
    }


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the text decoded from them."""
    require(docs, "doc_id", "text")

    def run(texts: list[str]) -> dict[str, list]:
        coder = encoder(path)
        return _digests(coder, [coder.encode(t) for t in texts])

    return map_texts(docs.select("doc_id", "text"), "text", run, ENCODED).drop("text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """All columns with the token ids and their digests in place of the text."""
    require(docs, "text")

    def run(texts: list[str]) -> dict[str, list]:
        coder = encoder(path)
        packed = [coder.encode(t) for t in texts]
        return _digests(coder, packed) | {"ids": [np.frombuffer(p, dtype="<u4").astype(np.int32) for p in packed]}

    return map_texts(docs, "text", run, TOKENS).drop("text")
