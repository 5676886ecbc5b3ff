"""Byte-level BPE without a merge loop.

A rank file gives each token its id. For every token the last merge that makes it is known, so two
neighbouring tokens can be tested for compatibility: they may stand side by side when no merge across
their border would have come first. A text's encoding is the one sequence of tokens of which all
neighbours are compatible; it is found by trying the longest match at each place and stepping back
where no compatible token leads on. Places that have failed are marked, so no place is left twice.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Unicode's white space, for a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: What one worker remembers until a task ends: encodings of words and of pre-tokens of at most CACHED_CHARS
#: characters, some 200 bytes each, and the compatibility of neighbours, some 140 bytes each. Together 200 MB at most.
WORDS, PIECES, NEIGHBOURS, CACHED_CHARS = 400_000, 300_000, 400_000, 48
#: Bytes up to which a piece's tokens are looked up where the search comes to; longer ones are matched in one pass.
SHORT = 64
NO_TOKEN = "no encoding: a byte of the text is no token"


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: lines of a base64 token and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Merges by rank, only with ranks under ``below``: what building a token looks like just before its last merge."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """pattern must never match on from a character that is not white space to one that is: texts are cut there first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.prefix = Memo(len(ranks), self._shorter)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.compatible = Memo(NEIGHBOURS, lambda pair: self._fits(pair >> 32, pair & 0xFFFFFFFF))
        #: The longest token that begins with these three bytes.
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 2:
                self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.trie.add_word(token.decode("latin-1"), (i, len(token)))
        self.trie.make_automaton()
        self.chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.pieces = Texts(PIECES, lambda piece: array("I", self.piece(piece.encode())).tobytes())
        self.chunks = Texts(WORDS, self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        found, pieces = self.pattern.findall(chunk), self.pieces
        return pieces[chunk] if found == [chunk] else b"".join([pieces[p] for p in found])  # one text and its ids are held for both

    def forget(self) -> None:
        """Frees what was remembered, all but the tables that the rank file bounds."""
        for memo in (self.pieces, self.chunks, self.compatible):
            memo.clear()

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins; None for a single byte."""
        if token not in self.halves:
            parts = merged(self.token[token], self.ranks, token)
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _shorter(self, token: int) -> int | None:
        """The longest token that this one begins with, itself aside."""
        whole = self.token[token]
        return next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), None)

    def longest(self, piece: bytes, at: int) -> int:
        """The longest token that stands at a place of a short piece."""
        ranks = self.ranks
        for end in range(min(len(piece), at + self.reach.get(piece[at : at + 3], 2)), at, -1):
            token = ranks.get(piece[at:end])
            if token is not None:
                return token
        raise ValueError(NO_TOKEN)

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right side by side.

        Undoes the later merge of the two step by step; a border pair that could have merged before
        the token in which it now stands would have done so.
        """
        # A merge across the border beats whatever was merged from here on; on equal rank the left one comes first.
        until_left = until_right = 1 << 62
        while True:
            joined = self.ranks.get(self.token[left] + self.token[right])
            if joined is not None and joined < until_left and joined <= until_right:
                return False
            if left > right:
                parts = self.split(left)
                if parts is not None:
                    until_left, left = left, parts[1]
                    continue
                parts = self.split(right)
                if parts is None:
                    return True
                until_right, right = right, parts[0]
            else:
                parts = self.split(right)
                if parts is not None:
                    until_right, right = right, parts[0]
                    continue
                parts = self.split(left)
                if parts is None:
                    return True
                until_left, left = left, parts[1]

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and (len(piece) == 1 or self.split(whole)):
            return [whole]
        longest = self.longest_in(piece) if len(piece) > SHORT else None
        sizes, compatible, prefix, reached = self.size, self.compatible, self.prefix, self.longest
        out, places, at, dead, end = [], [], 0, set(), len(piece)
        token = longest[0] if longest else reached(piece, 0)
        while True:
            ahead = at + sizes[token]
            if ahead not in dead and (not out or compatible[out[-1] << 32 | token]):
                out.append(token)
                if ahead == end:
                    return out
                places.append(at)
                at, token = ahead, longest[ahead] if longest else reached(piece, ahead)
                continue
            shorter = prefix[token]
            while shorter is None:
                if not out:
                    raise ValueError(NO_TOKEN)
                dead.add(at)
                at, shorter = places.pop(), prefix[out.pop()]
            token = shorter

    def longest_in(self, piece: bytes) -> list[int]:
        """The longest token at each place, by one pass over the piece."""
        longest = [0] * len(piece)
        for end, (token, size) in self.trie.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # matches come by their ends, so the last is the longest
        return longest

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pattern.findall(text) for i in self.piece(piece.encode())]

    def packed(self, text: str) -> bytes:
        return b"".join([self.chunks[c] for c in self.chunk.findall(text)])

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


class Memo(dict):
    """Remembers make(key), at least the last ``most`` / 2 that were asked for anew or again; ``most`` at most.

    When half of them are new, the new become the old and the old go, but for those that are asked for again.
    """

    def __init__(self, most: int, make):
        super().__init__()
        self.half, self.make, self.old = max(most // 2, 1), make, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            super().clear()
        self[key] = value

    def clear(self) -> None:
        super().clear()
        self.old = {}


class Texts(Memo):
    """A Memo of short texts only."""

    def keep(self, key, value) -> None:
        if len(key) <= CACHED_CHARS:
            super().keep(key, value)


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text as little-endian unsigned 32-bit integers.

    path: the rank file, present on every machine as a part of its installed package.
    Null and empty texts have no ids (an empty binary); repeated rows are encoded each; other columns
    of docs play no part. Texts are mapped batch by batch, with no shuffle.
    """

    def make():
        own = encoder(path, pattern)

        def each(batch: pa.RecordBatch) -> dict:
            return {id_col: batch.column(id_col), "ids": [own.packed(x) for x in texts(batch, text_col)]}

        each.done = own.forget
        return each

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary")


def decoder(path: str, pattern: str):
    """Packed ids -> the bytes that they stand for; None counts as no ids."""
    token = encoder(path, pattern).token
    return lambda ids: b"".join([token[i] for i in np.frombuffer(ids or b"", dtype="<u4").tolist()])


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; null ids decode to nothing."""

    def make():
        decoded = decoder(path, pattern)

        def each(batch: pa.RecordBatch) -> dict:
            return {id_col: batch.column(id_col), "ids": batch.column("ids"), "decoded": [decoded(x) for x in batch.column("ids").to_pylist()]}

        return each

    return map_batches(encoded.select(id_col, "ids"), make, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) as decode(encode(docs)) gives them, in one pass, so that a task needs one worker and its tables once."""

    def make():
        own, decoded = encoder(path, pattern), decoder(path, pattern)

        def each(batch: pa.RecordBatch) -> dict:
            ids = [own.packed(x) for x in texts(batch, text_col)]
            return {id_col: batch.column(id_col), "ids": ids, "decoded": [decoded(x) for x in ids]}

        each.done = own.forget
        return each

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of round_trip(); rows of docs as encode() has them."""
    done = round_trip(docs, path, pattern)
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
