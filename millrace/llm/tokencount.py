"""How many word pieces a text has, without making them.

Greedy longest match from left to right, as one walk over an automaton: a trie of the vocabulary whose
nodes have failure links. When no child carries the next character, the walk pops the pieces that the
node's text certainly begins with and goes on at what is left of it. How many pieces that are is
known for each node beforehand, so only numbers are added up, and each character is looked at a
constant number of times.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_batches, texts

#: The mark of a word's start in the vocabulary, and the words whose counts one worker remembers.
MARK, CACHE_ENTRIES, CACHED_BYTES = "▁", 800_000, 64


class Automaton:
    """vocabulary: pieces; one that begins a word starts with MARK, any other stands inside one."""

    def __init__(self, vocabulary: set[str]):
        self.children: list[dict[str, int]] = [{}, {}]  # of node 0 the pieces that begin words, of node 1 the others
        self.ends = [False, False]
        for piece in vocabulary:
            node, rest = (0, piece[1:]) if piece.startswith(MARK) else (1, piece)
            for c in rest:
                following = self.children[node].setdefault(c, len(self.children))
                if following == len(self.children):
                    self.children.append({})
                    self.ends.append(False)
                node = following
            if node > 1:
                self.ends[node] = True
        self.link: list[int | None] = [None] * len(self.children)
        self.popped = [0] * len(self.children)
        if MARK in vocabulary:  # a word may also begin with the mark alone
            self.link[0], self.popped[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            node = todo.popleft()
            for c, child in self.children[node].items():
                if self.ends[child]:
                    self.link[child], self.popped[child] = 1, 1
                else:
                    back, pieces = self.link[node], self.popped[node]
                    while back is not None and c not in self.children[back]:
                        pieces += self.popped[back]
                        back = self.link[back]
                    if back is not None:
                        self.link[child], self.popped[child] = self.children[back][c], pieces
                todo.append(child)

    def count(self, word: str) -> int:
        """The pieces of a word; 0 if it cannot be made of pieces."""
        children, link, popped = self.children, self.link, self.popped
        node, pieces = 0, 0
        for c in word:
            while c not in children[node]:
                pieces += popped[node]
                node = link[node]
                if node is None:
                    return 0
            node = children[node][c]
        while node != 1:
            pieces += popped[node]
            node = link[node]
            if node is None:
                return 0
        return pieces


class Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        pieces = self.automaton.count(word.decode())
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = pieces
        return pieces


def pieces_of(path: str) -> set[str]:
    """The pieces of a SentencePiece model, without its control, byte and unknown entries."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_byte, model.is_unknown, model.is_unused)
    return {model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)}


@lru_cache(maxsize=2)
def counts(path: str) -> Counts:
    return Counts(Automaton(pieces_of(path)))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of each whole text, under the vocabulary of the model at path.

    Words are runs of anything but space and \\x09 to \\x0D. A word that no pieces make up, as it holds
    a character outside the vocabulary, counts as one unknown token. Null and empty texts have no
    words; repeated rows are counted each; other columns of docs play no part. No shuffle.
    """

    def make():
        known = counts(path)

        def each(batch: pa.RecordBatch) -> dict:
            out: dict = {id_col: batch.column(id_col), "n_words": [], "n_tokens": [], "n_unknown": []}
            for x in texts(batch, text_col):
                pieces = [known[w] for w in x.encode().split()]
                unknown = pieces.count(0)
                out["n_words"].append(len(pieces))
                out["n_tokens"].append(sum(pieces) + unknown)
                out["n_unknown"].append(unknown)
            return out

        each.done = known.clear  # words are remembered until a task ends; the automaton stays
        return each

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_tokens bigint, n_unknown bigint")
