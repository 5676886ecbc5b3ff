"""Packing documents into sequences of a fixed number of tokens by patterns.

Documents become pieces, of which only lengths matter for packing. A pattern is a few lengths that
fill a sequence exactly; all patterns of at most ``parts`` lengths are enumerated, and how often each
is repeated is fitted to the histogram of lengths by non-negative least squares. Repeats are rounded
down, so patterns hold no gap; what is left is packed by best fit, longest first,
on the histogram too. The driver thus sees one count for each length, and the plan has a few thousand
patterns, however many documents there are. Pieces find their places by their number among those of
their length: a number within the task that cut them, plus what earlier tasks have of that length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import cached_property, lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WHITE, merged
from .common import map_batches, texts, written

#: Tokens of a sequence, the id that ends a document, the most documents of a fitted pattern.
SIZE, END, PARTS = 1024, 2, 3
#: Lengths under this part of a sequence take no part in patterns: they are kept for the gaps of what patterns leave.
FILLER = 10
#: Fits: patterns that join the active set at once, and the most least-squares solutions.
BLOCK, MOST_SOLVES = 64, 60
#: Encoded chunks that a task remembers, and the longest of them in characters: some 120 MB at most.
CHUNKS, CHUNK_CHARS = 500_000, 48


def byte_level(path: str) -> tuple[dict[bytes, int], dict[str, int], list[tuple[bytes, bytes]]] | None:
    """Ids by the bytes of the tokens, ids of the added tokens and merges of a byte-level ``tokenizers`` file.

    None if the file has settings beyond these, or tokens that stand for no bytes.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
    plain = model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    more = [model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
    more += [t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized")] + [file.get(x) for x in ("normalizer", "truncation", "padding")]
    if not plain or any(more):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; characters from 256 on are the others
    byte = dict(zip([*shown, *range(256, 512 - len(shown))], [*shown, *(b for b in range(256) if b not in shown)], strict=True))
    names = {t["content"]: t["id"] for t in added}
    tokens = [t for t in model["vocab"] if t not in names]
    if not set("".join(tokens)) <= set(map(chr, byte)):
        return None
    merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]

    def own(found: list[str]) -> list[bytes]:
        whole, ends = "".join(found).translate(byte).encode("latin-1"), list(accumulate(map(len, found), initial=0))
        return [whole[a:b] for a, b in pairwise(ends)]

    halves = own(list(chain.from_iterable(merges)))
    return dict(zip(own(tokens), [model["vocab"][t] for t in tokens], strict=True)), names, list(zip(halves[::2], halves[1::2], strict=True))


@lru_cache(maxsize=4)
def by_ranks(path: str) -> bool:
    """Whether merging by ranks, as tiktoken does, gives the ids of the file.

    It does if every token of more than a byte has one merge, in the order of ids, and the merges of its
    bytes that come before lead to the two parts of that one. Other neighbours that spell a token then
    never come to stand side by side.
    """
    found = byte_level(path)
    if found is None:
        return False
    ranks, _, merges = found
    ids = [ranks.get(a + b, -1) for a, b in merges]
    whole = sum(len(t) == 1 for t in ranks) == 256 and len(merges) == len(ranks) - 256 and all(a < b for a, b in pairwise([-1, *ids]))
    return whole and all(merged(a + b, ranks, i) == [a, b] for (a, b), i in zip(merges, ids, strict=True))


class Tokens:
    """Packed ids of texts by a byte-level ``tokenizers`` file whose pre-tokens never run on from a visible character to white space.

    Where ranks give the file's ids, texts are encoded whole by these. Otherwise, and where a run of white
    space is too long for that, they are cut into chunks of white space and what follows; a batch's chunks
    that are not remembered are encoded together, each once. Chunks that begin with white space stand one
    after the other in one text, whose ids are cut where the bytes of a chunk end.
    """

    def __init__(self, path: str, ranked: bool):
        """ranked: what by_ranks(path) says; the driver asks once."""
        self.path, self.ranked = path, None
        if ranked:
            import tiktoken

            ranks, added, _ = byte_level(path)
            self.ranked, self.added = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), set(added)
        self.chunk = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
        self.white = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
        self.known: dict[str, bytes] = {}

    @cached_property
    def model(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks of a machine side by side
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def size(self) -> np.ndarray:
        out = np.zeros(self.model.get_vocab_size(), dtype=np.int64)
        for token, i in self.model.get_vocab().items():
            out[i] = len(token)  # a character stands for a byte
        return out

    def each(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]

    def encoded(self, chunks: list[str]) -> dict[str, bytes]:
        white, inner, others = self.white, [], []
        for c in chunks:
            (inner if c[0] in white and c[-1] not in white else others).append(c)
        out = dict(zip(others, self.each(others), strict=True))
        ids = np.array(self.model.encode_batch_fast(["".join(inner)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends, wanted = np.cumsum(self.size[ids]), np.cumsum([len(c.encode()) for c in inner])
        cuts = np.searchsorted(ends, wanted)
        if len(inner) and (cuts[-1] >= len(ids) or (ends[cuts] != wanted).any()):
            return out | dict(zip(inner, self.each(inner), strict=True))  # a file that changes texts before it cuts them
        packed, at = ids.tobytes(), 0
        for chunk, end in zip(inner, (4 * (cuts + 1)).tolist(), strict=True):
            out[chunk] = packed[at:end]
            at = end
        return out

    def packed(self, batch: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out = list(map(self.whole, batch)) if self.ranked else [None] * len(batch)
        rest = [i for i, ids in enumerate(out) if ids is None]
        if rest:
            for i, ids in zip(rest, self.by_chunks([batch[i] for i in rest]), strict=True):
                out[i] = ids
        return out

    def whole(self, text: str) -> bytes | None:
        try:
            return self.ranked.encode_to_numpy(text, allowed_special=self.added, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # the pattern has looked back over too much white space
            return None

    def by_chunks(self, batch: list[str]) -> list[bytes]:
        cut = [self.chunk.findall(x) for x in batch]
        known = self.known
        made = self.encoded(list(set(chain.from_iterable(cut)).difference(known)))
        known.update(made)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        if len(known) > CHUNKS:
            known.clear()
        for chunk in made:
            if len(chunk) > CHUNK_CHARS:
                known.pop(chunk, None)
        return out


@lru_cache(maxsize=1)
def tokens(path: str, ranked: bool | None = None) -> Tokens:
    return Tokens(path, by_ranks(path) if ranked is None else ranked)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, task, place) of all pieces of docs.

    A document is its ids and ``end``. One of at most ``size`` tokens is one piece; longer ones are cut
    so that all pieces but the first have ``size`` tokens. place numbers a task's pieces of one length.
    The ids are left out if keep_ids is false.
    """
    ranked = by_ranks(path)

    def make():
        own, task, places = tokens(path, ranked), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        last = np.array([end], dtype="<u4").tobytes()

        def each(batch: pa.RecordBatch) -> dict:
            at, out = [], {c: [] for c in ("piece", "start", "length", "ids_crc32", "ids", "place")}
            for row, ids in enumerate(own.packed(texts(batch))):
                ids += last
                n, upto = len(ids) // 4, 0
                for piece in range(-(-n // size)):
                    upto, start = n - (-(-n // size) - 1 - piece) * size, upto
                    part = ids[4 * start : 4 * upto]
                    at.append(row)
                    for name, value in (("piece", piece), ("start", start), ("length", upto - start), ("ids_crc32", zlib.crc32(part)), ("ids", part), ("place", places[upto - start])):
                        out[name].append(value)
                    places[upto - start] += 1
            return out | {"doc_id": batch.column("doc_id").take(pa.array(at, type=pa.int64())), "task": [task] * len(at)}

        each.done = own.known.clear
        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' if keep_ids else ''}task int, place long")


def patterns(lengths: np.ndarray, size: int, parts: int = PARTS) -> np.ndarray:
    """All ways to fill ``size`` with at most ``parts`` of these lengths, a row each, descending and filled up with 0."""
    have, found = np.zeros(size + 1, dtype=bool), []
    have[lengths[lengths <= size]] = True
    stack = [((), size)]
    while stack:
        chosen, left = stack.pop()
        most = chosen[-1] if chosen else size
        if left <= most and have[left]:
            found.append((*chosen, left))
        deeper = parts - len(chosen)
        if deeper == 2:  # the last two at once
            first = np.arange((left + 1) // 2, min(most, left - 1) + 1)
            first = first[have[first] & have[left - first]]
            found += [(*chosen, a, left - a) for a in first.tolist()]
        elif deeper > 2:
            stack += [((*chosen, a), left - a) for a in range(1, min(most, left - 1) + 1) if have[a]]
    return np.array([(*p, *[0] * (parts - len(p))) for p in found], dtype=np.int64).reshape(len(found), parts)


def nonnegative(columns: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """x >= 0 that makes the weighted squares of (sum of x over the columns that hold a length) - target least.

    columns: rows of places in target, where place 0 stands for nothing. An active set grows by up to
    BLOCK columns that share no place, those along which the squares fall most; its solution is
    approached until a value would be negative, which then leaves. Squares never rise; the search ends
    where no column would lower them or after MOST_SOLVES solutions.
    """
    squared = np.where(np.arange(len(target)) > 0, weight.astype(float) ** 2, 0)
    x, active = np.zeros(len(columns)), np.zeros(0, dtype=np.int64)

    def made(which: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(columns[which].ravel(), np.repeat(values, columns.shape[1]), len(target))

    solves, least = 0, np.inf
    while solves < MOST_SOLVES:
        left = target - made(active, x[active])
        left[0] = 0
        squares = float(squared @ left**2)
        if not squares < least * (1 - 1e-6):
            break
        least, gain = squares, (squared * left)[columns].sum(axis=1)
        gain[active] = 0
        best = np.argsort(-gain, kind="stable")[: 64 * BLOCK]
        used, joins = set(), []
        for i, places in zip(best.tolist(), columns[best].tolist(), strict=True):
            if gain[i] <= 1e-9 * (1 + squared @ np.abs(target)) or len(joins) == BLOCK:
                break
            if used.isdisjoint(own := {p for p in places if p}):
                used |= own
                joins.append(i)
        active = np.concatenate([active, np.array(joins, dtype=np.int64)])
        while len(active) and solves < MOST_SOLVES:
            solves += 1
            dense = np.zeros((len(target), len(active)))
            np.add.at(dense, (columns[active].ravel(), np.repeat(np.arange(len(active)), columns.shape[1])), 1)
            dense *= np.sqrt(squared)[:, None]
            normal = dense.T @ dense
            normal[np.diag_indices(len(active))] += 1e-10 * np.trace(normal) / len(active)
            best = np.linalg.solve(normal, dense.T @ (np.sqrt(squared) * target))
            now, falls = x[active], best <= 0
            if not falls.any():
                x[active] = best
                break
            step = float(np.min(now[falls] / (now[falls] - best[falls] + 1e-300)))
            x[active] = now + min(1.0, step) * (best - now)
            leaves = falls & (x[active] <= 1e-12 + 1e-9 * now)
            x[active[leaves]] = 0
            active = active[~leaves]
    return np.maximum(x, 0)


def rounded(columns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole repeats of the patterns, those of the most repeats first, and what they leave of counts: x rounded down, and never more than there is."""
    left, out = counts.copy(), []
    order = np.flatnonzero(x >= 1)
    for i in order[np.argsort(-x[order], kind="stable")].tolist():
        lengths, need = np.unique(columns[i][columns[i] > 0], return_counts=True)
        n = min(int(x[i]), int((left[lengths] // need).min()))
        left[lengths] -= n * need
        out += [(tuple(v for v in columns[i].tolist() if v), n)] * (n > 0)
    return out, left


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of all pieces, longest first, worked out by length: (lengths, repeats). Sequences filled alike are counted, not listed."""
    room: dict[int, list[list]] = {}  # space left -> [lengths, repeats]

    def put(lengths: tuple, space: int, n: int) -> None:
        if n:
            room.setdefault(space, []).append([lengths, n])

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            space = min((s for s in room if s >= length), default=size)
            each = space // length
            if space in room:
                lengths, n = room[space].pop()
                if not room[space]:
                    del room[space]
            else:
                lengths, n = (), -(-left // each)
            full = min(n, left // each)
            put(lengths + (length,) * each, space - each * length, full)
            left, n = left - full * each, n - full
            if n and left:
                put(lengths + (length,) * left, space - left * length, 1)
                left, n = 0, n - 1
            put(lengths, space, n if lengths else 0)
    return [(lengths, n) for groups in room.values() for lengths, n in groups]


def plan(counts: np.ndarray, size: int = SIZE, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that hold ``counts[length]`` pieces of every length from 1 to size, each exactly once.

    Long lengths weigh more in the fit. The shortest are left out of it: without them what is left of
    the others could not be filled up, with them it wastes a few sequences in a million.
    """
    out, left = [], np.array(counts, dtype=np.int64)
    whole, left[size] = int(left[size]), 0
    lengths = np.flatnonzero(left)
    columns = patterns(lengths[lengths >= size // FILLER], size, parts)
    if len(columns):
        x = nonnegative(columns, left / max(1, left.sum()), np.arange(size + 1) / size) * left.sum()
        out, left = rounded(columns, x, left)
    return [((size,), whole)] * (whole > 0) + out + best_fit(left, size)


def places(made: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, by ranges of the numbers of its pieces: first number, first sequence, offset."""
    ranges: dict[int, list] = {}
    used, sequence = np.zeros(size + 1, dtype=np.int64), 0
    for lengths, repeats in made:
        offset = 0
        for length in lengths:
            ranges.setdefault(length, []).append((int(used[length]), sequence, offset))
            used[length] += repeats
            offset += length
        sequence += repeats
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)) for length, found in ranges.items()}


def packed(docs: DataFrame, path: str, size: int = SIZE, end: int = END, parts: int = PARTS, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of every piece of docs, packed into few sequences of at most ``size`` tokens.

    path: the tokenizer's file, present on every machine as a part of its installed package.
    Null and empty texts are documents of the end id alone. Repeated rows and null ids are documents of
    their own. An empty table packs to none. Columns beyond doc_id and text play no part. Patterns
    number about size * size / 12 for three parts; take two parts for sequences of many thousand tokens.
    """
    cut = written(pieces(docs, path, size, end, keep_ids), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task = written(by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "piece-counts")
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # a row for each length, size at most
        counts[length] = n
    found = places(plan(counts, size, parts), size)
    columns = [c for c in cut.columns if c not in ("task", "place")]
    numbered = cut.join(by_task.select("task", "length", "before"), ["task", "length"]).select(*columns, (F.col("place") + F.col("before")).alias("number"))

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for own in np.unique(length).tolist():
                rows, (first, base, at) = length == own, found[own]
                which = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows], offset[rows] = base[which] + number[rows] - first[which], at[which]
            return {c: batch.column(c) for c in columns} | {"sequence_id": sequence, "offset": offset}

        return each

    return map_batches(numbered, make, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in columns) + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): what packed() has placed, as whole sequences of packed ids, ready to be trained on."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, p: F.concat(all_, p["ids"]))
    return parts.select("sequence_id", (F.length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
