"""Scoring texts with a probabilistic suffix tree over words.

Every word is a symbol of its own; the root of the tree is the smoothed unigram model. A context of up
to DEPTH words, which does not reach beyond the start of a text, becomes a state if it occurs LEAST
times in training, if its suffix is a state and if what follows it diverges from what follows its
suffix by more than chance would. A state's distribution is smoothed with its suffix's. A token is
scored in the state of the longest suffix of what precedes it. So the tree grows with the corpus, and
neither it nor the vocabulary is ever held whole.

Texts are encoded in chunks, each with a vocabulary of its own. Chunks are a bucketed table and are not
shuffled any more; what they know goes to buckets and comes back as messages, columns packed by bytes:

- Words go by their hash; a bucket sums their counts and gives them ids that are small for frequent words.
- Tokens then go once, with the words before them and a count, by the nearest of these words. All
  contexts that end in a word meet in its bucket, which decides on their branch of the tree from the
  root up and answers with the probability in the longest state.

Contexts with a thousandth of all tokens, at most HOT of each length, are hot. What follows them is
dealt out by the following word, so their counts are spread over all buckets, and only their sums meet.
Below a hot context tokens are dealt out by one word more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import arrow_schema, as_array, bounded, bucketed, crc_mod, drop, trim, written, written_apart

#: How often a context occurs at least, and its words at most.
LEAST, DEPTH = 2, 3
#: A context with at least 1/HOT of all tokens is hot. Tokens for which there is one bucket, about.
HOT, BUCKET_TOKENS = 1000, 1_000_000
#: Tokens of a chunk, about, and words of its vocabulary.
CHUNK_TOKENS, CHUNK_WORDS = 1_000_000, 400_000
#: How much the suffix's distribution weighs in a state's, in tokens, at least (else as much as there are different next words); and how far beyond its mean the divergence must be, in standard deviations.
PRIOR, DEVIATIONS = 20.0, 4.0
#: Logarithms of probabilities travel as whole numbers of so many parts of 1, so a token's is exact to 0.00013.
PARTS = 4096
#: Ids of what is in no training text and of the start of a text; words' ids begin at 2 and have fewer bits than these.
UNKNOWN, START, ID_BITS = 0, 1, np.uint64(48)
#: Sums that decide on a context, as diverges() has them, and the number of its next words.
SUMS = ("n", "followers", "repeated", "tokens", "once", "surprise", "mass")
#: Whether shuffle files go as soon as the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def diverges(n, repeated, tokens, once, surprise, mass) -> np.ndarray:
    """Whether contexts differ from their suffixes by more than chance, from sums over what follows them.

    n: tokens after the context. Of words that follow it twice and more: their number, their tokens, the
    sum of c * log(c / p), where p is their probability after the suffix, and the sum of p. once: words
    that follow it once. Those are one cell of the test, as most words of a large vocabulary are expected less than once.
    """
    n, cells = np.maximum(n, 1), repeated + (once > 0)
    beyond = np.maximum(once, 1) / (n * np.maximum(1 - mass, 1e-12))
    divergence = 2 * (surprise - tokens * np.log(n) + once * np.log(beyond))
    free = np.maximum(cells - 1, 1)
    return divergence > free + DEVIATIONS * np.sqrt(2 * free)


def summed(n: np.ndarray, p: np.ndarray, context: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """SUMS by context, 0 to size - 1, over next words with their counts n and probabilities p after the suffix."""
    total = lambda rows, x=None: np.bincount(context[rows], weights=x, minlength=size)
    many, every = np.flatnonzero(n >= 2), slice(None)  # most next words come once
    own, p = n[many], p[many]
    return dict(zip(SUMS, (total(every, n), total(n > 0), total(many), total(many, own), total(n == 1), total(many, own * np.log(own / p)), total(many, p)), strict=True))


def judged(x: dict[str, np.ndarray]) -> np.ndarray:
    return (x["n"] >= LEAST) & diverges(x["n"], x["repeated"], x["tokens"], x["once"], x["surprise"], x["mass"])


def smooth(n, p, total, followers):
    weight = np.maximum(PRIOR, followers)
    return (n + weight * p) / (total + weight)


# --- messages ---


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers, byte plane by byte plane: high bytes that are all zero are left out, others compress well."""
    planes, widths = [], []
    for column in columns:
        column = np.ascontiguousarray(column)
        largest = int(column.max()) if len(column) else 0
        widths.append((largest.bit_length() + 7) // 8)
        planes.append(column.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T.tobytes())
    raw = b"".join(planes)
    size = len(columns[0])
    return np.array([size, len(raw)], "<u8").tobytes() + bytes(widths) + pa.compress(raw, "zstd", asbytes=True)


def unpacked(data: bytes, count: int) -> list[np.ndarray]:
    """The columns, as 64-bit numbers."""
    size, length = np.frombuffer(data, "<u8", 2).tolist()
    raw, at, out = np.frombuffer(pa.decompress(data[16 + count :], length, "zstd", asbytes=True), np.uint8) if length else np.zeros(0, np.uint8), 0, []
    for width in data[16 : 16 + count]:
        column = np.zeros((size, 8), np.uint8)
        column[:, :width] = raw[at : at + size * width].reshape(width, size).T
        out.append(column.reshape(-1).view("<u8"))
        at += size * width
    return out


def in_parts(p: np.ndarray) -> np.ndarray:
    """Probabilities as logarithms to base 10 in PARTS, 1 at least, so that 0 stands for none."""
    return np.clip(np.rint(-np.log10(p) * PARTS), 1, (1 << 16) - 1).astype(np.uint64)


def from_parts(x: np.ndarray) -> np.ndarray:
    return 10.0 ** (x.astype(np.float64) / -PARTS)


def mix(a: np.ndarray, b) -> np.ndarray:
    """Hashes of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def begins(ordered: np.ndarray) -> np.ndarray:
    """Whether each of these is another than the one before."""
    out = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=out[1:])
    return out


def numbered(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of keys of 64 - bits bits at most, the rows of equal ones as they come: they are sorted with their row's number below them, as plain numbers are sorted several times faster than places."""
    low = np.uint64((1 << bits) - 1)
    return (np.sort((keys << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each different hash, in their order, and the number of each row's hash: what np.unique gives."""
    bits = len(hashes).bit_length()
    order = numbered(hashes >> np.uint64(bits), bits)
    found = hashes[order]
    if (found[1:] < found[:-1]).any():  # rarely, some differ in their last bits alone
        order = np.argsort(hashes, kind="stable")
        found = hashes[order]
    first, inverse = begins(found), np.empty(len(hashes), dtype=np.int64)
    inverse[order] = np.cumsum(first) - 1
    return order[first], inverse


def dealt(bucket: np.ndarray) -> list[tuple[int, slice]]:
    """The buckets of rows that lie in their order, with their rows."""
    firsts = np.flatnonzero(begins(bucket))
    ends = [*firsts[1:].tolist(), len(bucket)][: len(firsts)]
    return [(b, slice(first, end)) for b, first, end in zip(bucket[firsts].tolist(), firsts.tolist(), ends, strict=True)]


def inside(lengths: np.ndarray) -> np.ndarray:
    """The place of each token in its text."""
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def preceding(sequence: np.ndarray, since: np.ndarray, back: int, start: int, nothing: int) -> np.ndarray:
    """What stands so many places before each token: a token, the text's start or, beyond it, nothing."""
    out = np.full_like(sequence, nothing)
    out[back:] = sequence[:-back]
    out[since < back] = nothing
    out[since == back - 1] = start
    return out


# --- encoding ---

ENCODED = "kind string, chunk bigint, ids array<{id}>, tokens binary, texts binary, bucket bigint, data binary, n_texts bigint, n_training bigint, n_tokens bigint, words array<bigint>"


def heavy(codes: np.ndarray, since: np.ndarray, training: np.ndarray, n: np.ndarray, n_texts: int) -> list[tuple[list[int], int]]:
    """Contexts with 1/HOT of a chunk's training tokens: their words, nearest first, and their counts. The code after the last word's is the start's."""
    total, words = int(n.sum()), len(n)
    many = np.append(n, [n_texts, 0]) * HOT >= max(total, 1)
    many[-1] = False
    frequent, dense = np.flatnonzero(many).tolist(), np.cumsum(many) - 1
    place, known, out = np.flatnonzero(training), [[]], []
    of = np.zeros(len(place), dtype=np.int64)
    codes = codes.astype(np.int64)
    for back in range(1, DEPTH + 1):
        word = preceding(codes, since, back, words, words + 1)[place]
        stays = many[word]
        key = of[stays] * len(frequent) + dense[word[stays]]
        count = np.bincount(key, minlength=len(known) * len(frequent))  # at most HOT contexts by HOT words
        found = np.flatnonzero((count > 0) & (count * HOT >= total))
        known = [[*known[k // len(frequent)], frequent[k % len(frequent)]] for k in found.tolist()]
        out += zip(known, count[found].tolist(), strict=True)
        number = np.full(len(count), -1)
        number[found] = np.arange(len(found))
        place, of = place[stays][number[key] >= 0], number[key][number[key] >= 0]
    return out


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, lower-cased, though some may then be equal; the texts' words by their numbers, one after the other, and how many each text has. A null has none."""
    cut = pc.ascii_split_whitespace(column.cast(pa.large_string()))
    words, ends = cut.flatten(), np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(), dtype=np.int64)
    some = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty words there
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    found = words.filter(some).dictionary_encode()
    lower = pc.ascii_lower(found.dictionary)  # not of the texts, as Arrow lowers slices of a table wrongly
    return lower, found.indices.to_numpy(), np.diff(before[ends], prepend=0)


def joined(found: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What split() would give for all texts at once, each word once."""
    words = pa.concat_arrays([x for x, _, _ in found]).dictionary_encode()
    numbers, starts = words.indices.to_numpy(), np.cumsum([0, *(len(x) for x, _, _ in found)])
    every = np.concatenate([numbers[start : start + len(x)][n] for (x, n, _), start in zip(found, starts.tolist(), strict=False)])
    return words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), every, np.concatenate([n for _, _, n in found])


def encoded(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> dict[str, DataFrame]:
    """Written tables: "text", each chunk's texts in its own codes, the codes in the messages' order, and sums; "word", messages of hashes and training counts; "heavy" contexts.

    The end of a text is the word of no bytes.
    """
    spark = docs.sparkSession
    schema = ENCODED.format(id=docs.schema[id_col].dataType.simpleString())
    arrow = arrow_schema(spark, schema)

    def rows(kind: str, chunk: int, size: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": [kind] * size, "chunk": [chunk] * size}
        return pa.RecordBatch.from_arrays([as_array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

    def close(chunk: int, found: list[tuple], held: list[bool], ids: list[pa.Array]):
        vocabulary, numbers, counts = joined(found)
        vocabulary.append(b"")
        lengths, words = counts + 1, len(vocabulary)
        every, ends = np.full(int(lengths.sum()), words - 1, dtype=np.uint32), np.zeros(int(lengths.sum()), dtype=bool)
        ends[np.cumsum(lengths) - 1] = True
        every[~ends] = numbers
        training = np.repeat(~np.array(held, dtype=bool), lengths)
        order = np.argsort(-np.bincount(every, minlength=words), kind="stable")
        code = np.empty(words, dtype=np.uint32)
        code[order] = np.arange(words, dtype=np.uint32)
        every = code[every]
        n = np.bincount(every[training], minlength=words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), dtype=np.uint64, count=words)[order]
        bucket = hashes % np.uint64(buckets)
        order = np.lexsort((hashes, bucket))
        parts = dealt(bucket[order])
        ids = pa.concat_arrays(ids)
        of_chunk = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        n_texts = len(held) - sum(held)
        yield rows("text", chunk, 1, ids=of_chunk, tokens=[packed(every)], texts=[packed(lengths, np.array(held, dtype=np.uint8))], data=[packed(order)], n_texts=[n_texts], n_training=[int(n.sum())], n_tokens=[len(every)])
        yield rows("word", chunk, len(parts), bucket=[b for b, _ in parts], data=[packed(hashes[order[x]], n[order[x]]) for _, x in parts])
        some = heavy(every, inside(lengths), training, n, n_texts)
        signed = np.append(hashes, np.uint64(START)).view(np.int64).tolist()
        yield rows("heavy", chunk, len(some), words=[[signed[w] for w in x] for x, _ in some], n_training=[c for _, c in some])

    def run(batches):
        base, number, tokens, distinct, found, held, ids = TaskContext.get().partitionId() << 32, 0, 0, 0, [], [], []
        for batch in batches:
            found.append(split(batch.column("text")))
            words, of, n = found[-1]
            tokens, distinct = tokens + len(of) + len(n), distinct + len(words)
            held += batch.column("held_out").to_pylist()
            ids.append(batch.column("id"))
            if tokens > CHUNK_TOKENS or distinct > CHUNK_WORDS:
                yield from close(base + number, found, held, ids)
                number, tokens, distinct, found, held, ids = number + 1, 0, 0, [], [], []
                trim()
        if tokens:
            yield from close(base + number, found, held, ids)
        trim()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (crc_mod(F.col(id_col), 5) == 1).alias("held_out"))
    return written_apart(bounded(slim).mapInArrow(run, schema), "encoded", "kind", ("text", "word", "heavy"))


COUNTED = "chunk bigint, bucket bigint, data binary, n_known bigint, hash bigint, id bigint"


def counter(total: int, buckets: int):
    """Sums a bucket's words: answers of counts and ids, the number of known words, and the ids of hot ones."""
    arrow = to_arrow_schema(StructType.fromDDL(COUNTED))

    def run(found: pa.Table) -> pa.Table:
        bucket = found.column("bucket")[0].as_py()
        parts = [unpacked(x, 2) for x in found.column("data").to_pylist()]
        words, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        c = np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.uint64)
        order, known = np.lexsort((words, -c.astype(np.int64))), int(np.count_nonzero(c))
        ids = np.zeros(len(words), dtype=np.uint64)
        ids[order[:known]] = np.arange(known, dtype=np.uint64) * np.uint64(buckets) + np.uint64(bucket + 2)
        ends = np.cumsum([len(x) for x, _ in parts])[:-1]
        answers = [packed(c[x], ids[x]) for x in np.split(inverse, ends)]
        hot = np.flatnonzero((c * np.uint64(HOT) >= total) & (c > 0))
        size, more = len(answers), len(hot) + 1
        columns = {
            "chunk": found.column("chunk").to_pylist() + [None] * more, "bucket": [bucket] * size + [None] * more, "data": answers + [None] * more, "n_known": [None] * size + [known] + [None] * len(hot),
            "hash": [None] * (size + 1) + words[hot].view(np.int64).tolist(), "id": [None] * (size + 1) + ids[hot].astype(np.int64).tolist(),
        }
        trim()
        return pa.table([as_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return run


# --- the model ---


@dataclass
class Model:
    """What all tasks know: sums, and the hot contexts as nodes of a tree of their own, 0 its root."""

    total: int
    whole: float
    n_texts: int
    buckets: int
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    depth: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    nodes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    state: np.ndarray = field(default_factory=lambda: np.ones(1, dtype=bool))
    n: np.ndarray = field(default_factory=lambda: np.ones(1))
    followers: np.ndarray = field(default_factory=lambda: np.ones(1))

    def with_hot(self, contexts: list[tuple[int, ...]]) -> None:
        """contexts: ids of words, nearest first, each context with its suffixes."""
        node = {(): 0} | {x: i for i, x in enumerate(sorted(contexts, key=lambda x: (len(x), x)), 1)}
        self.parent = np.array([node[x[:-1]] for x in node], dtype=np.int64)
        self.depth = np.array([len(x) for x in node], dtype=np.int64)
        keys = (self.parent.astype(np.uint64) << ID_BITS) + np.array([x[-1] if x else 0 for x in node], dtype=np.uint64)
        self.nodes = 1 + np.argsort(keys[1:])
        self.keys = keys[self.nodes]
        self.state = np.arange(len(node)) == 0
        self.n, self.followers = np.ones(len(node)), np.ones(len(node))

    def child(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The hot context one word longer, 0 if that is not hot."""
        if not len(self.keys):
            return np.zeros(len(node), dtype=np.int64)
        key = (node.astype(np.uint64) << ID_BITS) + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.nodes[at], 0)

    def learn(self, depth: int, sums: dict[str, np.ndarray], nodes: np.ndarray) -> None:
        self.n[nodes], self.followers[nodes] = sums["n"], sums["followers"]
        self.state[nodes] = judged(sums) & self.state[self.parent[nodes]]

    def after_hot(self, keys: np.ndarray, n: np.ndarray, p: np.ndarray, upto: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """keys: hot contexts with next words, ascending. Probabilities in the longest state up to a length, and those after the suffix."""
        node, p, suffix = (keys >> ID_BITS).astype(np.int64), p.copy(), p.copy()
        word = keys & ((np.uint64(1) << ID_BITS) - np.uint64(1))
        for depth in range(1, upto + 1):
            at = np.flatnonzero(self.depth[node] == depth)
            if depth > 1:
                p[at] = p[np.searchsorted(keys, (self.parent[node[at]].astype(np.uint64) << ID_BITS) + word[at])]
            suffix[at] = p[at]
            known = at[self.state[node[at]]]
            p[known] = smooth(n[known], p[known], self.n[node[known]], self.followers[node[known]])
        return p, suffix


class Chunk:
    """The tokens of a chunk's texts and what precedes them, by ids."""

    def __init__(self, found: pa.Table, model: Model, mail: pa.Table | None = None):
        """found: the chunk's row of the table of chunks. mail: the messages for it, by kind and bucket."""
        self.model, self.mail, self.number = model, {}, found.column("chunk")[0].as_py()
        if mail is not None:
            for kind, bucket, data in zip(mail.column("kind").to_pylist(), mail.column("bucket").to_pylist(), mail.column("data").to_pylist(), strict=True):
                self.mail.setdefault(kind, {})[bucket] = data
        self.ids = found.column("ids").combine_chunks().flatten()
        c, ids = unpacked(found.column("words")[0].as_py(), 2)
        codes = unpacked(found.column("tokens")[0].as_py(), 1)[0].view(np.int64)
        lengths, held = unpacked(found.column("texts")[0].as_py(), 2)
        self.lengths, self.held = lengths.astype(np.int64), held > 0
        self.training = np.repeat(~self.held, self.lengths)
        self.c, self.next = c[codes], ids[codes]
        self.codes, self.vocabulary = codes, ids
        self.root = ((c + 0.5) / model.whole)[codes]
        since = inside(self.lengths)
        context = np.where(c >= LEAST, ids, np.uint64(UNKNOWN))[codes]
        start = START if model.n_texts >= LEAST else UNKNOWN
        self.words = []
        for back in range(1, DEPTH + 1):  # a context ends at the text's start and before a word that cannot be in one
            word = preceding(context, since, back, start, UNKNOWN)
            if back > 1:
                word[self.words[-1] <= START] = UNKNOWN
            self.words.append(word)
        self.hot = np.zeros(len(codes), dtype=np.int64)

    def hot_contexts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length the tokens after hot contexts, and these; self.hot becomes the longest."""
        out, at, node = [], np.arange(len(self.next)), np.zeros(len(self.next), dtype=np.int64)
        for word in self.words:
            node = self.model.child(node, word[at])
            at, node = at[node > 0], node[node > 0]
            self.hot[at] = node
            out.append((at, node))
        return out

    def hot_keys(self, at: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (node.astype(np.uint64) << ID_BITS) + self.next[at]

    def ask_hot(self) -> list[tuple[int, bytes]]:
        """For each bucket: hot contexts with next words, their training counts, and the words' probabilities in the root."""
        found = self.hot_contexts()
        at = np.concatenate([x for x, _ in found])
        key, first, inverse = np.unique(self.hot_keys(at, np.concatenate([x for _, x in found])), return_index=True, return_inverse=True)
        n, p = np.bincount(inverse, weights=self.training[at], minlength=len(key)).astype(np.uint64), in_parts(self.root[at[first]])
        bucket = mix(self.next[at[first]], np.uint64(0)) % np.uint64(self.model.buckets)
        order = np.lexsort((key, bucket))
        return [(b, packed(key[order[x]], n[order[x]], p[order[x]])) for b, x in dealt(bucket[order])]

    def told_hot(self) -> None:
        """self.p: probabilities in the longest hot state, from the answers."""
        self.hot_contexts()
        self.p = self.root.copy()
        if "hot" in self.mail:
            told = [unpacked(x, 2) for x in self.mail["hot"].values()]
            key, p = np.concatenate([x for x, _ in told]), np.concatenate([x for _, x in told])
            order = np.argsort(key)
            at = np.flatnonzero(self.hot)
            self.p[at] = from_parts(p[order])[np.searchsorted(key, self.hot_keys(at, self.hot[at]), sorter=order)]

    def ask(self) -> None:
        """The different tokens, with what precedes them, whose longer contexts may be states; self.parts are their rows by bucket."""
        first = self.model.depth[self.hot]  # a token goes by one word more than its longest hot context has
        open_ = self.model.state[self.hot] & (first < DEPTH)
        for back, word in enumerate(self.words):
            open_ &= (first != back) | (word != UNKNOWN)
        self.asks = np.flatnonzero(open_)
        words, first = [x[self.asks] for x in self.words], first[self.asks]
        context, own = np.zeros(len(self.asks), dtype=np.uint64), np.zeros(len(self.asks), dtype=np.uint64)
        for back, word in enumerate(words):
            context = mix(context, word)
            own = np.where(first == back, context, own)
        index, inverse = grouped(mix(context, self.next[self.asks]))
        rows, bucket = self.asks[index], own[index] % np.uint64(self.model.buckets)
        # Any order within a bucket gives the same; by the word before and the next one, columns compress best.
        rank = np.empty(len(self.vocabulary), dtype=np.uint64)
        rank[np.argsort(self.vocabulary, kind="stable")] = np.arange(1, len(rank) + 1, dtype=np.uint64)
        before = np.where(words[0][index] == START, np.uint64(0), rank[self.codes[rows - 1]])
        width, bits = len(rank).bit_length(), len(index).bit_length()
        pairs, over = (before << np.uint64(width)) + rank[self.codes[rows]], max(0, self.model.buckets.bit_length() + 2 * width + bits - 64)
        order = numbered((bucket << np.uint64(2 * width - over)) + (pairs >> np.uint64(over)), bits)
        self.index, self.place = index[order], np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.place = self.place[inverse]
        self.parts = dealt(bucket[order])

    def asked(self) -> list[tuple[int, bytes]]:
        n = np.bincount(self.place, weights=self.training[self.asks], minlength=len(self.index)).astype(np.uint64)
        rows = self.asks[self.index]
        columns = [*(x[rows] for x in self.words), self.next[rows], n, self.model.depth[self.hot[rows]].astype(np.uint64), in_parts(self.p[rows])]
        return [(b, packed(*(x[part] for x in columns))) for b, part in self.parts]

    def scored(self) -> dict:
        log = np.log10(self.p)
        if len(self.asks):
            answers = self.mail["told"]
            told = np.concatenate([unpacked(answers[b], 1)[0] for b, _ in self.parts])[self.place].astype(np.float64)
            log[self.asks] = np.where(told > 0, -told / PARTS, log[self.asks])
        starts = np.cumsum(self.lengths) - self.lengths
        add = lambda x: np.add.reduceat(x, starts)
        return {"id": self.ids, "held_out": self.held, "n_tokens": self.lengths, "n_known": add((self.c > 0).astype(np.int64)), "base_score": add(np.log10(self.root)), "score": add(log)}


def sum_hot(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [unpacked(x, 3) for x in parts]
    key, first, inverse = np.unique(np.concatenate([x for x, _, _ in found]), return_index=True, return_inverse=True)
    return key, np.bincount(inverse, weights=np.concatenate([n for _, n, _ in found])), np.concatenate([p for _, _, p in found])[first]


def decide(parts: list[bytes]) -> list[bytes]:
    """A bucket's branches of the tree: for each message that it got, the logarithms in the longest states, 0 for none, in PARTS."""
    found = [unpacked(x, DEPTH + 4) for x in parts]
    ends = np.cumsum([len(x[0]) for x in found])[:-1]
    *words, following, n, first, p = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    p, told = from_parts(p), np.zeros(len(n), dtype=np.uint64)
    context, reached = np.zeros(len(n), dtype=np.uint64), np.ones(len(n), dtype=bool)
    for back, word in enumerate(words):
        context = mix(context, word)
        reached &= (first > back) | (word != UNKNOWN)
        rows = np.flatnonzero(reached & (first <= back))
        index, inverse = grouped(mix(context[rows], following[rows]))
        count = np.bincount(inverse, weights=n[rows], minlength=len(index))
        of, suffix = grouped(context[rows[index]])[1], p[rows[index]]
        sums = summed(count, suffix, of, len(index))
        state = judged(sums)[of]
        now = np.where(state, smooth(count, suffix, sums["n"][of], sums["followers"][of]), suffix)
        p[rows], reached[rows] = now[inverse], state[inverse]
        rows = rows[state[inverse]]
        told[rows] = in_parts(p[rows])
    return [packed(x) for x in np.split(told, ends)]


# --- the jobs ---


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs.

    Trained on the rows whose crc32 of the id's text, mod 5, is not 1. A null or empty text is its end
    alone. Repeated rows count and are scored each; a null id counts as training. An empty table gives
    an empty result; without training rows every token is unknown. Other columns play no part.
    """
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # all results are written tables here
    try:
        return modelled(docs, id_col, text_col)
    finally:
        spark.conf.set(CLEANUP, before)


MESSAGES = "chunk bigint, bucket bigint, data binary"
CHUNKS = "chunk bigint, ids array<{id}>, tokens binary, texts binary, words binary"


def modelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """scores(), whose last table is written already."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    word_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = encoded(docs, id_col, text_col, word_buckets)
    total, n_texts, n_tokens = (x or 0 for x in tables["text"].agg(*(F.sum(x) for x in ("n_training", "n_texts", "n_tokens"))).first())
    words = written(tables["word"].select("chunk", "bucket", "data").groupBy("bucket").applyInArrow(counter(total, word_buckets), COUNTED), "words")
    drop(tables["word"])
    distinct = words.agg(F.sum("n_known")).first()[0] or 0
    model = Model(total, total + 0.5 * (distinct + 1), n_texts, 1 + n_tokens // BUCKET_TOKENS)
    # At most HOT contexts of a length and HOT words, as each has a share of that size.
    heavy_ = tables["heavy"].groupBy("words").agg(F.sum("n_training").alias("n")).where(F.col("n") * HOT >= max(total, 1)).collect()
    id_of = {r.hash: r.id for r in words.where("hash is not null").collect()} | {START: START}
    model.with_hot([tuple(id_of[w] for w in r.words) for r in heavy_])

    chunk_schema, result_schema = CHUNKS.format(id=kind), f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    arrow, chunk_arrow, result_arrow = (arrow_schema(spark, x) for x in (MESSAGES, chunk_schema, result_schema))

    def messages(chunk: int, found: list[tuple[int, bytes]]) -> pa.Table:
        trim()
        return pa.table([pa.array([chunk] * len(found), pa.int64()), pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], schema=arrow)

    def with_words(found: pa.Table, got: pa.Table) -> pa.Table:
        order = unpacked(found.column("data")[0].as_py(), 1)[0]
        c, ids = np.zeros(len(order), dtype=np.uint64), np.zeros(len(order), dtype=np.uint64)
        known = [unpacked(x, 2) for _, x in sorted(zip(got.column("bucket").to_pylist(), got.column("data").to_pylist(), strict=True))]
        c[order], ids[order] = np.concatenate([x for x, _ in known]), np.concatenate([x for _, x in known])
        trim()
        columns = {x: found.column(x) for x in ("chunk", "ids", "tokens", "texts")} | {"words": pa.array([packed(c, ids)], pa.binary())}
        return pa.table([as_array(columns[f.name], f.type) for f in chunk_arrow], schema=chunk_arrow)

    of_chunk = words.where("chunk is not null").select("chunk", "bucket", "data")
    chunks = bucketed(tables["text"].select("chunk", "ids", "tokens", "texts", "data").groupBy("chunk").cogroup(of_chunk.groupBy("chunk")).applyInArrow(with_words, chunk_schema), "chunks", "chunk")
    drop(*tables.values(), words)

    def ask_hot(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(pa.Table.from_batches([batch.slice(i, 1)]), model)
                yield from messages(chunk.number, chunk.ask_hot()).to_batches()

    hot = learned_hot(model, written(bounded(chunks).mapInArrow(ask_hot, MESSAGES), "hot"))
    mail = hot.select(F.lit("hot").alias("kind"), "chunk", "bucket", "data")
    by_chunk = lambda more: chunks.groupBy("chunk").cogroup(more.groupBy("chunk"))

    def ask(found: pa.Table, got: pa.Table) -> pa.Table:
        chunk = Chunk(found, model, got)
        chunk.told_hot()
        chunk.ask()
        return messages(chunk.number, chunk.asked())

    def answer(found: pa.Table) -> pa.Table:
        answers = decide(found.column("data").to_pylist())
        trim()
        return pa.table([found.column("chunk"), found.column("bucket"), pa.array(answers, pa.binary())], schema=arrow)

    def score(found: pa.Table, got: pa.Table) -> pa.Table:
        chunk = Chunk(found, model, got)
        chunk.told_hot()
        chunk.ask()
        columns = chunk.scored()
        trim()
        return pa.table([as_array(columns[f.name], f.type) for f in result_arrow], schema=result_arrow)

    told = written(by_chunk(mail).applyInArrow(ask, MESSAGES).groupBy("bucket").applyInArrow(answer, MESSAGES), "told")
    out = written(by_chunk(mail.unionByName(told.select(F.lit("told").alias("kind"), "chunk", "bucket", "data"))).applyInArrow(score, result_schema), "scores")
    drop(chunks, told, hot)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def learned_hot(model: Model, asked: DataFrame) -> DataFrame:
    """The answers (chunk, bucket, data) to what chunks ask about hot contexts; the model learns which of these are states."""
    spark = asked.sparkSession
    sums_schema = "node bigint, " + ", ".join(f"{x} double" for x in SUMS)
    arrow, sums_arrow, kept_arrow = arrow_schema(spark, MESSAGES), arrow_schema(spark, sums_schema), arrow_schema(spark, "bucket bigint, data binary")

    def add(found: pa.Table) -> pa.Table:
        key, n, p = sum_hot(found.column("data").to_pylist())
        trim()
        return pa.table([found.column("bucket").slice(0, 1), pa.array([packed(key, n.astype(np.uint64), p)], pa.binary())], schema=kept_arrow)

    counts = written(asked.groupBy("bucket").applyInArrow(add, "bucket bigint, data binary"), "hot-counts")

    def sums_of(depth: int):
        def run(batches):
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    key, n, p = unpacked(data, 3)
                    suffix = model.after_hot(key, n, from_parts(p), depth)[1]
                    node = (key >> ID_BITS).astype(np.int64)
                    at = np.flatnonzero(model.depth[node] == depth)
                    nodes, of = np.unique(node[at], return_inverse=True)
                    sums = summed(n[at].astype(np.float64), suffix[at], of, len(nodes))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.array(sums[x], pa.float64()) for x in SUMS)], schema=sums_arrow)
            trim()

        return run

    for depth in range(1, int(model.depth.max()) + 1):
        sums = counts.select("data").mapInArrow(sums_of(depth), sums_schema).groupBy("node").agg(*(F.sum(x).alias(x) for x in SUMS)).toPandas()  # at most HOT rows
        model.learn(depth, {x: sums[x].to_numpy(np.float64) for x in SUMS}, sums["node"].to_numpy(np.int64))

    def answer(found: pa.Table, known: pa.Table) -> pa.Table:
        key, n, p = unpacked(known.column("data")[0].as_py(), 3)
        p = in_parts(model.after_hot(key, n, from_parts(p))[0])
        answers = []
        for data in found.column("data").to_pylist():
            asked = unpacked(data, 3)[0]
            answers.append(packed(asked, p[np.searchsorted(key, asked)]))
        trim()
        return pa.table([found.column("chunk"), found.column("bucket"), pa.array(answers, pa.binary())], schema=arrow)

    out = written(asked.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(answer, MESSAGES), "hot-told")
    drop(asked, counts)
    return out
