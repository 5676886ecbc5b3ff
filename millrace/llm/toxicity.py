"""Toxicity as matched clauses of a weighted finite-state grammar.

A tagger turns words into symbols: insult, threat, target, negation, report, quotation mark, clause
end, other. Three letter-to-letter transducers then run one on the other's output, composed into a
single table: negation defuses insults and threats in its scope, reported speech marks those that
are only quoted, and the clause machine gathers what a clause holds and emits its kind at the
clause's end. A document's score comes from the kinds of its clauses, never from a word by itself.

The insults are a short fixed list and word stems learned from labelled documents; the kinds' weights
are learned from the same documents. Both come from a bounded sample of labelled rows: of each label
FIT_DOCS documents at most, the first by the hash of their ids. Each label's documents count in the
proportion that the label has among all labelled rows, however many of them the sample holds.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, crc_mod, drop, map_batches, texts, written
from .quality import binomial_cdf

#: Labelled documents of each label that the grammar is fitted on, at most; and from what score on a document counts as toxic.
FIT_DOCS, TOXIC_FROM = 4000, 0.7
#: A stem is learned if its share of toxic documents is certainly over the sample's own share and LIFT of the
#: rest, at level ERRORS over the sample's documents, and if its left neighbours vary, as copies' do not.
LIFT, ERRORS, STEM_LENGTHS = 0.2, 0.2, range(4, 9)
#: Words whose tags one worker remembers.
CACHE_ENTRIES = 500_000
#: Words a negation or a verb of speech reaches over.
NEGATED, REPORTED = 3, 3

#: Words of the grammar in English, German, French and Spanish.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash clown pathetic worthless disgusting imbecile bastard idiota imbécil estúpido imbécile dummkopf trottel"
THREATS = "kill hurt murder strangle shoot stab destroy töten umbringen schlagen tuer frapper égorger matar golpear"
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes tus"
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie pas jamais nunca jamás nadie"
REPORTS = "said says say wrote writes told called calls claimed reported quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó"
#: Symbols: other, insult, threat, target, negation, report, quotation mark, clause end, end of a line or the text; D defused, S only said.
SYMBOLS = "OITYNRQEL"
#: Kinds of clauses, the strongest last; the share of toxic documents that is expected of each without evidence, worth PRIOR documents.
KINDS, PRIOR = {"none": 0.05, "defused": 0.15, "said": 0.2, "insult": 0.8, "threat": 0.8, "insult at target": 0.9}, 2.0

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]+|[\"“”«»]")

Step = Callable[[int, str], tuple[int, str]]


def negation(state: int, symbol: str) -> tuple[int, str]:
    """State: how many words a negation still reaches."""
    if symbol == "N":
        return NEGATED, "O"
    if symbol in "EL":
        return 0, symbol
    return max(0, state - 1), "D" if state and symbol in "IT" else symbol


def report(state: int, symbol: str) -> tuple[int, str]:
    """State: how many words a verb of speech still reaches; -1 within the quotation it opens, to the end of the line at most."""
    if symbol == "L":
        return 0, "E"
    if state == -1:
        return (0, "O") if symbol == "Q" else (-1, "S" if symbol in "IT" else "O" if symbol == "E" else symbol)
    if symbol == "R":
        return REPORTED, "O"
    if symbol == "Q":
        return (-1 if state else 0), "O"
    if symbol == "E":
        return 0, symbol
    return max(0, state - 1), "S" if state and symbol in "IT" else symbol


def clause(state: int, symbol: str) -> tuple[int, str]:
    """State: bits for insult, target, threat, threat at a target, defused, said. Emits the kind's number at the end."""
    if symbol == "E":
        insult, target, _, aimed, defused, said = (state >> i & 1 for i in range(6))
        kind = 5 if insult and target else 4 if aimed else 3 if insult else 2 if said else 1 if defused else 0
        return 0, str(kind)
    bits = {"I": 1, "T": 4, "D": 16, "S": 32}.get(symbol, 0)
    if symbol == "Y":
        bits = 2 | (8 if state & 4 else 0)
    return state | bits, ""


def compose(first: Callable, second: Callable) -> Callable:
    """The machine that feeds first's output to second; its states are pairs."""

    def step(state, symbol):
        a, middle = first(state[0], symbol)
        b, out = second(state[1], middle)
        return (a, b), out

    return step


def table(step: Callable, start) -> dict[tuple[int, str], tuple[int, str]]:
    """All states that are reached from start, numbered, with what follows for each symbol."""
    number, todo, out = {start: 0}, [start], {}
    for state in todo:
        for symbol in SYMBOLS:
            following, emitted = step(state, symbol)
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            out[number[state], symbol] = (number[following], emitted)
    return out


def grammar() -> dict[tuple[int, str], tuple[int, str]]:
    return table(compose(compose(negation, report), clause), ((0, 0), 0))


def base_tags() -> dict[str, str]:
    """The fixed words' symbols; insults win over what else a word may be."""
    out: dict[str, str] = {}
    for words, symbol in ((INSULTS, "I"), (THREATS, "T"), (TARGETS, "Y"), (NEGATIONS, "N"), (REPORTS, "R")):
        for w in words.split():
            out.setdefault(w, symbol)
    return out


class Tagger(dict):
    """Token -> symbol; stems end in *."""

    def __init__(self, lexicon: Iterable[str]):
        super().__init__()
        self.fixed = base_tags()
        lexicon = set(lexicon)
        self.stems = {x[:-1] for x in lexicon if x.endswith("*")}
        self.fixed |= {x: "I" for x in lexicon if not x.endswith("*")}
        self.lengths = sorted({len(x) for x in self.stems})

    def __missing__(self, token: str) -> str:
        if token[0] in ".!?;\n":
            symbol = "L" if "\n" in token else "E"
        elif token in "\"“”«»":
            symbol = "Q"
        else:
            symbol = self.fixed.get(token) or ("I" if any(len(token) > n and token[:n] in self.stems for n in self.lengths) else "O")
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = symbol
        return symbol


def clause_kinds(text: str, tagger: Tagger, machine: dict) -> list[int]:
    """The kinds of the text's clauses, those of no kind aside."""
    tags = "".join([tagger[t] for t in TOKEN.findall(text.lower())])
    if "I" not in tags and "T" not in tags:
        return []
    state, found = 0, []
    for symbol in tags + "L":
        state, emitted = machine[state, symbol]
        if emitted and emitted != "0":
            found.append(int(emitted))
    return found


def features(text: str) -> dict[str, int]:
    """Words and stems of a text, each with a set of 64 bits that its left neighbours' hashes fill."""
    out: dict[str, int] = defaultdict(int)
    before = ""
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        bit = 1 << (zlib.crc32(before.encode()) & 63)
        out[word] |= bit
        for n in STEM_LENGTHS:
            if len(word) > n:
                out[word[:n] + "*"] |= bit
        before = word
    return out


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of rows outside the held-out third. Of repeated labels the greatest counts."""
    return labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def label_weights(labels: DataFrame, fit_docs: int) -> tuple[float, float]:
    """What a clean and a toxic document of the sample stand for: all rows of the label over sampled ones, in units of all rows over sampled ones."""
    counted = {r["toxic"]: r["n"] for r in known_labels(labels).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_, sampled = sum(counted.values()), sum(min(n, fit_docs) for n in counted.values())
    return tuple(counted[t] / min(counted[t], fit_docs) * sampled / all_ if t in counted else 1.0 for t in (0, 1))


def training(docs: DataFrame, labels: DataFrame, fit_docs: int) -> DataFrame:
    """(text, toxic) of the sample: rows outside the held-out third, fit_docs of each label at most, the first by the hash of the id.

    Only the ids, at most 2 * fit_docs, are broadcast.
    """
    known = known_labels(labels)
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs) for t in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learn_lexicon(sample: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> list[str]:
    """Words and stems that mark toxic documents. The sample's bound holds for what is gathered here. weights: as of label_weights().

    The bar is set in shares of all labelled rows and then brought to the sample's mix, so that the test counts documents as sampled.
    """
    of_clean, of_toxic = weights
    arrow = arrow_schema(sample.sparkSession, "feature string, toxic bigint, clean bigint, beside bigint")

    def count(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                for feature, beside in features(text).items():
                    row = found.setdefault(feature, [0, 0, 0])
                    row[1 - toxic] += 1
                    row[2] |= beside if toxic else 0
        signed = [x[2] - (1 << 64) if x[2] >> 63 else x[2] for x in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64()), pa.array(signed, pa.int64())], schema=arrow)

    total = sample.mapInArrow(count, "feature string, toxic bigint, clean bigint, beside bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("beside")).alias("beside"))
    rows = total.where((F.col("toxic") >= 5) & (F.col("toxic") * of_toxic > F.col("clean") * of_clean) & (F.col("beside") >= F.least(F.col("toxic"), F.lit(32)) * 0.4)).collect()
    docs, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = toxic * of_toxic / max(1e-9, toxic * of_toxic + (docs - toxic) * of_clean)
    share += LIFT * (1 - share)
    share = share / of_toxic / (share / of_toxic + (1 - share) / of_clean)
    good = sorted((r.feature for r in rows if binomial_cdf(r.clean, r.toxic + r.clean, 1 - share) <= ERRORS / docs), key=lambda x: (len(x), x))
    chosen: set[str] = set()
    for feature in good:  # short stems first; what one of them covers adds nothing
        word = feature.rstrip("*")
        if not any(word[:n] + "*" in chosen for n in range(1, len(word) + (feature[-1] == "*"))):
            chosen.add(feature)
    return sorted(chosen)


def learn_weights(sample: DataFrame, lexicon: list[str], weights: tuple[float, float] = (1.0, 1.0)) -> dict[int, float]:
    """For each kind, the share of toxic documents among those of which it is the strongest kind. weights: as of label_weights()."""
    kinds = clauses(sample, lexicon, ["toxic"]).groupBy(F.coalesce(F.array_max("kinds"), F.lit(0)).alias("kind")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    seen = {r.kind: (r.toxic * weights[1], r.toxic * weights[1] + (r.n - r.toxic) * weights[0]) for r in kinds}
    return {k: (seen.get(k, (0, 0))[0] + PRIOR * share) / (seen.get(k, (0, 0))[1] + PRIOR) for k, share in enumerate(KINDS.values())}


def clauses(docs: DataFrame, lexicon: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``kinds``, the kinds of the clauses that the grammar matches in each whole text."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}

    def make():
        tagger, machine = Tagger(lexicon), grammar()

        def each(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in keep} | {"kinds": [clause_kinds(x, tagger, machine) for x in texts(batch)]}

        return each

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), make, ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), "kinds array<int>"]))


def toxicity(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted, kinds) of each row of docs.

    The strongest clause sets the score; each further matched clause halves half of what is left to 1.
    Null and empty texts match nothing and get the score of a text without matches. Without labels the
    fixed words and prior shares are left. Repeated rows are scored alike; a null id is not held out.
    Other columns, lang and source among them, play no part. Texts are scored where they lie.
    """
    sample = written(training(docs, labels, fit_docs), "fit-sample")
    of_label = label_weights(labels, fit_docs)
    lexicon = learn_lexicon(sample, of_label)
    weights = learn_weights(sample, lexicon, of_label)
    drop(sample)
    found = clauses(docs, lexicon, ["doc_id"])
    weight = F.array(*(F.lit(weights[k]) for k in range(len(KINDS))))
    best = F.when(F.size("kinds") == 0, weights[0]).otherwise(F.array_max(F.transform("kinds", lambda k: F.element_at(weight, k + 1))))
    more = F.when(F.size("kinds") < 2, 0.0).otherwise(0.5 - F.pow(F.lit(0.5), F.size("kinds")))
    scored = found.withColumn("score", best).withColumn("score", F.when(F.col("score") >= TOXIC_FROM, F.col("score") + (1 - F.col("score")) * more).otherwise(F.col("score")))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), F.size("kinds").alias("n_clauses"))
