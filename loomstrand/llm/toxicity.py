"""Toxicity: misspelled lexicon terms by automaton, weighed by their context.

The lexicon holds whole words and stems. The stems stand for any word that
begins with them; whole words of FUZZY letters and more are also found with
one letter wrong, missing or too many. Levenshtein automata of the words run
along the lexicon's trie; the product is made deterministic once, over the
classes of letters that the lexicon tells apart, and then read by all words of
a block of texts at the same time, one letter a step.

A hit between quotation marks, or after a word that reports speech, counts a
fraction of a plain hit. A logistic function of the log of the weighted hits
gives the score; lexicon, term weights and that function are learned from a
bounded sample of labelled rows.

Defined results: null and empty texts have no hits and get the lowest score;
without labels of both kinds the given seeds are the lexicon and the function
has fixed values; a null id is kept, and is never held out; rows that repeat
are scored each.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, sample, text_of

#: Terms of common abuse that need no label to be listed.
SEEDS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting")
#: Words that report what someone else said.
REPORTS = frozenset("said says wrote writes called calls quote quoted quotes word term sagte schrieb dit écrit dijo escribió".split())
QUOTES = frozenset("\"'“”„«»‘’‹›")
#: Labelled rows that are learned from, at most: toxic ones, clean ones.
TRAIN_ROWS = (1200, 4000)
#: Rows whose checksum leaves this rest are never learned from: (divisor, rest).
HELD = (3, 1)
#: Letters of a whole word from which on one error is allowed; lengths of stems.
FUZZY, STEMS = 5, (4, 5, 6, 7)
#: Share of a hit that a misspelled one and a quoted one count.
MISSPELLED, QUOTED = 0.9, 0.2
#: How pure a term must be, and the chance that any term is listed by accident.
PURE, SURE = 0.97, 0.01
LETTERS = re.compile(r"[^\W\d_]+")
#: Characters that count as a wrong letter between two letters.
MASKS = "@$*!0123456789"
#: Characters of one block of texts, about.
BLOCK_CHARS = 1 << 20


@dataclass
class Lexicon:
    """Terms with weights, and the automaton that finds them."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def compiled(self) -> Automaton:
        return Automaton(self.words, self.stems)


class Automaton:
    """Trie of all terms times Levenshtein automata of the long words, as tables.

    ``step[state * classes + class]``: the next state; state 0 is dead.
    ``term[state]``: the term that a word ending in that state is, or -1;
    ``cost[state]``: errors made; ``stem[state]``: whether a longer word is it too.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.terms, self.stem_terms = [*words, *stems], [*stems]
        self.weights = np.array([*words.values(), *stems.values()])
        letters = sorted(set("".join(self.terms)))
        self.classes = len(letters) + 2  # 0: not part of a word; 1: another letter
        code = {c: i + 2 for i, c in enumerate(letters)}
        self.code = code
        children: list[dict[int, int]] = [{}]
        last: dict[int, int] = {}
        fuzzy: set[int] = set()  # nodes on the way to a long whole word
        for i, term in enumerate(self.terms):
            node, path = 0, [0]
            for c in term:
                node = children[node].setdefault(code[c], len(children))
                if node == len(children):
                    children.append({})
                path.append(node)
            last.setdefault(node, i)
            if i < len(words) and len(term) >= FUZZY:
                fuzzy.update(path)
        ends_fuzzy = {n for n, i in last.items() if i < len(words) and len(self.terms[i]) >= FUZZY}
        ends_stem = {n for n, i in last.items() if i >= len(words)}

        def closed(items: set) -> frozenset:
            """With a letter left out; of two error counts at a node the lower."""
            out = set(items)
            for node, errors in items:
                if errors == 0 and node:
                    out |= {(n, 1) for n in children[node].values() if n in fuzzy}
            return frozenset((n, e) for n, e in out if not (e and (n, 0) in out))

        first = closed({(0, 0)})
        number, states, step = {frozenset(): 0, first: 1}, [frozenset(), first], [[0] * self.classes]
        at = 1
        while at < len(states):
            row = [0] * self.classes
            for c in range(1, self.classes):
                after = set()
                for node, errors in states[at]:
                    if c in children[node]:
                        to = children[node][c]
                        if errors == 0 or to in fuzzy:
                            after.add((to, errors))
                    if errors == 0 and node in fuzzy and node:  # the first letter is never wrong
                        after.add((node, 1))
                        after |= {(n, 1) for n in children[node].values() if n in fuzzy}
                key = closed(after)
                if key not in number:
                    number[key] = len(states)
                    states.append(key)
                row[c] = number[key]
            step.append(row)
            at += 1
        self.step = np.array(step, np.int32).ravel()
        n = len(states)
        self.term, self.cost, self.stem = np.full(n, -1, np.int32), np.zeros(n, np.int8), np.zeros(n, bool)
        for i, state in enumerate(states):
            ends = [(e, last[node], node) for node, e in state if node in last and (e == 0 or node in ends_fuzzy)]
            if ends:
                e, term, node = min(ends)
                self.term[i], self.cost[i] = term, e
                self.stem[i] = e == 0 and node in ends_stem
        table = np.zeros(0x110000, np.uint8 if self.classes < 256 else np.uint16)
        low = [chr(c).lower() for c in range(0x250)]
        for c in range(0x250):
            if chr(c).isalpha():
                table[c] = code.get(low[c], 1) if len(low[c]) == 1 else 1
        table[0x250:0x2000] = 1
        table[0x2C00:0x2E00] = 1
        table[0x3040:0x1F000] = 1
        self.table = table
        self.masks = np.array([ord(c) for c in MASKS], np.uint32)

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First code points, lengths and states of all words that are terms."""
        kinds = self.table[text]
        inside = kinds > 0
        if len(text) > 2:  # a mask between two letters is a letter
            masked = np.flatnonzero(inside[:-2] & ~inside[1:-1] & inside[2:]) + 1
            masked = masked[np.isin(text[masked], self.masks)]
            kinds = kinds.copy()
            kinds[masked], inside[masked] = 1, True
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at, end = starts, stops
        state = np.ones(len(starts), np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        index, depth = np.arange(len(starts)), 0
        while len(index):
            state = self.step[state * self.classes + kinds[at[index] + depth]]
            depth += 1
            over = at[index] + depth == end[index]
            hit = (self.term[state] >= 0) & (over | self.stem[state])
            if hit.any():
                found.append((starts[index[hit]], (stops - starts)[index[hit]], state[hit]))
            go = (state > 0) & ~over & ~hit
            index, state = index[go], state[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def quoted(text: str, first: int, last: int) -> bool:
    """Whether the span stands between quotation marks of its line, or after a word that reports."""
    line = text.rfind("\n", 0, first) + 1
    stop = text.find("\n", last)
    before, after = text[max(line, first - 60) : first], text[last : min(len(text) if stop < 0 else stop, last + 60)]
    if any(c in QUOTES for c in before[-2:]) and any(c in QUOTES for c in after[:3]):
        return True
    if sum(before.count(c) for c in '"“”«»') % 2 and any(c in QUOTES for c in after):
        return True
    return any(w in REPORTS for w in LETTERS.findall(before.lower())[-3:])


def found(texts: list[str], automaton: Automaton) -> list[list[tuple[int, int, int, int, bool]]]:
    """(first, last, term, errors, quoted) of the hits in each text."""
    out: list[list] = [[] for _ in texts]
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high]) <= BLOCK_CHARS):
            size += len(texts[high]) + 1
            high += 1
        flat = np.frombuffer("\n".join(texts[low:high]).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[low:high]])
        starts, lengths, states = automaton.hits(flat)
        which = np.searchsorted(bounds, starts, "right") - 1
        for i, first, n, state in sorted(zip(which.tolist(), (starts - bounds[which]).tolist(), lengths.tolist(), states.tolist(), strict=True)):
            out[low + i].append((first, first + n, int(automaton.term[state]), int(automaton.cost[state]), quoted(texts[low + i], first, first + n)))
        low = high
    return out


def weighed(hits: list[tuple[int, int, int, int, bool]], automaton: Automaton) -> float:
    return float(sum(automaton.weights[t] * (MISSPELLED if e else 1) * (QUOTED if q else 1) for _, _, t, e, q in hits))


def families(texts: list[str]) -> list[str]:
    """One text of each set of near copies, told by their smallest run of eight words: copies are no evidence of their own."""
    seen, out = set(), []
    for text in texts:
        words = LETTERS.findall(text.lower())
        name = min((zlib.crc32(" ".join(words[i : i + 8]).encode()) for i in range(max(1, len(words) - 7))), default=0)
        if name not in seen:
            seen.add(name)
            out.append(text)
    return out


def mined(toxic: list[str], clean: list[str], seeds: tuple[str, ...] = SEEDS) -> Lexicon:
    """Words and stems that toxic texts hold and clean ones don't, by the number of texts.

    A term must be too frequent in toxic texts for chance, given how many
    terms were looked at (a log-likelihood ratio against SURE).
    """

    def counted(texts: list[str]) -> tuple[Counter, Counter]:
        words, stems = Counter(), Counter()
        for text in texts:
            own = set(LETTERS.findall(text.lower()))
            words.update(own)
            stems.update({w[:n] for w in own for n in STEMS if len(w) > n})
        return words, stems

    toxic, clean = families(toxic), families(clean)
    bad_words, bad_stems = counted(toxic)
    good_words, good_stems = counted(clean)
    share = len(toxic) / max(len(toxic) + len(clean), 1)

    def purity(bad: int, good: int) -> float:
        rate = bad / max(len(toxic), 1)
        return rate / (rate + good / max(len(clean), 1)) if bad else 0.0

    def listed(bad: int, good: int, looked_at: int) -> bool:
        if bad < 3 or purity(bad, good) < PURE or not 0 < share < 1:
            return False
        n, ratio = bad + good, 0.0
        for k, p in ((bad, share), (good, 1 - share)):
            ratio += 2 * k * math.log(k / (n * p)) if k else 0
        return ratio > 2 * math.log(looked_at / SURE)

    whole = {w: purity(n, good_words[w]) for w, n in bad_words.items() if len(w) >= 3 and listed(n, good_words[w], len(bad_words))}
    stems: dict[str, float] = {}
    for p, n in sorted(bad_stems.items(), key=lambda x: (len(x[0]), x[0])):
        if any(p.startswith(q) for q in stems) or not listed(n, good_stems[p] + good_words[p], len(bad_stems)):
            continue
        if max((bad_words[w] for w in bad_words if w.startswith(p)), default=0) < 0.6 * n:  # many words, not one
            stems[p] = purity(n, good_stems[p] + good_words[p])
    words = {w: x for w, x in whole.items() if not any(w.startswith(p) for p in stems)}
    for w in seeds:
        words.setdefault(w, max(purity(bad_words[w], good_words[w]), 1 - good_words[w] / max(len(clean), 1)))
    return Lexicon(words, stems)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 5e-4, turns: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic regression, by Newton's method; both kinds weigh the same."""
    z = np.stack([x, np.ones_like(x)], 1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    b = np.zeros(2)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-z @ b))
        grad = z.T @ (weight * (p - y)) + ridge * len(y) * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(2)
        change = np.linalg.solve(hess, grad)
        b -= change
        if np.abs(change).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


@dataclass
class Model:
    """automaton; logistic function; words that clean texts hold though they are a letter off a term."""

    automaton: Automaton
    slope: float
    intercept: float
    fine: frozenset = frozenset()

    def hits(self, texts: list[str]) -> list[list]:
        return [[h for h in hits if not h[3] or text[h[0] : h[1]].lower() not in self.fine] for text, hits in zip(texts, found(texts, self.automaton), strict=True)]

    def score(self, hits: list) -> float:
        return float(1 / (1 + np.exp(-(self.slope * np.log1p(weighed(hits, self.automaton)) + self.intercept))))


#: Slope and intercept where no labels can be learned from.
PLAIN = (6.0, -3.0)


def learned(toxic: list[str], clean: list[str]) -> Model:
    automaton = mined(toxic, clean).compiled()
    if not toxic or not clean:
        return Model(automaton, *PLAIN)
    fine = frozenset(text[a:b].lower() for text, hits in zip(clean, found(clean, automaton), strict=True) for a, b, _, e, _ in hits if e)
    model = Model(automaton, *PLAIN, fine)
    x = np.log1p([weighed(h, automaton) for h in model.hits(toxic + clean)])
    slope, intercept = fitted(x, np.array([1.0] * len(toxic) + [0.0] * len(clean)))
    return Model(automaton, max(slope, 0.1), intercept, fine)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows: tuple[int, int] = TRAIN_ROWS) -> Model:
    return learned(*sample(docs, labels.where(~held_out(id_col, *HELD)), label, id_col, text_col, rows))


_HITS = "array<struct<first:int,last:int,term:string,errors:int,quoted:boolean>>"


def scored(model, with_hits: bool):
    """Rows (id, text) to (id, score[, hits])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("term", pa.string()), ("errors", pa.int32()), ("quoted", pa.bool_())]))
        for batch in batches:
            hits = m.hits(batch.column(1).to_pylist())
            columns = [batch.column(0), pa.array([m.score(h) for h in hits], pa.float64())]
            if with_hits:
                columns.append(pa.array([[{"first": a, "last": b, "term": m.automaton.terms[t], "errors": e, "quoted": q} for a, b, t, e, q in h] for h in hits], kind))
            yield pa.RecordBatch.from_arrays(columns, ["id", "score", "hits"][: len(columns)])

    return run


def scores(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_hits: bool = True) -> DataFrame:
    """(id, score, hits) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(scored(spark.sparkContext.broadcast(model), with_hits), f"id {kind}, score double" + f", hits {_HITS}" * with_hits)


def report(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    out = scores(spark, docs, train(docs, labels), with_hits=False).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out("doc_id", *HELD).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows with a score below ``least``, with all their columns; no row is shuffled."""
    shared, names = spark.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            hits = m.hits([t or "" for t in batch.column(names.index(text_col)).to_pylist()])
            yield batch.filter(pa.array([m.score(h) < least for h in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
