"""Toxicity from a learned lexicon, matched by Levenshtein automata and weighed in context windows.

Terms and stems that labelled texts single out form a trie. Misspelled terms are found by running words through the
product of the trie with a Levenshtein automaton (substitution, insertion, omission), whose states are made as they
are met and kept. Each match is weighed in the window of words around it: matches close together add up, those
within quotation marks or after a reporting word count as quoted. A logistic model joins the sums to a score.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_batches, slices, texts, written
from .sampling import by_hash

#: Bytes of a lower-case text that are not in words.
_SPLIT = bytes(c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256)).replace(b"'", b" ")
_TOKEN = re.compile(r"[^\x00-\x60\x7b-\x7f]+")
_QUOTES = "\"“”„«»‘’"
_REPORTING = frozenset("said says say wrote writes called calls quoted quote quoting dit disait écrit sagte sagt schrieb dijo dice escribió".split())
#: The context window of a match: words around it whose matches add up, and characters on each side of it in which
#: quotation marks on its line make it a quoted one.
WINDOW, QUOTE_REACH = 10, 160
LEVELS = 60
STEM = 2
#: More edits than any term allows.
FAR = 9


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def edits(term: str) -> int:
    """Misspellings that a term may have: none under 5 letters, two from 9 on."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The trie of terms and stems times a Levenshtein automaton, determinised as words are read.

    A state is a set of nodes with the edits so far; its answer is the best term that ends there: fewest edits, then most
    weight. A stem is met once its node is reached without edits, whatever follows.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float], most_states: int = 50_000):
        self.children: list[dict[str, int]] = [{}]
        self.most = [-1]  # the most edits that a term below the node allows
        self.term: list[tuple[int, float] | None] = [None]
        self.stem: list[float | None] = [None]
        for table, is_stem in ((terms, False), (stems, True)):
            for word, weight in table.items():
                node, allowed = 0, 0 if is_stem else edits(word)
                for c in word:
                    self.most[node] = max(self.most[node], allowed)
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({}), self.most.append(-1), self.term.append(None), self.stem.append(None)
                    node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
                if is_stem:
                    self.stem[node] = weight
                else:
                    self.term[node] = (allowed, weight)
        # (child, most edits below it) of each node, for steps that try them all
        self.below = [tuple((x, self.most[x]) for x in c.values()) for c in self.children]
        self.most_states = most_states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.answers: list[tuple[int, float] | None] = []
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self.state({0: 0})

    def state(self, items: dict[int, int]) -> int:
        """The state of these nodes, each with its fewest edits, and all that omitted letters reach. -1: nothing can
        match any more."""
        todo = list(items)
        while todo:
            node = todo.pop()
            used = items[node] + 1
            for child, most in self.below[node]:
                if most >= used and items.get(child, FAR) > used:
                    items[child] = used
                    todo.append(child)
        if not items:
            return -1
        key = frozenset(items.items())
        if key not in self.ids:
            ends = [(used, -self.term[n][1]) for n, used in items.items() if self.term[n] and used <= self.term[n][0]]
            best = min(ends, default=None)
            self.ids[key] = len(self.sets)
            self.answers.append(best and (best[0], -best[1]))
            self.sets.append(key)
            self.steps.append({})
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        children, most = self.children, self.most
        for node, used in self.sets[state]:
            child = children[node].get(c)
            if child is not None and most[child] >= used and out.get(child, FAR) > used:
                out[child] = used
            if used < most[node]:
                used += 1
                if out.get(node, FAR) > used:
                    out[node] = used
                for x, allowed in self.below[node]:
                    if allowed >= used and out.get(x, FAR) > used:
                        out[x] = used
        return self.state(out)

    def match(self, word: str) -> tuple[int, float] | None:
        """(kind, weight) of a word; kind 0: a term as it is, 1: misspelled, STEM: begins with a stem."""
        if len(self.sets) > self.most_states:
            self.reset()
        node, stem = 0, None
        for c in word:
            node = self.children[node].get(c)
            if node is None:
                break
            if self.stem[node] is not None:
                stem = max(stem or 0.0, self.stem[node])
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            if to is None:
                to = self.steps[state][c] = self.step(state, c)
            if to < 0:
                state = -1
                break
            state = to
        answer = self.answers[state] if state >= 0 else None
        if answer and not answer[0]:
            return 0, answer[1]
        if stem is not None:
            return STEM, stem
        return (1, answer[1]) if answer else None


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    weights: list[float] | None = None
    scale: list[float] | None = None
    prior: float = 0.0
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


N_FEATURES = 7


class _Codes(dict):
    """One byte for a word: 0 if it matches nothing, else its kind and weight level."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: bytes) -> int:
        if (code := self.older.get(word)) is None:
            found = self.automaton.match(word.decode("utf-8", "replace"))
            code = 1 + found[0] * LEVELS + min(LEVELS - 1, int(found[1] * 6)) if found else 0
        if len(word) <= 64:
            if len(self) >= 300_000:
                self.older = dict(self)
                self.clear()
            self[word] = code
        return code


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.codes = _Codes(Automaton(model.terms, model.stems))

    def features(self, text: str) -> list[float]:
        """Log sums of weights by kind, of the heaviest window, of quoted matches; density; whether any matches."""
        coded = bytes(map(self.codes.__getitem__, words(text)))
        if not coded.strip(b"\0"):
            return [0.0] * N_FEATURES
        at = np.flatnonzero(np.frombuffer(coded, np.uint8))
        code = np.frombuffer(coded, np.uint8)[at].astype(np.int64) - 1
        kind, weight = code // LEVELS, (code % LEVELS + 0.5) / 6
        quoted = np.array(self._quoted(text, at))
        sums = [float(weight[kind == k].sum()) for k in range(3)]
        open_ = np.where(quoted, 0.0, weight)
        total = np.concatenate([[0.0], np.cumsum(open_)])
        window = total[np.searchsorted(at, at + WINDOW, "right")] - total[np.searchsorted(at, at - WINDOW, "left")]
        return [*(float(np.log1p(s)) for s in sums), float(np.log1p(window.max())), float(weight[quoted].sum() / weight.sum()), float(np.log1p(100 * weight.sum() / len(coded))), float(np.log1p(len(at)))]

    @staticmethod
    def _quoted(text: str, at: np.ndarray) -> list[bool]:
        """Whether each matching word stands between quotation marks or soon after a reporting word."""
        low = text.lower()
        want, out, recent, i = set(at.tolist()), [], [], 0
        for i, m in enumerate(_TOKEN.finditer(low)):
            if i in want:
                before, after = low[max(0, m.start() - QUOTE_REACH) : m.start()], low[m.end() : m.end() + QUOTE_REACH]
                marks = sum(c in _QUOTES for c in before.rpartition("\n")[2]) % 2 and any(c in _QUOTES for c in after.partition("\n")[0])
                out.append(bool(marks) or any(w in _REPORTING for w in recent))
            recent = [*recent[-3:], m[0]]
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), features / np.array(self.model.scale)]) if self.model.weights else None
        if x is None:
            return np.full(len(features), self.model.prior)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic model; the first column (ones) is not penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, most_terms: int | None = None, most_stems: int | None = None, least_docs: int = 4) -> Model:
    """Fit to docs(doc_id, text) and labels(doc_id, toxic), from about `most` labelled rows (the sample's bound).

    The lexicon has all terms and stems of `least_docs` toxic texts or more that single out toxic texts well (the sample
    bounds them), or the best `most_terms` and `most_stems` of them. The logistic model learns how far to trust matches from texts that the lexicon has not
    seen: each half of the sample is matched with the lexicon of the other half. Null labels are left out; of several
    labels of a document the largest counts. Without labels of both kinds all scores are the labels' mean, or 0.
    """
    given = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = by_hash(given.withColumn("all", F.lit(1)), "doc_id", "all", most, "toxicity").select("doc_id", "toxic")
    # The sample's labels are at most about `most` rows.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = written(sample.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)).cast("int")))
    totals = {(r.part, r.toxic): r.n for r in rows.groupBy("part", "toxic").agg(F.count("*").alias("n")).collect()}
    size = lambda toxic, *parts: sum(totals.get((p, toxic), 0) for p in parts)
    if not size(0, 0, 1) or not size(1, 0, 1):
        return Model({}, {}, prior=float(given.agg(F.avg("toxic")).first()[0] or 0.0))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, toxic, part in zip(texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = {w.decode("utf-8", "replace") for w in words(text)}
                stems = {w[:n] for w in own for n in range(4, min(len(w), 9))}
                for key in [(w, False) for w in own] + [(w, True) for w in stems]:
                    counts.setdefault(key, [0, 0, 0, 0])[2 * part + toxic] += 1
            if len(counts) > 500_000:
                yield emitted(counts)
                counts = {}
        yield emitted(counts)

    def emitted(counts: dict) -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *(pa.array([counts[k][i] for k in keys], pa.int64()) for i in range(4))], ["word", "is_stem", "clean0", "toxic0", "clean1", "toxic1"])

    found = map_batches(rows.select("doc_id", "text", "toxic", "part"), vocabulary, "word string, is_stem boolean, clean0 long, toxic0 long, clean1 long, toxic1 long")
    counted = found.groupBy("word", "is_stem").agg(*[F.sum(c).alias(c) for c in ("clean0", "toxic0", "clean1", "toxic1")])
    some = checkpoint(counted.filter(F.col("toxic0") + F.col("toxic1") >= least_docs))

    def lexicon(*parts: int) -> Model:
        clean, toxic = (sum((F.col(f"{c}{p}") for p in parts), F.lit(0)) for c in ("clean", "toxic"))
        odds = F.log((F.col("toxic") + 0.5) / (size(1, *parts) + 1)) - F.log((F.col("clean") + 0.5) / (size(0, *parts) + 1))
        # Two standard errors below the odds a term must still be well above chance; few texts make large errors.
        error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
        own = some.select("word", "is_stem", clean.alias("clean"), toxic.alias("toxic")).withColumn("odds", odds)
        strong = own.filter((F.col("toxic") >= max(2, least_docs * len(parts) // 2)) & (F.col("odds") >= 3.0) & (F.col("odds") - 2 * error >= 0.75)).withColumn("rank", F.col("odds") * F.sqrt("toxic"))
        ranked = lambda stems: strong.filter(F.col("is_stem") == stems).orderBy(F.desc("rank"), "word")
        top = lambda stems, n: (ranked(stems) if n is None else ranked(stems).limit(n)).collect()
        terms = {r.word: r.odds for r in top(False, most_terms)}
        stems: dict[str, float] = {}
        for r in sorted(top(True, most_stems), key=lambda r: len(r.word)):
            # a stem of one term alone adds nothing to it
            if not any(r.word[:n] in stems for n in range(4, len(r.word))) and sum(t.startswith(r.word) for t in terms) != 1:
                stems[r.word] = r.odds
        return Model(terms, stems)

    final = lexicon(0, 1)
    matched = [_features(rows.filter(F.col("part") == 1 - p).select("toxic", "text"), lexicon(p), "toxic int").toArrow() for p in (0, 1)]
    y = np.concatenate([m.column(0).to_numpy() for m in matched]).astype(float)
    x = np.array([f for m in matched for f in m.column(1).to_pylist()], float)
    scale = np.maximum(x.std(0), 1e-6)
    return Model(final.terms, final.stems, logistic(np.column_stack([np.ones(len(x)), x / scale]), y).tolist(), scale.tolist())


_made: dict[str, Scorer] = {}


def _scorer(model: Model) -> Scorer:
    if model.key not in _made:
        _made.clear()
        _made[model.key] = Scorer(model)
    return _made[model.key]


def _features(rows: DataFrame, model: Model, own: str) -> DataFrame:
    """First column of rows(first, text) and the features of its text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # a bounded lexicon

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in slices(batches):
            found = [scorer.features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [batch.schema.names[0], "features"])

    return map_batches(rows, find, f"{own}, features array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and features (array) of all rows of docs(doc_id, text). A null text is an empty one;
    repeated rows stay; further columns are dropped; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in slices(batches):
            found = [scorer.features(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scorer.score(np.array(found)), pa.float64()), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "score", "features"])

    return map_batches(docs.select("doc_id", "text"), find, "doc_id long, score double, features array<double>")
