"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context windows.

The lexicon is learned from labelled rows: whole words, and word beginnings
that stand for their inflections.  Its trie, with up to one error for longer
whole words, is a nondeterministic automaton; its states are joined on demand
into a deterministic one whose steps are remembered, so most words leave it
after two or three letters.  Digits inside words are read as letters, and a
spelling that clean rows use is no misspelling.  A match weighs less in a window of quotation marks and
reporting words, and a logistic regression over the document's matches gives
the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import at_most, held_out

#: Labelled rows of each label that are learned from, at most; chosen by hash of the id.
LEARN_ROWS = 6000
#: A term needs so many toxic documents of the sample, and this share of its evidence on the toxic side.
SUPPORT = 8
PRECISION = 0.85
#: Terms of fewer letters must be spelled exactly.
FUZZY_FROM = 5
PREFIXES = range(4, 9)
#: Words on either side that count as a match's context.
CONTEXT = 6
QUOTED = 0.4
LETTERS = re.compile(r"[^\W\d_]+")
#: Letters, and the digits before, between and behind them.
WORD = re.compile(r"(?<!\d)\d*+[^\W\d_][^\W_]*+")
#: The letters that digits stand for.
DIGITS = str.maketrans("01345789", "oieastbg")
#: Marks and words that report another's speech.
QUOTE_MARKS = re.compile("[\"“”„«»]")
REPORTING = frozenset("said says quote quoted quotes called term word wrote writes sagte schrieb zitat dijo cita escribió dit écrit citation".split())
_KEEP_WORDS = 200_000


@dataclass
class Lexicon:
    """Terms with their weight; a term ending in ``*`` stands for all words that begin so."""

    terms: dict[str, float]
    _children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    _ends: list[list[tuple[str, bool, int]]] = field(default_factory=lambda: [[]])
    _states: dict[frozenset, int] = field(default_factory=dict)
    _content: list[frozenset] = field(default_factory=list)
    _steps: list[dict[str, int]] = field(default_factory=list)
    _accept: list[tuple[str, int] | None] = field(default_factory=list)
    _begin: list[str | None] = field(default_factory=list)

    def __post_init__(self) -> None:
        for term in sorted(self.terms):
            begins, word, at = term.endswith("*"), term.rstrip("*"), 0
            for c in word:
                if c not in self._children[at]:
                    self._children[at][c] = len(self._children)
                    self._children.append({})
                    self._ends.append([])
                at = self._children[at][c]
            self._ends[at].append((term, begins, 0 if begins or len(word) < FUZZY_FROM else 1))
        self._state({(0, 0)})

    def _state(self, positions: set[tuple[int, int]]) -> int:
        """The number of the deterministic state that holds these (trie node, errors) positions."""
        closed = positions | {(child, 1) for node, errors in positions if not errors for child in self._children[node].values()}
        key = frozenset(closed)
        if key not in self._states:
            self._states[key] = len(self._content)
            self._content.append(key)
            self._steps.append({})
            found = [(errors, -self.terms[t], t) for node, errors in key for t, _, most in self._ends[node] if errors <= most]
            self._accept.append((min(found)[2], min(found)[0]) if found else None)
            begins = [(-self.terms[t], t) for node, errors in key if not errors for t, begins, _ in self._ends[node] if begins]
            self._begin.append(min(begins)[1] if begins else None)
        return self._states[key]

    def _step(self, state: int, c: str) -> int:
        reached = set()
        for node, errors in self._content[state]:
            if c in self._children[node]:
                reached.add((self._children[node][c], errors))
            if not errors:
                reached.add((node, 1))
                reached.update((child, 1) for child in self._children[node].values())
        self._steps[state][c] = to = self._state(reached) if reached else -1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The best term for a small-lettered word and its number of errors."""
        state, begun = 0, None
        for c in word:
            to = self._steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return begun
            if self._begin[state]:
                begun = self._begin[state], 0
        hit = self._accept[state]
        return hit if hit and not (begun and hit[1]) else begun


def readings(word: str) -> list[str]:
    """A word; one with digits as the letters they stand for, and without them."""
    return [word] if LETTERS.fullmatch(word) else [word.translate(DIGITS), *LETTERS.findall(word)]


@dataclass
class Finder:
    """Matches of a lexicon in texts, with the words seen so far remembered up to a bound.

    ``spared`` are spellings that are no misspellings of a term; ``inexact``
    are the weights of misspelled terms where they differ.
    """

    lexicon: Lexicon
    spared: frozenset[str] = frozenset()
    inexact: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, int]] = {}

    def match(self, word: str) -> tuple[str, int] | None:
        """The best match of a word's readings."""
        found = [hit for r in readings(word) if (hit := self.lexicon.match(r)) and not (hit[1] and r in self.spared)]
        return min(found, key=lambda hit: (hit[1], -self.lexicon.terms[hit[0]], hit[0]), default=None)

    def matches(self, text: str) -> tuple[int, list[tuple[str, int, bool]]]:
        """Number of words, and term, errors and whether quoted of each match."""
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        for w in distinct - self.clean:
            if w not in self.hits:
                hit = self.match(w)
                if hit:
                    self.hits[w] = hit
                else:
                    self.clean.add(w)
        found = []
        if not distinct.isdisjoint(self.hits):
            spots = list(WORD.finditer(low))
            for i, w in enumerate(words):
                if w in self.hits:
                    near = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
                    before = low[spots[max(0, i - CONTEXT)].start() : spots[i].start()]
                    behind = low[spots[i].end() : spots[min(len(words) - 1, i + CONTEXT)].end()]
                    quoted = bool(QUOTE_MARKS.search(before) and QUOTE_MARKS.search(behind)) or not REPORTING.isdisjoint(near)
                    found.append((*self.hits[w], quoted))
        if len(self.clean) + len(self.hits) > _KEEP_WORDS:
            self.clean.clear()
            self.hits.clear()
        return len(words), found

    def features(self, text: str | None) -> list[float]:
        return self._numbers(*self.matches(text or ""))

    def both(self, text: str | None) -> list[list[float]]:
        """The features of a text and, if it has terms that may be misspelled, of its copy in which they all are."""
        n, found = self.matches(text or "")
        near = [(t, 1, q) for t, e, q in found if e or not t.endswith("*") and len(t) >= FUZZY_FROM]
        return [self._numbers(n, found)] + ([self._numbers(n, near)] if any(not e for _, e, _ in found) and near else [])

    def _numbers(self, n: int, found: list[tuple[str, int, bool]]) -> list[float]:
        exact = [self.lexicon.terms[t] * (QUOTED if q else 1.0) for t, e, q in found if not e]
        near = [self.inexact.get(t, self.lexicon.terms[t]) * (QUOTED if q else 1.0) for t, e, q in found if e]
        return [
            max(exact, default=0.0),
            min(sum(exact), 40.0) / 10,
            min(100.0 * sum(exact) / (n + 20), 40.0) / 10,
            max(near, default=0.0),
            min(100.0 * sum(near) / (n + 20), 40.0) / 10,
            np.log1p(n) / 5,
        ]


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray
    bias: float
    spared: frozenset[str] = frozenset()
    inexact: dict[str, float] = field(default_factory=dict)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(features @ self.weights + self.bias)))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            words = {r for w in set(WORD.findall((text.as_py() or "").lower())) for r in readings(w)}
            counts[toxic].update({w for w in words if len(w) > 2})
            counts[toxic].update({w[:k] + "*" for w in words for k in PREFIXES if len(w) > k})
    for toxic, c in counts.items():
        terms = list(c)
        for a in range(0, len(terms), 50_000):
            part = terms[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, type=pa.string()), pa.array([toxic] * len(part), type=pa.int32()), pa.array([c[t] for t in part], type=pa.int64())], names=["term", "toxic", "n"])


def _spellings(lexicon):
    """The distinct words of each row that a term meets with an error, and the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(lexicon)
        for batch in batches:
            found = []
            for text, toxic, later in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = {r for w in set(WORD.findall((text.as_py() or "").lower())) for r in readings(w)}
                found += [(w, hit[0], toxic, later) for w in own if (hit := automaton.match(w)) and hit[1]]
            columns = zip(*found) if found else [()] * 4
            kinds = pa.string(), pa.string(), pa.int32(), pa.bool_()
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["word", "term", "toxic", "later"])

    return run


def _features(lexicon, spared, inexact):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(Lexicon(lexicon), spared, inexact)
        for batch in batches:
            rows = [finder.both(t.as_py()) for t in batch.column(0)]
            toxic = [label for label, own in zip(batch.column(1).to_pylist(), rows) for _ in own]
            yield pa.RecordBatch.from_arrays([pa.array(toxic, type=pa.int32()), pa.array([x for own in rows for x in own], type=pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; the two labels weigh as they occur."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_rows: int = LEARN_ROWS) -> Model:
    """Learns terms and weights from labelled rows that are not held out.

    Labels are sampled before they meet the texts: at most about ``learn_rows``
    of each label, so that side of the join is broadcast within a known bound.
    Terms come from two thirds of the sample, the weights from the rest.  All
    terms with the support are taken, so their number is bounded by the sample
    alone: each stands in ``SUPPORT`` toxic documents of it.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and id is not null").filter(~held_out("id"))
    sample, counts = at_most(known.groupBy("id").agg(F.max("toxic").alias("toxic")), "id", learn_rows, "toxic")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("text", "toxic", (F.pmod(F.xxhash64("id", F.lit("half")), F.lit(3)) == 0).alias("later"))
    if not counts.get(1):
        return Model({}, np.zeros(6), -2.0)
    sums = rows.filter("not later").select("text", "toxic").mapInArrow(_term_counts, "term string, toxic int, n long")
    sums = sums.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    size = {t: max(1, min(n, learn_rows)) for t, n in counts.items()}
    share = size[1] / size.get(0, 1)
    able = sums.filter(F.col("pos") >= SUPPORT).withColumn("precision", F.col("pos") / (F.col("pos") + F.col("neg") * share + 0.5)).filter(F.col("precision") >= PRECISION)
    best = able.orderBy(F.desc("pos"), "term").collect()
    lexicon = {r["term"]: float(np.log((r["pos"] + 0.5) / (size[1] + 1)) - np.log((r["neg"] + 0.5) / (size.get(0, 1) + 1))) for r in best}
    seen = {r["term"]: (r["pos"], r["neg"]) for r in best}
    lexicon = _prune(lexicon, seen)
    near = rows.select("text", "toxic", "later").mapInArrow(_spellings(lexicon), "word string, term string, toxic int, later boolean")
    # words of the bounded sample that lie beside a term
    beside = near.groupBy("word", "term", "later").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).filter("neg > 0").collect()
    times = Counter()
    for r in beside:
        times[r["term"], r["word"]] += r["neg"]
    # words seen once tell how often words not seen yet lie beside a term, which then says less when it is misspelled
    clean = Counter(term for (term, _), n in times.items() if n == 1)
    inexact = {t: max(0.0, min(lexicon[t], lexicon[t] + float(np.log(seen[t][1] + 0.5) - np.log(n + 0.5)))) for t, n in clean.items()}
    # the weights see neighbours in clean rows that were not asked which words to spare
    early = _spared([r for r in beside if not r["later"]], share)
    got = rows.filter("later").select("text", "toxic").mapInArrow(_features(lexicon, early, inexact), "toxic int, x array<double>").toPandas()
    spared = early | _spared(beside, share)
    if not len(got) or got["toxic"].nunique() < 2:
        return Model(lexicon, np.array([0.8, 0, 0, 0.2, 0, 0]), -2.0, spared, inexact)
    w, bias = regression(np.array(got["x"].tolist()), got["toxic"].to_numpy(dtype=float))
    return Model(lexicon, w, bias, spared, inexact)


def _spared(rows: list, share: float) -> frozenset[str]:
    """Spellings beside a term that clean rows have too often to be misspellings."""
    pos, neg = Counter(), Counter()
    for r in rows:
        pos[r["word"]] += r["pos"]
        neg[r["word"]] += r["neg"]
    return frozenset(w for w in neg if pos[w] / (pos[w] + neg[w] * share) < PRECISION)


def _prune(lexicon: dict[str, float], counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Leaves out beginnings that stand for no more than one word or a longer beginning, and what a shorter one already says.

    Whole words that may have an error all stay: a beginning has none.
    """
    kept: dict[str, float] = {}
    more = {(word[:k], n) for term, n in counts.items() for word in [term.rstrip("*")] for k in PREFIXES if k <= len(word) - term.endswith("*")}
    for term in sorted(lexicon, key=lambda t: (len(t.rstrip("*")), t)):
        begins, word = term.endswith("*"), term.rstrip("*")
        if begins and (word, counts[term]) in more:
            continue
        shorter = [kept[word[:k] + "*"] for k in PREFIXES if k <= len(word) - begins and word[:k] + "*" in kept]
        if not begins and len(word) >= FUZZY_FROM or not shorter or max(shorter) < lexicon[term] - 0.7:
            kept[term] = lexicon[term]
    return kept


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        finder = Finder(Lexicon(m.lexicon), m.spared, m.inexact)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([finder.features(t.as_py()) for t in batch.column(2)])
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return score


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Null and empty texts are scored as texts without a match.  Repeated rows
    are answered one by one; without toxic labels nothing reaches 0.5.  An
    empty table gives an empty one; further columns are left, whatever their
    names.  A text of any length is read whole; its words are held once as a
    list.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of the sample, and its spellings beside them
    return narrow.mapInArrow(_scorer(shared), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
