"""Language identification by error-correcting output codes.

Every language has a codeword.  One binary naive Bayes classifier over hashed
byte bigrams and trigrams predicts each bit.  Decoding adds the logistic loss
of every bit, weighted by how reliable the bit was when learning, and takes
the language with the least; a second language close behind flags ambiguity.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buffers as B
from .split import held_out
from .store import Scratch

#: Rows of each language that are learned from, at most; chosen by hash of the id.
LEARN_ROWS = 3000
#: Hash buckets of n-grams.
BUCKETS = 1 << 15
#: A text is ambiguous if the two best languages' scores differ by less, or if the bits in which their codewords
#: differ hold less than this part of the evidence that a text of one language gives.
MARGIN = 0.25
UNKNOWN = "und"
#: Labelled rows that are learned from in all, at most; every language of these rows is learned, however many there are.
LEARN_TOTAL = 400_000
#: Languages up to which draws of a code are compared, and that a task counts at once.
COMPARED, HELD = 1024, 128
_STRETCH = 1 << 18
_GRAIN = 1 << 30

# small ASCII letters and all bytes of longer letters stay; the rest is a gap
_FOLD = B.LOWER.copy()
_FOLD[[i for i in range(128) if not 97 <= _FOLD[i] <= 122]] = 32


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of bigrams and trigrams ending at each byte, and which of them lie in one row and are no gap."""
    x = _FOLD[buf].astype(np.uint32)
    p1, p2 = np.zeros_like(x), np.zeros_like(x)
    p1[1:], p2[2:] = x[:-1], x[:-2]
    two = ((x * 0x9E3779B1 + p1 * 0x85EBCA77) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    three = ((x * 0x9E3779B1 + p1 * 0x85EBCA77 + p2 * 0xC2B2AE3D + np.uint32(12345)) * np.uint32(0x297A2D39)) >> np.uint32(17)
    good = ~((x == 32) & (p1 == 32))
    for starts in (offs[:-1], offs[:-1] + 1):
        good[starts[(starts >= 0) & (starts < len(buf))]] = False
    return two.astype(np.int64), three.astype(np.int64), good


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # bits
    apart: np.ndarray  # bits: the least evidence per n-gram that a learned language gives

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x bits, and the rows' numbers of n-grams; bytes are summed a stretch at a time, so a long text takes little more than a short one."""
        rows = np.zeros((len(offs) - 1, self.weights.shape[1]))
        n = np.zeros(len(offs) - 1)
        for a in range(0, len(buf), _STRETCH):
            b = min(a + _STRETCH, len(buf))
            back = min(a, 2)  # the two bytes before belong to the first n-grams
            two, three, good = (x[back:] for x in _grams(buf[a - back : b], offs - a + back))
            lo, hi = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, b, "left"))
            at = np.clip(offs[lo : hi + 1], a, b) - a
            sums = np.zeros((b - a + 1, rows.shape[1]))
            np.cumsum((self.weights[two] + self.weights[three]) * good[:, None], axis=0, out=sums[1:])
            count = np.concatenate(([0], np.cumsum(good)))
            rows[lo:hi] += sums[at[1:]] - sums[at[:-1]]
            n[lo:hi] += count[at[1:]] - count[at[:-1]]
        return rows / np.sqrt(1.0 + n)[:, None], n

    def decode(self, margins: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score, and its lead over the second: the lesser of scores and evidence."""
        # log(1 + exp(-m)) and log(1 + exp(m)) differ by m, so the sum of a codeword's losses falls by half of what its bits agree
        step = max(1, (1 << 21) // max(1, len(self.code)))
        gain = np.concatenate([0.5 * (margins[a : a + step] * self.trust) @ self.code.T for a in range(0, max(1, len(margins)), step)])
        best = gain.argmax(axis=1)
        odds = np.exp(gain - gain.max(axis=1, keepdims=True))
        share = odds / odds.sum(axis=1, keepdims=True)
        rows = np.arange(len(best))
        score = share[rows, best]
        if share.shape[1] < 2:
            return best, score, score
        others = share.copy()
        others[rows, best] = -1.0
        second = others.argmax(axis=1)
        differ = self.code[best] != self.code[second]
        evidence = (margins * self.code[best] * differ).sum(axis=1) / np.sqrt(1.0 + grams)
        usual = (self.apart * differ).sum(axis=1)
        return best, score, np.minimum(score - share[rows, second], evidence / np.maximum(usual, 1e-9))


def codewords(n: int) -> np.ndarray:
    """The exhaustive code up to 6 languages; beyond, the best spread of 64 fixed dense draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=float).T
    bits = int(np.ceil(10 * np.log2(n)))
    best, spread = None, -1
    for draw in range(64 if n <= COMPARED else 1):
        code = np.where(B.stream(1000 + draw, n * bits).reshape(n, bits) >> np.uint64(63), 1.0, -1.0)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if n > COMPARED:
            return code
        agree = code @ code.T
        np.fill_diagonal(agree, -np.inf)
        apart = int(code.shape[1] - agree.max()) // 2
        if apart > spread:
            best, spread = code, apart
    return best


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams by language and bucket; of more languages than are held at once, those so far are told first."""
    totals: dict[str, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        at = [np.flatnonzero(t) for t in totals.values()]
        lang = pa.array(np.repeat(np.array(list(totals), dtype=object), [len(x) for x in at]), type=pa.string())
        n = [t[x] for t, x in zip(totals.values(), at)]
        totals.clear()
        return pa.RecordBatch.from_arrays([lang, pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(n))], names=["lang", "bucket", "n"])

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for a, b, buf, offs in B.pieces(batch.column(0)):
            two, three, good = _grams(buf, offs)
            for i in range(b - a):
                if langs[a + i] not in totals and len(totals) == HELD:
                    yield told()
                own = slice(offs[i], offs[i + 1])
                ok = good[own]
                mine = totals.setdefault(langs[a + i], np.zeros(BUCKETS, dtype=np.int64))
                mine += np.bincount(two[own][ok], minlength=BUCKETS) + np.bincount(three[own][ok], minlength=BUCKETS)
    if totals:
        yield told()


def _sides(shared):
    """For rows of n-gram counts, each bucket in one task: the languages' shares on either side of each bit."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, code, weight = shared.value
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            lang = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            bucket, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for j in np.unique(bucket).tolist():
                at = bucket == j
                agreed = (n[at] * weight[lang[at]]) @ code[lang[at]]  # yes less no
                every = float((n[at] * weight[lang[at]]).sum())
                before = own.get(j)
                own[j] = np.append(agreed, every) + (0 if before is None else before)
        if own:
            values = np.stack(list(own.values()))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(own), dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))], names=["bucket", "sides"])

    return sides


def _evidence(shared):
    """For rows of n-gram counts, each language in one task: the least evidence of a language for each bit."""

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, _, weight, w = shared.value
        base, least, own = w.sum(axis=0), None, {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            bucket, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for x in dict.fromkeys(langs.tolist()):
                at = langs == x
                own[x] = own.get(x, 0.0) + n[at] @ w[bucket[at]]
            for x in list(own)[:-1]:  # rows come by language, so only the last may go on
                found = np.abs(weight[number[x]] * (own.pop(x) + 0.5 * base))
                least = found if least is None else np.minimum(least, found)
        for x, v in own.items():
            found = np.abs(weight[number[x]] * (v + 0.5 * base))
            least = found if least is None else np.minimum(least, found)
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least.tolist()], pa.list_(pa.float64()))], names=["least"])

    return evidence


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_rows: int = LEARN_ROWS, learn_total: int = LEARN_TOTAL) -> Model:
    """Learns from ``text`` and non-null ``lang`` of rows that are not held out.

    About ``learn_rows`` rows of each language at most, and ``learn_total`` in
    all, are learned from, chosen by a hash of the id; languages of fewer rows
    give all of them.  N-gram counts, the bits' weights and their reliability
    are summed on the executors; the driver gets the languages, a codeword for
    each, and a row of numbers for each bucket.
    """
    spark, disk = docs.sparkSession, Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out("id")).filter("lang is not null and text is not null and id is not null")
    labelled = disk.keep(rows.select("id", "lang"))
    sizes = disk.keep(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    share = min(1.0, learn_total / (sizes.agg(F.sum(F.least("rows", F.lit(learn_rows)))).first()[0] or 1))
    bound = (F.lit(float(_GRAIN)) * F.least(F.lit(1.0), F.lit(float(learn_rows)) / F.col("rows")) * share).cast("long")
    chosen = labelled.join(sizes, "lang").filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(_GRAIN)) < bound).select("id", "lang").distinct()
    sample = rows.join(F.broadcast(disk.keep(chosen)), ["id", "lang"], "left_semi")  # about learn_total ids at most
    sums = disk.keep(sample.select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    known = sorted(sums.groupBy("lang").agg(F.sum("n").alias("n")).join(sizes, "lang").collect(), key=lambda r: (-r["rows"], r["lang"]))
    languages = [r["lang"] for r in known]
    code = codewords(len(languages))
    if not languages:
        return Model([], code, np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones(1))
    weight = 1 / (np.array([r["n"] for r in known], dtype=float) + 0.5 * BUCKETS)  # of one n-gram in its language's share
    number = {x: i for i, x in enumerate(languages)}
    shared = spark.sparkContext.broadcast((number, code, weight))
    found = sums.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(_sides(shared), "bucket int, sides array<double>").collect()
    agreed, every = np.zeros((BUCKETS, code.shape[1])), np.zeros((BUCKETS, 1))
    for r in found:
        agreed[r["bucket"]], every[r["bucket"]] = r["sides"][:-1], r["sides"][-1]
    agreed += 0.5 * weight @ code
    every += 0.5 * weight.sum()
    yes, no = (code > 0).sum(axis=0), (code < 0).sum(axis=0)
    split = (yes > 0) & (no > 0)
    w = np.zeros_like(agreed)
    w[:, split] = np.log((every + agreed)[:, split] / (2 * yes[split])) - np.log((every - agreed)[:, split] / (2 * no[split]))
    told = spark.sparkContext.broadcast((number, code, weight, w))
    least = sums.repartition("lang").sortWithinPartitions("lang", "bucket").mapInArrow(_evidence(told), "least array<double>").collect()
    # how far the two sides' own n-grams lie apart, as a reliability
    apart = np.where(split, np.min([r["least"] for r in least], axis=0), 1.0)
    shared.unpersist()
    told.unpersist()
    trust = 0.05 + apart
    # an n-gram is a bigram and a trigram, so its evidence is twice a bucket's mean
    return Model(languages, code, w.astype(np.float32), trust / trust.mean(), 2 * apart)


def _identifier(model, text: int, wanted: bool):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            column = batch.column(text)
            letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for a, b, buf, offs in B.pieces(column, 1 << 19):
                ok = letter[a:b]
                if m.languages:
                    best, score, lead = m.decode(*m.margins(buf, offs))
                    names = np.array(m.languages, dtype=object)[best]
                else:
                    ok, names, score, lead = np.zeros(b - a, bool), np.empty(b - a, object), np.zeros(b - a), np.zeros(b - a)
                names = np.where(ok, names, UNKNOWN)
                if wanted:
                    if len(m.languages) > 1:  # two languages that a text may as well be in are none
                        ok = ok & (lead >= MARGIN)
                    yield batch.slice(a, b - a).filter(pa.array(ok))
                    continue
                new = [pa.array(names, type=pa.string()), pa.array(np.where(ok, score, 0.0)), pa.array(~ok | (lead < MARGIN))]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:text]), *new], names=[*batch.schema.names[:text], "lang_pred", "score", "ambiguous"])

    return identify


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row.

    Null texts and texts without a letter are ``und`` with score 0.  Ties go
    to the language with more rows.  Rows that repeat are answered one by
    one; if nothing could be learned, everything is ``und``.  An empty table
    gives an empty one; further columns are left, whatever their names.  Texts
    of any length are read whole, a stretch at a time.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x bits numbers
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return narrow.mapInArrow(_identifier(shared, 2, False), schema)


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language, with all their columns.

    Null and empty texts, those without a letter and those whose prediction is
    ambiguous have none; of one known language no text is ambiguous.  Repeated rows
    stay or go together, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_identifier(shared, docs.columns.index(text_col), True), docs.schema)
