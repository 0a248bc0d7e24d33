"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models spell words byte by byte from the bytes before: one learned from
documents labelled toxic, one from the others. The lower orders come from continuation counts
that both share, so an expression that neither class knows costs the same in both, and what a rare one
costs rests on its known beginnings. A document counts once for each of its words, and the discount is
above the usual 0.5 to 1, so what a handful of documents say is left to the shared counts: with
few labels that raises held-out F1 by a fifth. The log-likelihoods of an expression (a word with
its end) are divided by the square root of its length, as the noise of such a sum grows; a document
takes the difference of its most toxic expression, so that a long text doesn't dilute it (by the mean over the whole text the best held-out F1
on the tables here is 0.62 to 0.64, by the best expression 0.88 to 1.0). A logistic
curve maps the difference to a score. Its threshold, where the score is 0.3, has the best F1 over one
half of the training rows with the models of the other half; it lies above 0, where a text without evidence is. If that half holds
fewer than `FEWEST` toxic rows, or no such threshold is better than calling every row toxic, the labels can't place it:
then it lies above every training row, and the scores still rank the texts but call none toxic.

Counts come from all training rows; n-gram tables, continuation counts and both models are computed as
DataFrames. An n-gram that no class has in more documents than the discount takes costs what its context says,
so leaving it out of the model changes no score; all others are kept, and their number grows with the training
rows (20 bytes each in the broadcast). At most `max_rows` labelled rows are used, by hash of the id, which
bounds both broadcasts.

Defined cases: null and empty texts have difference 0 and hence the score that the curve has there, which is below 0.3. A very long text is read whole and
takes its most toxic expression. A score of exactly 0.3 is toxic; ties for the best threshold take the middle of their stretch.
With no labelled rows, one class only, or no n-gram that any class repeats enough, every score is 0. Null labels don't count; a doc_id labelled
more than once is toxic if one of its labels says so. Rows that repeat a doc_id are each scored.
Extra columns pass through nontoxic() and aren't read by toxicity().
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import as_array, bound_batches, held_out, text_slices, written
from eventide.llm.text import Words, owners, words

ORDER = 5  # bytes of an n-gram, which is exact in 40 bits
END = 1  # the byte after a word
MAX_ROWS = 1_000_000
DISCOUNT = 3.0
CUT, STEEP = 0.3, 3.0
BINS, LOW, WIDTH = 1600, -4.0, 0.01
FEWEST = 5  # toxic rows that place the threshold


def spelled(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct words: which each word is; per byte its word and its n-gram; lengths."""
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[first], w.end[first] - w.start[first] + 1
    own = np.repeat(np.arange(len(first)), size)
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    last = pos == size[own] - 1
    data = np.append(w.data, np.uint8(0))
    byte = np.where(last, np.uint64(END), data[np.minimum(start[own] + pos, len(w.data))].astype(np.uint64))
    gram = byte.copy()
    for j in range(1, ORDER):
        at = np.flatnonzero(pos >= j)
        gram[at] |= byte[at - j] << np.uint64(8 * j)
    return inverse, own, gram, size


class Model(NamedTuple):
    """Differences of log-likelihoods, by n-gram and, for n-grams of neither class, by context."""

    gram: np.ndarray
    gram_diff: np.ndarray
    context: np.ndarray
    context_diff: np.ndarray
    middle: float  # the difference at which the score is CUT

    def peaks(self, col: pa.Array) -> np.ndarray:
        """For each text the largest length-normalised difference of its expressions; 0 without any."""
        w = words(col)
        out = np.zeros(len(w.row) - 1)
        if not len(w.hash) or not len(self.gram):
            return out
        inverse, own, gram, size = spelled(w)
        i = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        before = gram >> np.uint64(8)
        j = np.minimum(np.searchsorted(self.context, before), len(self.context) - 1)
        diff = np.where(self.gram[i] == gram, self.gram_diff[i], np.where(self.context[j] == before, self.context_diff[j], 0))
        word = (np.bincount(own, weights=diff, minlength=len(size)) / np.sqrt(size))[inverse]
        has = np.flatnonzero(np.diff(w.row))
        out[has] = np.maximum.reduceat(word, w.row[has])
        return out

    def scores(self, col: pa.Array) -> np.ndarray:
        if not len(self.gram):
            return np.zeros(len(col))
        return 1 / (1 + np.exp(-(STEEP * (self.peaks(col) - self.middle) + np.log(CUT / (1 - CUT)))))


def _low(gram: str, size: int) -> Column:
    """The last `size` bytes of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * size) - 1))


def _context(gram: str) -> Column:
    return F.shiftrightunsigned(gram, 8)


def backoff(grams: DataFrame) -> DataFrame:
    """(suffix, below): the probability of a suffix's last byte after its other bytes, from the continuation counts of all n-grams."""
    levels, above = {}, grams.select(F.col("gram").alias("key"))
    for size in range(ORDER - 1, 0, -1):
        above = levels[size] = above.groupBy(_low("key", size).alias("key")).agg(F.count("*").alias("n"))
    seen = None
    for size, level in levels.items():
        own = level.agg(F.lit(size).alias("size"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"))
        seen = own if seen is None else seen.unionByName(own)
    discounts = {r["size"]: r["one"] / (r["one"] + 2 * r["two"]) if r["one"] else 0.5 for r in seen.collect()}
    shorter = None
    for size in range(1, ORDER):
        by, d = Window.partitionBy(_context("key")), F.lit(discounts[size])
        level = levels[size].select("key", "n", F.sum("n").over(by).alias("total"), F.count("*").over(by).alias("kinds"), _low("key", size - 1).alias("rest"))
        level = level.withColumn("less", F.lit(1 / 256)) if shorter is None else level.join(shorter.select(F.col("key").alias("rest"), F.col("p").alias("less")), "rest")
        shorter = level.select("key", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + d * F.col("kinds") / F.col("total") * F.col("less")).alias("p"))
    return shorter.select(F.col("key").alias("suffix"), F.col("p").alias("below"))


def kneser_ney(grams: DataFrame) -> tuple[Model, Model]:
    """The models of the first half of the training rows and of both."""
    both = grams.select("gram", "toxic0", "ordinary0", (F.col("toxic0") + F.col("toxic1")).alias("toxic"), (F.col("ordinary0") + F.col("ordinary1")).alias("ordinary"), _low("gram", ORDER - 1).alias("suffix"))
    counts = ["toxic0", "ordinary0", "toxic", "ordinary"]
    any_ = both.agg(*(F.max(c).alias(c) for c in counts)).first()
    by, off = Window.partitionBy(_context("gram")), lambda c: F.least(F.col(c), F.lit(DISCOUNT))
    t = both.join(backoff(grams), "suffix").withColumns({f"{c}_total": F.sum(c).over(by) for c in counts} | {f"{c}_off": F.sum(off(c)).over(by) for c in counts})
    t = t.filter((F.col("toxic") > DISCOUNT) | (F.col("ordinary") > DISCOUNT))
    rest = {c: F.when(F.col(f"{c}_total") > 0, F.col(f"{c}_off") / F.greatest(F.col(f"{c}_total"), F.lit(1))).otherwise(1.0) for c in counts}
    logs = {c: F.log((F.col(c) - off(c)) / F.greatest(F.col(f"{c}_total"), F.lit(1)) + rest[c] * F.col("below")) for c in counts}
    pairs = {"half": ("toxic0", "ordinary0"), "whole": ("toxic", "ordinary")}
    diffs = [(f(a) - f(b)).cast("float").alias(f"{name}_{what}") for name, (a, b) in pairs.items() for what, f in (("gram", logs.get), ("context", lambda c: F.log(rest[c])))]
    rows = t.select("gram", *diffs).toPandas().sort_values("gram", ignore_index=True)
    gram = rows["gram"].to_numpy().astype(np.uint64)
    context, first = np.unique(gram >> np.uint64(8), return_index=True)
    models = [Model(gram, rows[f"{n}_gram"].to_numpy(), context, rows[f"{n}_context"].to_numpy()[first], 0.0) if any_[a] and any_[b] else NOTHING for n, (a, b) in pairs.items()]
    return models[0], models[1]


NOTHING = Model(*(np.array([], k) for k in (np.uint64, np.float32, np.uint64, np.float32)), 0.0)


def _grams(train: DataFrame) -> DataFrame:
    """(gram, toxic0, ordinary0, toxic1, ordinary1): documents that have it, by half and class."""
    names = ["toxic0", "ordinary0", "toxic1", "ordinary1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(batch.column(0)):
                part = batch.slice(at, n)
                w = words(part.column(0))
                if not len(w.hash):
                    continue
                inverse, own, gram, size = spelled(w)
                once = np.unique(owners(w.row) * len(size) + inverse)
                kind = (2 * part.column(2).to_numpy() + (part.column(1).to_numpy() != 1))[once // len(size)]
                key, which = np.unique(gram, return_inverse=True)
                cols = [np.bincount(which, weights=np.bincount(once[kind == k] % len(size), minlength=len(size))[own], minlength=len(key)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols)], names=["gram", *names])

    counts = train.select("text", "toxic", "half").mapInArrow(run, "gram long, " + ", ".join(f"{c} long" for c in names))
    return counts.groupBy("gram").agg(*(F.sum(c).alias(c) for c in names))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS) -> Model:
    """Learn from the labelled rows that aren't held out."""
    bound_batches(docs.sparkSession)
    own = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    if n > max_rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    own = own.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    train = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(own), "doc_id")
    grams = written(_grams(train))
    half, model = kneser_ney(grams)
    if not len(model.gram):
        return model
    middle = _middle(*_peaks(train.filter("half = 1"), half))
    if middle is None:
        occupied = np.flatnonzero(_peaks(train, model)[1])
        middle = LOW + WIDTH * (occupied.max() + 1) + 1.0
    return model._replace(middle=float(middle))


def _peaks(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """How many toxic rows, and how many rows, have their largest difference in each bin."""
    shared = Shared(train.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(batch.column(0)):
                part = batch.slice(at, n)
                peak = np.clip((shared.value.peaks(part.column(0)) - LOW) / WIDTH + 1e-9, 0, BINS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(peak), part.column(1)], names=["bin", "toxic"])

    counts = train.select("text", "toxic").mapInArrow(run, "bin int, toxic int").groupBy("bin").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).toPandas()
    bad, n = np.zeros(BINS), np.zeros(BINS)
    bad[counts["bin"]], n[counts["bin"]] = counts["bad"], counts["n"]
    return bad, n


def _middle(bad: np.ndarray, n: np.ndarray) -> float | None:
    """The difference above 0 that parts the classes with the best F1, in the middle of its stretch; None if none parts them."""
    caught, said = bad[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
    f1 = 2 * caught / np.maximum(said + bad.sum(), 1)
    above = round(-LOW / WIDTH) + 1
    if bad.sum() < FEWEST or f1[above:].max() <= f1[0]:
        return None
    best = above + np.flatnonzero(f1[above:] >= f1[above:].max() - 1e-12)
    return float(LOW + WIDTH * (best[0] + best[-1]) / 2)


class Shared:
    """A broadcast model."""

    def __init__(self, spark, model: Model):
        self.sent = spark.sparkContext.broadcast(tuple(model))

    @property
    def value(self) -> Model:
        return Model(*self.sent.value)


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per document."""
    bound_batches(docs.sparkSession)
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(batch.column(2)):
                part = batch.slice(at, n)
                score = shared.value.scores(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def nontoxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that the model doesn't call toxic."""
    bound_batches(docs.sparkSession)
    shared, where = Shared(docs.sparkSession, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(as_array(batch.column(where))):
                part = batch.slice(at, n)
                yield part.filter(pa.array(shared.value.scores(part.column(where)) < CUT))

    return docs.mapInArrow(run, docs.schema)
