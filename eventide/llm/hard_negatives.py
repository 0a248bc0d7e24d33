"""Hard negatives by a multiway hyperplane tree: rows of other labels that score a little below an anchor's own positives.

Scores are integer inner products. One more component brings every row to the length M of the longest, so that the distance d of an anchor q and a
row x gives their score s exactly: d * d = q.q + M * M - 2 s. The best rows are the nearest, and a window of scores is an annulus around the anchor.

Each inner node has up to `fanout` split points, far from each other; a row goes to the nearest one, down to a leaf. For every split point and
every sibling subtree the node knows the least and the largest distance between the two, over all rows. An anchor's annulus, seen from a split point, is a
range of distances too, and a subtree whose range lies outside it is left out. The tree has at most `leaves` leaves, so it and its ranges are bounded
(fanout * leaves pairs of numbers for each level) and are broadcast; only its split points are chosen on a sample, the `sample` rows of least hash.

A leaf is searched exactly. Leaves of more than `block` rows are cut in chunks, and anchors are dealt in blocks of some `block`, so a task
holds one chunk and one block of anchors whatever the sizes of leaves and copies. Three rounds: an anchor's own chunk gives a
radius for its positives (one chunk of rows for one block of anchors); the annulus of that radius gives the exact positives; and for each positive the annulus of its window
gives the negatives. A task returns the first rows of each anchor and window, and their merge is a ranking whose limit works before the shuffle too.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part. Rows equal in id, label and vector are one
row. Rows that repeat an id with another label or vector are rows of their own, each an anchor if the id is one, but never positives or negatives of anchors with their id (all of these are ranked in their own right; a positive or negative id may then
occur more than once). Vectors meet only vectors of their dimension. Scores are exact while products of components stay below 2 ** 53 in sum. Ties go to the
smaller id. An empty table, or one without anchors, gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import bound_batches, dropped, written

SAMPLE, BLOCK, LEAF_ROWS, LEAVES, FANOUT, STRIP = 16_384, 16_384, 2048, 4096, 16, 256
POINT = "id long, h long, label long, v array<double>"


class Tree(NamedTuple):
    points: list[np.ndarray]  # of each inner node, its split points
    below: list[np.ndarray]  # of each split point, the inner node under it, or -1 - leaf
    leaves: int


def split_points(x: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Up to `most` different points far from each other, out of some three times as many at random."""
    some = np.unique(x[rng.permutation(len(x))[: 3 * most]], axis=0)
    taken, far = [0], np.full(len(some), np.inf)
    while len(taken) < most:
        far = np.minimum(far, distances(some, some[taken[-1:]])[:, 0])
        if far.max() <= 0:
            break
        taken.append(int(far.argmax()))
    return some[taken]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def grow(x: np.ndarray, leaves: int, fanout: int) -> Tree:
    """A tree of at most `leaves` leaves: the part with most of the sampled rows is split next."""
    rng = np.random.default_rng(1)
    points: list[np.ndarray] = []
    below: list[list[int]] = []
    open_: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]  # rows, node above, place in it
    closed: list[tuple[int, int]] = []
    while open_:
        open_.sort(key=lambda part: len(part[0]))
        rows, above, place = open_.pop()
        room = leaves - len(open_) - len(closed)
        p = split_points(x[rows], min(fanout, room), rng) if room > 1 and len(rows) >= 2 * fanout else x[:0]
        if len(p) < 2:
            closed.append((above, place))
            continue
        if above >= 0:
            below[above][place] = len(points)
        at = distances(x[rows], p).argmin(1)
        open_ += [(rows[at == k], len(points), k) for k in range(len(p))]
        points.append(p)
        below.append([0] * len(p))
    for leaf, (above, place) in enumerate(closed):
        if above >= 0:
            below[above][place] = -1 - leaf
    return Tree(points, [np.array(b) for b in below], len(closed))


def walk(x: np.ndarray, tree: Tree) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows that come to it, their distances to its split points, the nearest one), from the root down."""
    todo = [(0, np.arange(len(x)))] if tree.points and len(x) else []
    while todo:
        node, rows = todo.pop()
        d = distances(x[rows], tree.points[node])
        near = d.argmin(1)
        yield node, rows, d, near
        for k, under in enumerate(tree.below[node].tolist()):
            if under >= 0 and (near == k).any():
                todo.append((under, rows[near == k]))


def leaf_of(x: np.ndarray, tree: Tree) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    for node, rows, _, near in walk(x, tree):
        under = tree.below[node][near]
        out[rows[under < 0]] = -1 - under[under < 0]
    return out


def ranges_of(x: np.ndarray, tree: Tree) -> Iterator[tuple[int, int, int, float, float]]:
    """(node, split point, sibling subtree, least and largest distance) over the rows."""
    for node, _, d, near in walk(x, tree):
        for k in np.unique(near).tolist():
            part = d[near == k]
            for i, (a, b) in enumerate(zip(part.min(0).tolist(), part.max(0).tolist())):
                yield node, i, k, a, b


def reached(x: np.ndarray, inner: np.ndarray, outer: np.ndarray, tree: Tree, ranges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the leaves that may hold a point whose distance to the row lies in one of its annuli [inner, outer] (a column each; inner > outer: none)."""
    some = (inner <= outer).any(1)
    if not tree.points:
        rows = np.flatnonzero(some)
        return rows, np.zeros(len(rows), np.int32)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [(0, np.flatnonzero(some))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        d = distances(x[rows], tree.points[node])
        least, largest = ranges[node]  # split point x subtree; infinite and less than nothing where no row is
        slack = 1e-6 * (1 + d.max())
        hit = np.zeros((len(rows), len(tree.points[node])), bool)
        for w in range(inner.shape[1]):
            a, b = inner[rows, w][:, None], outer[rows, w][:, None]
            low = np.maximum(np.maximum(a - d, d - b), 0) - slack  # |d(p, x) - d(p, q)| is at most d(q, x), which is at most their sum
            high = d + b + slack
            hit |= ((least[None] <= high[:, :, None]) & (largest[None] >= low[:, :, None])).all(1) & (a <= b)
        for k, under in enumerate(tree.below[node].tolist()):
            on = rows[hit[:, k]]
            if under >= 0:
                todo.append((under, on))
            else:
                out.append((on, np.full(len(on), -1 - under, np.int32)))
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32))  # type: ignore[return-value]


def first(scores: np.ndarray, valid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's `most` highest valid scores; of equal ones the first columns."""
    s = np.where(valid, scores, -np.inf)
    if s.shape[1] > most:
        least = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most]
        more, tie = s > least, (s == least) & valid
        valid = more | (tie & (np.cumsum(tie, axis=1) <= most - more.sum(1, keepdims=True)))
    return np.nonzero(valid)


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with one more component, all as long as the longest."""
    return np.concatenate([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))[:, None]], axis=1)


def flat(x: np.ndarray) -> np.ndarray:
    """Anchors in the space of lifted(): the last component is nothing, so products are those of the vectors."""
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def radius(x: np.ndarray, score: np.ndarray, square: float) -> np.ndarray:
    """The distance that belongs to a score; the higher the score, the less (none at all: nothing is as far as minus infinity)."""
    return np.sqrt(np.maximum((x * x).sum(1).reshape(-1, *[1] * (score.ndim - 1)) + square - 2 * score, 0))


def hard_negatives(
    vectors: DataFrame, *, anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95),
    sample: int = SAMPLE, block: int = BLOCK, leaf_rows: int = LEAF_ROWS, leaves: int = LEAVES, fanout: int = FANOUT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: (vec_id, label, embedding of whole numbers). anchor: a condition on vec_id. An anchor's positives are its first rows of the same label;
    the negatives of one are the first rows of other labels whose score is between window[0] and window[1] hundredths of the positive's.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter((F.size("embedding") > 0) & finite)
    points = good.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    # the second hash tells rows that repeat an id apart; one row of each is kept
    points = written(points.withColumn("h", F.xxhash64("label", "v")).dropDuplicates(["id", "h"]).select("id", "h", "label", "v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    kinds = points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("square")).collect()
    out = None
    for kind in kinds:  # one for each dimension, of which a table has one as a rule
        own = points.filter(F.size("v") == kind["dim"])
        found = _Search(own, kind["n"], kind["square"], anchor, sample, block, leaf_rows, leaves, fanout).run(positives, negatives, window)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


class _Search:
    """The tree over the rows of one dimension, and the rounds over it."""

    def __init__(self, points: DataFrame, n: int, square: float, anchor: Column, sample: int, block: int, leaf_rows: int, leaves: int, fanout: int):
        spark = self.spark = points.sparkSession
        some = points.orderBy(F.xxhash64("h", "id"), "id").limit(sample).select("v").toPandas()["v"]
        tree = grow(lifted(np.stack(some.to_numpy()), square), int(min(leaves, max(1, n // leaf_rows))), fanout)
        self.square, self.tree = square, spark.sparkContext.broadcast(tuple(tree))
        shared = self.tree

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = Tree(*shared.value)
            for batch in batches:
                leaf = leaf_of(lifted(vectors_of(batch.column(3)), square), tree)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["id", "h", "label", "v", "leaf"])

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, held = Tree(*shared.value), {}
            for batch in batches:
                for node, i, k, a, b in ranges_of(lifted(vectors_of(batch.column(0)), square), tree):
                    c, d = held.get((node, i, k), (a, b))
                    held[node, i, k] = (min(a, c), max(b, d))
            rows = [(*key, *value) for key, value in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(),) * 3 + (pa.float64(),) * 2)], names=["node", "i", "k", "a", "b"])

        leafed = points.mapInArrow(place, f"{POINT}, leaf int")
        sizes = written(leafed.groupBy("leaf").agg(F.count("*").alias("size")))
        chunks = F.ceil(F.col("size") / block).cast("int")
        # at most `leaves` rows
        self.sizes = F.broadcast(sizes.select("leaf", chunks.alias("chunks")))
        self.points = written(leafed.join(self.sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id", "h"), "chunks").cast("int")).drop("chunks"))
        ranges = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in tree.points]
        # at most fanout * leaves pairs for each level
        for node, i, k, a, b in points.select("v").mapInArrow(spans, "node int, i int, k int, a double, b double").groupBy("node", "i", "k").agg(F.min("a"), F.max("b")).collect():
            ranges[node][0][i, k], ranges[node][1][i, k] = a, b
        self.ranges = spark.sparkContext.broadcast(ranges)
        anchors = self.points.withColumn("vec_id", F.col("id")).filter(anchor).drop("vec_id")
        parts = max(1, -(-anchors.count() // block))
        self.anchors = anchors.withColumn("part", F.pmod(F.xxhash64("id", "h", F.lit("part")), F.lit(parts)).cast("int"))

    def run(self, positives: int, negatives: int, window: tuple[int, int]) -> DataFrame:
        square, lo, hi = self.square, *window
        own = self.anchors.select("leaf", "chunk", "part", "id", "h", "label", "v")
        near = self._compare(own, lambda q, data, s: top(q, data, s, data.label[None] == q.label[:, None], positives, 0))
        # an anchor with fewer positives in its chunk has no radius yet, and may meet every leaf
        least = near.groupBy("id", "h").agg(F.when(F.count("*") >= positives, F.min("score")).cast("double").alias("least"))
        asked = written(self.anchors.join(least, ["id", "h"], "left").select("part", "id", "h", "label", "v", F.array(F.coalesce("least", F.lit(float("-inf")))).alias("low"), F.array(F.lit(float("inf"))).alias("high")))
        found = self._compare(self._deal(asked), lambda q, data, s: top(q, data, s, (data.label[None] == q.label[:, None]) & (s >= q.low[:, :1]), positives, 0))
        best = Window.partitionBy("id", "h").orderBy(F.desc("score"), "other", "oh")
        good = written(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).select("id", "h", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
        # 100 * score lies between lo and hi times the positive's score: whole numbers, so the bounds are rounded inwards
        p = F.col("positive_score")
        low, high = -F.expr(f"(-{lo} * positive_score) div 100"), F.expr(f"({hi} * positive_score) div 100")
        low = F.when(p * lo % 100 > 0, low + 1).otherwise(low)
        high = F.when(p * hi % 100 < 0, high - 1).otherwise(high)
        windows = good.withColumns({"low": low, "high": high}).groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
        asked = written(self.anchors.join(windows, ["id", "h"]).select("part", "id", "h", "label", "v", F.col("w.low").cast("array<double>").alias("low"), F.col("w.high").cast("array<double>").alias("high")))

        def windowed(q: _Rows, data: _Rows, s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            other = data.label[None] != q.label[:, None]
            for w in range(q.low.shape[1]):
                yield from top(q, data, s, other & (s >= q.low[:, w : w + 1]) & (s <= q.high[:, w : w + 1]), negatives, w + 1)

        found = self._compare(self._deal(asked), windowed)
        best = Window.partitionBy("id", "h", "place").orderBy(F.desc("score"), "other", "oh")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
        out = good.join(ranked, ["id", "h", "place"]).select(
            F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        return written(out)

    def _deal(self, asked: DataFrame) -> DataFrame:
        """A row of an anchor for each chunk of each leaf that its windows reach."""
        shared, ranges, square = self.tree, self.ranges, self.square

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, held = Tree(*shared.value), ranges.value
            for batch in batches:
                for at in range(0, batch.num_rows, STRIP):
                    part = batch.slice(at, STRIP)
                    x = vectors_of(part.column(4))
                    low, high = padded(part.column(5).to_pylist(), np.inf), padded(part.column(6).to_pylist(), -np.inf)
                    inner, outer = radius(x, np.where(low <= high, high, -np.inf), square), np.where(low <= high, radius(x, np.where(np.isinf(low), 0, low), square), -1)
                    outer = np.where(low == -np.inf, np.inf, outer)
                    row, leaf = reached(flat(x), inner, outer, tree, held)
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *taken.columns], names=["leaf", *taken.schema.names])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
        dealt = asked.mapInArrow(reach, f"leaf int, {fields}").join(self.sizes, "leaf")
        return dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def _compare(self, dealt: DataFrame, pick) -> DataFrame:
        """(id, h, place, other, oh, score): what pick() takes of each chunk for the anchors dealt to it."""
        keys = ["leaf", "chunk", "part"]
        dealt = written(dealt)
        here = dealt.select(*keys).distinct()
        own = ["_leaf", "_chunk", "_part"]  # new names: both sides come from one table
        data = self.points.join(here, ["leaf", "chunk"]).select(*(F.col(k).alias(o) for k, o in zip(keys, own)), "id", "h", "label", "v")

        def compare(_: Any, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(rows):
                rows = rows.sort_values(["id", "h"], kind="stable")
                data = _Rows(rows)
                for at in range(0, len(asked), STRIP):
                    q = _Rows(asked.iloc[at : at + STRIP])
                    s = q.v @ data.v.T
                    for i, j, place in pick(q, data, s):
                        out.append(pd.DataFrame({"id": q.id[i], "h": q.h[i], "place": np.int32(place), "other": data.id[j], "oh": data.h[j], "score": s[i, j].astype(np.int64)}))
            return pd.concat(out) if out else pd.DataFrame({"id": [], "h": [], "place": [], "other": [], "oh": [], "score": []})

        return dealt.groupBy(*keys).cogroup(data.groupBy(*own)).applyInPandas(compare, "id long, h long, place int, other long, oh long, score long")


class _Rows:
    def __init__(self, rows: pd.DataFrame):
        self.id, self.h, self.label = (rows[c].to_numpy(np.int64) for c in ("id", "h", "label"))
        self.v = np.stack(rows["v"].to_numpy()).astype(np.float64)
        if "low" in rows:
            self.low, self.high = padded(rows["low"], np.inf), padded(rows["high"], -np.inf)


def padded(lists, with_: float) -> np.ndarray:
    """Lists of different lengths as rows of one matrix."""
    out = np.full((len(lists), max(map(len, lists), default=0)), with_)
    for i, one in enumerate(lists):
        out[i, : len(one)] = one
    return out


def top(q: _Rows, data: _Rows, s: np.ndarray, valid: np.ndarray, most: int, place: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    i, j = first(s, valid & (data.id[None] != q.id[:, None]), most)
    if len(i):
        yield i, j, place


def vectors_of(col: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
