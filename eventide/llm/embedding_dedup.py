"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length one; equal ones with one label are one from the start. The coarse quantiser
is a product itself: each half of a vector has `side` centroids, and their pairs are the inverted lists, so the number of
lists grows with the largest label (some `per_list` vectors each) while what is fitted grows with its root. The residual is coded
in subspaces. A vector probes the lists nearest to it, 4 * lists ** 0.3 of them: on vectors of 64
independent components, the hardest case, pairs right at the least cosine are found with recall 0.999 at 5,000
vectors a label, 0.998 at 50,000 and 0.997 at 400,000, as either of the two may find the other; with up to some 30 lists all are
probed and every pair is found. In a list, table lookups give the asymmetric distance between a
vector and a coded one; a pair goes on if that distance is within the radius of the least cosine plus the coded one's
own error, which no true pair exceeds, and then its exact cosine decides.

Lists with one centroid of the first half are a group, so a vector travels once for each first centroid that it probes. Groups of
more than `block` rows are compared in chunks, each pair of chunks in a task of its own. A
task returns the number of links of each vector and, instead of the links, one link to the smallest
vector that it reaches in the task, so what leaves a task grows with its vectors and not their pairs.

The quantisers are fitted on a bounded sample of distinct vectors, those with the smallest hashes: `sample`, or 16 for each centroid of a half.

Defined cases: null labels, null ids and vectors that are null, empty, zero or hold null or non-finite
components link with nothing; so do vectors of different dimension. Rows that repeat an id with the
same vector are one vector in n_links. Rows that repeat an id with other vectors have their own n_links each and are one vertex in
component_id. Ties at the least cosine are links. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import bound_batches, spread_join, written
from eventide.llm.components import connected_components, local_roots

SAMPLE, BLOCK, PER_LIST, MOST_SIDE, PARTS, CODES = 8192, 16_384, 64, 1024, 16, 256
QUERIES = 2048  # vectors whose tables are held at once


class Quantiser(NamedTuple):
    halves: list[np.ndarray]  # of each half, side x its dimensions
    books: list[np.ndarray]  # for each subspace, codes x its dimensions

    @property
    def side(self) -> int:
        return len(self.halves[0])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def centroid(self, lists: np.ndarray) -> np.ndarray:
        return np.concatenate([self.halves[0][lists // self.side], self.halves[1][lists % self.side]], axis=1)

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` nearest lists of each vector, nearest first."""
        cut = self.halves[0].shape[1]
        d = [squared(x[:, :cut], self.halves[0]), squared(x[:, cut:], self.halves[1])]
        t = min(self.side, most)
        near = [np.argsort(m, axis=1, kind="stable")[:, :t] for m in d]
        a, b = (np.take_along_axis(m, i, 1) for m, i in zip(d, near))
        order = np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(x), -1), axis=1, kind="stable")[:, :most]
        return np.take_along_axis(near[0], order // t, 1) * self.side + np.take_along_axis(near[1], order % t, 1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of each vector's residual, and how far what they say is from it."""
        rest = x - self.centroid(home)
        codes = np.stack([nearest(p, b) for p, b in zip(self.parts(rest), self.books)], axis=1).astype(np.uint8)
        said = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.linalg.norm(rest - said, axis=1)

    def own(self, codes: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """The part of the squared distances to coded vectors of one list that doesn't depend on the vector compared."""
        out = np.zeros(len(codes))
        for m, (book, c) in enumerate(zip(self.books, np.array_split(centroid, len(self.books)))):
            out += ((book * book).sum(1) + 2 * book @ c)[codes[:, m]]
        return out

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the products of each vector's part with the codes: the same for every list."""
        return [(part @ book.T).astype(np.float32) for part, book in zip(self.parts(x), self.books)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(a[i : i + 4096], b).argmin(1) for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.random.default_rng(1).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(x: np.ndarray, side: int) -> Quantiser:
    side, cut = min(side, len(x)), max(1, x.shape[1] // 2)
    halves = [k_means(x[:, :cut], side), k_means(x[:, cut:], side) if x.shape[1] > 1 else np.zeros((side, 0))]
    q = Quantiser(halves, [])
    rest = x - q.centroid(q.probes(x, 1)[:, 0])
    return Quantiser(halves, [k_means(p, min(CODES, len(p))) for p in np.array_split(rest, min(PARTS, x.shape[1]), axis=1)])


def unit(rows) -> np.ndarray:
    x = np.asarray(list(rows), np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def list_links(x: np.ndarray, tables: list[np.ndarray], who: np.ndarray, y: np.ndarray, codes: np.ndarray, error: np.ndarray, q: Quantiser, centroid: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in x, in y) of the pairs of the vectors x[who] and the coded members y of a list whose cosine is high enough."""
    limit = np.sqrt(2 - 2 * cosine) + error + 1e-7
    part = x[who]
    # asymmetric distances |x - c - r|^2 = |x - c|^2 + |r|^2 + 2 c.r - 2 x.r, where r is what the codes say
    looked = np.zeros((len(who), len(y)), np.float32)
    for m, table in enumerate(tables):
        looked += table[who[:, None], codes[:, m][None]]
    apart = ((part - centroid) ** 2).sum(1)
    maybe = apart[:, None] + q.own(codes, centroid)[None] - 2 * looked <= (limit * limit)[None] + 1e-4
    a, b = np.nonzero(maybe)
    if 8 * len(a) > maybe.size:
        good = (part @ y.T)[a, b] >= cosine
    else:
        good = np.einsum("ij,ij->i", part[a], y[b]) >= cosine
    return who[a[good]], b[good]


def near_embeddings(vectors: DataFrame, *, cosine: float = 0.93, sample: int = SAMPLE, block: int = BLOCK, per_list: int = PER_LIST, hot_rows: int = 10_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors."""
    spark = vectors.sparkSession
    bound_batches(spark)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", "embedding", F.coalesce(good, F.lit(False)).alias("good"))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit("second"), "embedding")})
    key = ["label", "h1", "h2"]
    ones = written(
        rows.filter("good").groupBy(*key).agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n"), F.count("vec_id").alias("rows"))
        .withColumn("dim", F.size("embedding"))
    )
    kinds = ones.groupBy("dim", "label").agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).groupBy("dim").agg(F.max("n").alias("n"), F.sum("rows").alias("rows")).collect()
    bad = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not kinds:
        return bad
    links = None
    for kind in kinds:  # one for each dimension, of which a table has one as a rule
        own = ones.filter(F.col("dim") == kind["dim"])
        side = int(min(MOST_SIDE, max(1, round((kind["n"] / per_list) ** 0.5))))
        some = own.orderBy(F.xxhash64("embedding", "label"), "id").limit(max(sample, 16 * side)).select("embedding").toPandas()
        found = _links(own, fit(unit(some["embedding"]), side), cosine, block)
        links = found if links is None else links.unionByName(found)
    links = written(links)
    count = links.groupBy("id", *key[1:]).agg(F.sum("links").alias("links"))
    root = connected_components(links.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = ones.join(count, ["id", "h1", "h2"], "left").join(root, "id", "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    total = sum(k["rows"] for k in kinds)
    out = spread_join(rows.filter("good").select("vec_id", *key), known, key, ones.select(*key, F.col("rows").alias("n")), total=total, hot_rows=hot_rows)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(bad)


def _links(ones: DataFrame, q: Quantiser, cosine: float, block: int) -> DataFrame:
    """(id, h1, h2, links, root): parts of each vector's number of links, and a vector that it is connected to."""
    spark = ones.sparkSession
    shared = spark.sparkContext.broadcast(tuple(q))
    most = min(q.side**2, int(np.ceil(4 * (q.side**2) ** 0.3)))
    label, kind = (ones.schema[c].dataType.simpleString() for c in ("label", "embedding"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Quantiser(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                probes = q.probes(unit(part.column(1).to_pylist()), most)
                first = np.sort(probes // q.side, axis=1)
                new = np.ones(first.shape, bool)
                new[:, 1:] = first[:, 1:] != first[:, :-1]
                row, col = np.nonzero(new)  # a row for each first centroid that the vector probes
                take = pa.array(row)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(probes[row].astype(np.int32).reshape(-1)), most).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(first[row, col].astype(np.int32)), lists, *(part.column(i).take(take) for i in (2, 3, 4, 5, 1))],
                    names=["label", "at", "lists", "id", "h1", "h2", "n", "embedding"],
                )

    dealt = ones.select("label", "embedding", "id", "h1", "h2", "n").mapInArrow(deal, f"label {label}, at int, lists array<int>, id long, h1 long, h2 long, n long, embedding {kind}")
    # what is dealt isn't written: it is dealt once to count the groups' rows, and once to compare them
    sizes = written(dealt.groupBy("label", "at").agg(F.count("*").alias("size")).filter(F.col("size") > block))
    chunks = F.coalesce(F.ceil(F.col("size") / block).cast("int"), F.lit(1))
    placed = dealt.join(F.broadcast(sizes), ["label", "at"], "left").withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id", "h1"), F.col("chunks")).cast("int"))
    # a row meets every chunk of its group once: as (chunk, other) or (other, chunk)
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "label", "at", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "lists", "id", "h1", "h2", "n", "embedding"
    )

    def compare(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        q = Quantiser(*shared.value)
        _, at, lo, hi = key
        pdf = pdf.sort_values(["id", "h1"], kind="stable").reset_index(drop=True)
        x, lists, chunk = unit(pdf["embedding"]), np.stack(pdf["lists"].to_numpy()), pdf["chunk"].to_numpy()
        home = lists[:, 0]
        member = np.flatnonzero(home // q.side == at)
        codes, error = np.zeros((len(x), len(q.books)), np.uint8), np.zeros(len(x))
        if len(member):
            codes[member], error[member] = q.encode(x[member], home[member])
        row, col = np.nonzero(lists // q.side == at)
        asked = lists[row, col]
        order = np.argsort(asked, kind="stable")
        row, asked = row[order], asked[order]
        a, b = [], []
        held = {one: member[home[member] == one] for one in np.unique(home[member]).tolist()}
        for begin in range(0, len(x), QUERIES):
            tables = q.tables(x[begin : begin + QUERIES])
            for one, m in held.items():
                who = row[np.searchsorted(asked, one) : np.searchsorted(asked, one, "right")]
                who = who[(who >= begin) & (who < begin + QUERIES)] - begin
                for left, right in ((lo, hi), (hi, lo)) if lo != hi else ((lo, lo),):
                    left, right = who[chunk[who + begin] == left], m[chunk[m] == right]
                    for k in range(0, len(right), QUERIES):
                        some = right[k : k + QUERIES]
                        if len(left):
                            i, j = list_links(x[begin : begin + QUERIES], tables, left, x[some], codes[some], error[some], q, q.centroid(np.array([one]))[0], cosine)
                            a.append(i + begin)
                            b.append(some[j])
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        # each pair counts once: of one list in order; else where the smaller finds the larger, or where it doesn't and is found
        once = np.where(home[i] == home[j], i < j, (i < j) | ~(lists[j] == home[i][:, None]).any(1))
        i, j = i[once], j[once]
        n, ids = pdf["n"].to_numpy(), pdf["id"].to_numpy()
        count = np.bincount(i, weights=n[j], minlength=len(ids)) + np.bincount(j, weights=n[i], minlength=len(ids))
        has = np.flatnonzero(count)
        return pd.DataFrame({"id": ids[has], "h1": pdf["h1"].to_numpy()[has], "h2": pdf["h2"].to_numpy()[has], "links": count[has].astype(np.int64), "root": ids[local_roots(len(ids), i, j)][has]})

    return pairs.groupBy("label", "at", "lo", "hi").applyInPandas(compare, "id long, h1 long, h2 long, links long, root long")
