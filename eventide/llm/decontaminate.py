"""Benchmark decontamination by greedy string tiling.

Karp-Rabin hashes of windows of `min_match` words are the seeds, and hashes of seeds in a row those of
longer windows. The longest unmarked words that a document and a benchmark item share are a tile and are marked on
both sides; then the longest of what is left, while it has `min_match` words. The tiles' words over the item's
words are its coverage, which doesn't depend on the order of the passages. Equal seeds aren't paired, so
a text that repeats itself costs no more memory than another.

A benchmark up to `broadcast_bytes` of text travels to every task, so the documents aren't moved;
a larger one is joined on the seeds instead, with the same result. A pair is looked at only if it shares one of the item's rarer seeds: an
item that is covered enough has so many of its seeds in the document that leaving out one fewer of its most common ones loses no pair, and a phrase that
many items hold isn't followed into each of them. In the join, seeds and items that
very many documents share are split over several tasks.

Defined cases: null and empty texts match nothing, nor do items of fewer than `min_match` words. Of matches of one length the one that begins first in the
document, then in the item, is taken first; a coverage equal to the threshold is a match. Very long texts are read whole.
Repeated rows each have their result; rows without doc_id have theirs, and items without item_id none. An empty table on either side gives no match. Extra columns
aren't read by matches() and pass through decontaminated().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.llm.common import HOT_ROWS, as_array, bound_batches, mix, spread_join, text_slices, written
from eventide.llm.text import owners, powers, shingles, words

BROADCAST_BYTES = 32 << 20
_BASE = 0x9E6C63D0876A9A67
_INVERSE = pow(_BASE, -1, 1 << 64)
MATCHES = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def _among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b, the smaller side."""
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a if len(b) else np.zeros(len(a), bool)


class Seeds:
    """One side's seeds in order of place: how far each is followed by unmarked ones without a gap, and hashes of such windows."""

    def __init__(self, place: np.ndarray, hash_: np.ndarray):
        n, self.place = len(place), place
        end = np.append(np.flatnonzero(np.diff(place) != 1) + 1, n)
        self.left = end[np.searchsorted(end, np.arange(n), "right")] - np.arange(n)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hash_) * powers(_BASE, n), out=self.total[1:])
        self.down = powers(_INVERSE, n + 1)

    def windows(self, n: int) -> np.ndarray:
        """Where `n` seeds without a gap begin."""
        return np.flatnonzero(self.left >= n)

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.total[at + n] - self.total[at]) * self.down[at]

    def mark(self, at: int, n_words: int, min_match: int, most: int) -> None:
        """No seed may hold a word of the n_words from seed `at` on; no window is longer than `most`."""
        first = self.place[at] - min_match + 1
        lo, hi = np.searchsorted(self.place, [first - most, self.place[at] + n_words])
        self.left[lo:hi] = np.minimum(self.left[lo:hi], np.maximum(first - self.place[lo:hi], 0))


def tiles(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(start in document, start in item, words) of the greedy tiling.

    p, x: places, in order, and hashes of the document's seeds that the item holds too; q, y: of the item's. The greatest
    length that windows of both sides share is searched by halving (a shared window holds shared shorter ones), and all tiles of it are
    marked before a shorter one is looked for. Memory grows with the seeds of both sides, not with the pairs of equal ones.
    """
    doc, item = Seeds(p, x), Seeds(q, y)
    out: list[tuple[int, int, int]] = []
    most = n = int(min(doc.left.max(initial=0), item.left.max(initial=0)))
    while n:
        low, high = 0, n
        while low < high:
            mid = (low + high + 1) // 2
            shared = _among(doc.hashes(doc.windows(mid), mid), item.hashes(item.windows(mid), mid)).any()
            low, high = (mid, high) if shared else (low, mid - 1)
        n = low
        if not n:
            break
        size = n + min_match - 1
        a, b = doc.windows(n), item.windows(n)
        ha, hb = doc.hashes(a, n), item.hashes(b, n)
        while True:
            has = _among(ha, hb)
            a, ha = a[has], ha[has]
            if not len(a):
                break
            j = b[np.flatnonzero(hb == ha[0])[0]]
            out.append((int(p[a[0]]), int(q[j]), size))
            item.mark(j, size, min_match, most)
            doc.mark(a[0], size, min_match, most)
            free = item.left[b] >= n
            b, hb = b[free], hb[free]
            later = np.searchsorted(p[a], p[a[0]] + size)
            a, ha = a[later:], ha[later:]
        n -= 1
    return out


def match(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, size: int, min_match: int, threshold: float) -> tuple[float, int, int] | None:
    """(coverage, tiles, longest tile) of an item of `size` words by a document, if it reaches the threshold; p, x and q, y: places and hashes of their seeds."""
    of_item, of_doc = np.isin(y, x), _among(x, y)
    if of_item.sum() * min_match < threshold * size:
        return None
    got = tiles(p[of_doc], x[of_doc], q[of_item], y[of_item], min_match)
    covered = sum(n for *_, n in got) / size
    return (covered, len(got), max(n for *_, n in got)) if covered >= threshold else None


def rare_seeds(item: np.ndarray, often: np.ndarray, size: np.ndarray, min_match: int, threshold: float) -> np.ndarray:
    """Which seeds of each item to look up: all but as many of the most common ones as an item may lack that is covered enough.

    A tile of n words has n - min_match + 1 >= n / min_match seeds, so a covered item has `least` of its seeds in the document; of all but the
    least - 1 most common ones, one is there.
    """
    order = np.lexsort((often, item))
    seeds = np.bincount(item, minlength=len(size))
    nth = np.empty(len(item), np.int64)
    nth[order] = np.arange(len(item)) - (np.cumsum(seeds) - seeds)[item[order]]
    least = np.ceil(size * threshold / min_match - 1e-9).astype(np.int64)
    return nth <= (seeds - least)[item]


class Items:
    """The seeds of all items: the rarer ones of each sorted, with a bit table in front that rejects most others, and all of them by item."""

    def __init__(self, ids: list[int], col: pa.Array, min_match: int, threshold: float):
        w = words(col)
        self.ids, self.min_match = np.asarray(ids, np.int64), min_match
        self.size = np.diff(w.row)
        s = shingles(w, min_match)
        item = owners(s.row)
        whole = self.size[item] >= min_match
        self.all, self.row = s.hash, s.row
        _, which, n = np.unique(s.hash, return_inverse=True, return_counts=True)
        keep = whole & rare_seeds(item, n[which], self.size, min_match, threshold)
        h, item = s.hash[keep], item[keep]
        order = np.argsort(h, kind="stable")
        self.hash, self.item = h[order], item[order]
        self.mask = np.uint64((1 << max(16, int(len(h)).bit_length() + 5)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(self.hash & self.mask).astype(np.int64)] = True

    def matches(self, col: pa.Array, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(row, item id, coverage, tiles, longest tile) of the pairs that reach the threshold, of all that share a rarer seed."""
        s = shingles(words(col), self.min_match)
        at = np.flatnonzero(self.bits[(s.hash & self.mask).astype(np.int64)])
        row = np.searchsorted(s.row, at, "right") - 1
        # a seed of a row is looked up once
        _, once = np.unique(s.hash[at] ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
        at, row = at[once], row[once]
        lo = np.searchsorted(self.hash, s.hash[at])
        n = np.searchsorted(self.hash, s.hash[at], "right") - lo
        pairs = np.unique(np.repeat(row, n) * len(self.size) + self.item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        out, now = [], -1
        for r, item in zip((pairs // len(self.size)).tolist(), (pairs % len(self.size)).tolist()):
            if r != now:
                own = s.hash[s.row[r] : s.row[r + 1]]
                order, now = np.argsort(own, kind="stable"), r
                own = own[order]
            y = self.all[self.row[item] : self.row[item + 1]]
            each = np.unique(y)
            lo = np.searchsorted(own, each)
            n = np.searchsorted(own, each, "right") - lo
            p = np.sort(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
            got = match(p, s.hash[s.row[r] + p], np.arange(len(y)), y, int(self.size[item]), self.min_match, threshold)
            if got:
                out.append((r, int(self.ids[item]), *got))
        return out


def _small(bench: DataFrame, broadcast_bytes: int) -> bool:
    n = bench.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    return (n[0] or 0) + 16 * n[1] <= broadcast_bytes


def _items(bench: DataFrame, min_match: int, threshold: float):
    rows = bench.filter("item_id is not null").orderBy("item_id", "text").collect()  # checked by _small
    col = pa.array([r["text"] for r in rows], pa.string())
    return Shared(bench.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], col, min_match, threshold)))


class Shared:
    """A broadcast value with a name by which a worker keeps what it builds from it."""

    def __init__(self, sent):
        self.sent, self.id = sent, uuid.uuid4().hex

    @property
    def value(self):
        return self.sent.value


_built: dict[str, Items] = {}


def _index(shared) -> Items:
    """The index of a broadcast benchmark, built once in each worker process."""
    if shared.id not in _built:
        _built.clear()
        _built[shared.id] = Items(*shared.value)
    return _built[shared.id]


def matches(docs: DataFrame, bench: DataFrame, *, min_match: int = 4, threshold: float = 0.6, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest): the pairs whose coverage reaches the threshold."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bench = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    if not _small(bench, broadcast_bytes):
        return docs.select("doc_id", _row("doc_id").alias("_row")).join(_joined(docs, bench, min_match, threshold), "_row").drop("_row")
    shared = _items(bench, min_match, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in batches:
            for at, n in text_slices(batch.column(1)):
                part = batch.slice(at, n)
                got = index.matches(part.column(1), threshold)
                ids = part.column(0).take(pa.array([r for r, *_ in got], pa.int64()))
                rest = list(zip(*(g[1:] for g in got))) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, k) for c, k in zip(rest, (pa.int64(), pa.float64(), pa.int32(), pa.int32())))], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"]
                )

    return docs.mapInArrow(run, MATCHES)


def _seeds(df: DataFrame, key: str, min_match: int) -> DataFrame:
    """(key, hash, at, size): a row per seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(batch.column(1)):
                w = words(batch.column(1).slice(at, n))
                s, size = shingles(w, min_match), np.diff(w.row)
                own = owners(s.row)
                pos = np.arange(len(s.hash)) - s.row[own]
                good = size[own] >= min_match
                key_ = batch.column(0).slice(at, n).take(pa.array(own[good]))
                yield pa.RecordBatch.from_arrays([key_, pa.array(s.hash[good].view(np.int64)), pa.array(pos[good]), pa.array(size[own][good])], names=["key", "hash", "at", "size"])

    return df.select(key, "text").mapInArrow(run, "key long, hash long, at long, size long")


def _row(key: str):
    """A hash of the whole row (key, text); it isn't null where the key is."""
    return F.xxhash64(F.col(key).cast("long"), F.col("text").cast("string"))


def _joined(docs: DataFrame, bench: DataFrame, min_match: int, threshold: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(_row, item_id, coverage, n_tiles, longest): every row of the benchmark is an item of its own."""
    items = bench.filter("item_id is not null").withColumn("_item", _row("item_id"))
    d = written(_seeds(docs.select(_row("doc_id").alias("_row"), "text").distinct(), "_row", min_match).select(F.col("key").alias("_row"), "hash", F.col("at").alias("p")))
    b = written(_seeds(items.select("_item", "text").distinct(), "_item", min_match).select(F.col("key").alias("_item"), "hash", F.col("at").alias("q"), "size"))
    total = d.count()
    often = written(d.groupBy("hash").agg(F.count("*").alias("n")).join(b.select("hash").distinct(), "hash", "left_semi"))
    # a covered item has `least` of its seeds in the document, so one of the others with the least `least` - 1 left out is there too
    of = Window.partitionBy("_item")
    ranked = b.join(often, "hash", "left").withColumns({"nth": F.row_number().over(of.orderBy(F.coalesce("n", F.lit(0)), "hash", "q")), "seeds": F.count("*").over(of)})
    least = F.ceil(F.col("size") * threshold / min_match - 1e-9)
    rare = ranked.filter(F.col("n").isNotNull() & (F.col("nth") <= F.col("seeds") - least + 1)).select("_item", "hash").distinct()
    maybe = written(spread_join(d.select("_row", "hash").distinct(), rare, ["hash"], often, total=total, hot_rows=hot_rows).select("_row", "_item").distinct())
    n_maybe, per_item = maybe.count(), maybe.groupBy("_item").agg(F.count("*").alias("n"))
    met = spread_join(maybe, b.select("_item", "hash").distinct(), ["_item"], per_item, total=n_maybe, hot_rows=hot_rows)
    seeds = lambda at: F.array_sort(F.collect_list(F.struct(at, "hash")))
    of_doc = met.join(d, ["_row", "hash"]).groupBy("_row", "_item").agg(seeds("p").alias("x"))
    pairs = spread_join(of_doc, b.groupBy("_item").agg(F.max("size").alias("size"), seeds("q").alias("y")), ["_item"], per_item, total=n_maybe, hot_rows=hot_rows)

    def run(batches):
        for pdf in batches:
            out = []
            for r, i, size, *at in pdf.itertuples(index=False):
                p, x, q, y = (np.asarray(a, np.int64) for a in at)
                got = match(p, x.view(np.uint64), q, y.view(np.uint64), size, min_match, threshold)
                if got:
                    out.append((r, i, *got))
            yield pdf.__class__(out, columns=["_row", "_item", "coverage", "n_tiles", "longest"])

    pairs = pairs.select("_row", "_item", "size", "x.p", "x.hash", "y.q", F.col("y.hash").alias("hash_q"))
    hits = pairs.mapInPandas(run, "_row long, _item long, coverage double, n_tiles int, longest int")
    return hits.join(items.select("item_id", "_item"), "_item").select("_row", "item_id", "coverage", "n_tiles", "longest")


def decontaminated(docs: DataFrame, bench: DataFrame, *, min_match: int = 4, threshold: float = 0.6, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents, with all their columns, that cover no benchmark item."""
    bound_batches(docs.sparkSession)
    bench = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    if not _small(bench, broadcast_bytes):
        bad = _joined(docs.select("doc_id", F.col("text").cast("string")), bench, min_match, threshold).select(F.col("_row").alias("_contaminated")).distinct()
        return docs.join(bad, _row("doc_id") == F.col("_contaminated"), "left_anti")
    shared, where = _items(bench, min_match, threshold), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in batches:
            for at, n in text_slices(as_array(batch.column(where))):
                part = batch.slice(at, n)
                keep = np.ones(n, bool)
                keep[[r for r, *_ in index.matches(part.column(where), threshold)]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
