"""Substring dedup by content-defined chunking.

A gear rolling hash runs over the UTF-8 bytes. A place is a candidate where the hash's bits of a window of some 20
bytes are zero, and a border where no other candidate is within `least` bytes before it. Both
depend on the bytes just before the place and on nothing else, so an insertion moves no border behind its
window, and a passage has the same chunks in whatever document it stands. Chunks are deduplicated by the digest (128 bits) of the run that
begins with them: as many chunks as make `min_bytes`, all of one document. A run is a copy
if a document with a smaller doc_id holds its digest (with `within`, also if its own document does before it); the chunks of copied runs
are dropped. So whatever is dropped stands in a stretch of at least `min_bytes` that one other document
holds without a gap, and phrases that recur by chance in several documents drop nothing, however
many documents there are. A passage of some 250 bytes or more is caught wherever its borders fall, but for one that repeats a word
or two only: it has no border inside, so it is one chunk with what surrounds it.

Only (digest, doc_id) pairs are shuffled, pre-aggregated, and a digest that very many documents hold is split over several tasks; the text
meets the digests that are copies in its own document and is chunked once more.

Defined cases: null and empty texts have no chunks; texts shorter than `min_bytes` lose nothing. Rows without doc_id are kept
whole and don't count. Rows that repeat a doc_id are one document: they are treated alike, and none is a copy of another.
Of documents that hold the same run the one with the smallest doc_id keeps it. Very long texts are chunked whole. An empty table gives
an empty result. Extra columns pass through deduplicated() unless they clash with its output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import HOT_ROWS, as_array, bound_batches, mix, spread_join, text_slices, written
from eventide.llm.text import powers

GEAR = np.random.default_rng(4711).integers(0, 1 << 32, 256, dtype=np.uint32)
BITS, SHIFT, LEAST, MIN_BYTES = 5, 18, 8, 100
_BASE, _BASE2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = as_array(pa.compute.fill_null(col.cast(pa.large_string()), ""))
    row = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", np.uint8)[row[0] : row[-1]], row - row[0]


DIGEST = np.dtype([("d1", np.uint64), ("d2", np.uint64)])


def _polynomial(values: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The polynomial modulo 2^64 in the values from each start up to stop."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[stop] - total[start]) * powers(pow(base, -1, 1 << 64), len(values) + 1)[start]


def chunks(col: pa.Array, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, row, last, digest, data): where each chunk begins, the row it is of, the last chunk of the run that begins with it (-1: the row ends before) and the run's digest.

    A digest has two numbers of 64 bits: one of the run's bytes, one of its mixed words of eight bytes at every place, so that bytes
    that agree in the first by a pattern don't in the second.
    """
    data, row = _bytes(col)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, DIGEST), data
    h, span = GEAR[data], 1
    while span < 32:  # h[i] = sum over j < span of gear[i - j] << j
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    hit = ((h >> np.uint32(SHIFT)) & np.uint32((1 << BITS) - 1)) == 0
    head = (row[:-1, None] + np.arange(SHIFT + BITS + 1)[None]).ravel()
    hit[head[head < n]] = False  # there the window would reach into the row before
    at = np.flatnonzero(hit)
    at = at[np.diff(at, prepend=-LEAST - 1) > LEAST]
    cut = at + 1
    for _ in range(3):  # not inside a character
        inside = (cut < n) & ((data[np.minimum(cut, n - 1)] & 0xC0) == 0x80)
        cut = cut + inside
    start = np.unique(np.concatenate([row[:-1][np.diff(row) > 0], cut[cut < n]]))
    own = np.searchsorted(row, start, "right") - 1
    end = np.append(start[1:], n)
    last = np.searchsorted(end, start + min_bytes)
    last[(last >= len(start)) | (own[np.minimum(last, len(start) - 1)] != own)] = -1
    stop = np.where(last >= 0, end[last], start)
    size = (stop - start).astype(np.uint64)
    eight = np.ndarray(n, "<u8", np.append(data, np.zeros(7, np.uint8)).tobytes(), strides=1)
    digest = np.zeros(len(start), DIGEST)
    digest["d1"] = mix(_polynomial(data.astype(np.uint64) + np.uint64(1), _BASE, start, stop) ^ size)
    digest["d2"] = mix(_polynomial(mix(eight), _BASE2, start, np.maximum(start, stop - 7)) ^ size)  # of words inside the run
    return start, own, last, digest, data


def _pairs(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(d1, d2, doc_id), once for each row that holds such a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(batch.column(1)):
                part = batch.slice(at, n)
                _, row, last, digest, _ = chunks(part.column(1), min_bytes)
                row, digest = row[last >= 0], digest[last >= 0]
                key = digest["d1"] ^ mix(digest["d2"] + mix(row.astype(np.uint64) + np.uint64(1)))
                once = np.sort(np.unique(key, return_index=True)[1])
                d1, d2 = (pa.array(digest[d][once].view(np.int64)) for d in ("d1", "d2"))
                yield pa.RecordBatch.from_arrays([d1, d2, part.column(0).take(pa.array(row[once]))], names=["d1", "d2", "doc_id"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "d1 long, d2 long, doc_id long")


OUTPUT = {"n_chunks": "long", "n_dropped": "long", "dropped_bytes": "long", "first_doc_ids": "array<bigint>", "kept_text": "string"}


def deduplicated(docs: DataFrame, *, min_bytes: int = MIN_BYTES, within: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds n_chunks, n_dropped, dropped_bytes, first_doc_ids (who holds what was dropped before) and kept_text."""
    bound_batches(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if c not in OUTPUT))
    pairs = written(_pairs(docs, min_bytes))
    shared = written(pairs.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    copies = (
        spread_join(pairs, shared.drop("n"), ["d1", "d2"], shared.drop("first"), total=pairs.count(), hot_rows=hot_rows)
        .filter("doc_id > first").groupBy("doc_id").agg(F.collect_list(F.struct("d1", "d2", "first")).alias("_hits"))
        .select("doc_id", *(F.col(f"_hits.{c}").alias(f"_{c}") for c in ("d1", "d2", "first")))
    )
    joined = docs.join(copies.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    where, ids = docs.columns.index("text"), docs.columns.index("doc_id")
    names, width = [*docs.columns, *OUTPUT], len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(as_array(batch.column(where)), 1 << 20):
                part = batch.slice(at, n)
                start, row, last, digest, data = chunks(part.column(where), min_bytes)
                size = np.diff(np.append(start, len(data)))
                bounds = np.searchsorted(row, np.arange(n + 1))
                known = part.column(width).is_valid().to_numpy(zero_copy_only=False)
                has_id = part.column(ids).is_valid().to_numpy(zero_copy_only=False)
                out: list[tuple] = []
                for i in range(n):
                    a, b = bounds[i], bounds[i + 1]
                    own, first = digest[a:b], np.zeros(b - a, np.int64)
                    copy = np.zeros(b - a, bool)
                    if has_id[i] and b > a:
                        if within:
                            copy[:] = True
                            copy[np.unique(own, return_index=True)[1]] = False
                        first[:] = part.column(ids)[i].as_py()
                        if known[i]:
                            d1, d2, firsts = (part.column(width + j)[i].values.to_numpy() for j in range(3))
                            order = np.argsort(d1)
                            at_ = order[np.minimum(np.searchsorted(d1, own["d1"].view(np.int64), sorter=order), len(d1) - 1)]
                            found = (d1[at_] == own["d1"].view(np.int64)) & (d2[at_] == own["d2"].view(np.int64))
                            first[found] = firsts[at_[found]]
                            copy |= found
                        copy &= last[a:b] >= 0
                    edge = np.zeros(b - a + 1, np.int64)  # a copied run drops its chunks
                    np.add.at(edge, np.flatnonzero(copy), 1)
                    np.add.at(edge, last[a:b][copy] - a + 1, -1)
                    drop = np.cumsum(edge)[:-1] > 0
                    keep = np.repeat(~drop, size[a:b])
                    base = start[a] if b > a else 0
                    text = data[base : base + int(size[a:b].sum())][keep].tobytes().decode()
                    out.append((b - a, int(drop.sum()), int(size[a:b][drop].sum()), np.unique(first[copy]).tolist(), text))
                cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *cols], names=names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return joined.mapInArrow(run, ", ".join(fields + [f"{k} {v}" for k, v in OUTPUT.items()]))
