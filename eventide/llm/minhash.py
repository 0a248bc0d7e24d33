"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

The signature of a document estimates the probability Jaccard similarity of its weighted shingles
(weight 1 + ln of the number of times). Every shingle is a Poisson process of arrivals with its weight as
the rate; an arrival falls into a uniformly drawn slot, each slot keeps its earliest arrival, and a
process ends once its next arrival is later than every slot's (then no later one can change
anything). Slots are compared in bands. Texts with the same words are one text from the start: only
one of them enters the buckets. In a bucket every text is compared with one leader; texts that
this leaves in different components are then compared with one another, so no bucket is cut short: the texts outside the
bucket's largest component meet all others, in blocks bounded by rows and bytes, and those inside it don't meet again.
Leaders and buckets with very many texts, texts with very many copies and documents with very many links are split over several tasks.
A link needs a Jaccard similarity of the shingle sets of at least `threshold`, computed from the texts.

Defined cases: a text without words links with nothing and is its own class, as is a row without
doc_id (its class is null). Rows that repeat a doc_id are one vertex, which has the links of all their texts. Repeated rows and
texts of the same words are linked without being compared; a similarity equal to the threshold is a link. A very long text is read whole, as one
row of a block. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import HOT_ROWS, bound_batches, dropped, mix, spread_join, text_slices, written
from eventide.llm.components import connected_components, local_roots
from eventide.llm.text import Shingles, digests, jaccard, owners, shingles, words

_STEP = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(s: Shingles, slots: int) -> np.ndarray:
    """rows x slots hashes: the shingle whose arrival is the earliest in each slot (0: no shingle)."""
    rows = len(s.row) - 1
    own = owners(s.row)
    order = np.argsort((own.astype(np.uint64) << np.uint64(44)) | (s.hash >> np.uint64(20)), kind="stable")
    h, d = s.hash[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    weight = 1 + np.log(np.diff(np.append(at, len(h))))
    h, d = h[at], d[at]
    first = np.full(rows * slots, np.inf)
    who = np.zeros(rows * slots, np.uint64)
    latest = np.full(rows, np.inf)
    state, time = h.copy(), np.zeros(len(h))
    while len(h):
        state = state + _STEP
        draw = mix(state)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        live = time < latest[d]
        h, d, state, time, weight, draw = h[live], d[live], state[live], time[live], weight[live], draw[live]
        # another draw for the slot: it must not depend on the time
        slot = d * slots + (mix(draw + np.uint64(1)) % np.uint64(slots)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = time == first[slot]
        who[slot[won]] = h[won]
        latest = first.reshape(rows, slots).max(axis=1)
    return who.reshape(rows, slots)


def signatures(docs: DataFrame, *, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, d1, d2, bands): a hash of the text, two hashes of the words in order, and a hash for each band."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(batch.column(2), 1 << 19):
                w = words(batch.column(2).slice(at, n))
                sig = prob_minhash(shingles(w, k), bands * rows).reshape(n, bands, rows)
                h = np.zeros((n, bands), np.uint64)
                for j in range(rows):
                    h = mix(h * _STEP + sig[:, :, j] + np.uint64(j))
                d1, d2 = digests(w)
                flat = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), h.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), flat], names=["doc_id", "h", "d1", "d2", "bands"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), text).mapInArrow(run, "doc_id long, h long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, *, k: int, threshold: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Of the pairs (a, b), those whose texts are similar enough. texts: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in text_slices(batch.column(2)):
                part = batch.slice(at, n)
                good = pa.array(jaccard(part.column(2), part.column(3), k) >= threshold)
                yield part.select(["a", "b"]).filter(good)

    total, both = pairs.count(), pairs
    for end in ("b", "a"):  # a leader stands in as many pairs as its bucket has texts
        side = texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}"))
        both = spread_join(both, side, [end], pairs.groupBy(end).agg(F.count("*").alias("n")), total=total, hot_rows=hot_rows)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shared_counts(s: Shingles) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct shingles each pair of texts shares, and how many each text has."""
    n, own = len(s.row) - 1, owners(s.row)
    value, code = np.unique(s.hash, return_inverse=True)
    cell = np.unique(code * n + own)  # each text's distinct shingles, by shingle
    code, own = cell // n, cell % n
    size = np.bincount(own, minlength=n)
    often = np.bincount(code, minlength=len(value)) > 1
    renumber = np.cumsum(often) - 1
    code, own = renumber[code[often[code]]], own[often[code]]
    both = np.zeros((n, n), np.float32)
    for at in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(code, [at, at + 4096])
        part = np.zeros((n, 4096), np.float32)
        part[own[a:b], code[a:b] - at] = 1
        both += part @ part.T
    return both, size


def blocks(members: DataFrame, *, block: int, counts: DataFrame | None = None, total: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Deals the texts of mixed buckets to groups in which every two of different components meet.

    members: (band, bucket, id, root, size in bytes). Adds kind, lo and hi, a row for each group of a text. The texts outside the
    bucket's largest component are cut into chunks of `block` rows (a row counts more by 16 KB each), and so are those inside it: a
    chunk outside meets every chunk inside (kind 0) and every other outside (kind 1). So a bucket of n copies and few others
    travels as often as the others have chunks, once as a rule. counts: (band, bucket, n) of the buckets, `total` of all.
    """
    weight = 1 + F.col("size") / 16_384
    parts = members.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    chunks = lambda w: F.ceil(w / block).cast("int")
    bucket = parts.groupBy("band", "bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.sum("weight").alias("all"), F.max_by("weight", F.struct("n", "root")).alias("weight"))
    bucket = bucket.select("band", "bucket", "most", chunks(F.col("weight")).alias("inside"), F.greatest(F.lit(1), chunks(F.col("all") - F.col("weight"))).alias("outside"))
    key = ["band", "bucket"]
    rows = members.join(bucket, key) if counts is None else spread_join(members, bucket, key, counts, total=total, hot_rows=hot_rows)
    rows = rows.withColumn("in", F.col("root") == F.col("most"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("in"), F.col("inside")).otherwise(F.col("outside"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    own = F.col("own")
    met = F.when(F.col("in"), F.transform(upto(F.col("outside")), lambda i: group(0, i, own))).otherwise(
        F.concat(
            F.transform(upto(F.col("inside")), lambda j: group(0, own, j)),
            F.transform(F.filter(upto(F.col("outside")), lambda j: j != own), lambda j: group(1, F.least(own, j), F.greatest(own, j))),
        )
    )
    return rows.select("band", "bucket", "id", "root", F.explode(met).alias("g")).select("band", "bucket", "g.kind", "g.lo", "g.hi", "id", "root")


def block_links(members: DataFrame, texts: DataFrame, *, k: int, threshold: float, block: int, counts: DataFrame, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): links that connect what buckets' texts of different components connect. members: (band, bucket, id, root)."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        both, size = shared_counts(shingles(words(pa.array(pdf["text"], pa.string())), k))
        i, j = np.nonzero(np.triu(both >= threshold * (size[:, None] + size[None] - both) - 1e-6, 1))
        good = pdf["root"].to_numpy()[i] != pdf["root"].to_numpy()[j]
        ids = pdf["id"].to_numpy()
        root = local_roots(len(ids), i[good], j[good])
        has = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[root[has]], "b": ids[has]})

    groups = blocks(members.join(texts.select("id", "size"), "id"), block=block, counts=counts, total=total, hot_rows=hot_rows)
    rows = groups.join(texts.select("id", "text"), "id")
    return rows.groupBy("band", "bucket", "kind", "lo", "hi").applyInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, bands: int = 24, rows: int = 4, small: int = 24, block: int = 512, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, class_id), a row per row of docs; class_id is the smallest doc_id of its class."""
    sig = written(signatures(docs, k=k, bands=bands, rows=rows))
    good = sig.filter("doc_id is not null and d1 <> 0")
    # texts with the same words are one, numbered by itself; the smallest doc_id stands for all that hold it
    texts_of = good.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    ones = written(texts_of.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h"), "n", "bands"))
    same = spread_join(good.select("doc_id", "d1", "d2"), ones.select("d1", "d2", F.col("doc_id").alias("a")), ["d1", "d2"], ones.select("d1", "d2", "n"), total=sig.count(), hot_rows=hot_rows)
    same = same.filter("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    slots = ones.select("id", F.posexplode("bands").alias("band", "bucket"))
    leaders = slots.groupBy("band", "bucket").agg(F.min_by("id", F.xxhash64("id", "band")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    leaders = written(leaders)
    n_slots = bands * ones.count()
    shared = written(spread_join(slots, leaders, ["band", "bucket"], leaders.select("band", "bucket", "n"), total=n_slots, hot_rows=hot_rows).select("band", "bucket", "id", "leader", "n"))
    pairs = written(shared.filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
    wanted = shared.select("id").distinct()
    holders = ones.select("id", "doc_id", "h").join(wanted, "id")
    text = F.col("text").cast("string")
    texts = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).join(holders, ["doc_id", "h"]).groupBy("id").agg(F.max("text").alias("text")).withColumn("size", F.octet_length("text")))
    links = written(verified(pairs, texts, k=k, threshold=threshold, hot_rows=hot_rows))
    root = connected_components(links, hot_rows=hot_rows)
    member = written(shared.join(root, "id", "left").select("band", "bucket", "id", "n", F.coalesce("root", "id").alias("root")))
    mixed = member.groupBy("band", "bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band", "bucket")
    sizes = leaders.select("band", "bucket", "n")
    left = written(spread_join(member.filter("n > 2"), mixed, ["band", "bucket"], sizes, total=n_slots, hot_rows=hot_rows))
    few = left.filter(F.col("n") <= small)
    x = few.select("band", "bucket", F.col("id").alias("a"), F.col("root").alias("ra"))
    y = few.select("band", "bucket", F.col("id").alias("b"), F.col("root").alias("rb"))
    rest = x.join(y, ["band", "bucket"]).filter("a < b and ra <> rb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = written(rest)
    more = verified(rest, texts, k=k, threshold=threshold, hot_rows=hot_rows)
    many = block_links(left.filter(F.col("n") > small).drop("n"), texts, k=k, threshold=threshold, block=block, counts=sizes, total=n_slots, hot_rows=hot_rows)
    # links of texts are links of the documents that stand for them
    found = written(links.union(more).union(many))
    total, ends = found.count(), found
    for end in ("b", "a"):  # a leader has as many links as its bucket has texts that are like it
        side = ones.select(F.col("id").alias(end), F.col("doc_id").alias(f"d{end}"))
        ends = spread_join(ends, side, [end], found.groupBy(end).agg(F.count("*").alias("n")), total=total, hot_rows=hot_rows)
    root = connected_components(ends.select(F.col("da").alias("a"), F.col("db").alias("b")).union(same), hot_rows=hot_rows)
    for done in (ones, leaders, shared, pairs, texts, links, member, left, rest, found):  # the result reads sig and root only
        dropped(docs.sparkSession, done)
    class_ = sig.select("doc_id").join(root.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return class_.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))
