"""Hot keys, texts that repeat themselves, and the substring operator against a plain version."""

import gc
import random
import time
import weakref
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventide.llm import decontaminate, minhash, substring_dedup
from eventide.llm.common import spread_join, written
from eventide.llm.components import connected_components
from tests.llm.test_llm_brute import plain_tiles


def test_no_task_holds_a_hot_key(spark):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as with sides that are large
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(200_000).select(F.lit(1).alias("k"), "id").union(spark.range(100).select(F.col("id").cast("int") + 2, "id"))
        side = rows.select("k").distinct().withColumn("v", F.col("k") * 10)
        counts = rows.groupBy("k").agg(F.count("*").alias("n"))
        out = spread_join(rows, side, ["k"], counts, total=200_100, hot_rows=1000).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()
    finally:
        for key in off:
            spark.conf.unset(key)
    assert sum(r.n for r in out) == 200_100 and sum(r.v for r in out) == 2_000_000 + sum(10 * (i + 2) for i in range(100))
    assert max(r.n for r in out) <= 2 * 200_100 / len(out)


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_components_with_hubs(spark, hot_rows):
    r = random.Random(3)
    links = [(0, i) for i in range(1, 2000)] + [(5000, i) for i in range(3000, 4000)] + [(i, i + 1) for i in range(6000, 6100)] + [(1500, 6050)]
    links += [(a, b) for a, b in ((r.randrange(7000, 8000), r.randrange(7000, 8000)) for _ in range(600))]
    root = {i: i for link in links for i in link}
    while True:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    alone = {i for i in root if not any(i in (a, b) and a != b for a, b in links)}
    r.shuffle(links)
    got = {x.id: x.root for x in connected_components(spark.createDataFrame(links, "a long, b long"), hot_rows=hot_rows).collect()}
    assert got == {i: v for i, v in root.items() if i not in alone}


def test_copies_of_one_text_are_split(spark):
    # 20,000 copies of one text, near copies of it, and others, with a key hot from 50 rows
    base = [f"word{i}" for i in range(60)]
    near = [" ".join([*base[:j], "x", *base[j:]]) for j in (0, 60)] + [" ".join(base[1:])]
    others = [" ".join(f"o{k}w{i}" for i in range(30)) for k in range(20)]
    copies = spark.range(20_000).select((F.col("id") + 100).alias("doc_id"), F.lit(" ".join(base)).alias("text"))
    rest = spark.createDataFrame(list(enumerate([*near, *others])), "doc_id long, text string")
    out = minhash.near_duplicates(copies.union(rest), hot_rows=50)
    got = {(r.class_id, r.n) for r in out.groupBy("class_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 20_003)} | {(i, 1) for i in range(3, 23)}


def test_texts_that_repeat_themselves():
    items = [["spam"] * 200, ["a", "b"] * 50, ["a", "b", "c"] * 10 + ["d"] * 12]
    index = decontaminate.Items([0, 1, 2], pa.array([" ".join(x) for x in items]), 4, 0.6)
    long = ["spam " * 1_000_000, "a b " * 500_000, "a b c " * 300_000 + "d d d d d d x " * 3]
    begun = time.time()
    got = index.matches(pa.array(long), 0.6)
    assert time.time() - begun < 10
    assert [(r, i, c) for r, i, c, *_ in got] == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]
    r = random.Random(5)
    for _ in range(60):  # few words, so that nearly every seed repeats and lengths tie
        doc, item = ([r.choice("ab" if r.random() < 0.9 else "abc") for _ in range(r.randrange(4, 60))] for _ in range(2))
        one = decontaminate.Items([0], pa.array([" ".join(item)]), 4, 0.3)
        have = one.matches(pa.array([" ".join(doc)]), 0.3)
        want = plain_tiles(doc, item, 4)
        assert [h[2] for h in have] == ([pytest.approx(want)] if want >= 0.3 else [])


def plain_substring(texts, min_bytes):
    """The whole result, with the runs themselves in place of digests."""
    starts, runs, holder = {}, {}, {}
    for i, t in texts.items():
        data, h, hits = t.encode(), 0, set()
        for at, b in enumerate(data):
            h = (2 * h + int(substring_dedup.GEAR[b])) % 2**32
            if at >= substring_dedup.SHIFT + substring_dedup.BITS + 1 and (h >> substring_dedup.SHIFT) % 2**substring_dedup.BITS == 0:
                hits.add(at)
        cuts = {0} if data else set()
        for at in hits:
            if not any(at - k in hits for k in range(1, substring_dedup.LEAST + 1)):
                at += 1
                while at < len(data) and data[at] & 0xC0 == 0x80:
                    at += 1
                cuts |= {at} - {len(data)}
        starts[i] = sorted(cuts)
        ends, runs[i] = [*starts[i][1:], len(data)], []
        for s in starts[i]:
            last = next((k for k, e in enumerate(ends) if e >= s + min_bytes), None)
            runs[i].append((last, data[s : ends[last]]) if last is not None else None)
            if last is not None:
                holder[runs[i][-1][1]] = min(i, holder.get(runs[i][-1][1], i))
    out = {}
    for i, t in texts.items():
        data, gone, first = t.encode(), set(), set()
        for k, run in enumerate(runs[i]):
            if run and holder[run[1]] < i:
                gone |= set(range(k, run[0] + 1))
                first.add(holder[run[1]])
        ends = [*starts[i][1:], len(data)]
        parts = [data[s:e] for s, e in zip(starts[i], ends)]
        kept = b"".join(x for k, x in enumerate(parts) if k not in gone).decode()
        out[i] = (len(parts), len(gone), sum(len(parts[k]) for k in gone), sorted(first), kept)
    return out


def test_substring_dedup_equals_plain_version(spark):
    r = random.Random(4)
    passage = lambda n: " ".join(r.choice(["été", "naïve", "日本語"]) if r.random() < 0.1 else "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    shared = [passage(80) for _ in range(6)]
    texts = {i: " ".join(r.choice([r.choice(shared), passage(r.randrange(40))]) for _ in range(r.randrange(6))) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_substring(texts, 100)
    got = {x.doc_id: (x.n_chunks, x.n_dropped, x.dropped_bytes, x.first_doc_ids, x.kept_text) for x in substring_dedup.deduplicated(df, hot_rows=20).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 100


def test_digests_differ_where_a_polynomial_repeats():
    # a Thue-Morse word and its complement agree in every polynomial modulo 2^64 once they are long enough
    word = "a"
    for _ in range(12):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    seen = defaultdict(set)
    for t in (word, other):
        _, _, last, digest, _ = substring_dedup.chunks(pa.array([t]), len(t))
        seen["d1"].add(int(digest["d1"][0]))
        seen["both"].add((int(digest["d1"][0]), int(digest["d2"][0])))
        assert last[0] >= 0 and np.count_nonzero(last >= 0) == 1
    assert len(seen["both"]) == 2


def test_joins_of_few_rows_have_no_broadcast_of_hot_keys(spark):
    rows, side = spark.range(50).select((F.col("id") % 5).alias("k"), "id"), spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    out = spread_join(rows, side, ["k"], rows.groupBy("k").agg(F.count("*").alias("n")), total=50)
    assert out.columns == ["k", "id", "v"] and sorted(map(tuple, out.collect())) == sorted((i % 5, i, i % 5 * 10) for i in range(50))
    assert "_parts" not in out._jdf.queryExecution().toString()


def test_written_tables_are_not_held_by_the_driver(spark):
    table = written(spark.range(10))
    held = weakref.ref(table)
    assert table.count() == 10
    del table
    gc.collect()
    assert held() is None
