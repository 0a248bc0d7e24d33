"""The operators against brute-force versions, exact round trips and held-out accuracy."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline as P
from eventide.llm import decontaminate, embedding_dedup, language_id, minhash, packing, toxicity
from eventide.llm.queries import BPE, op1_best_fit_packing

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def words(t):
    return regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())


def grams(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(texts, threshold=0.8):
    """The smallest id that each id reaches over all pairs of sets similar enough."""
    sets, holds = {i: grams(t) for i, t in texts.items()}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holds[g].append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        near = defaultdict(int)
        for g in sets[i]:
            for j in holds[g]:
                if j < i:
                    near[j] += 1
        for j, n in near.items():
            if n / (len(sets[i]) + len(sets[j]) - n) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def noisy(seed, groups=12):
    """Groups of edited copies around and below the threshold."""
    r, out = random.Random(seed), {}
    for _ in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(40, 160))]
        for _ in range(r.randrange(1, 40)):
            t = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 25))):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            out[len(out)] = " ".join(t)
    return out


@pytest.mark.parametrize("small", [24, 3])
def test_near_duplicates_equal_all_pairs(spark, small):
    texts = noisy(small)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, small=small, block=16).collect()}
    assert got == classes(texts)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE["tokenizer"])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    rows = op1_best_fit_packing(spark, MEDIUM).toPandas()
    for doc, part in rows.sort_values("piece").groupby("doc_id"):
        ids = [*whole.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        assert part["length"].sum() == len(ids) and (part["length"].iloc[1:] == 2048).all() and (len(ids) > 2048 or len(part) == 1)
        for r in part.itertuples():
            assert zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert set(rows["doc_id"]) == set(texts)
    for _, b in rows.sort_values("offset").groupby("sequence_id"):
        assert (b["offset"] == b["length"].cumsum() - b["length"]).all() and b["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 2048) + 2


def test_encoder_equals_tokenizers():
    e = packing.encoder(BPE["tokenizer"], BPE["ranks"], BPE["pattern"])
    r = random.Random(5)
    bits = ["a", "Hello", "it's", " ", "  ", "\n", "\t", "é", "日本", "🙂", "123", "...", "<|endoftext|>", " ", "​", "'s", "x" * 50]
    for _ in range(3000):
        t = "".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randrange(12)))
        assert e(t) == e.exact(t), repr(t)


def test_best_fit_is_best_fit():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 101, 400)
    where, offset = packing.best_fit(lengths, 100)
    room: list[int] = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(x, b) for b, x in enumerate(room) if x >= lengths[i]]
        if fits:
            assert room[where[i]] == min(fits)[0]
        else:
            assert where[i] == len(room)
            room.append(100)
        assert offset[i] == 100 - room[where[i]]
        room[where[i]] -= lengths[i]


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    rows = []
    for i in range(900):
        v = centres[i % 12] + r.normal(size=16) * r.choice([0.05, 0.2, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ids, x, label = np.array([a for a, _, _ in rows]), np.array([b for _, b, _ in rows]), np.array([c for *_, c in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = ((x @ x.T) >= 0.93) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    root = embedding_dedup.local_roots(len(ids), *np.nonzero(near))
    for per_list, block in ((64, 1024), (20, 40)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_embeddings(df, per_list=per_list, block=block, hot_rows=10).collect()}
        assert got == {int(i): (int(n), int(ids[k])) for i, n, k in zip(ids, near.sum(1), root)}


def test_embeddings_recall_where_not_all_lists_are_probed(spark):
    # independent components and partners right above the least cosine, the hardest case; brute force over every third vector
    r = np.random.default_rng(7)
    x = r.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = r.normal(size=(3000, 32))
    off -= (off * x[:3000]).sum(1, keepdims=True) * x[:3000]
    x[3000:] = 0.935 * x[:3000] + np.sqrt(1 - 0.935**2) * off / np.linalg.norm(off, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(df, per_list=20).collect()}
    asked = np.arange(0, 6000, 3)
    want = ((x[asked] @ x.T) >= 0.93).sum(1) - 1
    have = np.array([got[i] for i in asked])
    assert (have <= want).all() and have.sum() >= 0.98 * want.sum()


def plain_tiles(doc, item, least):
    """Greedy string tiling by looking at every pair of positions; of equal lengths the first in the document, then in the item."""
    used_d, used_i, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < least:
            return out / len(item)
        used_d.update(range(best[1], best[1] + best[0]))
        used_i.update(range(best[2], best[2] + best[0]))
        out += best[0]


def test_tiling_equals_plain_tiling(spark):
    r = random.Random(8)
    items = [[f"t{r.randrange(60)}" for _ in range(r.randrange(12, 40))] for _ in range(5)]
    texts = []
    for _ in range(40):
        it = r.choice(items)
        cuts = sorted(r.sample(range(1, len(it)), 2))
        parts = [it[: cuts[0]], it[cuts[0] : cuts[1]], it[cuts[1] :]]
        r.shuffle(parts)
        noise = [f"n{r.randrange(90)}" for _ in range(r.randrange(30))]
        texts.append(noise + parts[0] + noise[:3] + parts[1] + (parts[2] if r.random() < 0.7 else []))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.matches(d, bench).collect()}
    want = {(a, b): round(c, 9) for a, t in enumerate(texts) for b, x in enumerate(items) if (c := plain_tiles(t, x, 4)) >= 0.6}
    assert got == want and len(got) > 10
    assert {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.matches(d, bench, broadcast_bytes=0).collect()} == want


def test_tiling_without_ties_is_exact(spark):
    # words of an item are distinct, so two matches never overlap and the order of ties changes nothing
    r = random.Random(2)
    items = [[f"i{k}w{j}" for j in range(r.randrange(8, 50))] for k in range(6)]
    texts = []
    for _ in range(60):
        it, t = r.choice(items), []
        for _ in range(r.randrange(1, 5)):
            a = r.randrange(len(it))
            t += it[a : a + r.randrange(1, 20)] + [f"n{r.randrange(50)}"] * r.randrange(1, 3)
        texts.append(t)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    want = {(a, b): round(c, 9) for a, t in enumerate(texts) for b, x in enumerate(items) if (c := plain_tiles(t, x, 4)) >= 0.3}
    for size in (1 << 20, 0):
        got = {(r.doc_id, r.item_id): round(r.coverage, 9) for r in decontaminate.matches(d, bench, threshold=0.3, broadcast_bytes=size).collect()}
        assert got == want and len(got) > 10


def test_items_that_share_a_phrase(spark):
    # a phrase that all items hold, identical items, and documents with the phrase only: plain tiling decides who is found
    r = random.Random(12)
    phrase = [f"common{i}" for i in range(7)]
    items = [phrase + [f"i{k}w{j}" for j in range(r.randrange(4, 20))] for k in range(25)] + [phrase + ["end"]] * 4
    texts = []
    for _ in range(60):
        it = r.choice(items)
        own = it[7:]
        texts.append(r.choice([phrase * 3, phrase + own, own, own[: len(own) // 2] + ["x"] + phrase, ["y"] + own[2:] + ["z"] + phrase[:5]]))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    want = {(a, b) for a, t in enumerate(texts) for b, x in enumerate(items) if plain_tiles(t, x, 4) >= 0.6}
    for size in (1 << 20, 0):
        assert {(r.doc_id, r.item_id) for r in decontaminate.matches(d, bench, broadcast_bytes=size).collect()} == want and len(want) > 40


def test_near_duplicates_recall_at_sf001(spark):
    # all pairs of all documents against the operator: every pair of similarity 0.8 or more is in one class
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()}
    want = classes(texts)
    together = [i for i in texts if want[i] != i]
    assert len(together) > 50 and sum(got[i] == got[want[i]] for i in together) >= 0.99 * len(together)
    assert sum(got[i] != i and want[i] == i for i in texts) == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    caught = rows[rows["predicted"] == 1]
    assert (caught["toxic"] == 1).mean() > 0.9 and len(caught) >= 0.5 * (rows["toxic"] == 1).sum()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.97


def common_lines(texts):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    scores = toxicity.toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))).collect()
    before = read(docs)
    texts = {r.doc_id: before[r.doc_id] or "" for r in scores if r.score < 0.3}
    texts = common_lines(texts)
    texts = {i: texts[i] for i, c in classes(texts).items() if i == c}
    items = [words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    seeds = [{tuple(x[i : i + 4]) for i in range(len(x) - 3)} for x in items]

    def leaked(t):
        w = words(t)
        have = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        near = [x for x, s in zip(items, seeds) if 4 * len(s & have) >= 0.6 * len(x)]
        return any(plain_tiles(w, x, 4) >= 0.6 for x in near)

    want = {i: t for i, t in texts.items() if not leaked(t)}
    out = P.run(spark, SMALL).toPandas()
    assert set(out["doc_id"]) == set(want)
    e = packing.encoder(BPE["tokenizer"], BPE["ranks"], BPE["pattern"])
    assert out.groupby("doc_id")["length"].sum().to_dict() == {i: len(e(t)) // 4 + 1 for i, t in want.items()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    stage = P.STAGES[1][1](spark, docs.filter(F.col("doc_id") < 50), SMALL)
    assert stage.columns == docs.columns


def plain_kneser_ney(grams, toxic, ordinary):
    """Differences by n-gram and by context over all n-grams at once, as dictionaries."""
    shared, level, order = {0: 1 / 256}, dict.fromkeys(grams, 1), toxicity.ORDER
    levels = []
    for size in range(order - 1, 0, -1):
        up = defaultdict(int)
        for g in level:
            up[g & ((1 << 8 * size) - 1)] += 1
        level = up
        levels.append((size, up))
    for size, n in reversed(levels):
        one, two = (sum(v == k for v in n.values()) for k in (1, 2))
        d = one / (one + 2 * two) if one else 0.5
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in n.items():
            total[g >> 8] += v
            kinds[g >> 8] += 1
        shared = {g: max(v - d, 0) / total[g >> 8] + d * kinds[g >> 8] / total[g >> 8] * shared[g & ((1 << 8 * (size - 1)) - 1)] for g, v in n.items()}
    out = []
    for n in (toxic, ordinary):
        total, off = defaultdict(int), defaultdict(float)
        for g, v in zip(grams, n):
            total[g >> 8] += v
            off[g >> 8] += min(v, toxicity.DISCOUNT)
        rest = {c: off[c] / total[c] if total[c] else 1.0 for c in total}
        out.append(({g: np.log((v - min(v, toxicity.DISCOUNT)) / max(total[g >> 8], 1) + rest[g >> 8] * shared[g & ((1 << 8 * (order - 1)) - 1)]) for g, v in zip(grams, n)}, rest))
    (g1, c1), (g0, c0) = out
    return {g: g1[g] - g0[g] for g in g1}, {c: np.log(c1[c]) - np.log(c0[c]) for c in c1}


def test_kneser_ney_equals_plain_version(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    train = docs.join(labels.select("doc_id", F.col("toxic").cast("int")), "doc_id").select("text", "toxic", (F.col("doc_id") % 2).cast("int").alias("half"))
    counted = toxicity._grams(train)
    t = counted.toPandas()
    half, whole = toxicity.kneser_ney(counted)
    for model, toxic, ordinary in ((half, t.toxic0, t.ordinary0), (whole, t.toxic0 + t.toxic1, t.ordinary0 + t.ordinary1)):
        by_gram, by_context = plain_kneser_ney(t.gram.tolist(), toxic.tolist(), ordinary.tolist())
        assert len(model.gram) and len(model.gram) < len(by_gram)
        gram, context = dict(zip(model.gram.tolist(), model.gram_diff)), dict(zip(model.context.tolist(), model.context_diff))
        for g, want in by_gram.items():  # what the model leaves out costs what its context says, or nothing
            assert gram.get(g, context.get(g >> 8, 0.0)) == pytest.approx(want, abs=1e-5)
        for c, want in by_context.items():
            assert context.get(c, 0.0) == pytest.approx(want, abs=1e-5)
