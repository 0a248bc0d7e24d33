"""Leaves, differences and digests of documents against plain recursion."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from eventide.operators import documents as D
from eventide.operators.verdicts import deep_diff
from eventide.sources.readers import canonical_digest

DOCS = [
    {"b": {"z": 1.5, "a": [1, {"x": None}], "é": 'q"\né'}, "_n": 3, "a": 1, "c": {}, "d": [], "g": True},
    {"b": {"z": 1.5, "a": [1, {"x": 0}], "é": 'q"\né'}, "_n": 4, "a": 1, "c": {"k": 1}, "d": [2], "a.b": [[0], [[1, 2]]]},
    {"_inner": {"_x": 1, "y": {"_z": 2}}, "k": {"_kept": 1}},
    {},
]


def flat(v, at="$"):
    if isinstance(v, dict) and v:
        return {p: x for k, w in v.items() for p, x in flat(w, f"{at}.{k}" if k.isidentifier() and k.isascii() else f"{at}[{json.dumps(k, ensure_ascii=False)}]").items()}
    if isinstance(v, list) and v:
        return {p: x for i, w in enumerate(v) for p, x in flat(w, f"{at}[{i}]").items()}
    return {at: json.dumps(v, ensure_ascii=False, separators=(",", ":"))}


def frame(spark, docs):
    return spark.createDataFrame([(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")


def test_leaves_equal_recursion(spark):
    rows = D.leaves(frame(spark, [*DOCS, 5, [1, [2]], None]), "doc").collect()
    for i, d in enumerate([*DOCS, 5, [1, [2]]]):
        assert {r.path: r.value for r in rows if r.id == i} == flat(d), d
    assert not [r for r in rows if r.id == 6]
    with pytest.raises(Exception, match="deeper than 2 levels"):
        D.leaves(frame(spark, DOCS), "doc", depth=2).collect()
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        D.leaves(spark.createDataFrame([("{x",)], "doc string"), "doc").collect()


def test_leaf_diff(spark):
    a, b = frame(spark, [DOCS[0], DOCS[2], DOCS[3]]), frame(spark, [DOCS[1], DOCS[2], None])
    got = {(r.id, r.path): (r.left, r.right) for r in D.leaf_diff(a, b, ["id"], "doc").collect()}
    x, y = flat(DOCS[0]), flat(DOCS[1])
    want = {(0, p): (x.get(p), y.get(p)) for p in x.keys() | y.keys() if x.get(p) != y.get(p)} | {(2, "$"): ("{}", None)}
    assert got == want
    assert {p.split("[")[0] for p in deep_diff(DOCS[0], DOCS[1])} >= {"$._n", "$.c.k", "$.d", "$.b.a"}
    some = D.leaf_diff(a, b, ["id"], "doc", ignore=("$._n", "$.b", "$.c")).select("path").distinct().collect()
    assert {r.path for r in some} == {"$", "$.d", "$.d[0]", "$.g", '$["a.b"][0][0]', '$["a.b"][1][0][0]', '$["a.b"][1][0][1]'}
    # NULL keys are paired too
    n = spark.createDataFrame([(None, '{"v":1}')], "id int, doc string")
    assert D.leaf_diff(n, n.withColumn("doc", F.lit('{"v":2}')), ["id"], "doc").first()[:] == (None, "$.v", "1", "2")


def test_digests_of_text_equal_plain(spark):
    df = frame(spark, [*DOCS, None])
    for r in df.select("id", D.canonical_digests(df, "doc").alias("digest")).collect():
        assert r.digest == (None if r.id == len(DOCS) else canonical_digest(DOCS[r.id]))


def test_digests_of_nested_columns_equal_plain(spark):
    kind = "doc struct<b: struct<z: int, _y: string>, a: array<struct<q: int, p: string>>, _top: int, m: map<string, struct<v: int, u: boolean>>>"
    rows = [((dict(z=1, _y="é"), [dict(q=1, p="x"), dict(q=None, p='"')], 7, {"k": dict(v=1, u=True), "a": dict(v=2, u=None)}),), ((None, [], None, {}),), (None,)]
    df = spark.createDataFrame(rows, kind)
    got = [r.digest for r in df.select(D.canonical_digests(df, "doc").alias("digest")).collect()]
    full = [{"b": r[0][0], "a": r[0][1], "_top": r[0][2], "m": r[0][3]} for r in rows[:2]]
    assert got == [*map(canonical_digest, full), None]


def test_tree_digests(spark):
    rows = [("g" if i % 3 else None, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(400)]
    got = {r.g: (r.n, r.digest) for r in D.tree_digests(spark.createDataFrame(rows, "g string, d string"), ["g"], "d").collect()}
    for g in ("g", None):
        own = sorted(d for k, d in rows if k == g)
        buckets = sorted({d[:2] for d in own})
        sha = lambda lines: hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert got[g] == (len(own), sha([f"{b}:{sha([d for d in own if d[:2] == b])}" for b in buckets]))


def test_result_documents(spark):
    rows = [(2, "good", 1.5, None, "é"), (2, "bad", None, 7, '"'), (1, "good", 0.1, 0, None)]
    df = spark.createDataFrame(rows, "spec int, layer string, z double, _n long, a string")
    got = {r.spec: r for r in D.result_documents(df, ["spec"], "layer").collect()}
    for spec in (1, 2):
        want = {"spec": spec, "layer": {k: {"z": z, "_n": n, "a": a} for s, k, z, n, a in rows if s == spec}}
        assert json.loads(got[spec].doc) == want
        assert got[spec].doc == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[spec].digest == canonical_digest(want)
    for wrong in ((1, "good", 0.2, 1, None), (1, None, 0.2, 1, None)):  # a layer twice, a layer without a name
        with pytest.raises(Exception, match="(?i)map.?key"):
            D.result_documents(spark.createDataFrame([*rows, wrong], df.schema), ["spec"], "layer").collect()
    assert D.result_documents(df.limit(0), ["spec"], "layer").count() == 0
