"""Result documents as data: their leaves, the difference of two runs, canonical text and digests.

Documents are rows of JSON text (or nested columns), so a comparison of millions of them is one plan, and nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"


def leaves(docs: DataFrame, doc: str, *, depth: int = 12) -> DataFrame:
    """The other columns, path and value (JSON text) of every leaf of a column of JSON text.

    A path is $.name[index].name; a name that isn't a plain word is quoted: $["a.b"]. Empty objects and arrays are leaves, null is a leaf; a NULL document has
    none, and text that isn't JSON fails the job. Each level is a lateral explosion of the rows of the level before, without a shuffle; documents deeper than `depth` fail the job.
    """
    kept = [c for c in docs.columns if c != doc]
    rows = docs.filter(F.col(doc).isNotNull()).select(*kept, F.lit("$").alias("_path"), F.parse_json(doc).alias("_value"))
    for _ in range(depth):
        inside = docs.sparkSession.tvf.variant_explode_outer(F.col("_value").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_inner"))
        name = F.when(F.col("_key").rlike(NAME), F.concat(F.lit("."), F.col("_key"))).otherwise(F.concat(F.lit("["), F.to_json(F.array("_key")).substr(F.lit(2), F.length(F.to_json(F.array("_key"))) - 2), F.lit("]")))
        step = F.when(F.col("_key").isNotNull(), name).otherwise(F.concat(F.lit("["), F.col("_pos"), F.lit("]")))
        # what can't be opened any more stays as it is
        opened = F.col("_pos").isNotNull()
        rows = rows.lateralJoin(inside).select(*kept, F.when(opened, F.concat("_path", step)).otherwise(F.col("_path")).alias("_path"), F.when(opened, F.col("_inner")).otherwise(F.col("_value")).alias("_value"))
    text = F.to_json("_value")
    flat = ~text.rlike(r"^[\[{]") | text.isin("{}", "[]")
    why = F.concat(F.lit(f"a document is deeper than {depth} levels at "), F.col("_path"))
    return rows.select(*kept, F.col("_path").alias("path"), F.when(flat, text).otherwise(F.raise_error(why)).alias("value"))


def leaf_diff(a: DataFrame, b: DataFrame, keys: list[str], doc: str, *, ignore: tuple[str, ...] = (), depth: int = 12) -> DataFrame:
    """(keys, path, left, right) of the leaves that differ; NULL where a side hasn't the leaf.

    Paths that begin with one of `ignore` (as whole steps) are left out. Documents are paired by keys (NULL keys too); one that the other side hasn't gives all of its leaves.
    """
    sides = []
    for df, name in ((a, "left"), (b, "right")):
        rows = leaves(df.select(*keys, doc), doc, depth=depth)
        for prefix in ignore:
            rows = rows.filter(~((F.col("path") == prefix) | F.col("path").startswith(f"{prefix}.") | F.col("path").startswith(f"{prefix}[")))
        sides.append(rows.withColumnRenamed("value", name).alias(name))
    same = F.lit(True)
    for k in [*keys, "path"]:
        same = same & F.col(f"left.{k}").eqNullSafe(F.col(f"right.{k}"))
    both = sides[0].join(sides[1], same, "full").filter(~F.col("left.left").eqNullSafe(F.col("right.right")))
    return both.select(*(F.coalesce(f"left.{k}", f"right.{k}").alias(k) for k in [*keys, "path"]), F.col("left.left").alias("left"), F.col("right.right").alias("right"))


def in_order(entries: Column) -> Column:
    """A map with its keys in order; its values needn't be comparable."""
    return F.map_from_entries(F.array_sort(F.map_entries(entries), lambda x, y: F.when(x.key < y.key, -1).when(x.key > y.key, 1).otherwise(0)))


def canonical_json(doc: Column) -> Column:
    """JSON text with the names of every object in order, without blanks, and without the document's own names that begin with an underscore.

    Numbers are written shortest (1.50 as 1.5, 1.0 as 1); a document that isn't an object keeps its form.
    """
    value = F.parse_json(doc)
    fields = F.map_filter(value.cast("map<string,variant>"), lambda k, _: ~k.startswith("_"))
    return F.when(F.ltrim(doc).startswith("{"), F.to_json(in_order(fields))).otherwise(F.to_json(value))


def canonical_struct(value: Column, kind: DataType, *, top: bool = True) -> Column:
    """A nested column whose to_json() is canonical: fields and keys in order at every depth, the outermost ones that begin with an underscore dropped."""
    if isinstance(kind, StructType):
        fields = sorted((f for f in kind.fields if not (top and f.name.startswith("_"))), key=lambda f: f.name)
        out = F.struct(*(canonical_struct(value.getField(f.name), f.dataType, top=False).alias(f.name) for f in fields))
        return F.when(value.isNotNull(), out)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: canonical_struct(x, kind.elementType, top=False))
    if isinstance(kind, MapType):
        values = F.transform_values(value, lambda _, x: canonical_struct(x, kind.valueType, top=False))
        return in_order(F.map_filter(values, lambda k, _: ~k.startswith("_")) if top else values)
    return value


def canonical_digests(df: DataFrame, column: str) -> Column:
    """The digest of each row's document: sha256 of its canonical text and a line end; NULL for none. column: JSON text, or a nested column."""
    kind = df.schema[column].dataType
    text = canonical_json(F.col(column)) if kind.simpleString() == "string" else F.to_json(canonical_struct(F.col(column), kind), {"ignoreNullFields": "false"})
    return F.sha2(F.concat(F.when(F.col(column).isNotNull(), text), F.lit("\n")), 256)


def tree_digests(rows: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, n, digest) of each group's sorted list of digests, made in two steps so that no group is gathered whole.

    A digest belongs to one of 256 buckets by its first two characters; a bucket's text is the sorted list of its digests, and the group's that of its buckets' digests.
    """
    bucket = F.substring(digest, 1, 2)
    lists = rows.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(digest))), 256).alias("_d"))
    ordered = F.array_sort(F.collect_list(F.struct("_b", "_d")))  # 256 at most
    return lists.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sha2(F.concat_ws("\n", F.transform(ordered, lambda x: F.concat(x["_b"], F.lit(":"), x["_d"]))), 256).alias("digest"))


def result_documents(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(keys, doc, digest), a document of canonical JSON for each key, in which `by` maps each of its values to the other columns.

    A value of `by` that is NULL or comes twice under a key fails the job. NULL columns are written as null. A document holds its key's rows, so they must be as few as the
    layers of a study. The digest is that of canonical_digests().
    """
    others = [c for c in rows.columns if c not in (*keys, by)]
    inner = F.map_from_entries(F.collect_list(F.struct(F.col(by), F.struct(*others))))
    whole = rows.groupBy(*keys).agg(inner.alias("_by")).select(*keys, F.struct(*keys, F.col("_by").alias(by)).alias("_doc"))
    text = F.to_json(canonical_struct(F.col("_doc"), whole.schema["_doc"].dataType), {"ignoreNullFields": "false"})
    return whole.select(*keys, text.alias("doc")).withColumn("digest", F.sha2(F.concat("doc", F.lit("\n")), 256))
