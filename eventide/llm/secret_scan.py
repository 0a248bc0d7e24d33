"""Secret scan: patterns find candidates, a random forest removes the false positives.

Only DataFrame functions and Spark's own random forest run here. A text is cut at its candidates, so
the pieces before and after one are its neighbours; where a candidate begins is a running sum over the pieces before it, so time is linear in a
text's candidates. A candidate ends where its characters do, however long it is; a private key is one finding from its first line to its last, and of
an address with a password the password is the value. What the forest sees of a candidate: its length,
the transitions between kinds of characters, the variety of its characters, how much of it words
of a dictionary cover, whether it looks like a path or like a reference to a value kept elsewhere, and which words stand beside it.
The dictionary is the fixed one below and the words that most documents of the corpus hold (common_words() counts all documents).

labelled_findings() makes the labelled findings that the forest learns from by default: keys, tokens
and passwords on one side; digests of files and commits, identifiers, paths, placeholders, references and prose on the
other. fit() takes any table of the same columns, so findings that people have labelled can replace or extend it; quality() gives precision and
recall over findings that fit() didn't see.

Defined cases: null and empty texts have no candidates. Very long texts are read whole. Repeated rows, and rows without doc_id, each have their findings. Ties of the
forest's vote (0.5) count as secrets. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.llm.common import dropped, written

#: Names of secrets, prefixes that issuers document, and a small dictionary.
NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?"
ISSUED = {
    "aws_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[sr]k_live_[0-9A-Za-z]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:\s*+(?:[A-Za-z0-9-]{1,40}+:[^\n]{0,200}\n)*+[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]{0,20}PRIVATE KEY-----)?+",
}
#: The password in an address.
ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"'<>]{1,64}:([^\s/@\"'<>]{3,200}+)@"
DICTIONARY = (
    "example sample test demo dummy placeholder changeme default password secret token admin user username your insert here none null true false string value "
    "the and for with this that from have will name file path home data config index image static assets library version release update module package "
    "number account service server client public private local host domain email address document section chapter"
).split()
#: Of a value in quotes everything up to its own quote belongs to it, else commas and semicolons that another name doesn't follow.
BARE = r"(?:[^\s\"'<>,;]|[,;](?=[^\s\"'<>,;])(?![A-Za-z0-9_.-]{0,40}+[\"']?[ \t]{0,3}[:=]))"
VALUE = rf"{ISSUED['private_key']}[^\s\"'<>,;]*+|(?<=\")[^\s\"]{{8,}}+(?=\")|(?<=')[^\s']{{8,}}+(?=')|(?!//){BARE}{{8,}}+"
#: The whole word around a name is read at once, so a text is walked in linear time.
ASSIGNED = rf"(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]++[\"']?[ \t]{{0,3}}[:=])(?=[A-Za-z0-9_.-]*?(?i:{NAMES}))[A-Za-z0-9_.-]++[\"']?[ \t]{{0,3}}(?:[:=]|=>|:=)[ \t]{{0,3}}[\"']?({VALUE})"
#: The value of a candidate that a name and a sign begin.
NAMED = rf"^(?=[A-Za-z0-9_.-]*?(?i:{NAMES}))[A-Za-z0-9_.-]++[\"']?[ \t]{{0,3}}(?:[:=]|=>|:=)[ \t]{{0,3}}[\"']?([\s\S]{{8,}}+)$"
LONG = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
CANDIDATE = "|".join([*(rf"(?<![A-Za-z0-9]){p}" for p in ISSUED.values()), rf"(?<![A-Za-z0-9+.-]){ADDRESS}", ASSIGNED, LONG])
#: A cheap test that every text with a candidate passes.
MAYBE = rf"(?i:{NAMES})|[A-Za-z0-9+/_=-]{{20}}|xox[abprs]-|PRIVATE KEY|://[^\s:/@]{{1,64}}:[^\s/@]{{3}}"
BESIDE = {
    "near_secret": r"(?i)pass|pwd|secret|token|key|auth|credential|bearer|login",
    "near_digest": r"(?i)sha-?\d*|md5|checksum|digest|commit|hash|uuid|guid|etag|revision|version|integrity",
    "near_example": r"(?i)example|sample|test|dummy|placeholder|changeme|your|lorem|todo",
}
FEATURES = ["n", "transitions", "variety", "digits", "upper", "hex_only", "coverage", "prose", "path", "reference", "assigned", "issued", *BESIDE]
#: What code or a template writes in place of a value: ${NAME}, f(x), a[b], object.field
REFERENCE = r"[\[({]|^\$|^[A-Za-z_]+\.[A-Za-z_]+(?:\.[A-Za-z_]+)*$|^%[A-Za-z_]+%?$|^<.*>?$"
WORDS = 2_000
THRESHOLD = 0.5


class Scanner(NamedTuple):
    """The forest and the words of the corpus that its features read."""

    model: PipelineModel
    words: list[str]


def common_words(docs: DataFrame, *, most: int = WORDS) -> list[str]:
    """The words of three letters or more, lower-cased, that most documents hold; all documents are counted."""
    own = F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)))
    counts = docs.select(own.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r["word"] for r in counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()]


def featured(findings: DataFrame, words: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds the forest's features to findings (candidate, before, after). words: those of the corpus."""
    named, address = F.regexp_extract("candidate", NAMED, 1), F.regexp_extract("candidate", rf"^{ADDRESS}$", 1)
    assigned = F.when(address != "", address).otherwise(named)
    value = F.when(assigned != "", assigned).otherwise(F.col("candidate"))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001\u0002\u0003]", "\u0004")
    share = lambda pattern: F.length(F.regexp_replace("value", pattern, "")) / F.col("n")
    issued = "|".join(f"^{p}" for p in ISSUED.values())
    # runs of letters, also inside camelCase
    runs = F.split(F.lower(F.regexp_replace("value", "([a-z])([A-Z])", "$1 $2")), r"[^\p{L}]+")
    # one intersection by hash tells which of a value's words are known; their places are then looked for among these few
    hit = F.array_intersect(F.filter(runs, lambda w: F.length(w) >= 3), F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"))
    among = lambda own, h: F.aggregate(own, F.lit(0), lambda n, w: n + F.when(F.array_contains(h, w), F.length(w)).otherwise(0))
    prose = F.transform(F.array(hit), lambda h: F.when(F.size(h) > 0, among(runs, h)).otherwise(0))[0] / F.col("n")
    beside = F.concat_ws(" ", "before", F.when(assigned != "", F.regexp_replace("candidate", r"[:=].*", "")), "after")
    return (
        findings.withColumn("value", value).withColumn("n", F.length("value").cast("double"))
        .withColumn("transitions", (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / F.col("n"))
        .withColumn("variety", F.size(F.array_distinct(F.split("value", ""))) / F.sqrt("n"))
        .withColumn("digits", share("[^0-9]")).withColumn("upper", share("[^A-Z]"))
        .withColumn("hex_only", F.col("value").rlike("^[0-9a-f-]+$|^[0-9A-F-]+$").cast("double"))
        .withColumn("coverage", 1 - share(f"(?i){'|'.join(DICTIONARY)}"))
        .withColumn("path", (F.col("value").rlike(r"[/\\][A-Za-z0-9_.-]+[/\\]|^[./~]|\.[a-z]{2,4}$") | F.col("before").rlike(r"[/\\]$")).cast("double"))
        .withColumn("prose", prose).withColumn("reference", F.col("value").rlike(REFERENCE).cast("double"))
        .withColumn("assigned", (assigned != "").cast("double")).withColumn("issued", F.col("value").rlike(issued).cast("double"))
        .withColumns({k: beside.rlike(p).cast("double") for k, p in BESIDE.items()})
    )


def labelled_findings(spark: SparkSession, each: int = 120) -> DataFrame:
    """(id, candidate, before, after, label): `each` findings of every kind, made from digests of numbers."""
    hexed = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexed)), "[+/=]", "x")
    words = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.col("id") % len(DICTIONARY) + 1).cast("int"))
    more = F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.col("id") * 7 % len(DICTIONARY) + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ["password", "token", "secret", "api_key", "pwd"])), (F.col("id") % 5 + 1).cast("int"))
    sign = F.element_at(F.array(*map(F.lit, ["=", " = \"", ": ", "='"])), (F.col("id") % 4 + 1).cast("int"))
    n = (F.lit(10) + F.col("id") % 31).cast("int")
    around = [F.element_at(F.array(*map(F.lit, x)), (F.floor(F.col("id") / 5) % len(x) + 1).cast("int")) for x in (["client_", "DB_", "my.app.", "", "aws-", "user"], ["", "_key", "", "_value", "-prod", "2", ".main"])]
    longer = F.concat(around[0], name, around[1])
    few = (F.lit(8) + F.floor(F.col("id") / 3) % 12).cast("int")
    # 88 to 5,000 characters that no period repeats
    many = F.transform(F.sequence(F.lit(1), F.lit(2) + (F.col("id") * F.col("id") % 114).cast("int")), lambda i: F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(hexed, i.cast("string")), 256))), "[+/=]", "x"))
    long = F.array_join(many, "")
    upper = F.upper(F.substring(F.regexp_replace(mixed, "[^A-Za-z2-7]", "Q"), 1, 16))
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.floor(F.col("id") / 3) % len(x) + 1).cast("int"))
    screaming = F.upper(F.concat(words, F.lit("_"), name))
    dashed = F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12))
    based = F.base64(F.unhex(hexed))
    numbers = F.regexp_replace(F.concat(F.conv(F.substring(hexed, 1, 12), 16, 10), F.conv(F.substring(hexed, 13, 12), 16, 10)), "-", "")
    camel = F.concat(words, F.initcap(more), F.initcap(words), pick("Service", "Controller2", "Test", "Helper3"), F.initcap(more))
    kinds = [
        (F.concat(name, sign, F.substring(mixed, 1, 8), pick("!", "#", "$9", "@x"), F.substr(mixed, F.lit(9), few)), words, more, 1),
        (F.concat(longer, sign, dashed), words, more, 1),
        (F.concat(longer, sign, based), words, more, 1),
        (F.concat(longer, sign, F.substring(hexed, 1, 32)), words, more, 1),
        (F.concat(longer, sign, F.concat(words, F.substring(mixed, 1, 9))), words, more, 1),
        (F.concat(longer, sign, F.lit("${"), screaming, F.lit("}")), words, more, 0),
        (F.concat(longer, sign, pick("process.env.", "os.environ[", "config.get(", "settings.", "self.", "getenv("), screaming), words, more, 0),
        (F.concat(longer, sign, camel), words, more, 0),
        (F.concat(longer, sign, F.concat_ws(".", words, more, words)), words, more, 0),
        (F.concat(longer, sign, pick("xxxxxxxxxxxx", "********", "00000000", "12345678", "aaaaaaaaaaaaaaaa", "----------", "REDACTED", "undefined", "required", "optional")), words, more, 0),
        (F.concat(F.lit("sha512-"), based, F.substring(mixed, 1, 40)), F.lit("integrity "), more, 0),
        (F.substring(hexed, 1, 32), pick("md5 ", "etag ", "revision ", "hash of the file "), more, 0),
        (dashed, pick("id ", "uuid ", "guid ", "request "), more, 0),
        (F.substr(numbers, F.lit(1), F.least(F.length(numbers), F.lit(20) + F.col("id") % 8)), pick("account ", "number ", "timestamp ", "isbn "), more, 0),
        (F.concat(words, F.lit("/"), more, F.lit("/js/"), words, F.lit("-"), F.substring(hexed, 1, 8)), F.lit("src=/"), more, 0),
        (F.concat(camel, F.col("id").cast("string"), words), words, more, 0),
        (F.concat(F.lit("AKIA"), upper), words, more, 1),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), long, F.lit("\n-----END RSA PRIVATE KEY-----")), words, more, 1),
        (F.concat(pick("postgres://", "https://", "amqp://", "mysql+pymysql://"), words, F.lit(":"), F.substr(mixed, F.lit(1), few), F.lit("@")), words, pick("db.host:5432/app", "host/path", "localhost"), 1),
        (F.concat(pick("postgres://", "https://"), words, F.lit(":"), pick("password", "changeme", "your_password", "xxxxxxxx", "example", "<password>", "${PASSWORD}", "********"), F.lit("@")), F.lit("example "), F.lit("host/path"), 0),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), words, more, 1),
        (F.concat(name, sign, F.substr(hexed, F.lit(1), n)), words, more, 1),
        (F.concat(name, sign, F.substr(mixed, F.lit(1), n)), words, more, 1),
        (F.concat(name, sign, F.substring(hexed, 1, 40)), words, more, 1),
        (F.concat(F.lit("sk_live_"), F.substring(mixed, 1, 24)), words, more, 1),
        (F.concat(longer, sign, F.substr(hexed, F.lit(1), few)), words, more, 1),
        (F.concat(longer, sign, F.substr(mixed, F.lit(1), few)), words, more, 1),
        (F.concat(name, sign, long), words, more, 1),
        (long, F.lit("Authorization: Bearer "), more, 1),
        (F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), long, F.lit("."), F.substring(mixed, 1, 43)), words, more, 1),
        (long, F.lit("data:image/png;base64,"), more, 0),
        (F.concat(F.lit("AKIA"), F.lit("EXAMPLEKEY000000")), F.lit("example"), more, 0),
        (F.substring(hexed, 1, 40), F.lit("commit "), more, 0),
        (hexed, F.lit("sha256 checksum "), more, 0),
        (F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 12)), F.lit("uuid "), more, 0),
        (F.concat(words, F.lit("/"), more, F.lit("/module2/"), words, F.lit("_"), more), F.lit("see /"), more, 0),
        (F.concat(name, sign, words, F.lit("_"), more), words, more, 0),
        (F.concat(name, sign, F.lit("your_"), words, F.lit("_here")), F.lit("example"), more, 0),
        (F.concat(longer, sign, words, F.lit("_"), more), words, more, 0),
        (F.concat(longer, sign, F.lit("your_"), words, F.lit("_here")), F.lit("example"), more, 0),
        (F.concat(words, F.lit("_"), more, F.lit("_"), words, F.col("id").cast("string")), words, more, 0),
        (F.concat_ws("-", words, more, words, more, F.lit("2024")), words, more, 0),
        (F.repeat(F.concat((F.col("id") % 10).cast("string"), F.lit("0")), 12), words, more, 0),
    ]
    each_kind = F.array(*(F.struct(c.alias("candidate"), b.alias("before"), a.alias("after"), F.lit(float(label)).alias("label")) for c, b, a, label in kinds))
    return spark.range(0, each, 1, 8).select("id", F.inline(each_kind))


def fit(findings: DataFrame, *, words: list[str] = [], trees: int = 32, depth: int = 9, seed: int = 11) -> Scanner:  # noqa: B006
    """A forest over labelled findings (candidate, before, after, label 0 or 1). Their features are written once; the same findings give the same forest."""
    rows = written(featured(findings, words).select(*FEATURES, "label"))
    dealt = rows.repartition(8, F.xxhash64(*FEATURES)).sortWithinPartitions(*FEATURES, "label")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    scanner = Scanner(Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(dealt), words)
    dropped(findings.sparkSession, rows)
    return scanner


def scored(findings: DataFrame, scanner: Scanner) -> DataFrame:
    """Findings with their features and the forest's probability."""
    return scanner.model.transform(featured(findings, scanner.words)).withColumn("probability", vector_to_array("probability")[1])


def quality(findings: DataFrame, scanner: Scanner, *, threshold: float = THRESHOLD) -> tuple[float, float]:
    """Precision and recall over labelled findings."""
    said, real = F.col("probability") >= threshold, F.col("label") == 1
    n = scored(findings, scanner).agg(F.count_if(said & real).alias("both"), F.count_if(said).alias("said"), F.count_if(real).alias("real")).first()
    return n["both"] / max(n["said"], 1), n["both"] / max(n["real"], 1)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, candidate, before, after): every candidate and the text beside it; start counts characters."""
    found, gaps = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.split("text", CANDIDATE, -1)
    rows = docs.filter(F.col("text").rlike(MAYBE)).select("doc_id", F.monotonically_increasing_id().alias("row"), found.alias("found"), gaps.alias("gaps"))
    n = F.size("found")
    # an outer explode: an inner one would look for the candidates once more, to leave out texts without any
    each = F.posexplode_outer(F.arrays_zip(F.col("found").alias("c"), F.slice("gaps", F.lit(1), n).alias("g"), F.slice("gaps", F.lit(2), n).alias("h"))).alias("i", "x")
    at = rows.select("doc_id", "row", each).filter("x is not null").select(
        "doc_id", "row", "i", F.col("x.c").alias("candidate"), F.right("x.g", F.lit(40)).alias("before"), F.left("x.h", F.lit(40)).alias("after"), (F.length("x.g") + F.length("x.c")).cast("long").alias("n")
    )
    ended = F.sum("n").over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return at.select("doc_id", (ended - F.length("candidate")).alias("start"), "candidate", "before", "after")


def secrets(docs: DataFrame, scanner: Scanner, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, rule, masked, sha256, probability): the candidates that the forest keeps."""
    rule = F.coalesce(*(F.when(F.col("value").rlike(f"^{p}"), F.lit(k)) for k, p in ISSUED.items()), F.when(F.col("candidate").rlike(f"^{ADDRESS}$"), F.lit("address")), F.when(F.col("assigned") == 1, F.lit("assigned")), F.lit("random"))
    return scored(candidates(docs), scanner).filter(F.col("probability") >= threshold).select(
        "doc_id", "start", F.length("candidate").cast("long").alias("length"), rule.alias("rule"), F.concat(F.left("value", F.lit(4)), F.lit("***")).alias("masked"),
        F.sha2("value", 256).alias("sha256"), F.round("probability", 6).alias("probability"),
    )
