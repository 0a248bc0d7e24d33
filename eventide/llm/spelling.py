"""Spelling variants by finite-state composition: words one edit apart, grouped under their commonest near word.

The words of a partition make a minimised acceptor. Composing it with the one-edit transducer and with itself accepts the pairs of words one
edit apart: before the edit both sides read the same letters, after it a pair of states reads what both accept, and those common
endings are kept for each pair of states, of which a minimised acceptor has few. A replacement is composed within the words
of one length, a deletion between the words of one length and those one longer.

No task sees the whole vocabulary: the initial states are dealt out. A pair whose shorter word has n letters agrees in the first n // 2 letters, or
else in the last n - n // 2, so a partition starts in the state after such a beginning (or, read from the other side, before such an
ending), and each pair belongs to exactly one partition. A partition of more than `most` words is dealt again by halves of what is left of its words, until
it is small or one letter is left (8,190 words at most over 90 letters; other alphabets of k letters k + k * k), so no beginning is too common.
A task returns for each word how many near words it has in the partition, and the best one, not the pairs.

Defined cases: words are compared by code point. Null and empty words are near nothing and aren't returned; rows that repeat a word are one word, with the sum of their counts.
Ties of n go to the smaller word. An empty table gives an empty result. Words of any length are allowed. Other columns than word and n aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import bound_batches, dropped, spread_join, written
from eventide.llm.line_dedup import LOWER, UPPER

MOST = 10_000
LETTERS = "[A-Za-zÀ-ÿ]+"
KEY = ["length", "head", "tail", "below"]


class Acceptor:
    """A minimised acyclic automaton; states are numbers, equal languages have one state."""

    def __init__(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._common: dict[tuple[int, int], list] = {}

    def _state(self, final: bool, moves: dict[str, int]) -> int:
        key = (final, *moves.items())
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.moves)
            self.moves.append(moves)
            self.final.append(final)
        return at

    def add(self, words: list[str]) -> int:
        """The initial state for a sorted list of distinct words."""
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]  # the states of the last word that may still grow
        last = ""
        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and last[same] == word[same]:
                same += 1
            for k in range(len(last), same, -1):
                path[k - 1][1][last[k - 1]] = self._state(*path.pop())
            path.extend((False, {}) for _ in range(len(word) - same))
            path[-1] = (True, path[-1][1])
            last = word
        for k in range(len(last), 0, -1):
            path[k - 1][1][last[k - 1]] = self._state(*path.pop())
        return self._state(*path[0])

    def common(self, p: int, q: int) -> list:
        """The endings that both states accept, each as a chain (letter, rest) that ends in ()."""
        known = self._common
        if (p, q) in known:
            return known[p, q]
        todo = [(p, q)]
        while todo:
            pair = todo[-1]
            if pair in known:
                todo.pop()
                continue
            a, b = self.moves[pair[0]], self.moves[pair[1]]
            steps = [(c, (x, b[c])) for c, x in a.items() if c in b]
            missing = [s for _, s in steps if s not in known]
            if missing:
                todo += missing
                continue
            out: list = [()] if self.final[pair[0]] and self.final[pair[1]] else []
            for c, s in steps:
                out += [(c, rest) for rest in known[s]]
            known[pair] = out
            todo.pop()
        return known[p, q]


def chained(rest: tuple) -> str:
    out = []
    while rest:
        out.append(rest[0])
        rest = rest[1]
    return "".join(out)


def near_pairs(short: list[str], long: list[str]) -> Iterator[tuple[str, str]]:
    """The pairs of words one edit apart: two of `short` (all of one length), or one of it and one of `long` (one letter longer). Both are sorted and distinct."""
    machine = Acceptor()
    p = machine.add(short)
    moves, common = machine.moves, machine.common
    if len(short) > 1:
        todo = [(p, "")] if short[0] else []
        while todo:
            state, seen = todo.pop()
            steps = list(moves[state].items())
            for i, (c, x) in enumerate(steps):
                for d, y in steps[i + 1 :]:
                    for rest in common(x, y):
                        end = chained(rest)
                        yield seen + c + end, seen + d + end
                if moves[x]:
                    todo.append((x, seen + c))
    if long:
        q = machine.add(long)
        both = [(q, p, "")]
        while both:
            state, other, seen = both.pop()
            beside = moves[other]
            for c, x in moves[state].items():
                for rest in common(x, other):
                    if not rest or rest[0] != c:  # of a run of equal letters the last one goes
                        end = chained(rest)
                        yield seen + end, seen + c + end
                if c in beside:
                    both.append((x, beside[c], seen + c))


def _partition(length: int, head: str, tail: str, below: int, words: list[str], counts: list[int], out: dict[str, list]) -> None:
    """Adds to out, by column, the near words that the words of one partition have in it."""
    n = dict(zip(words, counts))
    a, b = len(head), len(tail)
    middles = sorted(w[a : len(w) - b] for w in n)
    short, long = ([m for m in middles if len(m) == k] for k in (length - a - b, length - a - b + 1))
    found: dict[str, tuple[int, int, str]] = {}
    for x, y in near_pairs(short, long):
        u, v = head + x + tail, head + y + tail
        if below >= 0 and u[:below] == v[:below]:
            continue  # the partition of their common beginning has this pair
        for w, other in ((u, v), (v, u)):
            many, m, best = found.get(w, (0, 0, ""))
            k = n[other]
            found[w] = (many + 1, k, other) if k > m or (k == m and other < best) else (many + 1, m, best)
    for w, (many, m, best) in found.items():
        for name, value in (("word", w), ("near", many), ("best_n", m), ("best", best)):
            out[name].append(value)


OUT = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with one key; the last run of a batch waits for the next."""
    key, words, counts = None, [], []
    out: dict[str, list] = {name: [] for name in OUT.names}

    def done() -> None:
        if len(words) > 1:
            _partition(*key, words, counts, out)

    for batch in batches:
        for *k, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                done()
                key, words, counts = k, [], []
            words.append(word)
            counts.append(n)
        if len(out["word"]) > 10_000:
            yield pa.RecordBatch.from_pydict(out, schema=OUT)
            out = {name: [] for name in OUT.names}
    done()
    yield pa.RecordBatch.from_pydict(out, schema=OUT)


def _key(length: Column, head: Column, tail: Column, below: Column) -> Column:
    """A word's place in the partition that starts after `head` letters and ends before `tail`."""
    word, size = F.col("word"), F.char_length("word")
    return F.struct(length.cast("int").alias("length"), F.substring(word, F.lit(1), head).alias("head"), F.substring(word, size - tail + 1, tail).alias("tail"), below.cast("int").alias("below"))


def near_words(words: DataFrame, *, most: int = MOST) -> DataFrame:
    """(word, near, best_n, best) of the words that have a near word: how many, and the commonest."""
    bound_batches(words.sparkSession)
    length = F.explode(F.array(F.char_length("word"), F.char_length("word") - 1))
    half = F.floor(F.col("_n") / 2).cast("int")
    none = F.lit(-1)
    sides = F.array(_key(F.col("_n"), half, F.lit(0), none), _key(F.col("_n"), F.lit(0), F.col("_n") - half, half))
    rows = words.select("word", "n", length.alias("_n")).filter("_n > 0").select("word", "n", F.explode(sides).alias("k")).select("k.*", "word", "n")
    found, tables = None, []
    while True:
        hot = written(rows.groupBy(*KEY).agg(F.count("*").alias("size")).filter((F.col("size") > most) & (F.col("length") - F.char_length("head") - F.char_length("tail") > 1)))
        tables.append(hot)
        again = not hot.isEmpty()
        small = rows.join(hot.select(*KEY), KEY, "left_anti") if again else rows
        deal = F.xxhash64(*KEY)
        sorted_rows = small.withColumn("_at", deal).repartition("_at").sortWithinPartitions("_at", *KEY).select(*KEY, "word", "n")
        part = sorted_rows.mapInArrow(_partitions, "word string, near long, best_n long, best string")
        found = part if found is None else found.unionByName(part)
        if not again:
            break
        # the middle is halved: the pairs that agree in its first half too, and the others, which agree in its second half
        a, b = F.char_length("head"), F.char_length("tail")
        cut = a + F.floor((F.col("length") - a - b) / 2).cast("int")
        halves = F.array(_key(F.col("length"), cut, b, F.col("below")), _key(F.col("length"), a, F.col("length") - cut, cut))
        rows = written(rows.join(hot.select(*KEY), KEY, "left_semi").select("word", "n", F.explode(halves).alias("k")).select("k.*", "word", "n"))
        tables.append(rows)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    out = written(found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("b")).select("word", "near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best")))
    for t in tables:
        dropped(words.sparkSession, t)
    return out


def spelling_groups(words: DataFrame, *, ratio: int = 2, most: int = MOST, hot_rows: int = 10_000) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its commonest near word if that is `ratio` times as common; its root is where forms lead."""
    if ratio < 2:
        raise ValueError("forms must be commoner than their words")
    words = written(words.filter("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(words, most=most)
    forms = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    known = written(words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), forms.alias("form"), F.when(forms.isNotNull(), F.col("best_n")).alias("form_n")))
    # every step doubles the way: a form is at least twice as common as its word, so a way has 63 steps at most
    way = written(known.filter("form is not null").select("word", F.col("form").alias("at")))
    while True:
        ends = way.select(F.col("word").alias("at"), F.col("at").alias("next"))
        counts = way.groupBy("at").agg(F.count("*").alias("n"))
        moved = written(spread_join(way, ends, ["at"], counts, total=way.count(), hot_rows=hot_rows).select("word", F.col("next").alias("at")))
        if moved.isEmpty():
            break
        way = written(moved.unionByName(way.join(moved.select("word"), "word", "left_anti")))
    out = known.join(way.withColumnRenamed("at", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def runs(text: Column) -> Column:
    """The maximal runs of letters of a text, A-Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))


def vocabulary(docs: DataFrame, *, min_chars: int = 5, min_count: int = 3, typos: int | None = None) -> DataFrame:
    """(word, n) of the documents' runs of letters that are long and common enough.

    With `typos`, a run h of whose hash with the document (crc32 of `<doc_id>:<run>`) it divides first loses letter h modulo its length. A null text has no
    words; a row without doc_id hashes as one whose id is empty text; rows that repeat a doc_id all count.
    """
    words = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("word")).filter(F.char_length("word") >= min_chars)
    if typos:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("_h") % F.char_length("word")).cast("int")
        less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.withColumn("_h", h).select(F.when(F.col("_h") % typos == 0, less).otherwise(F.col("word")).alias("word")).filter(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t FROM range(256) AS r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}')) AS w FROM documents)
  WHERE length(w) >= 5 GROUP BY doc_id, w
), bytes AS (
  SELECT w, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM runs
), hashed AS (
  SELECT w, n, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT w AS word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 5 GROUP BY 1 HAVING sum(n) >= 3
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), masked AS (
  SELECT word, n, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS k FROM places
), shorter AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM places
), links AS (
  SELECT a.word, b.word AS other, b.n FROM masked a JOIN masked b USING (k) WHERE a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.k = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.k = b.word
), best AS (
  SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near FROM links QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON walk.at = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT walk.word, walk.at AS root FROM walk JOIN forms f ON walk.at = f.word WHERE f.form IS NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON f.word = r.word
"""
