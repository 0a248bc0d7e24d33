"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents become pieces of at most `length` tokens, the pieces are dealt at random to blocks of some `a_block` pieces, and every block
packs its pieces by best-fit decreasing: longest first, each into
the open bin with the least room that still takes it, found in a segment tree over the remaining
capacities. Bins that stay open with more room than `slack` give their pieces back; these are packed once more, in blocks of their own, until they
fit in one block or most of them come back. So what stays empty doesn't grow with the number of blocks. Blocks are counted from the
written pieces, so few, very long documents are spread over blocks like many short ones; so are repeated rows.

Defined cases: a null text is an empty one, whose only token is the closing id. A very long text has as many pieces as it needs. Repeated rows are
packed as often as they occur. Of pieces of one length the smaller doc_id, then the earlier piece, goes first; of bins with the same room
the one that came to it last is filled. An empty table packs into no sequence. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import bound_batches, written

PIECES_A_BLOCK = 2_000
UNITS_KEPT = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, equal to those of `tokenizers`.

    In byte-level BPE a single space between two characters that aren't white space always begins a
    pre-token, so such a text is the concatenation of its space-led units, and a unit that was seen
    before isn't encoded again. The same vocabulary in `tiktoken` encodes new units (it is quicker
    for one short string); a text with other white space beside a space, or with the
    string of a special token, goes whole through `tokenizers`.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.unit = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def exact(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, unit: str) -> None:
        if len(self.young) >= UNITS_KEPT // 2:
            self.old, self.young = self.young, {}
        if unit in self.old:
            self.young[unit] = self.old[unit]
        elif not unit or unit[0].isspace() or unit[-1].isspace():
            self.young[unit] = None
        else:
            self.young[unit] = np.asarray(self.unit(" " + unit), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        first, *units = text.split(" ")
        if not first or first[0].isspace() or first[-1].isspace() or any(s in text for s in self.special):
            return self.exact(text)
        head = np.asarray(self.unit(first), "<u4").tobytes()
        while True:
            have = self.young
            try:
                return head + b"".join([have[u] for u in units])
            except KeyError:
                if len(set(units)) > UNITS_KEPT // 4:
                    return self.exact(text)
                for u in units:
                    if u not in self.young:
                        self._learn(u)
            except TypeError:
                return self.exact(text)


_encoders: dict[tuple, Encoder] = {}


def encoder(*paths: str) -> Encoder:
    """One for each worker process; the vocabulary is read once."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first can be shorter than `length`."""
    first = n % length or length
    return [(0, min(first, n)), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, *, tokenizer: str, ranks: str, pattern: str, length: int = 2048, end_id: int = 0, ids: bool = False) -> DataFrame:
    """A row per piece of each document, with its token ids too if asked for."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks, pattern)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = encode(text or "") + end
                    for i, (start, n) in enumerate(cut(len(raw) // 4, length)):
                        own = raw[4 * start : 4 * (start + n)]
                        rows.append((doc_id, i, start, n, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if ids else [])))
                cols = list(zip(*rows)) if rows else [[]] * (6 if ids else 5)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + (", ids array<int>" if ids else ""))


class Capacities:
    """A segment tree over remaining capacities 0..top: how many open bins have each."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need that an open bin has, or -1."""
        tree, i = self.tree, need + self.size
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:  # everything right of this path has more room
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece, by best-fit decreasing."""
    open_, bins = Capacities(length), [[] for _ in range(length + 1)]
    where, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = open_.tightest(need)
        if room < 0:
            room, b, n = length, n, n + 1
        else:
            b = bins[room].pop()
            open_.add(room, -1)
        where[i], offset[i] = b, length - room
        if room > need:
            bins[room - need].append(b)
            open_.add(room - need, 1)
    return where, offset


def best_fit_pack(pieces_: DataFrame, *, length: int = 2048, a_block: int = PIECES_A_BLOCK, slack: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (length between 1 and `length`). slack: an eighth of the length by default."""
    spark = pieces_.sparkSession
    room = length // 8 if slack is None else slack
    names = [f.name for f in pieces_.schema.fields]
    schema = pieces_.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint,_open:boolean"
    todo, done, used, before = written(pieces_), None, 0, None
    while True:
        n = todo.count()
        blocks = max(1, round(n / a_block))
        again = blocks > 1 and (before is None or n <= before / 2)  # bins left open are packed once more
        packed = _packed(todo, names, schema, length, blocks, used, room if again else length)
        used += blocks * (n + 1)
        if again:
            packed = written(packed)
        closed = packed.filter("not _open").drop("_open")
        done = closed if done is None else done.unionByName(closed)
        if not again:
            return done
        todo, before = packed.filter("_open").select(*names), n


def _packed(todo: DataFrame, names: list[str], schema: str, length: int, blocks: int, used: int, room: int) -> DataFrame:
    """One pass over blocks; _open marks the pieces of bins that have more than `room` left."""
    tasks = max(int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, 20_000) // 4)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit(pdf["length"].to_numpy(), length)
        left = length - np.bincount(where, weights=pdf["length"].to_numpy())
        return pdf.assign(sequence_id=used + where * blocks + pdf["_block"], offset=offset, _open=left[where] > room)[[*names, "sequence_id", "offset", "_open"]]

    # the pieces are a written table, so the numbers of its rows are the same whenever a lost task is run again
    dealt = todo.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)))
    return dealt.repartition(tasks, "_block").groupBy("_block").applyInPandas(pack, schema)
