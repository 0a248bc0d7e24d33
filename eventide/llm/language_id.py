"""Language by compression: the dictionary that makes a text smallest names its language.

For every language a zstandard raw-content dictionary is filled with training texts. A text is
lower-cased, what isn't a letter becomes one space, and its blocks of `block` bytes are encoded with
each dictionary; blocks are short so that the dictionary, and not the text's own beginning, decides. The
smallest total wins; where the second is larger by less than `margin` of the smallest, `rejected` says that the margin is narrow,
and lang_pred still names the smallest.

The dictionaries are fitted on a bounded sample: for each language one document of up to 20,000
characters for each of `sample` buckets of the id (those of 1,000 or more first, then by hash), a whole
text, or where a bucket has longer documents only, the first 20,000 characters of one; then such pieces of the other buckets too, until `size` bytes are full. Every language of the training rows has a dictionary, and what is read at once is one language's sample.

Defined cases: a null text, and one without a letter, is `und` with score 0. Without training rows
every text is `und`, and with one language every text with a letter is that one, with the score of a margin of 1. Ties go to the language that sorts first, with
score 0, and are rejected. Very long texts are encoded whole, block by block. Repeated rows are each predicted.
Extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import bound_batches, held_out, text_slices

UNKNOWN = "und"
LONGEST = 20_000
MARGIN = 0.02


def letters(col: pa.Array) -> pa.Array:
    """The text's letters, lower-cased, with single spaces for all else."""
    low = pc.utf8_lower(pc.fill_null(col, ""))
    return pc.utf8_trim(pc.replace_substring_regex(low, r"[^\p{L}]+", " "), " ")


def fit(docs: DataFrame, *, size: int = 32 << 10, sample: int = 64) -> dict[str, bytes]:
    """A dictionary's bytes for each language, from the rows that aren't held out."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    h = F.xxhash64(F.col("doc_id").cast("long"))
    short = F.length("text") <= LONGEST
    first = F.when(short, F.struct(-F.least(F.length("text"), F.lit(1000)), h))
    piece = F.when(~short, h)
    picked = (
        train.groupBy("lang", F.pmod(h, F.lit(sample)).alias("bucket"))
        .agg(F.min_by(F.when(short, F.col("text")), first).alias("text"), F.min_by(F.when(~short, F.left("text", F.lit(LONGEST))), piece).alias("piece"))
    )
    out: dict[str, bytes] = {}
    for lang, group in itertools.groupby(picked.sort("lang", "bucket").toLocalIterator(), lambda r: r["lang"]):
        rows = list(group)  # at most `sample`
        # of each bucket a whole document, or else a piece; then, if there is room, the pieces of the others
        taken = [r["text"] if r["text"] is not None else r["piece"] for r in rows] + [r["piece"] for r in rows if r["text"] is not None and r["piece"] is not None]
        book = b""
        for t in taken:
            if len(book) >= size:
                break
            book += letters(pa.array([t]))[0].as_py().encode() + b" "
        out[lang] = book[:size]
    return out


class Coders:
    """A compressor for each language, with settings that search the dictionary and not only hash it."""

    def __init__(self, dictionaries: dict[str, bytes], block: int):
        import zstandard as z

        self.block, self.names = block, sorted(dictionaries)
        how = z.ZstdCompressionParameters(
            write_content_size=False, write_checksum=False, write_dict_id=False,
            strategy=z.STRATEGY_GREEDY, window_log=18, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=8,
        )
        self.encode = []
        for lang in self.names:
            own = z.ZstdCompressionDict(dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=how)
            self.encode.append(z.ZstdCompressor(dict_data=own, compression_params=how).compress)

    def sizes(self, text: str) -> list[int]:
        raw = text.encode()
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        return [sum([len(f(b)) for b in blocks]) for f in self.encode]


_coders: dict[tuple, Coders] = {}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, block: int = 400, margin: float = MARGIN) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): score is 0 to 1 and grows with the margin."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (block, *sorted(dictionaries.items()))
        if key not in _coders:
            _coders.clear()
            _coders[key] = Coders(dictionaries, block)
        coders = _coders[key]
        for batch in batches:
            for at, n in text_slices(batch.column(2)):
                part = batch.slice(at, n)
                lang, score, narrow = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
                for i, text in enumerate(letters(part.column(2)).to_pylist()):
                    if text and coders.names:
                        sizes = coders.sizes(text)
                        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
                        lead = sizes[order[1]] / sizes[order[0]] - 1 if len(order) > 1 else 1.0
                        lang[i], score[i], narrow[i] = coders.names[order[0]], 1 - np.exp(-8 * lead), lead < margin
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score), pa.array(narrow)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
