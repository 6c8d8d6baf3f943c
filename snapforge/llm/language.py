"""Language identification by compression: the language whose dictionary makes the text smallest.

Each language has a zstandard raw-content dictionary, made of training text. A text is encoded whole
with each dictionary; the smallest code wins, and a narrow margin is marked as a rejection.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.llm.common import fold, text_bytes, with_computed
from snapforge.session import keep

DICT_BYTES = 96 << 10  # of each language
SAMPLE_DOCS = 400  # training texts of a language that the dictionary may take from
SPANS = 2  # pieces of a long training text
LEVEL = 3
MARGIN = 0.01  # of the second smallest code; below, the language counts as not sure
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def dictionaries(training: DataFrame, size: int = DICT_BYTES, sample: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Dictionary of each language of ``training`` (text, lang); null langs and texts teach nothing.

    Takes spans from all over ``sample`` texts per language, drawn by a hash of the text; both bounds
    are part of the fit, and what comes to the driver is at most four bytes for each of ``size`` a
    language. Exact copies of a text count once.
    """
    share = max(64, size // sample)
    hashed = (
        training.filter("lang is not null and text is not null and length(trim(text)) > 0")
        .select("lang", F.xxhash64("text", F.lit(3)).alias("h"), F.lower("text").alias("text"))
    )
    drawn = Window.partitionBy("lang").orderBy("h")
    chosen = hashed.select("lang", "h").distinct().withColumn("_n", F.row_number().over(drawn)).filter(F.col("_n") <= sample)
    chosen = chosen.withColumn("_of", F.count("*").over(Window.partitionBy("lang")))
    # At most ``sample`` rows a language.
    rows = (
        hashed.join(F.broadcast(keep(chosen, "drawn")), ["lang", "h"])
        .withColumn("text", _spans(F.col("text"), F.col("h"), F.greatest(F.lit(share), F.floor(F.lit(size) / F.col("_of")))))
        .groupBy("lang", "_n").agg(F.min("text").alias("text"))
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_n", "text"))).alias("texts"))
    )
    found = {}
    for lang, texts in rows.collect():
        parts = [t.text.encode() for t in texts]
        most, left, taken = size - len(parts), len(parts), []
        # What short texts leave goes to the longer ones.
        for i in sorted(range(len(parts)), key=lambda i: (len(parts[i]), i)):
            each = max(0, most // left)
            taken.append((i, _cut(parts[i], each)))
            most, left = most - len(taken[-1][1]), left - 1
        found[lang] = b"\n".join(p for _, p in sorted(taken))[-size:]
    return dict(sorted(found.items()))


def _spans(text: Column, h: Column, chars: Column) -> Column:
    """All of a text of ``chars`` characters, or ``SPANS`` pieces of it, each from a place of its own stretch."""
    piece, stretch = F.floor(chars / SPANS), F.floor(F.length(text) / SPANS)
    pieces = [
        F.substring(text, (stretch * k + 1 + F.pmod(F.xxhash64(h, F.lit(k)), F.greatest(F.lit(1), stretch - piece + 1))).cast("int"), piece.cast("int"))
        for k in range(SPANS)
    ]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n", *pieces))


def _cut(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes, the same share of every span."""
    if len(data) <= most:
        return data
    spans = data.split(b"\n") if data.count(b"\n") == SPANS - 1 else [data[i * len(data) // SPANS : (i + 1) * len(data) // SPANS] for i in range(SPANS)]
    each = max(0, (most - SPANS + 1) // SPANS)
    return b"\n".join(s[:each] for s in spans)


def _sizes(compressors: list, data: bytes) -> list[int]:
    return [len(c.compress(data)) for c in compressors]


def identify(docs: DataFrame, learned: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """``docs`` and ``lang_pred``, ``score``, ``rejected`` from each whole text.

    lang_pred is a learned language, or "und" (score 0, not rejected) for a null text, a text without
    a letter, or when nothing was learned. Equal sizes go to the first name. score rises from 0.5 with
    the margin between the two smallest codes; with one language it is 1.
    """
    langs = list(learned)
    # Bounded by the number of languages times the size of a dictionary.
    shipped = docs.sparkSession.sparkContext.broadcast([learned[x] for x in langs])

    def factory():
        compressors = []
        for data in shipped.value:
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            compressors.append(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False))

        def one(data: bytes):
            text = data.decode()
            if not langs or not _LETTER.search(text):
                return UNKNOWN, 0.0, False
            data = text.lower().encode()
            sizes = _sizes(compressors, data)
            order = sorted(range(len(langs)), key=lambda i: (sizes[i], i))
            if len(langs) == 1:
                return langs[0], 1.0, False
            best, second = sizes[order[0]], sizes[order[1]]
            gain = (second - best) / second
            return langs[order[0]], 1 / (1 + math.exp(-60 * gain)), gain < margin

        def compute(column: pa.Array):
            rows = [one(x) for x in text_bytes(column)]
            return list(zip(*rows)) if rows else [[], [], []]

        return compute

    return with_computed(docs, factory, "lang_pred string, score double, rejected boolean")


def train_and_identify(docs: DataFrame) -> DataFrame:
    """``docs`` and ``held_out``, ``lang_pred``, ``score``, ``rejected``; learns from rows that are not held out."""
    marked = docs.withColumn("held_out", fold(F.col("doc_id"), 4, 2))
    learned = dictionaries(marked.filter(~F.col("held_out")).select("text", "lang"))
    return identify(marked.select("doc_id", "text", "held_out"), learned)
