"""Whole-table JSON documents of any length, read by many tasks.

A document of the interchange form is cut into chunks of bytes. What a chunk needs to know of the text before it is
whether it starts inside a string, and how deep. Counts of quotes and brackets per chunk, added up over the chunks of a
file, tell both, so every chunk can be read alone: it hands on the table rows that begin in it. The rest of the
document, with the rows left out, is short; it is put together once per file and says which page a row belongs to.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapforge.session import MAX_PARTITIONS, keep
from snapforge.sources.files import list_files, open_file

CHUNK = 16 << 20
# Depth of the keys of rows: document, list of pages, page, map of rows.
_ROWS = 4
_AHEAD = 1 << 20
_CELLS = "map<string, array<string>>"
_PIECE = 1 << 18  # bytes of rows that make one text
_LINES = 4 << 20  # bytes of rows that leave a task at once


class Scan(NamedTuple):
    """Brackets outside of strings (place, 1 or -1, depth behind) and quotes that open or close a string."""

    brackets: np.ndarray
    steps: np.ndarray
    depth: np.ndarray
    quotes: np.ndarray


def _plain_quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that no backslash escapes; ``escaped``: one before the data escapes the first byte."""
    quotes = np.flatnonzero(data == 34)
    slashes = np.flatnonzero(data == 92)
    if not len(slashes) and not escaped:
        return quotes
    first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    starts, lengths = slashes[first], np.diff(first, append=len(slashes))
    # An escaped first byte that is a backslash escapes nothing itself.
    lengths = lengths - ((starts == 0) & escaped)
    hidden = (starts + np.diff(first, append=len(slashes)))[lengths % 2 == 1]
    if escaped:
        hidden = np.append(hidden, 0)
    return quotes[~np.isin(quotes, hidden)]


def scan(data: np.ndarray, escaped: bool, in_string: bool, depth: int) -> Scan:
    quotes = _plain_quotes(data, escaped)
    brackets = np.flatnonzero((data | 32 == 123) | (data | 32 == 125))  # [ ] are { } without one bit
    brackets = brackets[(np.searchsorted(quotes, brackets) + in_string) % 2 == 0]
    steps = np.where(data[brackets] | 32 == 123, 1, -1)
    return Scan(brackets, steps, depth + np.cumsum(steps), quotes)


def _read(f, at: int, size: int) -> bytes:
    f.seek(at)
    return f.read(size)


def _escaped(f, at: int) -> bool:
    """Whether an odd number of backslashes stands before ``at``."""
    run, step = 0, 64
    while at - run > 0:
        low = max(0, at - run - step)
        data = _read(f, low, at - run - low)
        kept = data.rstrip(b"\\")
        run += len(data) - len(kept)
        if kept:
            break
        step *= 2
    return run % 2 == 1


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk the quotes, and the change of depth if it starts outside or inside a string."""
    for frame in frames:
        found = []
        for r in frame.itertuples():
            with open_file(r.path) as f:
                data = np.frombuffer(_read(f, r.start, r.size), np.uint8)
                escaped = _escaped(f, r.start)
            outside, inside = (scan(data, escaped, s, 0) for s in (False, True))
            found.append((len(outside.quotes), int(outside.steps.sum()), int(inside.steps.sum())))
        yield frame.assign(**dict(zip(("quotes", "deeper_out", "deeper_in"), np.array(found, np.int64).reshape(-1, 3).T)))


def _chunks(spark: SparkSession, path: str, chunk: int) -> DataFrame:
    """``path``, ``chunk``, ``start``, ``size``, ``in_string``, ``depth`` of all chunks of all files below ``path``."""
    files = list_files(spark, path).filter("length > 0")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / chunk)))
    parts = files.select("path", "length", cut.alias("chunk")).select(
        "path", "chunk", (F.col("chunk") * chunk).alias("start"), F.least(F.lit(chunk), F.col("length") - F.col("chunk") * chunk).cast("long").alias("size")
    )
    n = max(1, min(MAX_PARTITIONS, parts.count()))
    schema = "path string, chunk long, start long, size long, quotes long, deeper_out long, deeper_in long"
    counted = keep(parts.repartition(n).mapInPandas(_counts, schema), "chunks")
    # Windows over one row per chunk of a file.
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    deeper = F.when(F.col("in_string"), F.col("deeper_in")).otherwise(F.col("deeper_out"))
    known = counted.withColumn("in_string", inside).withColumn("depth", F.coalesce(F.sum(deeper).over(before), F.lit(0)))
    return keep(known.select("path", "chunk", "start", "size", "in_string", "depth"), "chunks").repartition(n)


def _skeleton(data: bytes, at: int, found: Scan, depth: int) -> tuple[bytes, int | None]:
    """The text above the rows; what opens a container of rows is followed by its own place in the file.

    Also the last such place in the chunk.
    """
    out, opened = [], None
    depths = np.concatenate([[depth], found.depth])
    ends = np.append(found.brackets, len(data))
    starts = np.concatenate([[0], found.brackets + 1])
    for j in np.flatnonzero((depths < _ROWS) | (np.append(depths[1:], _ROWS) < _ROWS)).tolist():
        if depths[j] < _ROWS:
            out.append(data[starts[j] : ends[j]])
        if j < len(found.brackets):
            place = int(ends[j])
            out.append(data[place : place + 1])
            if depths[j] == _ROWS - 1 and found.steps[j] > 0:
                opened = at + place
                out.append(b'"@":%d' % opened if data[place] == 123 else b"%d" % opened)
    return b"".join(out), opened


def _skeletons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        made = []
        for r in frame.itertuples():
            with open_file(r.path) as f:
                data = _read(f, r.start, r.size)
                found = scan(np.frombuffer(data, np.uint8), _escaped(f, r.start), r.in_string, r.depth)
            made.append(_skeleton(data, r.start, found, r.depth))
        pieces, opened = zip(*made) if made else ((), ())
        yield pd.DataFrame({"path": frame["path"], "chunk": frame["chunk"], "piece": pieces, "opened": pd.array(opened, "Int64")})


def _documents(text: bytes) -> Iterator[dict]:
    decoder, at, whole = json.JSONDecoder(), 0, text.decode("utf-8-sig")
    while at < len(whole):
        if whole[at].isspace():
            at += 1
            continue
        document, at = decoder.raw_decode(whole, at)
        yield document


def _pages(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One row per page of the documents in a file; ``opened`` is where its rows begin, null if it has no map of rows."""
    out = []
    for doc in _documents(b"".join(rows.sort_values("chunk")["piece"])):
        facts = [doc.get(c) for c in ("tableName", "pageSize", "totalPages", "totalRecords")]
        pages = doc.get("dataPages") or [{}]
        for page in pages:
            data = page.get("data")
            opened = data.get("@") if isinstance(data, dict) else None
            out.append((key[0], *facts, page.get("pageNum"), opened))
    names = ["path", "tableName", "pageSize", "totalPages", "totalRecords", "page_num", "opened"]
    return pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names[2:]})


def _rows_of(r) -> Iterator[tuple[int | None, str]]:
    """(place of the map if it opens in the chunk, text of some keys and their cells) of the rows that begin in a chunk."""
    with open_file(r.path) as f:
        escaped, ahead = _escaped(f, r.start), 0
        while True:
            data = _read(f, r.start, r.size + ahead)
            found = scan(np.frombuffer(data, np.uint8), escaped, r.in_string, r.depth)
            depths = np.concatenate([[r.depth], found.depth])
            opens = found.quotes[int(r.in_string) :: 2]  # every second quote opens a string
            keys = opens[depths[np.searchsorted(found.brackets, opens)] == _ROWS]
            closes = found.brackets[(found.steps < 0) & (found.depth == _ROWS - 1)]
            own = int(np.searchsorted(keys, r.size))
            borders = np.sort(np.concatenate([keys, closes]))
            ends = np.searchsorted(borders, keys[:own], side="right")
            # The last row ends at the next key or at the end of the map; further text is read until that is there.
            if not own or ends[-1] < len(borders):
                break
            if len(data) < r.size + ahead:
                raise ValueError(f"{r.path} ends inside a row")
            ahead = max(_AHEAD, 2 * ahead)
    if not own:
        return
    openings = found.brackets[(found.steps > 0) & (found.depth == _ROWS)]
    keys, owner = keys[:own], np.searchsorted(openings, keys[:own]) - 1
    # Neighbours of one map go on together: what stands between them is a comma, as in a map.
    cuts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(keys // _PIECE) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), own]):
        text = data[int(keys[a]) : int(borders[ends[b - 1]])].rstrip().rstrip(b",")
        yield (r.start + int(openings[owner[a]]) if owner[a] >= 0 else None), text.decode()


def _row_batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            opened, texts, size = [], [], 0
            for o, text in _rows_of(r):
                opened.append(o)
                texts.append("{" + text + "}")
                size += len(text)
                if size > _LINES:
                    yield pd.DataFrame({"path": r.path, "chunk": r.chunk, "opened": pd.array(opened, "Int64"), "rows": texts})
                    opened, texts, size = [], [], 0
            if texts:
                yield pd.DataFrame({"path": r.path, "chunk": r.chunk, "opened": pd.array(opened, "Int64"), "rows": texts})


def _page_list(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages of all files, and per chunk the container that its first rows belong to."""
    pieces = keep(chunks.mapInPandas(_skeletons, "path string, chunk long, piece binary, opened long"), "skeleton")
    schema = "path string, tableName string, pageSize long, totalPages long, totalRecords long, page_num long, opened long"
    pages = keep(pieces.groupBy("path").applyInPandas(_pages, schema), "pages")
    earlier = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("path", "chunk", F.last("opened", ignorenulls=True).over(earlier).alias("carried"))
    return pages, carried


def read_document_pages(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of whole-table documents: table, page_num, row_key, cells.

    All files below ``path`` are read (one document each, or several one after the other), in chunks of ``chunk`` bytes
    that are read alone, so one document of any length fills as many tasks as it has chunks. A task holds one chunk,
    and behind it as much as its last row goes on. Properties may come in any order, and unknown ones are passed over.
    Text that is not JSON, or that ends too early, is an error. Two small tables are written when this is called.
    """
    chunks = _chunks(spark, path, chunk)
    pages, carried = _page_list(chunks)
    rows = chunks.mapInPandas(_row_batches, "path string, chunk long, opened long, rows string")
    placed = rows.join(carried, ["path", "chunk"], "left").withColumn("opened", F.coalesce("opened", "carried"))
    named = pages.filter("opened is not null").select("path", "opened", F.col("tableName").alias("table"), "page_num")
    found = placed.join(named, ["path", "opened"])
    return found.select("table", "page_num", F.explode(F.from_json("rows", _CELLS, {"mode": "FAILFAST"})).alias("row_key", "cells"))


def read_document_totals(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """tableName, pageSize, totalPages, totalRecords as recorded in whole-table documents."""
    pages, _ = _page_list(_chunks(spark, path, chunk))
    return pages.select("tableName", "pageSize", "totalPages", "totalRecords").distinct()
