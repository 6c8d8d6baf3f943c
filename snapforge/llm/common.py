"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapforge.session import SHUFFLE_KEY, keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words between white space, for the functions of the JVM.
WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 4 << 20  # of a batch that are made Python objects at once


def quoted(name: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, names: list[str]) -> list[str]:
    """Columns of ``df`` that none of ``names`` replaces; names differ in more than their case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def fold(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part``; false for a null id."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % parts
    return F.coalesce(rest == part, F.lit(False))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SHUFFLE_KEY))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema, timestamp_utc=True)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``PIECE_BYTES``, so that no more of it at a time becomes Python objects."""
    step = max(1, int(batch.num_rows * PIECE_BYTES / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def with_computed(df: DataFrame, factory: Callable[[], Callable], ddl: str, source: str = "text") -> DataFrame:
    """``df`` and new columns computed from the column ``source``, some rows of a batch at a time.

    ``factory`` makes one function per task; that gets an Arrow column and returns one Arrow array
    per field of ``ddl``. A column of ``df`` with the name of a new one is replaced.
    """
    new = T.StructType.fromDDL(ddl)
    rest = others(df, new.fieldNames())
    at = rest.index(source) if source in rest else -1
    picked = df.select(*map(quoted, rest), *([] if at >= 0 else [quoted(source).alias("_source")]))
    schema = T.StructType([df.schema[c] for c in rest] + new.fields)
    types = [f.type for f in arrow_schema(new)]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        for batch in batches:
            for piece in pieces(batch):
                made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(compute(piece.column(at)), types)]
                columns = piece.columns if at >= 0 else piece.columns[:-1]
                yield pa.RecordBatch.from_arrays(columns + made, names=names)

    # Names by number on the way in: mapInArrow looks its columns up by names, in which dots have a meaning.
    return picked.toDF(*[f"c{i}" for i in range(len(picked.columns))]).mapInArrow(run, schema)


def planes(values: np.ndarray) -> bytes:
    """Bytes of an integer array, all first bytes first: slowly changing bytes stand together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def forest(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest node of each node's component under the edges u-v; ``labels`` of earlier edges go on."""
    lab = np.arange(n) if labels is None else labels
    while len(u):
        a, b = lab[u], lab[v]
        open_ = a != b
        if not open_.any():
            break
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab


def deal(df: DataFrame, keys: list[str], size: int, code: str, halves: bool = False) -> DataFrame:
    """Cut groups into blocks of about ``size`` rows and send each row to the block pairs it is part of.

    ``df`` has the boolean column ``member``; all rows of a group are queries, the members are also
    what queries are compared with. Adds ``_a``, ``_b`` (the pair: block of members, block of
    queries), ``is_member`` and ``is_query`` (the row's part in this pair). ``halves``: all rows are
    members and each unordered pair of blocks comes once. ``code`` is a column that spreads rows.
    A group of usual size is one pair, so its rows are sent once.
    """
    counts = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_q"), F.sum(F.col("member").cast("long")).alias("_m"))
        .filter(F.col("_q") > size)
    )
    spread = F.abs(F.xxhash64(F.col(code), F.lit(7)) % 1_000_003)
    cut = (
        df.join(keep(counts, "blocks"), keys, "left")
        .withColumn("_na", F.ceil(F.coalesce("_m", F.lit(1)) / size).cast("int"))
        .withColumn("_na", F.greatest("_na", F.lit(1)))
        .withColumn("_nb", F.ceil(F.coalesce("_q", F.lit(1)) / size).cast("int"))
    )
    if halves:
        cut = cut.withColumn("_x", (spread % F.col("_na")).cast("int"))
        cut = cut.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)))
        return cut.select(
            *df.columns,
            F.least("_x", "_t").alias("_a"), F.greatest("_x", "_t").alias("_b"),
            (F.col("_x") <= F.col("_t")).alias("is_member"), (F.col("_x") >= F.col("_t")).alias("is_query"),
        )
    cut = cut.withColumn("_x", (spread % F.col("_na")).cast("int")).withColumn("_y", (spread % F.col("_nb")).cast("int"))
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    as_member = F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), lambda t: pair(F.col("_x"), t))
    as_query = F.transform(F.sequence(F.lit(0), F.col("_na") - 1), lambda t: pair(t, F.col("_y")))
    both = F.when(F.col("member"), F.array_union(as_member, as_query)).otherwise(as_query)
    cut = cut.withColumn("_p", F.explode(both))
    return cut.select(
        *df.columns,
        F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"),
        (F.col("member") & (F.col("_p.a") == F.col("_x"))).alias("is_member"),
        (F.col("_p.b") == F.col("_y")).alias("is_query"),
    )
