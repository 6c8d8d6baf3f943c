"""Mask expressions. All are built-in functions, so they stay inside code generation.

Null stays null and other types are masked from their text form; the result is always text.
An empty result is not a valid mask: a length below one is an error, and so is an empty text
under ``mask_original`` unless ``on_empty='keep'``.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: longest random mask.
RANDOM_LIMIT = 100


def _bounded(limit: int, max_length: int | None) -> int:
    length = limit if max_length is None else min(limit, max_length)
    if length < 1:
        raise ValueError(f"invalid mask length {length}")
    return length


def mask_fixed(col: Column, ch: str, length: int, max_length: int | None = None) -> Column:
    """``ch`` repeated min(length, max_length) times."""
    return F.when(col.isNotNull(), F.lit(ch * _bounded(length, max_length)))


def mask_original(col: Column, ch: str, on_empty: str = "error") -> Column:
    """``ch`` repeated once per character of the value."""
    if on_empty not in ("error", "keep"):
        raise ValueError("on_empty must be 'error' or 'keep'")
    text = col.cast("string")
    masked = F.repeat(F.lit(ch), F.length(text))
    if on_empty == "error":
        masked = F.when(text == "", F.raise_error(F.lit("invalid mask length 0"))).otherwise(masked)
    return F.when(col.isNotNull(), masked)


def mask_random(
    col: Column,
    ch: str,
    max_length: int | None = None,
    row_key: list[Column] | None = None,
    seed: int = 0,
    salt: str = "",
) -> Column:
    """``ch`` repeated a random number of times, uniform in 1..min(100, max_length).

    With ``row_key`` the length is a hash of seed, salt and key, so a retried task gives the same
    mask. The masked value itself never enters the hash: equal values must not get equal masks.
    """
    limit = _bounded(RANDOM_LIMIT, max_length)
    if row_key:
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *row_key), F.lit(limit))
    else:
        # The salt tells columns apart, so the masks of one row don't share a length.
        draw = F.floor(F.rand(seed + zlib.crc32(salt.encode())) * limit)
    return F.when(col.isNotNull(), F.repeat(F.lit(ch), (draw + 1).cast("int")))
