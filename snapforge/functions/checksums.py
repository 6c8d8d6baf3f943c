"""Lower-case hex digests of binary or text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checksum_md5(content: Column) -> Column:
    return F.md5(content)


def checksum_sha256(content: Column) -> Column:
    return F.sha2(content, 256)
