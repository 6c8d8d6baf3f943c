"""Table snapshots, masking, integrity checks and schema evolution on Spark DataFrames."""

from snapforge.catalog import Catalog, Column, ForeignKey
from snapforge.session import build_session, keep, release_scratch, scratch_path

__all__ = [
    "Catalog",
    "Column",
    "ForeignKey",
    "build_session",
    "keep",
    "release_scratch",
    "scratch_path",
]
