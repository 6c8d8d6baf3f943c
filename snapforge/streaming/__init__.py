"""Operators that also work on a streaming DataFrame.

They are stateless column expressions or filters, so they need no watermark and no state. All
other operators aggregate, sort or look at a whole table and are for batch use.
"""

from snapforge.operators.integrity import check_violations, length_violations, null_rows
from snapforge.operators.masking import mask_table

STREAM_SAFE = (mask_table, check_violations, length_violations, null_rows)

__all__ = ["STREAM_SAFE", "check_violations", "length_violations", "mask_table", "null_rows"]
