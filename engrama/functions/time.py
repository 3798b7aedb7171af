"""Times as Unix milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how dialogue exports write a time, in UTC.
STAMP = "MMM dd, yyyy, HH:mm:ss"


def stamp_to_ms(stamp: Column, pattern: str = STAMP) -> Column:
    """Null for what does not parse. The session's time zone has to be UTC."""
    return F.unix_millis(F.try_to_timestamp(stamp, F.lit(pattern)))
