"""White space as texts in recordings have it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space, the four separators of ASCII included.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """A text without white space at its ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))
