"""Text and vector column expressions (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pack-size units and colour words removed from product text.
PACK_UNITS = ["PK", "PACK", "SET", "PIECE", "PC", "CM", "MM", "G", "KG", "ML", "L"]
COLOUR_WORDS = ["RED", "BLUE", "GREEN", "YELLOW", "PINK", "BLACK", "WHITE", "GOLD",
                "SILVER", "CREAM", "GREY", "GRAY"]
PACK_PATTERN = r"\b\d+\s?(" + "|".join(PACK_UNITS) + r")\b"
COLOUR_PATTERN = r"\b(" + "|".join(COLOUR_WORDS) + r")\b"


def clean_description(col: Column | str) -> Column:
    """TX1: upper-case, drop pack sizes and colour words, collapse blanks."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.upper(strip_ws(c))
    s = F.regexp_replace(s, PACK_PATTERN, "")
    s = F.regexp_replace(s, COLOUR_PATTERN, "")
    return strip_ws(F.regexp_replace(s, r"\s+", " "))


def strip_ws(c: Column) -> Column:
    """Trim every kind of leading/trailing whitespace (``trim`` only strips spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def l2_normalize(vec: Column, eps: float = 1e-9) -> Column:
    """TX3: v / (||v|| + eps) for an array<float|double> column."""
    v = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / (norm + eps))
