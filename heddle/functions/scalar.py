"""Scalar functions over text and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest text that models get, in characters.
MAX_CHARS = 2048
#: Least scores of the levels, in order; below them all the level is the last.
LEVELS = ((0.85, "very_strong_match"), (0.75, "strong_match"), (0.60, "moderate_match"), (0.45, "weak_match"))
LOW = "low_match"
#: The sentence for each level, and for any other.
SENTENCES = {
    "very_strong_match": "Kinh nghiệm rất phù hợp với yêu cầu công việc",
    "strong_match": "Kinh nghiệm phù hợp tốt với yêu cầu công việc",
    "moderate_match": "Kinh nghiệm có liên quan đến yêu cầu công việc",
    "weak_match": "Kinh nghiệm có một số điểm tương đồng với yêu cầu",
    "low_match": "Kinh nghiệm ít liên quan đến yêu cầu công việc",
}
UNKNOWN = "Không xác định được mức độ phù hợp"

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column | str) -> Column:
    """Without white space at either end, as Python understands white space."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), _EDGE, "")


def cap_text(text: Column | str, most: int = MAX_CHARS) -> Column:
    """Stripped, then cut to a number of code points; null is empty."""
    return F.left(strip(text), F.lit(most))


def boost_title(title: Column | str, text: Column | str) -> Column:
    """The title twice and the text, one a line, without empty ones."""
    t, p = F.nullif(strip(title), F.lit("")), F.nullif(strip(text), F.lit(""))
    return F.concat_ws("\n", t, t, p)


def match_level(score: Column | str) -> Column:
    """The level of a score; NaN has the lowest."""
    s = F.col(score) if isinstance(score, str) else score
    out = F.when(F.isnan(s), F.lit(LOW))
    for least, level in LEVELS:
        out = out.when(s >= F.lit(least), F.lit(level))
    return out.otherwise(F.lit(LOW))


def level_sentence(level: Column | str) -> Column:
    c = F.col(level) if isinstance(level, str) else level
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))[c], F.lit(UNKNOWN))


def percent(score: Column | str) -> Column:
    """The score times 100 to two decimals, rounded as Python rounds (which no built-in does everywhere)."""

    @F.pandas_udf("double")
    def rounded(x: pd.Series) -> pd.Series:
        # a value near to a tie is rounded by Python itself, any other by NumPy, which then gives the same
        v = x.to_numpy(np.float64, copy=True)
        with np.errstate(invalid="ignore"):
            near = np.flatnonzero(np.abs(np.abs(v * 100 % 1) - 0.5) < 1e-6)
            out = np.round(v, 2)
        out[near] = [round(float(y), 2) for y in v[near]]
        return pd.Series(out)

    hundred = (F.col(score) if isinstance(score, str) else score) * F.lit(100.0)
    return F.when(hundred.isNotNull(), rounded(hundred))


def shown(percent: Column | str) -> Column:
    """A percent as text with one decimal, rounded as Python formats it."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map("{:.1f}%".format, na_action="ignore")

    return text(percent)


def is_vectorless(*columns: str) -> Column:
    """Whether any of some columns is null."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def has_text(column: str) -> Column:
    """Neither null nor empty; white space counts as text."""
    return F.col(column).isNotNull() & (F.col(column) != "")
