"""Arrow UDFs for what Catalyst has no expression for: Ratcliff-Obershelp ratios, word differences, NFC.

Put every cheap condition into the join before these: a filter on their result is evaluated after them."""

from __future__ import annotations

import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


@F.pandas_udf(DoubleType())
def label_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of two keys; not symmetric, the current side comes first."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def _words(a: str, b: str, of: int) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    both, total = sum((x & y).values()), sum(x.values()) + (sum(y.values()) if of == 2 else 0)
    return of * both / total if total else 0.0


@F.pandas_udf(DoubleType())
def words_dice(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dice coefficient of two lists of words, each as often as it is there; 0 if both are empty."""

    def one(x, y) -> float:
        x, y = Counter(() if x is None else x), Counter(() if y is None else y)
        total = sum(x.values()) + sum(y.values())
        return 2.0 * sum((x & y).values()) / total if total else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def prose_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The better of the character ratio and the word-multiset Dice coefficient of two normalised paragraphs."""
    return pd.Series([max(SequenceMatcher(None, x, y, autojunk=False).ratio(), _words(x, y, 2)) if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def prose_coverage(part: pd.Series, whole: pd.Series) -> pd.Series:
    """How much of the first paragraph stands in the second, by characters or by words."""

    def one(x: str, y: str) -> float:
        if not x:
            return 1.0
        if not y:
            return 0.0
        blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        return max(sum(b.size for b in blocks) / len(x), _words(x, y, 1))

    return pd.Series([one(x or "", y or "") for x, y in zip(part, whole)], dtype="float64")


@F.pandas_udf(StructType([StructField("removed", StringType()), StructField("added", StringType())]))
def word_diff(current: pd.Series, prior: pd.Series) -> pd.DataFrame:
    """Word groups only in the prior (removed) and only in the current text (added), joined by ' / '."""
    rows = []
    for c, p in zip(current.fillna(""), prior.fillna("")):
        a, b = c.split(), p.split()
        parts: dict[str, list[str]] = {"removed": [], "added": []}
        for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag != "equal":
                for name, words in (("added", a[i:j]), ("removed", b[k:m])):
                    if any(ch.isalnum() for w in words for ch in w):
                        parts[name].append(" ".join(words))
        rows.append({k: " / ".join(v) for k, v in parts.items()})
    return pd.DataFrame(rows, columns=["removed", "added"])


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)
