"""Text similarity by longest matching blocks, and small sequence tests."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: Column, b: Column) -> Column:
    """2M / T, where M characters lie in matching blocks (longest first, then on both sides) and T is the total.

    The recursion has no counterpart among column functions, so this and what scores
    a text's windows by it are the Arrow functions here; call it on distinct pairs that ``could_reach`` passes.
    """

    @F.pandas_udf(DoubleType())
    def matched(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "", autojunk=False).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    return matched(a, b)


def _in_common(key: str, at: dict[str, int], window: str) -> int:
    """Length of the longest common subsequence; bit i of ``at[c]`` is set where ``key`` has c."""
    every = (1 << len(key)) - 1
    open_ = every
    for c in window:
        hit = open_ & at.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(key) - open_.bit_count()


def _sharing(key: str, text: str, least: int) -> list[tuple[int, int]]:
    """(-common, start from 0) of the windows of ``text`` as long as ``key`` that have ``least`` characters in common with it, in order, from the most."""
    lacks, shared, found, size = Counter(key), 0, [], len(key)
    at = {c: sum(1 << i for i, x in enumerate(key) if x == c) for c in lacks}
    for i, c in enumerate(text):  # as multisets first
        if c in lacks:
            shared += lacks[c] > 0
            lacks[c] -= 1
        if i >= size and (gone := text[i - size]) in lacks:
            lacks[gone] += 1
            shared -= lacks[gone] > 0
        if shared >= least and i >= size - 1 and (common := _in_common(key, at, text[i - size + 1 : i + 1])) >= least:
            found.append((-common, i - size + 1))
    return sorted(found)


def nearest_window(key: Column, text: Column, least: Column) -> Column:
    """Of a text's windows as long as ``key`` with ``least`` characters in common, in order, the one of highest ``ratio``, the first on ties: (ratio, start from 1), 0 without any.

    Matching blocks are characters in common, so windows are scored from the most of
    these down, and no more once they bound the ratio below the best.
    """

    @F.pandas_udf("ratio double, start int")
    def nearest(keys: pd.Series, texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        best = []
        for k, t, number in zip(keys, texts, numbers, strict=True):
            top, first = 0.0, -1
            for negative, i in _sharing(k, t, number) if t else ():
                bound = -negative / len(k)
                if bound < top:
                    break
                if bound > top or i < first:
                    ratio = SequenceMatcher(None, k, t[i : i + len(k)], autojunk=False).ratio()
                    if ratio > top or (ratio == top and i < first):
                        top, first = ratio, i
            best.append((top, first + 1))
        return pd.DataFrame(best, columns=["ratio", "start"])

    return nearest.asNondeterministic()(key, text, least)  # for the planner: a filter on the result is not pushed below it, where it would be computed again


def could_reach(a: Column, b: Column, least: float) -> Column:
    """An exact upper bound on ``ratio``: characters in common as multisets are no more than of the shorter text."""
    total = F.length(a) + F.length(b)
    by_length = 2 * F.least(F.length(a), F.length(b)) >= least * total
    # characters of each text that the other lacks altogether can't match
    shared = F.length(a) - F.length(F.call_function("translate", a, b, F.lit("")))
    return (total == 0) | (by_length & (2 * F.least(shared, F.length(b)) >= least * total))


def distinct_ratios(pairs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """``pairs`` with ``ratio``, computed once per distinct pair; null where it can't reach ``least``."""
    distinct = pairs.select(a, b).distinct().where(could_reach(F.col(a), F.col(b), least))
    return pairs.join(distinct.withColumn("ratio", ratio(F.col(a), F.col(b))), [a, b], "left")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the characters of ``short`` occur in ``long`` in order: a fold that drops what is passed."""
    state = F.aggregate(
        F.filter(F.split(short, ""), lambda c: c != ""),
        F.struct(F.lit(True).alias("ok"), long.alias("rest")),
        lambda s, c: F.struct(
            (s["ok"] & F.contains(s["rest"], c)).alias("ok"),
            F.substring(s["rest"], F.length(F.call_function("substring_index", s["rest"], c, F.lit(1))) + 2, F.length(s["rest"])).alias("rest"),
        ),
    )
    return state["ok"]


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y) & (x != ""), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
