"""String similarities. Levenshtein runs in the JVM; the others take Arrow
batches and compare each distinct pair of a batch once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import words


def jaro(a: str, b: str) -> float:
    """Matching characters within half the longer length, and transpositions."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken, own = [False] * m, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                own.append(c)
                break
    k = len(own)
    if not k:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(own, other, strict=True)) // 2
    return (k / n + k / m + (k - moved) / k) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised for a common prefix of up to four where it exceeds 0.7."""
    s = jaro(a, b)
    if s <= 0.7:
        return s
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return s + 0.1 * prefix * (1 - s)


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits and swaps of neighbours, which later edits may touch again."""
    far, last = len(a) + len(b), {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            k, l = last.get(y, 0), match  # noqa: E741
            if x == y:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][l] + i - k - 1 + 1 + j - l - 1)
        last[x] = i
    return d[-1][-1]


def _places(text: str) -> dict[str, int]:
    """For each character a bit at each of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(places: dict[str, int], n: int, text: str) -> int:
    """The length of the longest common subsequence of ``text`` and the text of
    ``n`` characters at ``places``: a row of the table is one number, whose zero
    bits are where the length rises (Hyyro 2004)."""
    row = whole = (1 << n) - 1
    for c in text:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & whole
    return n - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the lengths together."""
    if not a and not b:
        return 1.0
    return 2 * _common(_places(b), len(b), a) / (len(a) + len(b))


def _by_pair(score: Callable[[str, str], float], kind: str) -> Callable[[Column, Column], Column]:
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(left, right, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in seen:
                seen[pair] = score(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64" if kind == "double" else "Int64")

    return lambda a, b: F.pandas_udf(run, kind)(a, b)


jaro_similarity = _by_pair(jaro, "double")
jaro_winkler_similarity = _by_pair(jaro_winkler, "double")
damerau_levenshtein_distance = _by_pair(damerau_levenshtein, "bigint")
indel_similarity = _by_pair(indel_ratio, "double")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 minus the distance over the longer length; 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def token_sort(text: Column) -> Column:
    """The words in alphabetical order."""
    return F.array_join(F.array_sort(words(text)), " ")


def token_sort_similarity(a: Column, b: Column) -> Column:
    return indel_similarity(token_sort(a), token_sort(b))


def osa(a: str, b: str) -> int:
    """Edits and swaps of neighbours, no part edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before, last = last, row
    return last[-1]


def _key(text: str) -> str:
    """Lower case, marks as spaces, none at the ends."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).strip()


def plain(a: str, b: str) -> float:
    """``indel_ratio`` of the texts as keys; 0 where either is empty."""
    a, b = _key(a), _key(b)
    return indel_ratio(a, b) if a and b else 0.0


def partial(a: str, b: str) -> float:
    """The best ``indel_ratio`` of the shorter text with a run of the longer
    one that is no longer than it, run by run."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return float(not long)
    n, places = len(short), _places(short)
    runs = (long[max(0, i) : i + n] for i in range(1 - n, len(long)))
    return max(2 * _common(places, n, run) / (n + len(run)) for run in runs)


def token_set(a: str, b: str) -> float:
    """The best ``indel_ratio`` among the shared words, and these with what
    either side has besides; 1 where one side's words are all shared."""
    x, y = set(_key(a).split()), set(_key(b).split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (only_x and only_y):
        return 1.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    found = [indel_ratio(with_x, with_y)]
    if both:
        found += [indel_ratio(both, with_x), indel_ratio(both, with_y)]
    return max(found)


def weighted(a: str, b: str) -> float:
    """The best of the ratios, weighted down where they see less of the texts:
    words in any order 0.95; parts 0.9, or 0.6 where one text is over eight
    times as long."""
    a, b = _key(a), _key(b)
    if not a or not b:
        return 0.0
    ordered = lambda f: f(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    far = max(len(a), len(b)) / min(len(a), len(b))
    if far < 1.5:
        return max(indel_ratio(a, b), 0.95 * ordered(indel_ratio), 0.95 * token_set(a, b))
    scale = 0.9 if far <= 8 else 0.6
    return max(indel_ratio(a, b), scale * partial(a, b), 0.95 * scale * ordered(partial))


osa_distance = _by_pair(osa, "bigint")
plain_ratio = _by_pair(plain, "double")
partial_ratio = _by_pair(partial, "double")
token_set_ratio = _by_pair(token_set, "double")
weighted_ratio = _by_pair(weighted, "double")
