"""Quality rules on suffix arrays: how much of a text is repetition."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import slices, texts_of

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_lengths(words: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """For each word position the length of the longest sequence that starts
    there and occurs elsewhere in its document too; below ``least``, 0.

    The suffixes of all documents are ordered at once by prefix doubling, a
    document's number before its words, so that suffixes meet only those of
    their own document. Only suffixes that still tie are ordered again. The
    longest common prefix of neighbours follows from the ranks of each round,
    the largest step first.
    """
    n = len(words)
    out = np.zeros(n, dtype=np.int64)
    if not n:
        return out
    last = np.searchsorted(docs, docs, side="right")
    base = docs.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(base, kind="stable")
    fresh = np.concatenate(([True], base[order][1:] != base[order][:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks, step, place = [rank], 1, order
    size = np.bincount(rank, minlength=n)
    tied = np.flatnonzero(size[rank] > 1)
    while len(tied):
        ahead = tied + step
        inside = ahead < last[tied]
        second = np.zeros(len(tied), dtype=np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = rank[tied]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        start = np.maximum.accumulate(np.where(first, np.arange(len(tied)), 0))
        place = place.copy()
        at = group + np.arange(len(tied)) - start
        place[at] = tied
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[tied] = np.maximum.accumulate(np.where(fresh, at, 0))
        step *= 2
        ranks.append(rank)
        size = np.bincount(rank, minlength=n)
        tied = tied[size[rank[tied]] > 1]
    a, b = place[:-1], place[1:]
    same = docs[a] == docs[b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + common, b + common
        inside = (i + (1 << k) <= last[a]) & (j + (1 << k) <= last[b])
        equal = np.zeros(len(a), dtype=bool)
        equal[inside] = ranks[k][i[inside]] == ranks[k][j[inside]]
        common += equal.astype(np.int64) << k
    common[common < least] = 0
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which positions the union of the spans (position, length) covers. Only
    spans that can't be extended to the left count; the others lie in them."""
    n = len(lengths)
    starts = np.flatnonzero(lengths)
    starts = starts[~((starts > 0) & (lengths[starts - 1] == lengths[starts] + 1))]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths[starts], -1)
    return np.cumsum(edge)[:n] > 0


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.translate(None, SPACES)]
    return len(lines) - len(set(lines))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_repeat: int = 8,
    max_covered: float = 0.3,
    max_longest: int = 100,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, covered_chars, longest_repeat, base_failed,
    kept``.

    A repeat is a sequence of ``least_repeat`` words or more that occurs at
    two places of its text, which may overlap. ``covered_chars`` counts the
    characters of the words in the union of the maximal repeats. The method
    rejects a text of which they are more than ``max_covered``, or whose
    longest repeat has more than ``max_longest`` words and more than a tenth
    of the text's; base rules come first.

    Null, empty and word-less texts have zeros and fail the base rule. A very
    long text is handled whole, in a chunk of its own. Repeated rows give
    repeated rows, an empty table none; a null doc_id is kept as it is; other
    columns are ignored.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", chunk_bytes):
            texts = [t or b"" for t in texts_of(batch, "text")]
            split = [t.split() for t in texts]
            n_words = np.array([len(s) for s in split], dtype=np.int64)
            flat = list(chain.from_iterable(split))
            number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            words = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
            of = np.repeat(np.arange(len(texts)), n_words)
            lengths = repeat_lengths(words, of, least_repeat)
            inside = covered(lengths)
            chars = np.fromiter((len(w) - (0 if w.isascii() else len(w) - len(w.translate(None, CONTINUATION))) for w in number), dtype=np.int64, count=len(number))[words] if flat else words
            total = np.bincount(of, weights=chars, minlength=len(texts)).astype(np.int64)
            repeat_words = np.bincount(of[inside], minlength=len(texts))
            repeat_chars = np.bincount(of[inside], weights=chars[inside], minlength=len(texts)).astype(np.int64)
            longest = np.zeros(len(texts), dtype=np.int64)
            np.maximum.at(longest, of, lengths)
            symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], dtype=np.int64)
            lines = np.array([_dup_lines(t) for t in texts], dtype=np.int64)
            failed = (n_words < min_words) | (100 * repeat_words > max_repeat_percent * n_words)
            bad = (repeat_chars > max_covered * total) | (longest > max_longest) & (10 * longest > n_words)
            cols = [n_words, total, symbols, lines, repeat_words.astype(np.int64), repeat_chars, longest, failed, ~failed & ~bad]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    longs = ", ".join(f"{n} long" for n in names[:8])
    return rows.mapInArrow(run, f"{longs}, base_failed boolean, kept boolean")
