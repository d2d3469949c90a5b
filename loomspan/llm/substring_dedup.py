"""Substring dedup with sharded Aho-Corasick automata.

A phrase is ``window`` consecutive words; each occurrence of one that also
starts in a document of a smaller id is removed. The steps:

1. Every window has an anchor: of its short sub-sequences the one whose hash
   is the smallest, so equal windows have equal anchors, and consecutive
   windows mostly share one: they make a segment. Anchors that occur in one
   document only rule their segments out; a map task tells at once which of
   its own recur and sends one row for each other anchor.
2. The segments left are cut out of the texts, equal ones of a task as one
   row, and dealt to shards by anchor: equal windows meet in one shard.
3. Each shard confirms, word by word, which windows occur in several
   documents, compiles them to automata and streams its segments through. An
   occurrence carries the smallest id that its phrase occurs in.
4. Occurrences in documents of greater ids come back as spans of words.

What a shard gets for a phrase is a row for each map task that saw it, not
one for each document, so a phrase of a third of all documents stays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.llm.shared import kept_names, slices, spread, texts_of, trim
from loomspan.storage import settle

#: Words of an anchor; text that a task handles at a time; windows that one
#: automaton holds; numbers that anchors are dealt to tasks by.
ANCHOR, CHUNK_BYTES, AUTOMATON, SHARDS = 5, 8 << 20, 20_000, 1 << 20
#: Letters of a word's code inside an automaton: two do for most shards.
LETTERS = "".join(map(chr, range(256, 512)))
#: No smaller id is known; ids are 64-bit, so this is the greatest of them.
NONE = np.iinfo(np.int64).max


def segments(split: list[list[bytes]], window: int) -> tuple[np.ndarray, ...]:
    """(document number, first window, number of windows, anchor) of the
    segments of the texts; a text shorter than a window has none."""
    sizes = np.array([len(s) for s in split], dtype=np.int64)
    n = int(sizes.sum())
    empty = np.empty(0, dtype=np.int64)
    if n < window:
        return empty, empty, empty, empty.astype(np.uint64)
    of = np.repeat(np.arange(len(split)), sizes)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    digest = xxhash.xxh3_64_intdigest
    words = np.fromiter(map(digest, chain.from_iterable(split)), dtype=np.uint64, count=n)
    k = min(ANCHOR, window)
    grams = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(29)
    starts = n - window + 1
    least, at = grams[:starts].copy(), np.zeros(starts, dtype=np.int64)
    for j in range(1, window - k + 1):
        other = grams[j : j + starts]
        less = other < least
        least = np.where(less, other, least)
        at[less] = j
    whole = np.flatnonzero(of[:starts] == of[window - 1 :])
    place = whole + at[whole]
    doc = of[whole]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]))) if len(whole) else np.empty(0, bool)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(whole)))
    return doc[head], whole[head] - first[doc[head]], count, grams[place[head]]


def _recurring(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, found``: the segments whose anchor occurs in several documents,
    each a number of first window (lower 32 bits), number of windows (8 bits)
    and shard."""
    tasks = spread(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, at, count, anchor = segments([(t or b"").split() for t in texts_of(batch, "text")], window)
            order = np.lexsort((ids[doc], anchor))
            doc, at, count, anchor = ids[doc][order], at[order], count[order], anchor[order]
            if not len(anchor):
                continue
            head = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            tail = np.append(head[1:], len(anchor)) - 1
            own = doc[head] != doc[tail]
            known = np.repeat(own, tail - head + 1)
            # A row for each other task to match: smallest and greatest id.
            # Segments of one document alone wait for the answer; those of
            # anchors known to recur go on by document.
            dealt = (anchor % np.uint64(tasks)).astype(np.int64)
            hint = np.zeros(len(anchor), dtype=np.int8)
            hint[known] = 2  # recurs: go on, nothing to ask
            hint[head[own]] = 3  # recurs, and the one that tells the others
            hint[~known] = 1  # asks
            send_to = np.where(hint == 2, np.abs(doc) % tasks, dealt)
            by = np.argsort(send_to, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], send_to[by][1:] != send_to[by][:-1])))
            cols: list[list] = [[], [], [], [], [], []]
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True):
                part = by[a:b]
                row = (int(send_to[part[0]]), anchor[part].astype("<u8").tobytes(), doc[part].astype("<i8").tobytes(), at[part].astype("<i4").tobytes(), count[part].astype("i1").tobytes(), hint[part].tobytes())
                for out, x in zip(cols, row, strict=True):
                    out.append(x)
            kinds = (pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "anchor", "doc", "at", "count", "hint"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                held.append(tuple(np.frombuffer(x, dtype=d) for x, d in zip(row, ("<u8", "<i8", "<i4", "i1", "i1"), strict=True)))
        if not held:
            return
        trim()
        anchor, doc, at, count, hint = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, anchor))
        order = order[hint[order] != 2]
        a, d = anchor[order], doc[order]
        found = np.flatnonzero(hint == 2)
        if len(order):
            head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            tail = np.append(head[1:], len(a)) - 1
            told = np.maximum.reduceat((hint[order] == 3).astype(np.int8), head) > 0
            several = np.repeat((d[head] != d[tail]) | told, tail - head + 1)
            found = np.concatenate((found, order[several]))
        packed = at[found].astype(np.int64) | count[found].astype(np.int64) << 32 | (anchor[found] % np.uint64(SHARDS)).astype(np.int64) << 40
        for i in range(0, len(found), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(doc[found[i : i + 100_000]]), pa.array(packed[i : i + 100_000])], ["doc_id", "found"])

    sent = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(send, "shard int, anchor binary, doc binary, at binary, count binary, hint binary")
    return sent.repartition(tasks, "shard").mapInArrow(match, "doc_id long, found long")


def _cut_segments(docs: DataFrame, recurring: DataFrame, window: int) -> DataFrame:
    """The recurring segments: ``task, nth`` (a row's name), ``shard, words``
    (joined by spaces), ``low, high`` (the smallest and greatest id that the
    task saw it in), ``seen`` (doc_id, row hash, first word; int64 triples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", CHUNK_BYTES):
            keep = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
            batch = batch.take(pa.array(keep))
            ids, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            met: dict[bytes, list] = {}
            for doc, row, text, found in zip(ids, rows, texts_of(batch, "text"), batch.column(3).to_pylist(), strict=True):
                split = (text or b"").split()
                for x in sorted(set(found)):
                    i = x & 0xFFFFFFFF
                    words = b" ".join(split[i : i + (x >> 32 & 0xFF) + window - 1])
                    met.setdefault(words, [x >> 40, []])[1].append((doc, row, i))
            names = ["task", "nth", "shard", "words", "low", "high", "seen"]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            cols: list[list] = [[] for _ in names]
            for text, (shard, seen) in met.items():
                low, high = min(s[0] for s in seen), max(s[0] for s in seen)
                for out, x in zip(cols, (task, nth, shard, text, low, high, np.array(seen, dtype="<i8").tobytes()), strict=True):
                    out.append(x)
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    found = recurring.groupBy("doc_id").agg(F.collect_list("found").alias("found")).withColumnRenamed("doc_id", "_doc")
    rows = docs.join(found, F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "row_id", "found")
    return rows.mapInArrow(run, "task int, nth long, shard int, words binary, low long, high long, seen binary")


def locate(rows: list[tuple[list[bytes], int, int]], window: int) -> list[np.ndarray]:
    """For each segment (words, smallest and greatest id it was seen in) and
    each window of it, the smallest id that the phrase occurs in, or ``NONE``
    where it occurs in one document only.

    Windows are confirmed by comparing them; the recurring ones are compiled
    to automata of ``AUTOMATON`` phrases, and the segments that hold any of
    them are streamed through. Segments must come sorted by content, so that
    the phrases of an automaton and the segments that hold them are near each
    other and each segment meets few automata.
    """
    import ahocorasick

    codes: dict[bytes, str] = {}
    base = len(LETTERS)

    def code(word: bytes) -> str:
        out, n = "", len(codes)
        for _ in range(width):
            out, n = out + LETTERS[n % base], n // base
        codes[word] = out
        return out

    distinct = len(set(chain.from_iterable(w for w, _, _ in rows)))
    width = 1
    while base**width < distinct:
        width += 1
    texts = ["".join([codes.get(w) or code(w) for w in words]) for words, _, _ in rows]
    step, size = width, width * window
    met: dict[str, list[int]] = {}
    windows: list[list[list[int]]] = []
    for text, (_, low, high) in zip(texts, rows, strict=True):
        mine = []
        for i in range(0, len(text) - size + 1, step):
            phrase = text[i : i + size]
            known = met.get(phrase)
            if known is None:
                met[phrase] = known = [low, high, -1]
            elif low < known[0] or high > known[1]:
                known[0], known[1] = min(known[0], low), max(known[1], high)
            mine.append(known)
        windows.append(mine)
    # Phrases get automata in the order of the segments that hold them.
    number, holders = 0, []
    for j, mine in enumerate(windows):
        for entry in mine:
            if entry[0] != entry[1]:
                if entry[2] < 0:
                    entry[2] = number // AUTOMATON
                    number += 1
                    if entry[2] == len(holders):
                        holders.append([])
                if not holders[entry[2]] or holders[entry[2]][-1] != j:
                    holders[entry[2]].append(j)
    del windows
    out = [np.full(max(0, len(words) - window + 1), NONE, dtype=np.int64) for words, _, _ in rows]
    phrases: list[list[tuple[str, int]]] = [[] for _ in range(-(-number // AUTOMATON))]
    for phrase, (low, high, at) in met.items():
        if low != high:
            phrases[at].append((phrase, low))
    for held, streamed in zip(phrases, holders, strict=True):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, (phrase, _) in enumerate(held):
            automaton.add_word(phrase, k)
        automaton.make_automaton()
        for j in streamed:
            mine = out[j]
            for end, k in automaton.iter(texts[j]):
                start = end + 1 - size
                if start % step == 0:
                    mine[start // step] = held[k][1]
    return out


def _spans(cut: DataFrame, window: int) -> DataFrame:
    """``doc_id, row_id, spans`` (first word and end, in the upper and lower 32
    bits of a number): the words to remove, for rows that lose any."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        rows.sort(key=lambda r: r[2])
        distinct: list[tuple[list[bytes], int, int]] = []
        place, last = [], None
        for _, _, words, low, high in rows:
            if words == last:
                _, a, b = distinct[-1]
                distinct[-1] = (distinct[-1][0], min(a, low), max(b, high))
            else:
                distinct.append((words.split(b" "), low, high))
                last = words
            place.append(len(distinct) - 1)
        found = [x.astype("<i8").tobytes() if (x != NONE).any() else None for x in locate(distinct, window)]
        good = [(r[0], r[1], found[k]) for r, k in zip(rows, place, strict=True) if found[k] is not None]
        del distinct
        del rows, found
        trim()
        for i in range(0, len(good), 20_000):
            cols = zip(*good[i : i + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["task", "nth", "lows"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "seen", 2 << 20):
            seen = [np.frombuffer(x, dtype="<i8").reshape(-1, 3) for x in batch.column(0).to_pylist()]
            lows = [np.frombuffer(x, dtype="<i8") for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in lows])
            table = np.full((len(lows), int(sizes.max()) + 2), NONE, dtype=np.int64)  # a column without windows on either side
            nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            table[np.repeat(np.arange(len(lows)), sizes), nth + 1] = np.concatenate(lows)
            whole = np.concatenate(seen)
            gone = table[np.repeat(np.arange(len(seen)), [len(x) for x in seen])] < whole[:, :1]
            # runs of windows that go; row by row the k-th head belongs to the k-th tail
            row, head = np.nonzero(gone[:, 1:] & ~gone[:, :-1])
            _, tail = np.nonzero(gone[:, :-1] & ~gone[:, 1:])
            first = whole[row, 2]
            cols = (whole[row, 0], whole[row, 1], first + head, first + tail - 1 + window)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["doc_id", "row_id", "first", "past"])

    lows = cut.select("task", "nth", "words", "low", "high", "shard").repartition(4 * spread(cut), "shard").drop("shard").mapInArrow(shard, "task int, nth long, lows binary")
    lows = lows.select(F.col("task").alias("_task"), F.col("nth").alias("_nth"), "lows")
    back = cut.select("task", "nth", "seen").join(lows, (F.col("task") == F.col("_task")) & (F.col("nth") == F.col("_nth")))
    spans = back.select("seen", "lows").mapInArrow(expand, "doc_id long, row_id long, first long, past long")
    # one number a span keeps the lists flat: word numbers stay below 2^31
    packed = F.shiftleft("first", 32).bitwiseOR(F.col("past"))
    return spans.groupBy("doc_id", "row_id").agg(F.collect_list(packed).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept_sha256,
    kept_text`` (the words left, joined by one space) and the columns
    ``keep``, unchanged.

    A word goes if a window of ``window`` words that covers it also starts in
    a document of a smaller id; windows are judged on the input, not on what
    is left. Words are maximal runs of characters other than ASCII white
    space. Null texts have no words. Rows that repeat an id are judged as one
    document: they lose nothing to each other. A row without an id loses
    nothing and takes nothing from others. An empty table gives no rows;
    columns not in ``keep`` are ignored; one of a name above comes back with
    ``_in`` after it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("row_id", F.xxhash64("text"))
    cut = settle(_cut_segments(rows.select("doc_id", "text", "row_id"), _recurring(rows, window), window), "segments")
    spans = settle(_spans(cut, window), "spans")
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("row_id").alias("_row"), "spans")
    joined = rows.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("row_id") == F.col("_row")), "left")
    joined = joined.select("doc_id", "text", "spans", *[f"_keep_{c}" for c in keep])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK_BYTES):
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n = len(words)
                if spans:
                    stay = np.ones(n, dtype=bool)
                    for span in spans:
                        stay[span >> 32 : span & 0xFFFFFFFF] = False
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                left = b" ".join(words)
                for out, x in zip(cols, (n, n - len(words), hashlib.sha256(left).hexdigest(), left.decode()), strict=True):
                    out.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *batch.columns[3:]], [*own, *named])

    own = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    named = kept_names(keep, own)
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    for c, n in zip(keep, named, strict=True):
        schema = schema.add(n, rows.schema[f"_keep_{c}"].dataType)
    return joined.mapInArrow(finish, schema)
