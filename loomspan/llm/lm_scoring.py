"""Language-model scoring with a log-bilinear model.

The model predicts a target from the two tokens before it. Targets are the
end, every word that training documents hold often enough, each by itself, and
a few hundred tails: the words that are too rare, by what they end in. Contexts
are the commonest words by themselves and the others by what they end in. With
context vectors r, position matrices C1 and C2, target vectors q and biases b,

    s(w | u, v) = q_w . (C1 r_u + C2 r_v) + b_w,   q_w = own_w + ending_w

so a word that is seen rarely shares what its ending has learnt. Inside its
tail, a rare word has its smoothed share of the tail's counts.

The model is trained by noise-contrastive estimation on every training
document: each task runs over its own tokens from the model so far and sends
back the vectors it touched, which are averaged by how often, round after
round, in the cluster; the driver gets one model. Because exp(s) is a product
of a part in u and a part in v, the normalisers of all context pairs are one
sum of products of matrices over blocks of targets, so scores are properly
normalised log-probabilities at the cost of a look-up.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.shared import slices, texts_of
from loomspan.storage import settle

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The end token; no word is empty.
END = b""
#: Words that are contexts by themselves; endings, which are the other
#: contexts and the tails.
TOP, ENDINGS = 255, 256
#: Dimensions, noise samples a batch, tokens a batch, rounds of averaging.
DIMS, NOISE, BATCH, ROUNDS = 16, 128, 2048, 2
RATE = 0.03
#: Least count of a word with a vector of its own, and the number of such
#: words that a worker's memory allows; the tails hold all others.
LEAST, MOST = 8, 250_000
#: Distinct tokens that a task counts before it sends them on.
HELD = 200_000
CHUNK_BYTES = 1 << 20
#: Runs of ids in which vectors travel; input partitions of a training task.
PIECES, JOINED = 32, 64
#: Targets at a time in the normalisers.
BLOCK = 4096
STOPS = b".,;:!?"


def is_held_out(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _held_out(folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def ending(word: bytes) -> int:
    """The number of the word's last three bytes before closing stops."""
    return zlib.crc32(word.rstrip(STOPS)[-3:]) % ENDINGS


def count_tokens(docs: DataFrame) -> DataFrame:
    """``word, c``: every token of the training documents, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
            held.clear()
            return out

        for batch in slices(batches, "text", CHUNK_BYTES):
            for text in texts_of(batch, "text"):
                held.update(words_of(text))
            held[END] += batch.num_rows
            if len(held) > HELD:
                yield flush()
        if held:
            yield flush()

    return docs.where(~_held_out()).select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, least: int, most: int) -> tuple[list[tuple[bytes, int]], Column]:
    """The words with vectors of their own, by count and then by bytes, and
    the condition that they meet.

    The bound is a count that ``most`` words reach at most; it is found on a
    table of one row for each of some hundred classes of counts."""
    step = F.floor(F.log2("c") * 8)
    words = counts.where((F.length("word") > 0) & (F.col("c") >= least))
    bound, n = None, 0
    for r in sorted(words.groupBy(step.alias("k")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["k"]):
        if n + r["n"] > most:
            break
        bound, n = r["k"], n + r["n"]
    if bound is None:
        return [], F.lit(False)
    own = (F.length("word") > 0) & (F.col("c") >= least) & (step >= bound)
    found = [(bytes(r["word"]), r["c"]) for r in counts.where(own).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0])), own


def tail_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each tail, from the rows of ``counts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(ENDINGS, dtype=np.int64), np.zeros(ENDINGS, dtype=np.int64)
        for batch in batches:
            at = np.fromiter(map(ending, batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)
            np.add.at(n, at, batch.column(1).to_numpy())
            np.add.at(v, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(ENDINGS), pa.int32()), pa.array(n), pa.array(v)], ["tail", "n", "v"])

    n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    rows = counts.select("word", "c").mapInArrow(run, "tail int, n long, v long")
    for r in rows.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    return n, v


class Words:
    """Targets by number: 0 the end, then words by count, then the tails."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.number = {w: i + 1 for i, w in enumerate(words)}
        self.own, self.size = len(words) + 1, len(words) + 1 + ENDINGS
        ends = np.fromiter(map(ending, words), dtype=np.int64, count=len(words))
        tails = np.arange(ENDINGS)
        #: The ending of each target; the end has one to itself.
        self.ending = np.concatenate(([ENDINGS], ends, tails))
        #: The context that each target is: 0 the end and whatever stands
        #: before a text.
        nth = np.arange(1, len(words) + 1)
        self.context = np.concatenate(([0], np.where(nth <= TOP, nth, 1 + TOP + ends), 1 + TOP + tails))

    def __reduce__(self) -> tuple:
        return Words, (self.words,)

    def targets(self, texts: list[list[bytes]]) -> np.ndarray:
        """The targets of texts, each one's end after it."""
        known, own = self.number.get, self.own
        out: list[int] = []
        for text in texts:
            out.extend([known(w) or own + ending(w) for w in text])
            out.append(0)
        return np.array(out, dtype=np.int32)

    def contexts(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The contexts one and two tokens before; ends stand before a text."""
        seen = self.context[ids].astype(np.int32)
        near, far = np.zeros_like(seen), np.zeros_like(seen)
        near[1:], far[2:] = seen[:-1], seen[:-2]
        near[starts] = far[starts] = 0
        second = starts + 1
        far[second[second < len(ids)]] = 0
        return near, far


def _starts(texts: list[list[bytes]]) -> np.ndarray:
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return np.cumsum(sizes) - sizes


class Model:
    """``own`` (a vector and, last, a bias a target), ``ending``, ``context``,
    ``near`` and ``far``, all of 32-bit floats."""

    SHARED = ("ending", "context", "near", "far")

    def __init__(self, **parts: np.ndarray) -> None:
        self.__dict__.update(parts)

    @classmethod
    def start(cls, share: np.ndarray, contexts: int = 1 + TOP + ENDINGS, endings: int = ENDINGS + 1, dims: int = DIMS) -> Model:
        """The unigram model of ``share``, but for small random vectors."""
        rng = np.random.default_rng(7)
        kind = np.float32
        own = np.zeros((len(share), dims + 1), dtype=kind)
        own[:, dims] = np.log(share)
        random = lambda n: rng.normal(0, 0.3, (n, dims)).astype(kind)
        return cls(own=own, ending=random(endings), context=random(contexts), near=np.eye(dims, dtype=kind), far=0.5 * np.eye(dims, dtype=kind))

    def copy(self) -> Model:
        return Model(**{k: v.copy() for k, v in self.__dict__.items()})

    def score_parts(self, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(targets, near contexts, far contexts, log normaliser): w after v
        and u, u the nearer, has the log-probability
        targets[w] . (near[u] + far[v]) + own[w, -1] - norm[u, v]."""
        q, b = self.own[:, :-1] + self.ending[endings], self.own[:, -1]
        first, second = self.context @ self.near.T, self.context @ self.far.T
        tops = [np.full(len(first), -np.inf, dtype=np.float32) for _ in range(2)]
        blocks = [slice(i, i + BLOCK) for i in range(0, len(q), BLOCK)]
        for k in blocks:
            np.maximum(tops[0], (first @ q[k].T).max(axis=1), out=tops[0])
            np.maximum(tops[1], (second @ q[k].T + b[k]).max(axis=1), out=tops[1])
        total = np.zeros((len(first), len(second)))
        for k in blocks:
            total += np.exp(first @ q[k].T - tops[0][:, None]) @ np.exp(second @ q[k].T + b[k] - tops[1][:, None]).T
        norm = np.log(np.maximum(total, 1e-37)) + tops[0][:, None] + tops[1]
        return q, first, second, norm.astype(np.float32)


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places and the sum of the rows of each."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[head], np.add.reduceat(rows[order], head, axis=0)


def _by_class(at: np.ndarray, rows: np.ndarray, classes: int) -> np.ndarray:
    """The sum of the rows of each of a few classes."""
    return np.stack([np.bincount(at, weights=c, minlength=classes) for c in np.ascontiguousarray(rows.T)], axis=1).astype(np.float32)


class Trainer:
    """Noise-contrastive estimation in place, with AdaGrad a row; the noise is
    the unigram distribution ``share``."""

    def __init__(self, model: Model, endings: np.ndarray, share: np.ndarray) -> None:
        self.model, self.endings = model, endings
        self.edges, self.log_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.seen = {k: np.ones(len(v), dtype=np.float32) for k, v in model.__dict__.items()}
        self.bias_seen = np.ones(len(model.own), dtype=np.float32)
        #: How often each target was met, as itself or as noise.
        self.met = np.zeros(len(model.own), dtype=np.float32)

    def _step(self, name: str, at: np.ndarray, grad: np.ndarray) -> None:
        rows, seen = getattr(self.model, name), self.seen[name]
        seen[at] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
        rows[at, : grad.shape[1]] += RATE * grad / np.sqrt(seen[at])[:, None]

    def epoch(self, near: np.ndarray, far: np.ndarray, target: np.ndarray, seed: int) -> None:
        """One pass over the triples, in random order."""
        m, rng = self.model, np.random.default_rng(seed)
        order, dims = rng.permutation(len(target)), m.near.shape[0]
        with np.errstate(over="ignore"):
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                self._batch(m, near[part], far[part], target[part], rng, dims)

    def _batch(self, m: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng: np.random.Generator, dims: int) -> None:
        noise = np.minimum(np.searchsorted(self.edges, rng.random(NOISE) * self.edges[-1]), len(self.edges) - 1)
        n, both = len(w), np.concatenate((w, noise))
        rows = m.own.take(both, axis=0)
        q, b = rows[:, :dims] + m.ending.take(self.endings[both], axis=0), rows[:, dims] - self.log_noise[both]
        # contexts are few: their vectors are moved before they are dealt out
        hidden = (m.context @ m.near.T).take(u, axis=0)
        hidden += (m.context @ m.far.T).take(v, axis=0)
        real = np.einsum("ij,ij->i", hidden, q[:n]) + b[:n]
        taken = hidden @ -q[n:].T
        taken -= b[n:]
        np.exp(taken, out=taken)
        taken += 1
        np.divide(-1, taken, out=taken)
        miss = 1 / (1 + np.exp(real))
        into = taken @ q[n:]
        into += miss[:, None] * q[:n]
        grad = np.empty((n + NOISE, dims + 2), dtype=np.float32)
        np.multiply(miss[:, None], hidden, out=grad[:n, :dims])
        grad[n:, :dims] = taken.T @ hidden
        grad[:n, dims], grad[n:, dims] = miss, taken.sum(axis=0)
        grad[:, dims + 1] = 1
        at, sums = _summed(both, grad)
        self.met[at] += sums[:, -1]
        self.bias_seen[at] += sums[:, dims] ** 2
        m.own[at, dims] += RATE * sums[:, dims] / np.sqrt(self.bias_seen[at])
        self._step("own", at, sums[:, :dims])
        self._step("ending", *_summed(self.endings[at], sums[:, :dims]))
        by_near, by_far = (_by_class(x, into, len(m.context)) for x in (u, v))
        steps = ("context", by_near @ m.near + by_far @ m.far), ("near", by_near.T @ m.context), ("far", by_far.T @ m.context)
        for name, g in steps:
            self._step(name, np.arange(len(g)), g)


_PARTS = "piece int, weight double, ids binary, sums binary"
_KINDS = (pa.int32(), pa.float64(), pa.binary(), pa.binary())


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], ["piece", "weight", "ids", "sums"])


def _sent(model: Model, met: np.ndarray, tokens: int) -> pa.RecordBatch:
    """What a task has learnt: the targets it met, with how often, by runs of
    ids, and the shared parts, with its tokens."""
    rows = []
    for piece, ids in enumerate(np.array_split(np.arange(len(met)), PIECES)):
        ids = ids[met[ids] > 0]
        if len(ids):
            sums = np.concatenate((met[ids, None], model.own[ids]), axis=1).astype("<f4")
            rows.append((piece, 0.0, ids.astype("<i4").tobytes(), sums.tobytes()))
    flat = np.concatenate([getattr(model, k).ravel() for k in Model.SHARED])
    rows.append((PIECES, float(tokens), b"", flat.astype("<f4").tobytes()))
    return _parts(rows)


def _averaged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The weighted means of the rows of each piece."""
    held: dict[int, list] = {}
    for batch in batches:
        for piece, weight, ids, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece == PIECES:
                mine = held.setdefault(piece, [0.0, 0.0])
                mine[0] += weight
                mine[1] = mine[1] + weight * np.frombuffer(sums, dtype="<f4").astype(np.float64)
                continue
            at, rows = np.frombuffer(ids, dtype="<i4"), np.frombuffer(sums, dtype="<f4").reshape(-1, width + 1).astype(np.float64)
            rows[:, 1:] *= rows[:, :1]
            old = held.get(piece)
            held[piece] = [at, rows] if old is None else list(_summed(np.concatenate((old[0], at)), np.concatenate((old[1], rows))))
    out = []
    for piece, (a, b) in held.items():
        if piece == PIECES:
            out.append((piece, a, b"", (b / a).astype("<f4").tobytes()))
        else:
            out.append((piece, 0.0, a.astype("<i4").tobytes(), (b[:, 1:] / b[:, :1]).astype("<f4").tobytes()))
    if out:
        yield _parts(out)


def train(docs: DataFrame, words: Words, share: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The averaged model; each round takes its own part of the training
    documents, all of them together. A task runs over a number of input
    partitions, so what is sent back stays small beside the input."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    tasks = max(sc.defaultParallelism, docs.rdd.getNumPartitions() // JOINED)
    model, shared_words = Model.start(share), sc.broadcast((words, share))
    for turn in range(rounds):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            words, share = shared_words.value
            trainer, tokens = Trainer(shared.value.copy(), words.ending, share), 0
            for batch in slices(batches, "text", CHUNK_BYTES):
                texts = [words_of(t) for t in texts_of(batch, "text")]
                ids, starts = words.targets(texts), _starts(texts)
                trainer.epoch(*words.contexts(ids, starts), ids, seed=len(ids) + turn)
                tokens += len(ids)
            if tokens:
                yield _sent(trainer.model, trainer.met, tokens)

        part = docs.where(~_held_out() & (F.crc32(F.coalesce("text", F.lit(""))) % rounds == turn)).select("text")
        width = model.own.shape[1]
        learnt = part.coalesce(tasks).mapInArrow(run, _PARTS).repartition(PIECES, "piece")
        found = learnt.mapInArrow(lambda batches: _averaged(batches, width), _PARTS).collect()
        shared.destroy()
        for r in found:
            if r["piece"] < PIECES:
                model.own[np.frombuffer(r["ids"], dtype="<i4")] = np.frombuffer(r["sums"], dtype="<f4").reshape(-1, width)
                continue
            flat, at = np.frombuffer(r["sums"], dtype="<f4"), 0
            for name in Model.SHARED:
                old = getattr(model, name)
                setattr(model, name, flat[at : at + old.size].reshape(old.shape).copy())
                at += old.size
    shared_words.destroy()
    return model


#: What this worker last took from a model, by the model's name.
_held: dict[str, tuple] = {}


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score``.

    ``score`` is the model's log10 probability of the text and its end. A word
    of a tail has the probability of the tail times its smoothed share
    (c + 1) / (N' + V' + 1) of the tail's tokens, unseen ones together as one
    more; so the probabilities of all continuations add up to one. Words with
    vectors of their own are those seen ``least`` times or more, the ``most``
    commonest of them; their number grows with the input until a worker's
    memory is the bound.

    Null text is empty: an end alone. A null doc_id hashes as empty text and
    trains. Repeated rows train and are scored as often as they stand. With no
    training document, N and V are 0, and ``score`` is ``base_score``. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = settle(count_tokens(rows), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0)).alias("ends")).first()
    n_all, v_all, n_ends = int(total["n"]), int(total["v"]), int(total["ends"])
    found, own = frequent(counts, least, most)
    tail_n, tail_v = tail_counts(counts.where(~own & (F.length("word") > 0)))
    words = Words([w for w, _ in found])
    own_counts = np.array([n_ends, *(c for _, c in found)], dtype=np.float64)
    share = np.concatenate((own_counts, tail_n)) + 1
    log_all = float(np.log10(n_all + v_all + 1))
    model = None
    if n_all:
        share /= share.sum()
        model = train(rows, words, share)
        model = (*model.score_parts(words.ending), model.own[:, -1].copy())
    log_own = np.log10(own_counts + 1)
    shared = spark.sparkContext.broadcast((words, own_counts > 0, log_own, np.log10(tail_n + tail_v + 1), model))
    name = uuid.uuid4().hex
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "own_log", "model_log", "rest", "times"]
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _held:
            _held.clear()
            _held[name] = shared.value
        words, seen, log_own, log_tail, model = _held[name]
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", CHUNK_BYTES):
            docs_of = batch.column(0).to_pylist()
            split = [words_of(t) for t in texts_of(batch, "text")]
            starts, sizes = _starts(split), np.array([len(s) + 1 for s in split], dtype=np.int64)
            ids = words.targets(split)
            whole = ids < words.own
            own_log = np.where(whole, log_own[np.minimum(ids, words.own - 1)], 0.0)
            known = whole & seen[np.minimum(ids, words.own - 1)]
            logs = np.zeros(len(ids))
            if model is not None:
                near, far = words.contexts(ids, starts)
                q, first, second, norm, bias = model
                for i in range(0, len(ids), 1 << 16):
                    k = slice(i, i + (1 << 16))
                    u, v, w = near[k], far[k], ids[k]
                    logs[k] = np.einsum("ij,ij->i", q[w], first[u] + second[v]) + bias[w] - norm[u, v]
                logs /= np.log(10)
            tails = np.flatnonzero(~whole)
            logs[tails] -= log_tail[ids[tails] - words.own]
            others: list[Counter] = [Counter() for _ in split]
            flat = list(chain.from_iterable((*s, END) for s in split)) if len(tails) else []
            for d, i in zip((np.searchsorted(starts, tails, side="right") - 1).tolist(), tails.tolist(), strict=True):
                others[d][flat[i]] += 1
            cols = (
                [row + i for i in range(len(split))], docs_of, [is_held_out(d) for d in docs_of], sizes,
                np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(own_log, starts), np.add.reduceat(logs, starts),
                [list(o.keys()) for o in others], [list(o.values()) for o in others],
            )
            row += len(split)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, own_log double, model_log double, rest array<binary>, times array<int>"
    scored = settle(rows.mapInArrow(run, schema), "scored")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_log"))
    rest = rest.withColumnRenamed("row", "_row")
    both = scored.drop("rest", "times").join(rest, F.col("row") == F.col("_row"), "left")
    more = F.coalesce("more_log", F.lit(0.0))
    base = F.col("own_log") + more - F.col("n_tokens") * F.lit(log_all)
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model_log") + more if model is not None else base).alias("score"),
    )
