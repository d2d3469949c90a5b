"""Each operator on a fixture of odd rows, against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import chat_format, lm_scoring, mixing, packing, quality_rules, queries, simhash, substring_dedup, token_store, topk_search, toxicity
from loomspan.llm.components import connected_components
from loomspan.operators.ranges import running_total

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, row_id string, words string"
WORDS = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(40)]


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


PASSAGE = sentence(99, 30)
ROWS = [
    (1, sentence(1, 60) + "\n" + PASSAGE), (2, PASSAGE + " tail words here"), (3, None), (4, ""), (5, " \t\n "), (6, sentence(6, 3)),
    (7, "the same line\nthe same line\nthe same line"), (8, sentence(1, 60) + "\n" + PASSAGE), (9, "x " * 4000), (10, sentence(10, 5000)),
    (11, PASSAGE.replace(" ", " ") + "  two  spaces\r\n"), (12, "<|im_end|> | a.b 'tis Don't 1.5e3! ﬁ"), (12, "<|im_end|> | a.b 'tis Don't 1.5e3! ﬁ"), (None, sentence(5, 50)),
    (13, sentence(13, 20) + " " + PASSAGE + " " + sentence(14, 20)), (14, sentence(10, 5000) + " end"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, [None, "a", "b", "ü"][k % 4], None, "clash", "clash", None) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return (text or "").encode().split()


def test_substring_dedup(docs, none):
    low: dict[tuple, int] = {}
    for i, t in ROWS:
        w = split(t)
        for k in range(len(w) - 12):
            if i is not None:
                low[tuple(w[k : k + 13])] = min(low.get(tuple(w[k : k + 13]), i), i)
    expected = []
    for i, t in ROWS:
        w = split(t)
        gone = {x for k in range(len(w) - 12) if i is not None and low[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    found = substring_dedup.remove_repeats(docs, keep=("source", "words")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(expected)
    assert sum(e[2] > 0 for e in expected) >= 4
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_random_windows(spark):
    rng = np.random.default_rng(2)
    texts = [[WORDS[i] for i in rng.integers(0, 6, 40)] for _ in range(30)]
    texts += [texts[3][5:30] + texts[4][:20], texts[9]]
    df = spark.createDataFrame([(int(i), " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(df, window=4).collect()}
    for i, t in enumerate(texts):
        earlier = {tuple(o[k : k + 4]) for o in texts[:i] for k in range(len(o) - 3)}
        assert found[i] == len({x for k in range(len(t) - 3) if tuple(t[k : k + 4]) in earlier for x in range(k, k + 4)})


def test_locate_over_several_automata(monkeypatch):
    rng = np.random.default_rng(12)
    rows = sorted({tuple(b"w%d" % x for x in rng.integers(0, 5, int(n))) for n in rng.integers(4, 30, 80)})
    rows = [(list(w), int(low), int(low + rng.integers(0, 2))) for w, low in zip(rows, rng.integers(0, 50, len(rows)), strict=True)]
    whole = substring_dedup.locate(rows, 4)
    low: dict[tuple, list] = {}
    for words, a, b in rows:
        for k in range(len(words) - 3):
            low.setdefault(tuple(words[k : k + 4]), []).extend((a, b))
    for found, (words, _, _) in zip(whole, rows, strict=True):
        for k in range(len(words) - 3):
            ids = low[tuple(words[k : k + 4])]
            assert found[k] == (min(ids) if min(ids) != max(ids) else substring_dedup.NONE)
    monkeypatch.setattr(substring_dedup, "AUTOMATON", 3)
    assert all((a == b).all() for a, b in zip(whole, substring_dedup.locate(rows, 4), strict=True))


def test_chat_of_any_columns(spark):
    rows = [(1, 0, "user", "q" * 300_000, "a"), (1, 1, "assistant", "<|" * 100_000, "b")]
    names = ("nth", "x", "xs", "formatted", "written", "held", "first", "at", "head", "content", "loss_spans", "attachments")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c string")
    for c in names:
        df = df.withColumn(c, F.lit("clash"))
    r = chat_format.format_chat(df, chat_format.text_part(F.col("text"))).select(chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.loss == "<|" * 100_000


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|x", "a<", "|b", "<\\\\||<|", None, "line\nbreak <|nl|>", ""]
    rows = [(1, k, ["user", "assistant", "rö\nle", None][k % 4], t) for k, t in enumerate(texts)] + [(None, None, "assistant", "zz"), (1, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(df, chat_format.text_part(F.col("text")))
    out = out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    found = {r.conv_id: ([(x.role, x.content) for x in r.t], r.loss) for r in out.collect()}
    ordered = sorted(((k, r or "", t or "") for c, k, r, t in rows if c == 1))
    assert found[1] == ([(r, t) for _, r, t in ordered], "".join(t for _, r, t in ordered if r == "assistant"))
    assert found[None] == ([("assistant", "zz")], "zz")
    assert chat_format.format_chat(df.limit(0), chat_format.text_part(F.col("text"))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|", None, None), ("image", None, "i.png", 2), ("audio", None, "a.wav", 3), (None, "x", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", [("document", None, "d.pdf", None)]), (1, 2, "assistant", None)], f"conv_id long, turn long, role string, p {chat_format.PART_TYPE}")
    r = chat_format.format_chat(df, F.col("p")).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|<|image:0|><|audio:1|>x<|im_end|>\n<|im_start|>user\n<|document:2|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["index"], a.type, a.ref, a.n_tokens) for a in r.attachments] == [(0, "image", "i.png", 1152), (1, "audio", "a.wav", 75), (2, "document", "d.pdf", 1024)]
    assert r.attachment_tokens == 2251


def test_quality_rules(docs, none):
    found = Counter(tuple(r)[:6] for r in quality_rules.quality_rules(docs).collect())
    expected: Counter = Counter()
    for i, t in ROWS:
        w = split(t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        inside = {x for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        expected[i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside)] += 1
    assert found == expected
    assert quality_rules.quality_rules(none).count() == 0


def longest_repeats(w):
    """For each place the longest run of words that stands elsewhere too, by trying all."""
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_quality_verdicts(spark):
    rng = np.random.default_rng(21)
    some = lambda n, k: [f"é{x}" if x % 5 == 0 else f"w{x}" for x in rng.integers(0, k, n)]
    fresh = lambda n: some(n, 10**6)
    phrase, long = fresh(30), fresh(120)
    texts = [fresh(15), fresh(40), phrase + fresh(60) + phrase, phrase + fresh(200) + phrase, long + fresh(300) + long, long + fresh(2200) + long, some(80, 4), fresh(50) * 2, phrase[:8] + fresh(90) + phrase[:8]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("kept", F.lit("clash"))
    found = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    for i, w in enumerate(texts):
        lengths = [k if k >= 8 else 0 for k in longest_repeats(w)] if len(w) < 700 else None
        r = found[i]
        if lengths is None:  # both places of the long passage
            lengths = [0] * len(w)
            for at in (0, len(w) - 120):
                for k in range(113):
                    lengths[at + k] = 120 - k
        inside = {x for at, k in enumerate(lengths) for x in range(at, at + k)}
        chars = sum(len(w[x]) for x in inside)
        assert (r.n_repeat_words, r.covered_chars, r.longest_repeat) == (len(inside), chars, max(lengths))
        failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
        bad = chars > 0.3 * sum(map(len, w)) or max(lengths) > 100 and 10 * max(lengths) > len(w)
        assert (r.base_failed, r.kept) == (failed, not failed and not bad)
    assert {r.kept for r in found.values()} == {True, False}


def test_repeat_lengths_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(20):
        docs = np.sort(rng.integers(0, 3, 60))
        words = rng.integers(0, 3, 60)
        got = quality_rules.repeat_lengths(words, docs, 1)
        for i in range(60):
            best = 0
            for j in range(60):
                if i != j and docs[i] == docs[j]:
                    k = 0
                    while max(i, j) + k < 60 and docs[max(i, j) + k] == docs[i] and words[i + k] == words[j + k]:
                        k += 1
                    best = max(best, k)
            assert got[i] == best


def fold(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split() + [b""]


def base_rows(rows):
    counts: Counter = Counter()
    for i, t in rows:
        if not lm_scoring.is_held_out(i):
            counts.update(fold(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(i, len(fold(t)), sum(counts[w] > 0 for w in fold(t)), sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in fold(t))) for i, t in rows]


@pytest.mark.parametrize("bounds", [{"least": 2, "most": 30}, {"least": 1, "most": 0}, {}])
def test_lm_scoring(docs, none, bounds):
    found = lm_scoring.score(docs, **bounds).collect()
    n, expected = base_rows(ROWS)
    key = lambda rows: Counter((i, a, b, round(c, 4)) for i, a, b, c in rows)
    assert key((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in found) == key(expected)
    assert all(r.train_tokens == n and r.score < 0 for r in found)
    assert lm_scoring.score(none).count() == 0


def test_lm_counts_past_what_a_task_holds(spark):
    train = [i for i in range(20) if not lm_scoring.is_held_out(i)]
    held = next(i for i in range(99) if lm_scoring.is_held_out(i))
    rows = [(train[0], " ".join(f"v{k}" for k in range(270_000))), (train[1], "v1 v2 unseen"), (train[2], "v3"), (held, "v4 never v5")]
    found = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()
    n, expected = base_rows(rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in found) == sorted((i, a, b, round(c, 3)) for i, a, b, c in expected)


def test_lm_is_normalised():
    rng = np.random.default_rng(1)
    words = lm_scoring.Words([f"w{k}".encode() for k in range(20)])
    share = rng.random(words.size) + 0.1
    model = lm_scoring.Model.start(share / share.sum(), dims=4)
    trainer = lm_scoring.Trainer(model, words.ending, share / share.sum())
    ids = rng.integers(0, words.size, 500)
    trainer.epoch(*words.contexts(ids, np.array([0])), ids, 1)
    q, first, second, norm = model.score_parts(words.ending)
    for u, v in rng.integers(0, len(first), (40, 2)):
        assert abs(np.exp(q @ (first[u] + second[v]) + model.own[:, -1] - norm[u, v]).sum() - 1) < 1e-3


def test_lm_learns_context(spark):
    # four tongues, each with words and endings of its own: what came before tells which
    rng = np.random.default_rng(5)
    tongues = [[f"{s}{k}{e}" for k in range(60) for s in "aeiou"] for e in ("ing", "ent", "ung", "ado")]
    rows = [(i, " ".join(rng.choice(tongues[i % 4], 120))) for i in range(800)]
    out = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    per_token = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    assert len(out) > 50 and per_token > 0.25


@pytest.mark.parametrize("scale, small", [(1.0, False), (1e6, False), (1.0, True), (1e3, True)])
def test_topk(spark, scale, small, monkeypatch):
    if small:  # many blocks on either side, and many groups of query blocks
        for name, value in (("CANDIDATES", 16), ("QUERIES", 2), ("STEP", 4), ("GROUP_BYTES", 700)):
            monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=20) * scale).round(3).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(30)] + [(400, None), (420, [None] * 20), (440, [float("nan")] * 20), (None, rows[0][1]), (460, []), (480, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q, x in good.items():
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good.items() if i != q and len(y) == len(x))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert found == sorted(expected)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def ids_of(name, texts):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(queries.tokenizer_path(name))
    codec.encode_special_tokens = True
    return [np.array([*e.ids, 0], dtype="<u4") for e in codec.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(docs, none):
    found = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), capacity=64).collect()
    expected: Counter = Counter()
    for (i, _), ids in zip(ROWS, ids_of("word_bpe_49k.json", [t for _, t in ROWS]), strict=True):
        for k in range(0, len(ids), 64):
            expected[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    bins: dict[int, list] = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and b[-1][0] + b[-1][1] <= 64
    assert len(bins) <= -(-sum(r.length for r in found) // 64) + 2
    assert packing.pack(none, queries.tokenizer_path("word_bpe_49k.json")).count() == 0


def test_plan_uses_each_length_once():
    rng = np.random.default_rng(4)
    for _ in range(2):
        counts = np.zeros(129, dtype=np.int64)
        for n in rng.integers(1, 129, 400):
            counts[n] += 1
        runs = packing.best_plan(counts, 128, groups=(48, 96))
        used = np.zeros_like(counts)
        for times, use in runs:
            assert sum(n * k for n, k in use) <= 128
            for n, k in use:
                used[n] += times * k
        assert (used == counts).all()
        first_fit: list[int] = []
        for n in sorted(np.repeat(np.arange(129), counts), reverse=True):
            for b in range(len(first_fit)):
                if first_fit[b] >= n:
                    first_fit[b] -= n
                    break
            else:
                first_fit.append(128 - n)
        assert sum(t for t, _ in runs) <= 1.03 * len(first_fit) + 1


def test_simhash(spark, docs, none):
    prints = {}
    for _, t in ROWS:
        w = [x for x in bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[t] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in found) == Counter((i, f"{prints[t]:016x}") for i, t in ROWS)
    groups = {r.doc_id: r.component_id for r in found}
    assert groups[8] == 1 and groups[4] == groups[5] == 3 and groups[14] == 10 and groups[6] == 6
    assert simhash.near_duplicates(none).count() == 0


def test_close_links_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 60, dtype=np.int64)
    fps = set(base.tolist()) | {0, -1, -(1 << 63)}
    for x in base[:40].tolist():
        for _ in range(6):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                y ^= -(1 << 63) if b == 63 else 1 << b
            fps.add(y)
            x = y
    fps = sorted(fps)
    a = np.array(fps, dtype=np.int64).view(np.uint64)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2).tolist():
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    expected = {fps[i]: fps[find(i)] for i in range(len(fps))}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for most in (20_000, 3):  # and with files cut again
        got = {r.node: r.root for r in connected_components(simhash.close_links(df, 2, most)).collect()}
        assert {x: got.get(x, x) for x in fps} == expected


def test_token_store(spark, docs, none, tmp_path):
    path = f"{tmp_path}/store"
    token_store.write_store(docs, path, queries.tokenizer_path("byte_bpe_50k.json"))
    found = token_store.read_digests(spark, path).collect()
    whole = ids_of("byte_bpe_50k.json", [t for _, t in ROWS])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(ROWS, whole, strict=True))
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at and r.verified
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)
    assert all(r.ok for r in token_store.verify_store(spark, path).collect())
    rebuilt = Counter((r.doc_id, tuple(r.ids)) for r in token_store.read_ids(spark, path).collect())
    assert rebuilt == Counter((i, tuple(x.tolist())) for (i, _), x in zip(ROWS, whole, strict=True))
    assert token_store.store_digests(none, queries.tokenizer_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("table", ["raw/kind=chunk", "recipes", "manifests"])
def test_tampered_store_is_not_verified(spark, tmp_path, table):
    path = f"{tmp_path}/store"
    rows = [(i, sentence(i, 200)) for i in range(6)]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, queries.tokenizer_path("byte_bpe_50k.json"))
    assert all(r.verified for r in token_store.read_digests(spark, path).collect())
    held = spark.read.parquet(f"{path}/{table}")
    if table == "recipes":  # a document has another's parts
        other = held.where("doc_id = 3").first().parts
        held = held.withColumn("parts", F.when(F.col("doc_id") == 2, F.lit(bytes(other))).otherwise(F.col("parts")))
    elif table == "manifests":
        held = held.withColumn("root", F.unhex(F.sha2("root", 256)))
    else:  # one chunk holds another's ids
        first = held.agg(F.min("address").alias("a"), F.max_by("payload", "address").alias("p")).first()
        held = held.withColumn("payload", F.when(F.col("address") == first.a, F.lit(bytes(first.p))).otherwise(F.col("payload")))
    files = held.toArrow()
    import pyarrow.parquet as pq

    named = [f for f in (tmp_path / "store" / table).glob("*.parquet") if pq.read_metadata(f).num_rows]
    sizes = [pq.read_metadata(f).num_rows for f in named]
    assert sum(sizes) == files.num_rows
    at = 0
    parts = {f: pq.read_table(f) for f in named}
    for f, n in zip(named, sizes, strict=True):
        if table == "recipes":  # each row stays in its file
            kept = files.filter(pa_in(files["doc_id"], parts[f]["doc_id"]))
            kept = kept.take(pc_order(kept))
        else:
            kept = files.slice(at, n)
            at += n
        pq.write_table(kept, f)
        crc = f.with_name(f".{f.name}.crc")
        if crc.exists():
            crc.unlink()
    verified = {r.doc_id: r.verified for r in token_store.read_digests(spark, path).collect()}
    assert not all(verified.values()) and (table != "recipes" or not verified[2])


def pa_in(column, values):
    import pyarrow.compute as pc

    return pc.is_in(column, value_set=values.combine_chunks())


def pc_order(rows):
    import pyarrow.compute as pc

    return pc.sort_indices(rows, sort_keys=[("start", "ascending")])


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(8)
    rows, truth = [], []
    for i in range(600):
        bad, poor = i % 5 == 0, i % 7 == 0
        text = sentence(1000 + i, 60) + (" you utter numpty!" if bad else "") + (" $$$ ### %%%" * 9 if poor else "")
        rows.append((i, text))
        truth.append((i, 0 if poor else 1, int(bad)))
    rows += [(900, None), (901, ""), (None, sentence(3, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("p_toxic", F.lit("clash"))
    half = [t for t in truth if rng.random() < 0.5] + [(None, 1, 1), (5000, None, None), truth[0], truth[0]]
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labelled(spark, half), queries.toxicity_categories()).collect()}
    assert all(out[i].toxic == bool(x) for i, _, x in truth)
    assert all((out[i].p_low_quality > 0.5) == (q == 0) for i, q, _ in truth)
    assert out[900].kept and out[901].kept and out[None].kept


def test_toxicity_without_examples(spark, docs, none):
    out = toxicity.toxicity(docs, labelled(spark, []), queries.toxicity_categories()).collect()
    assert len(out) == len(ROWS) and all(r.kept and r.p_toxic == 0 for r in out)
    assert toxicity.toxicity(none, labelled(spark, [(1, 1, 0)]), queries.toxicity_categories()).count() == 0


def test_fill_targets():
    assert mixing.fill_targets([10, 10, 10], [5, 2, 1], 45, 2) == pytest.approx([20, 50 / 3, 25 / 3])
    assert mixing.fill_targets([0, 4], [5, 2], 6, 2) == pytest.approx([0, 6])
    assert mixing.fill_targets([], [], 0, 2) == []


def test_mix(docs, none):
    drawn = mixing.draw(docs)
    found = mixing.mix(drawn, F.lit(None).cast("double")).collect()
    assert len(found) == len(ROWS)
    sizes: Counter = Counter()
    for k, (_, t) in enumerate(ROWS):
        sizes[[None, "a", "b", "ü"][k % 4]] += len(split(t))
    taken: Counter = Counter()
    for r in found:
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
    targets = {r.source: r.target for r in found}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    biggest = {s: max(r.size for r in found if r.source == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= biggest[s] for s in sizes)
    again = mixing.mix(mixing.draw(docs.repartition(5)), F.lit(None).cast("double")).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, found)) == sorted(map(key, again))
    assert mixing.mix(mixing.draw(none), F.lit(1.0)).count() == 0


def test_running_total(spark):
    rng = np.random.default_rng(9)
    rows = [(["a", "b", None][int(k)], int(x), int(v)) for k, x, v in zip(rng.integers(0, 3, 300), rng.permutation(300), rng.integers(0, 9, 300), strict=True)]
    df = spark.createDataFrame(rows, "g string, x long, v long")
    for group in (None, ["g"]):
        for r in running_total(df, ["x"], F.col("v"), "before", group).collect():
            assert r.before == sum(v for g, x, v in rows if x < r.x and (group is None or g == r.g))


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("group", [1 << 20, 50])
def test_pieces_give_the_ids_of_whole_texts(name, spaced, group, monkeypatch):
    from loomspan.llm import tokens
    from loomspan.llm.tokens import Encoder

    monkeypatch.setattr(tokens, "GROUP", group)
    monkeypatch.setattr(tokens, "KEPT", 40 if group == 50 else tokens.KEPT)
    rng = np.random.default_rng(17)
    bits = ["a", "É", "é", "ÿ", "×", "÷", "ª", "ü", "Straße", "the", "don't", "'s", "'", "s", "7", "42", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", " ", "　", "\x85", "\x1c", "…", "—", "日本", "ﬁ", "İ", "é", "̸", "=", "<", "<|endoftext|>", "<|startoftext|>", "###", "$$$", ".", ",", "!", "_", "-", "`", "😀"]
    texts = ["".join(rng.choice(bits, int(n))) for n in rng.integers(0, 30, 1500)] + [None, "", "x" * 9000, " y" * 9000]
    codec = Encoder(queries.tokenizer_path(name), spaced)
    for part in (texts, texts[::-1], texts[:9]):  # cold and warm
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode([None if t is None else t.encode() for t in part])] == [x[:-1].tolist() for x in ids_of(name, part)]
