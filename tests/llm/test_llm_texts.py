"""Operators on texts against brute force, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.llm import bpe, langid, neardup, quality, substring, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = [f"w{i % 97} v{i % 31}" for i in range(400)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def hard(spark):
    """Ids and texts: repeats, shared passages, near copies, odd white space, a long text."""
    a = " ".join(PROSE[:60])
    b = " ".join(PROSE[100:160])
    near = a.replace("w5 ", "changed ", 1)
    rows = [(1, a), (2, a), (2, a), (3, near), (4, b + "\n" + " ".join(f"q{i}" for i in range(40))), (5, "start " + b), (6, None), (7, ""),
            (8, " \t\n\x0b\x0c\r"), (9, "one two"), (10, "One  TWO"), (11, " ".join(f"x{i}" for i in range(60_000))), (None, "null id " + a), (12, "é ü\xa0ß"),
            (13, " ".join(["same"] * 80)), (14, "a b c\na b c\n\na b c"), (15, "#*$%&|<> #"), (-3, near)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("mine")).withColumn("lang", F.lit(None).cast("string"))
    return rows, df


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\x0b\x1c\x85\xa0éA", max_size=30), max_size=5))
def test_words_and_windows(texts):
    data, offsets = words.buffers(pa.array(texts, pa.string()))
    w = words.words(data, offsets)
    want = [WORD.findall(t) for t in texts]
    raw = w.data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(w.start[a:z], w.end[a:z], strict=True)] for a, z in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == want
    for size in (1, 2, 3):
        at = words.inside(w.first, size)
        h = words.windows(w.hash, size)[at]
        grams = [tuple(x[i:i + size]) for x in want for i in range(len(x) - size + 1)]
        assert len(grams) == len(h) and len(set(grams)) == len(set(h.tolist()))
        assert len({(g, x) for g, x in zip(grams, h.tolist(), strict=True)}) == len(set(grams))


def test_slices_never_cut_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "", "b" * 200, "c"])], ["t"])
    parts = list(words.slices(iter([b]), "t", 60))
    assert [r for p in parts for r in p.column("t").to_pylist()] == b.column("t").to_pylist()


def brute_removed(texts, size):
    lists = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(x[i:i + size]) for x in lists for i in range(len(x) - size + 1))
    out = []
    for x in lists:
        gone = [False] * len(x)
        for i in range(len(x) - size + 1):
            if count[tuple(x[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((len(x), sum(gone), " ".join(y for y, g in zip(x, gone, strict=True) if not g)))
    return out


def test_substring_dedup(spark, hard):
    rows, df = hard
    got = substring.substring_dedup(df)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "n_removed", "kept_text"]
    got = Counter((r.doc_id, r.text, r.n_words, r.n_removed, r.kept_text) for r in got.collect())
    assert got == Counter((*r, *b) for r, b in zip(rows, brute_removed([t for _, t in rows], 35), strict=True))
    assert substring.substring_dedup(df.limit(0)).collect() == []


def test_substring_dedup_over_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 3, rng.integers(0, 40)))) for _ in range(200)]
    monkeypatch.setattr(substring, "blocks", lambda df, text: __import__("logsift.llm.blocks", fromlist=["x"]).blocks(df, text, 300))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(df, size=6).collect()}
    assert [got[i] for i in range(200)] == brute_removed(texts, 6)


def test_bpe_equals_the_library(spark, hard):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    more = ["a\u0301 \u0301b <|endoftext|>x  y<|startoftext|>  's don't ÀΣ ΑΣ \x85q\x1c\x1dr  z İ ǅ ﬁ \U0001F600 12a3 --!! \u200b\u3000k", "<|endoftext|>", "'S 'ſ K", "\xa0"]
    rows = hard[0] + [(100 + i, x) for i, x in enumerate(more)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe.encode_decode(df)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    want = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == Counter((i, tuple(e), t.decode(e, skip_special_tokens=False)) for i, e in want)
    assert Counter(map(tuple, bpe.digests(got).collect())) == Counter((i, len(e), sha(" ".join(map(str, e))), sha(t.decode(e, skip_special_tokens=False))) for i, e in want)
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_bpe_refuses_tokenizers_that_look_over_spaces():
    import json
    d = json.loads(open(bpe.default_path(), encoding="utf-8").read())
    assert bpe.splits_at_space(json.dumps(d))
    d["decoder"] = {"type": "ByteLevel"}
    assert not bpe.splits_at_space(json.dumps(d))


def brute_components(rows, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def test_near_duplicates(spark, hard):
    rows, df = hard
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == brute_components(rows)
    assert neardup.near_duplicates(df.limit(0)).collect() == []


def test_near_duplicates_large_groups(spark, monkeypatch):
    """Many near copies of one text in nodes that stay large, compared in chunks."""
    monkeypatch.setattr(neardup, "LEAF", 3)
    monkeypatch.setattr(neardup, "CHUNK", 8)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 7)):
            w[k] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == brute_components(rows)


def test_near_duplicates_of_long_texts(spark, monkeypatch, tmp_path):
    """Near copies of one long text in nodes that stay large: chunks are bounded by bytes, whatever their rows."""
    monkeypatch.setattr(neardup, "LEAF", 3)
    monkeypatch.setattr(neardup, "CHUNK_BYTES", 100_000, raising=False)
    compared = neardup._apart

    def recorded(size, percent):
        run, folder = compared(size, percent), str(tmp_path)

        def seen(rows):
            import uuid
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(sum(map(len, rows["z"]))))
            return run(rows)
        return seen

    monkeypatch.setattr(neardup, "_apart", recorded)
    base, rows = [f"w{i}" for i in range(3000)], []
    for i in range(50):
        rows.append((i, " ".join([*base[:60 * i], f"n{i}", *base[60 * i + 1:]])))
    for i in range(20):  # at 0.72 from the others
        rows.append((100 + i, " ".join([*base[:120 * i], *(f"m{i}_{k}" for k in range(480)), *base[120 * i + 480:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == brute_components(rows)
    held = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert held and max(held) < 150_000  # all 70 texts, which met in one task before, take about 500,000


@pytest.mark.parametrize("limit", [1, 40, 1000])
def test_sets_of_texts_one_by_one(limit):
    texts = [x.encode() for x in ("a b c d e f", "one", "x " * 60, "a b c d e f g h", "é ü")]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = neardup.sets_of(iter(texts), limit=limit)
    assert [x.tolist() for x in got] == [x.tolist() for x in neardup.shingle_sets(data, offsets)]
    assert neardup.sets_of(iter([])) == []


def test_near_duplicates_of_a_large_group(spark):
    """Hundreds of copies that differ in the tail only, and documents at 0.75 to 0.80 from all of them."""
    rows = []
    for g in range(3):
        base = [f"w{g}_{i}" for i in range(200)]
        rows += [(1000 * g + i, " ".join([*base, f"serial{g}_{i}"])) for i in range(200)]
        for at in range(4, 174, 4):  # no link among these
            rows.append((1000 * g + 500 + at, " ".join([*base[:at], *(f"n{g}_{at}_{k}" for k in range(23)), *base[at + 23:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, neardup.near_duplicates(df).collect())) == brute_components(rows)


def test_quality_base(spark, hard):
    rows, df = hard
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(df, labels).collect()
    want = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        hit = [any(0 <= j <= len(w) - 3 and grams[tuple(w[j:j + 3])] > 1 for j in (i - 2, i - 1, i)) for i in range(len(w))]
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * sum(hit) > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit), failed, None, not failed))
    assert Counter(map(tuple, got)) == Counter(want)
    assert quality.judge(df.limit(0), labels).collect() == []


def test_quality_learns(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"good{i}" for i in range(40)], [f"spam{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 60))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(120)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    right = np.mean([(got[i].probability >= 0.5) == bool(i % 3) for i in range(120, 240)])
    assert right > 0.95
    assert all(0 <= r.probability <= 1 for r in got.values())


def test_language_id_small(spark):
    rng = np.random.default_rng(4)
    vocabulary = {"aa": ["tha", "ing", "the", "and"], "bb": ["zuk", "öß", "sch", "xyq"]}
    rows = [(i, " ".join(rng.choice(vocabulary[x], rng.integers(3, 60))), x) for i in range(300) for x in [["aa", "bb"][i % 2]]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 !!", "bb"), (1003, "t", None), (None, "the and", "aa"), (1004, "the ing " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    got = langid.identify(df).withColumn("held_out", langid.held_out()).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1004].lang_pred == "aa"
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert langid.identify(df.limit(0)).collect() == []


def test_network_gradients():
    """Backpropagation through time against finite differences of the loss."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, (7, 3))
    w, u = (rng.normal(0, 0.2, s) for s in ((2 * langid.HIDDEN, 256), (2 * langid.HIDDEN, langid.HIDDEN)))
    w[:langid.HIDDEN] += 0.45
    out = rng.normal(size=(7, langid.HIDDEN, 3)).astype(np.float32)

    def loss(w, u):
        return float((langid._forward(w.astype(np.float32), u.astype(np.float32), x)[0][1:] * out).sum())

    kept = langid._forward(w.astype(np.float32), u.astype(np.float32), x)
    dw, du = langid._backward(u.astype(np.float32), x, kept, out)
    for grad, which in ((dw, 0), (du, 1)):
        for _ in range(12):
            i = (rng.integers(grad.shape[0]), int(rng.choice(x.ravel())) if which == 0 else rng.integers(grad.shape[1]))
            a, b = [w.copy(), u.copy()], [w.copy(), u.copy()]
            a[which][i] += 1e-2
            b[which][i] -= 1e-2
            slope = (loss(*a) - loss(*b)) / 2e-2
            assert abs(slope - grad[i]) < 0.05 + 0.05 * abs(slope)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_language_id_held_out_accuracy(spark, sf):
    d = f"/root/testdata/{sf}"
    got = langid.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = got.where("held_out and lang is not null").agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()
    assert n > 50 and right > 0.95


def thue_morse(bits):
    s = "a"
    for _ in range(bits):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [5, 6, 10, 12])
def test_words_of_like_structure(spark, bits):
    """A word over two letters and its complement, which collide under hashes that are polynomials
    modulo a power of two, are two words to all operators."""
    x, y = thue_morse(bits)
    shared = [f"s{i}" for i in range(36)]
    texts = {1: " ".join(shared[:18] + [x] + shared[18:]), 2: " ".join(shared[:18] + [y] + shared[18:]), 3: f"{x} b c d {y} b c e"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    near = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert near[1].component_id == 1 and near[2].component_id == 2
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(df).collect()} == {1: 0, 2: 0, 3: 0}
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_path())
    for r in bpe.encode_decode(df).collect():
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids
    w = words.words(*words.buffers(pa.array([texts[3]])))
    assert len(set(w.hash.tolist())) == 6 and quality._repeated(words.windows(w.hash, 3), len(w.hash)) == 0


def test_equal_hashes_are_compared_by_bytes(monkeypatch):
    """With a hash that knows lengths only, distinct words stay apart."""
    monkeypatch.setattr(words, "_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(["bb aa bb c", "aa dd c"])], ["text"])
    w, h, at, back = bpe._distinct(batch, "text")
    raw = w.data.tobytes()
    every = [raw[s:e] for s, e in zip(w.start, w.end, strict=True)]
    assert [every[at[k]] for k in back] == every and len(at) == 4 and (np.diff(h.astype(int)) >= 0).all()


@pytest.mark.parametrize("n,bits", [(40, 3), (4000, 6), (300, 1)])
def test_subtrees_equal_joins(spark, monkeypatch, n, bits):
    """Branching in a task and branching by joins end in the same nodes and pairs, whatever the bound between them."""
    monkeypatch.setattr(neardup, "SAME", 0)
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, 1 << bits, (n, neardup.TREES * neardup.DEPTH)).astype(np.uint32)
    df = spark.createDataFrame([(i.to_bytes(4, "big"), int(i % 5), t.tobytes()) for i, t in enumerate(tokens)], "key binary, c long, tokens binary")
    for classes in (df.select("key", "tokens"), df):
        got = []
        for group, held in ((0, 32_000), (25, 32_000), (25, 7), (100, 60), (1 << 30, 50)):
            monkeypatch.setattr(neardup, "GROUP", group)
            monkeypatch.setattr(neardup, "HELD", held)
            nodes, pairs = neardup._nodes(classes, 0, neardup.TREES)
            got.append((Counter(map(str, nodes.collect())), {tuple(sorted(p)) for p in pairs.collect()}))
        assert all(g == got[0] for g in got) and (got[0][0] or got[0][1])


@pytest.mark.parametrize("n", [1, 3, 9])
def test_quality_with_few_labels(spark, n):
    """A model is fitted as soon as both qualities are labelled."""
    good = [(i, " ".join(f"calm{(i * 7 + k) % 90} word{k}" for k in range(60))) for i in range(20)]
    bad = [(100 + i, " ".join(f"spam{(i + k) % 90} buy{k}" for k in range(60))) for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in good[:n]] + [(d, 0, 0) for d, _ in bad[:n]], "doc_id long, quality int, toxic int")
    p = {r.doc_id: r.probability for r in quality.judge(docs, labels).collect()}
    assert all(x is not None and 0 <= x <= 1 for x in p.values())
    assert np.mean([p[d] for d, _ in good]) > np.mean([p[d] for d, _ in bad])
    one = quality.judge(docs, labels.where("quality = 1")).collect()
    assert all(r.probability is None and r.kept != r.base_failed for r in one)


def test_language_sample_counts_repeated_rows_once(spark):
    rows = [(i, f"the quick text {i} of many words", "en") for i in range(40)] + [(i, f"der schnelle Text {i} mit Worten", "de") for i in range(40, 80)]
    df = spark.createDataFrame(rows + [rows[3]] * 500, "doc_id long, text string, lang string")
    x, y, names = langid.training_runs(df, "text", "lang", "doc_id", 1000)
    alone = langid.training_runs(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id", 1000)
    assert names == ["de", "en"] and (x == alone[0]).all() and (y == alone[1]).all()
