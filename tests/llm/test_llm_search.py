"""Spelling variants, hard negatives and exact top-k against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsift.llm import intvecs, negatives, topk, variants

LETTERS = "".join(chr(c) for c in range(0xC0, 0x100))


def brute_words(rows):
    import re
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [x for x in n if differ_by_one(w, x)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def spelled():
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdé"), int(rng.integers(6, 10)))) for _ in range(60)] + ["straße", "ÄÖÜäöü", "aaaaaaa", "bananas", "ananasb"]
    texts = []
    for i in range(1500):
        words = [base[int(k)] for k in rng.zipf(1.4, 40) % len(base)]
        words = [w if rng.random() < 0.8 else w[:(p := int(rng.integers(len(w))))] + "x" * int(rng.integers(2)) + w[p + 1:] for w in words]
        texts.append((i, " ".join(words).upper() if i % 7 == 0 else "-".join(words)))
    return texts + [(None, texts[0][1])] * 6 + [(3, None), (4, ""), (5, "12 ,;"), (6, "q" * 100_000), (7, ("long" * 300 + " ") * 5), (8, ("lxng" + "long" * 299 + " ") * 6)] + [(9, "repeat repeat")] * 3


@pytest.mark.parametrize("hot", [256, 3])
def test_variants(spark, spelled, monkeypatch, hot):
    """The finer keys of hot signatures (``hot`` = 3 makes nearly all hot) give the same words."""
    monkeypatch.setattr(variants, "HOT", hot)
    df = spark.createDataFrame(spelled, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    words = variants.written(variants.word_counts(df), "words")
    want = brute_words(spelled)
    assert {(r.word, r.n) for r in words.collect()} == set(want.items())
    got = variants.variants(words).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == brute_variants(want)
    assert sum(r.n_near > 0 for r in got) > 50 and any(r.root != r.form and r.form for r in got)


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(variants.written(variants.word_counts(none), "words")).collect() == []


def test_signatures_meet(spark):
    """Two words that differ by one character share a signature of their kind; lengths are told apart."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        w = "".join(rng.choice(list("abcdefgé"), int(rng.integers(1, 14))))
        p = int(rng.integers(len(w)))
        replaced, longer = w[:p] + "z" + w[p + 1:], w[:p] + "z" + w[p:]
        assert set(variants.signatures(w, 5, 2)) & set(variants.signatures(replaced, 5, 2))
        assert set(variants.signatures(w, 3, 1)) & set(variants.signatures(longer, 3, 1))
        for a, b in ((w, replaced), (w, longer)):
            m = [variants.mask(variants.letters(x)) ^ variants.mask(variants.letters(y)) for x, y in ((a, b),)][0]
            assert (m & (2**64 - 1)).bit_count() <= 2


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit(1)).withColumn("v", F.lit("x"))


def usable(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def product(a, b, scale):
    return sum(math.floor(scale * x) * math.floor(scale * y) for x, y in zip(a, b, strict=False))


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 10)) / 3
    rows = [(i, (base[i % 12] + rng.normal(0, 0.15, 10)).tolist(), int(i % 3)) for i in range(400)]
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(30)] + [(i, [0.0] * 10, 2) for i in range(430, 440)]  # copies: ties
    rows += [(440, None, 1), (441, [None] * 10, 1), (442, [float("nan")] + [1.0] * 9, 1), (443, [float("inf")] * 10, 0), (None, rows[0][1], 0),
             (460, [], 1), (461, [1.0, -2.0], 1), (462, rows[5][1] + [3.0, 1e3], 2), (480, [-1.0] * 10, 0), (500, rows[7][1], None)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, odd_vectors, monkeypatch, small):
    if small:  # many blocks on both sides
        monkeypatch.setattr(topk, "CANDIDATES", 60)
        monkeypatch.setattr(topk, "QUERIES", 7)
        monkeypatch.setattr(topk, "TILE", (3, 25))
    rows = odd_vectors
    got = topk.top_k(intvecs.integers(vectors_of(spark, rows), "vec_id", "embedding", 64), F.col("vec_id") % 20 == 0).collect()
    ok = usable(rows)
    want = []
    for q in (r for r in ok if r[0] % 20 == 0):
        s = sorted(((-product(q[1], c[1], 64), c[0]) for c in ok if c is not q))[:20]
        want += [(q[0], k + 1, c, -x) for k, (x, c) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_wide_and_repeated(spark):
    rows = [(20, [1e6, 1.0], 0), (21, [1e6, 0.5], 0), (21, [1e6, 0.5], 0), (20, [-1e6, 1.0], 0), (22, [3.0], 0)]
    got = topk.top_k(intvecs.integers(vectors_of(spark, rows), "vec_id", "embedding", 64), F.col("vec_id") % 20 == 0, 3).collect()
    first = 64_000_000**2 + 64 * 32
    assert Counter((r.query_id, r.vec_id, r.score) for r in got)[(20, 21, first)] == 2 and len(got) == 6
    assert topk.top_k(intvecs.integers(vectors_of(spark, rows[:0]), "vec_id", "embedding", 64), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(intvecs.integers(vectors_of(spark, rows[1:2]), "vec_id", "embedding", 64), F.col("vec_id") % 20 == 0).collect() == []


def brute_negatives(rows, every):
    ok = [(r[0], r[1], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]) for r in usable(rows) if r[2] is not None]
    out = []
    for a in (r for r in ok if r[0] % every == 0):
        scored = sorted(((-product(a[1], x[1], 256), x[0], x[2] == a[2]) for x in ok if x is not a))
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(a[0], pid, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(fit)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, odd_vectors, monkeypatch, small):
    if small:  # a small sample, many subtrees and parts, several levels, anchors in batches
        for name, value in (("FAN", 4), ("LEAF", 9), ("SAMPLE", 30), ("PART", 50), ("LEAST", 20), ("ANCHORS", 10), ("CHUNK", 3)):
            monkeypatch.setattr(negatives, name, value)
    vectors = vectors_of(spark, odd_vectors).where("label is not null")
    got = negatives.hard_negatives(intvecs.integers(vectors, "vec_id", "embedding", 256, negatives.relabelled()), F.col("vec_id") % 10 == 0).collect()
    want = brute_negatives(odd_vectors, 10)
    assert Counter(map(tuple, got)) == Counter(want) and len(want) > 200


def test_hard_negatives_of_little(spark):
    def mine(rows):
        return negatives.hard_negatives(intvecs.integers(vectors_of(spark, rows), "vec_id", "embedding", 256, F.col("label").cast("long")), F.col("vec_id") % 50 == 0).collect()
    assert mine([]) == [] and mine([(0, [1.0], 1)]) == []
    assert mine([(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert list(map(tuple, mine([(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (3, [0.96], 2), (4, [0.4], 3)]))) == [(0, 1, 1, 2, 65536, 49152)]
    assert len(mine([(0, [1.0], 1)] * 2 + [(2, [0.75], 2)])) == 2  # either row is the other's positive


def test_subtree_bounds_hold():
    """No score of a subtree leaves the interval that its ranges give."""
    rng = np.random.default_rng(6)
    v = negatives.Vectors(rng.integers(-300, 300, (500, 12)))
    a = negatives.Vectors(rng.integers(-300, 300, (40, 12)))
    points = negatives.split_points(v, np.arange(500))
    cell = v.far(np.arange(500), v, points).argmin(1)
    r = negatives.Ranges.of(v.far(np.arange(500), v, points), cell, v.norm2)
    least, most = r.scores(a.far(np.arange(40), v, points), a.norm2)
    dots = a.dots(np.arange(40), v, np.arange(500))
    assert (dots >= least[:, cell]).all() and (dots <= most[:, cell]).all()
