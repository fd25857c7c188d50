"""Mixing, chat formatting, URLs, archives, vectors, components and the pipeline."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsift.llm import chat, components, mixing, urls, vectors, warc
from logsift.session import scratch_path


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: share * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_targets(spark):
    rng = np.random.default_rng(1)
    for trial in range(4):
        sizes = {f"s{i}": int(rng.integers(0, 2000)) for i in range(9)} | {None: 50, "é": 7, "tiny": 1}
        if trial == 3:
            sizes = dict.fromkeys(sizes, 0)
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 50, int(rng.lognormal(3, 1.2)))), ["hot", "hot", "b", "c", None][i % 5], "x") for i in range(600)]
    rows += [(7, "a b c", "b", "x")] * 3 + [(None, "d e", "c", None), (601, None, "b", "x"), (602, "", "zero", "x"), (603, "word " * 20_000, "big", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix_plan(spark, corpus):
    rows, df = corpus
    got = mixing.mix_plan(df, block_words=200, shard_words=4000).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken, shards = Counter(), Counter()
    for r in got:
        copies = [c.copy for c in r.copies] if False else [c["copy"] for c in r.copies]
        assert r.size == len((r._c1 or "").split()) and r.source_size == sizes[r._c2] and abs(r.target - want[r._c2]) < 1e-6 * max(1, r.target)
        assert len(set(copies)) == len(copies) <= 3
        for c in r.copies:
            assert 0 < c["words"] <= r.size
            taken[r._c2] += c["words"]
            shards[c["shard"]] += c["words"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert len(shards) >= 8
    again = Counter(map(str, mixing.mix_plan(df.repartition(5), block_words=200, shard_words=4000).collect()))
    assert again == Counter(map(str, got))


def test_mixture_rows(spark, corpus):
    rows, df = corpus
    plan = mixing.mix_plan(df).select(F.explode("copies.words").alias("w")).agg(F.sum("w"), F.count("w")).first()
    out = mixing.mixture(df)
    assert out.columns == df.columns
    assert tuple(out.agg(F.sum(mixing.n_words("text")), F.count(F.lit(1))).first()) == tuple(plan)
    assert mixing.mix_plan(df.limit(0)).collect() == [] and mixing.mixture(df.limit(0)).collect() == []


def test_split_is_hypergeometric(spark):
    """Quotas are kept exactly, halves are even, and the draws have the right mean and variance."""
    quotas = [50, 30, 0, 1, 19]
    roots = spark.range(400).select((F.col("id") * 1000).alias("node"), F.array(*[F.lit(q).cast("long") for q in quotas]).alias("quotas"))
    got = mixing.split(roots, 1, 3).collect()
    left = {r.node // 2000: r.quotas for r in got if r.node % 2 == 0}
    right = {r.node // 2000: r.quotas for r in got if r.node % 2 == 1}
    assert all([a + b for a, b in zip(left[k], right[k], strict=True)] == quotas and sum(left[k]) == 50 for k in left)
    x = np.array([left[k] for k in left])
    mean, var = 50 * np.array(quotas) / 100, 50 * np.array(quotas) / 100 * (1 - np.array(quotas) / 100) * 50 / 99
    assert np.abs(x.mean(0) - mean).max() < 0.6 and np.abs(x.var(0) - var).max() < 2.5


def test_mixing_is_native(spark, corpus):
    plan = mixing.mix_plan(corpus[1])._jdf.queryExecution().toString() + urls.judge(spark.createDataFrame([(1, "http://a/b")], "page_id int, url string"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", chat.HARD), (1, 1, "assistant", "a < b \\ > c\\"), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, None, None, ""), (2, 5, "user", "</turn>\n<turn x>"),
            (None, 1, "assistant", "é\U0001F600"), (3, 1, "ass<istant", "<turn assistant>\n\\"), (4, 1, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("start", F.lit(1))
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    for conv in (1, 2, None, 3, 4):
        turns = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
    examples = chat.render(out).where("conv_id = 1").orderBy("position").collect()
    assert [chat.unescape(e.example[e.loss_start:e.loss_end]) for e in examples] == ["a < b \\ > c\\", "", ""]
    assert examples[1].example.startswith(examples[0].example)
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []


def test_chat_examples(spark, monkeypatch):
    """Every assistant turn carries its example: all turns before it and its own; the digests are read from those."""
    rows = [(c, t, ("user", "assistant", "tool")[(t + c) % 3], f"<{c}> said {t} \\" * (t % 4)) for c in range(5) for t in range(40)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for c in range(5):
        got, text = out.where(F.col("conv_id") == c).orderBy("position").collect(), ""
        for r, (_, t, role, said) in zip(got, rows[40 * c:], strict=False):
            text += f"<turn {role}>\n{chat.escape(said)}</turn>\n"
            assert (r.position, r.role, r.end) == (t, role, len(text))
            assert r.example == (text if role == "assistant" else None)
            assert role != "assistant" or r.example[r.loss_start:r.loss_end] == chat.escape(said)
        assert len(got) == 40
    # small batches: nothing is lost between them
    monkeypatch.setattr(chat, "HELD", 50)
    given = pa.RecordBatch.from_pydict({"c": [r[0] for r in rows], "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    small = pa.Table.from_batches(chat._expand(iter([given.slice(0, 33), given.slice(33)])))
    want = out.orderBy("conv_id", "position").collect()
    assert small.column("conv_id").to_pylist() == [r.conv_id for r in want]
    assert small.column("example").to_pylist() == [r.example for r in want]
    # a damaged example is not read back
    bad = out.withColumn("example", F.when(F.col("position") == 4, F.concat(F.lit("x"), "example")).otherwise(F.col("example")))
    with pytest.raises(Exception, match="cannot be read back"):
        chat.read_back(bad).collect()


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: s[:min([s.index(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), cut(rest[len(host):], "?#")


def test_url_rules(spark):
    given = [None, "", "abc", "HTTP://A.ORG/es", "http://example.org/es/?x", "http://w.example.org/en/1/2/3/4/5/6/7", "a\nb://Q.com/fr/\n#z", "x://y?://z/", "http://x.com/" + "a" * 50_000,
             "http://com/de/", "http://notcom/de/", "http://example.org", "http://example.org/en/2", "http://É.ORG/", "http://a.org/x", "http://a.org/x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)], "page_id int, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == len(given)
    for r in got:
        host, path = brute_url(r._c1)
        assert (r.host, r.path) == (host, path)
        fits = [(x, v) for x, v in urls.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/"):])]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert r.rule == best[0] and r.verdict in ("allow", "block") and (best[0] is None or r.verdict == best[1])
    assert urls.judge(df.limit(0)).collect() == []


def test_url_templates(spark):
    """Pages under a path that is labelled bad are rejected, those under a good one are not."""
    pages = spark.createDataFrame([(i, f"http://h.net/{kind}/{i}") for i in range(200) for kind in ("shop", "news")]
                                  + [(i, f"http://h.net/user/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}xyz/info") for i in range(100)], "page_id int, url string")
    labelled = spark.createDataFrame([(f"http://h.net/{kind}/{i}", kind == "news") for i in range(1000, 1060) for kind in ("shop", "news")], "url string, good boolean")
    got = urls.judge(pages, labelled=labelled).groupBy(F.split("path", "/")[1].alias("kind"), "verdict").count().collect()
    assert {(r.kind, r.verdict) for r in got if r.kind != "user"} == {("shop", "block"), ("news", "allow")}
    assert urls.judge(pages, labelled=labelled).where("path like '/user%'").select("template").distinct().count() == 1


def test_url_small_bad_section(spark):
    """A bad section with 4 % of a host's rows among 25 sections is not judged with the good ones."""
    kinds = [f"section{c}" for c in "abcdefghijklmnopqrstuvwxy"]
    pages = spark.createDataFrame([(i, f"http://h.net/{kind}/{i}") for i in range(20) for kind in kinds], "page_id int, url string")
    labelled = spark.createDataFrame([(f"http://h.net/{kind}/{i}", kind != "sectionc") for i in range(30) for kind in kinds], "url string, good boolean")
    got = urls.judge(pages, labelled=labelled).groupBy(F.split("path", "/")[1].alias("kind"), "verdict").count().collect()
    assert {(r.kind, r.verdict) for r in got} == {(k, "block" if k == "sectionc" else "allow") for k in kinds}


def test_url_deep_and_long_segments(spark):
    """A verdict that depends on the eighth segment, one that depends on a long segment's end, and the
    same verdicts for 20 children as for 21; a very deep path alone in its host needs no levels."""
    deep = "a/b/c/d/e/f/g"
    long = "x" * 90
    pages = [(i, f"http://h.net/{deep}/{kind}/{'pqrs'[i % 4]}") for i in range(40) for kind in ("shop", "news")]
    pages += [(i, f"http://l.net/{long}{kind}/{'pqrs'[i % 4]}") for i in range(40) for kind in ("shop", "news")]
    pages += [(0, "http://one.net/" + "z/" * 3000)]
    pages += [(i, f"http://n{n}.net/{chr(97 + k)}{kind}/v") for n in (20, 21) for k in range(n) for kind in ("shop",) for i in range(4)]
    df = spark.createDataFrame(pages, "page_id int, url string")
    labelled = spark.createDataFrame([(u, "news" in u) for _, u in pages if "shop" in u or "news" in u], "url string, good boolean")
    got = {(r.host, "shop" if "shop" in r.path else "news"): r.verdict for r in urls.judge(df, labelled=labelled).collect()}
    assert got == {("h.net", "shop"): "block", ("h.net", "news"): "allow", ("l.net", "shop"): "block", ("l.net", "news"): "allow", ("one.net", "news"): "block",  # no label of its own: the share over all hosts
                   ("n20.net", "shop"): "block", ("n21.net", "shop"): "block"}


def test_archives(spark):
    rows = [(5, "http://a/ b\n", "same"), (3, None, "same"), (9, "http://é/", None), (8, "", ""), (7, "u", "body\r\n\r\nWARC/1.1\r\n\r\nfiledesc://x 1\n"), (7, "u", "body\r\n\r\nWARC/1.1\r\n\r\nfiledesc://x 1\n"),
            (None, "n", "same"), (None, "n", "only null"), (6, "long", "ü" * 700_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("head", F.lit(1)).repartition(2)
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        body = (h or "").encode()
        f = first.get(h or "")
        want.append((p, len(body), warc.digest(body), "response" if p == f or f is None else "revisit", None if p == f else f))
    got = warc.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    large = warc.archive(df, min_bytes=5).where("record_type = 'revisit'").count()
    assert large == 0
    assert warc.archive(df.limit(0)).collect() == []


def test_arc_versions():
    for v in (1, 2):
        block = b"HTTP/1.1 200 OK\r\n\r\nx\n\ny"
        data = warc.version_block(v, "f", "20240101000000") + b"\n" + warc._line(v, "http://a/", "20240101000000", "text/html", "-", len(block)) + block + b"\n"
        (fields, body), = warc.parse_arc(data)
        assert body == block and fields["URL"] == "http://a/" and list(fields) == warc.ARC_FIELDS[v]
    with pytest.raises(ValueError):
        list(warc.parse_arc(warc.version_block(1, "f", "2024") + b"\nhttp://a/ 0 1 t 99\nshort"))


def brute_vectors(rows, cosine=0.93):
    ok = [x[1] is not None and x[2] is not None and len(x[1]) > 0 and all(c is not None and np.isfinite(c) for c in x[1]) and any(x[1]) for x in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None) if ok[i] else r[0]
        out.append((r[0], n[i], c, r[0] == c))
    return Counter(out)


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(0, 0.12, 8)).tolist(), int(i % 3)) for i in range(240)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 8, 1), (303, [None] + [1.0] * 7, 1), (304, [float("nan")] * 8, 1), (305, rows[0][1], None), (306, rows[0][1], 0),
             (306, rows[0][1], 0), (None, rows[0][1], 0), (307, (2 * np.array(rows[0][1])).tolist(), 0), (308, rows[0][1][:4], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(1))
    assert Counter(map(tuple, vectors.near_vectors(df).collect())) == brute_vectors(rows)
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_near_vectors_in_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 40)
    monkeypatch.setattr(vectors, "SHARD", 60)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(20, 16))
    rows = [(i, (base[i % 20] + rng.normal(0, 0.15, 16)).tolist(), 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
    want = {w[0]: w for w in brute_vectors(rows)}
    total = sum(w[1] for w in want.values())
    assert all(got[i].n_links <= want[i][1] for i in got) and sum(r.n_links for r in got.values()) >= 0.9 * total


def test_near_vectors_keep_all_links_of_a_shard(spark):
    """Links inside and at the edge of groups in one shard, all of which its task has computed."""
    rng = np.random.default_rng(0)
    base = rng.normal(size=(20, 16))
    x = (base[np.arange(1000) % 20] + rng.normal(0, 0.25, (1000, 16))).astype(np.float32).astype(float)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    want = (u @ u.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    assert {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()} == dict(enumerate(want.tolist()))


def test_near_vectors_between_shards(spark, monkeypatch):
    """Pairs with their ends in different shards, in data that has no clusters, and parts of shards."""
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "PART", 50)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2600, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    c, y = rng.uniform(0.931, 0.94, (400, 1)), rng.normal(size=(400, 64))
    y -= (y * x[:400]).sum(1, keepdims=True) * x[:400]
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    x = np.concatenate([x, c * x[:400] + np.sqrt(1 - c * c) * y]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert got == {k: (int(k < 400 or k >= 2600), k - 2600 if k >= 2600 else k) for k in range(3000)}


def test_near_vectors_by_shard(spark, monkeypatch):
    """Clustered data in many shards and parts: all links and components as by brute force."""
    monkeypatch.setattr(vectors, "SHARD", 20)
    monkeypatch.setattr(vectors, "PART", 15)
    rng = np.random.default_rng(13)
    base = rng.normal(size=(25, 6))
    rows = [(i, (base[i % 25] + rng.normal(0, 0.25, 6)).tolist(), int(i % 2)) for i in range(500)]
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert Counter(map(tuple, vectors.near_vectors(df).collect())) == brute_vectors(rows)


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, int(x)) for x in rng.integers(101, 200, 80)] + [(5, 5), (None, 3), (7, None), (8, 9), (8, 9)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 20 * 20 for i in range(60)) and all(got[x] == 100 for x in got if x >= 100)
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit(1)).withColumn("n_words", F.lit("x"))
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "encode":
            assert {"doc_id", "ids", "n_tokens"} <= set(out.columns)
        else:
            assert out.columns == docs.columns
        path = scratch_path(spark, "test", f"{name}-{np.random.default_rng().integers(1 << 60)}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        n = docs.count()
        if name in ("language_id", "near_dedup"):
            assert before is None or n <= before
        before = n
    assert before > 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (odd, odd.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert docs.count() == 0
