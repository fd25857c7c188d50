"""Spelling variants: words that differ by one character, grouped under their commonest form.

A word's letters, counted, are a binary vector: one dimension for each letter and
occurrence (the second ``e`` is another dimension than the first). One replaced
character moves two dimensions, one inserted or deleted character moves one. Near
words are found by partition and enumeration: the dimensions are dealt to
parts, and a signature is the exact content of all parts but as many as the
distance allows to differ, so vectors within the distance share one:

* words of equal length, distance 2: ``EQUAL`` parts, each choice of two left out;
* lengths that differ by one, distance 1: ``LONGER`` parts, each one left out.

Signatures hold the length, are hashed to 64 bits and joined by equality; the
join's condition verifies each pair (distances of letter and bigram masks, which
never exceed the true ones, then the edit distance), so only near words leave it.

A signature shared by more than ``HOT`` words would be compared pair by pair. Its
words get a finer key besides: the word with one position left out, a row for each
position. Near words share that key, and few others do. Nothing is capped.

Nulls: a null text has no words; a null id counts as empty text in the checksum.
Repeated rows count again, ties go to the smaller word, texts and words may be of
any length, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import written

#: Maximal runs of these characters, after lower-casing A-Z.
RUN = "[a-zÀ-ÿ]+"
EVERY, LENGTH, TIMES, RATIO = 199, 6, 5, 5
EQUAL, LONGER = 5, 3
HOT = 256


def _a_to_z(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``LENGTH`` characters that occur ``TIMES`` times or more, after
    one character went from each run whose checksum with the document's id ``EVERY`` divides."""
    run = (docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(_a_to_z(F.col(text)), F.lit(RUN), F.lit(0))).alias("run"))
           .withColumn("size", F.char_length("run")).where(F.col("size") >= LENGTH)
           .withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run"))))
    at = (F.col("h") % F.col("size")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.col("size")))
    word = F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run"))
    return (run.select(word.alias("word"), "size", "h").where((F.col("size") > LENGTH) | (F.col("h") % EVERY != 0))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES))


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "big", signed=True)


def letters(word: str) -> list[tuple[str, int]]:
    """The dimensions that are 1: each letter with the number of its occurrence."""
    seen: dict[str, int] = {}
    out = []
    for c in word:
        seen[c] = k = seen.get(c, -1) + 1
        out.append((c, k))
    out.sort()
    return out


def signatures(word: str, parts: int, distance: int) -> Iterator[int]:
    """Partition and enumeration: words whose letters differ in ``distance`` dimensions at most share one."""
    content = [""] * parts
    for c, k in letters(word):
        content[(ord(c) + 3 * k) % parts] += c
    for out in combinations(range(parts), distance):
        yield _hash(str(out), *(x for i, x in enumerate(content) if i not in out))


def mask(items) -> int:
    m = 0
    for x in items:
        m |= 1 << (hash_of(x) & 63)
    return m - (1 << 64) if m >> 63 else m


def hash_of(x) -> int:
    a, b = x
    return (ord(a) * 31 + (b if isinstance(b, int) else ord(b) * 7)) * 0x9E3779B1 >> 7


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n", "letters", "bigrams", "role", "signature"]
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            rows = []
            for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist(), strict=True):
                head = (word, n, mask(letters(word)), mask(zip(word, word[1:], strict=False)))
                size = len(word)
                rows += [(*head, 0, s ^ size) for s in signatures(word, EQUAL, 2)]
                for s in signatures(word, LONGER, 1):
                    rows += [(*head, 1, s ^ size), (*head, 2, s ^ (size - 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.int64()), strict=True)], names)


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for every key "the word without position i" that a near word can share. A word in
    the role of the shorter (1) is the key itself; keys are checksums of what stands before and after."""
    for b in batches:
        where, keys = [], []
        for i, (word, role) in enumerate(zip(b.column("word").to_pylist(), b.column("role").to_pylist(), strict=True)):
            raw = [c.encode() for c in word]
            before, after = [0], [0]
            for c in raw:
                before.append(zlib.crc32(c, before[-1]))
            for c in reversed(raw):
                after.append(zlib.crc32(c, after[-1]))
            n = len(raw)
            # role 0: equal lengths, so the position counts. Roles 1 and 2: the shorter word cut at every place.
            own = {(k, before[k], after[n - k - (role != 1)]) for k in range(n + (role == 1))}
            for k, x, y in own:
                where.append(i)
                keys.append(((x << 32 | y) ^ (k * 0x9E3779B97F4A7C15)) & 0x7FFFFFFFFFFFFFFF)
        rows = b.take(pa.array(where, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.int64())], [*b.schema.names, "gap"])


def _near(rows: DataFrame, by: list[str]) -> DataFrame:
    """``(a, b, a_n, b_n)``: near words among rows that share ``by``; the condition verifies in the join."""
    a, b = rows.alias("a"), rows.alias("b")
    shared = F.lit(True)
    for c in by:
        shared = shared & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    both = (((F.col("a.role") == 0) & (F.col("b.role") == 0) & (F.col("a.word") < F.col("b.word"))) | ((F.col("a.role") == 1) & (F.col("b.role") == 2)))
    verified = (both & (F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters"))) <= 2)
                & (F.bit_count(F.col("a.bigrams").bitwiseXOR(F.col("b.bigrams"))) <= 4)
                & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    return a.join(b, shared & verified).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"))


def near_words(words: DataFrame) -> DataFrame:
    """All pairs ``(a, b, a_n, b_n)`` of ``words`` (``word``, ``n``; words distinct) that differ by one character, each once."""
    rows = written(words.mapInArrow(_enumerate, "word string, n long, letters long, bigrams long, role byte, signature long"), "signatures")
    hot = written(rows.groupBy("signature").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT).select("signature"), "hot")
    plain = _near(rows.join(hot, "signature", "left_anti"), ["signature"])
    finer = rows.join(hot, "signature", "left_semi").mapInArrow(_gaps, "signature long, word string, n long, letters long, bigrams long, role byte, gap long")
    return written(plain.unionByName(_near(finer, ["signature", "gap"])).distinct(), "near")


def variants(words: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``words`` (``word``, ``n``; written, words distinct)."""
    near = near_words(words)
    both = near.select("a", "b", "b_n").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    first = F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")))
    linked = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), first.alias("top"))
    out = words.join(linked, "word", "left")
    is_form = -F.col("top.n") >= RATIO * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                             F.when(is_form, F.col("top.word")).alias("form"), F.when(is_form, -F.col("top.n")).alias("form_n")), "forms")
    # n grows fivefold along forms, so chains are short; each round doubles the steps taken
    to = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = to.alias("t").join(to.select(F.col("word").alias("w"), F.col("root").alias("next")), F.col("t.root") == F.col("w"), "left")
        after = written(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = after.select("word", "root")
        if after.where("moved").isEmpty():
            break
    return (out.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(written(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "words"))


#: Checksums by their definition (a table of 256 remainders), near words by leaving out each position.
SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS r
    FROM range(256) g(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
seen AS (
  SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, count(*) AS k
  FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2),
           lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS h FROM seen, crc),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
         ELSE run END AS word, k FROM summed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
         FROM words, unnest(range(1, length(word) + 1)) u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b
    ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top_n FROM near GROUP BY word),
tops AS (
  SELECT b.word, min(other) AS top FROM best b JOIN near n ON n.word = b.word AND n.other_n = b.top_n GROUP BY b.word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * w.n THEN top END AS form,
         CASE WHEN top_n >= 5 * w.n THEN top_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN tops t ON t.word = w.word),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next WHERE c.next IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
