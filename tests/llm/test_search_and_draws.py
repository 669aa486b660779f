"""Resampling, spelling variants and nearest neighbours against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from formlens.llm import neighbours, resampling, variants
from tests.llm.test_operators import by_sql, collected, folder, rows  # noqa: F401

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def drawn(texts, target, orders, buckets, percent, min_words):
    """(doc_id, text) and n_features, weight, score, rank of each row, by plain loops."""

    def of(text):
        words = WORD.findall(low(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in orders for i in range(len(words) - n + 1)]

    s, t = Counter(b for _, x in texts for b in of(x)[1]), Counter(b for x in target for b in of(x)[1])
    big, small = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big / ((s[b] + 1) * small))) for b in s}
    out, may = [], []
    for doc_id, text in texts:
        words, found = of(text)
        digest = hashlib.md5((text or "").encode()).hexdigest()
        h = int(hashlib.sha256(f"2024:{doc_id if doc_id is not None else 'text:' + digest}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if len(words) >= min_words:
            may.append((-score, doc_id is None, doc_id or 0, digest, len(out) - 1))
    for place, x in enumerate(sorted(may)[: percent * len(may) // 100], 1):
        out[x[-1]][4] = place
    return sorted(map(tuple, out), key=str)


def test_resampling_is_its_sql(spark, folder, rows):  # noqa: F811
    path = folder([*rows, *[(i % 40, f"word{i % 7} " * (i % 30), "s") for i in range(300)], *[(None, "the same one " * 9, None)] * 200])
    assert collected(resampling.op11_target_resampling(spark, path)) == by_sql(path, resampling.OP11_SQL)


@pytest.mark.parametrize("orders", [(1,), (1, 2, 3), (2,), (3, 4)])
def test_resampling_by_orders(spark, docs, orders):
    rng = random.Random(3)
    texts = [(i if i % 9 else None, " ".join(rng.choice("a Bb ccc d1 é 日本 x".split()) for _ in range(rng.randrange(40)))) for i in range(150)]
    texts += [(1, None), (2, ""), (3, "one"), (5, "a b c"), (5, "a b c"), *[(None, "hot text of words " * 8)] * 60]
    target = ["a Bb ccc x x x", None, "日本 é d1 " * 5]
    frame = docs([(i, t, "s") for i, t in texts], "").withColumns({"digest": F.lit("d"), "rank": F.lit(1), "copies": F.lit(5), "score": F.lit("x")}).repartition(5)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    found = resampling.ranked(resampling.scored(frame, asked, orders, buckets=50), percent=30, min_words=6)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()]
    assert sorted(got, key=str) == drawn(texts, target, orders, 50, 30, 6)


def test_resampled_rows_keep_their_columns(spark, docs):
    frame = docs([(i, f"plain words number {i % 4} " * 6, "s") for i in range(60)] + [(None, None, None)]).withColumn("rank", F.lit(7))
    got = resampling.resampled(frame, frame.filter("doc_id % 4 = 1"), percent=25, min_words=10)
    assert got.columns == frame.columns and got.count() == 60 * 25 // 100
    assert resampling.resampled(frame.limit(0), frame).count() == 0
    assert resampling.resampled(frame, frame.limit(0), min_words=10).count() == 6


def test_variants_are_their_sql(spark, folder, rows):  # noqa: F811
    rng = random.Random(8)
    base = ["spelling", "variant", "größeren", "niñería", "letters", "aaaaaaa", "abababab"]

    def slip(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aéz") + w[i:], w[:i] + rng.choice("aöz") + w[i + 1 :]])

    some = [(i, " ".join(rng.choice(base) if rng.random() < 0.8 else slip(rng.choice(base)) for _ in range(200)) + " UPPER Spelling ×÷×÷×÷ x", "s") for i in range(60)]
    path = folder([*rows, *some, *[(None, "Spelling speling " * 9, None)] * 30])
    got = collected(variants.op12_spelling_variants(spark, path))
    assert got == by_sql(path, variants.OP12_SQL) and len(got) > 100


def test_deletion_keys_are_those_of_the_strings():
    import pyarrow as pa

    words = ["banana", "aab", "abb", "", "é", "a\U0001f642b", "baanana", "ab", "x" * 500, "x" * 499]
    row, keys = variants.deletion_keys(pa.array(words))
    of = {}
    for w, k in zip(row.tolist(), keys.tolist(), strict=True):
        of.setdefault(w, []).append(k)
    strings = [[w, *{w[:i] + w[i + 1 :] for i in range(len(w))}] for w in words]
    assert [len(of[i]) for i in range(len(words))] == [len(x) for x in strings]
    for i, a in enumerate(strings):
        for j, b in enumerate(strings):
            assert bool(set(of[i]) & set(of[j])) == bool(set(a) & set(b)), (words[i], words[j])


def test_near_words_of_long_runs_and_long_chains(spark):
    chain = ["steps" + "a" * i for i in range(1, 9)]
    counts = {w: 6**i for i, w in enumerate(chain, 1) if i < 5} | {w: 5 for w in chain[4:]}
    long = "lorem" * 3000
    counts |= {long: 25, long + "x": 5, long[:7000] + "q" + long[7001:]: 5, long[1:] + "zz": 5}
    found = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)], "word string").repartition(3)
    got = {r.word: r for r in variants.variants(found).collect()}
    assert got.keys() == counts.keys()
    assert (got[chain[0]].root, got[chain[0]].form, got[chain[3]].form, got[chain[3]].root) == (chain[3], chain[1], None, chain[3])
    assert (got[long].n_near, got[long + "x"].root, got[long[1:] + "zz"].n_near) == (2, long, 0)
    assert variants.variants(found.limit(0)).count() == 0


def nearest(vectors, k, every):
    out = {}
    for q, a in vectors:
        if q % every == 0:
            scores = sorted((math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))), i) for i, b in vectors if i != q and len(a) == len(b))[:k]
            out[q] = [(i, pytest.approx(s, rel=1e-12)) for s, i in scores]
    return out


@pytest.mark.parametrize(("kind", "shard_bytes"), [("float", neighbours.SHARD_BYTES), ("double", 600), ("int", 300)])
def test_neighbours_of_few_odd_vectors(spark, kind, shard_bytes):
    rng = random.Random(4)
    number = (lambda: float(np.float32(rng.gauss(0, 1)))) if kind != "int" else lambda: rng.randrange(-9, 9)
    whole = 3 if kind == "int" else 3.0
    rows_ = [(i, [number() for _ in range(4 if i % 3 else 5)]) for i in range(1, 120)] + [(i, [whole, whole, whole, whole]) for i in range(200, 260)]
    rows_ = [(i, v) for i, v in rows_ if any(v)]
    odd = [(None, rows_[0][1]), (300, None), (305, []), (310, [0 * whole] * 4), (315, [None, *rows_[0][1][1:]]), rows_[7], rows_[7], (320, [whole] * 9)]
    odd += [(325, [float("nan"), 1.0, 1.0, 1.0]), (330, [float("inf"), 1.0, 1.0, 1.0])] if kind != "int" else []
    frame = spark.createDataFrame([(*r, 1) for r in rows_ + odd], f"vec_id bigint, embedding array<{kind}>, score int").repartition(4)
    frame = frame.withColumns({"dim": F.lit("x"), "shard": F.lit(1)})
    vectors = neighbours.vectors_of(frame).cache()
    found = neighbours.searched(neighbours.index_of(vectors, 7, shard_bytes), vectors.filter("vec_id % 5 = 0"), 7, block=4)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got == nearest(rows_, 7, 5)


def test_neighbours_of_many_vectors_are_found(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    vectors = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))).astype(np.float32)
    vectors[100:900] = vectors[100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").repartition(4)
    table = neighbours.vectors_of(frame).cache()
    index = neighbours.index_of(table, shard_bytes=2000 * 24 * 8).cache()
    assert index.count() == 3 and index.selectExpr("sum(sizes[0])").first()[0] == 6000 - 799
    found = {}
    for r in neighbours.searched(index, table.filter("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 50):
        d = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(6000), d)) if i != q][:10]
        hits += len(found[q] & set(order))
        if 100 <= q < 900:
            assert found[q] == set(order)
    assert hits / (120 * 10) >= 0.95


def test_neighbours_of_large_numbers(spark):
    frame = spark.createDataFrame([(i, [2.0**120 * i, 2.0**120]) for i in range(1, 300)], "vec_id bigint, embedding array<double>")
    table = neighbours.vectors_of(frame)
    got = neighbours.searched(neighbours.index_of(table), table.filter("vec_id = 100"), 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [99, 101, 98, 102]
