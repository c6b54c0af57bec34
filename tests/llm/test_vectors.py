"""Exact top-k and importance resampling."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heddle.llm import importance, kdtree, queries
from heddle.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


def brute(rows, asked, k):
    good = [(i, [int(x) for x in np.floor(256 * np.array(v, dtype=float))]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ((i, v) for i, v in good if i in asked):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, max(-kdtree.LONG, min(kdtree.LONG, -s))) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("shard", "block", "leaf"), [(8192, 4096, 128), (40, 3, 4)])
def test_topk(spark, monkeypatch, shard, block, leaf):
    monkeypatch.setattr(kdtree, "SHARD", shard)
    monkeypatch.setattr(kdtree, "BLOCK", block)
    monkeypatch.setattr(kdtree, "LEAF", leaf)
    rng = random.Random(1)
    common = [0.5, -0.25, 0.125]
    rows = [(i, common if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(3)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0, None, 1.0]), (203, [float("nan")] * 3), (204, [float("inf")] * 3), (None, common), (250, [1.0, 2.0]), (251, [1.0, 0.0]), (300, [1e3, -1e3, 1e3]), (-50, common)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    asked = {i for i, _ in rows if i is not None and i % 50 == 0}
    got = sorted(map(tuple, kdtree.topk(df, df.where("vec_id % 50 = 0"), Scratch(spark, "t"), 5).collect()))
    assert got == brute(rows, asked, 5)
    assert kdtree.topk(df.limit(0), df.limit(0), Scratch(spark, "t"), 5).count() == 0
    assert kdtree.topk(df, df.where("vec_id = 7777"), Scratch(spark, "t"), 5).count() == 0
    few = df.where("vec_id in (0, 1)")
    assert len(kdtree.topk(few, few, Scratch(spark, "t"), 5).collect()) == 2


def test_repeated_ids(spark):
    df = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (51, [0.5])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, kdtree.topk(df, df.where("vec_id = 50"), Scratch(spark, "t"), 5).collect()))
    assert got == [(50, 1, 51, 256 * 128)] * 2


def test_large_components_and_extra_columns(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "SHARD", 5)
    rng = random.Random(4)
    rows = [(i, [rng.choice((1e9, -1e18, 1e30, 2.0**53 + 2, -0.3, 7.5)), rng.uniform(-1, 1) * 10.0 ** rng.randint(0, 40)]) for i in range(60)]
    rows += [(70, [1e30, 1.0]), (71, [1e30, 1.0]), (72, [1e308, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, v int, region int, row string, query int")
    got = sorted(map(tuple, kdtree.topk(df, df.where("vec_id % 10 = 0"), Scratch(spark, "t"), 5).collect()))
    rows = [r for r in rows if r[0] != 72]
    assert got == brute(rows, {i for i, _ in rows if i % 10 == 0}, 5)
    assert any(abs(s) == kdtree.LONG for *_, s in got)


@pytest.mark.parametrize("common", [0, 3])
def test_regions_cover_all_and_spare_shards(spark, monkeypatch, common):
    """Clustered vectors are found without sending queries to every shard; a third may be equal."""
    monkeypatch.setattr(kdtree, "SHARD", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    v = np.repeat(centres, 75, 0) + rng.normal(size=(600, 6)) * 0.01
    rows = [(i, (centres[0] if common and i % common == 0 else x).tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scratch = Scratch(spark, "t")
    got = sorted(map(tuple, kdtree.topk(df, df.where("vec_id % 20 = 0"), scratch, 5).collect()))
    assert got == brute(rows, {i for i, _ in rows if i % 20 == 0}, 5)
    shards = spark.read.parquet(scratch.at("boxes")).agg(F.sum("shards")).first()[0]
    sent = spark.read.parquet(scratch.at("far")).count()
    assert shards >= 12 and sent < 30 * (shards - 1) / 2


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 4)) * 400
    v = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(4000, 4)))
    tree = kdtree.Tree(v, np.arange(4000))
    assert (tree.low[0] == v.min(0)).all() and (tree.high[0] == v.max(0)).all()
    for q in v[::400]:
        best = tree.search(q, kdtree.bounds(tree.low, tree.high, q[None])[0], -1, 5, float("-inf"))
        assert sorted(s for s, _ in best) == sorted((v @ q).astype(int).tolist())[-5:]


def test_topk_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.op5_topk(spark, DATA).collect()))
    assert got == brute(rows, {i for i, _ in rows if i % 50 == 0}, 5)


def test_importance_edges(spark):
    rows = [(i, "good words here " * 5) for i in range(20)] + [(20 + i, "bad junk stuff " * 5) for i in range(20)] + [(None, None), (50, ""), (51, " "), (1, "good words here " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = importance.resample(df, good, Scratch(spark, "t"), 0.5).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == round(len(rows) * 0.5)
    weight = {r["doc_id"]: r["weight"] for r in got}
    assert weight[15] > weight[25] and weight[None] == weight[50] == weight[51] == 0
    assert sum(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 20) >= 18
    kept = sorted((r["key"] for r in got if r["kept"]), reverse=True)
    assert kept == sorted((r["key"] for r in got), reverse=True)[: len(kept)]
    none = importance.resample(df, good.limit(0), Scratch(spark, "t"), 0.5).collect()
    assert {r["weight"] for r in none} == {0}
    assert importance.resample(df.limit(0), good, Scratch(spark, "t")).count() == 0
    assert not any(r["kept"] for r in importance.resample(df, good, Scratch(spark, "t"), 0.0).collect())
    assert all(r["kept"] for r in importance.resample(df, good, Scratch(spark, "t"), 1.0).collect())


def plain_resample(rows, good, share, seed):
    """(doc_id, weight, key) and the number drawn, by dictionaries."""

    def grams(text):
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def bucket(gram):
        data = np.frombuffer(gram.encode(), np.uint8)
        return int(importance.grams(data, np.array([0, len(data)]))[0][-1])  # of the pair, if it is one

    target, raw = Counter(), Counter()
    for i, text in rows:
        found = Counter(map(bucket, grams(text)))
        raw += found
        if i in good:
            target += found
    smooth = {b: 1 + raw[b] / max(sum(raw.values()), 1) * importance.BUCKETS for b in range(importance.BUCKETS)}
    t, r = sum(target.values()) + sum(smooth.values()), sum(raw.values()) + importance.BUCKETS
    ratio = {b: math.log((target[b] + smooth[b]) / t) - math.log((raw[b] + 1) / r) if target else 0 for b in smooth}
    out = []
    for i, text in rows:
        found = grams(text)
        weight = sum(ratio[bucket(g)] for g in found) / max(len(found), 1) * importance.SCALE
        start = 42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), start)
        u = (h % (1 << 30) + 0.5) / (1 << 30)
        out.append((i, weight, weight - math.log(-math.log(u))))
    return out, round(len(rows) * share)


@pytest.mark.parametrize("limit", [1 << 20, 3])
def test_importance_is_the_plain_one(spark, monkeypatch, limit):
    monkeypatch.setattr(importance, "RANGE", limit)
    rng = random.Random(3)
    words = ["Alpha", "beta", "gamma", "dELTA", "épsilon", "zeta9", "eta,"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 5]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(None, "beta gamma")] * 60 + [(500, None), (501, " \t"), (502, "beta " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, bin int, row string")
    good = set(range(0, 120, 5))
    for share in (0.2, 0.5, 0.8):
        want, n = plain_resample(rows, good, share, 7)
        got = importance.resample(df, spark.createDataFrame([(i,) for i in good], "doc_id long"), Scratch(spark, "t"), share, 7).collect()
        order = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert [(r["doc_id"], r["weight"], r["key"]) for r in sorted(got, key=order)] == [(i, pytest.approx(w), pytest.approx(x)) for i, w, x in sorted(want, key=order)]
        first = sorted(want, key=lambda r: (-round(r[2], 6), r[0] is not None, r[0] or 0))[:n]
        assert Counter(r["doc_id"] for r in got if r["kept"]) == Counter(i for i, *_ in first)


def test_noise_draws_by_weight(spark):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    got = importance.resample(df, df.limit(0), Scratch(spark, "t"), 0.3, seed=3).agg(F.count_if("kept"), F.avg("key")).first()
    assert got[0] == round(0.3 * n) and abs(got[1] - 0.5772) < 0.1


def test_importance_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    train = labels.where("doc_id % 2 = 0 and quality = 1")
    got = importance.resample(docs, train, Scratch(spark, "t")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = (got[got.quality == q].weight.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.95
