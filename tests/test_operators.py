"""Retrieval, matching, reranking, backfill and routes on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from heddle.functions.models import HashEncoder
from heddle.operators import backfill, kernel, matching, reranking, retrieval
from heddle.plans import api, fixtures
from heddle.sources import tables
from heddle.streaming import backfill as stream

DATA = "/root/testdata/sf0.001"


def test_kernel_is_the_expressions(spark):
    jobs, cvs = fixtures.jobs(spark, DATA).where("id < 60"), fixtures.cvs(spark, DATA)
    a = retrieval.search(jobs, cvs, 7).collect()
    b = {(r["source_id"], r["rank"]): r for r in retrieval.search_by_expressions(jobs, cvs, 7).collect()}
    assert len(a) == len(b) > 50
    for r in a:
        other = b[r["source_id"], r["rank"]]
        assert r["candidate_id"] == other["candidate_id"]
        assert r["final_score"] == pytest.approx(other["final_score"], abs=1e-12)


def test_blocks_dont_matter(spark, monkeypatch):
    jobs, cvs = fixtures.jobs(spark, DATA), fixtures.cvs(spark, DATA)
    whole = {tuple(r)[:2] + (r["rank"],) for r in retrieval.search(jobs, cvs, 3).collect()}
    monkeypatch.setattr(kernel, "SOURCES", 50)
    monkeypatch.setattr(kernel, "CANDIDATES", 70)
    assert {tuple(r)[:2] + (r["rank"],) for r in retrieval.search(jobs, cvs, 3).collect()} == whole


def test_what_leaves_the_kernel_grows_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(kernel, "SOURCES", 20)
    monkeypatch.setattr(kernel, "CANDIDATES", 20)
    monkeypatch.setattr(retrieval, "ranked", lambda found, most: found)
    rows = fixtures.halves(spark, DATA).where("id < 200")
    rows = [rows, rows.union(rows.withColumn("id", F.col("id") + 1000)).union(rows.withColumn("id", F.col("id") + 2000)).union(rows.withColumn("id", F.col("id") + 3000))]
    small, large = (retrieval.search(x, x, 3).count() for x in rows)
    assert small and large <= 4 * small  # 16 times, if every block of 20 candidates left its own best rows


@pytest.mark.parametrize(("sources", "tasks"), [(1, 24), (250, 8), (5_000, 24), (300_000, 24), (3_000_000, 24), (300_000, 2000)])
def test_grid(sources, tasks):
    s, c = kernel.grid(sources, tasks)
    assert s * c >= tasks and sources / s <= kernel.HELD and c <= max(tasks, 1)
    if 24 * kernel.LEAST <= sources <= 12 * kernel.HELD:
        assert (s, c) == kernel.grid(24 * kernel.LEAST, tasks) or tasks > 24


def test_copies_come_by_id(spark, monkeypatch):
    monkeypatch.setattr(kernel, "CANDIDATES", 30)
    rows = fixtures.halves(spark, DATA)
    copies = [rows.where(f"id = {i}").withColumn("id", F.explode(F.sequence(F.lit(1000 * i), F.lit(1000 * i + 80)))) for i in (1, 2, 3)]
    zero = rows.where("id = 4").withColumn("problem_dense", F.transform("problem_dense", lambda x: F.lit(0.0).cast("float"))).withColumn("id", F.explode(F.sequence(F.lit(5000), F.lit(5070))))
    every = rows.where("id < 40").union(copies[0]).union(copies[1]).union(copies[2]).union(zero)
    got = retrieval.search(rows.where("id < 20"), every, 50).collect()
    for i in {r["source_id"] for r in got}:
        mine = sorted((r for r in got if r["source_id"] == i), key=lambda r: r["rank"])
        assert [r["candidate_id"] for r in mine] == list(range(5000, 5050))
    got = retrieval.search(rows.where("id < 20"), every.where("id < 5000"), 50).orderBy("source_id", "rank").collect()
    want = retrieval.search_by_expressions(rows.where("id < 20"), every.where("id < 5000"), 50).orderBy("source_id", "rank").collect()
    assert [(r["source_id"], r["candidate_id"], r["rank"]) for r in got] == [(r["source_id"], r["candidate_id"], r["rank"]) for r in want]


def test_search_edges(spark):
    schema = f"id string, problem_dense array<float>, problem_sparse {tables.sparse.TYPE}, capability_dense array<float>, capability_sparse {tables.sparse.TYPE}"
    e = ([], [])
    rows = [("a", [1.0, 0.0], e, [1.0, 0.0], e), ("b", [1.0, 0.0], e, [1.0, 0.0], e), ("z", [0.0, 0.0], e, [1.0, 0.0], e), ("n", [1.0, 0.0], None, [1.0, 0.0], e), ("m", None, e, [1.0, 0.0], e)]
    df = spark.createDataFrame(rows, schema)
    found = retrieval.search(df, df, 10).orderBy("source_id", "rank").collect()
    by = {}
    for r in found:
        by.setdefault(r["source_id"], []).append(r["candidate_id"])
    # a source may lack sparse vectors, a candidate may not; a zero vector scores NaN, which is above the floor and first
    assert by["a"] == ["z", "a", "b"] and by["n"] == ["z", "a", "b"] and "m" not in by
    assert all(math.isnan(r["final_score"]) for r in found if r["candidate_id"] == "z")
    assert retrieval.search(df.limit(0), df, 5).count() == 0


def test_sign(spark):
    schema = f"id int, problem_dense array<float>, problem_sparse {tables.sparse.TYPE}, capability_dense array<float>, capability_sparse {tables.sparse.TYPE}"
    s = ([3], [1.0])
    df = spark.createDataFrame([(1, [1.0], s, [1.0], s)], schema)
    minus = retrieval.search(df, df, 1).first()
    plus = retrieval.search(df, df, 1, retrieval.Weights(sign=1)).first()
    assert minus["problem_score"] == pytest.approx(0.6) and plus["problem_score"] == pytest.approx(1.0)
    assert minus["capability_score"] == pytest.approx(0.0) and plus["capability_score"] == pytest.approx(1.0)


@pytest.mark.parametrize(("asked", "want"), [((), (50, 20)), ((10,), (10, 10)), ((None, None, 5), (5, 5)), ((30, 40), (30, 30)), ((100, None, 7), (100, 7))])
def test_limits(asked, want):
    assert retrieval.limits(*asked) == want


def chunks(spark, rows):
    return spark.createDataFrame(rows, "id int, parent int, content string, vec array<float>, idx int")


def test_ties_of_matches(spark):
    r = chunks(spark, [(1, 7, "r", [1.0, 0.0], 0)])
    e = chunks(spark, [(10, 8, "a", [1.0, 1.0], 0), (11, 8, "b", [1.0, 0.1], 1), (12, 8, "c", [1.0, 0.1], 2), (13, 8, "d", [0.0, 0.0], 3), (14, 8, "", [1.0, 0.0], 4), (15, 8, "x", None, 5)])
    pairs = spark.createDataFrame([(7, 8), (7, 9)], "job int, cv int")
    scored = matching.similarities(pairs, r, e)
    assert scored.count() == 4
    assert matching.best(scored).first()["exp_id"] == 11
    assert [x["exp_id"] for x in matching.top(scored).orderBy("place").collect()] == [12, 11, 10]
    assert [x["exp_id"] for x in matching.top(scored, consistent=True).orderBy("place").collect()] == [11, 12, 10]
    report = matching.report(pairs, r, e).first()
    assert report["total"] == 1 and report["well_count"] == 1 and report["total_experiences"] == 4
    assert report["responsibility_matches"][0]["best_match"]["experience_content"] == "b"
    assert report["well_matched_responsibilities"][0]["best_experience_chunk_id"] == 11


def test_ragged_vectors_raise(spark):
    r = chunks(spark, [(1, 7, "r", [1.0, 0.0], 0)])
    e = chunks(spark, [(1, 7, "r", [1.0], 0)])
    with pytest.raises(Exception, match="different lengths"):
        matching.similarities(spark.createDataFrame([(7, 7)], "job int, cv int"), r, e).count()


def test_rerank_keeps_retrieval_order_of_ties(spark):
    found = spark.createDataFrame([(1, c, 0.5, 0.5, 0.5, n) for n, c in enumerate((9, 8, 7), 1)], "source_id int, candidate_id int, problem_score double, capability_score double, final_score double, rank long")
    s = spark.createDataFrame([(1, "a b c")], "id int, problem_text string")
    c = spark.createDataFrame([(9, "x"), (8, None), (7, "a b")], "id int, problem_text string")
    got = reranking.rerank(found, s, c, 2)
    assert [r["candidate_id"] for r in got.orderBy("position").collect()] == [9, 8]
    out = reranking.results(found, reranking.rerank(found, s, c, 3)).first()
    assert (out["total_retrieved"], out["total_reranked"], [i["id"] for i in out["items"]]) == (3, 3, ["7", "9", "8"])


def test_rerank_caps_texts_below_its_joins(spark):
    found = spark.createDataFrame([(1, 9, 0.5, 0.5, 0.5, 1)], "source_id int, candidate_id int, problem_score double, capability_score double, final_score double, rank long")
    t = spark.createDataFrame([(1, "a" * 9), (9, "a" * 9)], "id int, problem_text string")
    plan = reranking.rerank(found, t, t, 5, max_chars=4)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join LeftOuter") :]
    assert "substring(" not in plan.removesuffix(joined) and joined.count("substring(") == 2


def test_backfill_binding_and_rejects(spark, tmp_path):
    class Broken(HashEncoder):
        def encode(self, texts):
            return [([float("nan")] * 64, {}) if "bad" in t else x for t, x in zip(texts, super().encode(texts), strict=True)]

    schema = tables.PARENT
    rows = [("1", "title one", "text", "cap", None, None, None, None), ("2", "t", "", "cap", None, None, None, None), ("3", "bad", "text", "cap", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    good, bad = backfill.embed_rows(df, Broken)
    assert [r["id"] for r in good.collect()] == ["1"] and [(r["id"], r["reason"]) for r in bad.collect()] == [("3", "vector")]
    shifted = good.first()["problem_dense"]
    assert shifted == pytest.approx(HashEncoder().encode(["title one"])[0][0])
    meant, _ = backfill.embed_rows(df.where("id = 1"), HashEncoder, "intended")
    assert meant.first()["problem_dense"] == pytest.approx(HashEncoder().encode(["text"])[0][0])
    assert backfill.store(df, good, backfill.VECTORS, str(tmp_path / "v2")) == 1
    assert spark.read.parquet(str(tmp_path / "v2")).where("problem_dense is not null").count() == 1


def test_stream_reads_each_row_once(spark, tmp_path):
    rows = fixtures.backlog(spark, DATA).withColumn("id", F.col("id").cast("string"))
    rows.write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("in", "updates", "rejected", "checkpoint")]
    for _ in range(2):
        stream.start(spark, paths[0], rows.schema, *paths[1:]).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == backfill.pending(rows).count()


def test_chunk_stream(spark, tmp_path):
    rows = fixtures.chunk_backlog(spark, DATA).withColumn("id", F.col("id").cast("string"))
    rows.write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("in", "updates", "rejected", "checkpoint")]
    for _ in range(2):
        stream.start_chunks(spark, paths[0], rows.schema, *paths[1:]).awaitTermination()
    assert spark.read.parquet(paths[1]).count() == backfill.pending_chunks(rows).count()


def test_a_failing_table_leaves_the_others(spark, tmp_path):
    good = fixtures.backlog(spark, DATA)
    done = backfill.run_all({"jobs": good, "broken": good.drop("title"), "cvs": good.limit(0)}, str(tmp_path))
    assert done["jobs"] == {"processed": backfill.pending(good).count(), "error": None} and done["cvs"]["processed"] == 0
    assert done["broken"]["processed"] == 0 and "title" in done["broken"]["error"]
    assert done["total"]["processed"] == done["jobs"]["processed"]
    assert spark.read.parquet(str(tmp_path / "jobs")).count() == good.count()


def test_nothing_passes_the_floor(spark):
    texts = fixtures.texts(spark, DATA)
    jobs, cvs = (f(spark, DATA).join(texts, "id", "left") for f in (fixtures.jobs, fixtures.cvs))
    (row,) = api.find_top_candidates("job", 4, jobs, cvs.limit(0)).collect()
    assert (row["total_retrieved"], row["total_reranked"], row["items"]) == (0, 0, [])


def test_settings(spark, monkeypatch):
    assert api.Settings.of(spark) == api.Settings()
    monkeypatch.setenv("HEDDLE_EMBED_BATCH", "3")
    spark.conf.set("spark.heddle.max_chars", "4")
    try:
        s = api.Settings.of(spark)
        assert (s.embed_batch, s.max_chars) == (3, 4)
        df = spark.createDataFrame([("abcd efgh",)], "text string")
        whole, capped = (api.embed(df, normalize=False, return_sparse=x).first()["dense"] for x in (False, True))
        assert sum(map(abs, whole)) == 2 and sum(map(abs, capped)) == 1
    finally:
        spark.conf.unset("spark.heddle.max_chars")


def test_best_of_a_block():
    import numpy as np

    from heddle.operators import kernel

    rng = np.random.default_rng(1)
    for most in (1, 3, 50):
        score = rng.integers(0, 5, (20, 30)).astype(float)
        score[rng.random(score.shape) < 0.1] = np.nan
        passed, ids = rng.random(score.shape) < 0.6, rng.permutation(30)
        r, c = kernel.best(score, passed, ids, most)
        for i in range(20):
            want = sorted(np.flatnonzero(passed[i]).tolist(), key=lambda j: (not np.isnan(score[i, j]), -score[i, j] if score[i, j] == score[i, j] else 0, ids[j]))[:most]
            assert c[r == i].tolist() == want


def test_status_of_an_empty_table(spark):
    row = backfill.status({"none": spark.createDataFrame([], tables.PARENT)}).first()
    assert (row["total"], row["completed_percent"], row["pending_percent"]) == (0, 0.0, 0.0)


def test_sources(spark):
    df = spark.createDataFrame([("[1,2]", "{1:0.5}/30522")], "a_dense_vector string, b_sparse_vector string")
    assert tables.sparse_form(df) == "text" and [n for n, _ in tables.vector_columns(df)] == ["a_dense_vector", "b_sparse_vector"]
    out = tables.decoded(df, ("a_dense_vector",), ("b_sparse_vector",))
    assert tables.sparse_form(out) == "json"
    row = tables.encoded(out, sparse_columns=("b_sparse_vector",)).first()
    assert row["b_sparse_vector"] == "{1:0.500000}/30522"
    with pytest.raises(ValueError):
        tables.read_jdbc(spark, None, "select 1")


def test_routes(spark):
    texts = fixtures.texts(spark, DATA)
    jobs, cvs = (f(spark, DATA).join(texts, "id", "left") for f in (fixtures.jobs, fixtures.cvs))
    out = api.find_top_candidates("job", 4, jobs, cvs, 10, 5).collect()
    assert out and out[0]["total_reranked"] <= 5 and out[0]["total_retrieved"] <= 10
    for bad in (("x", 4), ("job", None)):
        with pytest.raises(api.InvalidRequest):
            api.find_top_candidates(*bad, jobs, cvs)
    with pytest.raises(api.InvalidRequest):
        api.find_top_candidates("job", 4, jobs, cvs, 201)
    with pytest.raises(api.NotFound):
        api.find_top_candidates("cv", -1, jobs, cvs)
    r, e = fixtures.responsibilities(spark, DATA), fixtures.experiences(spark, DATA)
    assert api.semantic_match(3, 3, r, e).first()["total"] == 10
    with pytest.raises(api.NotFound):
        api.semantic_match(3, -1, r, e)
    made = api.embed(spark.createDataFrame([("a b",)], "text string"), return_sparse=True).first()
    assert made["dim"] == 64 and sum(x * x for x in made["dense"]) == pytest.approx(1, abs=1e-6)
    with pytest.raises(api.InvalidRequest):
        api.embed(spark.createDataFrame([], "text string"))
    assert api.engine_info()["fp16"] is False
    skills = spark.createDataFrame([(["a", "b"], ["b", "c"])], "need array<string>, have array<string>")
    row = api.explain_skills(skills, "need", "have").first()
    assert (row["matched"], row["missing"], row["coverage"], row["critical_gap"]) == (["b"], ["a"], 0.5, True)
