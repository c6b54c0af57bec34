"""The pipeline stage by stage against plain versions, and at its edges."""

import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from heddle.llm import bpe
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and every stage's result, each written and reread."""
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(path / name))
        docs = spark.read.parquet(str(path / name))
        out.append(docs)
    return out


def test_columns_and_order(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "repeated_substrings", "mixed_sources", "encoded"]
    assert all(df.columns == list(corpus_pipeline.COLUMNS) for df in stages[1:-1])
    assert all(df.dtypes == stages[0].dtypes for df in stages[1:-1])


def test_rules(stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    for r in stages[0].collect():
        n, _, _, _, again = brute.quality(r["text"])
        if n < 20 or 100 * again > 30 * n:
            assert r["doc_id"] not in kept
    assert len(kept) > 0.7 * stages[0].count()


def test_repeated_lines_are_cut_out(spark):
    rng = random.Random(6)
    bodies = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=40)) for _ in range(30)]
    docs = spark.createDataFrame([(i, f"Read more here\n{b}", "en", "a", len(b) + 15) for i, b in enumerate(bodies)], SCHEMA)
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.quality_rules(spark, docs, DATA).collect())
    assert got == [(i, b, len(b)) for i, b in enumerate(bodies)]


def test_one_of_each_group(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(d for d, _, _, kept in brute.near(rows, 5, 80) if kept)


def test_cut_passages(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    got = {r["doc_id"]: r for r in stages[3].collect()}
    for (d, text), (_, n, gone, kept) in zip(rows, brute.removed(rows, corpus_pipeline.WINDOW), strict=True):
        if n and n == gone:
            assert d not in got
        else:
            assert got[d]["text"] == text if not gone else brute.words(got[d]["text"]) == kept.split()
            assert got[d]["n_chars"] == len(got[d]["text"] or "")


def test_mix(stages):
    def by_source(df):
        out = {}
        for r in df.collect():
            out[r["source"]] = out.get(r["source"], 0) + len(brute.words(r["text"]))
        return out

    before, after = by_source(stages[3]), by_source(stages[4])
    want = brute.targets(before)
    longest = max(len(brute.words(r["text"])) for r in stages[3].collect())
    assert all(abs(after.get(s, 0) - want[s]) <= 1.5 * longest for s in want)
    assert {r["text"] for r in stages[4].collect()} <= {r["text"] for r in stages[3].collect()}


def test_encoded(stages):
    c = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(corpus_pipeline.VOCABULARY, public_tokenizers.PATTERN).ranks, special_tokens={})
    texts = sorted((r["doc_id"], len(c.encode_ordinary(r["text"]))) for r in stages[4].collect())
    assert sorted((r["doc_id"], r["n_tokens"]) for r in stages[5].collect()) == texts


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, got.drop("ids").collect())) == sorted(map(tuple, stages[-1].drop("ids").collect()))


def test_edges(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=80))
    same = text()
    rows = [(None, None, None, None, None), (1, same, "en", None, None), (1, same, "en", None, None), (2, same, None, "a", 3), (3, "", "en", "a", 0), (4, text(), "en", "a", 1), (None, text(), "en", "b", 1), (4, text(), "en", "b", 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", key int, hash string")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([r["doc_id"] for r in docs.collect()])
    key = lambda x: (x is None, x or 0)
    assert sorted(seen[0], key=key) == [1, 1, 2, 4, 4, None]
    assert sorted(seen[1], key=key) == sorted(seen[2], key=key) == [1, 4, 4, None]


def test_verdicts_go_by_row_not_by_id(spark):
    """Rows that share an id, or have none, are kept or go by their own text."""
    rng = random.Random(2)
    a, b, c, d = (" ".join(rng.choices([f"w{i}" for i in range(500)], k=90)) for _ in range(4))
    rows = [(2, a), (9, a), (9, b), (None, a), (None, c), (None, c + " x"), (None, d), (None, d)] + [(None, d)] * 40
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA).repartition(4)
    got = corpus_pipeline.near_duplicates(spark, docs, DATA).collect()
    assert all(tuple(r)[2:] == ("en", "a", len(r["text"])) for r in got)
    kept = sorted((r["doc_id"] or 0, r["text"][:200]) for r in got)
    assert len(kept) == 4 and kept[2:] == [(2, a[:200]), (9, b[:200])]
    assert {t for i, t in kept if i == 0} == {c[:200], d[:200]}


def test_the_mix_follows_the_schedule(spark, tmp_path):
    """Rows stand in the order of the slots that take them, so sources alternate by their weights."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=20)), "en", "abc"[i % 3], 40) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    corpus_pipeline.mixed_sources(spark, docs, DATA).write.parquet(str(tmp_path / "mix"))
    parts = sorted((tmp_path / "mix").glob("part-*"))
    found = [r["source"] for p in parts for r in spark.read.parquet(str(p)).collect()]
    share = {s: found.count(s) / len(found) for s in "abc"}
    for at in range(0, len(found) - 60, 60):
        assert all(abs(found[at : at + 60].count(s) / 60 - share[s]) < 0.12 for s in "abc")


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
