"""Licences, quality rules, substrings, near-duplicates and mixing against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from heddle.llm import components, licenses, mixing, neardup, quality, queries, substrings
from heddle.llm.scratch import Scratch
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
EDGES = [(None, "a b"), (1, None), (2, ""), (3, "  \n"), (4, "a"), (4, "a"), (5, "x " * 5000), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def mixed(rng, base, n, alphabet):
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            x = rng.randint(0, len(b) - 1)
            w += b[x : x + rng.randint(1, 30)] + rng.choices(alphabet, k=rng.randint(0, 8))
        rows.append((rng.choice([i, i, i, None, 7]), " ".join(w)))
    return rows


# ---- licences


def test_licenses(spark):
    rng = random.Random(1)
    parts = ["under", "the", "MIT", "license", "Apache", "License,", "version", "2.0", "2", "cc-by-nc", "cc", "by", "nc", "é", "x"]
    rows = EDGES + [(i, " ".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(10, 200)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_words int, score string")
    got = sorted((tuple(r)[:6] for r in licenses.scan(df, ["doc_id"]).collect()), key=lambda r: brute.by_null(r[:5]) + (r[5],))
    want = sorted(((d, *brute.licenses(t)) for d, t in rows), key=lambda r: brute.by_null(r[:5]) + (r[5],))
    assert got == want
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0


def test_license_texts_with_edits(spark):
    text = licenses.TEXTS[0].text.split()
    edited = " ".join(["x"] * 7 + text[:9] + ["really"] + text[9:20] + text[21:])
    df = spark.createDataFrame([(1, edited), (2, " ".join(text[:12]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, ["doc_id"]).collect()}
    assert got[1]["labels"] == "mit" and got[1]["n_base"] == 0 and 0.6 < got[1]["score"] <= 1
    assert got[2]["labels"] == "" and got[2]["score"] == 0
    (span,) = licenses.spans(df, ["doc_id"]).where("label is not null").collect()
    assert span["start"] in (6, 7)


def test_licenses_are_told_from_their_relatives(spark):
    notice = "GIMP is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    texts = {"gpl": notice.format(""), "lgpl": notice.format("Lesser "), "agpl": notice.format("Affero "), "cc-by": cc.format(""), "cc-by-sa": cc.format("-ShareAlike"), "cc-by-nc": cc.format("-NonCommercial"), "cc-by-nc-nd": cc.format("-NonCommercial-NoDerivatives")}
    long = "word " * 200_000 + texts["lgpl"] + " word" * 200_000
    df = spark.createDataFrame([(k, v) for k, v in texts.items()] + [("long", long), ("", "free software under the terms of the GNU General Public License")], "name string, text string")
    got = {r["name"]: (r["labels"], r["n_base"]) for r in licenses.scan(df, ["name"]).collect()}
    assert got == {**{k: (k, 0) for k in texts}, "long": ("lgpl", 0), "": ("", 0)}


def test_license_grams_are_held_against_words():
    """A run of words that has the hash of a template's gram, but not its words, is none of it."""
    import pyarrow as pa

    from heddle.llm.textkit import blocks

    ((_, _, data, offsets),) = blocks(pa.array(["under the MIT license", "the mit"]))
    words, grams = licenses.cut(data, offsets)
    grams = grams.view("int64")
    right, other = int(grams[0]), int(grams[1])
    got = licenses.verified(words, grams, {right: b"under the mit", other: b"some other words"})
    assert got[0] == right and got[1] == 0 and list(got[2:]) == list(grams[2:])


def test_license_query(spark, docs):
    got = {r["doc_id"]: tuple(r)[:6] for r in queries.op3_licenses(spark, DATA).collect()}
    assert got == {d: (d, *brute.licenses(t)) for d, t in docs}


# ---- quality


def test_measures(spark):
    rng = random.Random(2)
    rows = EDGES + [(i, "".join(rng.choices(["a ", "b ", "\n", "a\n", "é", "#", "$x ", " "], k=rng.randint(0, 80)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:6] for r in quality.measure(df, ["doc_id"]).collect()), key=brute.by_null)
    assert got == sorted(((d, *brute.quality(t)) for d, t in rows), key=brute.by_null)


def test_line_limits(spark):
    rng = random.Random(3)
    w = [f"w{i}" for i in range(3000)]
    fresh = lambda: " ".join(rng.sample(w, 30))
    rows = [(i, f"Common LINE  here\n{fresh()}", "h") for i in range(40)]
    rows += [(100 + i, "common line here\n" * 9 + "of words that stand " + fresh()[:8], "h") for i in range(5)]
    body = fresh() + "\n" + fresh()
    rows += [(200 + i, body + ("" if i % 2 else " more"), "h") for i in range(60)]  # copies aren't boilerplate
    rows += [(300, "common line here\n" * 9 + "of words that stand " + fresh(), None), (301, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.assess(df, Scratch(spark, "t"), ["doc_id"]).collect()}
    assert all(got[i]["kept"] and got[i]["removed_words"] == 3 for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(5))
    assert all(got[200 + i]["kept"] and got[200 + i]["removed_words"] == 0 for i in range(60))
    assert got[300]["removed_words"] == 0 and got[301]["base_failed"]
    assert quality.assess(df.limit(0), Scratch(spark, "t"), ["doc_id"]).count() == 0


def test_line_limits_count_distinct_documents(spark):
    """Documents of the same words in another order are distinct; copies count once in the share as well."""
    rng = random.Random(4)
    w = [f"w{i}" for i in range(30)]
    rows = [(i, "common line here\n" + " ".join(rng.sample(w, 30)), "h") for i in range(25)]
    rows += [(1000 + i, " ".join(w).upper() if i % 2 else "  ".join(w), "h") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["removed_words"] for r in quality.assess(df, Scratch(spark, "t"), ["doc_id"]).collect()}
    assert [got[i] for i in range(25)] == [3] * 25 and not any(got[i] for i in got if i >= 1000)


def test_lines_above_the_limit_are_removed(spark):
    rng = random.Random(5)
    w = [f"é{i}" for i in range(3000)]
    forms = ["{0}\n\nCommon  LINE here\n{1}", "common line here\n{0}\n{1}\n\tcommon line here ", "{0}\n{1}\n", "common line here\n\n{0} common line here\ncommon line here\n"]
    rows = [(i, forms[i % 4].format(*(" ".join(rng.sample(w, 15)) for _ in "ab")), ("h", None)[i % 8 > 3]) for i in range(240)]
    rows += [(300, rows[0][1], "other"), (301, None, "h"), (302, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.assess(df, Scratch(spark, "t"), ["doc_id"]).collect()}
    for i, text, source in rows:
        bad = lambda x: source != "other" and x.lower().split() == ["common", "line", "here"]
        assert got[i]["kept_text"] == (None if text is None else "\n".join(x for x in text.split("\n") if not bad(x)))
        assert got[i]["removed_words"] == (0 if text is None else 3 * sum(map(bad, text.split("\n"))))


def test_quality_query(spark, docs):
    for r in queries.op6_quality(spark, DATA).collect():
        want = brute.quality(dict(docs)[r["doc_id"]])
        assert tuple(r[c] for c in quality.MEASURES) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


# ---- substrings


@pytest.mark.parametrize(("window", "chunk"), [(13, 1 << 22), (13, 2000), (3, 3000), (25, 3000), (60, 5000)])
def test_removal(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    rng = random.Random(window)
    base = [rng.choices("abcdefgh", k=90) for _ in range(6)] + [["z"] * 90, ["a", "b"] * 45]
    rows = EDGES + mixed(rng, base, 150, "abcdefgh") + [(i, " ".join(base[0])) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    got = sorted(map(tuple, substrings.remove(df, window).collect()), key=lambda r: brute.by_null(r[:3]) + (r[3],))
    assert got == sorted(brute.removed(rows, window), key=lambda r: brute.by_null(r[:3]) + (r[3],))


def test_removal_keeps_spacing(spark):
    w = [f"w{i}" for i in range(13)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "x\n  y\t" + "\n".join(w) + "\n\nz  ")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in substrings.remove(df, 13, spacing=True).collect()}
    assert got == {1: " ".join(w), 2: "x\n  y\tz"}
    assert substrings.remove(df.limit(0), 13).count() == 0


def test_symbols_of_equal_stretches_agree():
    import numpy as np

    rng = np.random.default_rng(1)
    shared = rng.integers(0, 50, 40).astype(np.uint64)
    for times in (1, 2, 3):
        found = []
        for pad in (7, 13):
            h = np.concatenate((rng.integers(0, 50, pad).astype(np.uint64), shared, rng.integers(0, 50, 9).astype(np.uint64)))
            name, lo, hi = substrings.recompress(h, np.zeros(len(h), int), times)
            inside = (lo >= pad) & (hi < pad + len(shared))
            found.append(list(zip(name[inside], lo[inside] - pad, hi[inside] - pad, strict=True)))
        assert found[0] == found[1] and found[0]


def _thue_morse():
    x = b"ab"
    while len(x) < 1024:
        x += x.translate(bytes.maketrans(b"ab", b"ba"))
    return x.decode(), x.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_words_that_cancel_in_polynomials_are_told_apart(spark):
    """Two different Thue-Morse words, as words, as runs of words and as windows."""
    a, b = _thue_morse()
    rows = [(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, " ".join(a)), (4, " ".join(b)), (5, " ".join([a] * 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substrings.remove(df, 700).collect()))
    assert got == sorted(brute.removed(rows, 700))
    assert sorted(map(tuple, substrings.remove(df, 13).collect())) == sorted(brute.removed(rows, 13))
    near = {r["doc_id"]: r["component_id"] for r in neardup.link(df, Scratch(spark, "t"), 600, 85).collect()}
    assert near == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


@pytest.mark.parametrize("window", [1, 2, 3, 7, 13, 40])
def test_forms_are_those_of_the_words(window):
    """Equal windows have equal forms whatever stands around them, and different ones don't."""
    import numpy as np

    rng = np.random.default_rng(window)
    for size in (1, 2, 3, 8, 1000):
        docs = [rng.integers(0, size, rng.integers(0, 120)) for _ in range(30)]
        docs += [*docs[:5], np.concatenate((docs[6][5:], docs[7])), np.repeat(rng.integers(0, size, 20), rng.integers(1, 9, 20))]
        docs.append(np.concatenate((rng.integers(0, size, 3), docs[-1])))
        w, doc = np.concatenate(docs), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        at = np.array([i for i in range(len(w) - window + 1) if doc[i] == doc[i + window - 1]], int)
        one, two = substrings.forms(substrings.mix(w.astype(np.uint64) + np.uint64(77)), doc, at, window)
        by_words, by_form = {}, {}
        for i, form in zip(at.tolist(), zip(one.tolist(), two.tolist(), strict=True), strict=True):
            words = tuple(w[i : i + window].tolist())
            assert by_words.setdefault(words, form) == form and by_form.setdefault(form, words) == words


def test_rows_without_ids_are_spread_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 20_000)
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, text)] * 2000 + [(1, text)], "doc_id long, text string")
    chunk = substrings.dealt(df, 20, "doc_id", "text", ()).groupBy("chunk").count().collect()
    assert max(r["count"] for r in chunk) < 2 * 2001 / 20
    got = substrings.remove(df, 13)
    assert {(r["doc_id"], r["n_removed"]) for r in got.collect()} == {(None, 30), (1, 0)}


def test_substring_query(spark, docs):
    got = {tuple(r) for r in queries.op7_substrings(spark, DATA).collect()}
    assert got == {(d, n, r, hashlib.sha256(t.encode()).hexdigest()) for d, n, r, t in brute.removed(docs, 13)}


def test_least_inside():
    """Ranges of ordered bounds, and the search where they are out of order."""
    import numpy as np

    rng = np.random.default_rng(1)
    for ordered in (True, False) * 20:
        at = np.arange(rng.integers(0, 400))
        lo = np.sort(at - rng.integers(0, 3, len(at)))
        hi = at + rng.integers(0, 4, len(at))
        hi = np.sort(hi) if ordered else hi
        lo, hi = lo[lo >= 0], hi[lo >= 0]
        key = rng.integers(0, 1 << 60, len(lo)).astype(np.uint64)
        best, found = substrings._least_inside(lo, hi, key, at[: max(0, len(at) - 12)], 13)
        for a in range(len(best)):
            inside = (lo >= a) & (hi < a + 13)
            assert found[a] == inside.any()
            assert not inside.any() or best[a] == key[inside].min()


# ---- near-duplicates


@pytest.mark.parametrize(("k", "percent", "unit"), [(3, 85, 4096), (5, 80, 4096), (3, 85, 10)])
def test_near(spark, monkeypatch, k, percent, unit):
    monkeypatch.setattr(neardup, "UNIT", unit)
    rng = random.Random(4)
    syllables = [a + b for a in "abcdefgh" for b in "xyzuvw"]
    base = [rng.choices(syllables, k=rng.randint(30, 200)) for _ in range(5)]
    rows = EDGES + [(6, "A b"), (7, "q r s t"), (8, "q r s u")]
    for i in range(20, 220):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice("klmn")
        rows.append((rng.choice([i, i, i, None, 20]), " ".join(w)))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n int, cls string")
    found = neardup.link(df, Scratch(spark, "t"), k, percent).collect()
    assert sorted((tuple(r)[:4] for r in found), key=brute.by_null) == sorted(brute.near(rows, k, percent), key=brute.by_null)
    # one row stands for each component
    assert sum(r["first"] for r in found if r["n_shingles"]) == brute.n_components(rows, k, percent)
    assert all(r["first"] for r in found if not r["n_shingles"])


def test_rows_without_ids_meet_once(spark, monkeypatch):
    """Rows that repeat id and text, here a third of the table, bring their text to a unit once."""
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base)) for _ in range(1500)] + [(None, " ".join([*base[:99], "x"])) for _ in range(1500)] + [(i, f"other text of its own {i} " * 3) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    scratch = Scratch(spark, "t")
    monkeypatch.setattr(scratch, "drop", lambda *names: None)
    found = neardup.link(df, scratch, 3, 85).collect()
    assert spark.read.parquet(scratch.at("texts")).count() == 52 and spark.read.parquet(scratch.at("links1")).count() == 2
    assert sum(r["first"] for r in found if r["doc_id"] is None) == 1
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)


def test_large_unit_is_searched_whole(spark, monkeypatch):
    """Without any region's help, the blocks of a large unit find all its links."""
    monkeypatch.setattr(neardup, "UNIT", 8)
    monkeypatch.setattr(neardup, "by_region", lambda edges: edges.where("false").select(F.col("a").alias("cls"), neardup._unit("b", F.lit(0), F.lit(0), F.lit(0))))
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(None if i % 5 == 0 else i, " ".join(rng.choice("xyz") if rng.random() < 0.03 else w for w in base)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r)[:4] for r in neardup.link(df, Scratch(spark, "t"), 3, 85).collect()), key=brute.by_null)
    assert got == sorted(brute.near(rows, 3, 85), key=brute.by_null)


def test_large_region_is_connected():
    import numpy as np

    rows = np.zeros(3000, neardup._ROW)
    rows["cls"] = np.arange(3000)
    up = list(range(3000))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for batch in neardup._edges(rows, np.zeros(0, int), 5):
        assert batch.num_rows < 2 * 3000
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up[find(a)] = find(b)
    assert len({find(i) for i in range(3000)}) == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_large_region_is_compared_whole(spark, parts):
    """Classes of one region whose partners stand far from them in every order, and beyond borders of partitions."""
    import numpy as np

    rng = np.random.default_rng(6)
    n = 3000
    mins = rng.integers(0, 1 << 32, (2 * n, neardup.TREES * neardup.DEPTH), dtype=np.uint64).astype(np.uint32)
    mins[:, : neardup.DEPTH] = 1
    bits = rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    bits[: n // 2] = bits[0]  # one unit of half of all, pairs of the others
    rows = [(i, bytearray(mins[i].tobytes()), bytearray(bits[i % n].tobytes())) for i in range(2 * n)]
    classes = spark.createDataFrame(rows, "cls long, mins binary, bits binary")
    scratch = Scratch(spark, "t")
    few = neardup.forest(classes, parts, neardup.differing(85)).where("b is not null")
    assert components.components(few, scratch, "few").count() < 2 * n
    edges, units = neardup.gathered(classes, parts, neardup.differing(85), scratch)
    assert edges.count() < 4 * n
    root = dict(map(tuple, units.select("v", "root").collect()))
    again = dict(map(tuple, components.components(edges, scratch, "again").collect()))
    assert len(root) == 2 * n and set(root) == set(again)
    assert len(set(root.values())) == len(set(again.values())) == 1 + n - n // 2
    assert all(root[i] == root[i + n] for i in range(n)) and len({root[i] for i in range(n // 2)}) == 1


def test_near_query(spark, docs):
    assert sorted(map(tuple, queries.op8_neardup(spark, DATA).collect())) == sorted(brute.near(docs, 3, 85))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.link(empty, Scratch(spark, "t")).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(None, 1), (3, 3)]
    got = {r["v"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    for a, b in edges:
        if a is not None:
            assert got[a] == got[b]
    assert got[got[130]] == got[130] and got[100] != got[500] and len({got[v] for v in range(500, 560)}) == 1


# ---- mixing


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", "Z", "é", None]), rng.choice([0, 1, 5, 40, 900])) for i in range(400)] + [(1, "tiny", 3)] * 2 + [(None, "tiny", 0)] * 2
    df = spark.createDataFrame([(*r, 9, 1, 2, 3) for r in rows], "doc_id long, source string, size long, k int, block int, row int, target int")
    got = mixing.mix(df, ["doc_id"], Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and all(tuple(r[c] for c in ("k", "block", "row")) == (9, 1, 2) for r in got)
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = brute.targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(df.repartition(7), ["doc_id"], Scratch(spark, "t"))
    assert sorted(map(tuple, again.collect()), key=brute.by_null_text) == sorted(map(tuple, got), key=brute.by_null_text)
    assert mixing.mix(df.limit(0), ["doc_id"], Scratch(spark, "t")).count() == 0
    nothing = spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, size long")
    assert [tuple(r)[3:] for r in mixing.mix(nothing, ["doc_id"], Scratch(spark, "t")).select("doc_id", "source", "size", "taken", "first_slot").collect()] == [(0, None)]


def test_the_points_order_the_mix(spark, monkeypatch):
    """Slots by a plain walk over the golden-ratio points; others give another order."""
    monkeypatch.setattr(mixing, "SLOTS", 64)
    rng = random.Random(8)
    rows = [(i, "ab"[i % 4 == 0], rng.randint(1, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(df, ["doc_id"], Scratch(spark, "t")).collect()}
    assert got == brute.mixed(rows, mixing.SLOTS)
    monkeypatch.setattr(mixing, "PHI", 1779033703)
    other = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(df, ["doc_id"], Scratch(spark, "t")).collect()}
    assert {d: t for d, (t, _) in other.items()} == {d: t for d, (t, _) in got.items()} and other != got


def test_rows_without_ids_have_one_place(spark):
    """A third of all rows alike is one row of its bucket, and its copies stand one after another."""
    rows = [(None, "a", 3)] * 3000 + [(i, "a", 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "key long, source string, size long").repartition(6)
    known = df.select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("k"), mixing.shuffled(["key"]).alias("hash"), F.struct("key").alias("key"), "size")
    at = [r["at"] for r in mixing.line(known).collect()]
    assert len(set(at)) == len(rows) and max(at) in (21000 - 2, 21000 - 3)
    plan = mixing.line(known)._jdf.queryExecution().toString()
    assert "Window" in plan and known.groupBy("k", "hash", "key", "size").count().where("key.key is null").count() == 1


def test_sizes(spark):
    df = spark.createDataFrame([(t,) for _, t in EDGES] + [("é\xa0a\x0bb",)], "text string")
    assert [r["n"] for r in df.select(mixing.sizes().alias("n"), "text").collect()] == [len(brute.words(t)) for _, t in EDGES] + [2]


def test_mix_query(spark, docs):
    rows = [(r["doc_id"], r["source"], len(brute.words(r["text"]))) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = queries.op4_mixing(spark, DATA).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {d: n for d, _, n in rows}
    assert {r["doc_id"]: (r["taken"], r["first_slot"]) for r in got} == brute.mixed(rows, mixing.SLOTS)
