import hashlib
import random
import struct
import subprocess
import sys

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import bpe, queries
from heddle.session import ROOT

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = bpe.codec(PATH, PATTERN)
OTHER = tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("  \n\t'sté\x85\xa0"))), max_size=60))
def test_any_text(text):
    (packed,) = CODEC.encode_all([text])
    assert ids(packed) == OTHER.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()
    assert CODEC.encode(text) == packed


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "é" * 5_000, " " * 3_000 + "x", "x" + "\n" * 2_000, "the " * 5_000, "<|endoftext|>"])
def test_long_pretokens(text):
    assert ids(CODEC.encode(text)) == OTHER.encode_ordinary(text)


def test_queues_agree_and_end_empty():
    rng = random.Random(5)
    pieces = ["".join(rng.choices("aethinrs", k=rng.randint(1, 30))).encode() for _ in range(2000)]
    assert [ids(x) for x in CODEC.merge_all(pieces)] == [CODEC.merge(p) for p in pieces]
    assert not any(CODEC.low) and not any(CODEC.mid)


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 20_000)
    c = bpe.Codec(CODEC.ranks, PATTERN)
    for k in range(4):
        texts = [f"w{i} z{i * 7} z{i * 7}" for i in range(k * 100, k * 100 + 500)]
        assert [ids(x) for x in c.encode_all(texts)] == [OTHER.encode_ordinary(t) for t in texts]
    for known in (c.known_pieces, c.known_chunks):
        assert (known or known.old) and sum(2 * len(k) + len(v) + 180 for held in (known, known.old) for k, v in held.items()) <= 2 * 20_000


def test_long_texts_are_cut_at_single_spaces(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 20)
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choices(["the", "é", " ", "  ", "\n", " a", "'s", " 12", "."], k=rng.randint(0, 200)))
        (packed,) = CODEC.encode_all([text])
        assert ids(packed) == OTHER.encode_ordinary(text) and CODEC.decode(packed) == text.encode()


def test_unknown_id():
    with pytest.raises(ValueError):
        CODEC.decode(struct.pack("<I", 60_000))


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "y"), (3, "", None)], "doc_id int, text string, ids string")
    made = bpe.encode(df, PATH, PATTERN)
    assert {tuple(r) for r in bpe.decode(made, PATH, PATTERN).select("doc_id", "decoded").collect()} == {(1, b"a b"), (2, b""), (3, b"")}
    # a column with a result's name gives it up
    assert sorted(bpe.round_trip(df, PATH, PATTERN).columns) == ["decoded", "doc_id", "ids", "text"]
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = OTHER.encode_ordinary(r["text"] or "")
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


LEAN = """
import random, re, sys
from types import SimpleNamespace
import public_tokenizers, pyarrow as pa
from pyspark.sql import types as T
import corpus_pipeline
from heddle.llm import bpe
from heddle.llm.queries import VOCABULARY

frame = SimpleNamespace(columns=["text"], schema=T.StructType([T.StructField("text", T.StringType())]), mapInArrow=lambda run, schema: run)
rng = random.Random(3)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60_000)]
batches = [pa.record_batch({"text": [" ".join(rng.choices(words, k=400)) for _ in range(1000)]}) for _ in range(3)]
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
bpe.codec(VOCABULARY, public_tokenizers.PATTERN)
before, most = held(), 0
run = bpe.round_trip(frame, VOCABULARY, public_tokenizers.PATTERN, **({"lean": corpus_pipeline.ENCODED} if sys.argv[1] == "lean" else {}))
rows = 0
for out in run(iter(batches)):
    assert out.column("decoded").cast(pa.string()).equals(out.column("text"))
    rows += out.num_rows
    most = max(most, held() - before)
assert rows == 3000
print(most, held() - before)
"""


def test_a_lean_worker_gives_memory_back():
    held = {}
    for how in ("lean", "plain"):
        said = subprocess.run([sys.executable, "-c", LEAN, how], capture_output=True, text=True, cwd=ROOT, check=True, timeout=300).stdout
        held[how] = [int(x) for x in said.split()[-2:]]
    assert held["lean"][0] < held["plain"][0] * 0.8 and held["lean"][1] < held["plain"][1] * 0.7, held
