"""Byte-level BPE against the whole-text encoder, at chunk sizes that make every text long."""

import base64
import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from fleetlens.llm import byte_bpe

ODD = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "1", "23", "é", "中", "。", "　", "!?", "-", "\x1c", " ", "🙂", "꟎", "\U00011de1"]


@pytest.fixture(scope="module")
def whole():
    with open(byte_bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=byte_bpe.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_give_what_whole_texts_give(spark, whole):
    r = random.Random(11)
    texts = [None, "", " ", "abc", *("".join(r.choices(ODD, k=r.randrange(1, 1500))) for _ in range(60))]
    texts += ["a" * 3000, " " * 3000, "x " * 1500, "a" * 700 + " " * 700 + "b" * 699, "'" * 1000, "中" * 900, "ab " * 300 + "z" * 700 + " q\n" * 400, "x " * 1500]
    rows = [(None if i % 30 == 3 else 2**60 + 1 if i % 9 == 4 else i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").withColumn("doc_key", F.lit("clash"))
    pieces = byte_bpe.encode(docs, chunk=64, overlap=16)
    assert pieces.filter("n_pieces > 1").count() > 500

    expected = []
    for i, t, _ in rows:
        ids = whole.encode_ordinary(t or "")
        assert whole.decode(ids) == (t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.digest(pieces).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1:])) == sorted(
        expected, key=lambda x: (x[0] is None, x[0] or 0, x[1:])
    )


def test_decoded_pieces_are_the_text(spark):
    text = "naïve café, 東京 — it's 12 o'clock.\n" * 200
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    parts = byte_bpe.decode(byte_bpe.encode(docs, chunk=128, overlap=32)).orderBy("doc_id", "piece").collect()
    assert b"".join(bytes(p["bytes"]) for p in parts if p["doc_id"] == 1).decode() == text
    assert [bytes(p["bytes"]) for p in parts if p["doc_id"] == 2] == [b""]


def test_runs_over_many_chunks_are_merged(spark):
    """One pre-token over several chunks leaves one piece for them; its neighbours stay pieces of their own."""
    text = "word " * 100 + "z" * 1000 + " word" * 100
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = byte_bpe.encode(docs, chunk=64, overlap=16)
    assert 4 < pieces.count() < len(text) // 64


def test_empty_table_and_small_overlap(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.digest(byte_bpe.encode(docs)).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, overlap=2)
