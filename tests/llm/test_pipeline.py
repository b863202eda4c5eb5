"""The corpus pipeline on the smallest tables, and the driver's entry."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fleetlens.llm import token_shards

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= 0.7 * sizes[0] and sizes[3] >= 0.6 * sizes[0]
    assert docs.count() == docs.select("slot").distinct().count() > 0


def test_null_and_repeated_ids_are_rows_of_their_own(spark, tmp_path, monkeypatch):
    item = "a question with words enough to be looked for in all the texts of a corpus"
    words = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(6)]
    rows = [
        (None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (7, words[3]), (None, words[4]), (9, words[4]),
        (None, words[5] + " grobbin"), (7, words[5] + " " + item),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "without_toxic", lambda d, _: d.filter(~F.col("text").contains("grobbin")))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert got == sorted([(None, words[0]), (None, words[1]), (7, words[2]), (7, words[3]), (9, words[4])], key=str)


def brute_force(rows, items, toxic):
    """What the first three stages leave: no toxic text, the smallest id of each group of texts at 0.8 or more, no text with an item."""
    rows = [(i, t) for i, t in rows if toxic not in t]
    shingles = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                group[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), i), i)
    return {(i, t) for i, t in rows if i in first.values() and not any(x in t for x in items)}


def test_stages_against_brute_force(spark, tmp_path, monkeypatch):
    r = random.Random(21)
    item = "which of these seven rivers is the longest one that flows through four countries"
    rows = []
    for k in range(40):
        words = [f"w{r.randrange(4000)}" for _ in range(80)]
        rows.append((len(rows), " ".join(words)))
        for changes in r.choice([[], [0], [1], [2], [1, 1], [1, 2], [3], [4]]):
            copy = list(words)
            for c in range(changes):
                copy[(c * 19 + 7) % 80] = f"x{k}y{c}"
            rows.append((len(rows), " ".join(copy)))
        if k % 9 == 4:
            rows.append((len(rows), " ".join(words[:30]) + " " + item + " " + " ".join(f"z{r.randrange(4000)}" for _ in range(50))))
        if k % 11 == 5:
            rows.append((len(rows), "grobbin " + " ".join(f"t{r.randrange(4000)}" for _ in range(60))))
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"group": F.lit("clash"), "_row_key": F.lit(None).cast("int")}).repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(corpus_pipeline.toxicity, "train", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "without_toxic", lambda d, _: d.filter(~F.col("text").contains("grobbin")))
    docs = docs.drop("_row_key")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert {(d["doc_id"], d["text"]) for d in docs.collect()} == brute_force(rows, [item], "grobbin")
    corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).write.parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    assert mixed.columns == docs.columns
    to_ids = token_shards.Tokenizer(open(token_shards.VOCABULARY, "rb").read())
    wanted = sum(len(to_ids(d["text"])) // 2 + 1 for d in mixed.collect())
    assert corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path)).agg(F.sum("n_tokens")).first()[0] == wanted


@pytest.mark.parametrize("k", range(5))
def test_stages_of_empty_tables(spark, tmp_path, k):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_every_number_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
