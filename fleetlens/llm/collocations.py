"""Phrase collocations: frequent phrases of two to five words per language, level by level, and how firmly their words hold together.

1. Level 1 counts words. Level k reads the corpus again and emits a k-gram only
   where both (k-1)-grams in it are frequent (Apriori). What a task finds in a
   slice of texts is counted there; Spark adds the counts up and keeps phrases
   with ``min_count``.
2. The frequent (k-1)-grams are broadcast as a bit field of their 64-bit hashes,
   built in blocks by Spark and at most ``MAX_BITS`` (32 MB) long however many
   there are. Two grams may share a bit: then a few more k-grams are counted, and
   none is lost, as every phrase is counted by its words and cut by its own count.
3. Cuts of a candidate are scored from the level tables; the lowest one counts.
   A candidate is dropped if a longer one holds it and is as frequent. Counts
   cannot rise with length, so it is enough to look one word further: any longer
   one as frequent has such a one between.
4. Each language's first ``top`` are ranked in two steps: within ``SALT`` parts
   of the language, then among what is left of them.

Null text counts as empty, null language as ``und``. Equal rows count each. A text of
any length is read whole, in memory that is a multiple of it. An empty table or a
language without candidates gives no rows. Only ``text`` and ``lang`` are read:
ids may be null or repeat and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, stored
from .word_arrays import Words, byte_class, cut_words, slices

PIECE_BREAKS = ".,;:!?\x0a\x0b\x0c\x0d"
MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Bits of a field: ``SPREAD`` for each gram, ``MAX_BITS`` at most; built in blocks of ``BLOCK``.
SPREAD, MIN_BITS, MAX_BITS, BLOCK = 32, 1 << 16, 1 << 28, 1 << 16
SALT = 64

_word_break, _piece_break = byte_class(" \t" + PIECE_BREAKS), byte_class(PIECE_BREAKS)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), np.uint64, len(words)) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 11))


def _gram_hashes(of_words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words."""
    n = max(0, len(of_words) - k + 1)
    h = _mixed(of_words[:n])
    for j in range(1, k):
        h = _mixed(h * _MULTIPLIER + of_words[j : j + n])
    return h


def bit_field(grams: DataFrame, k: int) -> np.ndarray:
    """The bit field of ``grams(lang, phrase)`` of k words, as bytes; its length is a power of two."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (SPREAD * grams.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = []
            for lang, phrase in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at.append(int(_gram_hashes(_word_hashes(phrase.encode().split(b" "), lang), k)[0]) & (bits - 1))
            at = np.array(at, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array(at % BLOCK)], ["block", "bit"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, of = np.zeros(BLOCK, dtype=np.uint8), 0
        for b in batches:
            of = b.column(0)[0].as_py()
            field[b.column(1).to_numpy()] = 1
        yield pa.RecordBatch.from_arrays([pa.array([of]), pa.array([np.packbits(field, bitorder="little").tobytes()])], ["block", "field"])

    blocks = grams.select("lang", "phrase").mapInArrow(places, "block long, bit long").groupBy("block").applyInArrow(block, "block long, field binary")
    field = np.zeros(bits // 8, dtype=np.uint8)
    # At most MAX_BITS / BLOCK blocks of 8 KB, whatever the number of grams.
    for of, part in blocks.collect():
        field[of * BLOCK // 8 : (of + 1) * BLOCK // 8] = np.frombuffer(part, np.uint8)
    return field


def _has(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(field) * 8 - 1)
    return (field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _counted(words: Words, k: int, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct runs of k words that begin ``at`` some places, as phrases, and how often each does."""
    size = len(words.dictionary)
    code, first = words.ids[at], at
    for j in range(1, k):
        code = code * size + words.ids[at + j]
        if j == k - 1:
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            first = at[first]
        else:
            _, code = np.unique(code, return_inverse=True)
    parts = [words.dictionary.take(pa.array(words.ids[first + j])) for j in range(k)]
    return pc.binary_join_element_wise(*parts, " "), n


def _level(docs: DataFrame, find: Callable[[str, Words], Iterator[tuple[pa.Array, np.ndarray]]]) -> DataFrame:
    """(lang, phrase, f): what ``find`` counts in slices of a language's texts, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(0).dictionary_encode()
            of = langs.indices.to_numpy()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = b.column(1).take(pa.array(np.flatnonzero(of == i)))
                for begin, end in slices(texts):
                    words = cut_words(texts.slice(begin, end - begin), _word_break, _piece_break)
                    for phrases, n in find(lang, words):
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "f"])

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def word_level(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, f): frequent words; the row without a phrase has the number of all words of the language."""

    def find(lang: str, words: Words) -> Iterator[tuple[pa.Array, np.ndarray]]:
        if len(words.ids):
            yield words.dictionary, np.bincount(words.ids, minlength=len(words.dictionary))
            yield pa.array([None], pa.string()), np.array([len(words.ids)])

    return stored(_level(docs, find).filter((F.col("f") >= min_count) | F.col("phrase").isNull()), "words")


def next_level(docs: DataFrame, k: int, field: Broadcast, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, f): frequent k-grams, counted only where both (k-1)-grams in them are in the field."""

    def find(lang: str, words: Words) -> Iterator[tuple[pa.Array, np.ndarray]]:
        n = len(words.ids) - k + 1
        if n <= 0:
            return
        of_words = _word_hashes(words.dictionary.cast(pa.binary()).to_pylist(), lang)[words.ids]
        frequent = _has(field.value, _gram_hashes(of_words, k - 1))
        at = np.flatnonzero(frequent[:-1] & frequent[1:] & (words.piece[:n] == words.piece[k - 1 :]))
        if len(at):
            yield _counted(words, k, at)

    return stored(_level(docs, find).filter(F.col("f") >= min_count), f"grams{k}")


def levels(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> list[DataFrame]:
    """The level tables, from words to the longest phrases."""
    spark: SparkSession = docs.sparkSession
    tables = [word_level(docs, min_count)]
    for k in range(2, longest + 1):
        field = spark.sparkContext.broadcast(bit_field(tables[-1].filter("phrase IS NOT NULL"), k - 1))
        tables.append(next_level(docs, k, field, min_count))
        field.unpersist()
    return tables


def scored(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer phrase makes needless."""
    known = tables[0].filter("phrase IS NOT NULL")
    totals = tables[0].filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    longer = [(k, t) for k, t in enumerate(tables, start=1) if k > 1]
    candidates = reduce(DataFrame.unionByName, [t.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k")) for k, t in longer])
    within = F.expr("explode(array(substring_index(phrase, ' ', k - 1), substring_index(phrase, ' ', 1 - k)))")
    needless = candidates.filter("k > 2").select("lang", within.alias("phrase"), "a").distinct()
    candidates = candidates.join(needless, ["lang", "phrase", "a"], "left_anti")

    known = reduce(DataFrame.unionByName, [known, *(t for _, t in longer)])
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - k)")})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= BROADCAST_KEYS // 10 else totals, "lang")
    exact = "cast(1000 * cast(a as decimal(17, 0)) * cast(n as decimal(17, 0)) as decimal(38, 0)) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))"
    lowest = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return lowest.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    found = scored(levels(docs, min_count, longest)).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    order = (F.desc("score"), F.desc("a"), "phrase")
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _oracle(min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> str:
    """The same for DuckDB, from all runs of words."""
    grams = "\nUNION ALL\n".join(
        f"SELECT lang, {k} AS k, array_to_string(ws[i:i+{k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})"
        for k in range(1, longest + 1)
    )
    return rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS ({grams}),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {min_count}),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
cand AS (
  SELECT * FROM f a WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM f b WHERE b.lang = a.lang AND b.k > a.k AND 100 * b.f >= 100 * a.f AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, k, cut, array_to_string(string_split(phrase, ' ')[1:cut], ' ') AS fst, array_to_string(string_split(phrase, ' ')[cut+1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
s AS (
  SELECT cuts.lang, cuts.phrase AS phrase, a, cut, x.f AS l, y.f AS r, CAST(n.n AS BIGINT) AS n,
         CAST(CAST(1000 AS HUGEINT) * a * n.n AS HUGEINT) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = fst JOIN f y ON y.lang = cuts.lang AND y.phrase = rest JOIN n ON n.lang = cuts.lang),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}
"""


ORACLE_SQL = _oracle()
