"""Source divergence audit: how far the words of a language's sources lie apart, and which terms tell a source from its language.

1. One pass over the corpus. Texts are cut into terms on their bytes, terms are
   coded as integers into a dictionary of the distinct ones, and each (language,
   source) group's occurrences and documents are counted by ``bincount``. What
   leaves a task is one row per group and term, added up by Spark.
2. Terms in ``min_docs`` documents of their language are kept, numbered in
   UTF-8 order over the whole language by range partitions and running sums, and
   cut into chunks of ``CHUNK`` terms.
3. A task takes one chunk of one language: its kept terms as a sorted array,
   every source of the language as a dense vector over it (term ids by
   ``searchsorted``). It returns the summed differences of source pairs and each
   source's ten leading terms of the chunk; ids keep UTF-8 order, so ties need
   no texts. Sums and ranks over chunks are plain aggregates.

All arithmetic is in 64-bit integers. p = 1 + floor(10^9 (c + 2) / (N + 2 V)) is
divided in three steps of 10^3, which is exact while N + 2 V < 9 * 10^15
(otherwise OverflowError, as nothing would be right).

Null text, language and source count as ''. A group without terms has count 0
for each kept term; a language without kept terms has distance 0 for all its
pairs and no term rows; a language with one source has no pairs. Equal rows count
each. A text of any length is read whole, in memory that is a multiple of it. An
empty table gives an empty table. Only ``text``, ``lang`` and ``source`` are
read: ids may be null or repeat and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, with_running_sums
from .word_arrays import byte_class, cut_words, slices

#: Terms are runs of ASCII letters and characters beyond ASCII.
TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BREAKS = byte_class(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms in a chunk, and cells of a dense matrix of sources by terms.
CHUNK = 4096
CELLS = 1 << 21


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), exactly, while total < 9 * 10^15."""
    if total.max(initial=0) >= 9_000_000_000_000_000:
        raise OverflowError("a group has too many occurrences for 64-bit arithmetic")
    share, rest = np.zeros_like(count), count + 2
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + whole
    return share + 1


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            for begin, end in slices(texts):
                langs, sources = (b.column(k).slice(begin, end - begin).dictionary_encode() for k in (0, 1))
                group, members = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
                words = cut_words(texts.slice(begin, end - begin), BREAKS)
                size = len(words.dictionary)
                if not size:
                    continue
                once = np.unique(words.doc * size + words.ids)
                per_group = []
                for ids, of in ((words.ids, members[words.doc]), (once % size, members[once // size])):
                    order = np.argsort(of, kind="stable")
                    bounds = np.searchsorted(of[order], np.arange(len(group) + 1))
                    per_group.append([ids[order[a:z]] for a, z in zip(bounds, bounds[1:], strict=False)])
                for g, ids, in_docs in zip(group, *per_group, strict=True):
                    count = np.bincount(ids, minlength=size)
                    found = np.flatnonzero(count)
                    if len(found):
                        lang, source = langs.dictionary[int(g) // len(sources.dictionary)], sources.dictionary[int(g) % len(sources.dictionary)]
                        columns = [pa.repeat(lang, len(found)), pa.repeat(source, len(found)), words.dictionary.take(pa.array(found))]
                        columns += [pa.array(count[found]), pa.array(np.bincount(in_docs, minlength=size)[found])]
                        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    found = _grouped(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _grouped(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, first) for the terms in ``min_docs`` documents of their language; first is 1 in one row of each term."""
    of_term = Window.partitionBy("lang", "term")
    ranked = F.row_number().over(of_term.orderBy("source"))
    counts = term_counts(docs).withColumn("in_docs", F.sum("docs").over(of_term)).filter(F.col("in_docs") >= min_docs)
    return stored(counts.select("lang", "source", "term", "n", F.when(ranked == 1, 1).otherwise(0).alias("first")), "terms")


def _chunk_rows(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """Differences within one chunk of one language's terms: see ``audit``."""
    table = pa.Table.from_batches(list(batches)).to_pydict()
    lang = table["lang"][0]
    totals = {s: t for s, t, term in zip(table["source"], table["total"], table["term"], strict=True) if term is None}
    sources = sorted(totals)
    row_of = {s: i for i, s in enumerate(sources)}
    counted = [(row_of[s], t, n) for s, t, n in zip(table["source"], table["term"], table["n"], strict=True) if t is not None]
    terms = np.array(sorted({t for _, t, _ in counted}), dtype=object)
    ids = np.searchsorted(terms, np.array([t for _, t, _ in counted], dtype=object))
    at, n = np.array([i for i, _, _ in counted]), np.array([n for _, _, n in counted], dtype=np.int64)
    kinds = max(table["kinds"])
    total = np.array([totals[s] for s in sources], dtype=np.int64)[:, None] + 2 * kinds
    all_total = np.array([max(table["lang_total"])], dtype=np.int64) + 2 * kinds

    def rows(source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
        m = len(items)
        columns = [pa.repeat(lang, m), pa.repeat(source, m), pa.repeat(part, m), pa.array(items, pa.string()), pa.array(values, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])

    width = max(1, CELLS // len(sources))
    for begin in range(0, len(terms), width):
        here = (ids >= begin) & (ids < begin + width)
        dense = np.zeros((len(sources), min(width, len(terms) - begin)), dtype=np.int64)
        dense[at[here], ids[here] - begin] = n[here]
        p, q = _shares(dense, total), _shares(dense.sum(axis=0), all_total)
        for i, source in enumerate(sources):
            if i + 1 < len(sources):
                yield rows(source, "pair", sources[i + 1 :], _difference(p[i], p[i + 1 :]).sum(axis=1))
            leading = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            value = _difference(p[i][leading], q[leading])
            order = np.lexsort((leading, -value))[:top]
            if len(order):
                yield rows(source, "term", terms[begin + leading[order]].tolist(), value[order])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of the language by distance, ``term`` the ``top`` leading terms."""
    kept = kept_terms(docs, min_docs)
    of_lang = Window.partitionBy("lang")
    counted = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("kinds"))
    occurring = _grouped(docs).select("lang", "source").distinct()
    groups = occurring.join(counted, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("kinds").over(of_lang), F.lit(0)).alias("kinds"),
        F.coalesce(F.sum("total").over(of_lang), F.lit(0)).alias("lang_total"),
    )
    groups = stored(groups, "groups")

    numbered = with_running_sums(kept, ["lang", "term", "source"], {"before": F.col("first")}, by=["lang"])
    chunk = F.floor((F.col("before") + F.col("first") - 1) / CHUNK).cast("long")
    numbered = numbered.withColumn("chunk", chunk)
    # One row for each source of the language in every chunk, with its totals; the source may have no term there.
    firsts = numbered.filter((F.col("first") == 1) & ((F.col("before") % CHUNK) == 0)).select("lang", "chunk")
    headers = firsts.join(groups, "lang").select(
        "lang", "chunk", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "kinds", "lang_total"
    )
    zero = F.lit(0).cast("long")
    data = numbered.select("lang", "chunk", "source", "term", "n", zero.alias("total"), zero.alias("kinds"), zero.alias("lang_total"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chunk_rows(batches, top)

    by_chunk = headers.unionByName(data).groupBy("lang", "chunk")
    parts = stored(by_chunk.applyInArrow(run, "lang string, source string, part string, item string, value long"), "parts")

    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    still = groups.filter("kinds = 0").join(other, "lang").filter("source < item").select("lang", "source", "item", zero.alias("value"))
    sums = sums.unionByName(still)
    pairs = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(parts.filter("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = both.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


#: The same audit for DuckDB, from one row per source, kept term and source.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tk AS (SELECT rn, lang, source, unnest(regexp_extract_all(text, '{TERM_PATTERN}')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rn) AS docs FROM tk GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS kinds, sum(n) AS total FROM kept GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT dense.lang, source, term, dense.n,
         CAST(1 + CAST({SCALE} AS HUGEINT) * (dense.n + 2) // (sum(dense.n) OVER (PARTITION BY dense.lang, source) + 2 * v.kinds) AS HUGEINT) AS p,
         CAST(1 + CAST({SCALE} AS HUGEINT) * (lang_n + 2) // (v.total + 2 * v.kinds) AS HUGEINT) AS q
  FROM dense JOIN v ON v.lang = dense.lang),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(pair.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms)
  WHERE rank <= {TOP_TERMS})
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
