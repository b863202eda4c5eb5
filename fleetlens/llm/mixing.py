"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-word blocks.

1. Targets: the mix holds ``share`` percent of all words; sources share it by
   weight, none gets more than ``most`` times its own words, and what is over is
   shared again by weight until none is above (a water level, solved exactly in
   integers).
2. Quotas: the mix is cut into blocks of ``block_words`` words. Each block goes
   to the source with the highest quotient target / (2 k + 1), k being the
   blocks it has. The method is house-monotone, so the quotas of the first
   1, 2, ... shards are apportionments too, and their differences are integer
   quotas per shard. The last shard's last block of a source is cut, or another one
   begun, so that the source meets its target to the word.
3. Selection: each source's documents, in a seeded order, are one run of words
   cut into blocks. A seeded permutation of the blocks (Feistel network with cycle walking,
   another one for each pass) is the order in which they are drawn: the first
   shard draws its quota, then the second, and so on. Which words of a document
   are taken, and for which shard, follows from its place in the run alone, so nothing but
   running sums is shuffled, and a source of any size spreads over all tasks.

Only the per-source totals (one row per source of the mix) reach the driver,
which is where the weights are given. A null source is a source of its own and
comes last; documents without words take nothing. Repeated rows count each; the
order within a source is by id and text, so only equal rows can change places.
Ids may be null. An empty table gives no rows. Columns other than ``doc_id``,
``text`` and ``source`` are carried by ``mixed_documents`` and have no effect.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, ROW, WORD_PATTERN, materialize, row_keyed, with_running_sums, word_count

WEIGHTS = (5, 2, 1)
SHARE = 150
MOST = 2
BLOCK_WORDS = 64
SHARDS = 16
SEED = 20240611
ROUNDS = 4
#: Round function (r * STEP + key) mod PRIME * TURN mod PRIME, whose products fit 64 bits in any engine.
STEP, TURN, PRIME = 1103515245, 48271, 2147483647


def fair_targets(sizes: list[int], weights: list[int], share: int = SHARE, most: int = MOST) -> list[float]:
    """Water filling: weight times a common level, at most ``most`` times the size."""
    total = share * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    targets = [float(most * s) for s in sizes]
    capped, weight = 0, sum(weights)
    for j, i in enumerate(order):
        # level = (total / 100 - capped) / weight; source i stays below its cap from here on
        if (total - 100 * capped) * weights[i] <= 100 * most * sizes[i] * weight:
            for k in order[j:]:
                targets[k] = (weights[k] * (total - 100 * capped)) / (100.0 * weight)
            break
        capped += most * sizes[i]
        weight -= weights[i]
    return targets


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), ties to the earlier source, at most ``most`` each."""
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    got = [min(m, int(seats * v / total + 0.5)) for v, m in zip(votes, most, strict=True)]
    more = [(-v / (2 * k + 1), i) for i, (v, k, m) in enumerate(zip(votes, got, most, strict=True)) if k < m]
    heapq.heapify(more)
    short = seats - sum(got)
    while short > 0 and more:
        _, i = heapq.heappop(more)
        got[i] += 1
        short -= 1
        if got[i] < most[i]:
            heapq.heappush(more, (-votes[i] / (2 * got[i] + 1), i))
    less = [(v / (2 * k - 1), -i) for i, (v, k) in enumerate(zip(votes, got, strict=True)) if k]
    heapq.heapify(less)
    while short < 0:
        _, i = heapq.heappop(less)
        got[-i] -= 1
        short += 1
        if got[-i]:
            heapq.heappush(less, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def round_keys(seed: int, place: int, turn: int) -> list[int]:
    """Keys of the order in which the source at a place of the list draws its blocks in a pass."""
    return [int(hashlib.md5(f"{seed}:{place}:{turn}:{r}".encode()).hexdigest()[:7], 16) for r in range(ROUNDS)]


def drawn_at(block: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    """Place of each block in the order of drawing: a permutation of range(n)."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    x = np.array(block, dtype=np.int64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & low
        for k in keys:
            left, right = right, left ^ ((right * STEP + k) % PRIME * TURN % PRIME & low)
        x[todo] = left << half | right
        todo = todo[x[todo] >= n]
    return x


def _settled(quota: int, n: int, size: int, want: int, most: int, block_words: int, keys) -> tuple[int, int]:
    """Whole blocks to draw, and words of the next one, so that they are ``want`` words."""
    short = n * block_words - size  # the last block is shorter by so many words
    last = [int(drawn_at(np.array([n - 1]), n, keys(p))[0]) for p in range(most)] if n else []

    def words(q: int) -> int:
        turns, rest = divmod(q, n)
        return q * block_words - short * (turns + (turns < most and last[turns] < rest))

    q = min(quota, most * n)
    while q and words(q) > want:
        q -= 1
    while q < most * n and words(q + 1) <= want:
        q += 1
    return q, (want - words(q) if q < most * n else 0)


def plan(totals: list[tuple], weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED) -> list[dict]:
    """One dict per source (code-point order, null last): target, blocks, draws, and the draws after each shard."""
    totals = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [int(s) for _, s in totals]
    w = [weights[i % len(weights)] for i in range(len(totals))]
    targets = fair_targets(sizes, w, share, most)
    blocks = [-(-s // block_words) for s in sizes]
    seats = (share * sum(sizes)) // (100 * block_words)
    ends = [sainte_lague(targets, seats * (j + 1) // shards, [most * b for b in blocks]) for j in range(shards)]
    out = []
    for i, (source, _) in enumerate(totals):
        q, cut = _settled(ends[-1][i], blocks[i], sizes[i], int(targets[i]), most, block_words, lambda p, i=i: round_keys(seed, i, p))
        after = [*(min(e[i], q) for e in ends[:-1]), q + (cut > 0)]
        out.append({"source": source, "place": i, "source_size": sizes[i], "target": targets[i], "n_blocks": blocks[i], "draws": q, "cut": cut, "shard_ends": after})
    return out


def _draws(start: np.ndarray, size: np.ndarray, source: dict, block_words: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each pass: row, first word (of the row), words and shard of every piece that rows of one source give."""
    n, draws, cut = source["n_blocks"], source["draws"], source["cut"]
    first = start // block_words
    count = np.where(size > 0, (start + size - 1) // block_words - first + 1, 0)
    row = np.repeat(np.arange(len(start)), count)
    block = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    a = np.maximum(block * block_words, start[row])
    z = np.minimum((block + 1) * block_words, (start + size)[row])
    for turn in range(-(-(draws + (cut > 0)) // n) if n else 0):
        t = turn * n + drawn_at(block, n, round_keys(seed, source["place"], turn))
        end = np.where(t < draws, z, np.where(t == draws, np.minimum(z, block * block_words + cut), a))
        use = end > a
        shard = np.searchsorted(np.array(source["shard_ends"]), t[use], side="right")
        yield row[use], (a - start[row])[use], (end - a)[use], shard


def _placed(docs: DataFrame, keep: list[str], weights, share, most, block_words, shards, seed) -> tuple[DataFrame, list[dict]]:
    """Rows of ``keep`` with source place, size and start in the source's run, and the plan."""
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce("text", F.lit(""))).cast("binary"))
    sized = materialize(docs.select(*keep, F.col("source").alias("_source"), word_count(F.col("text")).alias("size"), h.alias("_h")))
    totals = [(r["_source"], r["n"]) for r in sized.groupBy("_source").agg(F.sum("size").alias("n")).collect()]
    sources = plan(totals, weights, share, most, block_words, shards, seed)
    placed = with_running_sums(sized, ["_source", "_h", *keep, "size"], {"start": F.col("size")}, by=["_source"])
    table = docs.sparkSession.createDataFrame([(s["source"], s["place"], s["source_size"], s["target"]) for s in sources], "_name string, place int, source_size long, target double")
    if len(sources) <= 50_000:  # at under 200 bytes a row
        table = F.broadcast(table)
    return placed.join(table, F.col("_source").eqNullSafe(F.col("_name"))).withColumnRenamed("_source", "source").drop("_name", "_h"), sources


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, shards=SHARDS, seed=SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, by_shard): words that the mix takes of each document, in all and for each shard."""
    placed, sources = _placed(docs, ["doc_id"], weights, share, most, block_words, shards, seed)
    shared = docs.sparkSession.sparkContext.broadcast(sources)

    @F.pandas_udf("array<long>")
    def words_by_shard(place: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
        out = np.zeros((len(place), shards), dtype=np.int64)
        start, size = start.to_numpy(), size.to_numpy()
        for p, at in place.groupby(place).indices.items():
            for row, _, words, shard in _draws(start[at], size[at], shared.value[p], block_words, seed):
                np.add.at(out, (at[row], shard), words)
        return pd.Series(list(out))

    got = placed.withColumn("by_shard", words_by_shard("place", "start", "size"))
    taken = F.aggregate("by_shard", F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "by_shard")


def mixed_documents(
    docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, shards=1, seed=SEED, shard_column: str | None = None
) -> DataFrame:
    """The mix itself, with the columns of ``docs`` and, if named, that of the shard.

    A document comes once for every pass and shard that draws any of its blocks,
    cut down to those; n_chars follows the text where it is cut.
    """
    keyed = row_keyed(docs)
    placed, sources = _placed(keyed, ["doc_id", ROW], weights, share, most, block_words, shards, seed)
    shared = docs.sparkSession.sparkContext.broadcast(sources)
    word = re.compile(WORD_PATTERN)

    def cut(text: str, begin: list[int], words: list[int]) -> str:
        """Runs of words of a text, a line each."""
        spans = [m.span() for m in word.finditer(text)]
        runs: list[list[int]] = []
        for a, n in sorted(zip(begin, words, strict=True)):
            if runs and runs[-1][1] == a:
                runs[-1][1] += n
            else:
                runs.append([a, a + n])
        return "\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in runs)

    @F.pandas_udf("array<struct<shard int, part string>>")
    def pieces(text: pd.Series, place: pd.Series, start: pd.Series, size: pd.Series) -> pd.Series:
        """A piece's text is null where it is the whole one."""
        out: list[list] = [[] for _ in range(len(text))]
        start, size = start.to_numpy(), size.to_numpy()
        for p, at in place.groupby(place).indices.items():
            for row, begin, words, shard in _draws(start[at], size[at], shared.value[p], block_words, seed):
                order = np.lexsort((shard, row))
                row, begin, words, shard = row[order], begin[order], words[order], shard[order]
                new = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(shard, prepend=-1))
                for a, z in zip(new, [*new[1:], len(row)], strict=True):
                    i = at[row[a]]
                    whole = words[a:z].sum() == size[i]
                    part = None if whole else cut(text.iat[i], begin[a:z].tolist(), words[a:z].tolist())
                    out[i].append({"shard": int(shard[a]), "part": part})
        return pd.Series(out)

    places = materialize(placed.filter("size > 0").select(F.col(ROW).alias("_mix_key"), "place", "start", "size"))
    places = F.broadcast(places) if places.count() <= BROADCAST_KEYS else places
    joined = keyed.join(places.select("_mix_key", F.struct("place", "start", "size").alias("_mix_place")), F.col(ROW) == F.col("_mix_key"))
    drawn = joined.withColumn("_mix_piece", F.explode(pieces(F.col("text"), "_mix_place.place", "_mix_place.start", "_mix_place.size")))
    part = F.col("_mix_piece.part")
    columns = []
    for c, kind in docs.dtypes:
        if c == "text":
            columns.append(F.coalesce(part, c).alias(c))
        elif c == "n_chars":
            columns.append(F.when(part.isNull(), F.col(c)).otherwise(F.length(part).cast(kind)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return drawn.select(*columns, *([F.col("_mix_piece.shard").alias(shard_column)] if shard_column else []))


def _feistel_sql(x: str) -> str:
    """One walk of ``drawn_at`` for DuckDB; h is half the bits, k0 to k3 the keys."""
    low = "((1 << h) - 1)"
    rounds = [f"({x} >> h)", f"({x} & {low})"]
    for r in range(ROUNDS):
        rounds.append(f"xor({rounds[r]}, ({rounds[r + 1]} * {STEP} + k{r}) % {PRIME} * {TURN} % {PRIME} & {low})")
    return f"(({rounds[ROUNDS]} << h) | {rounds[ROUNDS + 1]})"


#: The same mix for DuckDB: all draws of a source in their order, until its words are taken.
ORACLE_SQL = rf"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}:' || coalesce(text, '')) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
wt AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
       row_number() OVER (ORDER BY source NULLS LAST) AS ord FROM src),
run AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({MOST} * source_size) OVER (ORDER BY source_size / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY source_size / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft,
    row_number() OVER (ORDER BY source_size / w, ord) AS pos FROM wt),
lvl AS (
  SELECT capped AS c, wleft AS wl, pos AS p FROM run
  WHERE ({SHARE} * total - 100 * capped) * w <= 100 * {MOST} * source_size * wleft ORDER BY pos LIMIT 1),
tgt AS (
  SELECT source, source_size, ord - 1 AS place,
    CASE WHEN p IS NULL OR pos < p THEN CAST({MOST} * source_size AS DOUBLE)
         ELSE CAST(w * ({SHARE} * total - 100 * c) AS DOUBLE) / (100.0 * wl) END AS target,
    (source_size + {BLOCK_WORDS} - 1) // {BLOCK_WORDS} AS n
  FROM run LEFT JOIN lvl ON true),
turns AS (
  SELECT *, unnest(range(0, {MOST})) AS turn FROM tgt WHERE n > 0),
keys AS (
  SELECT source, place, n, turn, source_size, target, greatest(1, (CAST(ceil(log2(n)) AS BIGINT) + 1) // 2) AS h,
    {", ".join(f"CAST('0x' || substr(md5('{SEED}:' || place || ':' || turn || ':{r}'), 1, 7) AS BIGINT) AS k{r}" for r in range(ROUNDS))}
  FROM turns),
blocks AS (SELECT place, turn, n, h, k0, k1, k2, k3, unnest(range(0, n)) AS block FROM keys),
walk AS (
  SELECT place, turn, n, h, k0, k1, k2, k3, block, {_feistel_sql("block")} AS x FROM blocks
  UNION ALL
  SELECT place, turn, n, h, k0, k1, k2, k3, block, {_feistel_sql("x")} AS x FROM walk WHERE x >= n),
drawn AS (
  SELECT k.source, k.place, block, k.turn * k.n + x AS t, least({BLOCK_WORDS}, source_size - {BLOCK_WORDS} * block) AS words, CAST(floor(target) AS BIGINT) AS want
  FROM walk JOIN keys k ON walk.place = k.place AND walk.turn = k.turn WHERE x < walk.n),
given AS (
  SELECT place, block, greatest(0, least(words, want - coalesce(sum(words) OVER (PARTITION BY place ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS got
  FROM drawn),
d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a,
    row_number() OVER () AS rn
  FROM s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source),
parts AS (SELECT rn, place, a, size, unnest(range(a // {BLOCK_WORDS}, (a + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM d WHERE size > 0),
sums AS (
  SELECT rn, sum(greatest(0, least({BLOCK_WORDS} * block + got, a + size) - greatest({BLOCK_WORDS} * block, a))) AS taken
  FROM parts JOIN given USING (place, block) GROUP BY rn)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d LEFT JOIN sums USING (rn)
"""
