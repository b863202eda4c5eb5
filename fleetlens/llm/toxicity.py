"""Toxicity by two class-conditional Kneser-Ney bigram models with shared back-off.

Toxic and ordinary texts of the labelled rows each give a bigram model with
absolute discounting. Both back off to one continuation distribution counted
over both classes, and their back-off masses are made equal (per class and per
context), so an expression that neither class knows has the same probability
under both and says nothing; a rare expression leans on the shared counts. So
does a common one whose document counts do not tell the classes apart (a G test
below ``GATE``): chance differences between the two samples, such as their mix
of languages, would otherwise outweigh the few words that matter.

A text's evidence is the mean over its words of the log-likelihood ratio.
Held-back training rows turn it into a score by a logistic curve. Null, empty
and wordless texts have evidence 0 and the score that goes with it.

Training reads at most ``max_docs`` labelled texts per class, chosen by a hash
of doc_id; n-grams are counted on Spark. The model on the executors has at most
``max_entries`` words and as many bigrams (the count threshold rises until it
fits). Scoring is a pass over all texts without a shuffle. Rows that repeat get
the same score each, ids may be null (such rows are scored and never learnt
from), an empty table gives no rows, texts are read whole, ties of the
threshold count as toxic. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, materialize

MAX_DOCS = 4000
MAX_ENTRIES = 300_000
DISCOUNT = 0.75
#: G statistic of document counts from which a word's or pair's own class counts are used.
GATE = 16.0
THRESHOLD = 0.7
#: One in so many training texts sets the logistic curve instead of counts.
HOLD_BACK = 4

_word = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


@dataclass
class Model:
    """Log-likelihood ratios: by word, and by known pair of words where that differs."""

    vocabulary: dict[str, int]
    by_word: np.ndarray
    pairs: np.ndarray
    by_pair: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def evidence(self, text: str | None) -> float:
        words = words_of(text)
        if not words:
            return 0.0
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        ratio = self.by_word[ids]
        if len(self.pairs):
            before = np.concatenate(([len(self.by_word) - 1], ids[:-1]))
            keys = before * len(self.by_word) + ids
            at = np.searchsorted(self.pairs, keys)
            at[at == len(self.pairs)] = 0
            ratio = np.where(self.pairs[at] == keys, self.by_pair[at], ratio)
        return float(ratio.mean())

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -40, 40)))


def g_statistic(d0: np.ndarray, d1: np.ndarray, docs: tuple[float, float]) -> np.ndarray:
    """G of the documents with and without an expression, by class."""
    n0, n1 = max(docs[0], 1.0), max(docs[1], 1.0)
    total = np.zeros(len(d0))
    for with0, with1 in ((d0, d1), (n0 - d0, n1 - d1)):
        both = with0 + with1
        for own, n in ((with0, n0), (with1, n1)):
            expected = both * n / (n0 + n1)
            total += 2 * np.where(own > 0, own * np.log(np.maximum(own, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    return total


def build_model(words: pd.DataFrame, grams: pd.DataFrame, sums: dict[str, float], d: float = DISCOUNT, gate: float = GATE) -> Model:
    """From words(w, c0, c1, d0, d1, left) and grams(u, w, c0, c1, d0, d1, u0, u1, t0, t1).

    c: occurrences, d: documents, left: different words before it, u: occurrences
    of the context, t: different words after it. ``sums`` has the totals over
    all words: c0, c1, types t0, t1, left, and documents docs0, docs1.
    """
    n = [max(1.0, sums["c0"]), max(1.0, sums["c1"])]
    docs = (sums["docs0"], sums["docs1"])
    mass = [d * sums["t0"] / n[0], d * sums["t1"] / n[1]]
    shared = (words["left"].to_numpy(dtype=float) + 0.5) / (sums["left"] + 0.5 * (len(words) + 1))
    top = min(0.999, max(*mass, 1e-6))
    prob = []
    for c in (0, 1):
        own = np.maximum(words[f"c{c}"].to_numpy(dtype=float) - d, 0) / n[c]
        prob.append(own * (1 - top) / max(1e-9, 1 - mass[c]) + top * shared)
    vocabulary = {w: i + 1 for i, w in enumerate(words["w"])}
    size = len(vocabulary) + 2  # 0: unknown, last: start of text
    apart = g_statistic(words["d0"].to_numpy(dtype=float), words["d1"].to_numpy(dtype=float), docs) >= gate
    by_word = np.concatenate(([0.0], np.where(apart, np.log(prob[1]) - np.log(prob[0]), 0.0), [0.0]))
    w = grams["w"].map(vocabulary).to_numpy(dtype=np.int64)
    u = grams["u"].map(lambda x: vocabulary.get(x, 0) if x else size - 1).to_numpy(dtype=np.int64)
    context = [np.maximum(grams[f"u{c}"].to_numpy(dtype=float), 1.0) for c in (0, 1)]
    back = [np.where(grams[f"u{c}"] > 0, d * grams[f"t{c}"].to_numpy(dtype=float) / context[c], 1.0) for c in (0, 1)]
    most = np.minimum(1.0, np.maximum(back[0], back[1]))
    log = []
    for c in (0, 1):
        own = np.maximum(grams[f"c{c}"].to_numpy(dtype=float) - d, 0) / context[c]
        own *= (1 - most) / np.maximum(1e-9, 1 - np.minimum(back[c], 1 - 1e-9))
        log.append(np.log(own + most * prob[c][w - 1]))
    known = (u > 0) & (g_statistic(grams["d0"].to_numpy(dtype=float), grams["d1"].to_numpy(dtype=float), docs) >= gate)
    # Words that say nothing alone or in a pair are as good as unknown: the executors need not hold them.
    use = np.zeros(size, dtype=bool)
    use[u[known]] = use[w[known]] = True
    use |= by_word != 0
    use[0] = use[-1] = False
    new = np.cumsum(use)
    last = int(new[-1]) + 1
    new[~use], new[-1] = 0, last
    kept = {x: int(new[i]) for x, i in vocabulary.items() if use[i]}
    keys, ratio = (new[u] * (last + 1) + new[w])[known], (log[1] - log[0])[known]
    order = np.argsort(keys)
    return Model(kept, np.concatenate(([0.0], by_word[use], [0.0])), keys[order], ratio[order])


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, ridge: float = 1e-5) -> tuple[float, float]:
    """Slope and shift of a logistic curve, classes weighing alike, by Newton steps."""
    if not len(toxic) or toxic.min() == toxic.max():
        return 1.0, 0.0
    scale = evidence.std() or 1.0
    x = np.column_stack([evidence / scale, np.ones(len(evidence))])
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        g = x.T @ (weight * (p - toxic)) / len(toxic) + ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x / len(toxic) + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / scale), float(b[1])


def _counts(texts: DataFrame) -> DataFrame:
    """(u, w, c0, c1, d0, d1): occurrences and documents by class of pairs of neighbours, and with u null of words.

    u is '' at the start of a text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count: Counter = Counter()
            within: Counter = Counter()
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                words = words_of(text)
                own = Counter(zip(["", *words], words, [int(toxic)] * len(words), strict=False))
                own.update(zip([None] * len(words), words, [int(toxic)] * len(words), strict=True))
                count.update(own)
                within.update(own.keys())
            if count:
                u, w, c = zip(*count, strict=True)
                yield pd.DataFrame({"u": u, "w": w, "toxic": c, "n": list(count.values()), "docs": [within[k] for k in count]})

    pairs = texts.select("text", "toxic").mapInPandas(run, "u string, w string, toxic int, n long, docs long")
    sums = [
        F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col(x))), F.lit(0)).alias(f"{k}{c}") for k, x in (("c", "n"), ("d", "docs")) for c in (0, 1)
    ]
    return pairs.groupBy("u", "w").agg(*sums)


def _largest(df: DataFrame, n: Column, most: int, least: int) -> DataFrame:
    """Rows whose count n reaches the smallest threshold, ``least`` or more, that keeps ``most`` rows at most."""
    # A row for each different count: fewer than the square root of twice the sample's words.
    sizes = sorted((r["n"], r["k"]) for r in df.select(n.alias("n")).groupBy("n").agg(F.count("*").alias("k")).collect())
    left, bound = 0, sizes[-1][0] + 1 if sizes else 1
    for count, k in reversed(sizes):
        if count < least or left + k > most:
            break
        left, bound = left + k, count
    return df.filter(n >= bound)


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_docs: int = MAX_DOCS, max_entries: int = MAX_ENTRIES) -> Model:
    """Model from the rows of ``labels`` for which ``usable`` holds, joined with their texts."""
    spark = docs.sparkSession
    rows = labels.filter(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    keep = F.lit(False)
    for c, n in sizes.items():
        keep = keep | ((F.col("toxic") == c) & (draw < math.ceil(1_000_003 * min(1.0, max_docs / n))))
    chosen = rows.filter(keep)  # at most about max_docs per class, twelve bytes each
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Copies of a text count once.
    once = texts.groupBy(F.xxhash64("text").alias("_h")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    texts = materialize(once.drop("_h"))
    back = F.pmod(F.xxhash64("doc_id", F.lit("curve")), F.lit(HOLD_BACK)) == 0
    all_counts = materialize(_counts(texts.filter(~back)))
    single, pairs = all_counts.filter("u is null").drop("u"), all_counts.filter("u is not null")
    left = pairs.groupBy("w").agg(F.count("*").alias("left"))
    by_context = pairs.groupBy("u").agg(
        F.sum("c0").alias("u0"), F.sum("c1").alias("u1"),
        F.count_if(F.col("c0") > 0).alias("t0"), F.count_if(F.col("c1") > 0).alias("t1"),
    )
    sums = single.agg(
        F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.count_if(F.col("c0") > 0).alias("t0"), F.count_if(F.col("c1") > 0).alias("t1")
    ).first().asDict()
    sums["left"] = pairs.count()
    sums |= {f"docs{c}": texts.filter(~back & (F.col("toxic") == c)).count() for c in (0, 1)}
    sums = {k: float(v or 0) for k, v in sums.items()}
    seen = F.col("c0") + F.col("c1")
    words = _largest(single, seen, max_entries, 2).join(left, "w").toPandas().sort_values("w", ignore_index=True)
    grams = _largest(pairs, seen, max_entries, 3).join(by_context, "u").toPandas()
    grams = grams[grams["w"].isin(set(words["w"]))].sort_values(["u", "w"], ignore_index=True)
    model = build_model(words, grams, sums)
    held = texts.filter(back)
    shared = spark.sparkContext.broadcast(model)
    pdf = held.select("toxic", evidence_of(F.col("text"), shared).alias("evidence")).toPandas()
    if len(pdf) < 20 or pdf["toxic"].nunique() < 2:  # too few rows to hold any back
        pdf = texts.select("toxic", evidence_of(F.col("text"), shared).alias("evidence")).toPandas()
    model.slope, model.shift = fit_curve(pdf["evidence"].to_numpy(dtype=float), pdf["toxic"].to_numpy(dtype=float))
    return model


def evidence_of(text: Column, shared) -> Column:
    """Evidence of each text under a broadcast model; other columns stay in the JVM."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for b in batches:
            yield pd.Series([model.evidence(t) for t in b], dtype=float)

    return run(text)


def score_of(evidence: Column, model: Model) -> Column:
    z = F.lit(model.slope) * evidence + F.lit(model.shift)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, evidence) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", evidence_of(F.col("text"), shared).alias("evidence"))
    score = score_of(F.col("evidence"), model)
    return scored.select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows that the model does not reject, each judged by itself: nothing is joined or moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.filter(score_of(evidence_of(F.col("text"), shared), model) < threshold)


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows outside the held-out fold, score all rows."""
    held_out = doc_fold(F.col("doc_id"), 3) == 1
    model = train(docs, labels, ~held_out)
    return score_documents(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
