"""Language identification in two steps: the family first, then the language within it.

A text is a vector of hashed character 1-, 2- and 3-grams over the whole text
(square roots of shares, one block per length). Linear support vector machines,
one against one, first choose between families and then between the languages
of the chosen family, so closely related languages get hyperplanes of their
own. Votes decide; the margins of the voters, as logistic values, give the
score, the product of both steps.

Training takes at most about ``max_docs`` texts per language, chosen by a hash
of doc_id, and runs on Spark (hinge loss, pyspark.ml). The model is one row of
``DIMENSIONS`` weights per pair of classes. Scoring is one pass without a
shuffle. Null texts and texts without a letter are ``und`` with score 0; with
no labelled text at all everything is ``und``. Of equal votes the larger margins win, then the class that comes last
by name. Equal rows get equal answers; ids pass through untouched, whether null, large or
repeated; texts of any length are read whole, and an empty table gives an empty table. Only
``doc_id``, ``text`` and, to learn, ``lang`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_fold, materialize

MAX_DOCS = 1000
#: Families of common language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
    "sinitic": ("zh", "yue"),
}
BLOCKS = (512, 1536, 2048)
DIMENSIONS = sum(BLOCKS)
#: Characters hashed at a time, which bounds memory for very long texts.
PIECE = 1 << 18


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members), lang)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, DIMENSIONS long."""
    counts = np.zeros(DIMENSIONS)
    lowered = text.lower()
    for at in range(0, max(1, len(lowered)), PIECE):
        piece = lowered[at : at + PIECE + 2]
        cp = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        hashed, offset = cp * 40503, 0
        for n, size in enumerate(BLOCKS):
            if n:
                hashed = hashed[:-1] * 69069 + cp[n:] * 40503 if len(hashed) > 1 else hashed[:0]
                hashed &= 0x3FFFFFFF
            own = hashed[: min(len(hashed), PIECE)]
            counts[offset : offset + size] += np.bincount(((own >> 3) ^ own) % size, minlength=size)[:size]
            offset += size
    out, offset = np.zeros(DIMENSIONS), 0
    for size in BLOCKS:
        block = counts[offset : offset + size]
        out[offset : offset + size] = np.sqrt(block / max(1.0, block.sum()))
        offset += size
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """Pairs of classes with their weights and intercepts, for families and inside each."""

    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def choose(self, classes: list[str], x: np.ndarray) -> tuple[str, float]:
        if len(classes) == 1:
            return classes[0], 1.0
        votes = dict.fromkeys(classes, 0)
        trust = dict.fromkeys(classes, 0.0)
        for a, b in combinations(classes, 2):
            w, c = self.pairs[a, b]
            m = float(x @ w) + c
            votes[b if m > 0 else a] += 1
            p = 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
            trust[b] += p
            trust[a] += 1 - p
        best = max(classes, key=lambda k: (votes[k], trust[k], k))
        return best, trust[best] / (len(classes) - 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.members or not has_letter(text):
            return "und", 0.0
        x = features(text)
        family, p = self.choose(sorted(self.members), x)
        lang, q = self.choose(self.members[family], x)
        return lang, p * q


def _vectors(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):  # a vector is 32 KB
                part = b.iloc[k : k + 256]
                rows = [(lang, features(t)) for lang, t in zip(part["lang"], part["text"], strict=True) if has_letter(t)]
                yield pd.DataFrame(rows, columns=["lang", "x"])

    raw = texts.select("lang", "text").mapInPandas(run, "lang string, x array<float>")
    return raw.select("lang", array_to_vector("x").alias("features"))


def train(docs: DataFrame, usable: Column, max_docs: int = MAX_DOCS) -> Model:
    """Model from the rows for which ``usable`` holds and lang is not null."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (draw < int(1_000_003 * min(1.0, max_docs / n)) + 1))
    vectors = materialize(_vectors(rows.filter(keep)))
    langs = sorted(r["lang"] for r in vectors.select("lang").distinct().collect())
    model = Model()
    for lang in langs:
        model.members.setdefault(family_of(lang), []).append(lang)
    groups = [("families", {f: ls for f, ls in sorted(model.members.items())})]
    groups += [(f, {x: [x] for x in ls}) for f, ls in sorted(model.members.items())]
    for _, classes in groups:
        for a, b in combinations(sorted(classes), 2):
            both = vectors.filter(F.col("lang").isin(*classes[a], *classes[b]))
            both = both.select("features", F.col("lang").isin(*classes[b]).cast("double").alias("label"))
            fit = LinearSVC(maxIter=25, regParam=1e-3, standardization=False, aggregationDepth=2).fit(both)
            model.pairs[a, b] = (np.asarray(fit.coefficients.toArray()), float(fit.intercept))
    return model


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """Learn from rows with a language outside the held-out fold, predict all rows."""
    held_out = doc_fold(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return predict_languages(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
