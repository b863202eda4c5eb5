"""Source divergence and collocations against brute force, and on odd tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import collocations, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string"
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    words = ["the", "The", "of", "new", "York", "ÉTÉ", "naïve", "東京", "x1y", "a_b", "don't", "state", "\x00zero", "ß", "co-op", "ſ"]
    out = [(i, " ".join(r.choices(words, range(len(words), 0, -1), k=r.randrange(1, 60))) + r.choice(["", ".", "!\n", ", "]), r.choice(["en", "en", "en", "de"]), r.choice("pqrs")) for i in range(120)]
    out += [(1000 + i, "new york state of mind. new york state of mind; new york" + " the" * (i % 4), "en", None) for i in range(20)]
    out += [(None, None, None, None), (None, "", "en", "only empty"), (5, "alone\t words", "xx", "p"), (5, "alone", "xx", "q"), (7, "word " * 5000, "en", "p")]
    return out + out[:3]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("phrase", F.lit(1)).repartition(3)


def brute_divergence(rows, min_docs, top):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(source_divergence.TERM_PATTERN, (text or "").translate(CAPITALS))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, c in in_docs[lang].items() if c >= min_docs), key=lambda t: t.encode())
        sources = [s for g, s in groups if g == lang]
        whole = Counter()
        for s in sources:
            whole += counts[lang, s]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept]

        def diff(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(map(diff, p[s], p[o])), o) for o in sources if o != s]
            terms = [(diff(a, b), t) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), start=1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "cells"), [(4096, 1 << 21), (3, 8)])
def test_divergence_equals_brute_force(spark, docs, rows, monkeypatch, chunk, cells):
    monkeypatch.setattr(source_divergence, "CHUNK", chunk)
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    got = sorted(map(tuple, source_divergence.audit(docs).collect()))
    assert got == brute_divergence(rows, 10, 10)
    assert any(r[0] == "xx" and r[4] == 0 for r in got)


def test_shares_are_exact_for_large_counts():
    r = random.Random(3)
    total = np.array([r.randrange(10**15, 9 * 10**15) for _ in range(200)], dtype=np.int64)
    count = np.array([r.randrange(int(t)) for t in total], dtype=np.int64)
    assert source_divergence._shares(count, total).tolist() == [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(count, total, strict=True)]
    with pytest.raises(OverflowError):
        source_divergence._shares(count[:1], np.array([9 * 10**15], dtype=np.int64))


def brute_collocations(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= min_count}
        covered = {p[i:j] for p, c in frequent.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and c >= counts[p[i:j]]}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in covered:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], start=1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("min_count", "top", "bits"), [(20, 2000, 1 << 28), (20, 7, 1 << 16), (3, 2000, 1 << 16)])
def test_collocations_equal_brute_force(docs, rows, monkeypatch, min_count, top, bits):
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    got = sorted(map(tuple, collocations.mine(docs, min_count=min_count, top=top).collect()))
    assert got == brute_collocations(rows, min_count, top)
    assert len(got) > 5


def test_a_full_bit_field_loses_nothing(docs, rows, monkeypatch):
    """With every bit set no phrase is held back, and the counts decide alone."""
    monkeypatch.setattr(collocations, "bit_field", lambda grams, k: np.full(1 << 13, 255, dtype=np.uint8))
    assert sorted(map(tuple, collocations.mine(docs, min_count=20).collect())) == brute_collocations(rows, 20, 2000)


def test_scores_beyond_64_bits(spark):
    big = 10**13
    tables = [
        spark.createDataFrame([("en", None, 10**14), ("en", "a", big), ("en", "b", big)], "lang string, phrase string, f long"),
        spark.createDataFrame([("en", "a b", big - 7)], "lang string, phrase string, f long"),
    ]
    row = collocations.scored(tables).first()
    assert row["score"] == 1000 * (big - 7) * 10**14 // (big * big)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert source_divergence.audit(none).count() == 0
    assert collocations.mine(none).count() == 0
