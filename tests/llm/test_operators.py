"""Each training-data operator against a brute-force version, and on odd tables."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import decontamination, hilbert_shards, language_id, license_scan, mixing, quality_rules, simhash, substring_dedup, token_shards, toxicity
from fleetlens.llm.common import connected_components, with_running_sums
from fleetlens.llm.suffix_grouping import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, lang="en", sources=("a", "b", None)):
    rows = [(i, t, lang, sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, one long text, ties, a repeated row, a column with a clashing name."""
    texts = [None, "", "   \n ", "one", prose(1, 30_000), prose(2, 60), prose(2, 60), "A" * 5000, prose(3, 40) + "\n" + prose(3, 40)]
    base = docs_of(spark, texts)
    return base.union(base.filter("doc_id = 5")).withColumn("size", F.lit("clash")).withColumn("score", F.lit(None).cast("string")).withColumn("fp", F.lit(1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- shared helpers


def test_running_sums(spark):
    rows = [(i % 3 if i % 7 else None, i, i * i % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, i int, v long")
    got = {(r["g"], r["i"]): r["s"] for r in with_running_sums(df, ["g", "i"], {"s": F.col("v")}, by=["g"], partitions=7).collect()}
    total = Counter()
    for g, i, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        assert got[g, i] == total[g]
        total[g] += v


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {row["node"]: row["root"] for row in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}
    for x in nodes:
        low[find(x)] = min(low.get(find(x), x), x)
    assert got == {x: low[find(x)] for x in nodes}


def test_components_of_few_links_take_few_tasks(spark):
    sc, conf = spark.sparkContext, spark.conf
    old = {k: conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("40", "false"), strict=True):
            conf.set(k, v)
        sc.setJobGroup("components", "")
        edges = spark.range(30).selectExpr("id AS a", "id + 1 AS b")
        assert {r["root"] for r in connected_components(edges).collect()} == {0}
        tracker = sc.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup("components") for i in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for i in stages if (x := tracker.getStageInfo(i)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            conf.set(k, v)
    assert tasks < 1200


def test_suffix_array():
    r = random.Random(2)
    for _ in range(500):
        s = [r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(1, 60))] + [0]
        assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


# --- 1 licences


def test_licences(spark, odd, empty):
    texts = [prose(i, 50) for i in range(60)]
    texts += [prose(70, 30) + "\nReleased under the MIT License.\n" + prose(71, 30), "Licensed under the Apache License, Version 2.0.", "The licence plate was covered in mud.\n" + prose(72, 20), None, ""]
    out = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    assert len(out) == len(texts) and out[60]["family"] == "MIT" and out[61]["family"] == "Apache-2.0"
    assert all(out[i]["family"] == "none" for i in [*range(60), 62, 63, 64])
    model = license_scan.train(docs_of(spark, texts))
    assert license_scan.scan(odd, model).filter("family <> 'none'").count() == 0 and license_scan.scan(odd, model).count() == odd.count()
    assert license_scan.scan(empty).count() == 0


def test_licences_over_lines_and_of_unseen_families(spark):
    """Wrapped notices, families with one notice, licences that nothing was trained on, and words that only sound like one."""
    body = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    )
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    bsd = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    wanted = [
        (body, {"MIT"}), (prose(1, 40) + "\n\n" + textwrap.fill(body, 72) + "\n\n" + prose(2, 40), {"MIT"}), (textwrap.fill(isc, 60), {"ISC"}), (bsd, {"BSD"}),
        ("You should have received a copy of the GNU General Public License along with this program.", {"GPL"}),
        ("Hiermit wird jeder Person, die eine Kopie dieser Software erhält, unentgeltlich die Erlaubnis erteilt, sie zu nutzen.", {"unknown"}),
        ("Licensed under the Sun Industry Standards Source License version 1.2.", {"unknown"}), ("She got permission to copy the key.", {"none"}), (prose(3, 60) + "\n" + prose(4, 60), {"none"}),
    ]
    docs = docs_of(spark, [t for t, _ in wanted] + [prose(i, 50) for i in range(100, 160)])
    got = {r["doc_id"]: r["family"] for r in license_scan.scan(docs).collect()}
    assert all(got[i] in families for i, (_, families) in enumerate(wanted)), got
    assert {got[i] for i in range(len(wanted), len(got))} == {"none"}


# --- 2 decontamination


def test_decontamination(spark, odd, empty):
    item = "If a train leaves Boston at 9 and travels 60 miles each hour then how far from Boston is it after 9 hours of travel"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, prose(4, 30))], "item_id long, text string")
    filler = "some quite ordinary words stand here before it and "
    other = item.replace("Boston", "Paris").replace("60 miles", "75 km").replace(" 9", " 4")
    contradicts = item.replace("Boston at 9", "Paris at 4").replace("from Boston", "from London")
    texts = [filler + item.lower() + filler, filler + other + " " + filler, filler + contradicts + " " + filler, filler * 5, None, "", prose(4, 30), " ".join(prose(4, 30).split()[:12])]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_contaminated(docs_of(spark, texts), bench).collect()}
    assert (1, 1) in got and got[1, 1]["n_changed"] > 0 and (6, 4) in got and (2, 1) not in got
    assert not any(d in (3, 4, 5, 7) for d, _ in got)
    assert decontamination.find_contaminated(odd, bench).count() == 0 and decontamination.find_contaminated(empty, bench).count() == 0
    assert decontamination.find_contaminated(odd, bench.limit(0)).count() == 0
    kept = decontamination.without_contaminated(odd, bench)
    assert kept.count() == odd.count() and kept.columns == odd.columns


ITEM = "If a train leaves Boston at 9 and travels 60 miles each hour then how far from Boston is it after 9 hours of travel"


def pairs_of(spark, texts, items):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(docs_of(spark, texts), bench).collect()}


def test_decontamination_in_any_case_and_of_any_item(spark):
    """Copies in other case; items of few tokens or without words enough for a window."""
    title, upper = " ".join(w[:1].upper() + w[1:] for w in ITEM.split()), ITEM.upper()
    items = [ITEM, "too short", "12 34 km by 56 or 78 90", "Alice Smith 1 2 3 4 5 6 7"]
    texts = [
        "some words before " + ITEM.lower() + " and some after", title, upper, "it is TOO short here", "too long and short", "so 12 34 km by 56 or 78 90 it is",
        "so 12 34 km by 56 or 78 91 it is", "then ALICE smith 1 2 3 4 5 6 7.", "Alice Jones 1 2 3 4 5 6 7",
    ]
    assert pairs_of(spark, texts, items) == {(0, 0), (1, 0), (2, 0), (3, 1), (5, 2), (7, 3)}


def test_decontamination_judges_every_alignment(spark):
    """A contradicting frame before a copy with other values; a copy with a word more; two halves that contradict each other."""
    names = "we hear that Smith John lives near Smith and John by the old mill and walks every morning to the harbour where Smith meets John beside boats"
    other = ITEM.replace("Boston", "Paris").replace("60 miles", "75 km").replace(" 9", " 4")
    contradicts = ITEM.replace("Boston at 9", "Paris at 4").replace("from Boston", "from London")
    renamed = names.replace("Smith", "Brown").replace("John", "Peter")
    inserted = renamed.replace("mill and walks", "mill and slowly walks")
    swapped = inserted.replace("where Brown meets Peter", "where Peter meets Brown")
    texts = [contradicts + " and then we say that " + other, inserted, swapped, contradicts]
    assert pairs_of(spark, texts, [ITEM, names]) == {(0, 0), (1, 1)}


# --- 3 toxicity, 7 languages


def test_toxicity(spark, odd, empty):
    r = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        words = prose(i, 80, 2000).split()
        bad = i % 5 == 0
        for k in range(0, len(words), 20) if bad else []:
            words[k] = r.choice(["grobbin", "snarfle", "plonk"])
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    d = docs_of(spark, texts)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.toxic_scores(d, lab).collect()
    held = [x for x in out if x["held_out"]]
    assert len(out) == 600 and {x["doc_id"] for x in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(x["predicted"] == (x["doc_id"] % 5 == 0) for x in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 for x in out)
    scored = toxicity.toxic_scores(odd, lab)
    assert scored.count() == odd.count() and scored.filter("score is null").count() == 0
    assert toxicity.toxic_scores(empty, lab).count() == 0
    assert toxicity.toxic_scores(odd, lab.limit(0)).filter("predicted = 1").count() == 0


def test_languages(spark, odd, empty):
    stems = {"en": ("the", "ing", "th", "sh"), "de": ("sch", "ung", "der", "ein"), "fr": ("eau", "que", "ion", "les"), "es": ("cion", "los", "que", "ado")}
    r = random.Random(3)
    rows = []
    for i in range(800):
        lang = ("en", "de", "fr", "es")[i % 4]
        rows.append((i, " ".join("".join(r.choices(stems[lang], k=r.randint(1, 3))) for _ in range(30)), lang, "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "12 34 !!", "en", "s", 0), (902, "", None, "s", 0)]
    out = language_id.languages(spark.createDataFrame(rows, SCHEMA)).collect()
    held = [x for x in out if x["held_out"] and x["doc_id"] < 800]
    assert sum(x["lang_pred"] == ("en", "de", "fr", "es")[x["doc_id"] % 4] for x in held) >= 0.98 * len(held)
    assert {x["lang_pred"] for x in out if x["doc_id"] >= 900} == {"und"} and all(0 <= x["score"] <= 1 for x in out)
    assert language_id.languages(odd).count() == odd.count() and language_id.languages(empty).count() == 0


# --- 4 mixing


def test_quotas_are_highest_quotients():
    r = random.Random(4)
    for _ in range(200):
        votes = [float(r.randint(0, 50)) for _ in range(r.randint(1, 7))]
        most = [r.randint(0, 30) for _ in votes]
        seats = min(r.randint(0, 60), sum(m for m, v in zip(most, votes) if v))
        ranked = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(most[i])))[:seats]
        expected = Counter(i for _, i in ranked)
        if sum(votes):
            assert mixing.sainte_lague(votes, seats, most) == [expected[i] for i in range(len(votes))]


def test_draws_are_permutations_and_small_sources_meet_their_targets(spark):
    for n in (1, 2, 3, 50, 1000):
        keys = mixing.round_keys(1, 2, n)
        assert sorted(mixing.drawn_at(np.arange(n), n, keys).tolist()) == list(range(n))
    d = docs_of(spark, ["a b c", "d " * 40, "e " * 3000, "f " * 70], sources=("s", "t", "u", None))
    for r in mixing.mix(d).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert r["taken"] == int(r["target"]) > 0


def test_mix(spark, odd, empty):
    texts = [prose(i, 5 + i * 37 % 400) for i in range(120)] + [None, ""]
    d = docs_of(spark, texts, sources=("a", "a", "b", "c", None, "d"))
    out = mixing.mix(d).collect()
    total = sum(r["size"] for r in out)
    assert len(out) == 122 and all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = {}
    for r in out:
        by.setdefault(r["source"], [r["target"], r["source_size"], 0])[2] += r["taken"]
    assert all(got == int(t) and t <= 2 * size for t, size, got in by.values())
    # Quotas of the shards: apportionments of 1, 2, ... shards, drawn as whole blocks.
    sizes = sorted(((x, v[1]) for x, v in by.items()), key=lambda x: (x[0] is None, x[0] or ""))
    for p in mixing.plan(sizes):
        drawn = np.diff([0, *p["shard_ends"]])
        got = np.array([r["by_shard"] for r in out if r["source"] == p["source"]]).sum(axis=0)
        assert got.sum() == int(p["target"]) and all(a <= mixing.BLOCK_WORDS * n for a, n in zip(got, drawn)) and got.max() > 0
        assert sum(mixing.BLOCK_WORDS * n - a for a, n in zip(got, drawn)) <= 3 * mixing.BLOCK_WORDS
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * total) < 1e-6 * total
    text = mixing.mixed_documents(d)
    words = Counter()
    for r in text.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert words == Counter({r["doc_id"]: r["taken"] for r in out if r["taken"]}) and text.columns == d.columns
    by_shard = Counter()
    for r in mixing.mixed_documents(d, shards=16, shard_column="in_shard").collect():
        by_shard[r["doc_id"], r["in_shard"]] += len(WORD.findall(r["text"]))
    assert by_shard == Counter({(r["doc_id"], k): n for r in out for k, n in enumerate(r["by_shard"]) if n})
    clash = d.withColumns({c: F.lit("x") for c in ("taken", "start", "size", "place", "passes", "part", "shard")})
    assert sorted(map(str, mixing.mixed_documents(clash).select(*d.columns).collect())) == sorted(map(str, text.collect()))
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in out}
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- 5 tokens


def test_permutation():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(token_shards.permute(np.arange(n), n).tolist()) == list(range(n))
    assert token_shards.permute(np.arange(50), 1000, key=1).tolist() != token_shards.permute(np.arange(50), 1000, key=2).tolist()


def test_tokens_and_shards(spark, odd, empty, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(token_shards.VOCABULARY, "rb"))}
    whole = tiktoken.Encoding("test", pat_str=token_shards.SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [prose(i, 20 + i) + "\nÉa ñ  two  spaces\t" + "it's 12.5" for i in range(40)] + [None, "", " x", "x \ny\n z "]
    d = docs_of(spark, texts).coalesce(1)
    path = str(tmp_path / "shards")
    rows = token_shards.training_order(d, path, seq_len=64, shard_slots=8).collect()
    stream = [t for x in texts for t in [*(whole.encode_ordinary(x) if x else []), token_shards.END_OF_TEXT]]
    owner = [i for i, x in enumerate(texts) for _ in range(1 + (len(whole.encode_ordinary(x)) if x else 0))]
    n = -(-len(stream) // 64)
    assert sorted(r["slot"] for r in rows) == list(range(n))
    back = {(s, r["row"]): bytes(r["ids"]) for s in range(-(-n // 8)) for r in token_shards.read_shard(spark, path, s, 64).collect()}
    for r in rows:
        ids = np.frombuffer(back[r["shard"], r["row"]], "<u2").tolist()
        part = stream[r["seq"] * 64 : r["seq"] * 64 + 64]
        assert ids == part + [token_shards.END_OF_TEXT] * (64 - len(part)) and r["n_tokens"] == len(part)
        assert r["doc_ids"] == sorted(set(owner[r["seq"] * 64 : r["seq"] * 64 + 64])) and r["ids_crc32"] == zlib.crc32(back[r["shard"], r["row"]])
        assert r["slot"] == token_shards.permute(np.array([r["seq"]]), n)[0] and (r["shard"], r["row"]) == divmod(r["slot"], 8)
    assert len(back) == n
    assert token_shards.read_shard(spark, path, 0, 64, first_row=3).count() == 5
    assert token_shards.read_shard(spark, path, 0, 64, first_row=9).count() == 0
    assert token_shards.read_records(spark, path, 8 + 5, 2, 64, 8) == [back[1, 5], back[1, 6]]
    assert token_shards.read_records(spark, path, 8 + 7, 9, 64, 8) == [back[1, 7]] and token_shards.read_records(spark, path, 8 * n, 1, 64, 8) == []
    assert sum(r["n_tokens"] for r in token_shards.training_order(odd, str(tmp_path / "odd")).collect()) >= odd.count()
    assert token_shards.training_order(empty, str(tmp_path / "empty")).count() == 0


def test_checksums_are_made_where_records_are_read(spark, tmp_path):
    rows = token_shards.training_order(docs_of(spark, [prose(i, 30) for i in range(10)]), str(tmp_path / "s"), seq_len=64, shard_slots=8)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan  # or each task has two Python workers


def test_shards_from_many_partitions_and_after_a_break(spark, tmp_path):
    """Every partition's stream holds whole documents; a second call writes the shards that are missing and no others."""
    d = docs_of(spark, [prose(i, 30 + i % 17) for i in range(60)]).repartition(5)
    order = token_shards.TrainingOrder(d, seq_len=64, shard_slots=4)
    rows = {(r["shard"], r["row"]): bytes(r["ids"]) for r in order.sequences().collect()}
    assert len(rows) == order.size == order.index().count() and {4 * s + r for s, r in rows} == set(range(order.size))
    total = sum(r["n_tokens"] for r in order.index().collect())
    assert total == sum(sum(x) for x in (r["lengths"] for r in order.packed.collect()))
    path = tmp_path / "broken"
    token_shards.write_shards(order.sequences(), str(path), placed=True)
    kept = {p.name: p.stat().st_mtime_ns for p in path.glob("shard=*/part-*") if p.parent.name != "shard=1"}
    for p in (path / "shard=1").iterdir():
        p.unlink()
    (path / "shard=1").rmdir()
    token_shards.write_shards(order.sequences().repartition(3), str(path))
    assert {p.name: p.stat().st_mtime_ns for p in path.glob("shard=*/part-*") if p.parent.name != "shard=1"} == kept
    assert {(r["shard"], r["row"]): bytes(r["ids"]) for r in token_shards.read_shards(spark, str(path), 64).collect()} == rows


# --- 6 sharding


def test_hilbert_curve_steps_to_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)]).T
    index = hilbert_shards.hilbert_index(cells, 3)
    assert sorted(index.tolist()) == list(range(side**3))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def test_shards(spark, odd, empty):
    d = docs_of(spark, [prose(i % 90, 3 + i % 50) for i in range(333)])
    for law in ("rows", "bytes"):
        out = hilbert_shards.assign_shards(d, law=law).collect()
        counts = Counter(r["shard"] for r in out)
        assert len(out) == 333 and set(counts) <= set(range(40))
        slots = {}
        for r in out:
            slots.setdefault(r["shard"], []).append(r["slot"])
            assert r["size"] == len(r["text_crc32"] and prose(r["doc_id"] % 90, 3 + r["doc_id"] % 50).encode()) + 16
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if law == "rows":
            assert max(counts.values()) - min(counts.values()) <= 1
    got = hilbert_shards.assign_shards(odd).collect()
    assert len(got) == odd.count() and {r["text_crc32"] for r in got if r["doc_id"] in (0, 1)} == {0}
    assert hilbert_shards.assign_shards(empty).count() == 0


# --- 8 substrings


def brute_spans(rows):
    seen, out = set(), {}
    for doc, data in rows:
        cover = bytearray(len(data))
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                cover[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        rest = bytes(x for x, c in zip(data, cover) if not c)
        runs = sum(1 for k in range(len(data)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[doc] = (len(data), sum(cover), runs, hashlib.sha256(rest).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_substrings(spark, hot):
    r = random.Random(11)
    texts = [prose(i, 60) for i in range(25)]
    for i in range(25, 60):
        src = texts[r.randrange(i)]
        a = r.randrange(max(1, len(src) - 150))
        texts.append(prose(i, 12) + src[a : a + r.randrange(90, 300)] + prose(100 + i, 12))
    texts += [None, "", "ab" * 150, "z" * 99, "é" * 120, texts[3], texts[3], texts[30][:100], texts[30][:99]]
    expected = brute_spans([(i, (t or "").encode()) for i, t in enumerate(texts)])
    got = {x["doc_id"]: tuple(x)[1:] for x in substring_dedup.remove_repeats(docs_of(spark, texts), hot=hot).collect()}
    assert got == expected


def test_substrings_of_odd_tables(spark, odd, empty):
    assert substring_dedup.remove_repeats(odd).count() == odd.count() and substring_dedup.remove_repeats(empty).count() == 0


def test_substrings_of_repeated_and_null_ids(spark):
    """Rows of one id with other texts follow each other, null ids come last, equal rows get equal answers, large ids stay."""
    shared = "".join(random.Random(4).choices("abcdefghij ", k=320))
    rows = [(1, "first " * 3 + shared), (1, "other-" * 4 + shared + " end"), (2**60 + 1, shared[:150]), (None, shared + "x"), (None, "yz" * 90), (1, "first " * 3 + shared), (2**53 + 1, "unique text")]
    order = sorted(dict.fromkeys(rows), key=lambda x: (x[0] is None, x[0] or 0, rows.index(x)))
    expected = brute_spans([(i, t.encode()) for i, (_, t) in enumerate(order)])
    got = sorted((tuple(x) for x in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted(((r[0], *expected[order.index(r)]) for r in rows), key=str)
    assert {x[2] for x in got if x[0] == 1} == {0, 320} and sum(x[2] for x in got if x[0] == 2**60 + 1) == 150


def test_large_ids_beside_null_ones(spark):
    ids = [None, 2**53 + 1, 2**60 + 1]
    docs = spark.createDataFrame([(i, prose(9, 40), "en", "a", 1) for i in ids], SCHEMA)
    for found in (substring_dedup.remove_repeats(docs), quality_rules.clean_lines(docs), language_id.predict_languages(docs, language_id.Model())):
        assert sorted((r["doc_id"] for r in found.collect()), key=str) == sorted(ids, key=str)


def test_long_text_in_pieces(spark, monkeypatch):
    text = prose(5, 3000)
    _, pos, ah, ch, r = substring_dedup._anchors([text.encode()])
    whole = sorted(zip(ah.view(np.int64).tolist(), ch.view(np.int64).tolist(), pos.tolist(), r.tolist(), strict=True))
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    got = set()
    for begin, end, offset, piece in substring_dedup._pieces(text.encode()):
        _, pos, ah, ch, r = substring_dedup._anchors([prose(6, 50).encode(), piece, b"short"])
        keep = _ == 1
        got |= {x for x in zip(ah.view(np.int64)[keep].tolist(), ch.view(np.int64)[keep].tolist(), (pos[keep] + offset).tolist(), r[keep].tolist(), strict=True) if begin <= x[2] < end}
    assert sorted(got) == whole


# --- 9 SimHash


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, odd, empty):
    texts = [None, "", "One two", "one TWO", "ÀB çd Éf gh", *(prose(i, 200) for i in range(20))]
    r = random.Random(6)
    for i in range(40):
        words = texts[5 + i % 20].split()
        words[r.randrange(len(words))] = f"new{i}"
        texts.append(" ".join(words))
    out = {x["doc_id"]: x for x in simhash.near_duplicate_groups(docs_of(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [out[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert [out[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert simhash.near_duplicate_groups(odd).count() == odd.count() and simhash.near_duplicate_groups(empty).count() == 0


def test_near_fingerprints_are_linked(spark):
    r = random.Random(9)
    fps = []
    for _ in range(30):
        base = r.getrandbits(64)
        fps += [base, *(base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(4))]
    # Segment values that many different fingerprints share, in either half.
    for half in (0, 32):
        shared, rest = r.getrandbits(32), r.getrandbits(32)
        for _ in range(60):
            other = rest
            for _ in range(r.randrange(6)):
                other ^= 1 << r.randrange(32)
            fps.append((shared ^ (1 << r.randrange(32) if r.random() < 0.3 else 0)) << half | other << (32 - half))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    linked = simhash.links(spark.createDataFrame([(x,) for x in set(signed)], "fp long"))
    roots = {x["node"]: x["root"] for x in connected_components(linked).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j, b in enumerate(fps[:i]):
            if 0 < (a ^ b).bit_count() <= 2:
                assert roots[signed[i]] == roots[signed[j]]
                parent[find(a)] = find(b)
    assert len(set(roots.values())) == len({find(f) for f in fps if (f - (1 << 64) if f >> 63 else f) in roots})


def test_similar_groups(spark, odd, empty):
    texts = [prose(i, 300, 5000) for i in range(30)]
    near = []
    for i in range(30):
        words = texts[i].split()
        for k in (50, 150, 250):
            words[k] = "changed"
        near.append(" ".join(words))
    out = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs_of(spark, texts + near)).collect()}
    assert sum(out[30 + i] == i for i in range(30)) >= 28 and all(out[i] == i for i in range(30))
    assert simhash.similar_groups(odd).count() >= odd.count() and simhash.similar_groups(empty).count() == 0


def test_similar_groups_by_real_similarity(spark):
    """Pairs at a similarity of exactly 0.8 are found, those at 0.756 are not."""
    texts = [prose(i, 364, 50_000) for i in range(120)]

    def changed(i, n):
        words = texts[i].split()
        for k in range(n):
            words[20 + 30 * k] = f"changed{k}"
        return " ".join(words)

    out = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs_of(spark, texts + [changed(i, 8 if i < 80 else 10) for i in range(120)])).collect()}
    assert sum(out[120 + i] == i for i in range(80)) >= 77
    assert all(out[120 + i] == 120 + i for i in range(80, 120)) and all(out[i] == i for i in range(120))


def test_group_of_near_copies_against_all_pairs(spark):
    """More near copies than are compared with each other at a point, some too far from the rest, and a second group next to them."""
    r = random.Random(12)
    bases = [prose(1, 220, 50_000), prose(2, 220, 50_000)]
    texts = []
    for i in range(160):
        words = bases[i % 2].split()
        for k in range(r.choice((1, 1, 2, 3, 4, 6, 9))):
            words[r.randrange(220)] = f"new{i}x{k}"
        texts.append(" ".join(words))
    sets = [simhash.shingle_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                pairs.append((i, j))
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    out = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs_of(spark, texts)).collect()}
    assert sum(out[i] == out[j] for i, j in pairs) >= 0.99 * len(pairs) > 1000
    assert all(find(i) == find(out[i]) for i in range(len(texts)))


def test_texts_without_words_stay_apart(spark):
    out = simhash.similar_groups(docs_of(spark, [None, "", " \n ", "one", "one", None])).collect()
    assert {x["doc_id"]: x["component_id"] for x in out} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 5}


# --- 10 quality


def test_quality(spark, odd, empty):
    good = "\n".join(prose(i, 30) for i in range(4))
    menu = "Home | About | Contact | Shop | Help | Blog | News | Jobs\n" * 1 + "\n".join(f"Item{i} | More{i} | Less{i}" for i in range(12))
    texts = [good, menu, good + "\nAll rights reserved.\nClick here", "SHOUT!! AT!! " * 20, good + "\n" + good, "a b c " * 50, None]
    out = {x["doc_id"]: x for x in quality_rules.clean_lines(docs_of(spark, texts)).collect()}
    assert [out[i]["kept"] for i in range(7)] == [True, False, True, False, False, False, False]
    assert out[2]["clean_text"] == good and out[4]["n_dup_lines"] == 4
    assert quality_rules.clean_lines(odd).count() == odd.count() and quality_rules.clean_lines(empty).count() == 0


def test_repeated_words_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        words = [r.choice("ab") for _ in range(r.randint(0, 40))]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
        assert quality_rules.repeated_window_words(words) == len(covered)


def test_texts_left_apart_at_a_point_all_meet(spark, monkeypatch):
    """Every two texts of a point that are in different groups, also beyond one block, and none of one group."""
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 4)
    r = random.Random(3)
    at = {p: r.sample(range(60), n) for p, n in ((1, 2), (2, 9), (3, 30), (4, 12))}
    roots = {n: n % 7 for n in range(0, 60, 2)}
    rows = spark.createDataFrame([(p, n) for p, nodes in at.items() for n in nodes] + [(5, n) for n in (0, 14, 28)], "point long, node long")
    out = simhash._apart(rows, spark.createDataFrame(list(roots.items()), "node long, root long")).collect()
    expected = [tuple(sorted((a, b))) for nodes in at.values() for k, a in enumerate(nodes) for b in nodes[:k] if roots.get(a, a) != roots.get(b, b)]
    assert sorted(tuple(sorted(x)) for x in out) == sorted(expected)


def test_a_crowd_is_not_compared_with_itself_in_full(spark):
    """Seen from a central text every link is a link to it or among few pairs, whether or not the text all copy is there; the pairs of a crowd were all made."""
    r = random.Random(5)
    base = prose(3, 60).split()
    texts = []
    for k in range(240):
        words = list(base)
        for at in r.sample(range(60), r.choice((1, 2, 2, 3))):
            words[at] = f"w{r.randrange(6)}" if k % 9 == 0 else f"x{r.randrange(10**6)}"
        texts.append(" ".join(words[: 60 - k % 3 * r.choice((0, 0, 8))]))
    sets = [simhash.shingle_set(t) for t in texts]

    def common(i, j):
        return len(np.intersect1d(sets[i], sets[j]))

    def alike(i, j):
        return common(i, j) >= 0.8 * (len(sets[i]) + len(sets[j]) - common(i, j))

    keyed = spark.createDataFrame(list(enumerate(texts)), f"{simhash.ROW} long, text string")
    all_sets = simhash._Sets(keyed, keyed, 5, 42, 126, 0.8)
    links = [(i, j) for j in range(240) for i in range(j) if alike(i, j)]
    for centre in (0, 1, 9):
        rows = spark.createDataFrame([(i, i, centre) for i in range(240)], "node long, root long, centre long")
        seen = all_sets.by_centre(rows)
        near = {a for a, _ in seen.alike().collect()}
        assert near == {i for i in range(240) if i != centre and alike(i, centre)}
        near.add(centre)
        pairs = {tuple(x) for x in seen.may_be_alike().collect()}
        assert all((i, j) in pairs for i, j in links if not (i in near and j in near))
        assert len(pairs) < 240 * 239 / 2 / 4 and len(links) > 200


def test_sets_are_compared_without_batches_of_pairs(spark, monkeypatch):
    """Two sets a pair never go to Python: a batch of long texts' pairs has no bound there."""
    plans = []
    monkeypatch.setattr(simhash, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.localCheckpoint())
    texts = [prose(1, 300, 5000), prose(2, 300, 5000)]
    near = [" ".join([*t.split()[:-1], "changed"]) for t in texts]
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(docs_of(spark, texts + near)).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    compared = [p for p in plans if "own" in p]
    assert compared and not any("PythonUDF" in p or "ArrowEvalPython" in p for p in compared)


def test_anchors_of_a_piece_use_the_memory_of_the_last_one():
    """Arrays of a worker are made once; what a piece has given does not change with the next."""
    pieces = [[prose(i, 400).encode(), b"short", prose(i + 50, 90).encode()] for i in range(3)]
    first = substring_dedup._anchors(pieces[0])
    kept = [x.copy() for x in first]
    own = {k: id(v) for k, v in substring_dedup._own.items()}
    for p in pieces[1:]:
        substring_dedup._anchors(p)
    assert own and {k: id(v) for k, v in substring_dedup._own.items()} == own
    assert all((a == b).all() for a, b in zip(first, kept, strict=True))
    assert all((a == b).all() for a, b in zip(substring_dedup._anchors(pieces[0]), kept, strict=True))
