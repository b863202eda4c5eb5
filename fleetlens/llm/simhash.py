"""SimHash near-duplicates by multi-index hashing.

Two jobs share the method: a fingerprint is cut into segments, every segment has
a table, small Hamming balls around a segment's value are enumerated and looked
up in that table, and what is found there is verified on complete fingerprints.

``near_duplicate_groups`` links 64-bit fingerprints of at most two differing
bits. There are two segments of 32 bits: of two differences one segment holds at
most one, so the ball of radius 1 around one fingerprint's segment holds the
other one's segment, and no pair is missed. In a segment value that many
different fingerprints share (a group of near copies) the other segment is
searched the same way: there the balls of both sides meet at points whose
fingerprints are all at most two bits apart, so each is linked to the smallest
one, and links grow with the number of fingerprints, not with its square.

``similar_rows`` links texts whose sets of word shingles are alike. That takes a
wider fingerprint and a ball over the bits that are least certain (``similar_rows``
says how); the real similarity of the sets decides.

Copies (equal fingerprints, or equal sets) are merged before the search, so a
text that a third of all rows share is one row of it. Null and empty texts have
the fingerprint zero and are linked like any other in ``near_duplicate_groups``;
``similar_rows`` leaves texts without a word alone. Ids may be null or repeat: a
group is named by its smallest id, null where it has none. Rows that repeat each
get their row. An empty table has no groups. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, WORD_PATTERN, connected_components, few_or_shuffled, materialize, row_keyed, stored

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 2
#: Bits of a segment in either job.
SEGMENT = 32
#: A segment value that more different fingerprints share is searched by the other segment.
CROWD = 16
#: Hashes unpacked to bits at a time, which bounds memory for very long texts.
BLOCK = 1 << 16

_word = re.compile(WORD_PATTERN.encode().replace(rb"\x20", rb" "))
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; a text with fewer words is one shingle, one without words none."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    parts = _word.findall(data)
    if not parts:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return np.array([digest(joined, seed)], dtype="<u8")
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=False)], dtype="<u8")


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of their 64 bits, or of 64 bits a column of a matrix of hashes."""
    width = 8 * hashes.itemsize * (hashes.shape[1] if hashes.ndim > 1 else 1)
    counts = np.zeros(width, dtype=np.int64)
    for k in range(0, len(hashes), 255):  # so many fit the sums of one byte
        block = np.ascontiguousarray(hashes[k : k + 255]).view(np.uint8).reshape(-1, width // 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return counts


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash as an unsigned number: a bit is set where over half of the shingle hashes have it."""
    hashes = shingle_hashes(text, shingle, seed)
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", run("text").alias("fp"))


LOW = 0xFFFFFFFF


def _other(segment: Column, fp: Column) -> Column:
    """The 32 bits of a fingerprint outside a segment."""
    return F.when(segment == 0, F.shiftrightunsigned(fp, SEGMENT)).otherwise(fp.bitwiseAND(F.lit(LOW)))


def ball(value: Column) -> Column:
    """A 32-bit value and its neighbours at one bit."""
    flips = F.array(*[F.lit(m).cast("long") for m in [0, *[1 << k for k in range(SEGMENT)]]])
    return F.transform(flips, lambda m: value.bitwiseXOR(m))


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) links that connect every two fingerprints (column fp, all different) at most two bits apart."""
    if max_distance != 2:
        raise ValueError("two segments and balls of radius 1 decide distance 2")
    fp = F.col("fp")
    segments = F.array(
        F.struct(F.lit(0).alias("segment"), fp.bitwiseAND(F.lit(LOW)).alias("value")),
        F.struct(F.lit(1).alias("segment"), F.shiftrightunsigned(fp, SEGMENT).alias("value")),
    )
    table = distinct.select("fp", F.explode(segments).alias("s")).select("fp", "s.segment", "s.value")
    key = (F.shiftleft(F.col("segment").cast("long"), SEGMENT) + F.col("value")).alias("key")
    sizes = table.select(key).groupBy("key").agg(F.count("*").alias("n"))
    probes = table.select("fp", "segment", F.explode(ball(F.col("value"))).alias("value")).select("fp", "segment", key)
    # Most points of a ball are nobody's value; what is left are the table's own rows and near ones.
    hits = stored(probes.join(sizes, "key"), "simhash-hits")

    entries = table.select(key, F.col("fp").alias("other"))
    near = (F.col("fp") > F.col("other")) & (F.bit_count(fp.bitwiseXOR(F.col("other"))) <= max_distance)
    sparse = hits.filter(F.col("n") <= CROWD).join(entries, "key").filter(near).select(fp.alias("a"), F.col("other").alias("b"))

    other = _other(F.col("segment"), fp)
    own = F.when(F.col("segment") == 0, fp.bitwiseAND(F.lit(LOW))).otherwise(F.shiftrightunsigned(fp, SEGMENT))
    at_home = own == F.col("key").bitwiseAND(F.lit(LOW))
    points = F.when(at_home, ball(other)).otherwise(F.array(other))
    crowded = hits.filter(F.col("n") > CROWD).select("fp", "key", F.explode(points).alias("point"))
    met = crowded.select("fp", F.min("fp").over(Window.partitionBy("key", "point")).alias("low"))  # at most 65 rows each
    near_low = (fp != F.col("low")) & (F.bit_count(fp.bitwiseXOR(F.col("low"))) <= max_distance)
    return sparse.union(met.filter(near_low).select(fp.alias("a"), F.col("low").alias("b")))


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    marked = materialize(fingerprints(docs, shingle, seed))
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low_doc")))
    parts = connected_components(links(distinct))
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "low_doc", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low_doc").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# Texts with similar sets of shingles.

#: 20 segments of 32 bits. Of two sets with 0.8 in common a segment's balls meet with 0.18 (simulated), so those of one of 20 do with 0.98.
WIDE_WORDS = 10
#: Least certain bits of a segment, whose 16 fillings are its ball.
FREE = 4
#: Of 640 bits: 97 differ on average at a similarity of 0.8, and this is over three standard deviations more.
WIDE_DISTANCE = 126
SIMILARITY = 0.8
WIDE_SHINGLE = 5
#: Up to so many at a point are all compared with each other.
EVERY_PAIR = 8
#: Most central texts that each text of larger points is compared with.
HEADS = 4
#: In crowds of so many, texts whose groups are still apart are all compared; in larger ones by what they have and the most central text has not.
SMALL_CROWD = 16
#: Texts of a block of a crowd whose groups are still apart; every two blocks are compared.
PAIR_BLOCK = 256
#: Texts that are fingerprinted at a time, which bounds a worker's memory.
AT_ONCE = 500


def _words_of(hashes: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    """``words`` columns of 64 bits for each hash."""
    with np.errstate(over="ignore"):
        z = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(shingle_hashes(text, shingle, seed))


def wide_fingerprints(sets: list[np.ndarray], words: int = WIDE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of sets of hashes, and as many masks: the bits of each 32-bit segment whose votes were closest."""
    votes = np.empty((len(sets), 64 * words), dtype=np.int64)
    for i, s in enumerate(sets):
        votes[i] = sum((bit_counts(_words_of(s[k : k + BLOCK], words)) for k in range(0, len(s), BLOCK)), np.zeros(64 * words, np.int64)) * 2 - len(s)
    fps = np.packbits(votes > 0, axis=1, bitorder="little").view("<u8")
    order = np.argsort(np.abs(votes).reshape(len(sets), -1, SEGMENT), axis=2, kind="stable")[:, :, :FREE]
    masks = np.bitwise_or.reduce(np.uint32(1) << order.astype(np.uint32), axis=2)
    return fps, masks.astype("<u4").view("<u8").reshape(len(sets), words)


def ball_points(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Points of every segment's table at which a fingerprint stands: all fillings of the segment's free bits."""
    n = len(fps)
    values, free = (x.view("<u4").reshape(n, -1).astype(np.uint64) for x in (fps, masks))
    tables = (np.arange(values.shape[1], dtype=np.uint64) << np.uint64(SEGMENT))[None, :]
    points = [values & ~free | tables]
    rest = free.copy()
    for _ in range(FREE):
        lowest = rest & (~rest + np.uint64(1))
        points += [p | lowest for p in points]
        rest ^= lowest
    return np.stack(points, axis=2).reshape(n, -1)


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id of a group of ``similar_rows``."""
    keyed = row_keyed(docs.select("doc_id", "text"))
    found = keyed.select("doc_id", ROW).join(similar_rows(keyed), ROW)
    low = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return found.join(low, "group").select("doc_id", "component_id")


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u8").reshape(len(column), width) if len(column) else np.zeros((0, width), "<u8")


def similar_rows(
    keyed: DataFrame, shingle: int = WIDE_SHINGLE, seed: int = SEED, max_distance: int = WIDE_DISTANCE, similarity: float = SIMILARITY
) -> DataFrame:
    """(row key, group) for texts linked by pairs that share ``similarity`` of their distinct word shingles or more.

    ``keyed`` has row keys (``row_keyed``); a group is named by its smallest one.
    Rows without a word are groups of their own.

    Multi-index hashing over 20 segments of a 640-bit fingerprint. A bit of a
    SimHash is a majority, and similar sets differ mostly where the votes were
    close. So the ball around a segment is not all neighbours at some distance
    but the 16 fillings of its four closest bits, and both sides stand in the
    table at all points of their balls. A point is 32 bits long and has its
    table's number: at 12 million texts (30 GB) 0.05 strangers stand at one.

    Points at which over ``EVERY_PAIR`` texts meet, as groups of near copies do,
    come first: every text is compared with the ``HEADS`` most central ones of
    all its points (those that meet most others over all tables) and with a
    neighbour at the smallest one; what this leaves outside the group of the most
    central one is compared the same way among itself. At the other points all
    texts are compared that crowds have not yet put into one group. In the end all
    texts that still meet in a crowd from different groups are compared, in large
    ones those that can be alike (``_Central``), so no link is lost to the order
    of comparing. The complete fingerprints are verified first, then the sets themselves.
    """

    @F.pandas_udf("same binary, n int, fp binary, free binary")
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            same, n, fp, free = [], [], [], []
            for k in range(0, len(texts), AT_ONCE):
                sets = [shingle_set(t, shingle, seed) for t in texts.iloc[k : k + AT_ONCE]]
                fps, masks = wide_fingerprints(sets)
                same += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                n += [len(s) for s in sets]
                fp += [x.tobytes() for x in fps]
                free += [x.tobytes() for x in masks]
            yield pd.DataFrame({"same": same, "n": n, "fp": fp, "free": free})

    marked = stored(keyed.select(ROW, mark("text").alias("m")).select(ROW, "m.*"), "marked")
    worded = marked.filter("same is not null")
    distinct = stored(worded.groupBy("same").agg(F.min(ROW).alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("free").alias("free")), "distinct")

    def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                part = b.iloc[k : k + AT_ONCE]
                points = ball_points(_matrix(part["fp"], WIDE_WORDS), _matrix(part["free"], WIDE_WORDS))
                yield pd.DataFrame({"point": points.ravel().view(np.int64), "node": np.repeat(part["node"].to_numpy(), points.shape[1])})

    points = distinct.select("node", "fp", "free").mapInPandas(stand, "point long, node long")
    met = points.select("point", "node", F.count("*").over(Window.partitionBy("point")).alias("n")).filter("n > 1")
    met = stored(met.withColumn("crowd", F.sum("n").over(Window.partitionBy("node"))), "met")
    ordered = Window.partitionBy("point").orderBy(F.desc("crowd"), "node")

    def in_crowds(rows: DataFrame) -> DataFrame:
        """(node, others) of rows (point, node, n, crowd): the most central texts over all points, and a neighbour at the smallest one."""
        who = F.struct("crowd", "node")
        heads = F.array_compact(F.array(*[F.nth_value(who, k).over(ordered) for k in range(1, HEADS + 1)]))
        ranked = rows.select("node", "n", heads.alias("heads"), F.lag("node").over(ordered).alias("before"))
        by_node = ranked.groupBy("node").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("heads"))), asc=False).alias("heads"), F.min_by("before", F.when(F.col("before").isNotNull(), F.col("n"))).alias("before"))
        return by_node.select("node", F.array_compact(F.array_append(F.slice("heads", 1, HEADS)["node"], F.col("before"))).alias("others"))

    sets = _Sets(keyed, distinct, shingle, seed, max_distance, similarity)
    crowded = F.col("n") > EVERY_PAIR
    candidates = _pairs(in_crowds(met.filter(crowded)).select("node", F.explode("others").alias("other")))
    found = sets.alike(candidates)
    parts = materialize(connected_components(found))
    rooted = met.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Texts that crowds have already brought together need no further comparison with each other.
    earlier = Window.partitionBy("point").orderBy("node").rowsBetween(1 - EVERY_PAIR, -1)
    small = rooted.filter(~crowded).withColumn("others", F.collect_list(F.struct("root", "node")).over(earlier))
    few = small.select("node", F.filter("others", lambda o: o["root"] != F.col("root"))["node"].alias("others"))
    # What crowds still hold outside the group of their most central text is compared the same way among itself.
    rest = rooted.filter(crowded).withColumn("main", F.first("root").over(ordered)).filter("root <> main").select("point", "node", "n", "crowd")
    further = _pairs(few.union(in_crowds(rest)).select("node", F.explode("others").alias("other")))
    more = sets.alike(further.join(candidates, ["node", "other"], "left_anti"))
    if more.limit(1).count():
        found = stored(found.union(more), "links")
        parts = materialize(connected_components(found))
    # What crowds hold in different groups even then is compared in full, in large ones where it can be alike.
    asked = candidates.union(further)
    central = sets.by_centre(_centres(met.filter(F.col("n") > SMALL_CROWD), parts))
    apart = _apart(met.filter(crowded & (F.col("n") <= SMALL_CROWD)), parts).union(central.may_be_alike())
    last = sets.alike(_pairs(apart).join(asked, ["node", "other"], "left_anti"))
    last = stored(last.union(central.alike()).distinct(), "last-links")
    if last.limit(1).count():
        parts = connected_components(stored(found.union(last), "links"))
    named = distinct.join(parts, "node", "left").select("same", F.coalesce("root", "node").alias("group"))
    grouped = worded.select(ROW, "same").join(named, "same").select(ROW, "group")
    return grouped.union(marked.filter("same is null").select(ROW, F.col(ROW).alias("group")))


def _apart(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, other) of all texts that meet at a point of rows(point, node) and are in different groups of parts(node, root).

    A point's texts are dealt into blocks and every two blocks meet in a place of their own, so no task holds a crowd.
    """
    rooted = rows.select("point", "node").join(parts, "node", "left").select("point", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("point").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    rooted = rooted.join(several.filter("low <> high").select("point", "blocks"), "point").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    left = rooted.select("point", "node", "root", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = rooted.select("point", F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), "own")).alias("i"))
    met = left.join(right, ["point", "i", "j"]).filter("root <> other_root and (i < j or node < other)")
    return met.select("node", "other")


def _centres(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, root, centre) of texts at points of rows(point, node, crowd) that hold several groups: of all texts that such points bring together the most central one."""
    at = Window.partitionBy("point")
    rooted = rows.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.withColumn("low", F.min("root").over(at)).withColumn("high", F.max("root").over(at)).filter("low <> high")
    met = materialize(rooted.withColumn("first", F.min("node").over(at)).select("node", "root", "crowd", "first").distinct())
    families = materialize(connected_components(met.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))))
    own = met.select("node", "root", "crowd").distinct().join(families.withColumnRenamed("root", "family"), "node")
    centres = own.groupBy("family").agg(F.max_by("node", F.struct("crowd", "node")).alias("centre"))
    return materialize(own.join(centres, "family").select("node", "root", "centre"))


def _pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of different nodes, each once, the larger one first."""
    pairs = pairs.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    return materialize(pairs.filter("node <> other").distinct())


class _Sets:
    """Verifies pairs on sizes and complete fingerprints, then on the sets of the texts that are still in question.

    Two sets a pair are too wide for batches that go to Python, where thousands of pairs make one; arrays stay in the JVM, a pair at a time.
    """

    def __init__(self, keyed: DataFrame, distinct: DataFrame, shingle: int, seed: int, max_distance: int, similarity: float):
        self.keyed, self.distinct = keyed, distinct
        self.shingle, self.seed, self.max_distance, self.similarity = shingle, seed, max_distance, similarity

    def alike(self, pairs: DataFrame) -> DataFrame:
        """(a, b): pairs of (node, other) whose sets share enough."""
        most, shingle, seed, least = self.max_distance, self.shingle, self.seed, F.lit(self.similarity)
        fps = self.distinct.select("node", "n", "fp")

        @F.pandas_udf("boolean")
        def close(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(np.bitwise_count(_matrix(x, WIDE_WORDS) ^ _matrix(y, WIDE_WORDS)).sum(axis=1) <= most)

        both = pairs.join(fps, "node").join(fps.select(F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("fp").alias("other_fp")), "other")
        both = both.filter(F.least("n", "other_n") >= least * F.greatest("n", "other_n"))
        near = materialize(both.filter(close("fp", "other_fp")).select("node", "other"))
        sets = self.of(near.select("node").union(near.select("other")).distinct())
        both = near.join(sets, "node").join(sets.select(F.col("node").alias("other"), F.col("own").alias("other_own")), "other")
        both = both.select("node", "other", (F.size("own") + F.size("other_own")).alias("all"), F.size(F.array_intersect("own", "other_own")).alias("common"))
        return materialize(both.filter(F.col("common") >= least * (F.col("all") - F.col("common"))).select(F.col("node").alias("a"), F.col("other").alias("b")))

    def of(self, asked: DataFrame) -> DataFrame:
        """(node, own): sets of the texts asked for, stored."""
        shingle, seed = self.shingle, self.seed

        @F.pandas_udf("array<long>")
        def as_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([shingle_set(t, shingle, seed).view("<i8") for t in texts], dtype=object)

        texts = few_or_shuffled(self.keyed.select(F.col(ROW).alias("node"), "text"), asked, "node", "left_semi")
        return stored(texts.select("node", as_set("text").alias("own")), "sets")

    def by_centre(self, rows: DataFrame) -> _Central:
        """Texts of rows(node, root, centre) as their centres see them."""
        sets = self.of(rows.select("node").union(rows.select("centre")).distinct())
        both = rows.join(sets, "node").join(sets.select(F.col("node").alias("centre"), F.col("own").alias("centre_own")), "centre")
        both = both.select("*", F.size("own").alias("n"), F.size("centre_own").alias("centre_n"), F.size(F.array_intersect("own", "centre_own")).alias("common"))
        differs = F.concat(F.array_except("own", "centre_own"), F.array_except("centre_own", "own"))
        seen = both.select("node", "root", "centre", "n", "centre_n", "common", differs.alias("differs"))
        return _Central(stored(seen, "seen"), self.similarity)


class _Central:
    """Texts of crowds against a central text c of their own, which decides what pairs (x, y) need comparing.

    Where x and y differ from c in no common shingle, all that x and y share is in c and all of c
    is in x or y, so x and y are no more alike than x and c, or y and c. Pairs of which both are
    alike to c are in its group. So the others are found by a shingle in which both differ from c:
    those by which near copies differ are rare, and what most of a crowd has is not among them.
    Two sets that are alike differ in ``(1 - s) / (1 + s)`` of their sizes' sum at most, so so many
    of their differences from c are common, and the first common one, rarest first, has the others after it.
    """

    def __init__(self, seen: DataFrame, similarity: float):
        self.seen, self.similarity = seen, similarity
        self.linked = F.col("common") >= F.lit(similarity) * (F.col("n") + F.col("centre_n") - F.col("common"))

    def alike(self) -> DataFrame:
        """(a, b): texts of another group that share enough with their centre, by the sets alone."""
        roots = self.seen.filter("node = centre").select("centre", F.col("root").alias("centre_root"))
        found = self.seen.filter(self.linked & (F.col("node") != F.col("centre"))).join(roots, "centre")
        return found.filter("root <> centre_root").select(F.col("node").alias("a"), F.col("centre").alias("b"))

    def may_be_alike(self) -> DataFrame:
        """(node, other) of different groups."""
        s = self.similarity
        rows = self.seen.select("centre", "node", "root", "n", F.size("differs").alias("d"), self.linked.alias("linked"), F.explode("differs").alias("item"))
        item = Window.partitionBy("centre", "item")
        place = F.row_number().over(Window.partitionBy("centre", "node").orderBy("f", "item"))
        seen = [F.count("*").over(item).alias("f"), F.min("d").over(item).alias("least"), F.min("root").over(item).alias("low"), F.max("root").over(item).alias("high")]
        after = rows.select("*", *seen).withColumn("after", F.col("d") - place + 1)
        # Of items in one group only, or behind which too little is left for any partner, nothing comes.
        enough = F.col("after") >= F.ceil((F.col("d") + F.col("least") - (1 - s) / s * F.col("n")) / 2 - 1e-6)
        after = stored(after.filter(F.col("low") != F.col("high")).filter(enough).select("centre", "item", "node", "root", "n", "d", "linked", "after"), "differences")
        other = after.select("centre", "item", *[F.col(c).alias("other" if c == "node" else f"other_{c}") for c in ("node", "root", "n", "d", "linked", "after")])
        shared = F.ceil((F.col("d") + F.col("other_d") - (1 - s) / (1 + s) * (F.col("n") + F.col("other_n"))) / 2 - 1e-6)
        fits = (F.least("n", "other_n") >= s * F.greatest("n", "other_n") - 1e-6) & (F.least("after", "other_after") >= shared)
        apart = (F.col("root") != F.col("other_root")) & (F.col("node") < F.col("other")) & ~(F.col("linked") & F.col("other_linked"))
        return after.join(other, ["centre", "item"]).filter(apart & fits).select("node", "other").distinct()
