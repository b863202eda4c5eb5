"""Exact removal of repeated 100-byte strings across all documents, by suffix arrays.

Every window of ``length`` bytes has at least one anchor: a 24-byte string whose
hash is smallest among those of the window. Equal windows have the same anchors
at the same places, so it is enough to compare the surroundings of equal
anchors, the *context* of an anchor being all bytes of the windows around it.

1. Anchors of all documents; those whose 24 bytes occur once go at once.
2. Contexts that occur before as a whole are removed as a whole. Only the first
   occurrence of each different context of an anchor is looked at further.
3. Anchors with several different contexts: contexts are laid out in blocks of
   eight bytes aligned on the anchor, and a suffix array over the blocks (linear
   grouping, ``suffix_grouping``) brings equal continuations together. A window
   starts in some block; its class is the bytes before the next block border
   and the run of suffixes there that share the remaining bytes. All but the
   earliest window of a class are removed. Groups are independent and dealt
   out by anchor; a task takes them in batches.
4. Anchors with over ``hot`` different contexts (a phrase on a large share of
   all pages) are never gathered in a task: contexts that share 38 more bytes on
   one side with another one are cut into windows, and the windows' hashes are
   grouped with partial aggregation.

Spans are judged on the input and cut at the end, one document at a time. Null
texts are empty. doc_id orders the documents, null after all others; a row that repeats another one's
doc_id and text is the same document, and gets the same answer. Rows of one id
with other texts are documents of their own: they are numbered anew, in the order of
id and row, before anything is compared. An empty table gives an empty table; texts may
be of any length (they are hashed in pieces); only ``doc_id`` and ``text`` are read,
so other columns may have any name.

Contexts are taken for equal if two independent 64-bit hashes agree, that of the anchor and that of
the context; windows of hot anchors likewise. What suffix arrays compare they compare by bytes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, row_keyed, stored, with_running_sums
from .suffix_grouping import suffix_array

LENGTH = 100
ANCHOR = 24
SIDE = LENGTH - ANCHOR
HOT = 1000
#: Bytes hashed at a time, and how far neighbouring pieces of a long text overlap.
PIECE = 1 << 17
MARGIN = 2 * LENGTH
#: Contexts in one suffix array.
BATCH = 12_000
BLOCK = 8
LEFT = -(-SIDE // BLOCK)
RIGHT = -(-LENGTH // BLOCK)

_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers:
        n = PIECE + 2 * MARGIN + 1
        for base in (_P, pow(_P, -1, 1 << 64)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers.append(np.cumprod(steps))
    return _powers


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


_own: dict[str, np.ndarray] = {}


def _scratch(name: str, n: int) -> np.ndarray:
    """A worker's memory for one of its arrays, used again for every piece: fresh pages cost more time than the work on them."""
    if name not in _own or len(_own[name]) < n:
        _own[name] = np.empty(max(n, PIECE + 4 * MARGIN), np.uint64)
    return _own[name][:n]


class Hashes:
    """Hashes of any substrings of a piece, from running sums, which the next piece's replace."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _power_tables()
        terms, self.sums = _scratch("terms", len(data)), _scratch("sums", len(data) + 1)
        with np.errstate(over="ignore"):
            np.add(data, np.uint64(1), out=terms, dtype=np.uint64)
            terms *= self.power[: len(data)]
            self.sums[0] = 0
            np.cumsum(terms, out=self.sums[1:])

    def of_all(self, width: int) -> np.ndarray:
        """Those of all substrings of ``width`` bytes, in memory that is used again."""
        n = len(self.sums) - width
        z, shifted = _scratch("all", n), _scratch("terms", n)
        with np.errstate(over="ignore"):
            np.subtract(self.sums[width:], self.sums[:-width], out=z)
            z *= self.inverse[:n]
            for by, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, None)):
                np.right_shift(z, np.uint64(by), out=shifted)
                z ^= shifted
                if factor:
                    z *= np.uint64(factor)
        return z

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def _slide(a: np.ndarray, width: int, best, name: str) -> np.ndarray:
    """Minimum or maximum over every window of ``width``, in memory that is used again."""
    span, out, turn = 1, a, 0
    while span * 2 <= width:
        out = best(out[:-span], out[span:], out=_scratch(f"{name}{turn}", len(out) - span))
        span, turn = span * 2, 1 - turn
    n = len(a) - width + 1
    return best(out[:n], out[width - span : width - span + n], out=_scratch(f"{name}{turn}", n))


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of a few texts laid end to end: text, position, hash, context hash, bytes from the anchor to the context's end.

    Windows that reach over the end of a text count for nothing.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = LENGTH - ANCHOR + 1
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes = Hashes(data)
    h = hashes.of_all(ANCHOR)
    h |= np.uint64(1)
    low = _slide(h, width, np.minimum, "low")
    for e in ends[:-1].tolist():
        low[max(0, e - LENGTH + 1) : e] = 0
    padded = _scratch("padded", len(low) + 2 * (width - 1))
    padded[: width - 1] = padded[-width + 1 :] = 0
    padded[width - 1 : -width + 1] = low
    chosen = np.flatnonzero(_slide(padded, width, np.maximum, "high") == h)
    text = np.searchsorted(ends, chosen, side="right")
    start = (ends - sizes)[text]
    lo, hi = np.maximum(chosen - SIDE, start), np.minimum(chosen + LENGTH, ends[text])
    with np.errstate(over="ignore"):
        context = _mix(hashes.of(lo, hi) + (chosen - lo).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + (hi - chosen).astype(np.uint64))
    return text, chosen - start, h[chosen], context, hi - chosen


def _pieces(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """A long text in overlapping pieces: where its own part begins and ends, where the piece begins, its bytes."""
    for core in range(0, max(1, len(data)), PIECE):
        a = max(0, core - MARGIN)
        yield core, core + PIECE, a, data[a : core + PIECE + MARGIN]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def anchors(docs: DataFrame) -> DataFrame:
    """(ah, ch, doc_id, pos, r): anchor and context hashes with their place and the context's bytes from the anchor on."""

    def solve(docs_: list[int], own: list[tuple], texts: list[bytes]) -> pd.DataFrame:
        text, pos, ah, ch, r = _anchors(texts)
        begin, end, offset = (np.array(x, dtype=np.int64)[text] for x in zip(*own, strict=True))
        pos = pos + offset
        keep = (pos >= begin) & (pos < end)
        doc = np.array(docs_, dtype=np.int64)[text]
        return pd.DataFrame({
            "ah": ah.view(np.int64)[keep], "ch": ch.view(np.int64)[keep], "doc_id": doc[keep], "pos": pos[keep].astype(np.int32), "r": r[keep].astype(np.int32),
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, own, texts, size = [], [], [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].tolist(), b["text"], strict=True):
                data = _bytes(text)
                if pd.isna(doc) or len(data) < LENGTH:
                    continue
                for begin, end, offset, piece in _pieces(data):
                    if size + len(piece) > PIECE + 2 * MARGIN and texts:
                        yield solve(ids, own, texts)
                        ids, own, texts, size = [], [], [], 0
                    ids.append(doc)
                    own.append((begin, end, offset))
                    texts.append(piece)
                    size += len(piece)
        if texts:
            yield solve(ids, own, texts)

    return docs.select("doc_id", "text").mapInPandas(run, "ah long, ch long, doc_id long, pos int, r int")


def _blocks(contexts: list[bytes], left: np.ndarray) -> np.ndarray:
    """Contexts as rows of big-endian 8-byte blocks, the anchor at block LEFT."""
    wide = (LEFT + RIGHT) * BLOCK
    rows = [bytes(LEFT * BLOCK - k) + c for c, k in zip(contexts, left.tolist(), strict=True)]
    joined = b"".join(x + bytes(wide - len(x)) for x in rows)
    return np.frombuffer(joined, dtype=">u8").reshape(len(contexts), LEFT + RIGHT).astype(np.uint64)


def repeated_windows(doc: np.ndarray, pos: np.ndarray, left: np.ndarray, right: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, as bytes left of the anchor, of the windows of each context that occur earlier; -1 where none does.

    Contexts of equal anchors have to be in the same call.
    """
    m = len(contexts)
    blocks = _blocks(contexts, left)
    per = LEFT + RIGHT + 1
    ranks = np.unique(blocks, return_inverse=True)[1].reshape(m, -1) + 2
    symbols = np.zeros(m * per + 1, dtype=np.int64)
    symbols[:-1].reshape(m, per)[:, :-1] = ranks
    symbols[:-1].reshape(m, per)[:, -1] = 1  # end of a context; the last symbol is 0
    order = np.asarray(suffix_array(symbols), dtype=np.int64)

    # Shared bytes of neighbours, as far as a window reaches and both contexts go.
    flat = np.zeros(m * per + RIGHT + 3, dtype=np.uint64)
    flat[: m * per].reshape(m, per)[:, :-1] = blocks
    owner, block = np.minimum(order // per, m - 1), order % per
    room = np.where(order < m * per, right[owner] + (LEFT - block) * BLOCK, 0)
    x, y = order[:-1], order[1:]
    same, alive = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for d in range(RIGHT + 1):
        alive &= flat[np.minimum(x + d, len(flat) - 1)] == flat[np.minimum(y + d, len(flat) - 1)]
        same += alive
    differ = flat[np.minimum(x + same, len(flat) - 1)] ^ flat[np.minimum(y + same, len(flat) - 1)]
    shared = same * BLOCK
    for k in range(1, BLOCK + 1):
        shared += (differ >> np.uint64(64 - 8 * k)) == 0
    shared = np.minimum(shared, np.minimum(room[:-1], room[1:]))

    furthest, nearest = np.full(m, -1, np.int64), np.full(m, LENGTH, np.int64)
    starts = np.flatnonzero((order < m * per) & (block >= 1) & (block <= LEFT))
    own, at = owner[starts], block[starts]
    for e in range(BLOCK):
        cut = shared < LENGTH - e
        runs = np.concatenate(([0], np.cumsum(cut)))
        size = np.bincount(runs)
        run = runs[starts]
        a = (LEFT - at) * BLOCK + e
        use = (size[run] > 1) & (a <= np.minimum(left[own], SIDE)) & (LENGTH - a <= right[own])
        if not use.any():
            continue
        c, a, run = own[use], a[use], run[use]
        head = blocks[c, at[use] - 1] & np.uint64((1 << (8 * e)) - 1)
        start = pos[c] - a
        by = np.lexsort((start, doc[c], head, run))
        c, a, run, head, start = c[by], a[by], run[by], head[by], start[by]
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (head[1:] != head[:-1])))
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc[c] != doc[c[first]]) | (start != start[first])
        np.maximum.at(furthest, c[later], a[later])
        np.minimum.at(nearest, c[later], a[later])
    return furthest, nearest


def _solve(groups: DataFrame) -> DataFrame:
    """(doc_id, a, b) of contexts dealt out by anchor: repeated bytes around their anchors."""

    half = SIDE // 2

    def solve(rows: list[tuple]) -> pd.DataFrame:
        # Half of a window's other bytes lies on one side of its anchor: contexts that share neither side are alone.
        before = [(ah, c[k - half : k]) if k >= half else None for ah, _, _, k, c in rows]
        after = [(ah, c[k + ANCHOR : k + ANCHOR + half]) if len(c) >= k + ANCHOR + half else None for ah, _, _, k, c in rows]
        n_before, n_after = Counter(before), Counter(after)
        rows = [r for r, x, y in zip(rows, before, after, strict=True) if (x and n_before[x] > 1) or (y and n_after[y] > 1)]
        if not rows:
            return pd.DataFrame({"doc_id": [], "a": [], "b": []}, dtype=np.int64)
        _, doc, pos, left, contexts = (list(x) for x in zip(*rows, strict=True))
        doc, pos, left = (np.array(x, dtype=np.int64) for x in (doc, pos, left))
        right = np.array([len(c) for c in contexts], dtype=np.int64) - left
        far, near = repeated_windows(doc, pos, left, right, contexts)
        hit = far >= 0
        return pd.DataFrame({"doc_id": doc[hit], "a": (pos - far)[hit], "b": (pos - near + LENGTH)[hit]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(b[c].tolist() for c in ("ah", "doc_id", "pos", "left", "context")), strict=True):
                if len(rows) >= BATCH and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return groups.repartition("ah").sortWithinPartitions("ah").mapInPandas(run, "doc_id long, a long, b long")


def _solve_hot(groups: DataFrame) -> DataFrame:
    """The same for anchors with too many contexts for a task, by hashes of the windows themselves."""

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Half of a window's other bytes lies on one side of the anchor: hashes of those, 0 where the context ends before."""
        half = SIDE // 2
        for b in batches:
            left = b["left"].to_numpy()
            before = [xxh(c[k - half : k]) if k >= half else 0 for c, k in zip(b["context"], left.tolist(), strict=True)]
            after = [xxh(c[k + ANCHOR : k + ANCHOR + half]) if len(c) >= k + ANCHOR + half else 0 for c, k in zip(b["context"], left.tolist(), strict=True)]
            for side, values in ((0, before), (1, after)):
                yield pd.DataFrame({"ah": b["ah"], "doc_id": b["doc_id"], "pos": b["pos"], "side": side, "sub": values})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 2000):
                part = b.iloc[k : k + 2000]
                hashes, row, start = [], [], []
                for i, (c, pos, left) in enumerate(zip(part["context"], part["pos"].tolist(), part["left"].tolist(), strict=True)):
                    h = Hashes(np.frombuffer(c, np.uint8))
                    s = np.arange(max(0, left - SIDE), min(left, len(c) - LENGTH) + 1)
                    hashes.append(h.of(s, s + LENGTH))
                    row.append(np.full(len(s), i))
                    start.append(s + pos - left)
                row = np.concatenate(row)
                yield pd.DataFrame({
                    "ah": part["ah"].to_numpy()[row], "wh": np.concatenate(hashes).view(np.int64), "doc_id": part["doc_id"].to_numpy()[row], "pos": part["pos"].to_numpy()[row], "start": np.concatenate(start),
                })

    import xxhash

    def xxh(x: bytes) -> int:
        return xxhash.xxh64_intdigest(x) - (1 << 63)

    keyed = groups.mapInPandas(sides, "ah long, doc_id long, pos int, side int, sub long").filter("sub <> 0")
    shared = keyed.groupBy("ah", "side", "sub").agg(F.count("*").alias("n")).filter("n > 1").select("ah", "side", "sub")
    wanted = keyed.join(shared, ["ah", "side", "sub"]).select("doc_id", "pos").distinct()
    cut = groups.join(wanted, ["doc_id", "pos"], "left_semi").mapInPandas(windows, "ah long, wh long, doc_id long, pos int, start long")
    first = cut.groupBy("ah", "wh").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = cut.join(first, ["ah", "wh"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return later.groupBy("doc_id", "pos").agg(F.min("start").alias("a"), (F.max("start") + LENGTH).alias("b")).select("doc_id", "a", "b")


def _contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(ah, hot, doc_id, pos, left, context) cut from the texts for the places (doc_id, pos, r, ah, hot)."""
    by_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "r", "ah", "hot")).alias("places"))
    joined = docs.select("doc_id", "text").join(by_doc, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["ah", "hot", "doc_id", "pos", "left", "context"]
        for b in batches:
            rows = []
            for doc, text, places in zip(b["doc_id"].tolist(), b["text"], b["places"], strict=True):
                data = _bytes(text)
                for p in places:
                    lo = max(0, p["pos"] - SIDE)
                    rows.append((p["ah"], p["hot"], doc, p["pos"], p["pos"] - lo, data[lo : p["pos"] + p["r"]]))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(run, "ah long, hot boolean, doc_id long, pos int, left int, context binary")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, a, b): spans, overlapping each other, that cover every byte to remove."""
    found = anchors(docs)
    often = found.groupBy("ah").count().filter("count > 1").select("ah")
    kept = stored(found.join(often, "ah"), "anchors")
    first = kept.groupBy("ah", "ch").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"))
    again = kept.join(first.filter("n > 1"), ["ah", "ch"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
    whole = again.select("doc_id", F.greatest(F.lit(0), F.col("pos") - SIDE).cast("long").alias("a"), (F.col("pos") + F.col("r")).cast("long").alias("b"))
    firsts = kept.groupBy("ah", "ch").agg(F.min(F.struct("doc_id", "pos", "r")).alias("f"))
    sizes = firsts.groupBy("ah").count().filter("count > 1").select("ah", (F.col("count") > hot).alias("hot"))
    places = firsts.join(sizes, "ah").select("f.doc_id", "f.pos", "f.r", "ah", "hot")
    contexts = stored(_contexts(docs, places), "contexts")
    mixed = _solve(contexts.filter("not hot").drop("hot"))
    common = _solve_hot(contexts.filter("hot").drop("hot"))
    return whole.unionByName(mixed).unionByName(common)


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def remove_repeats(docs: DataFrame, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: bytes, bytes removed, runs removed, SHA-256 of the rest and, with_text, the rest.

    A run may cut a character in two; the text then has U+FFFD for its parts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return _cut(rows, hot, with_text)
    keyed = row_keyed(rows).withColumn("_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = keyed.groupBy("doc_id", "_hash").agg(F.min(ROW).alias("_first"))
    ordered = same.withColumn("_null", F.col("doc_id").isNull())
    numbered = stored(with_running_sums(ordered, ["_null", "doc_id", "_first"], {"_no": F.lit(1)}), "numbers")
    own = keyed.join(numbered.select(F.col("_first").alias(ROW), "_no"), ROW).select(F.col("_no").alias("doc_id"), "text")
    answers = _cut(own, hot, with_text).withColumnRenamed("doc_id", "_no")
    of = numbered.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_same"), "_no")
    members = keyed.join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_same"))).select("doc_id", "_no")
    return members.join(answers, "_no").drop("_no")


def _cut(docs: DataFrame, hot: int, with_text: bool) -> DataFrame:
    """The same for ids that are unique and not null."""
    spans = repeated_spans(docs, hot).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    schema = SCHEMA if with_text else SCHEMA.removesuffix(", kept_text string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for b in batches:
            rows = []
            for doc, text, own in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                data = _bytes(text)
                runs = merged([(s["a"], s["b"]) for s in own]) if own is not None else []
                rest, at = [], 0
                for x, y in runs:
                    rest.append(data[at:x])
                    at = y
                left = b"".join([*rest, data[at:]])
                row = (doc, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest())
                rows.append((*row, left.decode("utf-8", "replace")) if with_text else row)
            yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(run, schema)


#: The same for DuckDB: every window by its text, in hexadecimal digits.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM d)),
h AS (SELECT doc_id, i, md5_number(s) AS k FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h) WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r),
g2 AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
sp AS (SELECT doc_id, run, min(i) AS a, max(i) + {LENGTH} AS b FROM g2 GROUP BY doc_id, run),
ed AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM sp),
ag AS (SELECT sp.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last FROM sp GROUP BY sp.doc_id),
kp AS (SELECT ed.doc_id, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head FROM ed JOIN d ON ed.doc_id = d.doc_id GROUP BY ed.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN ag ON d.doc_id = ag.doc_id LEFT JOIN kp ON d.doc_id = kp.doc_id
"""
