"""Byte-level BPE: encode whole texts by a public rank file, long ones in overlapping chunks, and decode ids.

1. A text of up to ``chunk`` + ``overlap`` characters is one piece. A longer one
   is cut every ``chunk`` characters; each chunk also carries the next
   ``overlap`` characters. Chunks of all long texts are dealt out over all tasks.
2. Each chunk is pre-tokenised on its own, from its own first character. It
   reports where pre-tokens begin (after one that is not white space) in the
   part it shares with its predecessor and in the part it shares with its
   successor, as far as the characters it holds decide them.
3. Two neighbours resynchronise at the first such place that both report: the
   split depends on nothing but the place it starts from, so they agree from
   there on. Chunks without a common place (one run of letters, digits or signs
   fills the overlap) become one chunk, which is tried again.
4. The pieces between these places are encoded on their own, each match of the
   pattern separately. As no piece ends in white space before a character that
   is none, the pattern's look-ahead finds the same in a piece as in the text.
5. ``decode`` puts the bytes of ids together; ``digest`` reads a document's
   pieces in their order, one at a time.

Null and empty texts are one piece without ids. Texts may be of any length;
memory is bounded by a batch of chunks, unless a single pre-token is longer
(it has to be merged as one). Equal rows are encoded each on its own; ids may be
null, large or repeat, since long texts carry a key of their own. An empty table
gives an empty table. Only ``doc_id`` and ``text`` are read, so other columns
may have any name.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, stored
from .token_shards import SPLIT_PATTERN, VOCABULARY, Tokenizer

#: Characters between the starts of two chunks, and how far a chunk reaches into the next one.
CHUNK = 16_384
OVERLAP = 512
#: Characters after the start of a pre-token that its literal forms ('re, 've, 'll) may need.
LITERAL = 3

_split = regex.compile(SPLIT_PATTERN)
_PIECES = "doc_key long, doc_id long, piece long, n_pieces long, ids array<int>"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_CHUNKS = "doc_key long, doc_id long, piece long, start long, core long, ends boolean, text string"


@functools.lru_cache(maxsize=1)
def _tokenizer(ranks_file: bytes) -> Tokenizer:
    return Tokenizer(ranks_file)


@functools.lru_cache(maxsize=1)
def _id_bytes(ranks_file: bytes) -> list[bytes]:
    """The bytes of every id."""
    ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


@functools.lru_cache(maxsize=1)
def _as_encoder_sees() -> dict[int, str]:
    """Characters that this module's pattern library and the encoder's put into different classes, with a character of the encoder's class for each.

    Their Unicode versions differ by some letters and digits.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    each_byte = {bytes([i]): i for i in range(256)}
    instead: dict[str, str] = {}
    for name, example in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", "\t")):
        probe = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=each_byte, special_tokens={})
        theirs, ours = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(name, every))
        instead |= {c: example for c in theirs - ours}
        for c in ours - theirs:
            instead.setdefault(c, "#")
    return {ord(c): to for c, to in instead.items()}


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column without nulls."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return (values[a:z].tolist() for a, z in zip(offsets, offsets[1:], strict=False))


def pre_token_starts(text: str, ends: bool) -> list[int]:
    """Where pre-tokens begin that follow one without white space, as far as ``text`` decides it; ``ends``: the document ends here too."""
    if not text.isascii():
        instead = _as_encoder_sees()
        if not instead.keys().isdisjoint(map(ord, set(text))):
            text = text.translate(instead)
    tokens = _split.findall(text)
    stops = list(accumulate(map(len, tokens)))
    n = len(text)
    return [z for t, z in zip(tokens, stops, strict=True) if not t[-1].isspace() and z < n and (ends or z - len(t) + LITERAL <= n)]


def cut_chunks(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The overlapping chunks of ``docs(doc_key, doc_id, text)``, dealt out over all tasks and kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, doc, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                n = max(1, -(-(len(text) - overlap) // chunk))
                for at in range(0, n, 64):
                    some = range(at, min(n, at + 64))
                    m = len(some)
                    yield pa.RecordBatch.from_pydict({
                        "doc_key": pa.array([key] * m, pa.int64()), "doc_id": pa.array([doc] * m, pa.int64()), "piece": pa.array(some, pa.int64()),
                        "start": pa.array([k * chunk for k in some], pa.int64()),
                        "core": pa.array([len(text) - k * chunk if k == n - 1 else chunk for k in some], pa.int64()),
                        "ends": pa.array([k == n - 1 for k in some]),
                        "text": pa.array([text[k * chunk :] if k == n - 1 else text[k * chunk : (k + 1) * chunk + overlap] for k in some], pa.string()),
                    })

    return stored(docs.mapInArrow(run, _CHUNKS).repartition("doc_key", "piece"), "chunks")


def shared_starts(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(doc_key, piece, heads, tails): places in the document where pre-tokens begin, in what a chunk shares with either neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for start, core, ends, text in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                found = np.array([0, *pre_token_starts(text, ends)], dtype=np.int64)
                heads.append((found[found <= overlap] + start).tolist())
                tails.append([] if ends else (found[found >= core] + start).tolist())
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, lists), pa.array(tails, lists)], ["doc_key", "piece", "heads", "tails"])

    needed = chunks.select("doc_key", "piece", "start", "core", "ends", "text")
    return needed.mapInArrow(run, "doc_key long, piece long, heads array<long>, tails array<long>")


def stitch_points(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(doc_key, piece, begin, n_pieces): where each chunk takes over from its predecessor; null where they share no place."""
    in_order = Window.partitionBy("doc_key").orderBy("piece")
    common = F.array_min(F.array_intersect(F.lag("tails").over(in_order), "heads"))
    first = F.row_number().over(in_order) == 1
    return shared_starts(chunks, overlap).select(
        "doc_key", "piece", F.when(first, F.lit(0)).otherwise(common).alias("begin"), F.count("*").over(Window.partitionBy("doc_key")).alias("n_pieces")
    )


def _merged(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """The chunks of documents in which neighbours share no place, those put together."""
    broken = points.filter("begin IS NULL").select("doc_key").distinct()
    run = F.count("begin").over(Window.partitionBy("doc_key").orderBy("piece"))
    runs = points.join(broken, "doc_key").select("doc_key", "piece", (run - 1).alias("run"))
    text = F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", F.lit(1), F.col("core").cast("int")))
    last = F.row_number().over(Window.partitionBy("doc_key", "run").orderBy(F.desc("piece"))) == 1
    parts = chunks.join(runs, ["doc_key", "piece"]).withColumn("last", last).withColumn("text", text)
    joined = parts.groupBy("doc_key", "run").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("core").alias("core"), F.max("ends").alias("ends"),
        F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"),
    )
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return joined.select("doc_key", "doc_id", F.col("run").alias("piece"), "start", "core", "ends", whole.alias("text"))


def stitched(chunks: DataFrame, overlap: int = OVERLAP) -> list[tuple[DataFrame, DataFrame]]:
    """(chunks, points) pairs that hold every document once, all points found.

    Neighbours that share no place are put together and compared again with
    what follows, so a pass has fewer chunks than the one before it; texts
    without a run longer than ``overlap`` need one.
    """
    done = []
    while True:
        points = stored(stitch_points(chunks, overlap), "points")
        broken = points.filter("begin IS NULL")
        if broken.isEmpty():
            return [*done, (chunks, points)]
        done.append((chunks, points.join(broken.select("doc_key").distinct(), "doc_key", "left_anti")))
        chunks = stored(_merged(chunks, points), "chunks")


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_key, doc_id, piece, n_pieces, ids): the ids of every text, in pieces numbered from 0; doc_key is null where a text is one piece."""
    if overlap < LITERAL:
        raise ValueError(f"an overlap of {LITERAL} characters or more is needed")
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = _tokenizer(shared.value)
        for b in batches:
            coded = [to_ids(t) if t else b"" for t in b.column(4).to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(c) // 2 for c in coded], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(coded), "<u2").astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), ids)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], lists], ["doc_key", "doc_id", "piece", "n_pieces", "ids"])

    long = F.length("text") > chunk + overlap
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    pieces = [rows.filter(~long).select(F.lit(None).cast("long").alias("doc_key"), "doc_id", zero.alias("piece"), one.alias("n_pieces"), "text")]
    keyed = rows.filter(long).select(F.monotonically_increasing_id().alias("doc_key"), "doc_id", "text")
    for chunks, points in stitched(cut_chunks(keyed, chunk, overlap), overlap):
        in_order = Window.partitionBy("doc_key").orderBy("piece")
        spans = points.withColumn("end", F.lead("begin").over(in_order))
        spans = F.broadcast(spans) if points.count() <= BROADCAST_KEYS // 4 else spans
        at = chunks.join(spans, ["doc_key", "piece"])
        length = F.coalesce(F.col("end") - F.col("begin"), F.length("text")).cast("int")
        part = F.substring("text", (F.col("begin") - F.col("start") + 1).cast("int"), length)
        pieces.append(at.select("doc_key", "doc_id", "piece", "n_pieces", part.alias("text")))
    return functools.reduce(DataFrame.unionByName, [p.mapInArrow(run, _PIECES) for p in pieces])


def decode(pieces: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_key, doc_id, piece, n_pieces, bytes): what each piece's ids stand for. A piece may end inside a character; a document doesn't."""
    shared = pieces.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _id_bytes(shared.value)
        for b in batches:
            raw = [b"".join(map(table.__getitem__, ids)) for ids in _lists(b.column(4))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(raw, pa.binary())], ["doc_key", "doc_id", "piece", "n_pieces", "bytes"])

    return pieces.select("doc_key", "doc_id", "piece", "n_pieces", "ids").mapInArrow(run, _PIECES.replace("ids array<int>", "bytes binary"))


def digest(pieces: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document.

    The pieces of a long text meet in one task, in order, and are read one at a time.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _id_bytes(shared.value)
        names = [str(i) for i in range(len(table))]
        of_ids, of_bytes, count = hashlib.sha256(), hashlib.sha256(), 0
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for doc, piece, n, ids in zip(*(b.column(k).to_pylist() for k in range(3)), _lists(b.column(3)), strict=True):
                if ids:
                    of_ids.update((" " if count else "").encode() + " ".join(map(names.__getitem__, ids)).encode())
                    of_bytes.update(b"".join(map(table.__getitem__, ids)))
                    count += len(ids)
                if piece == n - 1:
                    for column, value in zip(out, (doc, count, of_ids.hexdigest(), of_bytes.hexdigest()), strict=True):
                        column.append(value)
                    of_ids, of_bytes, count = hashlib.sha256(), hashlib.sha256(), 0
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    columns = ("doc_id", "piece", "n_pieces", "ids")
    alone = pieces.filter("n_pieces = 1").select(*columns)
    several = pieces.filter("n_pieces > 1").repartition("doc_key").sortWithinPartitions("doc_key", "piece").select(*columns)
    return alone.mapInArrow(run, _DIGESTS).unionByName(several.mapInArrow(run, _DIGESTS))
