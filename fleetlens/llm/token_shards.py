"""Token ids in training order: packed sequences, a keyed permutation, fixed-stride shards.

1. Every text is tokenised once (byte-level BPE ranks of a public vocabulary,
   whose path is a parameter) and ends with an end-of-text id. Within an input
   partition texts follow each other and are cut into sequences of ``seq_len``
   ids; a partition's last one is filled up with end-of-text ids. Sequences are
   kept, two little-endian bytes an id and compressed, in a table in the shared folder, so what
   follows is settled whatever partitions a rerun would see.
2. The partitions' counts (one row each) number all sequences.
3. A Feistel network over the next even number of bits, keyed and walked until
   it falls below the number of sequences, sends sequence i to global slot p(i):
   a permutation that needs no table and no sort key.
4. Sequences go to range partitions of slots; each holds whole shards of
   ``shard_slots`` slots, and slot s is row s % shard_slots of shard
   s // shard_slots. On the way those for one partition travel together, compressed.
5. ``write_shards`` writes each shard as one file of records of equal size, so
   that any step of training seeks to its record (``read_records``), and leaves
   out the shards that are complete already.

Null and empty texts contribute their end-of-text id alone. An empty table has
no sequences. Equal rows are tokenised and placed each on its own, long texts
run over as many sequences as they need, ids may be null or repeat. Only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
SEQ_LEN = 1024
SHARD_SLOTS = 1024
KEY = 0x5EED_0F_0DDB_A11
ROUNDS = 6
#: Bytes of ids that are compressed together in the table, and that are dealt out to partitions at a time.
CHUNK = 1 << 20
DEALT = 1 << 24
#: Texts of a batch that a worker has as Python objects at a time.
AT_ONCE = 500
LEVEL = 5

if sys.byteorder != "little" or array("H").itemsize != 2:
    raise ImportError("two-byte little-endian numbers expected")

_double_space = re.compile(r"\s\s")


class Tokenizer:
    """Ids of a text as little-endian bytes.

    Only a run of white space needs the pattern's look-ahead. Texts without one
    are split by the same pattern without it, which takes half the time.
    """

    def __init__(self, ranks_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}

        def encoder(pattern: str):
            return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        self.any, self.single_spaced = encoder(SPLIT_PATTERN), encoder(SPLIT_PATTERN.replace(r"\s+(?!\S)|\s+", r"\s"))

    def __call__(self, text: str) -> bytes:
        return array("H", (self.any if _double_space.search(text) else self.single_spaced)(text)).tobytes()


def permute(index: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of ``index`` under a keyed permutation of range(size): a balanced Feistel network with cycle walking."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64).copy()
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            v = x[todo]
            left, right = v >> np.uint64(half), v & low
            for r in range(rounds):
                z = right + np.uint64((key * (2 * r + 1) + 0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & low)
            v = (left << np.uint64(half)) | right
            x[todo] = v
            todo = todo[v >= np.uint64(size)]
    return x.astype(np.int64)


@functools.lru_cache(maxsize=1)
def _tokenizer(ranks_file: bytes) -> Tokenizer:
    """A worker's own, for all its tasks."""
    return Tokenizer(ranks_file)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, end: int = END_OF_TEXT) -> DataFrame:
    """(part, first, lengths, doc_ids, packed): runs of sequences of an input partition, numbered from ``first`` on.

    lengths are ids without filling, doc_ids the documents in each sequence. The
    vocabulary file (under 1 MB) is broadcast from the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    width = 2 * seq_len
    tail = np.array([end], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, compress = _tokenizer(shared.value), zstandard.ZstdCompressor(level=LEVEL).compress
        part, first = TaskContext.get().partitionId(), 0
        ids, marks = bytearray(), []  # marks: document, and where it begins and ends in ids

        def rows(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first, ids, marks
            most = -(-len(ids) // width) if whole else len(ids) // width
            per = max(1, CHUNK // width)
            owners: list[list] = [[] for _ in range(most)]
            for doc, a, z in marks:
                for k in range(a // width, min(most, -(-z // width))):
                    owners[k].append(doc)
            for k in range(0, most, per):
                n = min(per, most - k)
                data = bytes(ids[k * width : (k + n) * width])
                lengths = [min(seq_len, (len(data) - i * width) // 2) for i in range(n)]
                data += tail * ((n * width - len(data)) // 2)
                columns = [[part], [first], [lengths], [owners[k : k + n]], [compress(data)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                first += n
            ids = ids[most * width :]
            marks = [(doc, max(0, a - most * width), z - most * width) for doc, a, z in marks if z > most * width]

        for b in batches:
            for k in range(0, len(b), AT_ONCE):
                keys, texts = (c.to_pylist() for c in b.slice(k, AT_ONCE).columns)
                for doc, text in zip(keys, texts, strict=True):
                    begin = len(ids)
                    if text:
                        ids += encode(text)
                    ids += tail
                    marks.append((doc, begin, len(ids)))
                    if len(ids) >= CHUNK:
                        yield from rows(False)
        if ids:
            yield from rows(True)

    names = ["part", "first", "lengths", "doc_ids", "packed"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.binary()]
    return docs.select("doc_id", "text").mapInArrow(run, "part long, first long, lengths array<int>, doc_ids array<array<long>>, packed binary")


class TrainingOrder:
    """All sequences of ``docs``, tokenised once, and the slot of each."""

    def __init__(
        self, docs: DataFrame, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS, key: int = KEY, end: int = END_OF_TEXT
    ):
        self.spark, self.seq_len, self.shard_slots, self.key = docs.sparkSession, seq_len, shard_slots, key
        self.packed = stored(pack(docs, vocabulary, seq_len, end), "tokens")
        # One row of 16 bytes for each input partition.
        counts = sorted(self.packed.groupBy("part").agg(F.sum(F.size("lengths")).alias("n")).collect())
        self.size = sum(r["n"] for r in counts)
        ends = np.cumsum([0, *(r["n"] for r in counts)])
        self.offsets = dict(zip((r["part"] for r in counts), ends.tolist(), strict=False))
        self.shards = -(-self.size // shard_slots)

    def index(self) -> DataFrame:
        """(slot, shard, row, seq, doc_ids, n_tokens) of every sequence, without its ids."""
        offsets, size, key, per = self.offsets, self.size, self.key, self.shard_slots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, first, lengths, owners in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    seq = offsets[part] + first + np.arange(len(lengths))
                    slot = permute(seq, size, key)
                    columns = [slot, slot // per, slot % per, seq]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, pa.int64()) for c in columns), pa.array(owners, pa.list_(pa.int64())), pa.array(lengths, pa.int64())],
                        ["slot", "shard", "row", "seq", "doc_ids", "n_tokens"],
                    )

        narrow = self.packed.select("part", "first", "lengths", "doc_ids")
        return narrow.mapInArrow(run, "slot long, shard long, row long, seq long, doc_ids array<long>, n_tokens long")

    def sequences(self) -> DataFrame:
        """(shard, row, ids): shards whole in range partitions of slots, in order."""
        offsets, size, key, per, width = self.offsets, self.size, self.key, self.shard_slots, 2 * self.seq_len
        shards = max(1, self.shards)
        parts = max(1, min(shards, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compress, unpack = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
            slots, records, held = [], [], 0

            def dealt() -> pa.RecordBatch:
                slot, ids = np.concatenate(slots), np.concatenate(records)
                order = np.argsort(slot, kind="stable")
                slot = slot[order]
                target = slot // per * parts // shards
                cuts = np.flatnonzero(np.diff(target, prepend=-1))
                groups = [(int(target[a]), order[a:z], slot[a:z]) for a, z in zip(cuts, [*cuts[1:], len(slot)], strict=True)]
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array([t for t, _, _ in groups], pa.int32()), pa.array([s.tolist() for _, _, s in groups], pa.list_(pa.int64())),
                        pa.array([compress(ids[o].tobytes()) for _, o, _ in groups], pa.binary()),
                    ],
                    ["target", "slots", "packed"],
                )

            for b in batches:
                for part, first, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    ids = np.frombuffer(unpack(data), np.uint8).reshape(-1, width)
                    slots.append(permute(offsets[part] + first + np.arange(len(ids)), size, key))
                    records.append(ids)
                    held += ids.nbytes
                    if held >= DEALT:
                        yield dealt()
                        slots, records, held = [], [], 0
            if slots:
                yield dealt()

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack = zstandard.ZstdDecompressor().decompress
            for b in batches:
                for slots, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    slot = np.array(slots)
                    ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(slot), [None, pa.py_buffer(unpack(data.as_py()))])
                    yield pa.RecordBatch.from_arrays([pa.array(slot // per), pa.array(slot % per), ids.cast(pa.binary())], ["shard", "row", "ids"])

        pieces = self.packed.select("part", "first", "packed").mapInArrow(deal, "target int, slots array<long>, packed binary")
        # Range partitions by formula: a run of whole shards each, without sampling the rows first.
        ranged = pieces.repartitionById(parts, F.col("target")).select("slots", "packed")
        return ranged.mapInArrow(unpacked, "shard long, row long, ids binary").sortWithinPartitions("shard", "row")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def finished_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard) of those that are written. Files are listed, not read."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "shard long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"/shard=([0-9]+)/", 1).cast("long").alias("shard")).distinct()


def write_shards(sequences: DataFrame, path: str, placed: bool = False) -> None:
    """One file per shard under ``path/shard=N``: records of 2 * seq_len + 1 bytes, the last one a line feed.

    Written by Spark's text writer, so it works on any store. Its committer moves
    whole files of finished tasks into place, so a shard that is there is
    complete; a call that follows one that was broken off writes the others.
    ``placed``: every shard is in one partition already, as ``TrainingOrder.sequences`` has it.
    """
    spark = sequences.sparkSession
    done = finished_shards(spark, path)
    # A row of 8 bytes for each shard file of a folder, which its store can list at once.
    sequences = sequences.join(F.broadcast(done), "shard", "left_anti") if done.limit(1).count() else sequences
    sequences = sequences if placed else sequences.repartition("shard")
    rows = sequences.sortWithinPartitions("shard", "row").select(F.col("ids").cast("string").alias("value"), "shard")
    rows.write.mode("append").partitionBy("shard").text(path)


def read_shards(spark: SparkSession, path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """(shard, row, ids) of all records."""
    return _read(spark, path, seq_len, "ids", "binary", lambda records: pa.array([r.tobytes() for r in records], pa.binary()))


def record_checksums(spark: SparkSession, path: str, seq_len: int = SEQ_LEN) -> DataFrame:
    """(shard, row, ids_crc32) of all records, whose ids stay where they are read."""
    return _read(spark, path, seq_len, "ids_crc32", "long", lambda records: pa.array([zlib.crc32(r.tobytes()) for r in records], pa.int64()))


def _read(spark: SparkSession, path: str, seq_len: int, name: str, kind: str, of: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    stride = 2 * seq_len + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                columns = [pa.array([shard] * len(data), pa.int64()), pa.array(range(len(data)), pa.int64()), of(data[:, :-1])]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "row", name])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.col("shard").cast("long"), "content").mapInArrow(run, f"shard long, row long, {name} {kind}")


def read_shard(spark: SparkSession, path: str, shard: int, seq_len: int = SEQ_LEN, first_row: int = 0) -> DataFrame:
    """(row, ids) of one shard from ``first_row`` on; none past its end."""
    found = read_shards(spark, path, seq_len).filter((F.col("shard") == shard) & (F.col("row") >= first_row))
    return found.select("row", "ids")


def read_records(spark: SparkSession, path: str, slot: int, n: int, seq_len: int = SEQ_LEN, shard_slots: int = SHARD_SLOTS) -> list[bytes]:
    """Up to n records of one shard from a slot on, for a training process: it opens the file at their place and reads no others."""
    shard, row = divmod(slot, shard_slots)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    file = next(s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    stride = 2 * seq_len + 1
    if row * stride >= file.getLen():
        return []
    with_seek = fs.open(file.getPath())
    try:
        with_seek.seek(row * stride)
        data = bytes(with_seek.readNBytes(n * stride))
    finally:
        with_seek.close()
    return [data[k : k + stride - 1] for k in range(0, len(data), stride)]


def training_order(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the shards of ``docs`` under ``path``; one row per record as written: slot, shard, row, seq, doc_ids, n_tokens (without filling), ids_crc32."""
    order = TrainingOrder(docs, **options)
    if order.size:
        write_shards(order.sequences(), path, placed=True)

    if not order.size:
        return order.index().withColumn("ids_crc32", F.lit(0).cast("long"))
    written = record_checksums(docs.sparkSession, path, order.seq_len)
    written = written.select((F.col("shard") * order.shard_slots + F.col("row")).alias("slot"), "ids_crc32")
    return order.index().join(written, "slot").select("slot", "shard", "row", "seq", "doc_ids", "n_tokens", "ids_crc32")
