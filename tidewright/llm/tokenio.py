"""Operator 4: token ids in binary shards with a minimal perfect hash index for keyed access.

File format: a Parquet folder with one row per shard. `payload` holds the ids of the shard's documents one after
another, raw, little-endian, 2 bytes each (4 where an id needs it); `doc_ids` are its documents in ascending order;
`index` is a minimal perfect hash (hash and displace) from a document's key to its slot, with a stored 32-bit
fingerprint, the offset and the number of ids in each slot. A key is the id and its occurrence in the shard, so repeated
ids are kept apart. Shards are contiguous in ascending id order, null ids first, and hold about SHARD_IDS ids, so writer
and reader need memory for one shard. Spark's committer writes the folder: lost executors only repeat their tasks.
"""

from __future__ import annotations

import bisect
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, staged
from tidewright.llm.fasttok import encoder

SHARD_IDS, SHARD_DOCS = 4 << 20, 100_000
#: Pieces in each generation of a worker's dictionary: 170 MB.
PIECES = 1_000_000
#: Ranges into which equal rows can fall.
SPREAD = 4096
MAGIC, PER_BUCKET = b"TWIX1\0\0\0", 4
SHARDS = "shard long, first_id long, last_id long, n_docs long, n_ids long, width int, doc_ids array<long>, payload binary, index binary"


def _key(doc_id: int | None, occurrence: int) -> bytes:
    return struct.pack("<?qI", doc_id is None, doc_id or 0, occurrence)


def _hash(key: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key, seed)


def build_index(keys: list[bytes], offsets: list[int], lengths: list[int]) -> bytes:
    """Index of n different keys: header, bucket displacements, then fingerprint, offset and length of each slot."""
    n = len(keys)
    buckets = max(1, -(-n // PER_BUCKET))
    members: list[list[int]] = [[] for _ in range(buckets)]
    for i, k in enumerate(keys):
        members[_hash(k, 0) % buckets].append(i)
    taken, shift, slot_of = bytearray(n), np.zeros(buckets, "<i4"), [0] * n
    order = sorted((b for b in range(buckets) if members[b]), key=lambda b: -len(members[b]))
    free = None
    for b in order:
        own = members[b]
        if len(own) == 1:  # placed in whatever slot is left, which the displacement names
            free = iter([s for s in range(n) if not taken[s]]) if free is None else free
            slots, d = [next(free)], None
            shift[b] = -slots[0] - 1
        else:
            d = 0
            while True:
                d += 1
                slots = [_hash(keys[i], d) % n for i in own]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
            shift[b] = d
        for i, s in zip(own, slots, strict=True):
            taken[s], slot_of[i] = 1, s
    at = np.array(slot_of, np.int64)
    prints, off, num = np.zeros(n, "<u4"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
    prints[at] = [_hash(k, 0xF1) & 0xFFFFFFFF for k in keys]
    off[at], num[at] = offsets, lengths
    return MAGIC + struct.pack("<QQ", n, buckets) + shift.tobytes() + prints.tobytes() + off.tobytes() + num.tobytes()


class Index:
    """Constant-time lookups in a stored index; arrays are views of its bytes."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not an index")
        self.n, self.buckets = struct.unpack("<QQ", blob[8:24])
        n, b = self.n, self.buckets
        self.shift = np.frombuffer(blob, "<i4", b, 24)
        self.prints = np.frombuffer(blob, "<u4", n, 24 + 4 * b)
        self.offsets = np.frombuffer(blob, "<u8", n, 24 + 4 * b + 4 * n)
        self.lengths = np.frombuffer(blob, "<u4", n, 24 + 4 * b + 12 * n)

    def find(self, doc_id: int | None, occurrence: int = 0) -> tuple[int, int] | None:
        """(offset, number of ids), or None for a key whose stored fingerprint differs."""
        if not self.n:
            return None
        k = _key(doc_id, occurrence)
        d = int(self.shift[_hash(k, 0) % self.buckets])
        slot = -d - 1 if d < 0 else _hash(k, d) % self.n
        if int(self.prints[slot]) != _hash(k, 0xF1) & 0xFFFFFFFF:
            return None
        return int(self.offsets[slot]), int(self.lengths[slot])


def _write(path: str, drops_space: bool, end_id: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path, drops_space, PIECES), TaskContext.get().partitionId()
        last = struct.pack("<I", end_id)
        seq, ids, keys, blobs, before, occurrence = 0, [], [], [], object(), 0

        def flush() -> pa.RecordBatch:
            lengths = [len(b) // 4 for b in blobs]
            offsets = [0, *np.cumsum(lengths).tolist()][: len(lengths)]
            flat = np.frombuffer(b"".join(blobs), "<u4")
            width = 2 if flat.max(initial=0) < 1 << 16 else 4
            known = [i for i in ids if i is not None]
            row = [(part << 32) | seq, min(known, default=None), max(known, default=None), len(ids), len(flat), width, list(ids), flat.astype(f"<u{width}").tobytes(), build_index(keys, offsets, lengths)]
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in SHARDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        held = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                occurrence = occurrence + 1 if i == before else 0
                before = i
                blob = enc.raw(text.as_py() or "") + last
                ids.append(i)
                keys.append(_key(i, occurrence))
                blobs.append(blob)
                held += len(blob) // 4
                if held >= shard_ids or len(ids) >= SHARD_DOCS:
                    yield flush()
                    seq, held, before = seq + 1, 0, object()
                    ids, keys, blobs = [], [], []
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, drops_space: bool = False, end_id: int = 2, shard_ids: int = SHARD_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every row of docs, each followed by end_id, to a folder of the format above.

    A null text is an empty one and has the end id alone. Rows that repeat an id stand together, in the order of a hash of
    their texts; equal rows, of which it does not matter which comes first, are dealt by SPREAD so that one id that fills
    much of the table is no one task's work.
    """
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("spread", F.monotonically_increasing_id() % SPREAD)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("spread")]
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    d.mapInArrow(_write(tokenizer, drops_space, end_id, shard_ids), SHARDS).write.options(**{"compression": "zstd", "parquet.page.row.count.limit": 1}).parquet(path)


def _ids(payload: bytes, width: int, offset: int, n: int) -> np.ndarray:
    return np.frombuffer(payload, f"<u{width}", n, offset * width).astype("<u4")


def _read(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, doc_ids, payload, width, blob in zip(*(b.column(i) for i in range(5)), strict=True):
                index, rows, before, occurrence = Index(blob.as_py()), [], object(), 0
                raw, w = payload.as_py(), width.as_py()
                for i in doc_ids.as_py():
                    occurrence = occurrence + 1 if i == before else 0
                    before = i
                    offset, n = index.find(i, occurrence)
                    ids = _ids(raw, w, offset, n)
                    rows.append((i, offset, n, zlib.crc32(ids.tobytes()), ids if keep else None))
                for lo in range(0, len(rows), 1000):
                    part = rows[lo : lo + 1000]
                    cols = [pa.array([shard.as_py()] * len(part), pa.int64()), *(pa.array([r[c] for r in part], pa.int64()) for c in range(4))]
                    names = ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"]
                    if keep:
                        cols, names = [*cols, pa.array([r[4].astype(np.int64) for r in part], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every document of a folder, through its shard's index.

    start counts the ids of all documents before it in the whole folder: the shards' totals are summed in order.
    """
    shards = prepare(spark).read.schema(SHARDS).parquet(path)
    writer = F.shiftright("shard", 32).alias("writer")  # a row for each task that wrote shards
    before = lambda *by: F.sum("n_ids").over(Window.partitionBy(*by[1:]).orderBy(by[0])) - F.col("n_ids")
    writers = shards.groupBy(writer).agg(F.sum("n_ids").alias("n_ids"))
    writers = writers.select("writer", before("writer", F.lit(0)).alias("first"))
    base = shards.select("shard", "n_ids", writer).withColumn("base", before("shard", "writer")).join(writers, "writer").select("shard", (F.col("first") + F.col("base")).alias("base"))
    docs = shards.select("shard", "doc_ids", "payload", "width", "index").mapInArrow(_read(keep_ids), "shard long, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def fetch(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids) of the named documents, each as often as it is stored; None names those without an id.

    The indexes of the shards whose ids come near are asked first. Then only the shards that answered are read, by their numbers: at
    most as many as ids were asked for, each a page of its own in the file. A fingerprint can answer for an id that is not there, so
    the ids of the shard have the last word.
    """
    wanted = sorted({i for i in doc_ids if i is not None})
    null = None in doc_ids
    schema = "doc_id long, ids array<long>"
    if not wanted and not null:
        return spark.createDataFrame([], schema)

    def hits(index: Index, first: int | None, last: int | None) -> Iterator[tuple[int | None, tuple[int, int]]]:
        near = [] if first is None else wanted[bisect.bisect_left(wanted, first) : bisect.bisect_right(wanted, last)]
        for i in [None] * null + near:
            for occurrence in itertools.count():
                if (hit := index.find(i, occurrence)) is None:
                    break
                yield i, hit

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, last, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for part in itertools.batched(hits(Index(blob), first, last), 1000):
                    rows = [(shard, i, at, n) for i, (at, n) in part]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["shard", "doc_id", "at", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, width, found, own in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                raw, own = payload.as_py(), set(own.as_py())
                found = [f for f in found if f["doc_id"] in own]
                for part in itertools.batched(found, 100):
                    ids = [_ids(raw, width, f["at"], f["n"]).astype(np.int64) for f in part]
                    yield pa.RecordBatch.from_arrays([pa.array([f["doc_id"] for f in part], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    shards = prepare(spark).read.schema(SHARDS).parquet(path)
    near = F.lit(null)
    if wanted:
        near = near | ((F.col("last_id") >= wanted[0]) & (F.col("first_id") <= wanted[-1]))
    found = shards.where(near).select("shard", "first_id", "last_id", "index").mapInArrow(ask, "shard long, doc_id long, at long, n long")
    found = staged(found, "tokens-found")
    return answering(shards, found).mapInArrow(cut, schema)


def answering(shards: DataFrame, found: DataFrame) -> DataFrame:
    """(payload, width, found, doc_ids) of the shards that hold what was found (shard, doc_id, at, n)."""
    own = found.groupBy("shard").agg(F.collect_list(F.struct("doc_id", "at", "n")).alias("found"))  # documents of one shard at most
    numbers = [r["shard"] for r in own.select("shard").collect()]  # as many as ids were asked for, at most
    return shards.where(F.col("shard").isin(numbers)).select("shard", "payload", "width", "doc_ids").join(own, "shard").select("payload", "width", "found", "doc_ids")
