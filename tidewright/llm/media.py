"""Operator 10: documents as media columns. A text's bytes become the 8-bit grey samples of a PNG; the stored PNG
is read back through its zlib chunks with checksum tests and numpy unfiltering, and a low-frequency cosine-transform
hash of the samples is kept beside it.

A null text is an empty one; an empty text still has one row of 64 zero samples. Rows are independent, so repeated
rows and ids give a row each, an empty table none, and no other column of docs is read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import prepare

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples whose filters are chosen at once, so that a long text needs little memory beside itself.
STRIP = 4096


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of the width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey PNG of the payload, whose length is a multiple of 64; each row takes the cheapest of the filters
    none, sub and up, by the sum of absolute differences."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    packer, body = zlib.compressobj(level), [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0))]
    packed = []
    for lo in range(0, len(rows), STRIP):
        cur = rows[lo : lo + STRIP]
        above = rows[lo - 1 : lo + len(cur) - 1] if lo else np.vstack([np.zeros((1, WIDTH), np.uint8), cur[:-1]])
        kinds = np.stack([cur, np.diff(cur, axis=1, prepend=np.uint8(0)), cur - above])
        cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
        best = cost.argmin(axis=0)
        lines = np.empty((len(cur), WIDTH + 1), np.uint8)
        lines[:, 0], lines[:, 1:] = best, kinds[best, np.arange(len(cur))]
        packed.append(packer.compress(lines.tobytes()))
    packed.append(packer.flush())
    return b"".join([*body, _chunk(b"IDAT", b"".join(packed)), _chunk(b"IEND", b"")])


def _paeth(left: int, up: int, corner: int) -> int:
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    return left if a <= b and a <= c else up if b <= c else corner


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of grey rows that each begin with their filter's number (0 to 4)."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown row filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)  # wraps at 256, as the format asks
    at = 0
    while at < len(out):
        if kinds[at] == 2:  # a run of up rows is a running sum down the columns
            end = at + int(np.argmin(np.append(kinds[at:] == 2, False)))
            base = out[at - 1] if at else np.zeros(out.shape[1], np.uint8)
            out[at:end] = np.cumsum(np.vstack([base[None], out[at:end]]), axis=0, dtype=np.uint8)[1:]
            at = end
            continue
        if kinds[at] >= 3:
            row, up = out[at], out[at - 1] if at else np.zeros(out.shape[1], np.uint8)
            left = corner = 0
            for i in range(len(row)):
                u = int(up[i])
                left = (int(row[i]) + ((left + u) // 2 if kinds[at] == 3 else _paeth(left, u, corner))) & 255
                row[i], corner = left, u
            at += 1
            continue
        rest = np.flatnonzero(kinds[at:] >= 2)
        at = at + int(rest[0]) if len(rest) else len(out)
    return out


def decode_png(stored: bytes) -> np.ndarray:
    """Grey samples of a stored PNG; raises ValueError if the signature, a checksum, the order or a size is wrong."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, head, ended = 8, [], None, False
    while at < len(stored) and not ended:
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        body, end = stored[at + 8 : at + 8 + n], at + 8 + n
        if len(body) != n or stored[end : end + 4] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended, at = kind == b"IEND", end + 4
    if head is None or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("a whole 8-bit grey PNG without interlace is asked for")
    raw = zlib.decompress(b"".join(parts))
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("the samples do not fill the image")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def _cosines(n: int, m: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(m)[:, None] / (2 * n))


def cosine_hash(samples: np.ndarray, side: int = 32, low: int = 8) -> str:
    """16 hex digits: the lowest 8 x 8 frequencies of the image, brought to 32 x 32 by area means, against their median."""
    down = np.linspace(0, len(samples), side + 1).astype(int)
    rows = np.stack([samples[a : max(b, a + 1)].mean(axis=0) if a < len(samples) else samples[-1].astype(float) for a, b in zip(down, down[1:], strict=False)])
    small = rows.reshape(side, side, -1).mean(axis=2)
    c = _cosines(side, low)
    f = np.round(c @ small @ c.T, 6).ravel()
    bits = f > np.median(f[1:])
    return np.packbits(bits).tobytes().hex()


def _encode(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(1)]
            stored = pa.array([encode_png(pad(t), level) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), stored], names=["doc_id", "n_bytes", "media"])

    return run


def _decode(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for m in b.column(2):
                stored = m.as_py()
                samples = decode_png(stored)
                back = samples.tobytes()
                out.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(samples)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [b.column(0), b.column(1), *(pa.array([r[c] for r in out], k) for c, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays([*arrays, *([b.column(2)] if keep else [])], names=[*names, *(["media"] if keep else [])])

    return run


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> None:
    """Write one row per row of docs to a Parquet folder: doc_id, n_bytes, and the PNG in the binary column media."""
    prepare(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    d.mapInArrow(_encode(level), "doc_id long, n_bytes long, media binary").write.option("compression", "none").parquet(path)


def read_media(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """The stored rows read back: checked, decoded and measured; SCHEMA, and the column media if keep."""
    rows = prepare(spark).read.schema("doc_id long, n_bytes long, media binary").parquet(path)
    return rows.mapInArrow(_decode(keep), SCHEMA + (", media binary" if keep else ""))


def to_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", level: int = 6, keep: bool = True) -> DataFrame:
    """One row per row of docs, written to path and read back: the stored PNG (column media, if keep), its sizes and digests
    and the cosine hash as 16 hex digits."""
    store_media(docs, path, id_col, text_col, level)
    return read_media(docs.sparkSession, path, keep)
