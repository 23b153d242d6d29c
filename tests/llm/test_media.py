import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from tidewright.llm import media


def slow_unfilter(lines):
    """Sample by sample, as the format's text says."""
    out = []
    for row in lines.tolist():
        kind, cur = row[0], row[1:]
        up = out[-1] if out else [0] * len(cur)
        for i in range(len(cur)):
            a, b, c = (cur[i - 1] if i else 0), up[i], (up[i - 1] if i else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            cur[i] = (cur[i] + (0, a, b, (a + b) // 2, near)[kind]) & 255
        out.append(cur)
    return np.array(out, np.uint8).reshape(lines.shape[0], -1)


def test_unfilter_of_all_kinds():
    rnd = np.random.default_rng(1)
    lines = rnd.integers(0, 256, (200, 65), dtype=np.uint8)
    lines[:, 0] = rnd.integers(0, 5, 200)
    assert (media.unfilter(lines) == slow_unfilter(lines)).all()


def test_round_trip_and_damage():
    rnd = random.Random(2)
    for n in (0, 1, 63, 64, 65, 5000, 700_000):
        payload = media.pad(bytes(rnd.choices(range(256), k=n)) if n < 10_000 else b"text " * (n // 5))
        stored = media.encode_png(payload)
        assert media.decode_png(stored).tobytes() == payload and len(payload) % 64 == 0 and payload
        for at in (3, 20, len(stored) // 2, len(stored) - 5):
            with pytest.raises((ValueError, zlib.error, struct.error)):
                media.decode_png(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])


def slow_hash(samples):
    """Means, cosine sums and bits one by one."""
    n, side, low = len(samples), 32, 8
    down = [int(n * k / side) for k in range(side + 1)]
    small = []
    for a, b in zip(down, down[1:], strict=False):
        rows = [[float(v) for v in samples[r]] for r in range(a, max(b, a + 1)) if r < n] or [[float(v) for v in samples[-1]]]
        mean = [sum(r[c] for r in rows) / len(rows) for c in range(64)]
        small.append([(mean[2 * c] + mean[2 * c + 1]) / 2 for c in range(side)])
    cos = lambda x, u: math.cos(math.pi * (2 * x + 1) * u / (2 * side))
    f = [round(sum(small[y][x] * cos(y, u) * cos(x, v) for y in range(side) for x in range(side)), 6) for u in range(low) for v in range(low)]
    middle = sorted(f[1:])[31]
    bits = "".join(str(int(x > middle)) for x in f)
    return f"{int(bits, 2):016x}"


def test_hash_against_plain_sums():
    rnd = random.Random(4)
    for n in (1, 3, 31, 33, 64, 200):
        data = media.pad(" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n * 9)).encode()[: 64 * n])
        samples = np.frombuffer(data, np.uint8).reshape(-1, 64)
        a, b = int(media.cosine_hash(samples), 16), int(slow_hash(samples), 16)
        assert (a ^ b).bit_count() <= 1, n  # a value that is the median up to rounding


def test_hash_follows_low_frequencies():
    grey = np.add.outer(np.arange(256), np.arange(64)).astype(np.uint8)
    assert media.cosine_hash(grey) == media.cosine_hash(grey)
    assert media.cosine_hash(grey) != media.cosine_hash(255 - grey)


def test_rows(spark, tmp_path):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (2, None, "x"), (3, "", None), (None, "é" * 70, "x"), (5, "w " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = media.to_media(df, str(tmp_path / "a")).collect()
    assert len(out) == 6
    for r, (i, t, _) in zip(sorted(out, key=str), sorted(rows, key=lambda x: 0), strict=False):
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and len(r.media) == r.media_bytes
    by = {(r.doc_id, r.n_bytes): r for r in out}
    for i, t, _ in rows:
        data = (t or "").encode()
        r, payload = by[i, len(data)], media.pad(data)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.to_media(df.limit(0), str(tmp_path / "b")).count() == 0
