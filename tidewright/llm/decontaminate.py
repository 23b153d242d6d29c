"""Operator 12: benchmark passages in documents, found through an FM-index of every shard.

Words are runs of letters, digits and anything beyond ASCII, lower-cased in A-Z. A shard is about a million words of whole
documents, each different text once; a longer document is a shard with several segments, whose ends overlap. A segment's
FM-index is the Burrows-Wheeler transform of its word numbers in a wavelet matrix, suffix positions at each 32nd word of a
document, and its vocabulary; it is built once, written, and can be asked for any phrases of up to OVERLAP + 1 words.

Phrases are all windows of `window` consecutive words of an item (an item of fewer words is one window, one without words
none). They come in blocks of BLOCK words at most, so what is sent to every task is bounded and any number of items can be
asked for. All windows of a block are searched backward at once; occurrences are located by walking to sampled positions,
and become spans of words, merged per document.

Null and empty texts have no words. Repeated rows have a row each; repeated items count once by their id, items without an
id count as one whose name is empty. Without items, or without documents, nothing is hit.
"""

from __future__ import annotations

import io
import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import keyed_rows, prepare, staged, unwrapped

SEGMENT, OVERLAP, SAMPLE = 1 << 20, 63, 32
#: Words of the items that are sent to all tasks at once, and of one part of an item.
BLOCK, PART = 1 << 20, 1 << 16
#: Occurrences located at once.
LOCATE = 1 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


# FM-index of one segment


def suffix_order(words: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """Positions in order of their suffixes. words are numbers from 1 and 0 behind each document; ends[i] is the place of the 0
    behind position i. Zeros stand in order of place, so a suffix is settled by its own document. Three words or more are
    compared at once, then the ranks so far double the length, for what is not yet settled."""
    n, per = len(words), max(1, 63 // bits)
    key, alive = words.astype(np.int64), words != 0
    for j in range(1, per):
        nxt = np.zeros(n, np.int64)
        nxt[:-j] = words[j:]
        nxt[~alive] = 0
        alive = nxt != 0
        key = key << bits | nxt
    zeros = np.flatnonzero(words == 0)
    key[zeros] = np.arange(len(zeros)) - len(zeros)
    at = np.argsort(key)
    key = key[at]
    order, rank = np.empty(n, np.int64), np.empty(n, np.int64)
    place = np.arange(n)
    reach = per
    while True:
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        first = place[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = first
        alone = new & np.append(new[1:], True)
        order[place[alone]] = at[alone]
        at, place, first = at[~alone], place[~alone], first[~alone]
        if not len(at):
            return order
        key = first << 32 | rank[np.minimum(at + reach, ends[at])]
        by = np.argsort(key)  # within `first`, so places keep their classes
        at, key = at[by], key[by]
        reach *= 2


def _bits(marks: np.ndarray) -> np.ndarray:
    """Marks as 64-bit words, one spare word behind."""
    packed = np.packbits(marks, bitorder="little")
    return np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8 + 8), "<u8")


class Ranks:
    """Marks with the number of those before each place."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.before = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, i: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


def build_segment(docs: list[list[bytes]]) -> bytes:
    """FM-index over the word lists of documents, as stored."""
    number: defaultdict = defaultdict(itertools.count(1).__next__)
    sizes = np.array([len(d) + 1 for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.zeros(starts[-1], np.int32)
    for s, d in zip(starts, docs, strict=False):
        text[s : s + len(d)] = np.fromiter(map(number.__getitem__, d), np.int32, len(d))
    bits = max(1, int(len(number)).bit_length())
    ends = np.repeat(starts[1:] - 1, sizes)
    order = suffix_order(text, ends, bits)
    seq = text[order - 1]
    offset = order - np.repeat(starts[:-1], sizes)[order]
    marked = offset % SAMPLE == 0
    levels, zeros = [], []
    for level in range(bits - 1, -1, -1):
        one = (seq >> level & 1).astype(bool)
        levels.append(_bits(one))
        zeros.append(len(seq) - int(one.sum()))
        seq = np.concatenate([seq[~one], seq[one]])
    out = io.BytesIO()
    vocabulary = np.frombuffer(b" ".join(number), np.uint8)  # in order of number
    counts = np.bincount(text, minlength=len(number) + 1)
    np.savez(out, words=vocabulary, counts=counts.astype(np.int32), starts=starts.astype(np.int32), levels=np.array(levels), zeros=np.array(zeros), marks=_bits(marked), samples=order[marked].astype(np.int32))
    return out.getvalue()


class Segment:
    """A stored FM-index."""

    def __init__(self, blob: bytes) -> None:
        z = np.load(io.BytesIO(blob))
        self.number = {w: k for k, w in enumerate(z["words"].tobytes().split(), 1)}
        counts = z["counts"].astype(np.int64)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.starts, self.samples, self.zeros = z["starts"].astype(np.int64), z["samples"], z["zeros"]
        self.levels, self.marks = [Ranks(w) for w in z["levels"]], Ranks(z["marks"])
        backward = np.zeros(len(counts), np.int64)  # the lowest level holds words in order of their reversed bits
        for k in range(len(self.levels)):
            backward |= (np.arange(len(counts)) >> k & 1) << (len(self.levels) - 1 - k)
        by = np.argsort(backward)
        self.lowest = np.empty(len(counts), np.int64)
        self.lowest[by] = np.cumsum(counts[by]) - counts[by]

    def rank(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each word stands before its row."""
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.ones(row)
            row = np.where(word >> (len(self.levels) - 1 - k) & 1, zeros + ones, row - ones)
        return row - self.lowest[word]

    def before(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one word earlier; only for words inside a document."""
        word = np.zeros(len(row), np.int64)
        at = row
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.at(at), level.ones(at)
            word = word << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return self.less[word] + at - self.lowest[word]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, low, high): the phrases, rows of word numbers, that occur, and their rows of suffixes."""
        which = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.less[-1])
        for k in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[which, k]
            low, high = self.less[word] + self.rank(word, low), self.less[word] + self.rank(word, high)
            some = low < high
            which, low, high = which[some], low[some], high[some]
            if not len(which):
                break
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, left, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            here = self.marks.at(rows)
            out[left[here]] = self.samples[self.marks.ones(rows[here])] + steps
            left, rows = left[~here], self.before(rows[~here])
            steps += 1
        return out


# Shards

INDEX = "shard long, doc_ids array<long>, hashes array<long>, slots array<int>, n_words array<long>, segments array<binary>, first array<array<int>>, offsets array<array<long>>"


def _shards(segment: int):
    """doc_id, th, text -> one row for each shard: its rows' ids, hashes and slots, the slots' sizes, and the segments with the
    slot and the word offset of each of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId() << 32, itertools.count()
        rows, seen, texts, held = [], {}, [], 0

        def flush() -> pa.RecordBatch:
            segments, first, offsets = [], [], []
            todo, slots, starts, size = [], [], [], 0

            def close() -> None:
                nonlocal todo, slots, starts, size
                segments.append(build_segment(todo))
                first.append(slots)
                offsets.append(starts)
                todo, slots, starts, size = [], [], [], 0

            for slot, words in enumerate(texts):
                step = max(1, segment - OVERLAP)
                for at in range(0, max(1, len(words) - OVERLAP), step) if len(words) > segment else [0] if words else []:
                    piece = words[at : at + segment] if len(words) > segment else words
                    if todo and size + len(piece) > segment:
                        close()
                    todo.append(piece)
                    slots.append(slot)
                    starts.append(at)
                    size += len(piece)
            if todo:
                close()
            row = [part + next(number), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [len(t) for t in texts], segments, first, offsets]
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            kinds = [pa.int64(), longs, longs, ints, longs, pa.list_(pa.binary()), pa.list_(ints), pa.list_(longs)]
            names = ["shard", "doc_ids", "hashes", "slots", "n_words", "segments", "first", "offsets"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            for i, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = text.as_py() or b""
                if raw not in seen:
                    words = words_of(raw)
                    if rows and held + len(words) > segment:
                        yield flush()
                        rows, seen, texts, held = [], {}, [], 0
                    seen[raw] = len(texts)
                    texts.append(words)
                    held += len(words)
                rows.append((i, th, seen[raw]))
                if len(rows) >= 100_000:  # many rows of few words
                    yield flush()
                    rows, seen, texts, held = [], {}, [], 0
        if rows:
            yield flush()

    return run


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The FM-indexes of docs, one row for each shard, written to the shared folder."""
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    return staged(rows.mapInArrow(_shards(segment), INDEX), "fm-index")


# Phrases


def _parts(window: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(text.as_py())
                for at in range(0, max(1, len(words) - window + 1), part) if words else []:
                    piece = words[at : at + part + window - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([item], pa.string()), pa.array([b" ".join(piece)], pa.binary()), pa.array([len(piece)], pa.int64())], names=["item", "words", "n"])

    return run


class Phrases:
    """The different windows of a block of items, by length, and the items of each."""

    def __init__(self, parts: list[tuple[str, bytes]], window: int) -> None:
        number: defaultdict = defaultdict(itertools.count().__next__)
        self.names = sorted({name for name, _ in parts})
        code = {name: k for k, name in enumerate(self.names)}
        found: defaultdict = defaultdict(list)
        for name, raw in parts:
            ids = np.fromiter(map(number.__getitem__, raw.split()), np.int64)
            size = min(window, len(ids))
            at = np.lib.stride_tricks.sliding_window_view(ids, size)
            found[size].append(np.column_stack([at, np.full(len(at), code[name])]))
        self.words = list(number)
        #: length -> (windows, first of each one's items, items)
        self.by_length = {}
        for size, tables in found.items():
            rows = np.unique(np.concatenate(tables), axis=0)
            new = np.append(True, (rows[1:, :size] != rows[:-1, :size]).any(axis=1))
            self.by_length[size] = rows[new, :size], np.append(np.flatnonzero(new), len(rows)), rows[:, size]

    def in_segment(self, seg: Segment) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, which, position) of each window's occurrences."""
        own = np.fromiter((seg.number.get(w, 0) for w in self.words), np.int64, len(self.words))
        for size, (windows, _, _) in self.by_length.items():
            there = np.flatnonzero((own[windows] != 0).all(axis=1))
            which, low, high = seg.search(own[windows[there]])
            which = there[which]
            upto = np.cumsum(high - low)
            for lo in range(0, int(upto[-1]) if len(upto) else 0, LOCATE):
                k = np.arange(lo, min(lo + LOCATE, int(upto[-1])))
                of = np.searchsorted(upto, k, "right")
                rows = high[of] - (upto[of] - k)
                yield size, which[of], seg.locate(rows)

    def items(self, size: int, which: np.ndarray) -> np.ndarray:
        _, first, items = self.by_length[size]
        return np.concatenate([items[first[w] : first[w + 1]] for w in which]) if len(which) else which


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap as one; all in order."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


FOUND = "row long, doc_id long, th long, n_words long, starts array<long>, ends array<long>, items array<string>"
_blocks: dict = {}


def _ask(block, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if block.value[0] not in _blocks:  # once a worker
            _blocks.clear()
            _blocks[block.value[0]] = Phrases(block.value[1], window)
        phrases = _blocks[block.value[0]]
        longs, nothing = pa.list_(pa.int64()), np.zeros(0, np.int64)
        for b in batches:
            for shard, ids, hashes, slots, sizes, first, offsets, segments in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6, 7)), b.column(5), strict=True):
                spans, items = defaultdict(list), defaultdict(set)
                for k, blob in enumerate(segments):
                    seg = Segment(blob.as_py())
                    slot, shift = np.array(first[k]), np.array(offsets[k]) - seg.starts[:-1]
                    for size, which, at in phrases.in_segment(seg):
                        doc = np.searchsorted(seg.starts, at, "right") - 1
                        by = np.lexsort((at, doc))
                        doc, which, at = doc[by], which[by], at[by] + shift[doc[by]]
                        cuts = np.flatnonzero(np.diff(doc)) + 1
                        for lo, hi in zip([0, *cuts], [*cuts, len(doc)], strict=True):
                            s = int(slot[doc[lo]])
                            spans[s].append(merged_spans(at[lo:hi], at[lo:hi] + size))
                            items[s].update(phrases.items(size, np.unique(which[lo:hi])).tolist())
                done = {s: merged_spans(*(np.concatenate(x) for x in zip(*found, strict=True))) for s, found in spans.items()}
                names = {s: sorted(phrases.names[k] for k in found) for s, found in items.items()}
                for lo in range(0, len(ids), 1000):
                    mine = slots[lo : lo + 1000]
                    cols = [
                        pa.array(range((shard << 20) + lo, (shard << 20) + lo + len(mine)), pa.int64()),
                        pa.array(ids[lo : lo + 1000], pa.int64()),
                        pa.array(hashes[lo : lo + 1000], pa.int64()),
                        pa.array([sizes[s] for s in mine], pa.int64()),
                        pa.array([done[s][0] if s in done else nothing for s in mine], longs),
                        pa.array([done[s][1] if s in done else nothing for s in mine], longs),
                        pa.array([names.get(s, []) for s in mine], pa.list_(pa.string())),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "th", "n_words", "starts", "ends", "items"])

    return run


def _union(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    both = [merged_spans(np.asarray(s), np.asarray(e)) if len(s) else (np.zeros(0, np.int64),) * 2 for s, e in zip(starts, ends, strict=True)]
    return pd.DataFrame({"starts": [s for s, _ in both], "ends": [e for _, e in both]})


def leaks(index: DataFrame, benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text", block: int = BLOCK, part: int = PART) -> DataFrame:
    """A row for each indexed row: doc_id, th (hash of its text), n_words, spans of hit words (start, end: end exclusive,
    merged, in order) and the ids of the items with an occurring window, sorted as strings."""
    if not 1 <= window <= OVERLAP + 1:
        raise ValueError(f"windows of 1 to {OVERLAP + 1} words")
    spark = prepare(index.sparkSession)
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    parts = staged(items.mapInArrow(_parts(window, part), "item string, words binary, n long").withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "fm-phrases")
    n_blocks = -(-2 * (parts.agg(F.sum("n")).first()[0] or 0) // block) or 1  # dealt evenly, so half full
    found = []
    for k in range(n_blocks):
        rows = parts.where(F.pmod("deal", F.lit(n_blocks)) == k).select("item", "words").collect()  # a block
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], bytes(r["words"])) for r in rows]))
        found.append(index.mapInArrow(_ask(sent, window), FOUND))
    spans = F.expr("arrays_zip(starts, ends)").cast("array<struct<start: long, end: long>>").alias("spans")
    if n_blocks == 1:
        return found[0].select("doc_id", "th", "n_words", spans, "items")
    every = staged(found[0], "fm-found")
    for f in found[1:]:
        every = every.unionByName(staged(f, "fm-found"))
    every = every.groupBy("row").agg(  # one row from each block
        *[F.first(c).alias(c) for c in ("doc_id", "th", "n_words")],
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")],
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return every.withColumn("u", F.pandas_udf(_union, "starts array<long>, ends array<long>")("starts", "ends")).select("doc_id", "th", "n_words", F.col("u.starts").alias("starts"), F.col("u.ends").alias("ends"), "items").select("doc_id", "th", "n_words", spans, "items")


def _without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    out = []
    for t, first, last in zip(text, starts, ends, strict=True):
        raw = t.encode()
        inside = np.array([c in _WORD or 65 <= c <= 90 for c in range(256)])[np.frombuffer(raw, np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        begins, stops = edges[::2], edges[1::2]
        keep, at = [], 0
        for a, b in zip(first, last, strict=True):
            keep.append(raw[at : begins[a]])
            at = stops[b - 1]
        out.append(b"".join([*keep, raw[at:]]).decode())
    return pd.Series(out)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the hit words cut out of their texts, signs around them kept; the other rows and columns are untouched."""
    hit = staged(leaks(index_documents(docs, id_col, text_col), benchmark, window).where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"]), "fm-leaks")
    spans = hit.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans")
    rows = keyed_rows(docs, id_col, text_col)
    here = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    text = F.col("row")[text_col]
    met = rows.join(spans, here, "left")
    cut = met.where("spans is not null").withColumn("row", F.col("row").withField(f"`{text_col}`", F.pandas_udf(_without, "string")(text, F.col("spans.start"), F.col("spans.end"))))
    return unwrapped(rows.join(spans, here, "left_anti").unionByName(cut.select("row", "doc_id", "th")), docs)
