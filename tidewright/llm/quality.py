"""Operator 2: quality by positive-unlabelled learning with non-negative risk.

Every text is measured by a few statistics of its characters, words and lines. Trusted positives (labelled 1, outside the
held-out fold) and unlabelled web text train a linear model over these and hinges at their quantiles: Adam on the
non-negative unbiased risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with logistic loss, where a negative bracket is
climbed out of instead. The prior pi is estimated first, from a model of positives against unlabelled text, as the
least ratio of the two samples' upper tails, with a confidence margin for thin tails. Negative labels are not used.

The samples are bounded: about FIT rows each, chosen by a hash; measuring and scoring cover every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import prepare, staged, unwrapped, without

#: Rows of each of the two samples that the model is fitted on, about; twice as many at most.
FIT, FOLDS = 15_000, 5
KEEP_AT = 0.3
FEATURES = ["log_words", "word_length", "capitals", "signs", "bars", "digits", "adjacent_repeats", "new_bigrams", "capital_words", "signed_words", "stops", "commas", "line_repeats", "words_per_line", "entropy", "longest_word"]
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,")
_SIGN_END = re.compile(rb"[^\x00-\x20.,0-9A-Za-z\x80-\xff](?=[\x20\x0a]|$)")
#: Words whose pairs are looked at together; a long text is the mean over such parts.
_PART = 2000


def measure(text: bytes | None) -> list[float]:
    """FEATURES of one UTF-8 text; zeros for a text without words."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = counts[97:123].sum() + counts[128:].sum() / 2
    capitals = counts[65:91].sum()
    share = counts[counts > 0] / size
    fresh = []
    for lo in range(0, n, _PART):
        part = words[lo : lo + _PART]
        fresh.append(len(set(zip(part, part[1:], strict=False))) / max(1, len(part) - 1) if len(part) > 1 else 1.0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        (size - n) / n,
        capitals / max(1.0, letters + capitals),
        sum(int(counts[c]) for c in _SIGNS) / size,
        int(counts[124]) / n,
        counts[48:58].sum() / size,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(np.mean(fresh)),
        sum(map(bytes.isupper, words)) / n,
        len(_SIGN_END.findall(text)) / n,
        int(counts[46]) / n,
        int(counts[44]) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        float(-(share * np.log2(share)).sum()),
        float(np.log1p(max(map(len, words)))),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([measure(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))], names=["th", "doc_id", "x"])


class Model:
    """Scores of rows of FEATURES: a linear model over scaled features and their hinges."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 400, seed: int = 0):
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        scaled = (both - self.mean) / self.scale
        self.knots = np.unique(np.round(np.quantile(scaled, [0.05, 0.25, 0.5, 0.75, 0.95], axis=0), 6), axis=0)
        p, u = self._design(positive), self._design(unlabelled)
        halves = []  # each half's tails are those of a model that has not seen it
        for a in (0, 1) if min(len(p), len(u)) > 1 else ():
            first = self._fit(p[a::2], u[a::2], None, rounds)
            halves.append(class_prior(p[1 - a :: 2] @ first, u[1 - a :: 2] @ first))
        self.prior = float(np.mean(halves)) if halves else 0.5
        self.weights = self._fit(p, u, self.prior, rounds)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        hinges = [np.maximum(0, z - k) for k in self.knots]
        return np.concatenate([np.ones((len(z), 1)), z, *hinges], axis=1)

    @staticmethod
    def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, rounds: int, rate: float = 0.05) -> np.ndarray:
        """Without a prior: positives against unlabelled text; with it: the non-negative risk."""
        decay = 1e-3 + 2 / len(p)
        w, m, s = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
        grad = lambda x, y, sig: x.T @ ((sig - y) / len(x))
        for t in range(1, rounds + 1):
            fp, fu = np.clip(p @ w, -30, 30), np.clip(u @ w, -30, 30)
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            if prior is None:
                g = grad(p, 1, sp) + grad(u, 0, su)
            else:
                rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                g_rest = grad(u, 0, su) - prior * grad(p, 0, sp)
                g = prior * grad(p, 1, sp) + g_rest if rest >= 0 else -g_rest
            g = g + decay * np.append(0, w[1:])
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        return w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.1) -> float:
    """Share of positives in the unlabelled sample: least ratio of upper tails, margins included when it is chosen."""
    cuts = np.quantile(positive, np.linspace(0, 0.95, 96))
    q_p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    q_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    margin = np.sqrt(np.log(4 / sure) / 2 / len(positive)) + np.sqrt(np.log(4 / sure) / 2 / len(unlabelled))
    best = np.argmin((q_u + margin) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learnt from: crc32 of the id as text, by 5. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, fit: int = FIT, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(th, doc_id, held_out, score, predicted): one row per row of docs, th being the text's hash.

    labels has doc_id and quality; an id with several labels is trusted only if all are 1, null labels count for
    nothing. A null text is an empty one and is scored like any other. Without trusted positives, or without other
    rows, nothing can be learnt and every score is .5. No rows give no rows; other columns of docs are not read.
    """
    spark = prepare(docs.sparkSession)
    d = docs.select(F.xxhash64(text_col).alias("th"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    measured = staged(d.mapInArrow(_measured, "th long, doc_id long, x array<double>"), "quality-measured")
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    trusted = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("q"))
    kinds = measured.join(trusted, "doc_id", "left")
    n = kinds.agg(F.count_if(F.col("q") == 1).alias("p"), F.count_if(F.col("q").isNull()).alias("u")).first()

    def sample(rows: DataFrame, total: int) -> np.ndarray:
        share = min(1.0, fit / max(1, total))
        chosen = rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id", "th"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * fit)
        ordered = sorted(chosen.select("th", "x").collect())  # the fit depends on the order of rows, and Spark's changes
        return np.array([r["x"] for r in ordered], np.float64).reshape(-1, len(FEATURES))

    positive, unlabelled = sample(kinds.where("q = 1"), n["p"]), sample(kinds.where("q is null"), n["u"])
    model = Model(positive, unlabelled) if len(positive) and len(unlabelled) else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).to_pylist(), np.float64).reshape(-1, len(FEATURES))
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["th", "doc_id", "score"])

    out = measured.mapInArrow(scored, "th long, doc_id long, score double")
    return out.select("th", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, broadcast_ids: int = 500_000, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that are not rejected, all columns kept. Rejected rows are named by id and text hash, so a row
    whose id stands beside another text goes or stays by its own text."""
    gone = classify(docs, labels, id_col=id_col, text_col=text_col, **kw).where("predicted = 0").select("doc_id", "th").distinct()
    return unwrapped(without(docs, staged(gone, "quality-gone"), broadcast_ids, id_col, text_col), docs)
