"""Quality grades by ordinal cumulative-link (proportional odds) regression on hashed text.

P(grade <= k | x) = sigmoid(b_k - w.x), thresholds b_0 < b_1 < ... kept ordered by fitting log
gaps; one weight vector is shared by all thresholds.  x is the set of a text's hashed features
(lower-cased words plus a few shape features), scaled to unit length.  The expected grade and
the tail probability P(grade >= top) serve selection.

Fitted on the driver with a bounded sample of graded rows (``MAX_TRAIN``, lowest hash of the
id first, so reruns agree); their texts are hashed on the executors, and of each the driver gets the
feature numbers only (at most 2**BITS, in practice its distinct words).  Every row is then scored in
one narrow pass over whole texts.  ``held_out`` rows (crc32 of the id as text divisible by 5) never train.

Defined results: null or empty texts have only shape features and get a score like any other, very
long ones count whole; fewer than two distinct grades in the sample, or an empty table, fit to the
prior (weights 0); of several grades of one id the highest counts, and every row of that id trains;
repeated rows get the same score; equal scores need no order; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 17
MAX_TRAIN = 8_000  # graded rows the fit may see (documented bound)
MEMO = 400_000
_word = re.compile(r"\S+").findall
_memo: dict[str, int] = {}


def _hash(token: str) -> int:
    h = _memo.get(token)
    if h is None:
        from zlib import crc32

        h = crc32(token.encode("utf-8", "surrogatepass")) >> (32 - BITS)
        if len(_memo) < MEMO:
            _memo[token] = h
    return h


def features(text: str | None) -> np.ndarray:
    """Distinct feature ids of a whole text."""
    text = text or ""
    words = text.lower().split()
    distinct = set(words)
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    shape = [
        f"\x00n{n.bit_length()}",
        f"\x00u{round(10 * len(distinct) / max(1, n))}",
        f"\x00l{round(10 * len(set(lines)) / max(1, len(lines)))}",
        f"\x00w{min(20, chars // max(1, n))}",
        f"\x00a{round(20 * sum(map(str.isalpha, text)) / chars)}",
    ]
    return np.fromiter({*map(_hash, distinct), *map(_hash, shape)}, np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Ordinal:
    """weights w over 2**BITS features, ordered thresholds b (grades - 1 of them)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 120, rate: float = 0.25, l2: float = 2e-5) -> "Ordinal":
        """Adam on the full sample; gradients of the cumulative logit likelihood."""
        w = np.zeros(1 << BITS)
        top = n_grades - 1
        share = np.array([np.mean(grades <= k) if len(grades) else (k + 1) / n_grades for k in range(top)]).clip(0.01, 0.99)
        b = np.log(share / (1 - share))
        b = np.maximum.accumulate(b + 1e-3 * np.arange(top))
        if len(set(grades.tolist())) < 2:
            return cls(w, b)
        raw = np.r_[b[:1], np.log(np.diff(b).clip(1e-3))]
        at = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))
        balance = len(grades) / (len(set(grades.tolist())) * np.bincount(grades, minlength=n_grades)[grades])
        m = [np.zeros_like(w), np.zeros_like(raw)]
        v = [np.zeros_like(w), np.zeros_like(raw)]
        for step in range(1, epochs + 1):
            b = np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])
            z = np.bincount(row, w[at], len(rows)) * scale
            edges = np.r_[-np.inf, b, np.inf]
            up, low = _sigmoid(edges[grades + 1] - z), _sigmoid(edges[grades] - z)
            p = (up - low).clip(1e-9)
            d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
            g_z = balance * (d_up - d_low) / len(rows)  # of the negative log likelihood
            g_b = np.zeros(top)
            for k in range(top):
                g_b[k] = (-(balance * d_up)[grades == k].sum() + (balance * d_low)[grades == k + 1].sum()) / len(rows)
            tail = np.cumsum(g_b[::-1])[::-1]
            g_raw = np.r_[tail[:1], tail[1:] * np.exp(raw[1:])]
            g_w = np.bincount(at, (g_z * scale)[row], 1 << BITS) + l2 * w
            for k, (x, g) in enumerate(((w, g_w), (raw, g_raw))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return cls(w, np.cumsum(np.r_[raw[:1], np.exp(raw[1:])]))

    def at_least(self, texts) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= top), one row for each text."""
        z = np.array([self.weights[f].sum() / np.sqrt(len(f)) for f in map(features, texts)])
        return 1 - _sigmoid(self.thresholds[None, :] - z[:, None])


def fit_quality(docs: DataFrame, grades: DataFrame, n_grades: int, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal:
    """Fit on at most ``max_train`` graded rows.  Ids chosen first, so only their texts move."""
    chosen = (
        grades.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("i")).agg(F.max(grade_col).cast("int").alias("g"))
        .orderBy(F.xxhash64("i"), "i").limit(max_train)
    )

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"d": b["d"], "g": b["g"], "f": [np.sort(features(t)) for t in b["t"]]})

    # bounded by max_train rows of two numbers
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("d") == F.col("i"))
    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("d", "g", "t").mapInPandas(hashed, f"d {kind}, g int, f array<int>").orderBy(F.xxhash64("d"), "d", F.xxhash64("f")).limit(max_train).toPandas()
    return Ordinal.fit([np.asarray(f, np.int64) for f in got["f"]], got["g"].to_numpy(np.int64), n_grades)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, model: Ordinal, min_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, p_top, p_least_1, selected (P(grade = top) tail at least ``min_tail``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.at_least(b["t"]) if len(b) else np.zeros((0, len(model.thresholds)))
            yield pd.DataFrame({"doc_id": b["i"], "expected_grade": p.sum(axis=1), "p_any": p[:, 0], "p_top": p[:, -1], "selected": p[:, -1] >= min_tail})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, expected_grade double, p_any double, p_top double, selected boolean")


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 poor but harmless, 2 good; unknown labels are left out."""
    return labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade"),
    )
