"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1/-1.  A trigram (a, b, c) is the element-wise
product of a's vector, b's vector rotated by one and c's rotated by two (binding of permuted
vectors); a text is the sum (bundle) of its trigrams, and so is a language: the sum over its
training texts.  A text gets the language whose prototype has the largest cosine.

Only trigram *counts* are gathered from texts, so a bundle costs one row per distinct trigram.
Prototypes are summed by Spark as (language, dimension) rows: what reaches the driver is
languages x dimensions numbers whatever the corpus size.

Defined results: null text or a text without a letter is ``und`` with score 0; very long texts count
whole; ties go to the language first in code point order; without any training language every text is
``und``; repeated rows get the same answer; an empty table gives an empty result; other columns pass
through, and where one has the name asked for the answer, the answer's gets ``_`` appended until it is free
(it is always the last column).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM = 1024
LETTERS = 2048  # ids 1..2047 for letters (later ones share), 0 for anything between words
SEED = 20240229
CHUNK = 1_500_000  # characters handled at once by a worker


@lru_cache(1)
def letter_ids() -> np.ndarray:
    """Code point -> letter id, by rank among the Unicode letters."""
    is_letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    ids = np.zeros(0x110000, np.int64)
    ids[is_letter] = np.arange(is_letter.sum()) % (LETTERS - 1) + 1
    return ids


@lru_cache(1)
def letter_vectors() -> np.ndarray:
    return (np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIM), np.int8) * 2 - 1).astype(np.int8)


@lru_cache(1)
def _rotated() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = letter_vectors()
    return v, np.roll(v, 1, axis=1), np.roll(v, 2, axis=1)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    a, b, c = _rotated()
    return (a[codes >> 22] * b[codes >> 11 & 2047] * c[codes & 2047]).astype(np.float32)


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram code, count) of every distinct trigram of every text, by text."""
    lowered = [t.lower() for t in texts]
    owner = np.repeat(np.arange(len(lowered)), [len(t) + 2 for t in lowered])
    points = np.frombuffer(("\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = letter_ids()[points]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] > 0) | (ids[:-1] > 0)  # a run of other characters is one boundary
    ids, owner = ids[keep], owner[keep]
    if len(ids) < 3:
        return (np.zeros(0, np.int64),) * 3
    mid = ids[1:-1] > 0
    codes = (ids[:-2] << 22 | ids[1:-1] << 11 | ids[2:])[mid]
    key, n = np.unique(owner[1:-1][mid] << 33 | codes, return_counts=True)
    return key >> 33, key & (1 << 33) - 1, n


def _chunks(b: pd.DataFrame, col: str) -> Iterator[pd.DataFrame]:
    group = (b[col].str.len().fillna(0) + 2).cumsum() // CHUNK
    for _, part in b.groupby(group, sort=False):
        yield part


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit prototypes, from all rows of ``docs``."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for part in _chunks(b, "t"):
                row, code, n = trigram_counts(part["t"].tolist())
                langs, lang_of = np.unique(part["l"].to_numpy(object).astype(str), return_inverse=True)
                codes, at = np.unique(code, return_inverse=True)
                if not len(codes):
                    continue
                by = np.zeros((len(langs), len(codes)), np.float32)
                np.add.at(by, (lang_of[row], at), n)
                for lang, v in zip(langs, by @ trigram_vectors(codes), strict=True):
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        for lang, v in sums.items():
            yield pd.DataFrame({"l": lang, "d": np.arange(DIM), "v": v})

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    # partial sums are whole numbers far below 2**53, so their order does not matter
    got = rows.mapInPandas(bundle, "l string, d int, v double").groupBy("l", "d").agg(F.sum("v").alias("v")).toPandas()
    langs = sorted(got["l"].unique())
    table = np.zeros((len(langs), DIM))
    for k, lang in enumerate(langs):
        own = got[got["l"] == lang]
        table[k, own["d"]] = own["v"]
    return langs, table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` plus ``out`` as last column: struct<lang, score>.  Only texts go to the workers; no shuffle."""
    while out.lower() in {c.lower() for c in docs.columns}:
        out += "_"
    langs, protos = model[0], model[1].astype(np.float32)

    def predict(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        row, code, n = trigram_counts([t or "" for t in texts])
        if not len(row) or not langs:
            return best, score
        codes, at = np.unique(code, return_inverse=True)
        vectors = trigram_vectors(codes)
        weight = n.astype(np.float32)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        ends = np.r_[first[1:], len(row)]
        for i, j in zip(first, ends, strict=True):
            v = weight[i:j] @ vectors[at[i:j]]
            cos = protos @ v / max(float(np.sqrt(v @ v)), 1e-12)
            k = int(cos.argmax())
            best[row[i]], score[row[i]] = langs[k], min(1.0, max(0.0, float(cos[k])))
        return best, score

    @F.pandas_udf("lang string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for part in _chunks(pd.DataFrame({"t": texts.to_numpy(object)}), "t"):
            at = part.index.to_numpy()
            lang[at], score[at] = predict([t if isinstance(t, str) else None for t in part["t"]])
        return pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn(out, language(F.col(text_col)))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32 of the id, as text, is not divisible by 5 (a null id trains)."""
    return docs.where(~held_out(id_col))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
