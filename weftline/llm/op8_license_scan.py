"""License scan: MinHash bands over overlapping windows retrieve templates, containment verifies.

Templates (license notices, and the full texts in ``licenses/``) and texts are lower-cased words over
a-z and 0-9; their shingles have five words.  A template with m shingles belongs to the smallest window length L = 2, 4, 8, ... with
L >= 2 m; windows of that length start every L / 2 shingles, so every run of m shingles lies wholly
in one window.  The Jaccard similarity of that window and the template is then at least
``0.75 m / (L + m / 4)``, over 0.17, and ``PERMUTATIONS`` one-row bands miss it with a probability
under 0.83 ** 32 < 0.003 (in the usual case, m = L / 2, under 1e-5).  Retrieved pairs are verified by
exact containment of the template's shingles in the window, 0.75 or more.

Only windows that hold an anchor word (license, copyright, ...; some more for full texts) and at least
75 % as many shingles as the shortest template of their length are hashed.  This loses nothing: it
is asserted for every template that shingles without an anchor are fewer than 75 % of it, so a
window that contains 75 % of a template contains an anchor.  The templates are fixed, a few hundred
band rows, so their side of the join is broadcast with a proven bound.

A template shorter than a shingle is one run of all its words, and its windows are the runs of that
length that equal it; its first anchor word tells where to look.

Result: one row per (document, license) with the best containment and the number of windows.
Defined results: null and empty texts give no row; texts of fewer than five words match only templates
as short; very long texts are read whole; a license with several templates counts the windows of all;
repeated rows, and rows of one id with different texts, count as one document that holds what any
of them holds; ties need no order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, PERMUTATIONS, CONTAINED = 5, 32, 0.75
ANCHOR = "licen[sc]|copyright|warrant|permission|sublicen|unlicen|rights"
#: Anchors of full texts, of which more than 75 % of the shingles can be without one of the above.
TEXT_ANCHOR = ANCHOR + "|software|distribut|liab|convey|library|modif|document|package|affirmer"
#: License notices (fixed values, public texts).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "agpl-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "lgpl": "Licensed under the GNU Lesser General Public License.",
    "epl-2.0": "Made available under the terms of the Eclipse Public License 2.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: Licenses with a full text in ``licenses/``.
TEXTS = (
    "0bsd", "apache-2.0", "artistic-1.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "gfdl-1.2", "gfdl-1.3", "gpl-1.0", "gpl-2.0", "gpl-3.0", "isc",
    "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "mit", "mpl-1.1", "mpl-2.0", "unlicense", "wtfpl", "zlib",
)


def full_texts() -> dict[str, str]:
    return {name: (Path(__file__).parent / "licenses" / f"{name}.txt").read_text() for name in TEXTS}


def _words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def _shingles_of(text: str) -> set[str]:
    words = _words_of(text)
    return {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def window_length(m: int) -> int:
    length = 2
    while length < 2 * m:
        length *= 2
    return length


def check_anchors(templates: dict[str, str], anchor: str = ANCHOR) -> None:
    for name, text in templates.items():
        shingles = _shingles_of(text) or {" ".join(_words_of(text))}
        bare = sum(not re.search(anchor, s) for s in shingles)
        if bare >= CONTAINED * len(shingles):
            raise ValueError(f"template {name}: too many shingles without an anchor word")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _shingles(words: str) -> Column:
    """64-bit hashes of all five-word runs of an array column."""
    n = F.size(words) - (SHINGLE - 1)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))
    return F.when(n >= 1, runs).otherwise(F.expr("CAST(array() AS array<bigint>)"))


def _minima(shingles: Column) -> Column:
    """One minimum for each permutation, with its number."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(PERMUTATIONS)),
        lambda k: F.struct(k.alias("k"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))).alias("low")),
    )


def _short(held: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """doc_id, license, length, start, containment of templates shorter than a shingle."""

    def runs(name: str, words: list[str]) -> Column:
        first = next(i for i, w in enumerate(words) if re.search(ANCHOR, w))
        starts = F.filter(F.transform("at", lambda p: p - first), lambda i: (i >= 1) & (F.array_join(F.slice("words", F.greatest(i, F.lit(1)), len(words)), " ") == " ".join(words)))
        return F.transform(starts, lambda i: F.struct(F.lit(name).alias("license"), F.lit(len(words)).alias("length"), i.alias("start"), F.lit(1.0).alias("containment")))

    found = F.concat(*[runs(name, _words_of(text)) for name, text in templates])
    return held.select("doc_id", F.explode_outer(found).alias("x")).where("x is not null").select("doc_id", "x.*")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment, n_windows.  Given ``templates`` replace the notices and the full texts."""
    texts = {} if templates else full_texts()
    templates = templates or TEMPLATES
    check_anchors(templates)
    check_anchors(texts, TEXT_ANCHOR)
    spark = docs.sparkSession
    short = [(name, text) for name, text in sorted(templates.items()) if not _shingles_of(text)]
    notices = [(name, text, False) for name, text in sorted(templates.items()) if _shingles_of(text)]
    listed = [(name, text, full, len(_shingles_of(text))) for name, text, full in notices + [(name, text, True) for name, text in sorted(texts.items())]]

    anchored = docs.where(F.lower(text_col).rlike(TEXT_ANCHOR if texts else ANCHOR)).select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))
    at = lambda anchor: F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.element_at("words", i).rlike(anchor))
    anchored = anchored.where(F.size("words") > 0)
    found = []
    if short:
        found.append(_short(anchored.select("doc_id", "words", at(ANCHOR).alias("at")), short))
    if listed:
        rows = [F.struct(F.lit(k).alias("t"), F.lit(name).alias("license"), F.lit(text).alias("text"), F.lit(window_length(m)).alias("length")) for k, (name, text, _, m) in enumerate(listed)]
        known = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
        known = known.select("t", "license", "length", _words(F.col("text")).alias("words")).select("t", "license", "length", F.array_distinct(_shingles("words")).alias("own"))
        bands = known.select("t", "length", F.explode(_minima(F.col("own"))).alias("b")).select("t", F.col("length").alias("t_length"), F.col("b.k").alias("t_k"), F.col("b.low").alias("t_low"))
        held = anchored.where(F.size("words") >= SHINGLE).select("doc_id", "words", _shingles("words").alias("runs"))
        held = held.select("doc_id", "runs", at(ANCHOR).alias("at"), (at(TEXT_ANCHOR) if texts else F.lit(None).cast("array<int>")).alias("text_at"))

        def starts(length: int) -> Column:
            """Windows of ``length`` shingles that hold an anchor word and enough shingles, as structs."""
            step = length // 2
            own = [(full, m) for _, _, full, m in listed if window_length(m) == length]
            need = min(-(-m * 3 // 4) for _, m in own)
            anchors = "text_at" if any(full for full, _ in own) else "at"
            first = lambda p: F.greatest(F.lit(0), F.floor((p - length - SHINGLE + 1 + step - 1) / step).cast("int"))
            numbers = F.flatten(F.transform(anchors, lambda p: F.sequence(first(p), F.greatest(first(p), F.floor((p - 1) / step).cast("int")))))
            windows = F.transform(F.array_distinct(numbers), lambda j: F.struct(F.lit(length).alias("length"), (j * step + 1).cast("int").alias("start"), F.slice("runs", (j * step + 1).cast("int"), length).alias("own")))
            windows = F.filter(windows, lambda w: F.size(w["own"]) >= need)
            return F.when(F.size("runs") >= need, windows).otherwise(F.array().cast("array<struct<length:int,start:int,own:array<bigint>>>"))

        lengths = sorted({window_length(m) for *_, m in listed})
        # outer: a plain explode makes the optimizer infer a filter that computes the array twice
        windows = held.select("doc_id", F.explode_outer(F.concat(*[starts(x) for x in lengths])).alias("w")).where("w is not null").select("doc_id", "w.*")
        keyed = windows.select("doc_id", "length", "start", F.col("own").alias("seen"), F.explode_outer(_minima(F.col("own"))).alias("b"))
        keyed = keyed.select("doc_id", "length", "start", "seen", F.col("b.k").alias("k"), F.col("b.low").alias("low"))
        hits = keyed.join(F.broadcast(bands), (F.col("length") == F.col("t_length")) & (F.col("k") == F.col("t_k")) & (F.col("low") == F.col("t_low"))).drop("t_length")
        hits = hits.join(F.broadcast(known.drop("length")), "t")
        share = F.size(F.array_intersect("own", "seen")) / F.size("own")
        found.append(hits.select("doc_id", "license", "length", "start", share.alias("containment")).where(F.col("containment") >= CONTAINED))
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    # one row per window before counting: a window is retrieved by several bands
    per_window = hits.groupBy("doc_id", "license", "length", "start").agg(F.max("containment").alias("containment"))
    return per_window.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_windows"))
