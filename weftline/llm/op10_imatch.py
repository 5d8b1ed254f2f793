"""I-Match fingerprints: hashes of a text's terms inside an inverse-document-frequency band.

Terms are the distinct lower-cased runs of letters and digits.  Document frequencies are counted
over all documents; the lexicon keeps terms whose idf = ln(N / df) lies in the band
(``LOW_SHARE`` <= df / N <= ``HIGH_SHARE``).  Its size has a proven bound: all df together are N times
the mean number of terms, so at most mean / ``LOW_SHARE`` terms (some 25,000) reach the lower share,
however large the corpus.  It is read as a scalar subquery and intersected with each text's terms in
place, so texts never move for it.

Randomised lexicons: ``GROUPS`` seeded draws keep a quarter of the lexicon each, and each of them is thinned
by ``len(RATES)`` further draws, so there are 64 overlapping random subsets of the lexicon, which keep a term
with probability 1/16 to 1/128.  A text's terms in a subset, sorted, are hashed.  A fingerprint lists these
hashes; likeness of two fingerprints is the share of equal hashes among the subsets that are not
empty on both sides.  (Subsets that keep most terms, as used against single-word changes, would tell
a text with a third replaced from a foreign one no better than chance: any change alters their hash.)

A text without lexicon terms uses all its terms, and one without terms its whole text, so equal
texts always have equal fingerprints and likeness 1.

Neighbours (next document by descending id) come from one shuffle by id range: at most ``RANGES`` ranges
between quantiles of the ids, about ``RANGE_ROWS`` documents each; each range also receives a copy of
the first document of the next lower non-empty range, and a window inside the range reads the next text.

Defined results: null text counts as empty; very long texts count whole; a single document is its own
next; among equal ids the order is by text, so repeated rows follow each other; a null id is the
lowest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.store import materialize

LOW_SHARE, HIGH_SHARE, GROUPS, RATES = 0.01, 0.2, 8, (4, 8, 16, 16, 16, 32, 32, 32)
RANGE_ROWS, RANGES = 4000, 4096
NONE = "-" * 8


def _terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW_SHARE, high: float = HIGH_SHARE) -> DataFrame:
    """term: hashes of the band's terms.  Two documents at least must share a term."""
    terms = docs.select(F.explode_outer(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).where("term is not null")
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") >= F.greatest(F.lit(2.0), total * low)) & (F.col("df") <= F.greatest(F.lit(2.0), total * high))).select("term")


def _chosen(rows: DataFrame, text: str, lex: DataFrame) -> DataFrame:
    """``rows`` plus w_chosen: the text's lexicon terms, sorted."""
    table = lex.agg(F.sort_array(F.collect_list("term"))).scalar()
    rows = rows.withColumn("w_terms", _terms(F.col(text)))
    # the intersection keeps the order of the sorted lexicon
    rows = rows.withColumn("w_kept", F.array_intersect(table, F.col("w_terms")))
    chosen = F.when(F.size("w_kept") > 0, F.col("w_kept")).when(F.size("w_terms") > 0, F.sort_array("w_terms")).otherwise(F.array(F.xxhash64(text)))
    return rows.withColumn("w_chosen", chosen).drop("w_terms", "w_kept")


def _hashed(rows: DataFrame, out: str) -> DataFrame:
    """``rows`` with w_chosen replaced by ``out``: hash of the terms in each random subset, or dashes."""
    groups = [f"w_group{k}" for k in range(GROUPS)]
    drawn = lambda k: F.transform("w_chosen", lambda t: F.xxhash64(t, F.lit(k)))
    rows = rows.withColumns({g: F.filter(drawn(k), lambda h: h.bitwiseAND(F.lit(3)) == 0) for k, g in enumerate(groups)})

    def one(group: str, k: int, rate: int) -> Column:
        own = F.filter(group, lambda h: F.shiftright(h, 8 + 7 * k).bitwiseAND(F.lit(rate - 1)) == 0)
        low = F.xxhash64(own).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(F.size(own) > 0, F.lower(F.lpad(F.hex(low), 8, "0"))).otherwise(F.lit(NONE))

    # groups are referred to often, so the optimizer computes each once
    return rows.withColumn(out, F.array(*[one(g, k, rate) for g in groups for k, rate in enumerate(RATES)])).drop("w_chosen", *groups)


def likeness(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when((x == NONE) & (y == NONE), F.lit(None)).when(x == y, 1).otherwise(0))
    told = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(told) > 0, F.aggregate(told, F.lit(0), lambda s, x: s + x) / F.size(told)).otherwise(F.lit(1.0))


def fingerprints(docs: DataFrame, lex: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t, f: every whole text with its list of hashes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return _hashed(_chosen(rows, "t", lex), "f")


def id_ranges(rows: DataFrame, key: str, range_rows: int = RANGE_ROWS, most: int = RANGES) -> Column:
    """Number of a row's range: how many of the quantiles lie at or below its id.  Reads the ids only."""
    count = rows.count()
    wanted = min(most, -(-count // range_rows))
    if wanted < 2:
        return F.lit(0)
    shares = [k / wanted for k in range(1, wanted)]
    cuts = sorted({c for c in rows.agg(F.percentile_approx(key, shares, 10 * wanted)).first()[0] or []})
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    seek = lambda at, step: F.when(F.try_element_at(table, at + step) <= F.col(key), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), seek)


def with_next(rows: DataFrame, key: str = "doc_id", columns: tuple[str, ...] = ("t", "f"), part: Column | None = None) -> DataFrame:
    """``rows`` plus next_<c> of the next row by descending key (after the last, the first)."""
    rows = rows.withColumn("p", F.lit(0) if part is None else part)
    # one row per range: the id of its first document, and the range above that must see it
    ranges = rows.groupBy("p").agg(F.max(key).alias("first_id"))
    order = Window.orderBy("p")  # at most RANGES + 1 rows
    above = F.coalesce(F.lead("p").over(order), F.min("p").over(Window.partitionBy()))
    ranges = materialize(ranges.select(F.col("p").alias("r"), "first_id", above.alias("above")), "id-ranges")
    dealt = rows.join(F.broadcast(ranges), (F.col("p") == F.col("r")) & F.col(key).eqNullSafe(F.col("first_id")), "left")
    copies = F.when(F.col("above").isNull(), F.array(F.struct(F.col("p").alias("p"), F.lit(0).alias("copy")))).otherwise(
        F.array(F.struct(F.col("p").alias("p"), F.lit(0).alias("copy")), F.struct(F.col("above").alias("p"), F.lit(1).alias("copy")))
    )
    dealt = dealt.select(key, *columns, F.explode(copies).alias("d")).select(key, *columns, "d.p", "d.copy")
    w = Window.partitionBy("p").orderBy("copy", F.col(key).desc(), columns[0])
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("copy = 0").drop("p", "copy")


def digest(docs: DataFrame) -> DataFrame:
    lex = materialize(lexicon(docs), "lexicon")
    part = id_ranges(docs.select("doc_id"), "doc_id")
    rows = with_next(fingerprints(docs, lex), part=part)
    n = F.char_length("t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - third), F.substring(F.col("next_t"), F.lit(1), third))
    rows = rows.select("doc_id", "t", "f", "next_f", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = _hashed(_chosen(rows.drop("t"), "edited", lex), "g")
    rows = rows.select("doc_id", "n_chars", "f", "next_f", F.sha2("edited", 256).alias("edited_sha256"), "g")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("f", "").alias("fingerprint"), F.array_join("g", "").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )
