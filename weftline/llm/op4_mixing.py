"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, 2, ...; together they share
``percent`` of all sizes, none gets more than ``cap`` times its own size, and what is cut off goes
to the others by weight (water filling: the level rises until no further source is cut off).

Sample: within a source a document's expected copies are proportional to its weight, at most ``cap``,
and meet the source's target in sum (water filling again, over the at most ``WEIGHTS`` weights).
Whole copies are certain; the remaining words of the source are drawn by Pareto order sampling:
with inclusion probability pi (the fraction of the expected copies) and a uniform u, documents are
ranked by ``u/(1-u) / (pi/(1-pi))`` and taken in this order until the remaining target is met, the last
one only if that comes nearer.  u comes from md5 of a seed, the id and the text, so reruns agree.

The registered query weighs a document by the number of binary digits of its size, so of two documents
of a source the longer one is likelier, and pi differs within a source.

Scale: one pass makes (id, source, size); ranks never need a source in one task: odds map to
4,096 bins, bins are summed per source, and only the bin in which a source's target is met is
ordered by a window.  Sources are numbered by a range sort, levels found by sums over them; their table is
broadcast up to ``BROADCAST_ROWS`` rows (counted first) and joined by a shuffle beyond it.

Defined results: null text has size 0; very long texts count whole; null sources form one source; a
source without words has target 0 and takes 0; repeated rows are separate documents, those of one id and
text share their draw and are interchangeable; an empty table gives an empty result; a document weight is
rounded to a whole number from 1 to ``WEIGHTS``, null counts as 1; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.store import materialize

BINS, WEIGHTS, BROADCAST_ROWS = 4096, 64, 500_000
WORD = r"[^\x20\x09-\x0D]+"


def uniform(id_col: str, text_col: str, seed: str) -> Column:
    """Uniform in (0, 1) with 52 bits of md5."""
    of_text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    hexed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), of_text))
    return (F.conv(F.substring(hexed, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def digits(size: str = "size") -> Column:
    """Weight of a document by the binary digits of its size."""
    return F.length(F.bin(size))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` plus rank: 0, 1, ... by code point, null last.  A range sort; no task sees all sources."""
    placed = materialize(sources.orderBy(F.col("src").asc_nulls_last()).withColumn("m", F.monotonically_increasing_id()), "mix-ranks")
    part, at = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row per partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(sizes), part == F.col("p")).withColumn("rank", F.col("before") + at).drop("m", "p", "before")


def source_targets(sources: DataFrame, percent: int = 100, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(src, source_size) -> plus target.  One row per source; whole numbers until the last division."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    rows = numbered(sources.select("src", "source_size")).withColumn("w", weight)
    exact = lambda c: c.cast("decimal(38,0)")
    total, open_w = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
    share, used, free, cut = total * percent // 100, 0, open_w, 0
    while True:  # the level (share - used) / free only rises, and so does the set of sources that it cuts off
        capped = exact(F.col("source_size") * cap) * exact(F.lit(free)) < exact(F.lit(share - used)) * exact(F.col("w"))
        n, size, w = rows.where(capped).agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if n == cut:
            break
        cut, used, free = n, size * cap, open_w - w
    rest = (F.lit(share - used).cast("long") * F.col("w")).cast("double") / F.lit(float(free)) if free else F.lit(0.0)
    target = F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(rest)
    return rows.select("src", "source_size", target.alias("target"))


def expected_copies(classes: DataFrame, targets: DataFrame, cap: int = 3) -> DataFrame:
    """(src, own, words) and targets -> src, own, source_size, target, e: copies expected of a document of weight own."""
    rows = classes.join(targets.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    order = Window.partitionBy("src").orderBy(F.col("own").desc())  # at most WEIGHTS rows of a source
    higher = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    left = F.sum(F.col("own") * F.col("words")).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("capped", (F.col("target") - higher) * F.col("own") >= left * cap)
    of_source = Window.partitionBy("src")
    full = F.coalesce(F.sum(F.when(F.col("capped"), F.col("words"))).over(of_source), F.lit(0)) * cap
    pull = F.sum(F.when(~F.col("capped"), F.col("own") * F.col("words"))).over(of_source)
    e = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("capped"), F.lit(float(cap))).otherwise((F.col("target") - full) / pull * F.col("own"))
    return rows.select("src", "own", "source_size", "target", F.least(F.lit(float(cap)), F.coalesce(e, F.lit(0.0))).alias("e"))


def mix(
    docs: DataFrame, percent: int = 100, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", weight: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: what the mix takes of every document.

    ``weight``: an expression over the columns of ``docs`` and ``size``; without one all documents weigh the same.
    """
    own = F.lit(1) if weight is None else F.least(F.greatest(F.round(F.coalesce(weight, F.lit(1))).cast("long"), F.lit(1)), F.lit(WEIGHTS))
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    sized = sized.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), "size", own.cast("long").alias("own"), uniform(id_col, text_col, seed).alias("u"))
    sized = materialize(sized, "mix-sizes")  # texts are read once; what follows needs numbers only
    classes = materialize(sized.groupBy("src", "own").agg(F.sum("size").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("src").agg(F.sum("words").alias("source_size")), percent, cap, weights)
    small = classes.count() <= broadcast_rows
    side = F.broadcast if small else lambda df: df
    expected = expected_copies(classes, targets, cap).withColumnsRenamed({"src": "s", "own": "o"})
    rows = sized.join(side(expected), F.col("src").eqNullSafe(F.col("s")) & (F.col("own") == F.col("o")))
    rows = rows.withColumn("sure", F.floor("e")).withColumn("pi", F.least(F.greatest(F.col("e") - F.col("sure"), F.lit(1e-9)), F.lit(1 - 1e-9)))
    odds = F.col("u") / (1 - F.col("u")) / (F.col("pi") / (1 - F.col("pi")))
    rows = rows.select(
        "id", "src", "size", "source_size", "target", "sure", odds.alias("q"),
        ((F.col("sure") < cap) & (F.col("size") > 0)).alias("can"),
    ).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS))
    # words that certain copies leave open, and the bin in which each source's draw ends
    sure = F.sum(F.col("sure") * F.col("size"))
    bins = rows.groupBy("src", "bin").agg(sure.alias("sure_words"), F.sum(F.when(F.col("can"), F.col("size")).otherwise(0)).alias("words"), F.first("target").alias("target"))
    bins = materialize(bins, "mix-bins")
    w = Window.partitionBy("src").orderBy("bin")
    ends = bins.select(
        F.col("src").alias("s"), "bin", "words",
        (F.col("target") - F.sum("sure_words").over(Window.partitionBy("src"))).alias("open"),
        F.sum("words").over(w).alias("upto"),
    )
    ends = ends.groupBy("s").agg(
        F.first("open").alias("open"),
        F.min(F.when((F.col("upto") >= F.col("open")) & (F.col("words") > 0), F.col("bin"))).alias("end"),
        F.coalesce(F.max(F.when(F.col("upto") < F.col("open"), F.col("upto"))), F.lit(0)).alias("base"),
    )
    rows = rows.join(side(ends), F.col("src").eqNullSafe(F.col("s"))).drop("s")
    inside = F.col("can") & (F.col("bin") == F.col("end"))
    edge = rows.where(inside)
    order = Window.partitionBy("src").orderBy("q", "id").rowsBetween(Window.unboundedPreceding, -1)
    middle = 2 * (F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))) + F.col("size")
    edge = edge.withColumn("more", (middle <= 2 * F.col("open")).cast("long"))
    rest = rows.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "more", (F.col("can") & (F.col("end").isNull() | (F.col("bin") < F.col("end"))) & (F.col("open") > 0)).cast("long")
    )
    both = edge.unionByName(rest)
    copies = F.col("sure") + F.coalesce(F.col("more"), F.lit(0))
    return both.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, (sum(source_size) OVER ())::BIGINT AS total FROM s),
o AS (SELECT *, 3 * coalesce(sum(source_size) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_,
             (sum(w) OVER (k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS open_w
      FROM w WINDOW k AS (ORDER BY source_size / w::DOUBLE, encode(source) NULLS LAST)),
c AS (SELECT *, (total - full_) * w > source_size * 3 * open_w AS capped FROM o),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
        ELSE ((total - 3 * coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0)::BIGINT) * w)::DOUBLE / (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE END AS target FROM c),
x AS (SELECT *, length(bin(size))::BIGINT AS own FROM d),
k AS (SELECT source, own, sum(size)::BIGINT AS words FROM x GROUP BY 1, 2),
h AS (SELECT k.source, own, words, source_size, target, (target - 3 * coalesce(sum(words) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) * own
               >= 3 * (sum(own * words) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS capped
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WINDOW z AS (PARTITION BY k.source ORDER BY own DESC)),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN capped THEN 3.0::DOUBLE
               ELSE (target - 3 * coalesce(sum(CASE WHEN capped THEN words END) OVER (PARTITION BY source), 0)::BIGINT) / (sum(CASE WHEN NOT capped THEN own * words END) OVER (PARTITION BY source))::DOUBLE * own END AS e FROM h),
e AS (SELECT x.doc_id, x.source, x.size, g.source_size, g.target, x.u, least(3.0::DOUBLE, coalesce(g.e, 0.0::DOUBLE)) AS e
      FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source AND x.own = g.own),
p AS (SELECT *, floor(e)::BIGINT AS sure, least(greatest(e - floor(e), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS pi FROM e),
q AS (SELECT *, u / (1 - u) / (pi / (1 - pi)) AS q, (sure < 3 AND size > 0) AS can,
             target - (sum(sure * size) OVER (PARTITION BY source))::DOUBLE AS open_ FROM p),
r AS (SELECT *, coalesce(sum(CASE WHEN can THEN size END) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_ FROM q),
m AS (SELECT *, CASE WHEN can AND open_ > 0 AND 2 * before_ + size <= 2 * open_ THEN 1 ELSE 0 END AS more FROM r)
SELECT doc_id, size, source_size, target, (sure + more) * size AS taken, sure + more AS copies FROM m
"""
