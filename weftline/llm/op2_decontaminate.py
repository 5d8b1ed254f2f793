"""Benchmark decontamination by template canonicalisation.

Numbers, units after numbers and names (capitalised words other than the function words below, wherever
they stand) become typed placeholders; everything else is lower-cased words.  Windows of five
template tokens of every benchmark item are hash-joined with those of every whole document.  A pair is
contaminated when the windows that match and whose slots are consistent cover at least ``MIN_COVER``
of the item's windows.

Slot consistency: on one alignment (document position minus item position) every slot value of the
item must stand for one document value throughout ("3 apples ... 3" may become "7 ... 7" but not
"7 ... 9"); windows with a value that disagrees with the alignment's usual one (of equally frequent ones
the last in order) are not counted.  So a re-parameterised question is found, and a text that only
shares sentence patterns is not.

A window with fewer than ``MIN_WORDS`` words besides placeholders says too little as a template and is
matched by its exact tokens instead, case aside; so are items of fewer than five tokens, as one window of
their own length, anywhere in a text.  Nothing of an item is left out.

Scale: window hashes are built by doubling (1, 2, 4, 5 tokens), so no window is ever materialised as
text.  Only windows that occur in the benchmark become rows that carry their tokens: the distinct hashes
of the benchmark are broadcast while there are at most ``BROADCAST_WINDOWS`` (counted first); beyond it the
windows are joined by a shuffle and the texts of those that match are read again.  A pair with enough
matches shares one of the item's rarest windows, so these alone bring pairs together (rarest by their count
in the documents): a sentence pattern that many items and many documents have makes no pairs.

Defined results: null and empty texts match nothing; items without words match nothing; very long texts
count whole; repeated rows give the result of their id once, and rows of one id count as one text each
that together hold what any of them holds; several texts of one item id are separate items, of which the
best counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.store import materialize

WINDOW, MIN_COVER, MIN_WORDS, BROADCAST_WINDOWS = 5, 0.5, 2, 1_000_000
NUM, UNIT, NAME, JOINT = "\ue000", "\ue001", "\ue002", "\ue003"  # private use characters
#: Units that become a placeholder after a number (fixed values).
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|l|ml|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|inch(?:es)?|meters?|metres?|dollars?|euros?|cents?|percent|usd|eur|°c|°f"
#: Words that are no names although they often start a sentence (fixed values).
FUNCTION_WORDS = (
    "a", "an", "the", "this", "that", "these", "those", "there", "it", "he", "she", "they", "we", "you", "i", "in", "on", "at", "of", "for", "from",
    "with", "by", "to", "if", "when", "while", "as", "and", "but", "or", "so", "what", "which", "who", "whom", "whose", "where", "why", "how", "is",
    "are", "was", "were", "do", "does", "did", "has", "have", "had", "can", "could", "will", "would", "should", "find", "given", "let", "each",
    "every", "all", "some", "no", "not", "after", "before", "then", "his", "her", "their", "its", "der", "die", "das", "ein", "eine", "und", "wer",
    "wie", "wo", "warum", "le", "la", "les", "un", "une", "des", "et", "qui", "que", "quel", "quelle", "comment", "el", "los", "las", "una", "y",
    "quién", "qué", "cómo",
)


def tokens(text: Column) -> Column:
    """Array of tokens; a slot token is its type's mark followed by its value."""
    cleared = F.translate(text, NUM + UNIT + NAME + JOINT, "    ")  # marks are ours alone
    joined = F.regexp_replace(cleared, r"(?<=[0-9])[.,](?=[0-9])", JOINT)
    numbered = F.regexp_replace(joined, f"([0-9][0-9{JOINT}]*+)", f" {NUM}$1 ")
    unit = F.regexp_replace(numbered, rf"(?i)({NUM}[0-9{JOINT}]++) {{1,2}}({UNITS})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    simple = F.when(text.rlike(f"[0-9{NUM}-{JOINT}]"), unit).otherwise(text)
    # the capital comes first in the pattern: it is what is rare
    named = F.regexp_replace(simple, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{NUM}-{JOINT}])", NAME)
    words = F.split(F.lower(named), rf"[^\p{{L}}\p{{N}}{NUM}-{JOINT}]+")
    known = [NAME + w for w in FUNCTION_WORDS]
    return F.transform(F.filter(words, lambda x: x != ""), lambda x: F.when(x.isin(*known), F.substring(x, 2, 1 << 20)).otherwise(x))


def is_slot(x: Column) -> Column:
    return (x >= NUM) & (x < JOINT)


def template(x: Column) -> Column:
    """A token without its slot value."""
    return F.when(is_slot(x), F.substring(x, 1, 1)).otherwise(x)


def plain(x: Column) -> Column:
    """A token without its mark."""
    return F.when(is_slot(x), F.substring(x, 2, 1 << 20)).otherwise(x)


def _joined(a: str, b: str, shift: int) -> Column:
    """Hashes of a at each position with b ``shift`` positions on, while there is one."""
    later = F.slice(b, F.lit(shift + 1), F.greatest(F.size(b) - shift, F.lit(0)))
    return F.zip_with(F.slice(a, F.lit(1), F.least(F.size(a), F.size(later))), later, lambda x, y: F.xxhash64(x, y))


def with_windows(rows: DataFrame, exact: set[int]) -> DataFrame:
    """Adds t5 (hash of five template tokens from each position) and e<n> (of n exact tokens) for n in ``exact``."""
    columns = rows.columns
    rows = rows.withColumn("h1", F.transform("tokens", lambda x: F.xxhash64(template(x))))
    for pre in ("h", *(["x"] if exact else [])):
        if pre == "x":
            rows = rows.withColumn("x1", F.transform("tokens", lambda x: F.xxhash64(plain(x), F.lit(1))))
        rows = rows.withColumn(f"{pre}2", _joined(f"{pre}1", f"{pre}1", 1))
        if pre == "x" and 3 in exact:
            rows = rows.withColumn("x3", _joined("x2", "x1", 2))
        rows = rows.withColumn(f"{pre}4", _joined(f"{pre}2", f"{pre}2", 2))
        if pre == "h" or 5 in exact:
            rows = rows.withColumn(f"{pre}5", _joined(f"{pre}4", f"{pre}1", 4))
    return rows.select(*columns, F.col("h5").alias("t5"), *[F.col(f"x{n}").alias(f"e{n}") for n in sorted(exact)])


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (id and hash of the text), pos, w, n_windows, item_tokens, exact (length, 0 for a template)."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.struct(F.col(item_col).alias("id"), F.xxhash64(text_col).alias("text")).alias("item"), F.col(text_col).alias("t")).distinct()
    rows = rows.select("item", tokens(F.col("t")).alias("tokens")).where(F.size("tokens") > 0)
    rows = with_windows(rows, set(range(1, WINDOW + 1)))
    n = F.size("tokens")
    length = F.least(n, F.lit(WINDOW))
    exact = F.element_at(F.array(*[F.col(f"e{k}") for k in range(1, WINDOW + 1)]), length)
    at = F.transform(exact, lambda e, i: F.struct(i.alias("pos"), e.alias("e"), F.get("t5", i).alias("t")))
    rows = rows.select("item", "tokens", length.alias("length"), F.explode(at).alias("x"))
    rows = rows.select("item", F.col("x.pos").alias("pos"), "length", F.col("x.e").alias("e"), F.col("x.t").alias("t"), F.expr("slice(tokens, x.pos + 1, length)").alias("item_tokens"))
    words = F.size(F.filter("item_tokens", lambda x: ~is_slot(x)))
    by_template = (F.col("length") == WINDOW) & (words >= MIN_WORDS)
    rows = rows.select("item", "pos", F.when(by_template, F.col("t")).otherwise(F.col("e")).alias("w"), "item_tokens", F.when(by_template, 0).otherwise(F.col("length")).alias("exact"))
    return rows.withColumn("n_windows", F.count(F.lit(1)).over(Window.partitionBy("item")))


def _hits(texts: DataFrame, bench: DataFrame, broadcast_windows: int) -> DataFrame:
    """doc_id, doc_pos, w, doc_tokens of every window of a document that occurs in the benchmark."""
    exact = {r[0] for r in bench.select("exact").distinct().collect()} - {0}  # at most WINDOW lengths
    known = bench.select(F.col("w").alias("bench_w")).distinct()
    tokenised = with_windows(texts.select("doc_id", tokens(F.col("t")).alias("tokens")), exact)
    carried = ["tokens"] if known.count() <= broadcast_windows else []
    # outer: else the optimizer infers a size filter from the explode, pushes it down and computes windows many times
    seen = tokenised.select("doc_id", *carried, F.posexplode_outer("t5").alias("doc_pos", "w"))
    if exact:
        windows = F.concat(*[F.transform(f"e{n}", lambda w, i: F.struct(i.alias("at"), w.alias("w"))) for n in sorted(exact)])
        rows = tokenised.select("doc_id", *carried, F.explode_outer(windows).alias("x"))
        seen = seen.unionByName(rows.select("doc_id", *carried, F.col("x.at").alias("doc_pos"), F.col("x.w").alias("w")))
    seen = seen.where("w is not null")
    cut = F.expr(f"slice(tokens, doc_pos + 1, {WINDOW})").alias("doc_tokens")
    if carried:
        return seen.join(F.broadcast(known), F.col("w") == F.col("bench_w"), "left_semi").select("doc_id", "doc_pos", "w", cut)
    met = seen.join(known, F.col("w") == F.col("bench_w"), "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("doc_pos", "w")).alias("met"))
    read = texts.join(met, "doc_id").select("doc_id", "met", tokens(F.col("t")).alias("tokens"))
    return read.select("doc_id", "tokens", F.explode("met").alias("x")).select("doc_id", "x.doc_pos", "x.w", F.expr(f"slice(tokens, x.doc_pos + 1, {WINDOW})").alias("doc_tokens"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_cover: float = MIN_COVER, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage of the contaminated pairs."""
    bench = materialize(benchmark_windows(benchmark, item_col, item_text), "benchmark-windows")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    hits = materialize(_hits(texts, bench, broadcast_windows), "benchmark-hits")
    # a pair with enough matches shares one of the rarest windows of the item
    df = hits.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "w", "pos")
    first = bench.join(df, "w", "left").withColumn("r", F.row_number().over(rarest))
    first = first.where(F.col("df").isNotNull() & (F.col("r") <= F.col("n_windows") - F.ceil(F.col("n_windows") * min_cover) + 1))
    pairs = hits.join(first.select("item", "w").distinct(), "w").select("doc_id", "item").distinct()
    cells = pairs.join(bench, "item").join(hits, ["doc_id", "w"]).withColumn("lag", F.col("doc_pos") - F.col("pos"))
    cells = materialize(cells.select("doc_id", "item", "n_windows", "pos", "lag", "exact", "item_tokens", "doc_tokens"), "benchmark-cells")
    enough = cells.groupBy("doc_id", "item").agg(F.countDistinct("pos").alias("n"), F.first("n_windows").alias("of")).where(F.col("n") >= min_cover * F.col("of"))
    cells = cells.join(enough.select("doc_id", "item"), ["doc_id", "item"], "left_semi")
    both = F.zip_with("item_tokens", "doc_tokens", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    slots = F.when(F.col("exact") == 0, F.filter(both, lambda x: is_slot(x["a"]))).otherwise(F.filter(both, lambda x: F.lit(False)))
    cells = cells.select("doc_id", "item", "n_windows", "pos", "lag", slots.alias("z"))
    usual = (
        cells.select("doc_id", "item", "lag", F.explode("z").alias("x")).groupBy("doc_id", "item", "lag", F.col("x.a").alias("a"), F.col("x.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "item", "lag", "a").agg(F.max(F.struct("n", "b")).alias("best"))
        .groupBy("doc_id", "item", "lag").agg(F.map_from_entries(F.collect_list(F.struct("a", "best.b"))).alias("usual"))
    )
    steady = (F.size("z") == 0) | F.forall("z", lambda x: F.element_at("usual", x["a"]) == x["b"])
    cells = cells.join(usual, ["doc_id", "item", "lag"], "left").where(steady)
    found = cells.groupBy("doc_id", "item").agg(F.first("n_windows").alias("n_windows"), F.countDistinct("pos").alias("n_matched"))
    found = found.withColumn("coverage", F.col("n_matched") / F.col("n_windows")).where(F.col("coverage") >= min_cover)
    best = found.groupBy("doc_id", F.col("item.id").alias("item_id")).agg(F.max(F.struct("coverage", "n_matched", "n_windows")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_windows", "x.n_matched", "x.coverage")
