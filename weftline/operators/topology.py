"""Service topology: links between groups of nodes, and the largest groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import schema
from weftline.plans.store import materialize


def build(edges: DataFrame, groups: DataFrame, classes: Sequence[tuple[DataFrame, DataFrame, str]] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, degrees, omitted) of edges (from_id, to_id, kind, metadata, confidence) under groups (id, grp).

    links: from_grp, to_grp, kind, count, confidence (the weakest).  Ambiguous edges of one source, kind and
    metadata count once, as heuristic, when all their candidates lie in one group; else they are omitted.

    ``classes`` are edges not multiplied out: (found, members, kind) as of ``resolve.import_classes``, with the target
    as metadata.  The members of a class are counted by group, so hot names cost their imports plus their candidates.
    """
    a = groups.select(F.col("id").alias("from_id"), F.col("grp").alias("from_grp"))
    b = groups.select(F.col("id").alias("to_id"), F.col("grp").alias("to_grp"))
    placed = [edges.join(a, "from_id").join(b, "to_id").select("from_id", "from_grp", "kind", "metadata", "confidence", "to_grp", F.col("to_grp").alias("last"), F.lit(1).cast("long").alias("edges"))]
    for found, members, kind in classes:
        name = ["name", "scope"]
        sources = found.withColumnRenamed("node_id", "from_id").join(a.hint("merge"), "from_id")
        sizes = members.join(b.hint("merge"), "to_id").groupBy(*name, "to_grp").agg(F.count(F.lit(1)).alias("size"))
        sizes = materialize(sizes, "class-groups")  # read for sure and for ambiguous edges
        sources = materialize(sources.select("from_id", "from_grp", F.lit(kind).alias("kind"), F.col("target").alias("metadata"), "confidence", *name), "class-sources")
        none = F.lit(None)
        sure = sources.where("confidence != 'ambiguous'").groupBy("from_grp", "kind", "confidence", *name).agg(F.count(F.lit(1)).alias("sources"))
        sure = sure.join(sizes.hint("merge"), name).groupBy("from_grp", "kind", "confidence", "to_grp").agg(F.sum(F.col("sources") * F.col("size")).alias("edges"))
        placed.append(sure.select(none.cast("long").alias("from_id"), "from_grp", "kind", none.cast("string").alias("metadata"), "confidence", "to_grp", F.col("to_grp").alias("last"), "edges"))
        ends = sizes.groupBy(*name).agg(F.min("to_grp").alias("to_grp"), F.max("to_grp").alias("last"))
        unsure = sources.where("confidence = 'ambiguous'").join(ends.hint("merge"), name)
        placed.append(unsure.select("from_id", "from_grp", "kind", "metadata", "confidence", "to_grp", "last", F.lit(1).cast("long").alias("edges")))
    placed = materialize(reduce(DataFrame.unionByName, placed), "placed-edges")  # read by every fold below
    sure = placed.where("confidence != 'ambiguous'").select("from_grp", "to_grp", "kind", schema.confidence_rank(F.col("confidence")).alias("rank"), "edges")
    unsure = (
        placed.where("confidence = 'ambiguous'").groupBy("from_id", "from_grp", "kind", "metadata")
        .agg(F.min("to_grp").alias("to_grp"), F.max("last").alias("last"))
    )
    once = unsure.where("to_grp = last").select("from_grp", "to_grp", "kind", F.lit(1).alias("rank"), F.lit(1).cast("long").alias("edges"))
    omitted = unsure.where("to_grp != last").agg(F.count(F.lit(1)).alias("ambiguous_omitted"))
    counted = sure.unionByName(once).groupBy("from_grp", "to_grp", "kind").agg(F.sum("edges").alias("count"), F.max("rank").alias("rank"))
    counted = materialize(counted.withColumn("confidence", schema.confidence_of(F.col("rank"))).drop("rank"), "group-links")
    links = counted.where("from_grp != to_grp")
    ends = links.select(F.col("from_grp").alias("grp"), "count").unionByName(links.select(F.col("to_grp").alias("grp"), "count"))
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("contracts"))
    inside = counted.where("from_grp = to_grp").groupBy(F.col("from_grp").alias("grp")).agg(F.sum("count").alias("internal"))
    degrees = size.join(ends.groupBy("grp").agg(F.sum("count").alias("degree")), "grp", "left").join(inside, "grp", "left").na.fill(0, ["degree", "internal"])
    return links, degrees, omitted


def select(links: DataFrame, degrees: DataFrame, most: int) -> DataFrame:
    """Links between the ``most`` largest groups (degree, contracts, name); the rest becomes ``other`` and self links go."""
    # the table of groups is the aggregate's result; a top-n over it is a take-ordered, not a full sort
    top = degrees.orderBy(F.desc("degree"), F.desc("contracts"), "grp").limit(most).select("grp")
    keep = lambda side: top.select(F.col("grp").alias(side), F.lit(True).alias(f"{side}_kept"))
    rows = links.join(keep("from_grp"), "from_grp", "left").join(keep("to_grp"), "to_grp", "left")
    name = lambda side: F.when(F.col(f"{side}_kept"), F.col(side)).otherwise(F.lit("other"))
    rows = rows.select(name("from_grp").alias("from_grp"), name("to_grp").alias("to_grp"), "kind", "count", schema.confidence_rank(F.col("confidence")).alias("rank"))
    rows = rows.where("from_grp != to_grp").groupBy("from_grp", "to_grp", "kind").agg(F.sum("count").alias("count"), F.max("rank").alias("rank"))
    return rows.withColumn("confidence", schema.confidence_of(F.col("rank"))).drop("rank")


def mermaid(links: DataFrame, limit: int = 200) -> str:
    """Mermaid text of a bounded set of links."""
    rows = links.orderBy("from_grp", "to_grp", "kind").limit(limit).collect()
    safe = lambda s: str(s).replace('"', "#quot;").replace("\n", " ")[:120]
    names = sorted({r[c] for r in rows for c in ("from_grp", "to_grp")})
    at = {n: f"g{k}" for k, n in enumerate(names)}
    head = ["graph LR", *(f'  {at[n]}["{safe(n)}"]' for n in names)]
    return "\n".join(head + [f"  {at[r['from_grp']]} -->|{r['kind']} {r['count']}| {at[r['to_grp']]}" for r in rows])


def rank_groups(degrees: DataFrame) -> DataFrame:
    w = Window.orderBy(F.desc("degree"), F.desc("contracts"), "grp")
    return degrees.withColumn("rank", F.row_number().over(w))
