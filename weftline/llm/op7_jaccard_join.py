"""Exact Jaccard join on word shingles by signature trees, and its components.

A document's set holds the distinct five-word shingles of its whole text (words: runs of anything but
the six ASCII white spaces, A-Z lower-cased); fewer words make one shingle of the whole sequence.
Two documents link when 100 * intersection >= 75 * union.

1. *Sets.*  One pass gives every document its set size and a digest of its set; equal sets are one
   node from here on, so exact copies cost nothing more.  The same pass counts shingles that recur
   within a stretch of text; the ``HOT`` most frequent (bounded, broadcast) only set the order below.
2. *Blocks.*  Shingles are ordered from rare to frequent.  Two sets that link have an overlap of
   ``ceil(0.75 n)`` at least, so the first k of their common shingles lie among the first
   ``n - ceil(0.75 n) + k`` of either, whatever the order.  Nodes with such a shingle in common form
   a block; a node that shares fewer than k of them with any others (k for the smallest size it may
   link with) has no link and goes.  The order keeps passages that many documents share out of blocks.
3. *Trees around hubs.*  The hub of a block is the node with the largest share of its shingles in blocks,
   so of an original and its edited copies it is the original.  The nodes that meet a hub most often (each
   node counts for two hubs) form a signature tree, which the hub's signature traverses; pairs that
   remain are verified exactly.  Components of these links label the nodes.
4. *Trees of blocks.*  A block with one label is done, and a node with fewer than k blocks of several
   labels too.  By the argument of 2, the first common block of two nodes, smallest blocks first, is not
   among the last k - 1 of either, so these go.  Every block that is left is a signature tree which
   is joined with itself (``signature_tree``), and pairs of nodes of different labels that remain are
   verified exactly.  Blocks over ``BLOCK`` rows are split by size first (sets that link are in the
   same or in neighbouring size bands), then into chunks, so no task holds an unbounded block.
5. *Components* of all verified links by alternating large-star / small-star rounds, each a
   partial aggregation and a join, written to the shared folder.

Shingles are 64-bit hashes, digests are 64 bits of BLAKE2b.

Defined results: null, empty and white-space texts have an empty set, no link, and are their own
component; very long texts count whole; repeated rows are one node; ids are integers, rows of equal id
share a component only through their texts (``classes`` tells them apart); the least id names a
component, so ties need no order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shingles import digest_of, shingle_sets
from weftline.llm.signature_tree import bitmap, candidate_pairs, links
from weftline.llm.store import drop, materialize

HOT, BLOCK, STRETCH, RECUR = 200_000, 4000, 2_000_000, 4
BROADCAST_ROWS = 1_000_000
SIEVE = 22  # bits of the table that sorts out shingles that are not hot


def shared_least(n: int) -> int:
    """Shingles that two linked sets share in their prefixes, by the size of the smaller."""
    return max(1, -(-3 * n // 4) // 10)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + shared_least(n)


def _long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def set_rows(docs: DataFrame) -> DataFrame:
    """kind 0: (id, key, n, node) for each document; kind 1: (shingle, -, count) recurring within a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def recurring() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= RECUR
            none = np.zeros(often.sum(), np.int64)
            return _batch(kind=np.ones(len(none), np.int32), id=_long(s[often]), key=none, n=n[often].astype(np.int64), node=none)

        for b in batches:
            for at, sets in shingle_sets(b.column("t")):
                part = b.slice(at, len(sets))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                node = np.fromiter(map(digest_of, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column("id"), part.column("key"), pa.array(n), pa.array(node)], names=["kind", "id", "key", "n", "node"])
                held += sets
                size += int(n.sum())
                if size >= STRETCH:
                    yield recurring()
                    held, size = [], 0
        if size:
            yield recurring()

    return docs.mapInArrow(run, "kind int, id long, key long, n long, node long")


def block_rows(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sig, node): the rarest shingles of every set; each set once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        sieve, low = np.zeros(1 << SIEVE, bool), np.uint64((1 << SIEVE) - 1)
        sieve[(known & low).astype(np.int64)] = True
        done: set[int] = set()

        def prefix(s: np.ndarray) -> np.ndarray:
            p = prefix_length(len(s))
            maybe = sieve[(s & low).astype(np.int64)]
            if not maybe.any():
                return s[:p]
            rank = np.zeros(len(s), np.int64)
            at = np.minimum(np.searchsorted(known, s[maybe]), len(known) - 1)
            rank[maybe] = np.where(known[at] == s[maybe], counts[at], 0)
            return s[np.argsort(rank, kind="stable")[:p]]

        for b in batches:
            for _, sets in shingle_sets(b.column("t")):
                sigs, nodes = [], []
                for s in sets:
                    node = digest_of(s)
                    if len(s) and node not in done:
                        if len(done) < 1_000_000:
                            done.add(node)
                        sigs.append(prefix(s))
                        nodes.append(node)
                if sigs:
                    yield _batch(sig=_long(np.concatenate(sigs)), node=np.repeat(np.array(nodes, np.int64), [len(s) for s in sigs]))

    return docs.mapInArrow(run, "sig long, node long")


def set_table(docs: DataFrame) -> DataFrame:
    """(node, n, items, bits): whole sets and bitmaps of the given documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sets in shingle_sets(b.column("t")):
                columns = [pa.array([digest_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([bitmap(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "items", "bits"])

    return docs.mapInArrow(run, "node long, n long, items binary, bits binary")


def tree_join(rows: DataFrame) -> DataFrame:
    """Candidate (a, b) of every tree.  rows: (sig, i, j, side, node, n, bits, label); where i < j only sides that differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def join() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            column = lambda c: t[c].to_numpy()
            for a, b in candidate_pairs(column("node"), column("n"), t["bits"].to_pylist(), column("label"), column("side").astype(np.int64), key[1] != key[2]):
                yield _batch(a=a, b=b)

        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("sig", "i", "j")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for first, end in zip([0, *new.tolist()], [*new.tolist(), b.num_rows], strict=True):
                if first == end:
                    continue
                own = tuple(int(k[first]) for k in keys)
                if own != key:
                    if held:
                        yield from join()
                    key, held = own, []
                held.append(b.slice(first, end - first))
        if held:
            yield from join()

    dealt = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) that link, by exact intersection."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["a_items"], b["b_items"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(links(len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            yield b.loc[keep, ["a", "b"]]

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_items", "b_items")
    return both.mapInPandas(run, "a long, b long")


def label_nodes(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label): the smallest node of each component, for nodes other than it."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
        joined = both.join(low, F.col("a") == F.col("k"))
        if large:
            return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        moved = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x"))
        return moved.select("x.a", "x.b").where("a != b").distinct()

    mark = lambda e: e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = mark(edges)
    for _ in range(rounds):
        last, edges = edges, materialize(star(star(edges, True), False), "stars")
        drop(last)
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def hot_shingles(rows: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent recurring shingles, by hash: at most ``most`` pairs of numbers."""
    top = rows.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(most).toPandas()
    s = top["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(s)
    return s[order], top["n"].to_numpy(np.int64)[order]


def _need(n: F.Column) -> F.Column:
    """shared_least of the smallest size a node may link with."""
    return F.greatest(F.lit(1), F.floor(F.ceil(F.ceil(n * 0.75) * 0.75) / 10))


def _of_several(rows: DataFrame, column: str) -> DataFrame:
    """The rows of blocks that hold more than one value of ``column``."""
    by_sig = Window.partitionBy("sig")
    return rows.withColumns({"low": F.min(column).over(by_sig), "high": F.max(column).over(by_sig)}).where("low != high").drop("low", "high")


def _enough(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of nodes in enough blocks, with c (number of blocks) and n."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(sizes, "node")
    return rows.join(counts.where(F.col("c") >= _need(F.col("n"))), "node")


def hub_trees(blocks: DataFrame, sets: DataFrame, chunk: int = BLOCK) -> DataFrame:
    """Rows of the trees around hubs: side 0 the hub, side 1 nodes that meet it.  blocks: (sig, node, hub)."""
    met = blocks.where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    by_node = Window.partitionBy("node").orderBy(F.desc("c"), "hub")
    star = met.withColumn("r", F.row_number().over(by_node)).where("r <= 2").select("node", "hub")
    sizes = star.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    members = star.join(sizes, "hub").select(F.col("hub").alias("sig"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("i"), F.lit(1).alias("side"), "node")
    hubs = sizes.select(F.col("hub").alias("sig"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(0).alias("side"), F.col("hub").alias("node"))
    rows = members.unionByName(hubs).join(sets.select("node", "n", "bits"), "node")
    return rows.select("sig", "i", (F.col("i") + 1).alias("j"), "side", "node", "n", "bits", F.col("node").alias("label"))


def block_trees(blocks: DataFrame, sets: DataFrame, chunk: int = BLOCK) -> DataFrame:
    """Rows of the trees of blocks.  blocks: (sig, node, n, label, c) of blocks of several labels; c: in how many a node is."""
    sized = blocks.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("sig")))
    order = Window.partitionBy("node").orderBy("size", "sig")
    first = sized.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("c") - _need(F.col("n")) + 1).select("sig", "node", "n", "label")
    first = materialize(_of_several(first, "label").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("sig"))), "labelled-blocks")
    # blocks of the same nodes need one look: passages give many of them
    same = first.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("y"))
    rows = first.join(same.groupBy("m", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")
    # a size band is 4/3 wide, so sets that link are in the same or in neighbouring bands
    large = F.col("size") > chunk
    band = F.when(large, F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)))).otherwise(0).cast("int")
    rows = rows.withColumn("band", band)
    of_band = rows.where(large).groupBy("sig", "band").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    at = of_band.withColumn("before", F.coalesce(F.lag(F.struct("band", "chunks")).over(Window.partitionBy("sig").orderBy("band")), F.struct(F.lit(-9).alias("band"), F.lit(0).alias("chunks"))))
    at = at.withColumn("after", F.coalesce(F.lead(F.struct("band", "chunks")).over(Window.partitionBy("sig").orderBy("band")), F.struct(F.lit(-9).alias("band"), F.lit(0).alias("chunks"))))
    # numbers of a block's chunks: band by band
    at = at.withColumn("base", F.sum("chunks").over(Window.partitionBy("sig").orderBy("band")) - F.col("chunks"))
    low = F.when(F.col("before.band") == F.col("band") - 1, F.col("base") - F.col("before.chunks")).otherwise(F.col("base"))
    high = F.when(F.col("after.band") == F.col("band") + 1, F.col("base") + F.col("chunks") + F.col("after.chunks")).otherwise(F.col("base") + F.col("chunks"))
    at = at.select("sig", "band", "chunks", "base", low.alias("from"), (high - 1).alias("to"))
    small = rows.where(~large).select("sig", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "node", "n", "label")
    big = rows.where(large).join(at, ["sig", "band"]).withColumn("side", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int"))
    big = big.withColumn("o", F.explode(F.sequence(F.col("from").cast("int"), F.col("to").cast("int"))))
    big = big.select("sig", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "node", "n", "label")
    return small.unionByName(big).join(sets.select("node", "bits"), "node")


def classes(docs: DataFrame, key: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, n, class for every row; rows of one class (null: an empty set) are linked, directly or by others.

    ``key``: a long that tells rows of one id apart, such as a hash of their texts.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if key is None else key).cast("long").alias("key"), F.col(text_col).alias("t"))
    rows = materialize(set_rows(texts), "shingle-sets")
    owners = rows.where("kind = 0").select("id", "key", "n", "node")
    blocks = block_rows(texts.select("t"), hot_shingles(rows))
    # the node that stands for equal sets is read from one of their documents
    first = owners.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "key")).alias("first"), F.first("n").alias("n"))
    sizes = first.select("node", "n")
    blocks = materialize(_of_several(blocks, "node").distinct(), "blocks")
    for k in range(2):
        score = F.least(F.lit(1000), F.floor(F.col("c") * 1000 / F.col("n")))
        # the share of its shingles that a node has in blocks: an original shares all, an edited copy not its edits
        able = _enough(blocks.select("sig", "node"), sizes).withColumn("best", F.max(F.struct(score.alias("score"), "node")).over(Window.partitionBy("sig")))
        last, blocks = blocks, materialize(_of_several(able.select("sig", "node", F.col("best.node").alias("hub")), "node"), f"blocks-{k}")
        drop(last)
    wanted = materialize(first.join(blocks.select("node").distinct(), "node", "left_semi").select(F.col("first.id").alias("w_id"), F.col("first.key").alias("w_key")), "wanted")
    keys = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    of_wanted = texts.join(keys, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("key") == F.col("w_key")), "left_semi")
    sets = materialize(set_table(of_wanted.select("t")).dropDuplicates(["node"]), "sets")
    near = materialize(verify(tree_join(hub_trees(blocks, sets)), sets), "hub-links")
    labels = label_nodes(near)
    named = blocks.select("sig", "node").join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
    # a link that is left lies in k blocks of several labels
    named = _of_several(_enough(_of_several(named, "label"), sizes).drop("c", "n"), "label")
    named = materialize(_enough(named, sizes), "unsettled-blocks")
    more = verify(tree_join(block_trees(named, sets)), sets)
    labels = label_nodes(near.unionByName(more))
    # a node may stand for a large part of all rows (exact copies): labels are few and come to the rows
    labels = F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels
    of_class = F.when(F.col("n") > 0, F.coalesce("label", "node")).alias("class")
    return owners.join(labels, "node", "left").select("id", "key", "n", of_class)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows = materialize(classes(docs, None, id_col, text_col), "classes")
    # a class may hold a large part of all rows: its name is broadcast where classes of several rows are few
    several = materialize(rows.where("class is not null").groupBy("class").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "class-names")
    names = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    out = rows.join(names, "class", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
