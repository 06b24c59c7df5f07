"""Mixing of sources to target weights, over exact quotas of blocks that a splitting tree deals to output shards.

1. Targets: sources share all words by weight; one that would get more than `repeat` times its words gets just that, and the
   rest is shared again. Sorted by words over weight, the sources that are cut off are a prefix, so one pass of running sums
   finds the level at which the others meet it.
2. Blocks: a source's documents are hashed to blocks, and the blocks are permuted. Its quota is all blocks for each whole pass,
   then the first blocks of the permutation, then documents of the next block, the last of them in part.
3. Tree: at each node all block draws are ordered at random and the first half goes left. So the counts of the sources on the
   left follow the multivariate hypergeometric distribution, and the leaves' counts add up to the quotas exactly.
4. A shard takes as many consecutive draws of a source's permuted blocks as its count says, and orders its rows at random:
   `mixture` has the shards of each document's draws, `draws` a row for each draw with its place in the shard.

All randomness is a hash of ids and a seed, so reruns agree. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hyperweave.llm.common import SPACE_CLASS, written

#: Documents in a block about, and the least blocks of a source; levels of the tree give 2**levels shards.
BLOCK_ROWS, LEAST_BLOCKS, LEVELS = 2000, 8, 3
#: Bits of the slices of a shard that are numbered apart.
SLICE_BITS = 8


def _size() -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE_CLASS), "")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size: the words that ASCII white space separates; null texts have none."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3) -> DataFrame:
    """source, docs, source_size, weight and target, for rows (source, size). Sources by code point, null last, take the weights in turn."""
    found = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = found.withColumn("weight", weight.cast("long"))
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * repeat
    over = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levels = ranked.withColumn("left", left).withColumn("over", over)
    cut = levels.withColumn("cut", F.col("source_size") * repeat * F.col("over") <= F.col("left") * F.col("weight"))
    # What is left where the first source isn't cut is what all from there on share.
    share = F.min_by(F.struct("left", "over"), F.when(~F.col("cut"), -F.col("left"))).over(W.partitionBy())
    first = cut.withColumn("share", share)
    target = F.when(F.col("cut"), (F.col("source_size") * repeat).cast("double")).otherwise(F.col("share.left") / F.col("share.over") * F.col("weight"))
    return first.select("source", "docs", "source_size", "weight", target.alias("target"))


def _blocks(rows: DataFrame, seed: int) -> DataFrame:
    """The rows with the block of their source that they belong to."""
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")).cast("int"))


def _plan(rows: DataFrame, wanted: DataFrame, seed: int, repeat: int) -> DataFrame:
    """A row per block: its place in the permutation, whole passes that take it, and words that the last pass takes of it in part."""
    blocks = rows.groupBy("key", "block").agg(F.sum("size").alias("words"))
    all_blocks = blocks.join(wanted.select("key", "blocks", "quota", "source_size"), "key")
    by = W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block")
    placed = all_blocks.withColumn("place", F.row_number().over(by) - 1).withColumn("before", F.sum("words").over(by) - F.col("words"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("quota") - passes * F.col("source_size")
    more = (F.col("before") + F.col("words") <= rest) & (F.col("words") > 0)
    return placed.select("key", "block", "place", (passes + more.cast("long")).alias("passes"), F.when(~more & (F.col("before") < rest), rest - F.col("before")).otherwise(0).cast("long").alias("part"))


def _halved(draws: DataFrame, order: Column) -> DataFrame:
    """Rows (key, block, ..., draw, node) with the child that each goes to: of a node's rows by `order` the first half goes left.

    Leading bits of the order make slices. Counts of slices, which are summed before they are shuffled, say which slice the
    middle of a node falls into, and only the rows of that one are put in order.
    """
    rows = draws.withColumn("order", order).withColumn("slice", F.shiftrightunsigned("order", 64 - SLICE_BITS).cast("int"))
    counts = rows.groupBy("node", "slice").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("node").orderBy("slice"))
    half = F.floor((F.sum("n").over(W.partitionBy("node")) + 1) / 2)
    # Rows before the slice, and how many of the slice go left: all, none or, in the middle one, some.
    left = counts.select("node", "slice", F.greatest(F.lit(0), F.least(F.col("n"), half - (upto - F.col("n")))).alias("left"), "n")
    placed = rows.join(F.broadcast(left), ["node", "slice"])  # a bounded number of slices for each of at most 2**levels nodes
    clear = placed.where("left = 0 or left = n").withColumn("right", (F.col("left") == 0).cast("int"))
    rank = F.row_number().over(W.partitionBy("node", "slice").orderBy("order", "key", "draw"))
    middle = placed.where("left > 0 and left < n").withColumn("right", (rank > F.col("left")).cast("int"))
    return clear.unionByName(middle).withColumn("node", 2 * F.col("node") + F.col("right")).select(*draws.columns)


def splitting_tree(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """(key, block, shards): the shard of each draw of each block, drawn in part or whole."""
    turns = plan.select("key", "block", "place", (F.col("passes") + (F.col("part") > 0).cast("long")).alias("turns")).where("turns > 0")
    draws = turns.select("key", "block", "place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("turns"))).alias("turn"))
    ordered = draws.withColumn("draw", F.row_number().over(W.partitionBy("key").orderBy("turn", "place")))
    node = ordered.withColumn("node", F.lit(0))
    for level in range(levels):
        node = written(_halved(node, F.xxhash64(F.lit(seed + 2 + level), "key", "draw")), "node")
    quotas = node.groupBy("key", "node").agg(F.count("*").alias("quota"))
    ends = quotas.withColumn("end", F.sum("quota").over(W.partitionBy("key").orderBy("node")))
    dealt = ends.select("key", F.col("node").alias("shard"), F.explode(F.sequence(F.col("end") - F.col("quota") + 1, F.col("end"))).alias("draw"))
    return ordered.withColumn("draw", F.col("draw").cast("long")).join(dealt, ["key", "draw"]).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("shards"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, levels: int = LEVELS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and shards of every row of docs (doc_id, source, text).

    taken is the words that the mix takes of the document, repeats counted; at most one document of a source is taken in part,
    and no more than `repeat` times its size. shards has the shard of each time the document's block is drawn. Repeated ids
    stand in the same block and order among themselves by size. Documents without words are never taken.
    """
    rows = written(sizes(docs), "sizes")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # a null source is a source, too
    blocks = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("docs") / BLOCK_ROWS))
    wanted = targets(rows, weights, repeat).select(key.alias("key"), "source_size", "target", blocks.cast("int").alias("blocks"), F.least(F.round("target").cast("long"), F.col("source_size") * repeat).alias("quota"))
    wanted = written(wanted, "targets")
    keyed = _blocks(rows.withColumn("key", key).join(wanted.select("key", "blocks", "source_size", "target"), "key"), seed)
    plan = written(_plan(keyed, wanted, seed, repeat), "plan")
    dealt = written(plan.join(splitting_tree(plan, levels, seed), ["key", "block"], "left").select("key", "block", "passes", "part", F.col("shards.shard").alias("shards")), "dealt")
    joined = keyed.join(dealt, ["key", "block"])
    # Only blocks drawn in part, one of a source, need an order of their documents.
    cut = joined.where("part > 0 and size > 0")
    by = W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id"), "doc_id", "size")
    some = cut.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.coalesce(F.sum("size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))))
    rest = joined.where("not (part > 0 and size > 0)").withColumn("more", F.lit(0).cast("long"))
    return some.unionByName(rest).select("doc_id", F.when(F.col("key") != "", F.expr("substring(key, 2)")).alias("source"), "size", "source_size", "target", (F.col("size") * F.col("passes") + F.col("more")).cast("long").alias("taken"), F.when(F.col("size") > 0, F.coalesce("shards", F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")).alias("shards"))


def draws(plan: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, size, shard, place and words: a row for each time that `plan`, rows of `mixture`, takes a document.

    The n-th time goes to the shard of the n-th draw of the document's block; words is the document's size, or less the last
    time it is taken in part. place numbers the rows of a shard from 0 in the order of a hash of id, time and seed, in two
    steps: the hash's first bits make slices, and rows are numbered within slices that counts before them shift.
    """
    fields = ["doc_id", "source", "size", "taken", "shards"]
    times = plan.where("taken > 0").select(*fields, F.posexplode(F.slice("shards", F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("time", "shard"))
    rows = times.select("doc_id", "source", "size", "shard", F.least(F.col("size"), F.col("taken") - F.col("time") * F.col("size")).alias("words"), F.xxhash64(F.lit(seed + 4), "doc_id", "time").alias("order"), "time")
    rows = rows.withColumn("slice", F.shiftrightunsigned("order", 64 - SLICE_BITS).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    shift = counts.select("shard", "slice", (F.sum("n").over(W.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("shift"))
    within = F.row_number().over(W.partitionBy("shard", "slice").orderBy("order", "doc_id", "time", "words")) - 1
    return rows.withColumn("within", within).join(shift, ["shard", "slice"]).select("doc_id", "source", "size", "shard", (F.col("shift") + F.col("within")).alias("place"), "words")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeat: int = 3, seed: int = 17) -> DataFrame:
    """The rows of docs in the mix: each as often as it is taken, a part of a half or more as a whole one.

    Rows come by shard, and by place within it. Rows that agree in doc_id, source and number of words each come as often as the
    most taken of them; a null doc_id or source agrees with null.
    """
    plan = written(mixture(docs, weights, repeat, seed=seed).where("taken > 0"), "plan")
    most = plan.groupBy("doc_id", "source", "size").agg(F.max_by(F.struct("taken", "shards"), "taken").alias("r")).select("doc_id", "source", "size", "r.*")
    dealt = draws(most, seed).where("2 * words >= size").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "shard", "place")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    return docs.withColumn("_words", _size()).join(dealt, same).orderBy("shard", "place", "doc_id").select(*docs.columns)
