"""Mixing sources to target weights by Sainte-Lague apportionment, with SQL functions only.

1. Targets: sources share all words by weight; a source's target stops at
   ``max_repeat`` times its size and the excess is shared again by weight. The
   fixed point is found in closed form from running sums over the sources.
2. Blocks: words are dealt in equal blocks. A block is a thousandth of the
   smallest positive target (one word at least), so the rounding of a quota is
   small beside any target.
3. Quotas: a source's target is a number of blocks; Sainte-Lague gives each shard
   of the source an integer quota (highest quotients size / (2k - 1)). The quota
   of a shard can only lie within half its share of n seats around its
   proportional part, so only those candidates are ranked: about two for each
   shard, whatever the number of blocks.
4. Selection: inside a shard, documents lie one after another in seeded hash
   order (of equal ids by size, then digest of the text). Whole rounds of the quota take every block; the rest takes a run of
   blocks from a seeded start, cyclically. What a document has in the selected
   blocks is what the mix takes from it.

Nothing depends on partitioning, so that reruns agree. A source may hold any part
of the rows: it is cut into shards of about ``shard_docs`` documents by hash, and
windows are over one shard, or over the shards of one source (one row each).

Null text counts 0 words and takes 0; a null source is a source of its own, last
in the order; rows with the same id are separate documents with places of their own,
and only rows of equal id and equal text can change places; a source without words
has target 0; an empty table gives an empty result; texts of any length are counted
whole. Columns other than the three named are ignored by :func:`mix` and kept by
:func:`apply_mix`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import WORD, Scratch


def hash32(*parts: Column) -> Column:
    """An unsigned 32-bit number from md5 of the parts, the same in any SQL engine."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], max_repeat: int) -> DataFrame:
    """(source, source_size) to target words for each source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    w = sizes.withColumn("nth", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    # Sources fill up in the order of cap / weight; the first that has room decides the level.
    fill = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(all_rows)).withColumn("weights", F.sum("weight").over(all_rows))
    w = w.withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    w = w.withColumn("share", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("open", F.col("rest").cast("double") / F.col("share") <= F.col("cap") / F.col("weight"))
    w = w.withColumn("first", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "nth", "rest", "share"))).over(all_rows))
    level = F.col("weight") * F.col("first.rest").cast("double") / F.col("first.share")
    capped = F.col("cap") / F.col("weight") < F.col("first").getField("col1")
    return w.select("source", "source_size", "total", F.when(capped, F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level)).alias("target"))


def shard_quotas(shards: DataFrame, max_repeat: int) -> DataFrame:
    """(source, shard, words, source_size, target, block) to blocks taken from each shard."""
    seats = F.round(F.col("target") / F.col("block")).cast("long")
    by = W.partitionBy("source")
    s = shards.withColumn("seats", seats).withColumn("n", F.count(F.lit(1)).over(by))
    s = s.withColumn("blocks", F.ceil(F.col("words") / F.col("block")))
    part = F.coalesce(F.try_divide(F.col("words").cast("double"), F.col("source_size")), F.lit(0.0))
    low = F.greatest(F.lit(0), F.ceil(part * (F.col("seats") - F.col("n") / 2) - 0.5))
    high = F.greatest(F.lit(0), F.floor(part * (F.col("seats") + F.col("n") / 2) + 0.5))
    most = F.lit(max_repeat) * F.col("blocks")
    s = s.withColumn("low", F.least(low, most)).withColumn("high", F.least(high, most))
    s = s.withColumn("open", F.col("seats") - F.sum("low").over(by))
    k = s.where("high > low").select("source", "shard", "open", "words", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k"))
    best = W.partitionBy("source").orderBy((F.col("words").cast("double") / (2 * F.col("k") - 1)).desc(), "shard", "k")
    won = k.withColumn("place", F.row_number().over(best)).where("place <= open")
    won = won.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("won"))
    s, won = s.alias("s"), won.alias("w")
    same = F.col("s.source").eqNullSafe(F.col("w.source")) & (F.col("s.shard") == F.col("w.shard"))
    return s.join(won, same, "left").select("s.*", (F.col("low") + F.coalesce("won", F.lit(0))).alias("quota"))


def placed(docs: DataFrame, weights: list[int], max_repeat: int, seed: int, shard_docs: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, digest, ...) of each document with the words that the mix takes of it."""
    size = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long")
    d = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
    )
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = source_targets(sizes.select("source", "source_size"), list(weights), max_repeat)
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) / 1000)).cast("long"))
    spread = sizes.select(F.col("source").alias("of"), F.ceil(F.col("docs") / shard_docs).cast("long").alias("shards"))
    plan = targets.join(spread, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # Every document finds its shard by hash; the number of shards of its source comes with the plan.
    p = plan.select(F.col("source").alias("of"), "source_size", "target", "block", "shards")
    d = d.join(p, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    d = d.withColumn("shard", hash32(F.lit(seed), F.lit("shard"), F.col("id")) % F.col("shards"))
    d = d.withColumn("draw", hash32(F.lit(seed), F.lit("draw"), F.col("id")))
    per = d.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("block").alias("block"))
    quota = shard_quotas(per, max_repeat).select(F.col("source").alias("of"), F.col("shard").alias("at"), "words", "blocks", "quota")
    d = d.join(quota, F.col("source").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("at"))).drop("of", "at")
    upto = W.partitionBy("source", "shard").orderBy("draw", "id", "size", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("end", F.sum("size").over(upto)).withColumn("begin", F.col("end") - F.col("size"))
    d = d.withColumn("rounds", F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0))
    d = d.withColumn("extra", F.col("quota") - F.col("rounds") * F.col("blocks"))
    start = hash32(F.lit(seed), F.lit("start"), F.coalesce("source", F.lit("")), F.col("shard")) % F.greatest(F.col("blocks"), F.lit(1))
    d = d.withColumn("from", start)

    def overlap(first: Column, last: Column) -> Column:
        """Words of the document within the blocks first to last (last excluded)."""
        return F.greatest(F.lit(0), F.least(F.col("end"), last * F.col("block")) - F.greatest(F.col("begin"), first * F.col("block")))

    stop = F.col("from") + F.col("extra")
    run = overlap(F.col("from"), F.least(stop, F.col("blocks"))) + overlap(F.lit(0), F.greatest(stop - F.col("blocks"), F.lit(0)))
    return d.withColumn("taken", (F.col("rounds") * F.col("size") + run).cast("long"))


def mix(
    docs: DataFrame,
    weights: list[int] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 17,
    shard_docs: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns the id, ``source``, ``size``, ``source_size``, ``target``, ``taken``
    and the ``shard``, ``block`` and ``quota`` that led to it.
    """
    d = placed(docs, weights, max_repeat, seed, shard_docs, id_col, text_col, source_col)
    return d.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "shard", "block", "quota")


def apply_mix(
    docs: DataFrame,
    weights: list[int] = (1, 2, 3),
    max_repeat: int = 3,
    seed: int = 17,
    shard_docs: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The documents as the mix takes them: each row as often as its words were taken.

    A document of which only a part lies in the selected blocks is taken whole if
    half or more of it does; at most two documents of a shard are cut that way.
    Rows keep all columns of ``docs``. Rows that share id, source and text share what is
    taken of them all: each is taken equally often, and one of them for the remainder.
    """
    key = ["__id", "__source", "__digest"]
    d = placed(docs, weights, max_repeat, seed, shard_docs, id_col, text_col, source_col)
    copies = F.sum(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("int")
    d = d.groupBy(*[F.col(k[2:]).alias(k) for k in key]).agg(copies.alias("__copies"), F.count(F.lit(1)).cast("int").alias("__rows")).where("__copies > 0")
    taken = Scratch(docs.sparkSession).write(d)
    left = F.col("__copies") % F.col("__rows")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.md5(F.col(text_col)) == F.col("__digest"))
    times = lambda n: F.explode(F.sequence(F.lit(1), n))
    each = F.floor(F.col("__copies") / F.col("__rows")).cast("int")
    out = docs.join(taken.where("__copies >= __rows"), same).withColumn("__copy", times(each)).select(*docs.columns)
    rest = taken.where(left > 0)
    if rest.isEmpty():
        return out
    return out.unionByName(docs.join(rest, same).dropDuplicates(key).withColumn("__copy", times(left)).select(*docs.columns))
