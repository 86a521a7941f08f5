"""Sharding by a k-d tree over document metadata.

Equal texts form an atom, placed by the metadata of its first row and weighing the
bytes of all its rows. A node of the tree is split along its widest dimension (by the
weighted standard deviation, in parts of that of the whole table, so that dimensions of
different units compare) at the weighted median, until leaves reach the target bytes; as all cuts
are medians, that is a number of levels, and a number of shards says the same. Medians are found by
distributed histograms: every pass adds up weights in ``BINS`` bins, shared by all nodes of
a level, and the driver sees those sums only; the bin with the median is refined until it
is light or a single point, then ties are cut along a hash of the text. No node is
ever collected or sorted as a whole.

An atom that weighs more than a hundredth of a shard is heavy (at most a hundred per
shard exist). Heavy atoms go to the side of the cut on which they lie, and the cut
moves so that the rest fills up both sides; only an atom heavier than what a side has
room for is dealt out by row. So equal texts stay together as far as equal sizes
allow.

Null texts are texts of their own kind with size 1; null metadata counts as the
lowest value; repeated rows are rows of their own; ties lie on one side of a cut or are
cut along the hash; an empty table gives an empty result. Only id, text, source and
language are read, so that other columns can have any name; texts of any length count
in full.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, materialise

BINS = 1 << 15
#: A cut is good when it is off by no more than this part of its node.
EXACT = 2e-4
DIMENSIONS = ("length", "source", "lang", "hash")


@dataclass
class Cut:
    """Atoms with (coordinate, hash) below (at, tie) go left."""

    node: int
    dimension: str
    at: float
    tie: float


def unit(column: Column) -> Column:
    """A value's place in [0, 1) by hash, the same for equal values; null is 0."""
    return F.when(column.isNull(), F.lit(0.0)).otherwise(F.crc32(column.cast("string").cast("binary")) / F.lit(2.0**32))


def atoms_of(docs: DataFrame, source_col: str, lang_col: str) -> DataFrame:
    """(atom, weight, rows, one coordinate in [0, 1) for each dimension): one row for each distinct text."""
    per = docs.groupBy("atom").agg(
        F.sum("size").alias("weight"),
        F.min(F.struct("doc_id", F.col("size").alias("size"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"))).alias("first"),
    )
    length = F.least(F.log2(F.col("first.size").cast("double")) / 40, F.lit(1.0))
    spread = F.crc32(F.concat(F.lit("atom:").cast("binary"), F.col("atom"))) / F.lit(2.0**32)
    return per.select("atom", "weight", length.alias("length"), unit(F.col("first.source")).alias("source"), unit(F.col("first.lang")).alias("lang"), spread.alias("hash"))


def spreads(atoms: DataFrame) -> dict[int, dict[str, float]]:
    """For each node its weight, and the weighted standard deviation of its atoms in each dimension."""
    w = F.col("weight").cast("double")
    sums = [F.sum(w).alias("weight")]
    for d in DIMENSIONS[:3]:
        sums += [(F.sum(w * F.col(d)) / F.sum(w)).alias(f"m_{d}"), (F.sum(w * F.col(d) * F.col(d)) / F.sum(w)).alias(f"q_{d}")]
    rows = atoms.groupBy("node").agg(*sums).collect()
    return {r["node"]: {"weight": r["weight"]} | {d: math.sqrt(max(0.0, v)) if (v := r[f"q_{d}"] - r[f"m_{d}"] ** 2) > 1e-12 else 0.0 for d in DIMENSIONS[:3]} for r in rows}


def place(cuts: list[Cut], node: Column) -> Column:
    """The child of each atom's node after these cuts: 2 n or 2 n + 1."""
    side = F.lit(0)
    for c in cuts:
        left = (F.col(c.dimension) < c.at) | ((F.col(c.dimension) == c.at) & (F.col("hash") < c.tie))
        side = F.when(node == c.node, F.when(left, 0).otherwise(1)).otherwise(side)
    return node * 2 + side


def beyond(x: float) -> float:
    """The next number above ``x``."""
    return math.nextafter(x, math.inf)


def medians(light: DataFrame, targets: dict[int, tuple[str, float, float]]) -> list[Cut]:
    """For each node (dimension, weight wanted on the left, tolerance) the cut of its light atoms."""
    cuts: dict[int, Cut] = {}
    # node -> column searched, low, high, weight left of low, value of a tied coordinate
    open_: dict[int, list] = {n: [d, 0.0, 1.0 + 1e-9, 0.0, None] for n, (d, _, _) in targets.items()}
    bins_each = max(256, BINS // max(1, len(targets)))
    while open_:
        value, low, high, chosen = F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(False)
        for n, (d, lo, hi, _, tied) in open_.items():
            here = F.col("node") == n
            inside = (F.col(d) == tied) & (F.col("hash") >= lo) & (F.col("hash") < hi) if tied is not None else (F.col(d) >= lo) & (F.col(d) < hi)
            value = F.when(here, F.col("hash") if tied is not None else F.col(d)).otherwise(value)
            low, high = F.when(here, F.lit(lo)).otherwise(low), F.when(here, F.lit(hi)).otherwise(high)
            chosen = F.when(here, inside).otherwise(chosen)
        x = light.where(chosen).withColumn("v", value).withColumn("lo", low).withColumn("hi", high)
        bins = x.withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins_each), F.lit(bins_each - 1)))
        sums = bins.groupBy("node", "bin").agg(F.sum("weight").alias("w"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        by: dict[int, list] = {}
        for r in sums:
            by.setdefault(r["node"], []).append(r)
        for n in list(open_):
            d, lo, hi, left, tied = open_[n]
            want, tolerance = targets[n][1:]
            rows = sorted(by.get(n, []), key=lambda r: r["bin"])
            stop = None
            for r in rows:
                if left + r["w"] > want:
                    stop = r
                    break
                left += r["w"]
            if stop is None:  # all of them go left
                cuts[n] = Cut(n, d, tied, 2.0) if tied is not None else Cut(n, d, 2.0, 0.0)
                del open_[n]
                continue
            single = stop["a"] == stop["b"]
            if stop["w"] <= tolerance or (single and tied is not None):
                after = want - left > left + stop["w"] - want  # the nearer end of the bin
                edge = beyond(stop["b"]) if after else stop["a"]
                cuts[n] = Cut(n, d, tied, edge) if tied is not None else Cut(n, d, edge, 0.0)
                del open_[n]
            elif single:
                open_[n] = [d, 0.0, 1.0 + 1e-9, left, stop["a"]]
            else:
                open_[n] = [d, stop["a"], beyond(stop["b"]), left, tied]
    return list(cuts.values())


def shards_for(total: float, target_bytes: int) -> int:
    """The least power of two of leaves that hold ``target_bytes`` at most when all are equal."""
    if target_bytes < 1:
        raise ValueError("the target is a number of bytes")
    return 1 << max(0, math.ceil(total / target_bytes) - 1).bit_length()


def kd_shards(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", target_bytes: int | None = None) -> DataFrame:
    """The shard and the slot of every document.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, shard and slot (0, 1, 2, ...
    within each shard). Leaves are split until they hold ``target_bytes`` at most, or until
    there are ``shards`` of them, a power of two (8 if neither is given).
    """
    if shards is not None and target_bytes is not None:
        raise ValueError("give a number of shards or a target in bytes")
    shards = 8 if shards is None and target_bytes is None else shards
    if shards is not None and (shards < 1 or shards & (shards - 1)):
        raise ValueError("the number of shards must be a power of two; a target in bytes can be any number")
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1
    atom = F.when(F.col(text_col).isNull(), F.lit("null").cast("binary")).otherwise(F.unhex(F.sha2(F.col(text_col), 256)))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.cast("long").alias("size"), crc.alias("text_crc32"), atom.alias("atom"), F.col(source_col), F.col(lang_col))
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(rows)
    atoms = scratch.write(atoms_of(rows, source_col, lang_col))
    total = atoms.agg(F.sum("weight")).first()[0] or 0
    shards = shards or shards_for(total, target_bytes)
    heavy = {}
    sizes = {1: 0.0}
    if total:
        limit = total / shards / 100
        for r in atoms.where(F.col("weight") > limit).collect():  # at most 100 for each shard
            heavy[bytes(r["atom"])] = r.asDict() | {"node": 1}
        light = atoms.where(F.col("weight") <= limit).drop("atom").withColumn("node", F.lit(1))
        light_atoms = atoms.where(F.col("weight") <= limit).withColumn("node", F.lit(1))
    whole = spreads(atoms.withColumn("node", F.lit(1))).get(1, {}) if total else {}
    pieces: dict[bytes, dict[int, float]] = {a: {1: float(h["weight"])} for a, h in heavy.items()}
    level = 1
    while total and level < shards:
        known = spreads(light)
        targets, sides = {}, {}
        for n in range(level, 2 * level):
            r = known.get(n)
            light_w = r["weight"] if r else 0.0
            mine = sorted(((p[n], a) for a, p in pieces.items() if p.get(n)), reverse=True)
            half = (light_w + sum(w for w, _ in mine)) / 2
            # the widest dimension; on a tie the first one
            width = {d: r[d] / whole[d] if r and whole[d] > 0 else 0.0 for d in DIMENSIONS[:3]}
            d = max(DIMENSIONS[:3], key=width.get)
            d = d if width[d] > 1e-9 else "hash"
            targets[n] = [d, half, light_w, mine]
        # where a node has heavy atoms, a first cut tells on which side each of them lies
        first = medians(light, {n: (t[0], min(t[1], t[2]), max(t[2], 1.0) * 0.02) for n, t in targets.items() if t[3]})
        wanted = {n: (t[0], t[1], max(EXACT * t[1], 1.0)) for n, t in targets.items() if not t[3]}
        for c in first:
            d, half, light_w, mine = targets[c.node]
            used = [0.0, 0.0]
            for w, a in mine:
                h = heavy[a]
                side = 0 if h[d] < c.at or h[d] == c.at and h["hash"] < c.tie else 1
                if used[side] + w > half:
                    side = 1 - side
                p = pieces[a]
                del p[c.node]
                if used[side] + w <= half + EXACT * half:
                    p[2 * c.node + side] = w
                    used[side] += w
                else:  # heavier than either side has room for: by row
                    room = half - used[0]
                    p[2 * c.node], p[2 * c.node + 1] = room, w - room
                    used[0] += room
                    used[1] += w - room
            wanted[c.node] = (d, max(0.0, half - used[0]), max(EXACT * half, 1.0))
        cuts = medians(light, wanted)
        light = light.withColumn("node", place(cuts, F.col("node")))
        light_atoms = light_atoms.withColumn("node", place(cuts, F.col("node")))
        level *= 2
    if not total:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    spark = docs.sparkSession
    # Heavy atoms, a hundred for each shard at most, go their own way: no atom of the join below is a large group.
    few = F.broadcast(spark.createDataFrame([(a,) for a in pieces], "atom binary"))
    placed = rows.join(few, "atom", "left_anti").join(light_atoms.select("atom", (F.col("node") - shards).cast("int").alias("shard")), "atom")
    if pieces:
        dealt = []
        for a, p in pieces.items():
            whole, below = sum(p.values()), 0.0
            parts = [(n, w) for n, w in sorted(p.items()) if w > 0]
            for i, (n, w) in enumerate(parts):
                dealt.append((a, n - shards, below / whole, 2.0 if i + 1 == len(parts) else (below + w) / whole))
                below += w
        table = F.broadcast(spark.createDataFrame(dealt, "atom binary, to int, low double, high double"))
        h = rows.join(table.select("atom").distinct(), "atom", "left_semi")
        # rows of one atom are all of one size: their numbers deal them out
        h = numbered(h, "atom", rows.count())
        last = h.groupBy("atom").agg(F.max("number").alias("last"))
        h = h.join(last, "atom").withColumn("u", (F.col("number") + 0.5) / (F.col("last") + 1))
        h = h.join(table, "atom").where("u >= low and u < high").select(*rows.columns, F.col("to").alias("shard"))
        placed = placed.select(*rows.columns, "shard").unionByName(h.select(*rows.columns, "shard"))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "shard"))
    scratch.drop()
    return with_slots(placed)


def numbered(rows: DataFrame, key: str, total: int, bucket_rows: int = 20_000) -> DataFrame:
    """Add ``number``: 0, 1, 2, ... within each key, by hash of the id.

    Rows fall into buckets by hash of the id; the buckets' counts give each its first
    number, and rows are numbered inside their bucket only.
    """
    buckets = max(1, -(-total // bucket_rows))
    b = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    per = b.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    offset = per.withColumn("begin", F.sum("n").over(W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    inner = F.row_number().over(W.partitionBy(key, "bucket").orderBy("doc_id", "text_crc32"))
    out = b.join(offset.drop("n"), [key, "bucket"])
    return out.withColumn("number", (F.coalesce("begin", F.lit(0)) + inner - 1).cast("long")).select(*rows.columns, "number")


def with_slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard without gaps."""
    return numbered(placed, "shard", placed.count()).withColumnRenamed("number", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
