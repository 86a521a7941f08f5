"""What every filter does alone, in every order and beside the others.

A document's failures are a bit mask. Masks are counted per part (source), once over all
rows; everything else follows from these counts. The subset-zeta transform turns the
counts into survivors: survivors(S) is the number of documents that fail no filter of S,
the sum of the counts of all masks within the complement of S. A step of an order is the
difference between two neighbouring subsets, survivors(before) less survivors(before and
this filter), for documents and for good and toxic labels alike.

The copy filter E looks at the whole table. Equal texts have equal digests (SHA-256) and
equal other failures, so that copies are counted and not joined back: rows add up per
digest, part and labels, and of each digest the rows with its smallest id pass. A group of
any size is a few rows for each task before it is shuffled.

Null texts are empty; null parts are the empty string, as are empty ones. Rows without an
id are no copies of others and make none; repeated rows with the smallest id of their
text all pass E. Of labels that repeat an id, one that says 1 counts. Empty tables give no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm._common import WORD

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: The filters of :func:`text_failures` and the copy filter, in the order of their bits.
FILTERS = "ABCDE"

#: Orders grow with the factorial of the number of filters.
MOST_FILTERS = 8

MEASURES = ("n", "good", "toxic")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: too short, repetitive, many capitals, odd signs."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, length = F.size(words), F.length(text)
    tests = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * (length - F.length(F.translate(text, CAPITALS, ""))) > 2 * length,
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((t.cast("int") * (1 << bit) for bit, t in enumerate(tests)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, part, digest, mask, good, toxic) of every document; the mask without copies."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias("good" if c == "quality" else c)
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("id")).agg(one("quality"), one("toxic"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_failures(text).alias("mask"),
    )
    none = F.lit(0)
    return rows.join(marked, "id", "left").select("id", "part", "digest", "mask", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))


def mask_counts(rows: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents of every mask, later copies with the copy bit.

    Rows of one id are added up first, so that the smallest id of a group carries the number
    of its rows; then a group is one row for each part and pair of labels.
    """
    key = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("id", *key).count()
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "count")))
    lost = F.sum(F.when(F.col("id").isNull(), F.col("count")).otherwise(0))
    groups = by_id.groupBy(*key).agg(F.sum("count").alias("n"), lost.alias("lost"), first.alias("first"))
    least = F.min("first.id").over(W.partitionBy("digest"))
    at_first = F.when(F.col("first.id") == least, F.col("first.count")).otherwise(0)
    split = groups.withColumn("kept", F.col("lost") + at_first).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask"), F.col("kept").alias("m")),
            F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("kept")).alias("m")),
        )),
    )
    m = F.col("m")
    return split.where("m > 0").groupBy("part", "mask").agg(F.sum(m).alias("n"), F.sum(m * F.col("good")).alias("good"), F.sum(m * F.col("toxic")).alias("toxic"))


def zeta(counts: np.ndarray) -> np.ndarray:
    """Sums over all subsets of each mask; the last axis has 2^k masks."""
    k = counts.shape[-1].bit_length() - 1
    cube = counts.reshape(*counts.shape[:-1], *[2] * k)
    for axis in range(counts.ndim - 1, cube.ndim):
        cube = np.cumsum(cube, axis=axis)
    return cube.reshape(counts.shape)


def part_audit(part: str, counts: np.ndarray, names: str) -> pd.DataFrame:
    """All orders and steps of one part; ``counts`` has the measures of each mask."""
    k = len(names)
    every = (1 << k) - 1
    survivors = zeta(counts)[:, every - np.arange(every + 1)]  # by the set of filters that all passed
    alone = survivors[0, 0] - survivors[0, [1 << b for b in range(k)]]
    only = [int(counts[0, 1 << b]) for b in range(k)]
    shapley = np.zeros(k, np.int64)
    for b in range(k):
        for before in range(every + 1):
            if not before >> b & 1:
                size = before.bit_count()
                shapley[b] += factorial(size) * factorial(k - 1 - size) * (survivors[0, before] - survivors[0, before | 1 << b])
    out = []
    for order in permutations(range(k)):
        before, name = 0, "".join(names[b] for b in order)
        for step, b in enumerate(order, 1):
            after = before | 1 << b
            removed, good, toxic = survivors[:, before] - survivors[:, after]
            out.append((part, name, step, int(survivors[0, after]), int(removed), int(alone[b] - removed), only[b], int(good), int(toxic), int(shapley[b])))
            before = after
    return pd.DataFrame(out, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every part, order and step from (part, mask, n, good, toxic); a part has 2^k masks at most."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; {MOST_FILTERS} are allowed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((len(MEASURES), 1 << len(names)), np.int64)
        for i, measure in enumerate(MEASURES):
            np.add.at(table[i], pdf["mask"].to_numpy(), pdf[measure].to_numpy())
        return part_audit(pdf["part"].iloc[0], table, names)

    return counts.groupBy("part").applyInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents."""
    return audit(mask_counts(failures(docs, labels), 1 << FILTERS.index("E")))
