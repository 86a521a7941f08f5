"""Near-duplicate detection: a multi-index Hamming join over b-bit MinHash signatures.

1. Every text becomes its set of distinct word shingles (64-bit hashes), the digest
   of that set and a signature of ``symbols`` b-bit MinHash values. Texts with the
   same set are one class, whose smallest id stands for it.
2. Two sets of similarity s differ in a signature symbol with probability 1 - s, so
   a pair at the threshold differs in more than ``radius`` symbols with probability
   below ``miss`` only (binomial tail). ``radius`` follows from threshold and miss.
3. Pigeonhole: the signature is cut into m chunks with radius < 2 m, so that a pair
   within the radius has a chunk with one error at most. Enumerating that error,
   every chunk gives one key for each of its symbols, with that symbol masked: all
   pairs within the radius share a key.
4. Keys are not expanded into pairs. Every key names its most popular member (the one
   that shares most keys with most others) as its centre; a class is compared on the
   full sets with the most popular of the centres with which it shares many keys: its
   family. Links merge components; classes that did not link try a second centre.
5. What is still apart may link past the centre. Relative to a centre c, a member a is
   the difference set D_a of a and c, and |a xor b| = |D_a| + |D_b| - 2 |D_a and D_b|.
   So members that can link must have a certain number of differences in common, and an
   equi join on prefixes of the rarest differences (prefix filter with sizes and positions)
   finds every such pair; see :func:`within_groups`. The many texts around one centre thus
   never meet in pairs, at whatever similarity they lie.
6. Classes that share a key but not a family: a key with at most ``pairs_up_to`` such
   members is joined in pairs whose signatures lie within the radius; the members of a larger
   one are all compared with that key's centre and go through step 5 as a group.

All pairs found are decided on the full sets, so that no link within the radius is lost
between components.

Texts with fewer words than a shingle has are one shingle as a whole; texts without
words, and nulls, have an empty set and link with nothing. Every row gives one row, rows
with equal ids too, each for its own text; links join texts, never equal ids as such. A
null id is no smallest id: a group of null ids only has component null. Empty tables give
empty results. Only id and text are read, so that other columns can have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, WordIds, ascii_words, map_batches, mix64

#: Signature symbols of 16 bits in one long (the fourth stays 0, so that sums do not overflow),
#: the lower 15 bits of each, and the highest bit of each.
PER_LONG, LOW_BITS, HIGH_BITS = 3, 0x7FFF7FFF7FFF, 0x800080008000
#: Tells the shingles that a set lacks from those that it has more than its centre.
LACKED = np.uint64(0x5851F42D4C957F2D)


def radius_for(threshold: float, symbols: int, miss: float) -> int:
    """Smallest r with P(Binomial(symbols, 1 - threshold) > r) <= miss."""
    p, tail = 1 - threshold, 1.0
    for r in range(symbols + 1):
        tail -= math.comb(symbols, r) * p**r * (1 - p) ** (symbols - r)
        if tail <= miss:
            return r
    return symbols


def chunks_for(symbols: int, radius: int) -> list[list[int]]:
    """Symbol numbers by chunk: as few chunks as leave one error at most in one of them."""
    m = min(symbols, radius // 2 + 1)
    return [c.tolist() for c in np.array_split(np.arange(symbols), m)]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word ids."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, 0x9E3779B97F4A7C15 + size, np.uint64)
    for i in range(size):
        h = mix64(h ^ words[i : i + n])
    return np.unique(h)


class Signer:
    """Shingle sets and signatures of texts."""

    def __init__(self, size: int, symbols: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.ids = size, WordIds()
        self.a = rng.integers(1, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, symbols, dtype=np.uint64)

    def set_of(self, text: str | None) -> np.ndarray:
        return shingles(self.ids.of(ascii_words(text)), self.size)

    def minima(self, s: np.ndarray) -> np.ndarray:
        """The smallest value of each hash function over the set."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max)
        for i in range(0, len(s), 2048):
            block = s[i : i + 2048, None] * self.a
            block += self.b
            np.minimum(least, block.min(axis=0), out=least)
        return least

    def signature(self, s: np.ndarray) -> np.ndarray:
        """The top 16 bits of each minimum, mixed, three of them in a long."""
        symbols = np.zeros(-(-len(self.a) // PER_LONG) * PER_LONG, np.uint16)
        symbols[: len(self.a)] = mix64(self.minima(s)) >> np.uint64(48)
        out = np.zeros((len(symbols) // PER_LONG, 4), np.uint16)
        out[:, :PER_LONG] = symbols.reshape(-1, PER_LONG)
        return out.view(np.int64).reshape(-1)


def hamming(x: Column, y: Column, symbols: int) -> Column:
    """Number of differing 16-bit symbols of two signatures.

    A symbol of the exclusive or is not 0 if its highest bit is set, or becomes so when
    the greatest 15-bit number is added to the rest of it.
    """
    total = F.lit(0)
    for i in range(-(-symbols // PER_LONG)):
        z = x[i].bitwiseXOR(y[i])
        total = total + F.bit_count((z.bitwiseAND(F.lit(LOW_BITS)) + F.lit(LOW_BITS)).bitwiseOR(z).bitwiseAND(F.lit(HIGH_BITS)))
    return total


def sketch(docs: DataFrame, size: int, symbols: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, signature) of every document; an empty set has null digest."""

    def make():
        signer = Signer(size, symbols, seed)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            count, digest, signature = [], [], []
            for text in batch.column(2).to_pylist():
                s = signer.set_of(text)
                count.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signature.append(signer.signature(s) if len(s) else None)
            return {"doc_id": batch.column(0), "text_hash": batch.column(1), "n_shingles": pa.array(count, pa.int64()), "digest": pa.array(digest, pa.binary()), "signature": pa.array(signature, pa.list_(pa.int64()))}

        return work

    return map_batches(keyed(docs, id_col, text_col), make, "doc_id long, text_hash long, n_shingles long, digest binary, signature array<long>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, text): what tells rows with equal ids apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def masked_keys(classes: DataFrame, symbols: int, radius: int) -> DataFrame:
    """(key, node): one key for every chunk and masked symbol."""
    chunks = chunks_for(symbols, radius)

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            node, n = batch.column(0), batch.num_rows
            sig = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint16)
            sig = sig.reshape(n, -1, 4)[:, :, :PER_LONG].reshape(n, -1).astype(np.uint64)
            keys = []
            for number, chunk in enumerate(chunks):
                for gap in chunk if len(chunk) > 1 else [None]:
                    h = np.full(n, 1 + number * 1000 + (0 if gap is None else gap + 1), np.uint64)
                    for i in chunk:
                        if i != gap:
                            h = mix64(h ^ (sig[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                    keys.append(h)
            key = np.stack(keys, axis=1).reshape(-1).view(np.int64)
            at = np.repeat(np.arange(n), len(keys))
            return {"key": pa.array(key), "node": node.take(pa.array(at))}

        return work

    return map_batches(classes.select("node", "signature"), make, "key long, node long")


def meet(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the input, always by sort and merge.

    Spark takes what an explode or a Python step gives for no larger than what went into it, and
    a compressed file for as large as its rows: left to itself it broadcasts such a table through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def may_link(n_a: Column, n_b: Column, sig_a: Column, sig_b: Column, symbols: int, radius: int, percent: int) -> Column:
    """Whether two sets are of fitting sizes and their signatures within the radius."""
    return (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent) & (hamming(sig_a, sig_b, symbols) <= radius)


def compared(edges: DataFrame, texts: DataFrame, size: int, percent: int, differences: bool = False) -> DataFrame:
    """(a, b, n_a, n_b, same) of the pairs (a, b), from their full sets.

    ``same``: 100 * |intersection| >= percent * |union|. With ``differences`` also the
    hashes of what one of the sets has and the other one has not.
    """
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = meet(meet(edges.select("a", "b"), left, "a"), right, "b").select("a", "b", "text_a", "text_b")

    def make():
        signer, last = Signer(size, 1, 0), {}

        def set_of(node: int, text: pa.StringScalar) -> np.ndarray:
            if node not in last:
                if len(last) >= 64:
                    last.clear()
                last[node] = signer.set_of(text.as_py())
            return last[node]

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            n_a, n_b, same, differ = [], [], [], []
            for x, y, tx, ty in zip(a, b, batch.column(2), batch.column(3), strict=True):
                p, q = set_of(x, tx), set_of(y, ty)
                k = len(np.intersect1d(p, q, assume_unique=True))
                n_a.append(len(p))
                n_b.append(len(q))
                same.append(100 * k >= percent * (len(p) + len(q) - k))
                if differences:
                    own, lacked = np.setdiff1d(p, q, assume_unique=True), np.setdiff1d(q, p, assume_unique=True)
                    differ.append(np.concatenate([own, mix64(lacked ^ LACKED)]).view(np.int64))
            out = {"a": batch.column(0), "b": batch.column(1), "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()), "same": pa.array(same, pa.bool_())}
            return out | ({"differ": pa.array(differ, pa.list_(pa.int64()))} if differences else {})

        return work

    return map_batches(both, make, "a long, b long, n_a long, n_b long, same boolean" + (", differ array<long>" if differences else ""))


def within_groups(compared_to: DataFrame, label: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components that can link, of members of one group (rows with equal ``b``, the centre).

    With d = |D|, n = |set| and p = ``percent``, a and b link only if they have ``need`` =
    ((100 + p)(d_a + d_b) - (100 - p)(n_a + n_b)) / (2 (100 + p)) differences in common,
    which is above 0 for every pair that its centre does not join. Differences of one
    component only are of no use; the others are ordered by how many members have them,
    rarest first. Of two sets with ``need`` elements in common, the first common one has
    at least need - 1 more behind it in either: so a set is entered with a prefix only,
    a shorter one where its partner has as many differences or more.

    Members and prefixes are written, as each is read twice: one plan of all steps holds
    every step four times, and the driver keeps such a plan anew for every stage that ends.
    """
    m = compared_to.select(F.col("b").alias("centre"), F.col("a").alias("node"), F.col("n_a").alias("n"), "differ")
    m = meet(m, label, "node")
    several = m.groupBy("centre").agg((F.min("component") < F.max("component")).alias("split")).where("split").select("centre")
    m = scratch.write(m.join(several, "centre", "left_semi").withColumn("d", F.size("differ").cast("long")))
    x = m.select("centre", "node", "component", "n", "d", F.explode("differ").alias("difference"))
    shared = x.groupBy("centre", "difference").agg((F.min("component") < F.max("component")).alias("split"), F.count(F.lit(1)).alias("often"))
    x = meet(x, shared.where("split").drop("split"), ["centre", "difference"])
    mine = Window.partitionBy("centre", "node")
    x = x.withColumn("place", F.row_number().over(mine.orderBy("often", "difference"))).withColumn("last", F.count(F.lit(1)).over(mine))
    p = F.lit(percent)
    as_larger = F.greatest(F.lit(1), F.ceil(F.col("d") - F.col("n") * (100 - p) / p))
    as_smaller = F.greatest(F.lit(1), F.ceil(F.col("d") - F.col("n") * (100 - p) / (2 * p)))
    x = x.where(F.col("place") <= F.col("last") - as_larger + 1).withColumn("probes", F.col("place") <= F.col("last") - as_smaller + 1)
    x = scratch.write(x.drop("often"))
    a, b = x.where("probes").alias("x"), x.alias("y")
    need = F.ceil(((100 + p) * (F.col("x.d") + F.col("y.d")) - (100 - p) * (F.col("x.n") + F.col("y.n"))) / (2 * (100 + p)))
    in_order = (F.col("x.d") < F.col("y.d")) | ((F.col("x.d") == F.col("y.d")) & (F.col("x.node") < F.col("y.node")))
    sizes = (F.col("x.n") * 100 >= F.col("y.n") * p) & (F.col("y.n") * 100 >= F.col("x.n") * p)
    left = F.least(F.col("x.last") - F.col("x.place"), F.col("y.last") - F.col("y.place")) + 1
    same = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.difference") == F.col("y.difference"))
    pairs = meet(a, b, same & (F.col("x.component") != F.col("y.component")) & in_order & sizes & (left >= need))
    pairs = scratch.write(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    scratch.drop(m, x)
    return pairs


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes of the edges.

    Large-star and small-star steps alternate until nothing changes. Both work with
    one aggregate and one join on the node, so that a hub is no single group of rows
    in memory.
    """
    pairs = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = fingerprint(pairs)
    while mark[0]:
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        old, pairs = pairs, scratch.write(small.where("u <> v").distinct())
        scratch.drop(old)
        before, mark = mark, fingerprint(pairs)
        if mark == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def fingerprint(pairs: DataFrame) -> tuple:
    """Number of pairs and a sum over their hashes, to see whether a step changed them."""
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class Labels:
    """Component of every class, merged as links are found."""

    def __init__(self, node: DataFrame, scratch: Scratch) -> None:
        self.scratch, self.table = scratch, scratch.write(node.select("node", F.col("node").alias("component")))

    def merge(self, found: DataFrame) -> None:
        """The new links (a, b) join components, which are again named after their smallest node."""
        a, b = self.table.toDF("a", "ca"), self.table.toDF("b", "cb")
        between = meet(meet(found.select("a", "b"), a, "a"), b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        named = components(between, self.scratch).toDF("component", "root")
        old = self.table
        self.table = self.scratch.write(meet(old, named, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        self.scratch.drop(old)


def classes_of(docs: DataFrame, size: int, percent: int, symbols: int, miss: float, seed: int, pairs_up_to: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of every row."""
    scratch = Scratch(docs.sparkSession)
    radius = radius_for(percent / 100, symbols, miss)
    rows = scratch.write(sketch(docs, size, symbols, seed, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = rows.where("digest is not null").groupBy("digest").agg(first, F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc_id", "first.text_hash", "signature", "n")
    classes = scratch.write(classes)
    node = classes.select("node", "signature", "n")
    keys = masked_keys(classes, symbols, radius)
    # Keys of one class only are of no use: the rest is small.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = scratch.write(meet(keys, shared, "key"))
    wanted = meet(classes, members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = meet(keyed(docs, id_col, text_col), wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    texts = scratch.write(texts.select("node", "text").dropDuplicates(["node"]))
    labels = Labels(node, scratch)

    # A member that shares many keys with many others lies in the middle of a family.
    popular = scratch.write(members.groupBy("node").agg(F.sum("members").alias("popularity")))
    draw = F.struct(F.col("popularity"), F.xxhash64("node").alias("draw"), F.col("node").alias("centre"))
    centre = scratch.write(meet(members, popular, "node").groupBy("key").agg(F.max(draw).alias("c")).select("key", "c.centre", F.col("c.popularity").alias("p")))
    star = meet(members, centre, "key").where("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("keys"), F.first("p").alias("p"))
    # At most as many centres as a class has keys.
    star = star.groupBy("node").agg(F.collect_list(F.struct("p", "centre", "keys")).alias("centres"), F.max("keys").alias("most"))
    many = F.filter("centres", lambda c: c["keys"] * 2 >= F.col("most"))
    star = scratch.write(star.select(F.col("node").alias("a"), F.array_max(many)["centre"].alias("b"), "centres"))
    to_centre = scratch.write(compared(star, texts, size, percent, differences=True))
    labels.merge(to_centre.where("same"))
    # Who did not link tries the centre of another component with which it shares most keys.
    other = meet(to_centre.where("not same").select("a"), star, "a").select("a", F.col("b").alias("family"), F.explode("centres").alias("c")).where("c.centre <> family")
    other = other.select("a", F.col("c.keys").alias("keys"), F.col("c.centre").alias("b"))
    other = meet(meet(other, labels.table.toDF("a", "ca"), "a"), labels.table.toDF("b", "cb"), "b")
    other = other.where("ca <> cb").groupBy("a").agg(F.max(F.struct("keys", "b")).alias("m")).select("a", "m.b")
    labels.merge(scratch.write(compared(other, texts, size, percent)).where("same"))

    # Keys whose members are neither all of one component nor all of one family.
    family = star.select(F.col("a").alias("node"), F.col("b").alias("family"))
    family = family.union(family.select("family", "family")).groupBy("node").agg(F.min("family").alias("family"))
    tagged = meet(meet(members, labels.table, "node"), family, "node", "left")
    mixed = tagged.groupBy("key").agg((F.min("component") < F.max("component")).alias("split"), (F.min("family") < F.max("family")).alias("families"), (F.count("family") < F.count(F.lit(1))).alias("alone"))
    mixed = mixed.where("split and (families or alone)").select("key")
    rest = scratch.write(meet(tagged, mixed, "key", "left_semi"))
    large = meet(rest.where(F.col("members") > pairs_up_to).select("key", F.col("node").alias("a")), centre, "key")
    large = meet(large.select("a", F.col("centre").alias("b")).where("a <> b").distinct(), star, ["a", "b"], "left_anti")
    to_key = scratch.write(compared(large, texts, size, percent, differences=True))
    labels.merge(to_key.where("same"))

    inside = within_groups(to_centre.union(to_key), labels.table, percent, scratch)
    small = meet(meet(rest.where(F.col("members") <= pairs_up_to).drop("component"), labels.table, "node"), node, "node")
    x, y = small.alias("x"), small.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & ~F.coalesce(F.col("x.family") == F.col("y.family"), F.lit(False))
    close = may_link(F.col("x.n"), F.col("y.n"), F.col("x.signature"), F.col("y.signature"), symbols, radius, percent)
    across = meet(x, y, apart & close).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = scratch.write(inside.union(across).distinct())
    labels.merge(scratch.write(compared(pairs, texts, size, percent)).where("same"))

    named = meet(classes, labels.table, "node")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = meet(named, smallest, "component").select("digest", "component_id")
    out = meet(rows.drop("signature"), named, "digest", "left").drop("digest")
    own = F.col("n_shingles") == 0
    out = Scratch(docs.sparkSession).write(out.withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("component_id"))))
    scratch.drop()
    return out


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    symbols: int = 48,
    miss: float = 5e-4,
    seed: int = 5,
    pairs_up_to: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Component of every document under the links of similarity ``percent`` or more.

    Returns doc_id, n_shingles, component_id (smallest id reachable) and kept.
    """
    rows = classes_of(docs, size, percent, symbols, miss, seed, pairs_up_to, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, symbols: int = 48, miss: float = 5e-4, seed: int = 5, pairs_up_to: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id stands for their component, with all columns.

    Rows that repeat this id with a text of the component all stay, as they are one document.
    """
    rows = classes_of(docs, size, percent, symbols, miss, seed, pairs_up_to, id_col, text_col)
    gone = rows.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    here = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__hash"))
    return docs.join(gone, here, "left_anti")
