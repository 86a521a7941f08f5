"""Substring de-duplication by content-defined chunks with a gear rolling hash.

A gear hash rolls over the words of a text: shifted on by each word, it holds the last few
(``MEMORY``) only. A chunk ends after a word whose hash is the smallest of some ``width``
hashes in a row, so that chunks have 1 to ``width`` words and whether a word ends one
depends on the words near it alone: an insertion moves the ends near itself and no others.
A chunk is known by the digest of its bytes together with the words around it that decide
where it begins and ends. Of every passage of ``min_words`` whole words, the outer words
left aside (they may be part of longer ones in the other text), at least one such stretch
lies inside, so that equal passages always share a chunk, whatever stands around them.
Chunks are compared by digest; the first place of a digest (smallest document, then
offset) is its origin.

Chunks of one document that repeat the same origin document at the same distance are
joined to runs; a run is compared byte by byte with the origin's text and grown to
both sides as far as the texts agree. Runs of ``min_words`` whole words or more are
returned. Repeats within one document are not counted.

The origin of a chunk need not hold the whole passage. Windows of ``min_words`` words
that no returned range covers, though all their chunks stand in earlier documents,
are therefore looked up as wholes among all documents that hold such a chunk, and linked
to the first one that holds the window. So every word of a window of ``min_words`` whole
words that an earlier document holds as whole words lies in a returned range.

Digests are added up before they are shuffled, and joined back as (digest, place)
rows, so that a passage found everywhere is no group in one task. Only documents with
repeats move their texts, and the pairs of a common origin are dealt out by salt, with its
text sent to each part.

Null and empty texts have no repeats; rows that share an id count as one document;
of several origins at the same distance the first one is taken; empty tables give empty
results; only id and text are read, so that other columns can have any name; texts of any
length are read whole. ``min_words`` is 4 or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, WordIds, map_batches, mix64

SPACES = b" \t\n\r\x0b\x0c"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
ONE_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words that the gear hash holds.
MEMORY = 4
#: Pairs of an origin that one part of a salted join has.
PAIRS = 1_000


class Words:
    """Places of a text's words, and digests of all windows of so many words."""

    def __init__(self, raw: bytes, ids: WordIds) -> None:
        data = np.frombuffer(raw, np.uint8)
        inside = np.concatenate([[False], ~IS_SPACE[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        symbols = np.zeros(2 * len(self.starts), np.uint64)  # word, space, word, ...
        self.ids = symbols[::2] = ids.of(raw.split())
        left, right = self.ends[:-1], self.starts[1:]
        symbols[1:-1:2] = ONE_BYTE[data[left]]
        for i in np.flatnonzero(right - left > 1).tolist():
            symbols[2 * i + 1] = ids[raw[left[i] : right[i]]]
        powers = np.cumprod(np.full(len(symbols), BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * powers)])

    def spans(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Digests of the words first to last (last excluded), with what stands between them."""
        shift = np.cumprod(np.full(len(self.starts), pow(INVERSE, 2, 1 << 64), np.uint64))
        return mix64((self.sums[2 * last - 1] - self.sums[2 * first]) * shift[first])

    def digests(self, n: int) -> np.ndarray:
        """Digest of the ``n`` words from every word on."""
        first = np.arange(max(0, len(self.starts) - n + 1))
        return self.spans(first, first + n)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` values in a row, by doubling."""
    have = 1
    while 2 * have <= width:
        x, have = op(x[:-have], x[have:]), 2 * have
    rest = width - have
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def reach(min_words: int) -> tuple[int, int, int]:
    """(words inside a passage, words that the gear hash holds, hashes of which the smallest ends a chunk).

    All hashes of ``width`` in a row around an end must lie inside for it to be certain;
    what is left then has room for two ends.
    """
    if min_words < 4:
        raise ValueError("passages have 4 words or more")
    inside = min_words - 2
    memory = MEMORY if inside >= 4 * MEMORY else 1
    return inside, memory, max(1, (inside - memory + 3) // 4)


def winnow(grams: np.ndarray, keep_of: int) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest of every ``keep_of`` grams in a row, places of all grams that are one)."""
    if len(grams) < keep_of:
        return grams[:0], np.zeros(0, np.int64)
    lowest = sliding(grams, keep_of, np.minimum)
    edge = np.zeros(keep_of - 1, np.uint64)
    return lowest, np.flatnonzero(sliding(np.concatenate([edge, lowest, edge]), keep_of, np.maximum) == grams)


def gear(ids: np.ndarray, memory: int) -> np.ndarray:
    """The rolling hash at every word from the first that has ``memory`` words: older words are shifted out."""
    g = mix64(ids)
    step = np.uint64(64 // memory)
    h = g.copy()
    for k in range(1, memory):
        h[k:] += g[:-k] << (step * np.uint64(k)) if len(g) > k else g[:0]
    return h[memory - 1 :]


def chunks(words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first word, word after the last) of every chunk with the words that decide where it begins and ends."""
    _, memory, width = reach(min_words)
    _, at = winnow(gear(words.ids, memory), width)
    ends = at + memory - 1
    first, last = ends[:-1] - (memory - 1) - (width - 1), ends[1:] + width
    fits = (first >= 0) & (last <= len(words.ids))
    first, last = first[fits], last[fits]
    return words.spans(first, last), first, last


def chunk_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(digest, doc_id, begin, end) of all chunks."""

    def make():
        known = WordIds()

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            ids, digest, begin, end, n = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                words = Words(text.encode("utf-8", "surrogatepass") if text else b"", known)
                found, first, last = chunks(words, min_words)
                digest.append(found)
                begin.append(words.starts[first])
                end.append(words.ends[last - 1])
                n.append(len(found))
            return {
                "digest": pa.array(np.concatenate(digest).view(np.int64)),
                "doc_id": ids.take(pa.array(np.repeat(np.arange(len(n)), n))),
                "begin": pa.array(np.concatenate(begin).astype(np.int32)),
                "end": pa.array(np.concatenate(end).astype(np.int32)),
            }

        return work

    return map_batches(docs, make, "digest long, doc_id long, begin int, end int")


def window_rows(texts: DataFrame, min_words: int) -> DataFrame:
    """(chunk, digest, doc_id, begin, end) of the windows of (doc_id, text, chunks, ranges) whose chunks
    are all among ``chunks`` and that no range covers; without ranges (null), of all whose first one is."""
    inside, _, _ = reach(min_words)
    inner = min_words - inside + 1

    def make():
        known = WordIds()

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            out = {"chunk": [], "digest": [], "doc_id": [], "begin": [], "end": []}
            for doc, text, held, ranges in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = Words(text.as_py().encode("utf-8", "surrogatepass"), known)
                digests = words.digests(min_words)
                if not len(digests):
                    continue
                found, first, _ = chunks(words, min_words)
                # The first chunk that begins at a word or later lies within the ``inside`` words from there.
                leading = found[np.searchsorted(first, np.arange(len(words.ids) - inside + 1))]
                wanted = np.isin(leading, np.array(held.as_py(), np.int64).view(np.uint64))
                ranges = ranges.as_py()
                ok = wanted[: len(digests)] if ranges is None else sliding(wanted, inner, np.logical_and)[: len(digests)].copy()
                for r in ranges or []:
                    low = np.searchsorted(words.starts, r["begin"], "left")
                    ok[low : max(low, np.searchsorted(words.ends, r["end"], "right") - min_words + 1)] = False
                at = np.flatnonzero(ok)
                out["chunk"].append(leading[at].view(np.int64))
                out["digest"].append(digests[at].view(np.int64))
                out["doc_id"].append(np.full(len(at), doc.as_py(), np.int64))
                out["begin"].append(words.starts[at])
                out["end"].append(words.ends[at + min_words - 1])
            return {n: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32 if n in ("begin", "end") else np.int64)) for n, x in out.items()}

        return work

    return map_batches(texts, make, "chunk long, digest long, doc_id long, begin int, end int")


def grow(text: bytes, origin: bytes, begin: int, end: int, at: int) -> tuple[int, int] | None:
    """The longest equal stretch around text[begin:end] == origin[at:...]; None if that is not equal."""
    if text[begin:end] != origin[at : at + end - begin]:
        return None
    left = common(text[:begin][::-1], origin[:at][::-1])
    right = common(text[end:], origin[at + end - begin :])
    return begin - left, end + right


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else []
    return int(differ[0]) if len(differ) else n


def whole_words(text: bytes, begin: int, end: int) -> tuple[int, int, int]:
    """The stretch cut to whole words, and their number."""
    space = SPACES
    while begin < end and begin > 0 and text[begin - 1 : begin] not in space and text[begin : begin + 1] not in space or begin < end and text[begin : begin + 1] in space:
        begin += 1
    if end < len(text) and text[end : end + 1] not in space:
        while end > begin and text[end - 1 : end] not in space:
            end -= 1
    while end > begin and text[end - 1 : end] in space:
        end -= 1
    return begin, end, len(text[begin:end].split())


def grown_runs(d: DataFrame, hits: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """What the hits (doc_id, origin_id, begin, end, shift) grow to, compared byte by byte."""
    # Runs: hits of one pair at one distance that overlap or touch.
    line = W.partitionBy("doc_id", "origin_id", "shift").orderBy("begin", "end")
    upto = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    runs = hits.withColumn("new", (upto.isNull() | (F.col("begin") > upto)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(line.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = runs.groupBy("doc_id", "origin_id", "shift", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    # All runs of a pair travel together with its two texts.
    pairs = runs.groupBy("doc_id", "origin_id").agg(F.collect_list(F.struct("begin", "end", "shift")).alias("runs"))
    pairs = scratch.write(pairs)
    mine = d.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    theirs = d.join(pairs.select(F.col("origin_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("origin_id"), F.col("text").alias("origin"))
    # A common origin has many pairs: they go to parts by salt, and its text to each part.
    parts = pairs.groupBy("origin_id").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts")).where("parts > 1")
    salted = pairs.join(parts, "origin_id", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0)).cast("int")).drop("parts")
    theirs = theirs.join(parts, "origin_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = salted.join(mine, "doc_id").join(theirs, ["origin_id", "salt"]).select("doc_id", "origin_id", "runs", "text", "origin")

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            rows = []
            for doc, origin, found, text, other in zip(*(batch.column(i) for i in range(5)), strict=True):
                a, b = text.as_py().encode("utf-8", "surrogatepass"), other.as_py().encode("utf-8", "surrogatepass")
                seen: dict[tuple[int, int], int] = {}
                for r in found.as_py():
                    grown = grow(a, b, r["begin"], r["end"], r["begin"] - r["shift"])
                    if grown:
                        begin, end, n = whole_words(a, *grown)
                        if n >= min_words and (begin, end) not in seen:
                            seen[begin, end] = n
                            rows.append((doc.as_py(), origin.as_py(), begin, end, begin - r["shift"], n))
            names = ("doc_id", "origin_id", "begin", "end", "origin_begin", "n_words")
            return {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(names)}

        return work

    return map_batches(both, make, "doc_id long, origin_id long, begin long, end long, origin_begin long, n_words long").distinct()


def with_origins(rows: DataFrame, holders: DataFrame) -> DataFrame:
    """``rows`` with the first place of their digest in ``holders``, where that is in an earlier document."""
    first = holders.groupBy("digest").agg(F.min(F.struct("doc_id", "begin")).alias("o"), F.max("doc_id").alias("last"))
    first = first.where("last > o.doc_id").select("digest", F.col("o.doc_id").alias("origin_id"), F.col("o.begin").alias("origin_begin"))
    hits = rows.join(first, "digest").where("doc_id > origin_id")
    return hits.select("digest", "doc_id", "origin_id", "begin", "end", (F.col("begin") - F.col("origin_begin")).alias("shift")).distinct()


def repeats(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, origin_id, begin, end, origin_begin, n_words): byte ranges that an earlier document holds too."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    every = scratch.write(chunk_rows(d, min_words))  # read twice, made once
    hits = scratch.write(with_origins(every, every))
    scratch.drop(every)
    found = scratch.write(grown_runs(d, hits.drop("digest"), min_words, scratch))
    # Windows that the origins of their chunks do not hold as a whole, though each chunk has one.
    ranges = found.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))
    later = hits.groupBy("doc_id").agg(F.collect_set("digest").alias("chunks")).join(ranges, "doc_id", "left")
    asked = d.join(later, "doc_id").select("doc_id", "text", "chunks", F.coalesce("ranges", F.array().cast("array<struct<begin:bigint,end:bigint>>")).alias("ranges"))
    asked = scratch.write(window_rows(asked, min_words))
    # Everyone with such a chunk, the chunk's origin included, is asked for the windows.
    held = hits.join(asked.select(F.col("chunk").alias("digest")).distinct(), "digest")
    held = held.select("doc_id", "digest").union(held.select("origin_id", "digest")).groupBy("doc_id").agg(F.collect_set("digest").alias("chunks"))
    held = d.join(held, "doc_id").select("doc_id", "text", "chunks", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("ranges"))
    held = window_rows(held, min_words).join(asked.select("digest").distinct(), "digest", "left_semi")
    more = with_origins(asked.drop("chunk"), held)
    out = Scratch(docs.sparkSession).write(found.union(grown_runs(d, more.drop("digest"), min_words, scratch)).distinct())
    scratch.drop()
    return out


def remove_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the byte ranges of ``found`` (from :func:`repeats`); all columns stay."""
    ranges = found.groupBy("doc_id").agg(F.collect_set(F.struct("begin", "end")).alias("__ranges")).withColumnRenamed("doc_id", "__id")

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, rs in zip(text, spans, strict=True):
            if t is None or rs is None:
                out.append(t)
                continue
            raw, at, parts = t.encode("utf-8", "surrogatepass"), 0, []
            for r in sorted((r["begin"], r["end"]) for r in rs):
                if r[0] > at:
                    parts.append(raw[at : r[0]])
                at = max(at, r[1])
            out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass"))
        import pandas as pd

        return pd.Series(out)

    joined = docs.join(ranges, F.col(id_col) == F.col("__id"), "left")
    return joined.withColumn(text_col, cut(F.col(text_col), F.col("__ranges"))).select(*docs.columns)
