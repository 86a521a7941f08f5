"""Language identification with bit-sliced Bloom filters of n-grams.

Learning counts the character n-grams of labelled texts per language. A language's
filter takes the n-grams that are at least ``keep`` times as frequent in it as in
the language where they are most frequent. All filters share their hash functions
and are stored sliced: slot -> bit mask of languages, in as many 64-bit words as all
languages need. One look-up of an n-gram is the AND of ``hashes`` slots and returns
every language that contains it.

A text's score for a language is the share of its n-grams found there, corrected
for the filter's false positive rate f (the share of full slots to the power of
the number of hashes): (hits / n - f) / (1 - f). The largest score decides; of equal
scores the first language by name.

Counts come from a sample of labelled rows, drawn by hash of the id, of at most about
``rows`` rows shared equally by the languages, so that rare ones are learned too (a
documented bound of the classifier; a language with fewer rows gives all it has).
Predictions read every whole text. All n-grams that qualify go in; the number of slots
is about eight for each n-gram of the largest language, but 2 ** 20 at least and
2 ** ``most_bits`` at most, beyond which the false positive rate, and so the correction,
grows instead.

A null text, or one without any letter, is ``und`` with score 0. Rows with null
language teach nothing. Without any labelled row everything is ``und``; empty tables
give empty results. Repeated rows are rows of their own. Only the id, the text and the
columns of ``keep`` are read, so that others can have any name. Texts of any length are
read whole, in pieces that overlap by one n-gram.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_batches, mix64

SIZES = (2, 3, 4)
#: Languages whose sampling rates are broadcast (some 100 KB).
MANY = 10_000
LETTER = re.compile(r"[^\W\d_]")


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of anything but letters is one blank, also at either end."""
    letters = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.where((letters < 65) | ((letters > 90) & (letters < 97)) | ((letters > 122) & (letters < 170)), np.uint32(32), letters)
    blank = plain == 32
    stay = np.ones(len(plain), bool)
    stay[1:] = ~(blank[1:] & blank[:-1])
    return plain[stay]


def pieces(text: str, piece: int = 200_000):
    """64-bit codes of all n-grams of a text, piece by piece, each n-gram once for every place."""
    plain = letters_of(text)
    for begin in range(0, len(plain), piece):
        out = []
        for n in SIZES:
            part = plain[begin : begin + piece + n - 1].astype(np.uint64)
            count = len(part) - n + 1
            if count > 0:
                code = np.full(count, n, np.uint64)
                for i in range(n):
                    code = (code << np.uint64(15)) ^ part[i : count + i]
                out.append(code)
        if out:
            yield mix64(np.concatenate(out))


def grams(text: str) -> np.ndarray:
    """64-bit codes of all n-grams of a text."""
    return np.concatenate([np.zeros(0, np.uint64), *pieces(text)])


def word_count(languages: int) -> int:
    """64-bit words of a mask over so many languages."""
    return max(1, -(-languages // 64))


class Filters:
    """The sliced filters: languages, slots (a row for each word of the mask) and false positive rates."""

    def __init__(self, languages: list[str], slots: np.ndarray, bits: int, hashes: int) -> None:
        self.languages, self.slots, self.bits, self.hashes = languages, slots, bits, hashes
        full = [float(((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false = np.array([f**hashes for f in full])

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Languages that contain each n-gram, as a bit mask."""
        found = np.full((len(self.slots), len(codes)), np.iinfo(np.uint64).max)
        for i in range(self.hashes):
            found &= self.slots[:, self.places(codes, i)]
        return found

    def places(self, codes: np.ndarray, i: int) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return ((codes >> np.uint64(i * (64 // self.hashes))) & mask).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for codes in pieces(text):
            found = self.masks(codes)
            total += len(codes)
            hits += [np.count_nonzero(found[k // 64] & np.uint64(1 << (k % 64))) for k in range(len(self.languages))]
        share = np.clip((hits / max(total, 1) - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        best = int(np.argmax(share))
        weight = share[best] ** 4 / max(float((share**4).sum()), 1e-12)
        return self.languages[best], float(weight) if share[best] > 0 else 0.0


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, code, n): n-grams of the labelled texts by language, added up inside each batch first."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            lang, code, n = [], [], []
            by: dict[str, list[str]] = {}
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(text)
            for name, texts in by.items():
                c, k = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                lang += [name] * len(c)
                code.append(c.view(np.int64))
                n.append(k)
            return {"lang": pa.array(lang, pa.string()), "code": pa.array(np.concatenate(code) if code else [], pa.int64()), "n": pa.array(np.concatenate(n) if n else [], pa.int64())}

        return work

    rows = map_batches(labelled.select("text", "lang"), make, "lang string, code long, n long")
    return rows.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, most_bits: int = 23, hashes: int = 3, keep: float = 0.1, least: int = 3) -> Filters:
    """Filters from (text, lang) rows, all of them; see :func:`sample`.

    The driver gets one row for each language and the slots that are not empty, whose
    number ``most_bits`` bounds.
    """
    counts = gram_counts(labelled.where("text is not null and lang is not null")).persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    if not languages:
        counts.unpersist()
        return Filters([], np.zeros((1, 1 << 20), np.uint64), 20, hashes)
    numbers = labelled.sparkSession.createDataFrame(list(enumerate(languages)), "number int, lang string")
    rated = counts.where(F.col("n") >= least).join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    top = rated.groupBy("code").agg(F.max("share").alias("top"))
    chosen = rated.join(top, "code").where(F.col("share") >= keep * F.col("top")).join(numbers, "lang").select("number", "code").persist()
    largest = chosen.groupBy("number").count().agg(F.max("count")).first()[0] or 1
    bits = min(most_bits, 64 // hashes + 1, max(20, int(8 * largest - 1).bit_length()))
    slot = F.explode(F.array(*[F.shiftrightunsigned("code", i * (64 // hashes)).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(hashes)]))
    words = range(word_count(len(languages)))
    bit = F.expr("shiftleft(1L, number % 64)")
    full = chosen.select(slot.alias("slot"), "number", bit.alias("bit")).groupBy("slot")
    full = full.agg(*[F.bit_or(F.when(F.floor(F.col("number") / 64) == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]).toArrow()
    slots = np.zeros((len(words), 1 << bits), np.uint64)
    for w in words:
        slots[w, full.column("slot").to_numpy()] = full.column(f"w{w}").to_numpy().view(np.uint64)
    chosen.unpersist()
    counts.unpersist()
    return Filters(languages, slots, bits, hashes)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, *keep, lang_pred, score) of every text; the languages filters go out as one broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]

    def make():
        model = shared.value

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            found = [model.predict(t) for t in batch.column(len(names)).to_pylist()]
            out = {name: batch.column(i) for i, name in enumerate(names)}
            return out | {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}

        return work

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", lang_pred string, score double"
    return map_batches(docs.select(*names, text_col), make, schema)


def sample(labelled: DataFrame, rows: int, id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """About ``rows`` of the labelled rows, the same number of each language where it has so many, drawn by hash of the id."""
    sizes = labelled.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")).where("__lang is not null").collect()
    each = rows / max(1, len(sizes))
    rates = labelled.sparkSession.createDataFrame([(r["__lang"], 1_000_000 * each / r["__n"]) for r in sizes], "__lang string, __rate double")
    # One row for each language: broadcast while these are few, so that no language's texts meet in one task.
    rated = labelled.join(F.broadcast(rates) if len(sizes) <= MANY else rates, F.col(lang_col) == F.col("__lang"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000))
    return rated.where(draw < F.col("__rate")).select(*labelled.columns)
