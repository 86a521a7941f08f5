"""Token counts by rank-synchronous merging.

Pre-tokens are held as ragged numpy arrays (flat symbols plus offsets). In every
round each sequence finds its lowest-ranked adjacent pair and all occurrences of
that pair are merged at once, in all sequences together. A merge can only create
pairs of higher rank, so this ends with the same symbols as merging one pair at
a time. Only the number of surviving symbols is kept.

Nulls count as empty texts (0 bytes, 0 tokens); empty tables give empty results;
other columns of the input are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm._common import map_batches

FAR = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class MergeTable:
    """Symbols and ranked merges of a byte-level vocabulary file with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        self.size = len(vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.rank, self.made = code[order], order.astype(np.int64), made[order]
        self.special = sorted(t["content"] for t in spec["added_tokens"])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.blank, self.odd = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (FAR: no merge) and its place in the table."""
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        return np.where(self.code[at] == codes, self.rank[at], FAR), at

    def count(self, words: list[str]) -> np.ndarray:
        """Symbols that survive in each word."""
        if not words:
            return np.zeros(0, np.int64)
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[flat]
        symbols[ends[size > 0] - 1] = self.last[flat[ends[size > 0] - 1]]
        result = size.copy()
        who = np.flatnonzero(size > 1)
        keep = np.repeat(size > 1, size)
        symbols, size = symbols[keep], size[who]
        while len(who):
            starts = np.cumsum(size) - size
            inside = np.ones(len(symbols), bool)
            inside[starts + size - 1] = False  # the last symbol of a sequence starts no pair
            rank = np.full(len(symbols), FAR)
            place = np.zeros(len(symbols), np.int64)
            left = np.flatnonzero(inside)
            rank[left], place[left] = self.find(symbols[left] * self.size + symbols[left + 1])
            least = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(least, size)) & (rank < FAR)
            # of overlapping occurrences (a a a), every second one from the left merges
            at = np.flatnonzero(hit)
            first = np.ones(len(at), bool)
            first[1:] = np.diff(at) != 1
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[place[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            size = size - np.add.reduceat(gone, starts, dtype=np.int64)
            symbols = symbols[~gone]
            result[who] = size
            going = (least < FAR) & (size > 1)
            symbols = symbols[np.repeat(going, size)]
            who, size = who[going], size[going]
        return result

    def pre_tokens(self, text: str) -> list[str]:
        """Normalise and split one stretch of text that holds no special string."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())


class Counter:
    """Token counts of texts; remembers the counts of words up to a limit.

    No pre-token crosses white space, so the count of a text is the sum over its
    words, and only words not seen before are normalised, split and merged.
    """

    def __init__(self, table: MergeTable, limit: int = 1_000_000) -> None:
        self.table, self.limit, self.known = table, limit, {}

    def learn(self, words: list[str]) -> None:
        """Count the symbols of new words, all in one ragged batch."""
        pieces, owner, total = [], [], np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            parts = [word]
            if self.table.cut is not None and "<|" in word:
                parts = self.table.cut.split(word)
                total[i] = len(parts) - 1
            for part in parts:
                tokens = self.table.pre_tokens(part)
                pieces += tokens
                owner += [i] * len(tokens)
        np.add.at(total, owner, self.table.count(pieces))
        self.known.update(zip(words, total.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        # str.split also cuts at the separators 1C to 1F, which the vocabulary's pattern keeps
        parts = [self.table.blank.split(t) if self.table.odd.search(t) else t.split() for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        new = [w for w in set().union(*parts) if w not in self.known]
        for i in range(0, len(new), 20_000):
            self.learn(new[i : i + 20_000])
        return [sum(map(self.known.__getitem__, p)) for p in parts]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    ``vocabulary`` is the path of the vocabulary file on every executor.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        counter = Counter(MergeTable(vocabulary))

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens: list[int] = []
            for i in range(0, len(texts), 256):
                tokens += counter.count(texts[i : i + 256])
            return {
                id_col: batch.column(0),
                "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            }

        return work

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
