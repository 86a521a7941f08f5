"""Encoding and decoding with a merge-type (BPE) sentencepiece model by a prefix table.

The encoding of a text is the one sequence whose neighbours all are compatible: a pair is
compatible when encoding the two joined gives the pair back. So every prefix of a text has
one last token, and the table of these tokens is filled from left to right: of the pieces
that end at a place (matches of an Aho-Corasick automaton) it is the one that is
compatible with the last token of the prefix before it. The ids are read off backwards.
Work grows with the length of the text and not with the number of merges.

Compatibility follows the merges inside both pieces, best first, and looks for a merge
across their border that would come earlier; results are kept by each worker process, over
its tasks. Where no piece holds a space after another character, a text is cut before each
run of spaces, and at line ends and tabs that no piece holds; these parts are encoded alone,
and short ones are kept in two generations of bounded size.

Null texts are empty and have no tokens. Texts of any length are encoded whole; repeated
rows give repeated rows, null ids stay, an empty table gives an empty one, and other
columns are ignored, whatever their names. Models with a normalisation table, with pieces
that users defined or that are not used, or without byte pieces are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._common import map_batches

SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = float("-inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a message in the protocol-buffer wire format."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            top = list(fields(f.read()))
        pieces = [dict(fields(v)) for k, v in top if k == 1]
        self.pieces = [p[1].decode("utf-8") for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        trainer = dict(f for k, v in top if k == 2 for f in fields(v))
        normal = dict(f for k, v in top if k == 3 for f in fields(v))
        if trainer.get(3) != 2 or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("the model is not of merge type with plain text and spaces kept")
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or self.kinds.count(BYTE) != 256:
            raise ValueError("the model has pieces of other kinds, or no byte pieces")
        self.prefix = SPACE_MARK if normal.get(3, 1) else ""
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ").decode("utf-8")
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.values = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}


class Encoder:
    """Encodes texts; compatibility and merges inside pieces are remembered."""

    def __init__(self, model: Model, limit: int = 1_000_000) -> None:
        self.model, self.limit = model, limit
        self.automaton = ahocorasick.Automaton()
        for piece in model.ids:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.inner: dict[str, tuple[bool, list]] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        inside = "".join(model.ids)
        edges = "".join(c for c in "\n\r\t" if c not in inside)
        crossing = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in model.ids)
        run = f"[^{SPACE_MARK}{edges}]"
        self.parts = re.compile("(?s).+" if crossing else f"{SPACE_MARK}+{run}*|{run}+|" + (f"[{edges}]" if edges else "(?!)"))

    def merges(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether merging makes one piece of it; score, first and last part of every merge, in order."""
        known = self.inner.get(piece)
        if known is None:
            parts, steps = list(piece), []
            while True:
                best, at = NEVER, -1
                for i in range(len(parts) - 1):
                    score = self.model.scores.get(parts[i] + parts[i + 1], NEVER)
                    if score > best:
                        best, at = score, i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[0], parts[-1]))
            known = self.inner[piece] = (len(parts) == 1, steps)
        return known

    def compatible(self, left: str | None, right: str) -> bool:
        """Whether the two, joined and encoded, give the two again; left None: a text begins."""
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merges(right)[0] and (left is None or not self.crossed(left, right))
        return known

    def crossed(self, left: str, right: str) -> bool:
        """Whether a merge over the border comes before the merges inside have ended."""
        before, after = self.merges(left)[1], self.merges(right)[1]
        end, start, i, j = left[-1], right[0], 0, 0
        while True:
            over = self.model.scores.get(end + start, NEVER)
            own = before[i][0] if i < len(before) else NEVER
            other = after[j][0] if j < len(after) else NEVER
            if over > own and over >= other and over > NEVER:  # of equal scores the leftmost merge comes first
                return True
            if own == other == NEVER:
                return False
            if own >= other:
                end = before[i][2]
                i += 1
            else:
                start = after[j][1]
                j += 1

    def encode_part(self, part: str) -> list[int]:
        """Ids of one part: fill the table of last tokens, then read it backwards."""
        last: list[str | None] = [None] * (len(part) + 1)
        known = self.pairs.get
        for end, (piece, size) in self.automaton.iter(part):
            end += 1
            if last[end] is None:
                before = last[end - size]
                if before is None and end > size:  # the character before is no piece
                    before = part[end - size - 1]
                fits = known((before, piece))
                if fits or fits is None and self.compatible(before, piece):
                    last[end] = piece
        ids, at = [], len(part)
        while at:
            piece = last[at]
            if piece is None:
                at -= 1
                ids += [self.model.bytes[b] for b in reversed(part[at].encode("utf-8", "replace"))]
            else:
                at -= len(piece)
                ids.append(self.model.ids[piece])
        ids.reverse()
        return ids

    def split(self, text: str) -> list[str]:
        """The parts of a text, with marks for spaces, that no piece crosses."""
        return self.parts.findall(self.model.prefix + text.replace(" ", SPACE_MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.encode_part(part)]


class Decoder:
    """Texts of ids; bytes that are no UTF-8 become replacement characters, one for each."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.special = {i for i, k in enumerate(model.kinds) if k != NORMAL}

    def surfaces(self, ids: list[int]) -> str:
        """The pieces of the ids with spaces for marks; the space before a text is still there."""
        m, out, raw = self.model, [], bytearray()
        if self.special.isdisjoint(ids):
            return "".join([m.pieces[i] for i in ids]).replace(SPACE_MARK, " ")
        for i in ids:
            if i in m.values:
                raw.append(m.values[i])
                continue
            if raw:
                out.append(self.characters(bytes(raw)))
                raw.clear()
            if m.kinds[i] == UNKNOWN:
                out.append(m.unknown)
            elif m.kinds[i] == NORMAL:
                out.append(m.pieces[i].replace(SPACE_MARK, " "))
        return "".join(out) + self.characters(bytes(raw))

    @staticmethod
    def characters(raw: bytes) -> str:
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "surrogateescape")  # every byte that fits no character stands alone
            return re.sub("[\udc80-\udcff]", "�", text)

    def decode(self, ids: list[int]) -> str:
        text = self.surfaces(ids)
        first = next((i for i in ids if self.model.kinds[i] != CONTROL), None)
        marked = first is not None and self.model.kinds[first] == NORMAL and self.model.pieces[first].startswith(SPACE_MARK)
        return text[1:] if marked and self.model.prefix else text


class Parts(dict):
    """Part of a text to its number of ids, the ids as text and the decoded part.

    Short parts are kept; when ``limit`` of them are, they become the older generation and
    the one before is forgotten.
    """

    def __init__(self, model: Model, limit: int = 400_000, longest: int = 64) -> None:
        super().__init__()
        self.encoder, self.decoder = Encoder(model), Decoder(model)
        self.limit, self.longest = limit, longest
        self.older: dict[str, tuple[int, str, str]] = {}

    def __missing__(self, part: str) -> tuple[int, str, str]:
        value = self.older.get(part)
        if value is None:
            ids = self.encoder.encode_part(part)
            value = len(ids), ",".join(map(str, ids)), self.decoder.surfaces(ids)
        if len(part) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[part] = value
        return value


@cache
def parts_of(path: str) -> Parts:
    """What this process knows of the model's parts."""
    return Parts(Model(path))


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """Number and digests of the ids and of the decoded text of every row.

    ``model`` is the path of the model file on every executor. With ``full`` the rows carry
    ``ids`` and ``decoded`` too.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        parts = parts_of(model)
        split, prefix = parts.encoder.split, len(parts.encoder.model.prefix)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            counts, id_hash, text_hash, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = [parts[p] for p in split(text or "")]
                joined, decoded = ",".join([f[1] for f in found]), "".join([f[2] for f in found])[prefix:]
                counts.append(sum([f[0] for f in found]))
                id_hash.append(hashlib.sha256(joined.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
                if full:
                    ids.append(list(map(int, joined.split(","))) if joined else [])
                    texts.append(decoded)
            out = {
                id_col: batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(id_hash, pa.string()),
                "decoded_sha256": pa.array(text_hash, pa.string()),
            }
            return out | ({"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())} if full else {})

        return work

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(id_col, text_col), make, schema + (", ids array<int>, decoded string" if full else ""))
