"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit check.

The CGK embedding walks along a sequence: at step j it writes the current symbol and
goes on to the next one, or stays, as a random function of (j, symbol) says. Sequences
at a small edit distance get walks that meet again soon, so that their embeddings are
at a small Hamming distance; sampling positions of the embedding is then an LSH.

Symbols are pieces of about three letters, cut where a pair of letters says so (and at
spaces and punctuation, which belong to none): an edit changes the pieces around it only,
so that typos in most words leave pieces between them. A walk depends only on where it
starts, so that one walk from every piece of a document stands for the item-sized windows
of all benchmark items at once, and an item is walked from all of its pieces. Equal
samples line a window of the document up with the item. Windows are compared in two steps,
both by bit-parallel dynamic programming over characters: 64 characters of the item around
the sample must lie within ``FIRST`` times ``max_edit`` of their length (all windows of a
batch at once); then the whole item decides exactly, by its edit distance to the best part
of the window: at most ``max_edit`` of its length. White space and case are normalised.

``TIERS`` is set for a recall of at least 0.95 of what a full search finds at any edit
rate up to ``max_edit`` = 0.2, whether letters or words are edited; the tests measure it
by rate and kind of edit. Items too short for the first tier have walks of shorter ones.

A sample that many items share goes on to a longer stretch of its walk. Where its item has
no longer one, it stays as it is if the item needs it, having other samples for less than
half of its walks: no item is left without. Items that share half of their
samples or more (made from one template, or near copies) are one family and count as one
there, so that their samples stay short; each sample leads to all members that have it.
Equal items are one entry with several ids.

Documents never move: walk, look-up and check happen where the document is read. The
index is built by tasks, in blocks of at most ``block_items`` items and ``block_chars``
characters. Blocks go out together, as many as take ``SHIPPED`` bytes, and one scan of the
documents looks for all of them; only a larger benchmark takes a further scan, with what
the last one found written before.

Null or empty texts match nothing; empty or null items are skipped; empty tables give
empty results. Each (document row, item) with a match gives one row, its best (the first
of equal ones); rows that repeat an id are rows of their own. Only id and text are read
here, so that other columns can have any name. Texts of any length are read whole.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Scratch, map_batches, mix64, sliced

#: ((steps, sampled steps) of each stretch of the walk, walks, items of fewer pieces have them).
TIERS = ((((6, 5), (6, 4), (8, 4), (12, 6)), 3, 1 << 30), (((3, 2),), 2, 12), (((1, 1),), 1, 4))
#: A sample that more families of items share goes on to the next stretch of its walk.
COMMON = 2
#: Bytes of index that go out with one scan of the documents.
SHIPPED = 128 << 20
#: Of all pairs of letters, this part starts a new piece.
CUT = 0.35
#: Characters of the first comparison, how far they can be shifted, and how much more than ``max_edit`` may differ there.
FEW, SHIFT, FIRST = 64, 8, 1.5
GRID = 32
BATCH_CHARS = 1 << 20
PAD = 1024
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*b" .,;:!?\"'()[]\0"]] = True
#: What the first 0 to 8 bytes of a 64-bit word keep.
BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def folded(text: str) -> np.ndarray:
    """One byte for each character: ASCII as it is, others folded into the upper half."""
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, code, 128 + (code & 127)).astype(np.uint8)


class Pieces:
    """Cuts texts into pieces."""

    def __init__(self, seed: int) -> None:
        begins = np.random.default_rng(seed).random((256, 256)) < CUT
        before, here = SEPARATORS[:, None], SEPARATORS[None, :]
        # boundaries: the first letter of a piece, and the first separator after one
        bound = np.where(here, ~before, before | begins)
        self.bound = bound.T.reshape(-1)  # the pair of bytes as a little-endian number: the later one is the higher byte

    def of(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, place) of every piece."""
        n = len(letters)
        raw = np.zeros(n + 9, np.uint8)
        raw[0], raw[1 : n + 1] = 32, letters
        pairs = np.ndarray((n,), "<u2", raw.data, strides=(1,))
        edge = np.flatnonzero(self.bound[pairs])
        begins = ~SEPARATORS[letters[edge]]
        size = np.diff(np.append(edge, n))[begins]
        place = edge[begins]
        words = np.ndarray((n + 1,), "<u8", raw.data, strides=(1,))
        return mix64(words[place + 1] & BYTES[np.minimum(size, 8)]), place


class Walks:
    """The random walks: for each a salt and the sampled steps of its stretches."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.plans = []
        for stretches, repeats, below in TIERS:
            for _ in range(repeats):
                at, begin = [], 0
                for steps, samples in stretches:
                    mine = np.sort(rng.choice(steps, samples, replace=False)) + begin
                    at.append(mine.tolist())
                    begin += steps
                self.plans.append((np.uint64(rng.integers(1, 2**63)), at, below))

    def bits(self, plan: int, symbols: np.ndarray) -> np.ndarray:
        """For each piece, whether a walk that is there at step j goes on: bit j."""
        return (mix64(symbols ^ self.plans[plan][0]) & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def go(self, plan: int, stretch: int, symbols: np.ndarray, bits: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, key) after a stretch of the walks that are at ``pos`` with ``key``.

        The step counts from the walk's first sample, so that every walk reads where it starts.
        """
        _, at, _ = self.plans[plan]
        first = at[0][0]
        begin, samples = (at[stretch - 1][-1] - first if stretch else 0), {x - first for x in at[stretch]}
        n = len(symbols)
        pos_out, key_out = np.empty(len(pos), np.int32), np.empty(len(pos), np.uint64)
        for i in range(0, len(pos), 1 << 15):  # a part that stays in the cache
            p, k = pos[i : i + (1 << 15)].astype(np.int32), key[i : i + (1 << 15)].copy()
            for j in range(begin, at[stretch][-1] - first + 1):
                if j > begin:
                    p += ((bits[p] >> np.uint32(j % 32)) & np.uint32(1)).astype(np.int32)
                    np.minimum(p, n - 1, out=p)
                if j in samples:
                    k ^= symbols[p]
                    k *= np.uint64(0x9E3779B97F4A7C15)
                    k ^= k >> np.uint64(29)
            pos_out[i : i + len(p)], key_out[i : i + len(p)] = p, k
        return pos_out, key_out

    def start(self, plan: int, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pieces, with the keys of walks that have not begun."""
        return np.arange(len(symbols), dtype=np.int32), np.full(len(symbols), self.plans[plan][0])


def scan(pattern: np.ndarray | str, text, anchored: bool = False, stop: int | None = None) -> tuple[int, int]:
    """Fewest edits between the pattern and any part of the text, and where that part ends.

    Bit-parallel over the pattern, with one integer for its column. ``anchored``: the part begins
    where the text does. ``stop``: end at the first place with so few edits.
    """
    m, places = len(pattern), {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, edits = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        equal = places.get(c, 0)
        across = equal | minus
        down = (((equal & plus) + plus) ^ plus) | equal
        rise, fall = minus | ~(down | plus) & mask, plus & down
        if rise & top:
            edits += 1
        elif fall & top:
            edits -= 1
        rise, fall = rise << 1 | anchored, fall << 1
        plus, minus = (fall | ~(across | rise)) & mask, rise & across & mask
        if edits < best:
            best, end = edits, j
            if stop is not None and best <= stop:
                break
    return best, end


def best_part(item: str, window: str, most: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the first of the best parts of the window; None with more than ``most`` edits."""
    edits, end = scan(item, window)
    if edits > most:
        return None
    if edits == len(item):
        return edits, 0, 0
    _, back = scan(item[::-1], window[:end][::-1], anchored=True, stop=edits)
    return edits, end - back, end


def families(item: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The family of each of ``n`` items: those that share half of their different keys with another one of it.

    Items are not compared in pairs: the holders of a key are compared with its first, middle and last one.
    """
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    new = np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])) if len(key) else np.zeros(0, bool)
    key, item = key[new], item[new]
    total = np.bincount(item, minlength=n)
    _, low, times = np.unique(key, return_index=True, return_counts=True)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at in (low, low + times // 2, low + times - 1):
        lead = np.repeat(item[at], times)
        pair, shared = np.unique(item * np.int64(n) + lead, return_counts=True)
        a, b = pair // n, pair % n
        near = (a != b) & (2 * shared >= np.minimum(total[a], total[b]))
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            parent[root(i)] = root(j)
    return np.array([root(i) for i in range(n)], np.int64)


def many_families(key: np.ndarray, item: np.ndarray, family: np.ndarray) -> np.ndarray:
    """Keys with more than ``COMMON`` places, of the members of a family the one with most of them counted."""
    if not len(key):
        return key
    order = np.lexsort((item, key))
    key, item = key[order], item[order]
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])))
    places = np.diff(np.append(edge, len(key)))
    key, of = key[edge], family[item[edge]]
    order = np.lexsort((places, of, key))
    key, of, places = key[order], of[order], places[order]
    last = np.append((key[1:] != key[:-1]) | (of[1:] != of[:-1]), True)  # the member with most places
    value, at = np.unique(key[last], return_inverse=True)
    return value[np.bincount(at, weights=places[last]) > COMMON]


class Index:
    """Items of one block, with the keys of their walks in order."""

    def __init__(self, items: list[tuple[int, str]], max_edit: float = 0.2, seed: int = 11) -> None:
        self.max_edit, self.pieces, self.walks = max_edit, Pieces(seed), Walks(seed)
        ids: dict[str, list[int]] = {}
        for i, t in items:
            if x := normalised(t):
                ids.setdefault(x, []).append(i)
        #: different texts, each with the ids of the items that have it
        self.items = [(of, x) for x, of in ids.items()]
        symbols = [self.pieces.of(folded(x)) for _, x in self.items]
        plain = [self.moved(0, 0, number, s, place, np.arange(len(s)), *self.walks.start(0, s)) for number, (s, place) in enumerate(symbols) if len(s)]
        key = np.concatenate([np.zeros(0, np.uint64), *(m[5] for m in plain)])
        item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(m[5]), m[0], np.int64) for m in plain)])
        self.family = families(item, key, len(symbols))
        #: by plan and stretch: keys, where each begins and how often it comes, (item, offset) in order of the key, a bit map, keys that go on
        self.tables = []
        for plan, (_, at, below) in enumerate(self.walks.plans):
            walks = [self.moved(plan, 0, number, s, place, np.arange(len(s)), *self.walks.start(plan, s)) for number, (s, place) in enumerate(symbols) if 0 < len(s) < below]
            levels, total, have = [], {m[0]: len(m[5]) for m in walks}, Counter()
            for stretch in range(len(at)):
                if not walks:
                    break
                keys = np.concatenate([m[5] for m in walks])
                item = np.concatenate([np.full(len(m[5]), m[0], np.int64) for m in walks])
                common = many_families(keys, item, self.family) if stretch + 1 < len(at) else keys[:0]
                stay, further = [], []
                for number, s, place, begin, pos, key in walks:
                    go = np.isin(key, common)
                    longer = self.moved(plan, stretch + 1, number, s, place, begin[go], pos[go], key[go]) if go.any() else None
                    fits = np.zeros(len(key), bool)
                    if longer and len(longer[5]):
                        fits[np.flatnonzero(go)[np.isin(begin[go], longer[3])]] = True
                        further.append(longer)
                    have[number] += int((~go).sum())
                    # What has no longer walk stays here, however many share it, if too little else is left of the item.
                    here = ~fits if 2 * (have[number] + fits.sum()) < total[number] else ~go
                    stay.append((number, place[begin[here]], key[here], key[fits]))
                levels.append(self.level(stay, keys))
                walks = further
            self.tables.append(levels)

    def moved(self, plan: int, stretch: int, number: int, s: np.ndarray, place: np.ndarray, begin: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple:
        """(item, symbols, places, first piece, piece, key) of the walks after a stretch, of those that fit into the item."""
        pos, key = self.walks.go(plan, stretch, s, self.walks.bits(plan, s), pos, key)
        # A walk that reaches the end reads its last piece again, which a document does not.
        fits = (pos < len(s) - 1) | (len(self.walks.plans[plan][1]) == 1)
        return number, s, place, begin[fits], pos[fits], key[fits]

    @staticmethod
    def level(stay: list[tuple], every: np.ndarray) -> tuple:
        """Table of the keys that stay on a level, a bit map of all keys on it, and those that go on."""
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(every >> np.uint64(44)).astype(np.int64)] = True
        keys = np.concatenate([x[2] for x in stay])
        item = np.concatenate([np.full(len(x[2]), x[0], np.int32) for x in stay])
        offset = np.concatenate([x[1] for x in stay]).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        value, low, times = np.unique(keys[order], return_index=True, return_counts=True)
        return value, low, times, item[order], offset[order], np.packbits(bitmap), np.unique(np.concatenate([x[3] for x in stay]))


class Finder:
    """Items in documents."""

    def __init__(self, index: Index) -> None:
        self.index = index
        self.bitmaps = [[np.unpackbits(t[5]).astype(bool) for t in levels] for levels in index.tables]
        texts = [x for _, x in index.items]
        self.size = np.array([len(x) for x in texts], np.int64)
        self.most = np.floor(index.max_edit * self.size + 1e-9).astype(np.int64)
        # stretches of the items for the first comparison: bit masks of where each byte stands
        count = np.maximum(0, -(-(self.size - FEW) // GRID)) + 1
        self.first = np.cumsum(count) - count
        self.few = np.repeat(np.minimum(self.size, FEW), count)
        self.begin = np.concatenate([np.minimum(np.arange(c) * GRID, max(0, s - FEW)) for c, s in zip(count, self.size, strict=True)]) if texts else np.zeros(0, np.int64)
        self.masks = np.zeros((int(count.sum()), 256), np.uint64)
        for number, x in enumerate(texts):
            letters = folded(x)
            for p in range(self.first[number], self.first[number] + count[number]):
                part = letters[self.begin[p] : self.begin[p] + FEW]
                np.bitwise_or.at(self.masks[p], part, np.uint64(1) << np.arange(64 - len(part), 64, dtype=np.uint64))
        self.masks = self.masks.reshape(-1)

    def spots(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place of the equal sample, its offset in the item), one for each alignment and stretch of the item."""
        symbols, place = self.index.pieces.of(letters)
        found = []
        for plan, levels in enumerate(self.index.tables if len(symbols) else []):
            pos, key = self.index.walks.start(plan, symbols)
            begin, bits = pos, self.index.walks.bits(plan, symbols)
            for stretch, (keys, first, times, item, offset, _, common) in enumerate(levels):
                pos, key = self.index.walks.go(plan, stretch, symbols, bits, pos, key)
                hit = np.flatnonzero(self.bitmaps[plan][stretch][(key >> np.uint64(44)).astype(np.int64)])
                begin, pos, key = begin[hit], pos[hit], key[hit]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    rare = np.flatnonzero(keys[at] == key)
                    at = at[rare]
                    n = times[at]
                    at = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found.append((item[at].astype(np.int64), np.repeat(place[begin[rare]], n), offset[at].astype(np.int64)))
                go = np.isin(key, common)
                begin, pos, key = begin[go], pos[go], key[go]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        item, at, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        # item, alignment and offset in one number, so that plain sorting brings equal ones together
        longest = int(self.size.max())
        low, middle = longest.bit_length(), (len(letters) + longest).bit_length()
        line = np.sort(((item << middle) + at - offset + longest << low) + offset)
        same = line - (line & ((1 << low) - 1)) + (line & ((1 << low) - 1)) // GRID
        line = line[np.append(True, same[1:] != same[:-1])] if len(line) else line
        offset = line & ((1 << low) - 1)
        item, start = line >> (low + middle), (line >> low & ((1 << middle) - 1)) - longest
        return item, start + offset, offset

    def near(self, padded: np.ndarray, item: np.ndarray, at: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Whether the stretch of the item around each sample is near the text there: all at once, one column of bits each.

        ``padded`` is the text with ``PAD`` zeros at either end.
        """
        stretch = self.first[item] + np.clip((offset - FEW // 4) // GRID, 0, np.maximum(0, -(-(self.size[item] - FEW) // GRID)))
        m = self.few[stretch]
        width = FEW + 2 * SHIFT
        start = np.clip(at - offset + self.begin[stretch] - SHIFT + PAD, 0, len(padded) - width)
        text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[start].T)
        base = stretch * 256
        up = np.uint64(64) - m.astype(np.uint64)  # patterns stand in the upper bits, so that the sign is their last one
        full = bool((m == FEW).all())
        area = ~np.uint64(0) << up
        plus, minus = area.copy(), np.zeros(len(item), np.uint64)
        edits = m.astype(np.int8)
        best = edits.copy()
        for j in range(width):
            equal = self.masks[base + text[j]]
            across = equal | minus
            down = equal & plus
            down += plus
            down ^= plus
            down |= equal
            fall = plus & down
            down |= plus
            np.invert(down, out=down)
            down |= minus  # where the column rises
            edits += (down.view(np.int64) < 0).view(np.int8)
            edits -= (fall.view(np.int64) < 0).view(np.int8)
            if not full:
                down &= area
                fall &= area
            down <<= np.uint64(1)
            fall <<= np.uint64(1)
            np.bitwise_and(down, across, out=minus)
            across |= down
            np.invert(across, out=across)
            np.bitwise_or(fall, across, out=plus)
            if not full:
                plus &= area
            np.minimum(best, edits, out=best)
        return best <= np.ceil(FIRST * self.index.max_edit * m)

    def find(self, texts: list[str | None]) -> list[tuple]:
        """As :func:`find_all` with this block alone."""
        return find_all([self], texts)

    def find_in(self, group: list[tuple[int, str]]) -> list[tuple]:
        """As :func:`find_all`, for numbered texts that fit into memory together."""
        if not group or not self.index.items:
            return []
        letters = folded("\0".join(x for _, x in group))
        first = np.cumsum([0, *(len(x) + 1 for _, x in group[:-1])])
        item, at, offset = self.spots(letters)
        keep, padded = [], np.pad(letters, PAD)
        for i in range(0, len(item), 1 << 13):  # parts that stay in the cache
            part = slice(i, i + (1 << 13))
            keep.append(self.near(padded, item[part], at[part], offset[part]))
        keep = np.concatenate([np.zeros(0, bool), *keep])
        item, at, offset = item[keep], at[keep], offset[keep]
        doc = np.searchsorted(first, at, "right") - 1
        start = at - offset - first[doc]
        slack = np.maximum(8, self.most[item])
        best: dict[tuple[int, int], tuple] = {}
        for d, number, line in sorted(set(zip(doc.tolist(), item.tolist(), (start // slack).tolist(), strict=True))):
            s, most = int(max(8, self.most[number])), int(self.most[number])
            low = max(0, (line - 1) * s)
            text, x = group[d][1], self.index.items[number][1]
            got = best_part(x, text[low : max(0, (line + 2) * s + len(x))], most)
            if got:
                edits, a, b = got
                row = (edits, low + a, low + b)
                if (d, number) not in best or row < best[d, number]:
                    best[d, number] = row
        out = []
        for (d, number), (edits, a, b) in sorted(best.items()):
            text, (names, x) = group[d][1], self.index.items[number]
            where = edits, 1 - edits / len(x), text.count(" ", 0, a), text.count(" ", a, b) + 1
            out += [(group[d][0], name, *where) for name in names]
        return out


def find_all(finders: list[Finder], texts: list[str | None]) -> list[tuple]:
    """(number of the text, item id, edits, similarity, first word, words) of the best match of every item of all blocks."""
    out, group, chars = [], [], 0
    for number, text in enumerate([*texts, None]):
        if text:
            group.append((number, normalised(text)))
            chars += len(group[-1][1])
        if group and (chars >= BATCH_CHARS or number == len(texts)):
            for finder in finders:
                out += finder.find_in(group)
            group, chars = [], 0
    return out


def indexes(benchmark: DataFrame, o: dict) -> DataFrame:
    """(size, index): the indexes of all blocks, built by tasks."""
    text = F.col(o["item_text_col"])
    items = benchmark.select(F.col(o["item_col"]).cast("long").alias("item"), text.alias("text")).where(F.length(F.trim(text)) > 0)
    n = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-n["items"] // o["block_items"]), -(-n["chars"] // o["block_chars"]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars = [], 0

        def made() -> pa.RecordBatch:
            blob = pickle.dumps(Index(block, o["max_edit"], o["seed"]))
            return pa.RecordBatch.from_pydict({"size": pa.array([len(blob)], pa.int64()), "index": pa.array([blob], pa.binary())})

        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.append((item, words))
                chars += len(words)
                if len(block) >= o["block_items"] or chars >= o["block_chars"]:
                    yield made()
                    block, chars = [], 0
        if block:
            yield made()

    return items.repartition(blocks).mapInArrow(build, "size long, index binary")


def shipments(table: DataFrame) -> Iterator[list[bytes]]:
    """Indexes of so many blocks at a time as go out together; one block at least."""
    ready, size = [], 0
    for row in table.toLocalIterator():
        if ready and size + row["size"] > SHIPPED:
            yield ready
            ready, size = [], 0
        ready.append(bytes(row["index"]))
        size += row["size"]
    if ready:
        yield ready


def over_blocks(benchmark: DataFrame, options: dict, apply, start: DataFrame, step) -> DataFrame:
    """``step(result so far, apply(broadcast indexes))`` over all shipments; one at a time is in memory."""
    spark, scratch, result, before = benchmark.sparkSession, Scratch(benchmark.sparkSession), start, None
    built = scratch.write(indexes(benchmark, options))
    for ready in shipments(built):
        if before is not None:  # a further shipment: what the last one found is written, and its indexes go
            result = scratch.write(result)
            before.unpersist()
        before = spark.sparkContext.broadcast(ready)
        result = step(result, apply(result, before))
    scratch.drop(built)
    return result


def finders(shared) -> list[Finder]:
    return [Finder(pickle.loads(blob)) for blob in shared.value]


DEFAULTS = {"max_edit": 0.2, "seed": 11, "block_items": 2_000, "block_chars": 1_000_000, "id_col": "doc_id", "text_col": "text", "item_col": "item_id", "item_text_col": "text"}


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, distance, similarity, first_word, n_words): every item that a document holds.

    Options and their defaults: max_edit 0.2, seed, block_items, block_chars, and the columns
    id_col, text_col, item_col, item_text_col.
    """
    o = DEFAULTS | options
    schema = "doc_id long, item_id long, distance long, similarity double, first_word long, n_words long"
    source = docs.select(F.col(o["id_col"]).cast("long").alias("doc_id"), F.col(o["text_col"]).alias("text"))

    def search(_: DataFrame, shared) -> DataFrame:
        def make():
            blocks = finders(shared)

            def work(batch: pa.RecordBatch) -> dict[str, object]:
                ids = batch.column(0).to_pylist()
                rows = [(ids[r[0]], *r[1:]) for r in find_all(blocks, batch.column(1).to_pylist())]
                names = ("doc_id", "item_id", "distance", "similarity", "first_word", "n_words")
                return {n: pa.array([r[k] for r in rows], pa.float64() if n == "similarity" else pa.int64()) for k, n in enumerate(names)}

            return work

        return map_batches(source, make, schema)

    return over_blocks(benchmark, o, search, docs.sparkSession.createDataFrame([], schema), lambda found, more: found.union(more))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; every row is judged by its own text."""
    o = DEFAULTS | options

    def keep(rows: DataFrame, shared) -> DataFrame:
        at = rows.columns.index(o["text_col"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = finders(shared)
            for part in sliced(batches):
                clean = np.ones(part.num_rows, bool)
                clean[[r[0] for r in find_all(blocks, part.column(at).to_pylist())]] = False
                yield part.filter(pa.array(clean))

        return rows.mapInArrow(run, rows.schema)

    return over_blocks(benchmark, o, keep, docs, lambda _, kept: kept)
