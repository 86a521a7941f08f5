"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

Lexicon: words and word beginnings outside quotations whose documents are toxic far
more often than the others are learned from labelled documents. Matching: the Levenshtein automata of all
entries, run over the trie of the entries, form one deterministic automaton whose
states are built when first reached; a word is read once, letter by letter, and most
words reach the dead state early. It finds entries spelled exactly, misspelled ones
(one error from 5 letters on, two from 9), and both as the beginning of a longer word.

Scoring: every kind of match of an entry has the probability, smoothed, that a
labelled document with it is toxic. A match within quotation marks (that open and
close within a window of words around it) has a probability of its own. Matches of a
document with p >= 0.5 combine as 1 - product (1 - p); weaker ones, of which a long text
has many by chance, do not add up: the strongest of them counts. Without any match the
score is the rate of toxic documents among those without.

Learning reads a sample of labelled rows, drawn by hash of the id, of at most about
``sample_rows`` rows (a documented bound of the classifier), of copies one. Scores read every whole
text, and only the text.

Null and empty texts have the score of texts without matches. Conflicting labels of
one id count as toxic. Without labelled rows there is no lexicon and all scores are 0.5 x
the smoothed rate. Repeated rows are scored alike; empty tables give empty results. Of
entries of equal worth the first in the alphabet is taken. Texts of any length are read
whole, word by word. Only the id, the text and the columns of ``keep`` are read, and
:func:`reject_toxic` passes rows through as they are, so that other columns can have any name.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm._common import map_batches, remainder, sample, sliced
from tidemark.llm.near_dedup import Signer

EDGES = ".,;:!?()[]{}<>\"'`*%$&#/\\|~^_+=-“”„‟«»‹›‘’‚…–—"
OPEN, CLOSE = "\"“„«‹‘‚'", "\"”“»›’‘'"
WINDOW = 8
STEMS = range(4, 11)
EXACT, FUZZY, FUZZY_START = 0, 1, 2
#: Prior belief (toxic, clean documents) in a match of each kind.
PRIOR = {EXACT: (4.0, 1.0), FUZZY: (4.0, 1.0), FUZZY_START: (1.0, 2.0)}
QUOTED = 0.4


def core(word: str) -> str:
    return word.strip(EDGES).lower()


def allowed(length: int) -> int:
    """Errors that a term of this length may have."""
    return 2 if length >= 9 else 1 if length >= 5 else 0


class Automaton:
    """The entries' trie under their Levenshtein automata, made deterministic state by state."""

    def __init__(self, entries: list[str]) -> None:
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[int] = [-1]
        self.most: list[int] = [0]
        for i, term in enumerate(entries):
            node = 0
            self.most[0] = max(self.most[0], allowed(len(term)))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.entry.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed(len(term)))
            self.entry[node] = i
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.hits: list[tuple[tuple[int, int], ...]] = []
        self.start = self.state({0: 0})

    def state(self, errors: dict[int, int]) -> int:
        """The number of a state: trie nodes with their fewest errors, letters left out included."""
        todo = list(errors)
        while todo:
            n = todo.pop()
            e = errors[n] + 1
            for child in self.children[n].values():
                if e <= self.most[child] and errors.get(child, 9) > e:
                    errors[child] = e
                    todo.append(child)
        key = frozenset(errors.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(e, self.entry[n]) for n, e in errors.items() if self.entry[n] >= 0 and e <= allowed(len(self.entries[self.entry[n]]))]
            self.hits.append(tuple(sorted(found)))
        return self.numbers[key]

    def step(self, state: int, letter: str) -> int:
        out: dict[int, int] = {}
        for n, e in self.sets[state]:
            for c, child in self.children[n].items():
                cost = e + (c != letter)
                if cost <= self.most[child] and out.get(child, 9) > cost:
                    out[child] = cost
            if e + 1 <= self.most[n] and out.get(n, 9) > e + 1:
                out[n] = e + 1
        to = self.steps[state][letter] = self.state(out) if out else -1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, kind) of the best match: exact, then misspelled, then a misspelled beginning."""
        state, begin = self.start, None
        for letter in word:
            to = self.steps[state].get(letter)
            state = self.step(state, letter) if to is None else to
            if state < 0:
                break
            found = self.hits[state]
            if found:
                if found[0][0] == 0:
                    return found[0][1], EXACT
                begin = begin or found[0]
        if state >= 0 and self.hits[state]:
            return self.hits[state][0][1], FUZZY
        return (begin[1], FUZZY_START) if begin else None


class Matcher:
    """Matches of whole texts; remembers words up to a limit."""

    def __init__(self, entries: list[str], limit: int = 500_000) -> None:
        self.automaton, self.known, self.limit = Automaton(entries), {}, limit

    def lookup(self, word: str):
        found = self.automaton.match(core(word)) if self.automaton.entries else None
        self.known[word] = found
        return found

    def find(self, text: str | None) -> set[tuple[int, int, bool]]:
        """(entry, kind, quoted) of all matches."""
        if not text:
            return set()
        if len(self.known) > self.limit:
            self.known = {}
        words = text.split()
        known = self.known
        for new in set(words):
            if new not in known:
                self.lookup(new)
        out = set()
        for i, m in enumerate(map(known.__getitem__, words)):
            if m is not None:
                out.add((*m, quoted(words, i)))
        return out


def quoted(words: list[str], at: int) -> bool:
    """A quotation mark opens at most WINDOW words before and closes at most WINDOW words after."""
    opens = any(w[0] in OPEN for w in words[max(0, at - WINDOW) : at + 1])
    return opens and any(w.rstrip(".,;:!?")[-1:] in CLOSE and w.rstrip(".,;:!?") for w in words[at : at + WINDOW + 1])


def unquoted(words: list[str]) -> list[str]:
    """The words that do not stand in quotation marks."""
    if not any(w[0] in OPEN for w in words):
        return words
    return [w for i, w in enumerate(words) if not quoted(words, i)]


class Model:
    """Lexicon entries and match probabilities."""

    def __init__(self, entries: list[str], p: dict[tuple[int, int, bool], float], base: float) -> None:
        self.entries, self.p, self.base = entries, p, base

    def score(self, found: set[tuple[int, int, bool]]) -> float:
        rest, weak = 1 - self.base, self.base
        for entry, kind, inside in found:
            p = self.p.get((entry, kind, inside))
            if p is None:
                a, b = PRIOR[kind]
                p = a / (a + b) * (QUOTED if inside else 1)
            if p >= 0.5:
                rest *= 1 - p
            else:
                weak = max(weak, p)
        return max(1 - rest, weak)


def term_counts(labelled: DataFrame) -> DataFrame:
    """(term, toxic, clean): documents with each word and word beginning, added up inside each batch first."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            count = [Counter(), Counter()]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {core(w) for w in set(unquoted((text or "").split()))}
                terms = {w for w in words if len(w) >= 4}
                terms |= {w[:n] for w in words for n in STEMS if n < len(w)}
                count[not toxic].update(terms)
            names = list(count[0].keys() | count[1].keys())
            return {"term": pa.array(names, pa.string()), "toxic": pa.array([count[0][t] for t in names], pa.int64()), "clean": pa.array([count[1][t] for t in names], pa.int64())}

        return work

    rows = map_batches(labelled.select("text", "toxic"), make, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_entries(rows: list, toxic: int, clean: int, least_llr: float = 22.0, precision: float = 0.8) -> list[str]:
    """Terms with significantly toxic documents: of a chain of beginnings the longest that finds as many."""
    base = toxic / max(1, toxic + clean)
    good: dict[str, int] = {}
    for r in rows:
        t, c = r["toxic"], r["clean"]
        share = t / (t + c)
        if share < precision or share <= base:
            continue
        llr = 2 * (t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0.0))
        if llr >= least_llr:
            good[r["term"]] = t
    entries: list[str] = []
    taken: set[str] = set()
    for term in sorted(good, key=lambda t: (len(t), t)):
        if any(term[:n] in taken for n in range(4, len(term))):
            continue
        # the shortest good beginning of a chain: lengthen it while hardly a document is lost
        best = term
        longer = [t for t in good if t.startswith(term) and good[t] >= 0.9 * good[term]]
        best = max([best, *longer], key=len)
        taken.add(term)
        entries.append(best)
    return entries


def match_rows(docs: DataFrame, entries: list[str]) -> DataFrame:
    """(toxic, matches) of labelled texts."""

    def make():
        matcher = Matcher(entries)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            found = [[f"{e},{k},{int(q)}" for e, k, q in sorted(matcher.find(t))] for t in batch.column(0).to_pylist()]
            return {"toxic": batch.column(1), "found": pa.array(found, pa.list_(pa.string()))}

        return work

    return map_batches(docs.select("text", "toxic"), make, "toxic boolean, found array<string>")


def without_copies(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """One row of each group of copies and near copies, so that a rare word of a much copied text is no evidence.

    Rows that agree in the MinHash of one of ``rounds`` hash functions over 5-word
    shingles count as copies; the row with the smallest id stays.
    """
    kinds = dict(rows.dtypes)

    def make():
        signer = Signer(5, rounds, 23)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            least = np.stack([signer.minima(signer.set_of(t)) for t in batch.column(1).to_pylist()]).view(np.int64)
            out = {"id": batch.column(0), "text": batch.column(1), "toxic": batch.column(2)}
            return out | {f"h{i}": pa.array(least[:, i]) for i in range(rounds)}

        return work

    schema = f"id {kinds['id']}, text string, toxic boolean, " + ", ".join(f"h{i} long" for i in range(rounds))
    out = map_batches(rows.select("id", "text", "toxic"), make, schema)
    for i in range(rounds):
        first = W.partitionBy(f"h{i}").orderBy("id")
        out = out.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return out.select("id", "text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and probabilities from the labelled rows of ``docs``."""
    marked = labels.where("toxic is not null").groupBy(F.col(id_col).alias("id")).agg((F.max("toxic") == 1).alias("toxic"))
    marked = sample(marked, sample_rows, "id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marked, "id")
    rows = without_copies(rows).persist()
    toxic, clean = (rows.where(c).count() for c in ("toxic", "not toxic"))
    entries: list[str] = []
    if toxic and clean:
        share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
        terms = term_counts(rows).where((F.col("toxic") >= 4) & (share >= 0.8)).collect()
        entries = choose_entries(terms, toxic, clean)
    base = (0.5 * toxic + 0.5) / (toxic + clean + 1.0)
    p: dict[tuple[int, int, bool], float] = {}
    if entries:
        found = match_rows(rows, entries).persist()
        none = {r["toxic"]: r["count"] for r in found.where(F.size("found") == 0).groupBy("toxic").count().collect()}
        base = (none.get(True, 0) + 0.5) / (none.get(True, 0) + none.get(False, 0) + 1.0)
        # an exact match counts wherever it is; a misspelled one where nothing is spelled exactly
        x = found.withColumn("exact", F.exists("found", lambda m: m.contains(",0,"))).select("toxic", "exact", F.explode("found").alias("m"))
        x = x.where(F.col("m").contains(",0,") | ~F.col("exact"))
        seen: dict[tuple[int, int, bool], list[int]] = {}
        for r in x.groupBy("m").agg(F.sum(F.col("toxic").cast("int")).alias("t"), F.count(F.lit(1)).alias("n")).collect():
            e, k, q = (int(v) for v in r["m"].split(","))
            seen[e, k, bool(q)] = [r["t"], r["n"]]
        for e in range(len(entries)):
            for k in (EXACT, FUZZY, FUZZY_START):
                a, b = PRIOR[k]
                t, n = seen.get((e, k, False), (0, 0))
                p[e, k, False] = (t + a) / (n + a + b)
                t, n = seen.get((e, k, True), (0, 0))
                p[e, k, True] = (t + 3 * QUOTED * p[e, k, False]) / (n + 3)
        found.unpersist()
    rows.unpersist()
    return Model(entries, p, min(base, 0.5))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), threshold: float = 0.7) -> DataFrame:
    """(doc_id, *keep, score, predicted) of every text. The model is as large as the lexicon, which the sample bounds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]

    def make():
        m = shared.value
        matcher = Matcher(m.entries)

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            scores = [m.score(matcher.find(t)) for t in batch.column(len(names)).to_pylist()]
            out = {n: batch.column(i) for i, n in enumerate(names)}
            return out | {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())}

        return work

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", score double, predicted int"
    return map_batches(docs.select(*names, text_col), make, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Rows to learn from: crc32 of the id modulo 3 is not 1."""
    return labels.where(remainder("doc_id", 3) != 1)


def reject_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int, threshold: float = 0.7) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    model = learn(docs, training_labels(labels), sample_rows)
    schema = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        matcher = Matcher(m.entries)
        for part in sliced(batches):
            keep = [m.score(matcher.find(t)) < threshold for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)
