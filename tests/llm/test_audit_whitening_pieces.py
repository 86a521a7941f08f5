"""Filter audit, whitening and piece encoding against brute force and the library."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, piece_encoding, queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# filter audit


def fails(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum(c.isascii() and c.isupper() for c in text) > 2 * len(text),
        "D": any(c in "#$%&*|" for c in text),
    }


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        f = fails(text or "")
        f["E"] = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((source or "", i, f))
    out = {}
    for part in {p for p, _, _ in rows}:
        mine = [(i, f) for p, i, f in rows if p == part]
        removed_in_all = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                removed_in_all[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[name] for _, f in mine) - len(gone), sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(removed_in_all[key[1][key[2] - 1]])
    return out


def audited(df):
    keys = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): [r[k] for k in keys] for r in rows}
    assert len(out) == len(rows)
    return out


def made_documents(seed, n):
    """Short documents of all kinds: copies, null and repeated ids, null and empty texts and sources."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "plain", "LOUD WORDS", "a # b", "x " * 300, "the LOUD $ one", " ".join(map(str, range(250))), " ".join(map(str, range(250))) + " %"]
    docs = [(rng.choice([None, *range(n)]), rng.choice(texts), rng.choice([None, "", "a", "b"])) for _ in range(n)]
    labels = [(rng.choice([None, *range(n)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(n)]
    return docs, labels


@pytest.mark.parametrize("seed", range(3))
def test_audit_equals_brute_force(spark, seed):
    docs, labels = made_documents(seed, 80)
    table = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in docs], SCHEMA).withColumns({"part": F.lit(1), "mask": F.lit("m"), "id": F.lit(2.5), "digest": F.lit(None)})
    got = audited(filter_audit.filter_audit(table.repartition(5), spark.createDataFrame(labels, LABELS).withColumn("good", F.lit("x"))))
    assert got == brute_audit(docs, labels)


def test_audit_of_given_documents(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert audited(queries.op11_filter_audit(spark, SF)) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert filter_audit.filter_audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(1, "word", "en", "s", 1)], SCHEMA)
    assert filter_audit.filter_audit(one, spark.createDataFrame([], LABELS)).count() == 120 * 5


def test_zeta_sums_over_subsets():
    counts = np.arange(2 * 16).reshape(2, 16) ** 2
    want = [[sum(int(row[t]) for t in range(16) if t & ~s == 0) for s in range(16)] for row in counts]
    assert filter_audit.zeta(counts).tolist() == want


def test_audit_refuses_too_many_filters(spark):
    with pytest.raises(ValueError, match="too many orders"):
        filter_audit.audit(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGHI")


# whitening


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_whitening(vectors, most):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, total = len(u), u.sum(axis=0)
    centred = u - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ axes / np.sqrt(values), values / (centred**2).sum() * n


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [3, 2.2, 1.5, 1, 0.7, 0.4]
    vectors = [*base.tolist(), *[base[7].tolist()] * 200]
    broken = [(9001, None, 0), (9002, [1.0] * 5 + [None], 0), (9003, [float("nan")] + [0.0] * 5, 0), (9004, [float("-inf")] + [0.0] * 5, 0), (9005, [], 0), (9006, [1.0] * 7, 0)]
    table = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)] + broken + [(None, vectors[0], 1)], VECTORS).repartition(7)
    got = whitening.whiten(table.withColumn("x", F.lit(1)).withColumn("id", F.lit("a")), most=4).collect()
    n, deviation, whitened, explained = brute_whitening(vectors, 4)
    assert len(got) == 4 * (len(vectors) + 1) and {r.vec_id for r in got} == {None, *range(len(vectors))}
    assert {r.n for r in got} == {n} and n == 300
    assert max(r.identity_error for r in got) < 1e-9
    signs = {}
    for r in got:
        i = 0 if r.vec_id is None else r.vec_id
        k = r.component - 1
        signs.setdefault(k, np.sign(whitened[i, k] * r.whitened))
        assert int(r.deviation) == int(deviation[i])
        assert r.whitened * signs[k] == pytest.approx(whitened[i, k], abs=1e-8)
        assert r.explained == pytest.approx(explained[k], rel=1e-9)


def test_chan_merge_is_the_moment_of_all(spark):
    x = np.random.default_rng(1).integers(900_000, 1_100_000, (100, 5))
    parts = [whitening.Moments.of(p) for p in np.array_split(x, [1, 3, 40, 77])]
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + parts[len(parts) // 2 * 2 :]
    whole = parts[0]
    assert whole.n == 100 and whole.total == x.sum(axis=0).tolist()
    assert np.allclose(whole.scatter, np.cov(x.T, bias=True) * 100, rtol=1e-10)


def test_whitening_without_variance_and_without_rows(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)], VECTORS)).collect()
    assert sorted((r.vec_id, r.component, r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same) == [(v, c, 0.0, 0.0, 0.0, 0) for v in (1, 2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 0) for i in range(4)], VECTORS)).collect()
    assert [r.whitened for r in line if r.component == 2] == [0.0] * 4 and line[0].identity_error < 1e-9
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).count() == 0


def test_deviations_of_huge_entries_are_exact(spark):
    big = [2.0**50, 1.0]
    got = whitening.whiten(spark.createDataFrame([(1, big, 0), (2, [0.0, 1.0], 0), (3, [1.0, 3.0], 0)], VECTORS)).collect()
    x = [[int(64 * c) + 1_000_000 for c in v] for v in (big, [0.0, 1.0], [1.0, 3.0])]
    total = [sum(c) for c in zip(*x, strict=True)]
    want = {i + 1: sum((3 * a - s) ** 2 for a, s in zip(v, total, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: int(r.deviation) for r in got} == want


# piece encoding


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return piece_encoding.Model(MODEL)


def made_texts(model, n, seed):
    rng = random.Random(seed)
    pieces = list(model.ids)
    odd = ["a", "b", " ", "  ", "e", "▁", "\n", "\t", "é", "ж", "한", "\U0001f916", "\x00", "th", "in", "﷽", "<s>", "<0x41>", "�"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4:
            yield "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        elif kind < 0.7:
            yield "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
        else:
            yield "".join(rng.choice("abcdeinorst ") for _ in range(rng.randint(0, 40)))


def test_pieces_equal_the_library(library, model):
    encoder, decoder = piece_encoding.Encoder(model), piece_encoding.Decoder(model)
    for text in [*made_texts(model, 4000, 11), "", " ", "a" * 3000, " " * 5000, "the" * 1000]:
        ids = library.encode(text)
        assert encoder.encode(text) == ids, text
        assert decoder.decode(ids) == library.decode(ids), text


def test_decoding_of_any_ids_equals_the_library(library, model):
    decoder, rng = piece_encoding.Decoder(model), random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(300), 259, 28705]) for _ in range(rng.randint(0, 8))]
        assert decoder.decode(ids) == library.decode(ids), ids


def test_last_token_of_every_prefix_is_unique(model):
    """Of the pieces that end at a place exactly one is compatible, and it ends the encoding of the prefix."""
    encoder = piece_encoding.Encoder(model)
    for text in itertools.islice(made_texts(model, 300, 4), 300):
        part = model.prefix + "".join(c for c in text.replace(" ", "▁") if c in model.ids)
        last = {0: None}
        for end in range(1, len(part) + 1):
            fits = [p for p in (part[s:end] for s in range(max(0, end - 16), end)) if p in model.ids and encoder.compatible(last[end - len(p)], p)]
            assert len(fits) == 1
            last[end] = fits[0]
            assert encoder.encode_part(part[:end])[-1] == model.ids[fits[0]]


def test_pieces_of_tables(spark, library):
    edge = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "one two"), (None, "x " * 30_000), (7, "ÀÉ \U0001f600 ß </s>")]
    table = spark.createDataFrame(edge, "doc_id long, text string").withColumns({"ids": F.lit(1), "decoded": F.lit("d"), "n_tokens": F.lit(0)})
    for df in (table, spark.read.parquet(f"{SF}/documents.parquet")):
        want = Counter()
        for r in df.collect():
            ids = library.encode(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
        assert Counter(tuple(r) for r in piece_encoding.encode_texts(df, MODEL).collect()) == want
    full = piece_encoding.encode_texts(table, MODEL, full=True).where("doc_id = 4").first()
    assert (full.ids, full.decoded) == (library.encode("one two"), "one two")
    assert piece_encoding.encode_texts(table.limit(0), MODEL).count() == 0


def test_short_memory_changes_nothing(model, library):
    parts = piece_encoding.Parts(model, limit=3, longest=4)
    text = "one two three four five one two three"
    assert [i for p in parts.encoder.split(text) for i in map(int, parts[p][1].split(","))] == library.encode(text)
