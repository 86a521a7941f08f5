"""The text operators against brute force, exact references and edge cases."""

import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import decontaminate, exact_dedup, html_extract, labelled_pages, language_id, mixing, near_dedup, queries, sharding, substring_dedup, token_count, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \t\n ", "en", "a", 5),
    (4, "one two three four five six seven", "en", "a", 1),
    (5, "one two three four five six seven", None, "b", 1),
    (5, "one two three four five six seven", None, "b", 1),
    (6, "x " * 20_000, "en", None, 1),
    (7, "ÀÉ \U0001f600 ß <|endoftext|>", "de", "a", 1),
    (8, "word", "en", "c", 1),
    (9, "", "en", "no words", 0),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({"id": F.lit("x"), "size": F.lit("y"), "node": F.lit(0), "digest": F.lit(1.5)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# token counts


def test_tokens_equal_the_library(spark, edge, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for table in (edge, docs):
        want = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
        got = token_count.count_tokens(table, path).collect()
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_tokens_of_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, counter = Tokenizer.from_file(path), token_count.Counter(token_count.MergeTable(path))
    texts = ["aaaaaaaaaaaaaaaa", "a\x1cb\x1fc", "it's I'LL we've", "x" * 3000, "<|startoftext|>a<|endoftext|>", "<|EndOfText|>", "ΑΣ ΣΑΣ", "é e　z", "１２３ ½", "don’t—stop…"]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_tokens_of_an_empty_table(empty):
    assert token_count.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# near duplicates


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        p, q = sets[a], sets[b]
        if p and q and 100 * len(p & q) >= percent * len(p | q):
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):  # groups of edited copies, with chains whose ends do not link
        text = rng.choice(words, 60).tolist()
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[int(rng.integers(60))] = str(rng.choice(words))
    rows += [(len(rows) + i, " ".join(rng.choice(words, int(rng.integers(1, 9))))) for i in range(40)]
    rows += [(500, None), (501, ""), (502, rows[0][1])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent).collect()
    want = brute_components(rows, size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("pairs_up_to", [2, 100])
def test_families_with_links_that_pass_the_centre_by(spark, pairs_up_to):
    """Copies of one text edited lightly and heavily; some heavy ones share edits, so that they link with each other only."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(120):
        w = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            w[at] = f"e{i}x{at}"
        rows.append((len(rows), " ".join(w)))
    for g in range(6):
        w = list(base)
        for at in rng.choice(150, 12, replace=False):
            w[at] = f"shared{g}x{at}"
        for k in range(4):
            v = list(w)
            v[int(rng.integers(150))] = f"own{g}y{k}"
            rows.append((len(rows), " ".join(v)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, percent=85, pairs_up_to=pairs_up_to).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


def test_near_duplicates_broadcast_no_table_that_grows(spark, monkeypatch):
    """Left to itself, Spark takes exploded rows and compressed files for small and sends them through the driver."""
    plans, write = [], near_dedup.Scratch.write

    def watched(scratch, df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(scratch, df)

    monkeypatch.setattr(near_dedup.Scratch, "write", watched)
    texts = [" ".join(f"w{i}" if i % 17 != k else f"x{k}" for i in range(120)) for k in range(17)]
    near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert any("SortMergeJoin" in line for line in joins)
    # But for the centres of groups that are still split: one row for each, which only the right side of the semi join can be.
    assert all("SortMergeJoin" in line or "[centre#" in line and "LeftSemi, BuildRight" in line for line in joins), joins


def test_no_plan_of_near_duplicates_holds_many_steps(spark, monkeypatch):
    """The driver keeps a plan anew for every stage of it that ends, so its memory grows with the square of a plan."""
    joins, write = [], near_dedup.Scratch.write

    def watched(scratch, df):
        joins.append(df._jdf.queryExecution().sparkPlan().toString().count("Join "))
        return write(scratch, df)

    monkeypatch.setattr(near_dedup.Scratch, "write", watched)
    texts = [" ".join(f"w{i}" if i % 17 != k else f"x{k}" for i in range(120)) for k in range(17)]
    near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert max(joins) <= 6, joins


def test_near_duplicates_of_edge_rows(edge, empty):
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(edge, size=3, percent=85).collect()}
    assert got[5] == 4 and got[1] == 1 and got[2] == 2 and got[3] == 3
    assert near_dedup.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id for r in near_dedup.keep_one(edge).collect()) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven"
    rows = spark.createDataFrame([(1, a), (1, b), (2, b), (7, c), (7, c), (None, a), (None, "x y z"), (3, "x y z q")], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect())
    assert got == Counter({(1, 1, True): 2, (2, 1, False): 1, (7, 7, True): 2, (None, 1, False): 1, (None, None, True): 1, (3, 3, True): 1})
    assert Counter((r.doc_id, r.text) for r in near_dedup.keep_one(rows).collect()) == Counter({(1, a): 1, (1, b): 1, (7, c): 2, (None, "x y z"): 1, (3, "x y z q"): 1})


def test_masked_keys_find_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    radius = near_dedup.radius_for(0.85, 48, 5e-4)
    chunks = near_dedup.chunks_for(48, radius)
    assert sorted(itertools.chain(*chunks)) == list(range(48))
    for _ in range(2000):
        wrong = set(rng.choice(48, radius, replace=False).tolist())
        assert min(len(wrong & set(c)) for c in chunks) <= 1


@pytest.mark.parametrize("symbols", [48, 7])
def test_hamming_counts_differing_symbols(spark, symbols):
    from pyspark.sql import functions as F

    signer = near_dedup.Signer(3, symbols, 5)
    sets = [np.arange(a, a + 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for a in range(0, 60, 3)]
    minima = [near_dedup.mix64(signer.minima(s)) >> np.uint64(48) for s in sets]
    packed = [signer.signature(s).tolist() for s in sets]
    rows = [(i, j, packed[i], packed[j]) for i in range(len(sets)) for j in range(len(sets))]
    frame = spark.createDataFrame(rows, "i int, j int, x array<long>, y array<long>")
    for r in frame.select("i", "j", near_dedup.hamming(F.col("x"), F.col("y"), symbols).alias("d")).collect():
        assert r.d == int((minima[r.i] != minima[r.j]).sum())


# exact duplicates


def brute_exact(rows):
    import hashlib
    import re

    by = defaultdict(list)
    for r in rows:
        by[re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")].append(r[0])
    return Counter((i, min(v), len(v), i == min(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in by.items() for i in v)


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_duplicates_even_if_digests_collide(spark, edge, tmp_path, bits):
    rows = [*EDGE, *[(100 + i, f"text number {i % 90}", "en", "a", 1) for i in range(300)]]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    got = exact_dedup.exact_duplicates(spark, path, digest_bits=bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute_exact(rows)


def test_exact_duplicates_with_null_and_repeated_ids(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(None, "q"), (3, "q"), (7, "r"), (7, "r"), (8, "r"), (None, "s"), (None, "s")], "doc_id long, text string").repartition(3).write.parquet(path)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark, path).collect())
    assert got == Counter({(None, 3, 2, False): 1, (3, 3, 2, True): 1, (7, 7, 3, True): 2, (8, 7, 3, False): 1, (None, None, 2, True): 2})


def test_exact_duplicates_of_an_empty_table(spark, empty, tmp_path):
    path = str(tmp_path / "documents.parquet")
    empty.write.parquet(path)
    assert exact_dedup.exact_duplicates(spark, path).count() == 0


# mixing


def brute_targets(size):
    names = sorted((n for n in size if n is not None), key=lambda n: n.encode()) + ([None] if None in size else [])
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[n] for n in capped)
        open_ = [n for n in names if n not in capped]
        share = {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if share[n] > 3 * size[n]}
        if not over:
            return {n: 3.0 * size[n] if n in capped else share[n] for n in names}
        capped |= over


def test_mix_targets_and_takes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), str(rng.choice(["a", "b", "c", "d"], p=[0.7, 0.2, 0.08, 0.02]))) for i in range(3000)] + [(9001, None, None), (9002, "x y", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d, shard_docs=200).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(6, 0.01 * t), (s, taken[s], t)
    again = mixing.mix(d.repartition(7), shard_docs=200).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def repeated_documents(spark):
    """Ids with several texts, rows that repeat, null ids; a source that is taken 3 times and one that is cut."""
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 150)), " ".join(["w"] * int(rng.integers(1, 60))) + f" {rng.integers(0, 3)}", str(rng.choice(["a", "b", "c"], p=[0.7, 0.28, 0.02]))) for _ in range(1500)]
    rows += [(None, "null id", "a")] * 7 + [(3, "again and again", "b")] * 40 + [(3, "again and again", "a")] * 40
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_reruns_agree_where_ids_repeat(spark):
    d, _ = repeated_documents(spark)
    runs = [Counter(tuple(r) for r in mixing.mix(d.repartition(n), shard_docs=200).select("doc_id", "source", "size", "taken").collect()) for n in (1, 7, 13)]
    assert runs[0] == runs[1] == runs[2]
    kept = [Counter(tuple(r) for r in mixing.apply_mix(d.repartition(n), shard_docs=200).collect()) for n in (1, 7)]
    assert kept[0] == kept[1]


def test_rows_that_repeat_are_taken_as_often_as_the_mix_says(spark):
    d, _ = repeated_documents(spark)
    want = Counter()
    for r in mixing.placed(d, [1, 2, 3], 3, 17, 200, "doc_id", "text", "source").collect():
        want[r.id, r.source, r.digest] += round(r.taken / r.size + 1e-12)
    got = Counter()
    for r in mixing.apply_mix(d, shard_docs=200).withColumn("digest", F.md5("text")).collect():
        got[r.doc_id, r.source, r.digest] += 1
    assert got == Counter({k: v for k, v in want.items() if v})


def test_mix_of_edge_rows(edge, empty):
    assert mixing.mix(edge).count() == len(EDGE)
    assert mixing.mix(empty).count() == 0
    assert mixing.apply_mix(edge).columns == edge.columns


def test_quotas_are_sainte_lague(spark):
    sizes = [530, 240, 110, 60, 30, 20, 10]
    d = spark.createDataFrame([("s", i, n, sum(sizes), 21.0, 1) for i, n in enumerate(sizes)], "source string, shard long, words long, source_size long, target double, block long")
    got = [r.quota for r in mixing.shard_quotas(d, 3).orderBy("shard").collect()]
    seats = [0] * len(sizes)
    for _ in range(21):
        best = max(range(len(sizes)), key=lambda i: (sizes[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    assert got == seats


# sharding


def test_shards_are_even_and_copies_stay_together(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "t" * int(rng.integers(1, 400)) + str(i % 1500), "en", f"s{i % 5}", 1) for i in range(4000)]
    rows += [(5000 + i, "copy" * 50, "de", "s0", 1) for i in range(300)] + [(9000, None, None, None, None)]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 8).collect()
    assert len(got) == len(rows)
    weight, slots, where = Counter(), defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        t = text[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        weight[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert set(weight) == set(range(8))
    assert max(weight.values()) <= 1.03 * min(weight.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(s) > 1 for s in where.values()) == 0


def test_a_group_larger_than_a_shard_is_dealt_out(spark):
    rows = [(i, "same text" if i % 3 else f"text {i} " + "z" * (i % 7), "en", "s", 1) for i in range(3000)]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 8).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    assert len(got) == 8 and max(r.w for r in got) <= 1.1 * min(r.w for r in got)


def test_a_heavy_group_at_the_cut_stays_whole(spark):
    """A tenth of all bytes are copies of one text, which lies at the median of every dimension."""
    rows = [(i, "t" * 200 + f"{i:05}", "en", "s", 1) for i in range(1800)] + [(5000 + i, "c" * 205, "en", "s", 1) for i in range(200)]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 4).collect()
    weight = Counter()
    for r in got:
        weight[r.shard] += r.size
    assert len(got) == 2000 and max(weight.values()) <= 1.02 * min(weight.values())
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1


def test_cuts_are_weighted_medians(spark):
    """The tree against one built in memory: same dimension and the same halves at the root."""
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(rng.integers(1, 3000)) + str(i), "en", "s", 1) for i in range(1000)]
    got = {r.doc_id: r.shard for r in sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    order = sorted(rows, key=lambda r: len(r[1]))
    total, left = sum(len(r[1]) + 1 for r in rows), 0
    for r in order:
        middle = left + (len(r[1]) + 1) / 2
        if abs(middle - total / 2) > 0.01 * total:
            assert got[r[0]] == (middle > total / 2)
        left += len(r[1]) + 1


def test_every_node_is_halved_along_one_dimension(spark):
    """The whole tree: at each node the two sides have equal bytes and do not overlap in some dimension."""
    rng = np.random.default_rng(12)
    rows = [(i, "x" * int(rng.integers(1, 900)) + f" {i}", "lang" + str(int(rng.integers(40))), "source" + str(int(rng.integers(400))), 1) for i in range(6000)]
    got = {r.doc_id: r.shard for r in sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 8).collect()}
    at = {d: {r[0]: v(r) for r in rows} for d, v in {"length": lambda r: len(r[1]), "source": lambda r: zlib.crc32(r[3].encode()), "lang": lambda r: zlib.crc32(r[2].encode())}.items()}
    weight = {r[0]: len(r[1]) + 1 for r in rows}
    used = set()
    for width in (4, 2, 1):
        for first in range(0, 8, 2 * width):
            left = [i for i, s in got.items() if first <= s < first + width]
            right = [i for i, s in got.items() if first + width <= s < first + 2 * width]
            a, b = sum(weight[i] for i in left), sum(weight[i] for i in right)
            assert abs(a - b) <= 0.02 * (a + b)
            parted = [d for d, v in at.items() if max(v[i] for i in left) <= min(v[i] for i in right)]
            assert parted, (width, first)
            used |= set(parted)
    assert len(used) > 1


@pytest.mark.parametrize(("target", "leaves"), [(10**9, 1), (60_000, 8), (40_000, 8), (30_000, 16)])
def test_leaves_reach_the_target_bytes(spark, target, leaves):
    rows = [(i, "t" * (i % 200) + str(i), "en", f"s{i % 7}", 1) for i in range(2500)]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), target_bytes=target).groupBy("shard").agg(F.sum("size").alias("w")).collect()
    assert len(got) == leaves and max(r.w for r in got) <= 1.02 * target
    with pytest.raises(ValueError, match="power of two"):
        sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 7)


def test_shards_of_edge_rows(edge, empty):
    assert sharding.kd_shards(edge, 2).count() == len(EDGE)
    assert sharding.kd_shards(empty, 8).count() == 0


# toxicity


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    terms = ["idiot", "scum", "worthless", "moron"]
    machine = toxicity.Automaton(terms)
    rng = np.random.default_rng(4)
    for term in terms:
        for _ in range(300):
            w = list(term)
            for _ in range(int(rng.integers(0, 4))):
                at, kind = int(rng.integers(0, len(w) + 1)), rng.integers(3)
                if kind == 0:
                    w.insert(at, "x")
                elif at < len(w):
                    w[at : at + 1] = [] if kind == 1 else ["q"]
            w = "".join(w)
            found = machine.match(w)
            exact = any(w.startswith(t) for t in terms)
            near = any(distance(w, t) <= toxicity.allowed(len(t)) for t in terms)
            begins = any(distance(w[:n], t) <= toxicity.allowed(len(t)) for t in terms for n in range(len(w) + 1))
            if exact:
                assert found[1] == toxicity.EXACT
            elif near:
                assert found[1] == toxicity.FUZZY
            else:
                assert (found is not None) == begins


def test_toxicity_separates_quotation(spark):
    rng = np.random.default_rng(8)
    words = [f"calm{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choice(words, 30).tolist()
        if i % 6 == 0:
            text[int(rng.integers(30))] = "blockhead"
            labels.append((i, 1))
        elif i % 6 == 1:
            text[10] = '"blockhead"'
            labels.append((i, 0))
        else:
            labels.append((i, 0))
        rows.append((i, " ".join(text)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(d, lab.withColumn("text", F.lit("clash")), 10_000)
    assert any("blockhead".startswith(e) or e == "blockhead" for e in model.entries)
    test = spark.createDataFrame([(1, "calm1 calm2 blockhead calm3"), (2, "calm1 blokhead calm2"), (3, 'calm1 "blockhead" calm2'), (4, "calm1 calm2"), (5, None), (6, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(test, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 1
    assert got[3].score < got[1].score and got[3].predicted == 0
    assert got[4].predicted == got[5].predicted == got[6].predicted == 0 and got[5].score == got[6].score


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted, r.score) for r in queries.op3_toxicity(spark, folder).collect() if r.held_out and r.doc_id in truth]
    hit = sum(t and p for t, p, _ in held)
    assert len(held) > 500 and all(0 <= s <= 1 and p == (s >= 0.7) for _, p, s in held)
    assert hit >= 0.85 * sum(p for _, p, _ in held) and hit >= 0.85 * sum(t for t, _, _ in held), (len(held), hit, sum(p for _, p, _ in held), sum(t for t, _, _ in held))


def test_toxicity_without_labels(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(edge, none, 100)
    assert toxicity.score(edge, model).count() == len(EDGE)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.reject_toxic(edge, none, 100).columns == edge.columns


# language


def test_language_held_out_accuracy(spark):
    out = queries.op10_language(spark, SF)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [(r.lang_pred == truth[r.doc_id]) for r in out.collect() if r.held_out]
    assert held and sum(held) / len(held) >= 0.95


def test_language_of_edge_rows(edge, empty):
    filters = language_id.learn(edge)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(edge, filters).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    none = language_id.learn(empty)
    assert {r.lang_pred for r in language_id.identify(edge, none).collect()} == {"und"}


def test_seventy_languages_are_all_learned(spark):
    rng = np.random.default_rng(12)
    rows, truth = [], {}
    for k in range(70):
        parts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(12)]
        for _ in range(40):
            i = len(rows)
            truth[i] = f"l{k:02}"
            rows.append((i, " ".join("".join(rng.choice(parts, 2)) for _ in range(30)), truth[i]))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.learn(d.where("doc_id % 40 > 5"))
    assert filters.languages == sorted(set(truth.values())) and len(filters.slots) == 2
    got = language_id.identify(d.where("doc_id % 40 <= 5"), filters).collect()
    assert {r.lang_pred for r in got} == set(filters.languages)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) >= 0.98


def test_all_ngrams_of_very_long_texts_count():
    rng = np.random.default_rng(13)
    text = "".join(rng.choice(list("abc de"), 450_000))
    plain = language_id.letters_of(text)
    whole = Counter(tuple(plain[i : i + n].tolist()) for n in language_id.SIZES for i in range(len(plain) - n + 1))
    codes = Counter(language_id.grams(text).tolist())
    assert sorted(codes.values()) == sorted(whole.values())


def test_a_rare_language_is_sampled(spark):
    d = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("often").alias("lang"))
    by = {r.lang: r["count"] for r in language_id.sample(d, 400).groupBy("lang").count().collect()}
    assert by["rare"] == 5 and 120 < by["often"] < 280


# benchmark leaks


def test_leaks_equal_a_full_search(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 7)))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(3, 50))))) for i in range(12)] + [(50, None), (51, "")]
    rows, planted = [], set()
    for i in range(60):
        w = rng.choice(words, 80).tolist()
        if i % 2:
            item, text = items[i % 12]
            piece = text.split()
            if len(piece) > 20 and i % 4 == 1:
                piece[int(rng.integers(len(piece)))] = "zzz"
            w[30:30] = [x.upper() if i % 3 else x for x in piece]
            planted.add((i, item))
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, "")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}

    full = {(i, k) for i, t in rows for k, x in items if x and t and full_distance(x, t) <= 0.2 * len(x)}
    assert planted <= got
    assert got <= full and len(got) >= 0.95 * len(full)
    clean = decontaminate.remove_leaks(d.withColumn("item_id", F.lit(1)), b)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in got}


def full_distance(item, text):
    """Fewest edits between the item and any part of the text, cell by cell in rows."""
    return plain_distance(*(" ".join(t.lower().split()) for t in (item, text)))


def plain_distance(item, text):
    item, text = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (item, text))
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, c in enumerate(item, 1):
        new = np.append(i, np.minimum(row[:-1] + (text != c), row[1:] + 1))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_bit_parallel_distance_equals_the_full_one():
    rng = np.random.default_rng(15)
    for _ in range(300):
        item, text = ("".join(rng.choice(list("ab cé"), int(rng.integers(1, n)))) for n in (90, 200))
        item, text = " ".join(item.split()) or "a", " ".join(text.split())
        edits, end = decontaminate.scan(item, text)
        assert edits == plain_distance(item, text)
        edits, a, b = decontaminate.best_part(item, text, len(item))
        assert b in (end, 0) and plain_distance(item, text[a:b]) == edits


def test_leaks_at_the_edges_of_texts():
    """Items whose first or last words are cut off, at the edge of every text of a group."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(900)]
    items = [(i, " ".join(rng.choice(words, 40, replace=False))) for i in range(12)]
    finder = decontaminate.Finder(decontaminate.Index(items))
    for missing in range(5):
        front = [" ".join(x.split()[missing:] + rng.choice(words, 50).tolist()) for _, x in items]
        back = [" ".join(rng.choice(words, 50).tolist() + x.split()[: 40 - missing]) for _, x in items]
        found = {(r[0], r[1]): r for r in finder.find([*front, *back])}
        for text, (item, x) in enumerate(items + items):
            assert (text, item) in found, (missing, text)
            lost = x.split()[:missing] if text < 12 else x.split()[40 - missing :]
            assert found[text, item][2] <= sum(len(w) + 1 for w in lost)
            first, n = found[text, item][4:]
            assert abs(first - (0 if text < 12 else 50)) <= missing and abs(n - 40) <= 5


def typos(text, rate, rng):
    letters = list(text)
    for i in sorted(rng.choice(len(letters), max(1, int(rate * len(letters))), replace=False).tolist(), reverse=True):
        letters[i : i + (rng.integers(3) > 0)] = [str(rng.choice(list("abcdefghijklmnop")))] * int(rng.integers(2))
    return "".join(letters)


def replaced(text, rate, rng):
    """Words replaced, until that part of the letters is."""
    words, used = text.split(), 0
    for i in rng.permutation(len(words)).tolist():
        if used + len(words[i]) <= rate * len(text):
            used += len(words[i])
            words[i] = "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 8))))
    return " ".join(words)


def one_in(text, every, rng):
    words = text.split()
    for i in range(every // 2, len(words), every):
        at = int(rng.integers(len(words[i])))
        words[i] = words[i][:at] + "z" + words[i][at + 1 :]
    return " ".join(words)


EDITS = [(typos, 0.05), (typos, 0.1), (typos, 0.15), (typos, 0.2), (replaced, 0.05), (replaced, 0.1), (replaced, 0.15), (replaced, 0.2), (one_in, 4), (one_in, 2), (one_in, 1)]


@pytest.mark.parametrize(("edit", "rate"), EDITS)
def test_leaks_reach_the_recall_of_a_full_search(edit, rate):
    """Items of the given table, of 15 to 59 words, edited: at least 0.95 of those that a full search finds are found."""
    import pyarrow.parquet as pq

    rng = np.random.default_rng(21)
    items = [(r["item_id"], " ".join(r["text"].lower().split())) for r in pq.read_table("/root/testdata/sf0.1/benchmark.parquet").to_pylist() if r["text"]]
    other = [x for _, x in items]
    texts = [f"{other[i - 1][:150]} {edit(x, rate, rng)} {other[i - 2][:150]}" for i, (_, x) in enumerate(items)]
    near = {(i, k) for i, (k, x) in enumerate(items) if full_distance(x, texts[i]) <= 0.2 * len(x)}
    found = {(r[0], r[1]) for r in decontaminate.Finder(decontaminate.Index(items)).find(texts)}
    assert len(near) > 20 and len(near - found) <= 0.05 * len(near), (len(near), len(near - found))


TEMPLATES = [
    "what is the capital city of the country named {}?",
    "{} is the name of which river, lake or mountain on the continent?",
    "if {} apples are shared equally between {} children, how many apples does every child get and how many are left over?",
]


@pytest.mark.parametrize("template", TEMPLATES)
@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15])
def test_items_of_one_template_are_found(template, rate):
    """Against a full search, for 30 items made from one template beside 60 others: 0.95 of all pairs, and each document's own item."""
    rng = np.random.default_rng(int(rate * 100) + len(template))
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(n))
    items = [(i, template.format(word(1), word(1))) for i in range(30)] + [(100 + i, word(14)) for i in range(60)]
    texts = [f"{word(20)} {typos(x, rate, rng) if rate else x} {word(20)}" for _, x in items[:30]]
    near = {(t, i) for t, text in enumerate(texts) for i, x in items if full_distance(x, text) <= 0.2 * len(x)}
    found = {(r[0], r[1]) for r in decontaminate.Finder(decontaminate.Index(items)).find(texts)}
    assert found <= near and len(near - found) <= 0.05 * len(near), (len(near), len(near - found))
    own = {(t, t) for t in range(30)} & near
    assert len(own - found) <= (0 if rate <= 0.05 else 1)


@pytest.mark.parametrize("copies", [3, 5, 40])
@pytest.mark.parametrize("size", [4, 7, 15])
def test_items_that_stand_several_times_are_found_under_every_id(spark, copies, size):
    rng = np.random.default_rng(copies)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(n))
    plain = [word(size) for _ in range(20)]
    items = [(k * 100 + i, x.upper() if k % 2 else x) for i, x in enumerate(plain) for k in range(copies)]
    texts = [f"{word(10)} {x} {word(10)}" for x in plain]
    found = {(r[0], r[1]) for r in decontaminate.Finder(decontaminate.Index(items)).find(texts)}
    assert {(i, k * 100 + i) for i in range(20) for k in range(copies)} <= found


@pytest.mark.parametrize("copies", [3, 6])
def test_near_copies_of_items_are_found(copies):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(copies)
    given = [" ".join(r["text"].lower().split()) for r in pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist() if r["text"]][:25]
    items = [(100 * k + i, typos(x, 0.06, rng) if k else x) for i, x in enumerate(given) for k in range(copies)]
    texts = [f"{given[i - 1][:80]} {typos(x, 0.08, rng)} {given[i - 2][:80]}" for i, x in enumerate(given)]
    near = {(t, i) for t, text in enumerate(texts) for i, x in items if full_distance(x, text) <= 0.2 * len(x)}
    found = {(r[0], r[1]) for r in decontaminate.Finder(decontaminate.Index(items)).find(texts)}
    assert found <= near and len(near - found) <= 0.01 * len(near), (len(near), len(near - found))


def test_blocks_shipments_and_one_index_find_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    blocks = sorted(map(tuple, decontaminate.leaks(docs, bench, block_items=7).collect()))
    monkeypatch.setattr(decontaminate, "SHIPPED", 1)
    shipped = sorted(map(tuple, decontaminate.leaks(docs, bench, block_items=9).collect()))
    assert one == blocks == shipped and one
    kept = {r.doc_id for r in decontaminate.remove_leaks(docs, bench, block_items=9).collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} - {r[0] for r in one}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8])
def test_short_items_are_found(size):
    rng = np.random.default_rng(size)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9))))
    items = [(i, " ".join(word() for _ in range(size))) for i in range(40)]
    texts = [" ".join([word() for _ in range(20)] + [x.upper() + ","] + [word() for _ in range(20)]) for _, x in items]
    found = {(r[0], r[1]) for r in decontaminate.Finder(decontaminate.Index(items)).find(texts)}
    assert {(i, i) for i in range(40)} <= found


def test_leaks_of_edge_tables(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(edge, none).count() == 0
    one = spark.createDataFrame([(1, "three four five six")], "item_id long, text string")
    assert decontaminate.leaks(empty, one).count() == 0
    assert {r.doc_id for r in decontaminate.leaks(edge, one, block_items=1).collect()} == {4, 5}


# repeated passages


def test_repeats_find_shared_passages_and_only_those(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    passage = " ".join(word() for _ in range(60))
    short = " ".join(word() for _ in range(20))
    rows = []
    for i in range(80):
        w = [word() for _ in range(200)]
        at = int(rng.integers(1, 199))
        w[at:at] = [passage] if i % 4 == 0 else [short] if i % 4 == 1 else []
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a" * 30_000)]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == {i for i in range(4, 80) if i % 4 == 0}
    text = dict(rows)
    for r in got:
        assert passage.encode() == text[r.doc_id].encode()[r.begin : r.end]
        assert text[r.origin_id].encode()[r.origin_begin :].startswith(passage.encode()[: r.end - r.begin])
    cut = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(got))
    assert sum(passage in (r.text or "") for r in cut.collect()) == 1


def test_repeats_meet_a_holder_of_the_whole(spark):
    """Earlier excerpts of under 50 words, or an earlier place in the same document, do not hide a longer passage."""
    rng = np.random.default_rng(10)
    rows, want, number = [], set(), 0
    for _ in range(12):
        word = lambda n: ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) for _ in range(n)]
        n = int(rng.integers(50, 62))
        whole = word(n)
        excerpts = [whole[: n - 15], whole[15:], whole[:40] + word(30) + whole, whole, whole]
        if number % 2:
            excerpts[2] = whole[5:49]
        for k, piece in enumerate(excerpts):
            rows.append((number + k, " ".join(word(40) + piece + word(40))))
        holder = number + 3 if number % 2 else number + 2
        want |= {(i, holder) for i in range(holder + 1, number + 5)}
        number += 5
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.origin_id) for r in got} == want
    text = dict(rows)
    for r in got:
        assert r.n_words >= 50 and text[r.doc_id].encode()[r.begin : r.end] == text[r.origin_id].encode()[r.origin_begin :][: r.end - r.begin]


@pytest.mark.parametrize("min_words", [5, 12])
def test_repeats_cover_what_a_full_search_finds(spark, min_words):
    rng = np.random.default_rng(min_words)
    pool = [rng.choice(list("abcdefgh"), 30).tolist() for _ in range(6)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(4):
            a, n = int(rng.integers(0, 20)), int(rng.integers(2, 25))
            parts += pool[int(rng.integers(6))][a : a + n] + [f"w{i}{len(parts)}"]
        rows.append((i, "".join(w + str(rng.choice([" ", " ", "  ", "\n"])) for w in parts)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    covered = defaultdict(set)
    for r in substring_dedup.repeats(d, min_words=min_words).collect():
        assert r.origin_id < r.doc_id and r.n_words >= min_words
        covered[r.doc_id] |= set(range(r.begin, r.end))
    seen = set()
    for i, text in rows:
        ends = [m for m in range(len(text)) if text[m] not in " \n" and (m + 1 == len(text) or text[m + 1] in " \n")]
        starts = [m for m in range(len(text)) if text[m] not in " \n" and (m == 0 or text[m - 1] in " \n")]
        windows = [(a, b + 1) for a, b in zip(starts, ends[min_words - 1 :], strict=False)]
        for a, b in windows:
            assert text[a:b] not in seen or set(range(a, b)) <= covered[i]
        seen |= {text[a:b] for a, b in windows}


@pytest.mark.parametrize("min_words", [4, 5, 12, 17, 18, 50, 73])
def test_every_passage_holds_a_chunk_and_insertions_move_no_others(min_words):
    """All chunks of a passage that lie inside it are found again wherever the passage stands, and there is one."""
    rng, known = np.random.default_rng(min_words), substring_dedup.WordIds()
    inside, memory, width = substring_dedup.reach(min_words)
    for alphabet in (2, 9, 500):
        word = lambda n: [f"w{int(k)}" for k in rng.integers(0, alphabet, n)]  # noqa: B023, E731
        for _ in range(30):
            passage = word(inside)
            seen = []
            for left, right in ((0, 0), (1, 40), (37, 0), (int(rng.integers(60)), int(rng.integers(60)))):
                text = " ".join(["a" + str(int(k)) for k in rng.integers(0, 99, left)] + passage + ["z" + str(int(k)) for k in rng.integers(0, 99, right)])
                digest, first, last = substring_dedup.chunks(substring_dedup.Words(text.encode(), known), min_words)
                held = (first >= left) & (last <= left + inside)
                seen.append(list(zip(digest[held].tolist(), (first[held] - left).tolist(), (last[held] - left).tolist(), strict=True)))
            assert seen[0] and all(x == seen[0] for x in seen)
            assert all(b - a <= memory - 1 + 3 * width - 1 for _, a, b in seen[0])


def test_chunks_around_an_insertion_stay():
    rng, known = np.random.default_rng(3), substring_dedup.WordIds()
    words = [f"w{int(k)}" for k in rng.integers(0, 5000, 4000)]
    digests = lambda ws: set(substring_dedup.chunks(substring_dedup.Words(" ".join(ws).encode(), known), 50)[0].tolist())
    before, after = digests(words), digests(words[:2000] + ["inserted"] + words[2000:])
    assert len(before) > 500 and len(before - after) <= 12 and len(after - before) <= 12


def test_a_common_origin_is_dealt_out(spark, monkeypatch):
    """An origin with more pairs than a part has: the same rows from any number of parts."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} own{i} " + " ".join(f"x{i}_{j}" for j in range(20))) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, substring_dedup.repeats(d).collect()))
    monkeypatch.setattr(substring_dedup, "PAIRS", 4)
    assert sorted(map(tuple, substring_dedup.repeats(d).collect())) == whole and {(r[0], r[1]) for r in whole} == {(i, 0) for i in range(1, 30)}


def test_repeats_of_edge_rows(edge, empty):
    assert substring_dedup.repeats(empty).count() == 0
    assert {(r.doc_id, r.origin_id) for r in substring_dedup.repeats(edge, min_words=5).collect()} <= {(5, 4)}


# main text

PAGE = """<html><body><header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a>Home</a></nav>
<main><article><header><h1>Title &amp; more</h1></header><p>One two three four five six seven.<p>Unclosed <a href="x">link</a> here
<div class="ad-slot">Buy now</div><form><label>Email</label><input></form><p>Second  paragraph
 here <em>now</em>.</p><ul><li>a b c<li>d e f</ul><script>var x = "<p>no</p>";</script><style>p{}</style></article>
<section class="comments"><p>Nice article I liked it very much indeed and so on and on</p></section></main><aside><p>related stuff</p></aside><footer>c</footer>"""


@pytest.fixture(scope="module")
def weights():
    return queries.page_weights()


def test_relearning_gives_the_saved_weights(weights):
    again = html_extract.learn(labelled_pages.labelled_pages())
    assert again.word.keys() == weights.word.keys() and again.tag == pytest.approx(weights.tag, abs=1e-4)
    assert max(abs(v - weights.word[k]) for k, v in again.word.items()) < 0.01 and np.abs(again.shape - weights.shape).max() < 0.01


@pytest.mark.parametrize("name", ["comment", "comments", "sidebar", "ad", "footer", "related", "form"])
def test_an_article_under_a_misleading_name_stays(weights, name):
    article = "".join(f"<p>{PROSE[3:-4]} Paragraph {i} says more.</p>" for i in range(8))
    page = f'<body><nav><ul>{"".join(f"<li><a href=x>menu {i}</a></li>" for i in range(6))}</ul></nav><div class="{name}"><h1>A title of the page</h1>{article}</div><footer><p>copyright</p></footer></body>'
    assert html_extract.extract(page, weights).count("says more") == 8


def test_linked_references_in_an_article_stay_and_comments_beside_it_go(weights):
    article = "".join(f"<p>{PROSE[3:-4]} Paragraph {i}.</p>" for i in range(6))
    references = "".join(f"<li><a href=x>Reference number {i} with some words of title</a></li>" for i in range(8))
    comments = "".join(f"<p>I think that comment {i} is what a reader would write here, more or less.</p>" for i in range(6))
    page = f'<body><article><h1>A title</h1>{article}<h2>Sources</h2><ul>{references}</ul></article><div class="qzx7">{comments}</div><footer>x</footer></body>'
    text = html_extract.extract(page, weights)
    assert text.count("Reference number") == 8 and "reader would write" not in text


def test_main_text_of_a_page(weights):
    assert html_extract.extract(PAGE, weights) == "Title & more\nOne two three four five six seven.\nUnclosed link here\nSecond paragraph here now.\na b c\nd e f"
    assert html_extract.extract(None, weights) == html_extract.extract("", weights) == html_extract.extract("<p", weights) == ""


def test_main_text_of_labelled_pages(weights):
    """Layouts not learned from, many of them with parts that only their form tells apart."""
    both = got_words = main_words = 0
    for p, main in labelled_pages.labelled_pages(200, seed=99):
        got, want = Counter(html_extract.extract(p, weights).split()), Counter(" ".join(main).split())
        both += (got & want).total()
        got_words += got.total()
        main_words += want.total()
    assert both >= 0.98 * got_words and both >= 0.98 * main_words


def test_main_text_equals_the_articles_of_the_given_pages(weights):
    import html
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        parts = re.split(r"<[^>]+>", re.sub(r"</?(?:b|a|i)(?: [^>]*)?>", "", article))
        assert html_extract.extract(page, weights) == "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in parts) if x)


PROSE = "<p>This is a sentence of some words that goes on for a while, and then ends.</p>"


@pytest.mark.parametrize("name", ["more", "learn-more", "bottom-story", "text-banner notice-free", "x7"])
def test_articles_with_odd_names_stay_and_menus_with_unknown_names_go(weights, name):
    menu = "".join(f'<a href="/{i}">Entry number {i}</a>' for i in range(25))
    items = "".join(f'<li><a href="/{i}">Other {i}</a></li>' for i in range(25))
    page = f'<html><body><div class="k9">{menu}</div><div class="{name}"><h1>Some title here</h1>{PROSE * 6}</div><div class="z1"><ul>{items}</ul></div></body></html>'
    assert html_extract.extract(page, weights).split("\n") == ["Some title here"] + [PROSE[3:-4]] * 6


@pytest.mark.parametrize("part", ["aside", "form", "nav", "footer", "header", 'div class="ad"', 'div class="cookie-notice"', 'div id="related"', 'section class="comments"', "div hidden", 'div aria-hidden="true"', 'div style="color:red;display: none"'])
def test_other_parts_within_and_after_an_article_go(weights, part):
    other = f"<{part}>{PROSE.replace('This', 'Other')}</{part.split()[0]}>"
    page = f"<html><body><article><h1>Title</h1>{PROSE * 2}{other}{PROSE}<p>Of.</p></article>{other}</body></html>"
    assert html_extract.extract(page, weights).split("\n") == ["Title", *[PROSE[3:-4]] * 3, "Of."]


def test_what_only_looks_hidden_stays(weights):
    page = f'<html><body><article title="hidden" style="overflow:hidden" aria-hidden="false"><h1>Title</h1>{PROSE * 3}</article></body></html>'
    assert len(html_extract.extract(page, weights).split("\n")) == 4


def test_the_region_is_the_best_of_all(weights):
    for p, _ in labelled_pages.labelled_pages(40, seed=5):
        seen = html_extract.tokens(p)
        shape = {b: float(row @ weights.shape) for b, row in html_extract.look(seen).items()}
        run = lambda t: isinstance(t, html_extract.Run)
        score = [weights.score(t.around, shape.get(t.block, 0.0)) if run(t) else None for t in seen]
        value = [weights.tag if s is None else max(html_extract.LEAST, min(html_extract.MOST, s)) * t.words for s, t in zip(score, seen, strict=True)]
        sums = np.concatenate([[0.0], np.cumsum(value)])
        best = max(((sums[j] - sums[i], -i, -j) for i in range(len(sums)) for j in range(i + 1, len(sums))))
        inside = [t for i, t in enumerate(seen) if -best[1] <= i < -best[2] and run(t) and score[i] > 0]
        assert html_extract.extract(p, weights).split() == " ".join(t.text for t in inside).split()


def test_broken_pages_take_linear_time(weights):
    import time

    for broken in ('<a href="x>', "<p title='a ", "<script>x<style>", "<div>", "<!-", "</", "<b", "&#"):
        began = time.process_time()
        html_extract.extract(broken * 20_000 + "end", weights)
        assert time.process_time() - began < 3, broken


def test_main_text_of_tables(spark, weights):
    pages = spark.createDataFrame([(1, "u", None), (2, None, PAGE), (2, None, PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extract.extract_pages(pages, weights).orderBy("page_id").collect()
    assert [r.n_chars for r in got][0] == 0 and got[1] == got[2]
    assert html_extract.extract_pages(pages.limit(0), weights).count() == 0
