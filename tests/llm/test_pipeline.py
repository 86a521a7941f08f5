"""The pipeline, stage by stage and as a whole."""

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_targets, full_distance

SF = "/root/testdata/sf0.001"
NAMES = ["toxicity", "near duplicates", "benchmark decontamination", "mixing", "sharding"]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        assert after.count() > 0
        docs = after
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert shards.count() == docs.count()
    assert {r.shard for r in shards.collect()} == set(range(8))


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(folder, documents by id) with toxic, copied, leaked, empty and repeated documents and columns whose names the operators use."""
    folder, rng = tmp_path_factory.mktemp("corpus"), np.random.default_rng(40)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9))))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(int(rng.integers(12, 40))))) for i in range(8)]
    rows, labels = [], []
    for i in range(420):
        w = text(int(rng.integers(30, 80)))
        toxic = i % 7 == 0
        if toxic:
            w[int(rng.integers(len(w)))] = "blockhead" if i % 2 else "blokhead"
        if i % 7 == 3:
            w[10:10] = items[i % 8][1].split()
        rows.append((i, " ".join(w), "en", f"s{i % 4}"))
        labels.append((i, int(toxic)))
    for k, i in enumerate(range(1, 420, 20)):  # near copies, of clean documents and of others
        w = rows[i][1].split()
        for copy in range(4):
            v = list(w)
            if copy:
                v[int(rng.integers(len(v)))] = word()
            rows.append((1000 + 10 * k + copy, " ".join(v), "en", f"s{copy}"))
    rows += [(2000, None, None, None), (2001, "", "en", "s0"), (2002, "  \n", "en", "s1"), (None, " ".join(text(40)), "de", "s1"), (3000, rows[1][1], "en", "s1"), (3000, rows[1][1], "en", "s1")]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = d.withColumns({"node": F.lit(1), "size": F.lit("x"), "hash": F.lit(2.0), "item_id": F.lit(3), "shard": F.lit(None).cast("string")})
    d.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows, dict(items)


def test_every_stage_equals_brute_force(spark, planted):
    folder, rows, items = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    now = Counter((r[0], r[1], r[3]) for r in rows)

    def after(name):
        nonlocal docs
        docs = stages[name](spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        return Counter((r.doc_id, r.text, r.source) for r in docs.collect())

    clean = Counter({k: n for k, n in now.items() if not any(w in ("blockhead", "blokhead") for w in (k[1] or "").split())})
    assert (now := after("toxicity")) == clean
    ids = {k[1]: i for i, k in enumerate(sorted(now, key=lambda k: (k[0] is None, k[0] or 0)))}
    texts = {i: t for t, i in ids.items()}
    least = {}
    for k in now:
        least[ids[k[1]]] = min(least.get(ids[k[1]], 10**9), 10**9 if k[0] is None else k[0])
    group = defaultdict(list)
    for i, (_, c) in brute_components(list(texts.items()), 5, 80).items():
        group[c].append(least[i])
    component = {i: c for i, (_, c) in brute_components(list(texts.items()), 5, 80).items()}
    empty = lambda t: not (t or "").split()
    kept = Counter({k: n for k, n in now.items() if empty(k[1]) or (10**9 if k[0] is None else k[0]) == min(group[component[ids[k[1]]]])})
    assert (now := after("near duplicates")) == kept
    held = Counter({k: n for k, n in now.items() if not any(k[1] and full_distance(x, k[1]) <= 0.2 * len(x) for x in items.values())})
    assert sum(held.values()) < sum(now.values())
    assert (now := after("benchmark decontamination")) == held
    size = Counter()
    for (_, t, s), n in now.items():
        size[s] += n * len((t or "").split())
    mixed = after("mixing")
    assert set(mixed) <= set(now) and all(n <= 3 * now[k] for k, n in mixed.items())
    taken = Counter()
    for (_, t, s), n in mixed.items():
        taken[s] += n * len((t or "").split())
    longest = max(len((k[1] or "").split()) for k in now)
    for s, target in brute_targets(size).items():
        assert abs(taken[s] - target) <= 2 * longest, (s, taken[s], target)
    shards = stages["sharding"](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in shards) == Counter({i: sum(n for k, n in mixed.items() if k[0] == i) for i in {k[0] for k in mixed}})
    slots = defaultdict(list)
    for r in shards:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_the_whole_run_is_the_stages_one_after_another(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda rows: Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in rows)
    assert key(corpus_pipeline.run(spark, folder).collect()) == key(docs.collect())
