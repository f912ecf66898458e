import random

import pytest
from pyspark.sql import functions as F

from rankloom.llm import packing
from rankloom.llm import tokenize as tk


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_cuts_and_joins_equal_an_independent_library(reference):
    enc, rng = tk.encoder(tk.default_vocabulary()), random.Random(1)
    atoms = ["a", "'s", " ", "\n", "的", "é", "1", "!", "ab", "'re", "  ", "٣", "Ж", "a" * 50, "的" * 30, "!" * 40, " " * 30, "'" * 9, "<|endoftext|>", "�", "😀"]
    for _ in range(400):
        s = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 80)))
        assert tk.encode_whole(enc, s, rng.choice([3, 5, 8, 16])) == reference(s)


def test_encode_documents_edge_cases(spark, reference):
    long = "的" * 90 + " word" * 40 + "x" * 200 + "\n\n\n" + "é" * 77
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello <|endoftext|>", "c"), (4, long, None), (4, long, None), (5, " 　\n", "d"), (None, "x y", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id or 0, list(r.ids)) for r in tk.encode_documents(df, leaf_chars=32).collect()))
    assert got == sorted(((k or 0, reference(t) if t else []) for k, t, _ in rows))
    assert tk.encode_documents(df.limit(0)).count() == 0
    counts = sorted((r.doc_id or 0, r.n_tokens) for r in tk.token_counts(df, leaf_chars=32).collect())
    assert counts == sorted((k, len(i)) for k, i in got)


def test_plan_holds_every_item_and_is_tight():
    rng = random.Random(2)
    counts = {s: rng.randint(0, 400) for s in range(1, 2049)}
    kinds = packing.plan_containers(counts)
    seen = {}
    for k in kinds:
        assert sum(s for s, _ in k["items"]) == k["fill"] <= 2048
        for s, _ in k["items"]:
            seen[s] = seen.get(s, 0) + k["n"]
    assert seen == {s: c for s, c in counts.items() if c}
    total, n = sum(s * c for s, c in counts.items()), sum(k["n"] for k in kinds)
    assert n <= -(-total // 2048) * 1.01
    with pytest.raises(ValueError):
        packing.plan_containers({3000: 1})


def test_tiers_change_the_plan_and_waste_nothing():
    rng = random.Random(8)
    counts = {}
    for _ in range(40_000):  # a heavy tail of long texts, as in documents
        s = min(2048, int(rng.lognormvariate(4.5, 1.0)) + 1)
        counts[s] = counts.get(s, 0) + 1
    total = sum(s * c for s, c in counts.items())
    plans = {t: packing.plan_containers(counts, n_tiers=t) for t in (1, 3, 5)}
    assert plans[1] != plans[3] != plans[5]
    for t, kinds in plans.items():
        assert total / (2048 * sum(k["n"] for k in kinds)) > 0.999
        seen = {}
        for k in kinds:
            for s, _ in k["items"]:
                seen[s] = seen.get(s, 0) + k["n"]
        assert seen == counts and {k["tier"] for k in kinds} <= set(packing.tiers(2048, t))
    opened = [k for k in plans[5] if k["tier"] == 2048]
    assert all(max(s for s, _ in k["items"]) > 1024 for k in opened) and any(t < 2048 for k in opened for _, t in k["items"])


def test_packing_is_valid(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, None, 1, 7, 100, 100, 100, 2048, 2049, 5000])) for i in range(600)] + [(7, 100), (7, 100)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    out = packing.pack_sizes(spark, items, group=4).cache()
    assert out.groupBy("doc_id").agg(F.sum("part_tokens").alias("t")).filter("t < 0").count() == 0
    assert out.agg(F.sum("part_tokens")).first()[0] == sum(n or 0 for _, n in rows)
    used = out.filter("container_id is not null").groupBy("container_id").agg(F.sum("part_tokens").alias("t"), F.collect_list(F.struct("container_offset", "part_tokens")).alias("x")).collect()
    assert all(r.t <= 2048 for r in used)
    for r in used:
        at = 0
        for o, n in sorted(map(tuple, r.x)):
            assert o == at
            at += n
    assert sorted(r.container_id for r in used) == list(range(len(used)))
    split = out.filter("part > 0").select("doc_id").distinct().count()
    assert split == sum(1 for _, n in rows if n and n > 2048)
    assert packing.pack_sizes(spark, items.limit(0)).count() == 0
    steps = out.filter("container_id is not null").groupBy("step_group").agg(F.countDistinct("container_id").alias("c")).collect()
    assert max(s.c for s in steps) <= 5
