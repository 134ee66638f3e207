"""Near-duplicate classes against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from voxframe.llm import minhash
from voxframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent):
    sets = []
    for doc_id, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "Γ", "delta", "e", "f,", "g.", "HH", "iota", "kappa", "λ"]
    rows: list = [None, "", " \t\n", "one two", "ONE  two", "a b c d e", "A\tb c d e", "a b c d", "x " * 60]
    for _ in range(n):
        words = [rng.choice(vocabulary) + str(rng.randrange(40)) for _ in range(rng.randrange(20, 150))]
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            own = list(words)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "edit"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("percent", "members"), [(85, 1024), (80, 4)])
def test_equals_all_pairs(spark, monkeypatch, percent, members):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members)
    rows = corpus(percent, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, percent).collect())
    assert got == brute(rows, percent)


def test_documents_of_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == brute([tuple(r) for r in docs.collect()], 85)


def test_null_ids_repeated_rows_and_other_columns(spark):
    rows = [(5, "p q r s t u", 1), (5, "p q r s t u", 2), (5, "other words are here now", 3), (2, "other words are here now", 4), (None, "p q r s t u", 5), (9, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cluster int")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (9, 9, True)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_a_repeated_id_links_by_each_of_its_texts(spark):
    first, second = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(5, " ".join(first)), (5, " ".join(second)), (6, " ".join([*first[:-1], "x"])), (7, " ".join([*second[:-1], "y"]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 5}


def test_signature_coordinates_are_shifts_of_one_permutation():
    values = np.random.default_rng(1).integers(0, 1 << 63, 700, dtype=np.uint64)
    got = minhash.signature(values, 8)
    first = minhash.scattered((values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32), 0x3C6EF372)
    assert got.tolist() == [int(minhash.scattered(first + np.uint32(k), 0x1B873593).min()) for k in range(8)]


def test_components_of_chains_loops_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, 7), (1, 50), (50, 1), (1, 50)] + [(900, 901 + k) for k in range(20)] + [(None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: 100 for k in range(100, 141)} | {1: 1, 50: 1} | {900 + k: 900 for k in range(21)}
