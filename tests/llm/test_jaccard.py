import random

import brute
import numpy as np
import pytest

from whorl.llm import jaccard


def made(n, seed):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.7:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                at = r.randrange(len(w) + 1)
                if r.random() < 0.5 and len(w) > 1:
                    w.pop(at % len(w))
                else:
                    w.insert(at, f"x{r.randrange(50)}")
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(f"w{r.randrange(400)}" for _ in range(r.choice([3, 9, 15, 40, 120]))))
    texts += ["", None, " \n", "one", "ONE", "one two"]
    return list(enumerate(texts))


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, words, percent):
    docs = made(400, words)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as n_shingles", "1 as component_id")
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_join(df, words=words, percent=percent).collect()}
    assert got == brute.jaccard_components(docs, words, percent)


def test_tree_finds_every_point_within_the_bound():
    r = np.random.default_rng(0)
    points = r.integers(0, 6, (300, 32))
    tree = jaccard.CountTree(points)
    for probe in points[:20]:
        need = (9 * (points.sum(1) + probe.sum())) // 19
        assert sorted(tree.reach(probe, need)) == list(np.flatnonzero(np.minimum(points, probe).sum(1) >= need))


def test_empty_table(spark):
    assert jaccard.jaccard_join(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_counts_beyond_16_bits_keep_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUPS", 1)  # one group holds what 256 hold in texts 256 times as long
    w = [f"w{i}" for i in range(80_000)]
    docs = [(1, " ".join(w)), (2, " ".join([*w, *(f"x{i}" for i in range(200))])), (3, " ".join(w[::-1]))]
    got = {r[0]: r[2] for r in jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_components_match_brute_force_with_split_cells(spark, monkeypatch, words, percent):
    monkeypatch.setattr(jaccard, "CELL", 3)
    monkeypatch.setattr(jaccard, "PAYS", 1.1)  # leave the hub rounds after the first one
    docs = made(400, 10 + words)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_join(df, words=words, percent=percent).collect()}
    assert got == brute.jaccard_components(docs, words, percent)


def test_work_on_texts_with_a_common_part_follows_their_number(spark, monkeypatch):
    rows, save = {}, jaccard.Scratch.save
    monkeypatch.setattr(jaccard, "CELL", 64)

    def counted(self, df, name, *more):
        found = save(self, df, name, *more)
        if name.endswith(("-blocks", "refined")):
            rows[name] = rows.get(name, 0) + found.count()
        return found

    monkeypatch.setattr(jaccard.Scratch, "save", counted)
    common, seen = " ".join(f"w{i}" for i in range(42)), []
    for n in (500, 2000):
        rows.clear()
        docs = [(i, f"{common} " + " ".join(f"v{i}x{k}" for k in range(6))) for i in range(n)]
        docs += [(n, docs[7][1] + " end")]
        got = {r[0]: r[2] for r in jaccard.jaccard_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
        assert got == {i: 7 if i == n else i for i in range(n + 1)}
        seen.append(sum(rows.values()))
    assert seen[1] <= 6 * max(seen[0], 100)
