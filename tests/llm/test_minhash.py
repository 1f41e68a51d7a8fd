import random

import numpy as np
import pytest

from fogbank.llm import common, minhash


def brute(docs):
    """Component of each document by comparing all pairs."""
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(prose):
    """Groups of copies whose edits put pairs on both sides of the threshold, a shared passage, and loners."""
    rnd, out = random.Random(5), []
    shared = prose(999, 60)
    for g in range(6):
        base = prose(g, 120)
        out += [edited(rnd, base, rnd.randrange(6)) for _ in range(12)]
    chain = prose(77, 150)
    for _ in range(10):
        out.append(chain)
        chain = edited(rnd, chain, 3)
    out += [f"{shared} {prose(200 + i, 40)}" for i in range(25)] + [prose(300 + i, 30) for i in range(10)]
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("block,refine,block_bytes", [(256, 4096, 8 << 20), (3, 2, 8 << 20), (256, 4096, 3000)])
def test_components_equal_brute_force(spark, corpus, block, refine, block_bytes):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, block=block, refine=refine, block_bytes=block_bytes).collect()}
    want = brute(corpus)
    assert got == want and len({c for _, c in want.values()}) < len(corpus) - 40


def test_scratch_is_released(spark, corpus):
    from pathlib import Path

    at = lambda: {p.name for p in Path(common.shared_dir(spark).removeprefix("file://")).iterdir()}
    before = at()
    got = minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert len(at() - before) <= 4 and got.count() == len(corpus)


def test_index_meets_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, minhash.K, dtype=np.uint16)
    for _ in range(200):
        b = a.copy()
        at = rng.choice(minhash.K, minhash.RADIUS, replace=False)
        b[at] ^= 1
        wrong = (a != b).reshape(minhash.CHUNKS, minhash.WIDTH).sum(1)
        assert wrong.min() <= 1


def test_odd_rows(spark, odd_docs):
    got = minhash.near_duplicates(odd_docs)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd_docs.count() and got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    for i in (3, 4, 5):
        assert by[i].n_shingles == 0 and by[i].component_id == i and by[i].kept
    assert by[1].component_id == by[2].component_id == by[11].component_id == 0 and by[7].component_id == 6 and by[6].n_shingles == 1
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.label for r in minhash.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
