"""Boosted trees against a grower in plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fogbank.operators import boosting

ALL = dict(share_of_inputs=1.0, share_of_rows=1.0, least_rows=20, category_rows=20)


def table(spark, n=500, seed=1, parts=3):
    """Inputs with ties and missing values, a category that matters, and a target."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 40, n) / 4, rng.normal(0, 1, n), rng.integers(0, 7, n)
    a[rng.random(n) < 0.1] = np.nan
    y = np.where(np.isnan(a), 3.0, a) * 0.7 + (b > 0.3) * 2 + np.isin(c, [1, 4, 5]) * 1.5 + rng.normal(0, 0.3, n)
    rows = [(i, None if np.isnan(u) else float(u), float(v), int(k), float(t)) for i, (u, v, k, t) in enumerate(zip(a, b, c, y, strict=True))]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c int, y double").repartition(parts)


def plain_tree(rows, edges, settings):
    """Best-first growth by loops over rows: the splits as (kind, rows that go low), and the leaves' values by row."""
    base = sum(r[4] for r in rows) / len(rows)
    g = {r[0]: base - r[4] for r in rows}

    def bin_of(r, f):
        v = r[1 + f]
        return 0 if v is None else 1 + sum(v > e for e in edges[f])

    def value(ids, l2):
        s = sum(g[i] for i in ids)
        return s * s / (len(ids) + l2)

    def best(node):
        found = (1e-9, None)
        ids = [r[0] for r in node]

        def offer(low, l2):
            nonlocal found
            high = [i for i in ids if i not in low]
            if len(low) >= settings.least_rows and len(high) >= settings.least_rows:
                gain = value(low, l2) + value(high, l2) - value(ids, l2)
                if gain > found[0] * (1 + 1e-9):
                    found = (gain, low)

        for f in (0, 1):
            for with_missing in (False, True):
                for bar in range(1, len(edges[f]) + 1):
                    offer({r[0] for r in node if 1 <= bin_of(r, f) <= bar or (with_missing and bin_of(r, f) == 0)}, settings.l2)
        of = {}
        for r in node:
            of.setdefault(r[3], []).append(r[0])
        order = sorted(of, key=lambda k: (sum(g[i] for i in of[k]) / (len(of[k]) + settings.category_smooth), k))
        seen = 0
        for k in range(1, len(order)):
            low = {i for c in order[:k] for i in of[c]}
            if len(low) // settings.category_rows > seen // settings.category_rows:
                offer(low, settings.l2 + settings.category_l2)
            seen = len(low)
        return found

    leaves, splits = [(best(rows), rows)], []
    while len(leaves) < settings.leaves:
        (gain, low), node = max(leaves, key=lambda x: x[0][0])
        if low is None:
            break
        splits.append(frozenset(low))
        leaves = [x for x in leaves if x[1] is not node]
        for part in ([r for r in node if r[0] in low], [r for r in node if r[0] not in low]):
            leaves.append((best(part) if len(part) >= 2 * settings.least_rows else (0, None), part))
    return splits, {r[0]: base - settings.rate * sum(g[q[0]] for q in node) / (len(node) + settings.l2) for _, node in leaves for r in node}


@pytest.mark.parametrize("task_rows", [250_000, 120, 1])
def test_one_tree_equals_plain_growth(spark, task_rows):
    rows, df = table(spark)
    settings = boosting.Settings(rounds=1, rate=1.0, leaves=9, bins=16, task_rows=task_rows, **ALL)
    model = boosting.fit(df, ["a", "b"], "y", F.lit(False), ["id"], "c", settings)
    splits, values = plain_tree(rows, model.edges, settings)
    assert len(model.trees) == 1 and len(model.trees[0].splits) == len(splits) == 8
    got = {r.id: r.p for r in df.select("id", model.column(df).alias("p")).collect()}
    assert max(abs(got[i] - values[i]) for i in values) < 1e-6
    assert len({round(v, 9) for v in got.values()}) == 9


def test_rounds_are_the_same_however_rows_are_dealt(spark):
    """Large nodes by histograms of all tasks, small ones within a task, rewritten or kept residuals: the same trees."""
    _, one = table(spark, 1500, parts=1)
    _, many = table(spark, 1500, parts=5)
    made = []
    for df, settings in ((one, dict(task_rows=10**6)), (many, dict(task_rows=300, rewrite=2)), (many.orderBy("b"), dict(task_rows=1, rewrite=3))):
        made.append(boosting.fit(df, ["a", "b"], "y", F.col("id") > 1300, ["id"], "c", boosting.Settings(rounds=6, leaves=7, bins=32, **settings)))
    text = [[[(s.feature, s.bar, s.missing_low, s.sums, None if s.chosen is None else s.chosen.tolist()) for s in t.splits] for t in m.trees] for m in made]
    assert text[0] == text[1] == text[2] and len(text[0]) == 6
    assert made[0].losses == made[1].losses == made[2].losses and made[0].losses[-1] < made[0].losses[0]


def test_training_ends_after_patience_and_keeps_the_best_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.normal())) for i in range(600)]  # nothing to learn
    df = spark.createDataFrame(rows, "id long, a double, y double").coalesce(1)
    m = boosting.fit(df, ["a"], "y", F.col("id") >= 400, ["id"], None, boosting.Settings(patience=5, rate=0.3))
    best = min(range(1, len(m.losses)), key=lambda i: m.losses[i])
    assert len(m.trees) == best and len(m.losses) == best + 6


def test_new_values_and_stations_have_a_side(spark):
    _, df = table(spark, 800)
    m = boosting.fit(df.where("a IS NOT NULL"), ["a", "b"], "y", F.lit(False), ["id"], "c", boosting.Settings(rounds=4, rate=0.5, **ALL))
    odd = spark.createDataFrame([(None, None, None), (1e9, -1e9, 99), (float("nan"), 0.0, 1)], "a double, b double, c int")
    assert all(np.isfinite(r.p) for r in odd.select(m.column(odd).alias("p")).collect())
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(df.limit(0), ["a"], "y", F.lit(False), ["id"])
    few = boosting.fit(df.limit(10), ["a"], "y", F.lit(False), ["id"], None, boosting.Settings(rounds=3))
    assert few.trees == []


def test_the_share_of_rows_is_drawn_by_key():
    key = np.arange(100_000)
    a, b = boosting._drawn(key, 7, 1, 0.8), boosting._drawn(key, 7, 2, 0.8)
    assert abs(a.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.01
    assert (boosting._drawn(key[::-1].copy(), 7, 1, 0.8)[::-1] == a).all() and boosting._drawn(key, 7, 1, 1.0).all()


def test_a_step_brings_only_sums_to_the_driver(spark, monkeypatch):
    """Rows that come back are bounded by leaves, inputs and bins, whatever the table's size."""
    got = []
    real = boosting._Fit.wide_step

    def seen(self, *a):
        out = real(self, *a)
        got.append(sum(int((h.n > 0).sum()) + len(h.category) for h in out[0].values()))
        return out

    monkeypatch.setattr(boosting._Fit, "wide_step", seen)
    _, df = table(spark, 3000)
    boosting.fit(df, ["a", "b"], "y", F.lit(False), ["id"], "c", boosting.Settings(rounds=1, bins=8, leaves=4, task_rows=1))
    assert got and max(got) <= 4 * (2 * 8 + 7)


def test_rows_are_packed_in_large_blocks(spark):
    """Not in a block for each Arrow batch: every step's counting costs the same for a small block as for a large one."""
    rows = spark.range(0, 25_000, 1, 1).selectExpr("double(id % 7) AS target", "false AS held", "id AS key", "double(id % 50) AS a")
    scratch = []
    blocks = boosting._blocks(rows, ["a"], [np.arange(10.0)], None, scratch)
    assert blocks.count() == 1
    boosting.release(scratch)


def test_a_table_of_one_task_makes_the_trees_of_single_steps_in_a_few_jobs(spark, monkeypatch):
    """Jobs of three rounds instead of one or more a round; categories without rows to train on; nodes of all tasks and of one."""
    monkeypatch.setattr(boosting, "ROUNDS", 3)
    rng = np.random.default_rng(5)
    off = rng.normal(0, 2, 150)
    rows = [(i, None if i % 11 == 0 else float(rng.normal()), None if i % 17 == 0 else int(c), float(off[c] + rng.normal())) for i, c in enumerate(rng.integers(0, 150, 4000))]
    df = spark.createDataFrame(rows, "id long, a double, c int, y double").repartition(3)
    made, jobs = [], []
    for one_task in (0, 16):
        settings = boosting.Settings(rounds=7, rate=0.5, leaves=9, bins=16, least_rows=10, category_rows=5, task_rows=1500, one_task=one_task)
        spark.sparkContext.setJobGroup(f"one-{one_task}", "")
        made.append(boosting.fit(df, ["a"], "y", (F.col("id") % 5 == 0) | (F.col("c") == 3), ["id"], "c", settings))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"one-{one_task}")))
    spark.sparkContext.setJobGroup("", "")
    text = [[sorted((s.feature, s.bar, s.missing_low, s.sums, None if s.chosen is None else s.chosen.tolist()) for s in t.splits) for t in m.trees] for m in made]
    assert text[0] == text[1] and len(text[0]) > 3 and len(made[0].losses) == 8 and made[0].losses == made[1].losses
    assert jobs[1] < jobs[0] - 7
