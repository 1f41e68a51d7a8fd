import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fogbank.llm import mixing, sharding


def test_shards_are_contiguous_and_balanced(spark, prose):
    docs = spark.createDataFrame([(i * 3 % 200, prose(i, 5 + i % 60)) for i in range(200)], "doc_id long, text string")
    got = sharding.shard_by_bytes(docs, 5).toPandas().sort_values("doc_id")
    assert got.shard.is_monotonic_increasing and len(got) == 200
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 5 and sums.max() - sums.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))


def test_odd_rows(spark, odd_docs):
    got = sharding.shard_by_bytes(odd_docs, 3).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[3]["size"] == 1 and by[3].text_crc32 == 0 and by[6]["size"] == 8 and by[6].text_crc32 == zlib.crc32(b"one two")
    assert sharding.shard_by_bytes(odd_docs.limit(0)).count() == 0


def brute_rake(cells, targets, rounds):
    w = dict(cells)
    total = sum(w.values())
    w = {k: v / total for k, v in w.items()}
    for _ in range(rounds):
        for a in range(3):
            now = {}
            for k, v in w.items():
                now[k[a]] = now.get(k[a], 0) + v
            w = {k: v * targets[a][k[a]] / now[k[a]] for k, v in w.items()}
    return w


def test_raking_meets_targets(spark):
    cells = {(s, g, t): 10.0 + 7 * i for i, (s, g, t) in enumerate((s, g, t) for s in "AB" for g in ("en", "de") for t in ("p", "q"))}
    df = spark.createDataFrame([(*k, int(v)) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    want = [{"A": 0.7, "B": 0.3}, {"en": 0.4, "de": 0.6}, {"p": 0.5, "q": 0.5}]
    got = mixing.rake(df, {"source": {"A": 7.0, "B": 3.0}, "lang": want[1], "topic": want[2]}, 20).collect()
    exact = brute_rake(cells, want, 20)
    total = sum(cells.values())
    for r in got:
        k = (r.source, r.lang, r.topic)
        assert r.ratio == pytest.approx(exact[k] / (cells[k] / total), rel=1e-9) and 0 <= r.prob <= 1
    assert max(r.prob for r in got) == pytest.approx(1.0)
    share = sum(r.ratio * cells[r.source, r.lang, r.topic] / total for r in got if r.source == "A")
    assert share == pytest.approx(0.7, abs=1e-6)


def test_raking_stops_at_its_tolerance(spark):
    cells = [(s, g, t, 50 * 3 ** (i % 7) + i) for i, (s, g, t) in enumerate((s, g, t) for s in "ABC" for g in ("en", "de") for t in ("p", "q"))]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    total = sum(c[3] for c in cells)
    aims = {"source": {"A": 0.2, "B": 0.3, "C": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"p": 0.9, "q": 0.1}}
    for together in (True, False):
        got = {(r.source, r.lang, r.topic): r.ratio for r in mixing.rake(df, aims, mixing.ROUNDS_MOST, tolerance=1e-6, together=together).collect()}
        for at, axis in enumerate(mixing.AXES):
            for category, aim in aims[axis].items():
                assert sum(got[c[:3]] * c[3] / total for c in cells if c[at] == category) == pytest.approx(aim, abs=1e-6)


def test_many_cells_give_the_same_rows(spark, prose):
    docs = spark.createDataFrame([(i, prose(i, 3 + i % 40), ("en", "de", None)[i % 3], f"s{i % 5}") for i in range(150)], "doc_id long, text string, lang string, source string")
    cols = ["doc_id", "sampled", F.round("prob", 9).alias("prob"), "row"]
    few, many = (mixing.calibrated(docs, small_cells=n).select(*cols).orderBy("doc_id").collect() for n in (mixing.SMALL_CELLS, 0))
    assert few == many and len(few) == 150


def test_sampling_follows_probabilities(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("word " * 20).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 4 == 0, "rare").otherwise("hot").alias("source"))
    out = mixing.calibrated(docs, {"source": {"rare": 1.0, "hot": 1.0}})
    by = {r.source: (r.p, r.s) for r in out.groupBy("source").agg(F.avg("prob").alias("p"), F.avg(F.col("sampled").cast("int")).alias("s")).collect()}
    assert by["rare"][0] == pytest.approx(1.0) and by["hot"][0] == pytest.approx(1 / 3) and by["hot"][1] == pytest.approx(1 / 3, abs=0.04)


def test_odd_rows_mix(spark, odd_docs):
    got = mixing.calibrated(odd_docs)
    assert got.count() == odd_docs.count() and {r.source for r in got.collect()} == {"src0", "(none)"}
    assert got.where("sampled").select("row.*").columns == odd_docs.columns
    assert mixing.calibrated(odd_docs.limit(0)).count() == 0


def test_rare_cells_do_not_set_the_kept_share(spark):
    cells = [(f"s{i}", g, t, 1000 + 100 * i + 50 * len(g + t)) for i in range(4) for g in ("en", "de") for t in ("prose", "note")]
    for rare in ([], [("(none)", "(none)", "note", 1)], [("(none)", "en", "prose", 2), ("s0", "xx", "note", 1)]):
        df = spark.createDataFrame(cells + rare, "source string, lang string, topic string, tokens long")
        got = mixing.rake(df, keep=0.75).join(df, list(mixing.AXES)).collect()
        total = sum(r.tokens for r in got)
        assert sum(r.prob * r.tokens for r in got) == pytest.approx(0.75 * total) and all(0 < r.prob <= 1 for r in got)
        scale = {round(r.prob / r.ratio, 9) for r in got if r.prob < 1}
        assert len(scale) == 1 and all(r.ratio * min(scale) >= 1 - 1e-9 for r in got if r.prob == 1)
    assert {r.prob for r in mixing.rake(df, keep=1.0).collect()} == {1.0}


def test_pipeline_keeps_three_quarters(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("word " * 20).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    assert corpus_pipeline.mix(spark, docs, "").count() == pytest.approx(3000, abs=120)
