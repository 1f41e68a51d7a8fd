import itertools

import numpy as np
from pyspark.sql import functions as F

from fogbank.llm import langid, toxicity
from fogbank.llm.common import least_by_hash


def test_language_held_out_accuracy(spark, prose):
    rows = [(i, prose(i, 25, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, ~langid.fold_held_out())
    got = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(langid.fold_held_out()).collect()
    assert len(got) > 20 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, odd_docs, prose):
    net = langid.fit(odd_docs, F.lit(True))
    by = {r.doc_id: r for r in langid.predict(odd_docs, net).collect()}
    assert by[3].lang_pred == by[4].lang_pred == by[8].lang_pred == "und" and by[3].score == 0 and by[0].lang_pred == "en"
    assert langid.fit(odd_docs.limit(0), F.lit(True)) is None and langid.predict(odd_docs, None).where("lang_pred <> 'und'").count() == 0
    assert odd_docs.where(langid.language(odd_docs, net) != "und").count() == odd_docs.count() - 4


def network(rng, langs=3):
    mask = langid.width_mask()
    net = langid.Network([f"l{i}" for i in range(langs)], rng.normal(size=(256, langid.EMBED)), rng.normal(size=mask.shape) * mask, rng.normal(size=mask.shape[1]), rng.normal(size=(mask.shape[1], langs)), rng.normal(size=langs))
    net.embed[0] = 0
    return net, mask


def test_convolution_equals_plain_loops():
    rng = np.random.default_rng(4)
    net, _ = network(rng)
    windows = rng.integers(1, 256, (3, langid.WINDOW), dtype=np.uint8)
    got = net.probabilities(windows)
    for w, p in zip(windows, got, strict=True):
        top = []
        for f in range(len(net.bias)):
            width = langid.WIDTHS[f // langid.FILTERS]
            at = [sum(float(net.embed[w[s + o]] @ net.filters[o * langid.EMBED : (o + 1) * langid.EMBED, f]) for o in range(width)) for s in range(langid.STEP)]
            top.append(max(0.0, max(at) + net.bias[f]))
        z = np.array(top) @ net.dense + net.dense_bias
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(p, want, atol=1e-5)


def test_gradients_equal_differences():
    rng = np.random.default_rng(5)
    net, mask = network(rng)
    x, y, weight = rng.integers(1, 256, (4, langid.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 1]), np.array([0.1, 0.4, 0.2, 0.3])

    def loss():
        z = np.maximum(net.pooled(x)[0], 0) @ net.dense + net.dense_bias
        return float(-(weight * np.log(langid.softmax(z)[np.arange(4), y])).sum())

    grads = langid.gradients(net, x, y, weight, mask)
    for name, g in grads.items():
        value = getattr(net, name)
        places = np.argwhere(np.abs(g) > 1e-3)
        for k in rng.choice(len(places), min(6, len(places)), replace=False):
            at, step = tuple(places[k]), 1e-6
            old = value[at]
            value[at] = old + step
            up = loss()
            value[at] = old - step
            down = loss()
            value[at] = old
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4 * max(1, abs(g[at])), name


def test_rare_languages_are_sampled(spark):
    assert langid.shares({"a": 10_000, "b": 40, "c": 5000}, 3000) == {"a": 1480, "b": 40, "c": 1480}
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "rare").otherwise("hot").alias("lang"))
    a = langid.sample(df, "doc_id", "lang", 100)
    assert a == langid.sample(df.repartition(7), "doc_id", "lang", 100) and len(a) == 100 and sum(i < 30 for i in a) == 30
    assert langid.sample(df.limit(0), "doc_id", "lang", 100) == []
    many = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 450).cast("string")).alias("lang"))
    assert len(langid.sample(many, "doc_id", "lang", 450)) == 450  # one of each of 450 languages


def test_an_id_that_is_repeated_brings_no_more_than_its_share(spark, prose, monkeypatch):
    rows = [(1, prose(1, 30), "en")] * 400 + [(2, prose(2, 30, "de"), "de"), (3, "und", "und"), (4, prose(3, 30, "de"), "de")]
    seen = []
    monkeypatch.setattr(langid, "train", lambda windows, labels, langs: seen.append((len(windows), langs)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert seen == [(3, ["de", "en"])] or (seen[0][1] == ["de", "en"] and seen[0][0] <= 9)


def test_clashing_columns_do_not_reach_the_results(spark, odd_docs):
    clash = odd_docs.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9.0)).withColumn("spans", F.lit(1))
    net = langid.fit(clash, F.lit(True))
    assert langid.predict(clash, net).columns == ["doc_id", "lang_pred", "score"] and langid.predict(clash, net).where("score > 1").count() == 0
    model = toxicity.train([], [])
    assert toxicity.score(clash, model).columns == ["doc_id", "score", "spans"] and toxicity.score(clash, model).where("score > 1").count() == 0


def test_windows_cover_every_byte():
    for n in (0, 1, langid.WINDOW, langid.WINDOW + 1, 3 * langid.STEP, 5000):
        text = bytes(range(1, 252)) * (n // 251 + 1)
        w, covers = langid.windows_of(text[:n])
        whole = b"".join(x[: langid.STEP].tobytes() for x in w) + w[-1].tobytes()[langid.STEP :]
        assert whole[:n] == text[:n] and not whole[n:].strip(b"\0") and len(w) == len(covers)
        assert n == 0 or w[-1].tobytes().rstrip(b"\0").endswith(text[:n][-1:])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    f = toxicity.Field(np.zeros(1 << toxicity.HASH_BITS), 0.0, rng.normal(size=(2, 2)))
    e = np.concatenate((rng.normal(size=4), [np.nan], rng.normal(size=6), [np.nan, np.nan], rng.normal(size=1)))
    got = f.marginals(e)
    at = 0
    for part in (e[:4], e[5:11], e[13:]):
        at = {4: 0, 6: 5, 1: 13}[len(part)]
        weight = {t: np.exp(sum(x for x, y in zip(part, t, strict=True) if y) + sum(f.moves[a, b] for a, b in zip(t, t[1:], strict=False))) for t in itertools.product((0, 1), repeat=len(part))}
        for i in range(len(part)):
            assert abs(got[at + i] - sum(v for t, v in weight.items() if t[i]) / sum(weight.values())) < 1e-9


def test_pieces_end_where_chains_end(prose):
    for text in (prose(3, 4000).replace(" of ", ". "), prose(4, 4000), "x" * 5000, prose(5, 300) + "é" * 3000 + " " + prose(6, 500)):
        t = text.encode()
        cut = list(toxicity.pieces(t, 700))
        assert b"".join(t[a:b] for a, b in cut) == t
        assert [c for a, b in cut for c in toxicity.chains(toxicity.tokens(t[a:b]))] == list(toxicity.chains(toxicity.tokens(t)))


def test_expected_pairs_and_gradient_equal_enumeration():
    rng = np.random.default_rng(1)
    e, n, moves = rng.normal(size=(3, 5)), np.array([5, 2, 1]), rng.normal(size=(2, 2))

    def weight(row, tags, e, moves):
        return sum(e[row, i] for i, t in enumerate(tags) if t) + sum(moves[a, b] for a, b in zip(tags, tags[1:], strict=False))

    def log_total(e, moves):
        return sum(np.log(sum(np.exp(weight(r, t, e, moves)) for t in itertools.product((0, 1), repeat=k))) for r, k in enumerate(n))

    p, pairs = toxicity.expectations(e, n, moves)
    step = 1e-5
    for r, k in enumerate(n):  # the marginals are the derivatives of the log partition function
        for i in range(k):
            d = np.zeros_like(e)
            d[r, i] = step
            assert abs((log_total(e + d, moves) - log_total(e - d, moves)) / (2 * step) - p[r, i]) < 1e-6
    for a, b in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = step
        assert abs((log_total(e, moves + d) - log_total(e, moves - d)) / (2 * step) - pairs[a, b]) < 1e-6


def test_induced_lexicon_equals_plain_greedy_cover():
    rng = np.random.default_rng(2)
    words = [b"ab%d" % i for i in range(12)]
    docs = [[words[j] for j in rng.choice(12, 4, replace=False)] + [b"doc%d" % i, b"own%d" % i] for i in range(30)]
    toxic = [words[3] in d or words[7] in d for d in docs]
    docs = [[w for w in d if bad or w not in words[3:8:4]] for d, bad in zip(docs, toxic, strict=True)]
    chosen = toxicity.induce(docs, toxic)
    bad = [set(f for w in d for f in toxicity.features(w)[:-1]) for d, y in zip(docs, toxic, strict=True) if y]
    good = [set(f for w in d for f in toxicity.features(w)[:-1]) for d, y in zip(docs, toxic, strict=True) if not y]
    left, plain = list(bad), set()
    while True:
        pure = {f for d in left for f in d if sum(f in d for d in bad) >= 2 and sum(f in d for d in good) <= 0.01 * sum(f in d for d in bad)}
        best = max(pure, key=lambda f: (sum(f in d for d in left), sum(f in d for d in bad), -len(f), f), default=None)
        if best is None or sum(best in d for d in left) < 2:
            break
        plain.add(best)
        left = [d for d in left if best not in d]
    assert plain <= chosen and {b"w" + words[3], b"w" + words[7]} <= chosen


def test_scores_do_not_depend_on_lots(spark, prose, monkeypatch):
    rows = toxic_docs(prose)
    docs = [(i, t) for i, t, _ in rows[:40]] + [(1000, " ".join(t for _, t, _ in rows))]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    every = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(every, labels, F.lit(True))
    texts = [t.encode() for _, t in docs]
    whole = toxicity.judged(model, texts)
    monkeypatch.setattr(toxicity, "LOT_BYTES", 500)
    monkeypatch.setattr(toxicity, "pieces", lambda t, f=toxicity.pieces: f(t, 500))
    small = toxicity.judged(model, texts)
    assert np.allclose(whole[0], small[0]) and whole[1] == small[1] and len(whole[1][-1]) > 100
    assert toxicity.fit(every, labels, F.lit(True), max_bytes=3000).doc is not None


def toxic_docs(prose):
    bad = ["idiot", "moron", "trash", "scum"]
    rows = []
    for i in range(300):
        w = prose(i, 60).split()
        if i % 4 == 0:
            for k in range(3):
                w[(i * 7 + k * 11) % 60] = bad[(i // 4 + k) % 4]
        rows.append((i, " ".join(w).replace(" of ", ". "), int(i % 4 == 0)))
    return rows


def test_toxicity_held_out(spark, prose):
    rows = toxic_docs(prose)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    text, truth = {i: t for i, t, _ in rows}, {i: y for i, _, y in rows}
    got = toxicity.score(docs, model).collect()
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in got]) > 0.97
    words = {text[r.doc_id][s.start : s.end] for r in got for s in r.spans}
    assert {"idiot", "moron", "trash", "scum"} <= words


def test_hot_near_copies_leave_the_lexicon_alone(prose):
    rows = toxic_docs(prose)
    source = next(t for _, t, y in rows if y).split()
    copies = [" ".join([*source[: 7 * k], f"edit{k}", *source[7 * k + 1 :]]) for k in range(8)]
    docs = [toxicity.tokens(t.encode()) for t in [*copies, *(t for _, t, _ in rows)]]
    toxic = [True] * len(copies) + [y == 1 for _, _, y in rows]
    assert len(set(toxicity.groups(docs, [i for i, y in enumerate(toxic) if y]).values())) == 75
    chosen = toxicity.induce(docs, toxic)
    assert all(any(f in chosen for f in toxicity.features(w)) for w in (b"idiot", b"moron", b"trash", b"scum"))
    assert toxicity.induce([*docs[:9], *docs[8:][1:4]], [True] * 9 + [False] * 3) == set()  # one text alone is no evidence


def test_training_takes_every_chain(monkeypatch):
    rows = []
    seen = toxicity.expectations
    monkeypatch.setattr(toxicity, "expectations", lambda e, n, moves: (rows.append(len(n)), seen(e, n, moves))[1])
    # Long toxic documents with more than 8,000 tagged chains, and more clean chains than 4 of each.
    toxic = [[w for k in range(900) for w in (b"n%d" % (k % 50), b"idiot", toxicity.EDGE)] for _ in range(10)]
    clean = [[w for k in range(900) for w in (b"m%d" % (k % 50), toxicity.EDGE)] for _ in range(45)]
    monkeypatch.setattr(toxicity, "groups", lambda docs, of: {i: i for i in of})
    toxicity.train(toxic + clean, [True] * 10 + [False] * 45, epochs=1)
    assert sum(rows) == 55 * 900


def test_toxicity_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels, F.lit(True))
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(odd_docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.0} and toxicity.score(odd_docs.limit(0), none).count() == 0


def test_bounded_sample_is_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    a, b = least_by_hash(df, "doc_id", 100), least_by_hash(df.repartition(7), "doc_id", 100)
    assert a == b and len(set(a)) == 100 and len(least_by_hash(df.limit(30), "doc_id", 100)) == 30
