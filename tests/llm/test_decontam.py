import random
import re

import numpy as np
import pytest

from fogbank.llm import decontam


def norm(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, names = norm(t), set(), set()
        for name, it in items:
            x = norm(it)
            n = min(13, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    names.add(str(name))
        out[i] = (len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.fixture(scope="module")
def cases(prose):
    rnd = random.Random(9)
    items = [(i, prose(500 + i, 20 + i % 15)) for i in range(12)] + [(20, "short item here"), (21, "lone"), (22, ""), (23, None), (24, "!!!"), (25, prose(503, 18))]
    docs = []
    for i in range(60):
        t = prose(i, rnd.randrange(10, 200))
        if i % 2:
            w = (items[rnd.randrange(12)][1] or "").split()
            a = rnd.randrange(6)
            t += ". " + ", ".join(w[a : a + rnd.randrange(10, 20)]).upper() + " " + prose(i + 100, 20)
        docs.append((i, t + (" Short ITEM, here" if i % 7 == 0 else "") + (" lone" if i % 11 == 0 else "")))
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_hits_equal_brute_force(spark, cases, block):
    docs, items = cases
    blocks = decontam.automata(spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontam.judge(spark.createDataFrame(docs, "doc_id long, text string"), blocks).collect()}
    want = brute(docs, items)
    assert got == want and any(w[3] for w in want.values()) and len(blocks) == (1 if block > 1000 else len(blocks))


def test_several_passes_give_the_same(spark, cases, monkeypatch):
    docs, items = cases
    monkeypatch.setattr(decontam, "HELD", 2)
    items, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([*docs, docs[1], (None, docs[3][1]), (77, None)], "doc_id long, text string")
    blocks = decontam.automata(items, block_bytes=200)
    assert len(blocks) > 4
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontam.judge(df, blocks).where("doc_id < 77").collect()}
    assert got == brute(*cases) and decontam.judge(df, blocks).count() == len(docs) + 3
    left = decontam.uncontaminated(df, blocks)
    monkeypatch.setattr(decontam, "HELD", 1000)
    assert sorted(map(str, left.collect())) == sorted(map(str, decontam.uncontaminated(df, decontam.automata(items, block_bytes=200)).collect()))


def test_a_very_long_item(spark, prose):
    item = prose(8, 20_000)
    sam = decontam.Automaton([("a", decontam.words(item.encode())), ("b", decontam.words(prose(9, 50).encode()))])
    ids = np.array([sam.vocab.get(w, 0) for w in decontam.words(("x " + item + " x").encode())])
    hit = np.zeros(len(ids), dtype=bool)
    assert sam.stream(ids, hit) == ({"a"}, len(ids) - 2) and hit.sum() == len(ids) - 2


def test_cleaning_removes_only_hit_words(spark):
    item = " ".join(f"w{i}" for i in range(13))
    blocks = decontam.automata(spark.createDataFrame([(1, item)], "item_id long, text string"))
    text = f"Before, {item.upper()}! After é."
    r = decontam.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), blocks).first()
    assert r.contaminated and "w0" not in r.cleaned.lower() and r.cleaned.startswith("Before, ") and r.cleaned.endswith("After é.") and r.longest == 13


def test_odd_rows(spark, odd_docs):
    blocks = decontam.automata(spark.createDataFrame([(1, "one two"), (None, "9 9")], "item_id long, text string"))
    by = {r.doc_id: r for r in decontam.judge(odd_docs, blocks).collect()}
    assert by[6].n_hit == by[7].n_hit == 2 and by[3].n_words == 0 and not by[3].contaminated and by[8].n_hit == 3 and list(by[8]["items"]) == [""]
    none = decontam.automata(spark.createDataFrame([], "item_id long, text string"))
    assert decontam.judge(odd_docs, none).where("n_hit > 0").count() == 0 and decontam.judge(odd_docs.limit(0), blocks).count() == 0
    assert odd_docs.where(~decontam.contaminated(odd_docs, blocks)).count() == odd_docs.count() - 3
