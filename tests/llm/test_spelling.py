import random
import re
import zlib
from collections import Counter

import pytest

from fogbank.llm import spelling


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def grouped(n):
    near = {w: [v for v in n if v != w and distance_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def collected(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@pytest.fixture(scope="module")
def vocabulary():
    """Words with all kinds of errors: short alphabets make many near words, runs make one error possible in several ways."""
    rnd = random.Random(3)
    n = {}
    for _ in range(700):
        n["".join(rnd.choice("ab") for _ in range(rnd.randrange(5, 11)))] = rnd.randrange(3, 400)
    for _ in range(500):
        w = "".join(rnd.choice("aeioustrnßé×") for _ in range(rnd.randrange(5, 16)))
        for k in range(rnd.randrange(1, 5)):
            n[w] = rnd.randrange(3, 2000)
            i = rnd.randrange(len(w))
            w = max((w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "z" + w[i + 1 :])[k % 3], w[:5], key=len)
    n |= {"a" * k: 10 * 2**k for k in range(5, 14)} | {"x" * 300: 5, "x" * 301: 10, "x" * 150 + "y" + "x" * 150: 4}
    return {w: k for w, k in n.items() if len(w) >= 5}


def test_automaton_is_minimal_and_numbers_words():
    listed = sorted({w.encode() for w in "work works worked working walk walks walked walking talk talks talked talking a".split()} | {b"t", b"te"})
    auto = spelling.Automaton(listed)
    assert [auto.number(w) for w in listed] == list(range(len(listed)))
    assert [auto.number(w) for w in (b"", b"wor", b"workx", b"zz", b"ta")] == [None] * 5
    futures = {w[i:] for w in listed for i in range(len(w) + 1)}
    prefixes = {w[:i] for w in listed for i in range(len(w) + 1)}
    rest = {p: frozenset(w[len(p) :] for w in listed if w.startswith(p)) for p in prefixes}
    assert len(auto.final) == len(set(rest.values())) and futures
    assert spelling.Automaton([]).number(b"a") is None
    assert spelling.Automaton([b"abc"]).number(b"abc") == 0


def test_search_finds_all_and_each_once(vocabulary):
    listed = sorted(w.encode("latin-1") for w in vocabulary)
    auto = spelling.Automaton(listed)
    asked = listed[::7] + [b"aaaaaa", b"nothing"]
    for part in (2, 3):
        q, number = auto.one_error(asked, spelling.np.array([len(w) // part for w in asked]))
        got = sorted(zip(q.tolist(), number.tolist(), strict=True))
        want = sorted(
            (i, k) for i, w in enumerate(asked) for k, v in enumerate(listed) if v[: len(w) // part] == w[: len(w) // part] and distance_one(v, w)
        )
        assert got == want and len(got) == len(set(got))


def test_a_collision_of_state_hashes_is_noticed(monkeypatch):
    listed = sorted(w.encode() for w in "ab abc b bcd cd".split())
    calls = []
    real = spelling._mixed

    def weak(x):
        calls.append(1)
        return real(x) if len(calls) > 40 else x * spelling.np.uint64(0)

    monkeypatch.setattr(spelling, "_mixed", weak)
    auto = spelling.Automaton(listed)
    assert [auto.number(w) for w in listed] == list(range(len(listed)))


@pytest.mark.parametrize("block", [50_000, 150])
def test_groups_equal_brute_force(spark, vocabulary, block):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3)
    assert collected(spelling.group_variants(df, block=block)) == grouped(vocabulary)


def test_texts_to_groups(spark, odd_docs, prose):
    rows = [(i, " ".join((prose(i % 5, 60), "Straße STRASSE École école naïve naive ××××× don't", prose(99 + i, 40).upper()))) for i in range(60)]
    rows += [(None, "wordwithoutid " * 4), (7, None), (8, ""), (9, "12 !!"), (10, "l" * 3000), (10, "l" * 3000), (10, "L" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'k' AS word", "1 AS n", "'r' AS root", "'key' AS key", "0 AS run").repartition(4)
    n = counted(rows)
    assert dict(map(tuple, spelling.words(df).collect())) == n
    assert collected(spelling.group_variants(spelling.words(df))) == grouped(n)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert dict(map(tuple, spelling.words(odd_docs).collect())) == counted(odd)


def test_very_long_words_take_time_in_proportion():
    import time

    def took(n):
        words = sorted([b"l" * n, b"l" * (n + 1), b"l" * (n // 3) + b"x" + b"l" * (n - n // 3), b"a" * 20, b"l" * n + b"qq", b"y" + b"l" * n])
        began = time.perf_counter()
        auto = spelling.Automaton(words)
        q, k = auto.one_error(words, spelling.np.array([len(w) // 2 for w in words]))
        got = {(words[i], words[j]) for i, j in zip(q.tolist(), k.tolist(), strict=True)}
        assert got == {(a, b) for a in words for b in words if distance_one(a, b) and a[: len(a) // 2] == b[: len(a) // 2]} or n > 2000
        assert (b"l" * n, b"l" * (n + 1)) in got
        return time.perf_counter() - began

    took(300)
    assert took(60_000) < 40
    assert [spelling.one_apart(*p) for p in ((b"ab", b"ab"), (b"ab", b"b"), (b"ab", b"abc"), (b"ab", b"ba"), (b"", b"a"), (b"abc", b"axc"), (b"abc", b"c"))] == [False, True, True, False, True, True, False]


def test_deletion_rule_applies(spark):
    rows = [(i, "hippopotamus") for i in range(600)]
    got = dict(map(tuple, spelling.words(spark.createDataFrame(rows, "doc_id int, text string")).collect()))
    assert got == counted(rows)
    assert spelling.words(spark.createDataFrame(rows, "doc_id int, text string"), deleted_every=None).collect()[0].n == 600


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.words(none)).collect() == []
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert collected(spelling.group_variants(one)) == [("alone", "", "alone", 3, 0, 0)]
