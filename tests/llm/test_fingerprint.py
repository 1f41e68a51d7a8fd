import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from fogbank.llm import fingerprint


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_likeness_estimates_generalised_jaccard(prose):
    s, errors = fingerprint.Sampler(), []
    for i in range(60):
        a = prose(i, 120)
        b = fingerprint.edited(a, prose(i + 500, 120))
        errors.append(fingerprint.likeness(s.fingerprint(a), s.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_small_caches_give_the_same_fingerprint(prose):
    text = prose(1, 3000)
    assert fingerprint.Sampler(64).fingerprint(text) == fingerprint.Sampler().fingerprint(text)


@pytest.mark.parametrize("blocks", [1, 5])
def test_successors(spark, prose, blocks):
    docs = [(i * 2, prose(i, 3 + i)) for i in range(30)]
    got = {r.doc_id: r for r in fingerprint.with_successors(spark.createDataFrame(docs, "doc_id long, text string"), blocks=blocks).collect()}
    order, s = sorted(docs, reverse=True), fingerprint.Sampler()
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        assert got[i].n_chars == len(text) and got[i].fingerprint == s.fingerprint(text)
        assert got[i].edited_fingerprint == s.fingerprint(text[: len(text) - len(text) // 2] + following[: len(text) // 2])
        assert got[i].near_next == fingerprint.likeness(s.fingerprint(text), s.fingerprint(following))


def slow_fingerprint(text):
    """The same samples, one word and one hash function at a time, from the definition."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    counts = Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in text).split())
    out = ""
    for k in range(1, fingerprint.SAMPLES + 1):
        best = None
        for word, n in counts.items():
            h = xxhash.xxh3_64_intdigest(word.encode())
            seed = mix((h + k * 0x9E3779B97F4A7C15) & mask)
            u = [((mix((seed + i * 0x632BE59BD9B4E019) & mask) >> 40) + 0.5) / 2**24 for i in range(1, 6)]
            r, c, b = -math.log(u[0]) - math.log(u[1]), -math.log(u[2]) - math.log(u[3]), u[4]
            t = math.floor(math.log(n) / r + b)
            score = c * math.exp(-r * (t - b + 1))
            if best is None or score < best[0]:
                best = (score, mix(h + mix((t + 1) & mask) & mask) >> 48)
        out += f"{best[1]:04x}"
    return out


def test_query_columns_equal_a_slow_version(spark, prose):
    docs = [(i, ("Ü " if i % 3 else "") + prose(i, 5 + 4 * i) + " same same Same") for i in range(12)]
    got = {r.doc_id: r for r in fingerprint.with_successors(spark.createDataFrame(docs, "doc_id long, text string"), blocks=3).collect()}
    share = lambda a, b: sum(a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4] for k in range(fingerprint.SAMPLES)) / fingerprint.SAMPLES
    for i, text in docs:
        following = docs[i - 1][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = slow_fingerprint(text), slow_fingerprint(changed), slow_fingerprint(following)
        # The operator draws in single precision: a near tie may fall to the other word.
        assert share(a, got[i].fingerprint) >= 0.98 and share(b, got[i].edited_fingerprint) >= 0.98
        assert abs(got[i].near_edited - share(a, b)) <= 0.04 and abs(got[i].near_next - share(a, c)) <= 0.04


def test_odd_rows(spark, odd_docs):
    got = fingerprint.with_successors(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_chars == 0 and by[3].fingerprint == by[4].fingerprint == fingerprint.EMPTY and by[0].fingerprint == by[1].fingerprint
    assert fingerprint.with_successors(odd_docs.limit(0)).count() == 0
    lone = fingerprint.with_successors(spark.createDataFrame([(None, "ab cd")], "doc_id long, text string")).collect()
    assert len(lone) == 1 and lone[0].doc_id is None and lone[0].near_next == 1.0


def test_every_oracle_is_sql_text():
    import __spark_entry__

    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
