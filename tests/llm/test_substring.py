import random
import re

import numpy as np
import pandas as pd
import pytest

from fogbank.llm import substring


def brute(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.fixture(scope="module")
def corpus(prose):
    rnd, out = random.Random(3), []
    passages = [prose(50 + i, n) for i, n in enumerate((12, 13, 14, 19, 40))]
    for i in range(60):
        parts = [prose(i, rnd.randrange(5, 40))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), prose(1000 + i, rnd.randrange(1, 9))]
        out.append("\n".join(parts))
    return list(enumerate(out + out[:5]))


def test_removal_equals_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string")).collect()}
    want = brute(corpus)
    assert got == want and sum(n for _, n, _ in want.values()) > 300


def test_windows_that_share_one_hash_are_told_apart(spark, corpus, monkeypatch):
    hashes = substring.Part.hashes
    monkeypatch.setattr(substring.Part, "hashes", lambda self, at, n, k=0: hashes(self, at, n, k) % np.uint64(50) if n == substring.WINDOW and not k else hashes(self, at, n, k))
    ids, texts = zip(*corpus, strict=True)
    part = substring.Part(pd.DataFrame({"id": ids, "t": [t.encode() for t in texts], "known": True}))
    w = part.windows()
    order, first = substring._grouped(part.hashes(w, 13, 1), part.hashes(w, 13))
    words = [" ".join(t.split()[k : k + 13]) for t in texts for k in range(len(t.split()) - 12)]
    assert first.sum() == len(set(words)) and len({words[i] for i in order[first]}) == first.sum()
    some = order[first][::2]
    answers = [np.stack((part.hashes(w[some], 13), part.hashes(w[some], 13, 1)), 1)]
    known = {words[i] for i in some}
    assert substring._among(part.hashes(w, 13), part.hashes(w, 13, 1), answers).tolist() == [x in known for x in words]


def test_any_two_positions_share_an_anchor():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substring.COVER and (j + d) % 7 in substring.COVER for d in range(7))
    assert substring.ANCHOR + 6 == substring.WINDOW


def test_odd_rows(spark, odd_docs):
    got = substring.remove_repeats(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == 0 and by[3].kept == "" and by[1].n_removed == by[1].n_words == 60 and by[0].n_removed == 0
    assert by[2].kept == "tail" and by[10].n_words == 4 and by[11].n_removed == 0
    assert substring.remove_repeats(odd_docs.limit(0)).count() == 0
