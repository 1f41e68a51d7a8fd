import re

from pyspark.sql import functions as F

from fogbank.llm import secrets

TEXTS = [
    'x password = "abcdefgh1" and AKIAABCDEFGHIJKL12 end',
    "Token:short then SECRET: longenough99, api_key='ÄÖ' api-key=nothing99",
    "é" * 5 + " " + "0123456789abcdef" * 2 + " " + "f" * 31 + " passwd=passwd=12345678",
    "password = token: abcdefghij AKIA1 AKIAAKIAAKIAAKIA",
    "", None, "secret=" + "a1" * 20_000,
]


def brute(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(out)


def test_spans_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    v = secrets.versions(docs)
    got = {r.doc_id: [tuple(x) for x in r.found] for r in secrets.findings(v, secrets.scan_unseen(v)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)} and sum(map(len, got.values())) >= 6


def test_only_unseen_blobs_and_rules_are_scanned(spark):
    v = secrets.versions(spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[0]), (3, "clean")], "doc_id long, text string"))
    ledger = secrets.scan_unseen(v, secrets.empty_ledger(spark))
    assert ledger.count() == 2
    later = v.unionByName(secrets.versions(spark.createDataFrame([(4, TEXTS[2])], "doc_id long, text string")))
    assert secrets.scan_unseen(later, ledger).count() == 1
    assert secrets.scan_unseen(later, ledger, "base-2").count() == 3
    found = secrets.findings(later, ledger.unionByName(secrets.scan_unseen(later, ledger)))
    assert {r.doc_id for r in found.where(F.size("found") > 0).collect()} == {1, 2, 4}


def test_added_rules_find_more_and_a_long_text_is_whole(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- at https://me:pass1@host/x "
    long = "".join(f"é{i} AKIA{'Z' * 12} " for i in range(2000)) + text
    v = secrets.versions(spark.createDataFrame([(1, text), (2, long), (3, "://x")], "doc_id long, text string"))
    sets = tuple(secrets.RULE_SETS)
    ledger = secrets.scan_unseen(v, None, sets)
    assert ledger.count() == 6
    got = {r.doc_id: [tuple(x) for x in r.found] for r in secrets.findings(v, ledger, sets).collect()}
    added = lambda t: [(m.start(), 3, "pem", m.end()) for m in re.finditer(secrets.PEM, t)] + [(m.start(), 4, "login", m.end()) for m in re.finditer(secrets.LOGIN, t)]
    assert got == {1: added(text), 2: sorted(brute(long) + added(long)), 3: []} and len(got[2]) == 2002 and len(got[1]) == 2


def test_history_is_scanned_once(spark):
    sets = tuple(secrets.RULE_SETS)
    first = secrets.versions(spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[0]), (3, "clean"), (4, None)], "doc_id long, text string"))
    later = secrets.redacted(first)
    assert later.count() == 2 and later.where(F.col("text").contains("[redacted]")).count() == 2
    ledger = secrets.scan_unseen(first, None, sets)
    new = secrets.scan_unseen(first.unionByName(later), ledger, sets)
    assert (ledger.count(), new.count()) == (6, 2)
    part = ledger.where(F.col("rules") == secrets.RULE_VERSION)  # an older ledger, from before the added rules
    assert {r.rules: r["count"] for r in secrets.scan_unseen(first, part, sets).groupBy("rules").count().collect()} == {secrets.ADDED_VERSION: 3}


def test_odd_rows(spark, odd_docs):
    v = secrets.versions(odd_docs)
    assert secrets.findings(v, secrets.scan_unseen(v)).count() == odd_docs.count()
    assert secrets.scan_unseen(secrets.versions(odd_docs.limit(0))).count() == 0


def test_a_long_run_without_an_address_takes_linear_time(spark):
    import time

    def took(n):
        df = secrets.versions(spark.createDataFrame([(1, "http://x " + "z" * n)], "doc_id long, text string"))
        began = time.perf_counter()
        assert secrets.scan_unseen(df, None, tuple(secrets.RULE_SETS)).select(F.sum(F.size("found"))).first()[0] == 0
        return time.perf_counter() - began

    took(1000)
    assert took(1_000_000) < 10
    long_scheme = secrets.versions(spark.createDataFrame([(1, "b" * 50 + "://me:pass@host")], "doc_id long, text string"))
    assert secrets.scan_unseen(long_scheme, None, secrets.ADDED_VERSION).first().found[0].start == 19


def test_the_query_shows_what_each_scan_of_the_history_does(spark, tmp_path, monkeypatch):
    """Without the ledger's anti-join pairs are found twice; without the scan of later versions their spans are missing."""
    texts = [*TEXTS, "at https://me:pass1@host/x password=abcdefgh12345 and " + "0123456789abcdef" * 2, "-----BEGIN RSA PRIVATE KEY-----"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[7])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op9_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 2
    every = lambda t: sorted([*brute(t), *[(m.start(), 3, "pem", m.end()) for m in re.finditer(secrets.PEM, t or "")], *[(m.start(), 4, "login", m.end()) for m in re.finditer(secrets.LOGIN, t or "")]])
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    for r in got:
        text = texts[7 if r.doc_id is None else r.doc_id]
        clean = re.sub(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "[redacted]", text or "", flags=re.A)
        assert r.spans == listed(every(text)) and r.later_spans == (listed(every(clean)) if clean != (text or "") else None)
    assert sum(r.later_spans not in (None, "") for r in got) >= 3
    plain = secrets.scan_unseen
    monkeypatch.setattr(secrets, "scan_unseen", lambda v, ledger, sets: plain(v, None, sets))
    assert sorted(map(str, secrets.op9_secrets(spark, str(tmp_path)).collect())) != sorted(map(str, got))
    monkeypatch.undo()
    real = secrets.scanned
    monkeypatch.setattr(secrets, "scanned", lambda history: real(history[:2]))
    assert sum(r.later_spans not in (None, "") for r in secrets.op9_secrets(spark, str(tmp_path)).collect()) < sum(r.later_spans not in (None, "") for r in got)
