"""Substring dedup by difference-cover anchors (operator 2).

A window of 13 words that starts in a document with a smaller id as well is removed. Windows aren't all compared:
anchors are 7-word windows that start at positions p with p mod 7 in the difference cover {1, 2, 4}. For any two
positions some shift below 7 brings both into the cover, so two equal 13-word windows, wherever they start, share an
anchor at the same shift, and 7 + 6 words fit into 13. So:

1. Documents are dealt to parts by a hash of their id. Each part sends the hashes of its distinct anchors to buckets;
   a bucket answers each part with those that other parts have as well.
2. Windows that contain such an anchor (or one that two of the part's own documents share) are the candidates: the
   anchor extends to the 13 words around it. Each part sends its candidates' 128-bit hashes, under their smallest
   document; a bucket answers with those that a smaller document elsewhere has.
3. Each part marks the words that such windows, or windows of a smaller document of its own, cover.

A hash is sent once per part, not per document, so passages that very many documents share and large groups of copies
cost one row per part. Anchors only select, so 32 bits of a hash do; windows decide, by two independent 64-bit sums over
128-bit hashes of their words: 10**13 windows have a colliding pair with a probability of about 10**-13. A part is at most
PART_BYTES of text, or one longer document, and takes some 100 bytes a word.

Words are runs of non-white-space, unchanged. Windows are judged on the input. Null text has no words; a text of fewer
than 13 words keeps all; rows with one id don't remove each other's words; a null id counts as the largest; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents, partitions
from fogbank.llm.minhash import mixed

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text for each part and bucket at most, however few shuffle partitions are set.
PART_BYTES = 64 << 20
LAST = np.iinfo(np.int64).max

_BASE = np.uint64(0x9E6C63D0676A9A99)
_BUCKET = np.uint64(0xD1342543DE82EF95)


class WordDigests(dict):
    """128-bit hashes of words as bytes; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h


class Part:
    """The documents of one part in id order, as one long array of word hashes."""

    def __init__(self, pdf: pd.DataFrame):
        ids = pdf["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        texts = pdf["t"].tolist()
        self.texts = [texts[i] for i in order]
        self.known = pdf["known"].to_numpy()[order]
        digests = WordDigests()
        size, pieces = [], []
        for t in self.texts:
            ws = t.split() if t else []
            size.append(len(ws))
            pieces.append(b"".join(map(digests.__getitem__, ws)))
        self.size = np.array(size, dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        h = np.frombuffer(b"".join(pieces), dtype=np.uint64).reshape(-1, 2)
        n = len(h)
        self.doc = np.repeat(np.arange(len(size)), self.size)
        self.at = np.arange(n) - self.start[self.doc] if n else np.empty(0, dtype=np.int64)
        self.left = self.size[self.doc] - self.at if n else np.empty(0, dtype=np.int64)
        # h[0] + h[1] * b + ...: a stretch's sum, divided by the power at its start, depends on its words only
        power = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, _BASE))))[:n]
        self.sums = [np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h[:, k] * power, dtype=np.uint64))) for k in (0, 1)]

    def hashes(self, starts: np.ndarray, length: int, k: int = 0) -> np.ndarray:
        """The hashes of the stretches that begin at starts; k: which of the two independent ones."""
        raw = (self.sums[k][starts + length] - self.sums[k][starts]) * _inverse_powers(len(self.sums[k]))[starts]
        return mixed(raw + np.uint64(length))

    def anchors(self) -> np.ndarray:
        cover = np.isin(self.at % PERIOD, COVER)
        return np.flatnonzero(cover & (self.left >= ANCHOR) & (self.size[self.doc] >= WINDOW))

    def windows(self) -> np.ndarray:
        return np.flatnonzero(self.left >= WINDOW)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_inverse = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        _inverse = np.cumprod(np.concatenate((np.ones(1, dtype=np.uint64), np.full(n, _INVERSE))))
    return _inverse


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal rows together, earlier ones first, and where a group of it begins; the last key counts most."""
    order = np.lexsort(keys)
    first = np.ones(len(order), dtype=bool)
    if len(order):
        first[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, first


def _among(x: np.ndarray, y: np.ndarray, answers: list[np.ndarray]) -> np.ndarray:
    """Whether each pair of hashes (x, y) is one of the answers (rows of two)."""
    known = np.concatenate(answers)
    out = np.isin(x, known[:, 0])
    some = np.flatnonzero(out)
    order, first = _grouped(np.concatenate((known[:, 1], y[some])), np.concatenate((known[:, 0], x[some])))
    # known rows come first, so a group that has one begins with one
    out[some] = False
    hit = (order[first] < len(known))[np.cumsum(first) - 1]
    mine = order >= len(known)
    out[some[order[mine] - len(known)]] = hit[mine]
    return out


def _anchor_keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper, 32 bits of the hash in the lower half."""
    return (mixed(h * _BUCKET) % np.uint64(buckets)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each stretch of a sorted array."""
    if not len(bucket):
        return []
    starts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _shared_anchors(part: Part, answers: pd.DataFrame, buckets: int) -> np.ndarray:
    """Word positions of the part's anchors that another document has too."""
    at = part.anchors()
    keys = _anchor_keys(part.hashes(at, ANCHOR), buckets)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], part.doc[at[order]]
    group = np.cumsum(np.concatenate(([0], k[1:] != k[:-1]))) if len(k) else np.empty(0, dtype=int)
    several = np.zeros(len(k), dtype=bool)
    if len(k):  # positions run through the documents in order, so the ends of a group tell whether it has two
        first = np.concatenate(([True], k[1:] != k[:-1]))
        lo = d[np.flatnonzero(first)]
        hi = d[np.concatenate((np.flatnonzero(first)[1:] - 1, [len(k) - 1]))]
        several = (lo != hi)[group]
    known = [np.uint64(b) << np.uint64(32) | np.frombuffer(v, dtype=np.uint32).astype(np.uint64) for b, v in zip(answers["bucket"], answers["vals"], strict=True)]
    if known:
        several |= np.isin(k, np.concatenate(known))
    out = np.zeros(len(part.doc), dtype=bool)
    out[at[order[several]]] = True
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by a space) for each row of docs."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    parts = max(2 * partitions(spark), -(-total // PART_BYTES))
    buckets = max(partitions(spark), -(-total // PART_BYTES))
    ident = F.col(id_col).cast("long")
    dealt = docs.select(
        F.coalesce(ident, F.lit(LAST)).alias("id"), ident.isNotNull().alias("known"), F.col(text_col).cast("binary").alias("t")
    ).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(parts, "part")

    def send_anchors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = Part(pdf)
        keys = np.unique(_anchor_keys(part.hashes(part.anchors(), ANCHOR), buckets))
        low = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = [(b, key[0], low[i:j].tobytes()) for b, i, j in _by_bucket(keys >> np.uint64(32))]
        return pd.DataFrame(rows, columns=["bucket", "part", "vals"])

    def answer_anchors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        vals = [np.frombuffer(v, dtype=np.uint32) for v in pdf["vals"]]
        every = np.sort(np.concatenate(vals))
        twice = np.unique(every[1:][every[1:] == every[:-1]])  # a part sends a value once
        out = []
        for p, v in zip(pdf["part"], vals, strict=True):
            hit = v[np.isin(v, twice, assume_unique=True)]
            if len(hit):
                out.append((key[0], p, hit.tobytes()))
        return pd.DataFrame(out, columns=["bucket", "part", "vals"])

    def send_windows(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "part", "docs", "counts", "vals"]
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        part = Part(pdf)
        upto = np.concatenate(([0], np.cumsum(_shared_anchors(part, answers, buckets))))
        w = part.windows()
        w = w[upto[w + PERIOD] > upto[w]]  # the anchor starts at one of the window's first 7 words
        x, y = part.hashes(w, WINDOW), part.hashes(w, WINDOW, 1)
        order, first = _grouped(y, x)
        some = order[first]  # the first occurrence is in the smallest document
        x, y, doc = x[some], y[some], part.doc[w[some]]
        bucket = (mixed(x * _BUCKET) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((x, doc, bucket))
        h, doc, bucket = np.stack((x[order], y[order]), 1), doc[order], bucket[order]
        out = []
        for b, i, j in _by_bucket(bucket):
            ds, n = np.unique(doc[i:j], return_counts=True)
            out.append((b, key[0], part.ids[ds].astype(np.int64).tobytes(), n.astype(np.int32).tobytes(), h[i:j].tobytes()))
        return pd.DataFrame(out, columns=columns)

    def answer_windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(v, dtype=np.uint64).reshape(-1, 2) for v in pdf["vals"]]
        doc = [np.repeat(np.frombuffer(d, dtype=np.int64), np.frombuffer(n, dtype=np.int32)) for d, n in zip(pdf["docs"], pdf["counts"], strict=True)]
        hs, ds = np.concatenate(h), np.concatenate(doc)
        order, first = _grouped(hs[:, 1], hs[:, 0])
        least = np.empty(len(hs), dtype=np.int64)
        least[order] = np.minimum.reduceat(ds[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        out, at = [], 0
        for p, v, d in zip(pdf["part"], h, doc, strict=True):
            hit = v[least[at : at + len(v)] < d]
            at += len(v)
            if len(hit):
                out.append((p, hit.tobytes()))
        return pd.DataFrame(out, columns=["part", "vals"])

    def remove(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_words", "n_removed", "kept"]
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        part = Part(pdf)
        w = part.windows()
        x, y = part.hashes(w, WINDOW), part.hashes(w, WINDOW, 1)
        mine = part.ids[part.doc[w]] if len(w) else np.empty(0, dtype=np.int64)
        order, first = _grouped(y, x)
        gone = np.zeros(len(w), dtype=bool)
        gone[order] = mine[order[first]][np.cumsum(first) - 1] < mine[order] if len(w) else False
        if len(answers) and len(w):
            gone |= _among(x, y, [np.frombuffer(v, dtype=np.uint64).reshape(-1, 2) for v in answers["vals"]])
        edge = np.zeros(len(part.doc) + 1, dtype=np.int64)
        np.add.at(edge, w[gone], 1)
        np.add.at(edge, w[gone] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out = []
        for doc, known, text, s, n in zip(part.ids.tolist(), part.known, part.texts, part.start.tolist(), part.size.tolist(), strict=True):
            words, bad = text.split() if text else [], covered[s : s + n]
            removed = int(bad.sum())
            if removed:
                words = [x for x, b in zip(words, bad.tolist(), strict=True) if not b]
            out.append((doc if known else None, n, removed, b" ".join(words).decode()))
        return pd.DataFrame(out, columns=columns)

    anchors = dealt.groupBy("part").applyInPandas(send_anchors, "bucket int, part int, vals binary")
    shared = anchors.groupBy("bucket").applyInPandas(answer_anchors, "bucket int, part int, vals binary")
    by_part = dealt.groupBy("part")
    windows = by_part.cogroup(shared.groupBy("part")).applyInPandas(send_windows, "bucket int, part int, docs binary, counts binary, vals binary")
    smaller = windows.groupBy("bucket").applyInPandas(answer_windows, "part int, vals binary")
    return by_part.cogroup(smaller.groupBy("part")).applyInPandas(remove, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP2_SQL = r"""WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (
  SELECT doc_id, i, hash(ws[i:i + 12]) AS h, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h, s) AS least FROM x) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g),
k AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
t AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM (
    SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)"""
