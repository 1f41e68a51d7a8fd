"""MinHash near-duplicates by a multi-index Hamming join (operator 1).

1. A document's set is its distinct 5-word shingles (64-bit hashes). Equal sets form one class, so exact copies are
   handled once; the class id is its smallest doc_id.
2. A class's signature has K = CHUNKS * WIDTH minimum hashes of 16 bits. Two signatures that differ in at most
   RADIUS = 2 * CHUNKS - 1 positions agree, by the pigeonhole principle, in some chunk up to one position. Each chunk is
   therefore indexed under every way of allowing one error (leaving one of its positions out), so every pair within
   RADIUS meets in a bucket. A pair of similarity 0.75 fails to meet only if all chunks have two errors or more:
   (1 - 0.75**4 - 4 * 0.25 * 0.75**3) ** 9, about 6e-6, and rarer above.
3. Buckets don't emit pairs. First each member is compared with its buckets' smallest and largest member only; links
   are confirmed on the full sets, and components contract. Only buckets that still hold several components go on:
   members are dealt in blocks of bounded size (so a huge bucket is many tasks), rows of the bucket's largest component
   meet only those outside it, and each block compares its sets and emits at most a spanning forest of confirmed links.
   A bucket with more than REFINE members outside its largest component is indexed again by the pigeonhole on the
   remaining chunks, which keeps the guarantee.
4. Components by minimum-label propagation with pointer jumping.

Links: 100 * |A and B| >= 75 * |A or B|. Words are lower-cased (A-Z) runs of non-white-space; a text of fewer than
five words is one shingle; null text or text without words has an empty set and links with nothing. Repeated rows are
in one class; ids are expected to be unique per text; an empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents, durable, release

SHINGLE = 5
CHUNKS, WIDTH = 9, 4
K = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
#: Differing positions beyond which a pair isn't compared: P(more | similarity 0.75) is about 1e-7.
FAR = 23
BLOCK = 256
#: Bytes of text in a part of a block, about: longer texts make smaller parts.
BLOCK_BYTES = 8 << 20
REFINE = 4096
#: Ids that may be broadcast to filter documents: 8 bytes each.
FEW_IDS = 100_000
SETS_KEPT = 64
PERCENT = 75

_RNG = np.random.default_rng(20240501)
_MUL = _RNG.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, K, dtype=np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], dtype=np.uint64)
    out = h[: n - SHINGLE + 1] * _PLACE[0]
    for i in range(1, SHINGLE):
        out = mixed(out + h[i : n - SHINGLE + 1 + i] * _PLACE[i]) if i == SHINGLE - 1 else out + h[i : n - SHINGLE + 1 + i] * _PLACE[i]
    return np.unique(out)


def signature(s: np.ndarray) -> bytes:
    """K minimum hashes, 16 bits of each."""
    least = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(least, (s[i : i + 2048, None] * _MUL + _ADD).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16).tobytes()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, size (bytes of text), h1, h2 (the set's 128-bit hash), sig."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["t"], strict=True):
                s = shingles(text, hashes)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((doc, len(s), len(text or b""), (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), signature(s) if len(s) else b""))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "size", "h1", "h2", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInPandas(
        rows, "doc_id long, n_shingles long, size long, h1 long, h2 long, sig binary"
    )


def index(classes: DataFrame) -> DataFrame:
    """key, cid for each chunk and each place of the allowed error: 48 bits of symbols below 16 bits of chunk and place."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch["sig"]), dtype=np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            keys = np.empty((len(batch), CHUNKS * WIDTH), dtype=np.uint64)
            for c in range(CHUNKS):
                for out in range(WIDTH):
                    a, b, d = (sig[:, c, i] for i in range(WIDTH) if i != out)
                    keys[:, c * WIDTH + out] = np.uint64(c * WIDTH + out) << np.uint64(48) | a << np.uint64(32) | b << np.uint64(16) | d
            yield pd.DataFrame({"key": keys.reshape(-1).astype(np.int64), "cid": np.repeat(batch["cid"].to_numpy(), keys.shape[1])})

    return classes.select("cid", "sig").mapInPandas(rows, "key long, cid long")


def refined(members: DataFrame) -> DataFrame:
    """Members of huge buckets under finer keys: some other chunk has at most RADIUS // (CHUNKS - 1) = 2 errors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = list(combinations(range(WIDTH), WIDTH - RADIUS // (CHUNKS - 1)))
        for batch in batches:
            if not len(batch):
                continue
            sig = np.frombuffer(b"".join(batch["sig"]), dtype=np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
            key = batch["key"].to_numpy().astype(np.uint64)
            own = (key >> np.uint64(48)).astype(int) // WIDTH
            for c in range(CHUNKS):
                some = np.flatnonzero(own != c)
                for i, (a, b) in enumerate(pairs):
                    at = np.uint64(c * len(pairs) + i) << np.uint64(32) | sig[some, c, a] << np.uint64(16) | sig[some, c, b]
                    finer = mixed(mixed(key[some]) + at)
                    yield batch.iloc[some].assign(key=finer.astype(np.int64))

    return members.mapInPandas(rows, members.schema)


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b), written down, whose full sets are linked; docs: doc_id, text."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.select("doc_id", "t")
    if ids.count() <= FEW_IDS:
        texts = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, recent = WordHashes(), OrderedDict()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"], strict=True):
                if (sa := recent.get(a)) is None:
                    sa = recent[a] = shingles(ta, hashes)
                    if len(recent) > SETS_KEPT:
                        recent.popitem(last=False)
                keep.append(linked(sa, shingles(tb, hashes)))
            yield batch.loc[keep, ["a", "b"]]

    second = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b")
    both = second.join(texts.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(rows, "a long, b long")


def near(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most FAR positions."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), dtype=np.uint16).reshape(-1, K) for c in ("sa", "sb"))
            yield batch.loc[(x != y).sum(1) <= FAR, ["a", "b"]]

    with_b = pairs.join(signatures.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    with_a = with_b.join(signatures.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a")
    return with_a.select("a", "b", "sa", "sb").mapInPandas(rows, "a long, b long")


def components(edges: DataFrame, scratch: list | None = None) -> DataFrame:
    """id, label (the smallest id reachable) for every id in edges (a, b)."""
    own, last = [], []
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), own)
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), last)
    while True:
        # the least label among the neighbours, then the label of that label
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(around, labels["id"] == around["a"]).select("id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = durable(lower.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), own)
        release(last)
        last.append(own.pop())
        labels = new.select("id", "label")
        if not new.where(F.col("old") != F.col("label")).limit(1).count():
            release(own)
            if scratch is not None:
                scratch += last
            return labels


def sets_in_blocks(rows: DataFrame, confirm: bool) -> DataFrame:
    """Streams blocks (key, i, j), sorted, and compares members of different labels.

    Without confirm: the members (key, cid) that have such a partner within FAR whose first common bucket this is.
    With confirm: at most a spanning forest of the confirmed links (a, b) of each block.
    """
    names = ["key", "i", "j"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            cols = [batch[c].to_numpy() for c in names]
            new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])))
            starts = np.flatnonzero(new)
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield batch.iloc[s:e]
            held = batch.iloc[starts[-1] :]
        if held is not None and len(held):
            yield held

    def candidates(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Places (x, y) in the block of the pairs to compare."""
        sig = np.frombuffer(b"".join(block["sig"]), dtype=np.uint16).reshape(-1, K)
        label, part, major = (block[c].to_numpy() for c in ("label", "part", "major"))
        i, j = int(block["i"].iloc[0]), int(block["j"].iloc[0])
        out = []
        for x in range(len(block)):
            far = (sig[x + 1 :] != sig[x]).sum(1)
            ok = (far <= FAR) & (label[x + 1 :] != label[x]) & ~(major[x + 1 :] & major[x])
            if i != j:  # pairs inside one part belong to its own block
                ok &= part[x + 1 :] != part[x]
            out.append(np.flatnonzero(ok) + x + 1)
        xs = np.repeat(np.arange(len(block)), [len(o) for o in out])
        ys = np.concatenate(out) if out else np.empty(0, dtype=int)
        if len(xs):  # a pair is compared in its first common bucket only
            same = (sig[xs] == sig[ys]).reshape(-1, CHUNKS, WIDTH)
            wrong = WIDTH - same.sum(2)
            chunk = (wrong <= 1).argmax(1)
            bad = (~same[np.arange(len(xs)), chunk]).argmax(1)  # the place of the error, or the first place
            first = chunk * WIDTH + bad
            mine = (block["top"].to_numpy()[xs]) == first
            xs, ys = xs[mine], ys[mine]
        return xs, ys

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks(batches):
            xs, ys = candidates(block)
            some = np.union1d(xs, ys)
            if len(some):
                yield block.iloc[some][["key", "top", "cid"]]

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for block in blocks(batches):
            xs, ys = candidates(block)
            if not len(xs):
                continue
            ids, texts = block["cid"].tolist(), block["t"].tolist()
            root: dict = {}

            def find(v):
                while root.setdefault(v, v) != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            sets: dict[int, np.ndarray] = {}
            out, label = [], block["label"].tolist()
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                a, b = find(label[x]), find(label[y])
                if a == b:
                    continue
                for z in (x, y):
                    if z not in sets:
                        sets[z] = shingles(texts[z], hashes)
                if linked(sets[x], sets[y]):
                    root[a] = b
                    out.append((ids[x], ids[y]))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.mapInPandas(links, "a long, b long") if confirm else rows.mapInPandas(members, "key long, top int, cid long")


def dealt(members: DataFrame, block: int, block_bytes: int, scratch: list) -> DataFrame:
    """Members (key, top, cid, label, sig, size, ...) in blocks: i, j, part, major are added; rows are sorted by block.

    A part has about ``block`` members, or fewer where their texts would pass block_bytes.
    """
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    totals = sizes.groupBy("key").agg(F.max(F.struct("n", "label", "bytes")).alias("top_label"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.count("*").alias("labels"))
    # Written down, so that both sides of the join are plain shuffles: Spark can then split a huge bucket.
    parts = lambda n, size: F.ceil(F.greatest(n / block, size / block_bytes)).cast("int")
    top = F.col("top_label")
    totals = durable(totals.where(F.col("labels") > 1).select("key", top["label"].alias("big"), parts(F.col("all") - top["n"], F.col("all_bytes") - top["bytes"]).alias("p"), parts(top["n"], top["bytes"]).alias("q")), scratch)
    rows = members.join(totals, "key").withColumn("major", F.col("label") == F.col("big"))
    # Minor rows are dealt in parts 0..p-1, major rows in parts p..p+q-1; blocks are the pairs of parts with a minor one.
    h = F.xxhash64("cid")
    rows = rows.withColumn("part", F.when(F.col("major"), F.col("p") + F.pmod(h, "q")).otherwise(F.pmod(h, "p")).cast("int"))
    # A minor row meets every part, a major row the minor parts.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("major"), F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1))))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", "p", "q", "big")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid")


def remaining_links(members: DataFrame, signatures: DataFrame, texts: DataFrame, block: int = BLOCK, refine: int = REFINE, block_bytes: int = BLOCK_BYTES, scratch: list | None = None) -> DataFrame:
    """Confirmed links between different labels of a bucket; members: key, cid, label."""
    scratch = [] if scratch is None else scratch
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
    mixed_keys = sizes.agg((F.sum("n") - F.max("n")).alias("minor"), F.count("*").alias("labels")).where(F.col("labels") > 1)
    mixed_keys = durable(mixed_keys, scratch)
    top = F.shiftrightunsigned("key", 48).cast("int").alias("top")
    rows = members.join(mixed_keys.select("key", "minor"), "key").join(signatures.select("cid", "sig", "size"), "cid").select("key", top, "cid", "label", "sig", "size", "minor")
    rows = durable(rows, scratch)
    usual = rows.where(F.col("minor") <= refine).drop("minor")
    huge = rows.where(F.col("minor") > refine).drop("minor")
    if huge.limit(1).count():
        usual = usual.unionByName(refined(huge))
    # The first comparison needs no texts, so only the number of members bounds its blocks.
    some = sets_in_blocks(dealt(usual.withColumn("size", F.lit(0)), block, block_bytes, scratch), confirm=False).distinct()
    chosen = durable(usual.join(some, ["key", "top", "cid"], "left_semi").distinct(), scratch)
    ids = chosen.select("cid").distinct()
    docs = texts
    if ids.count() <= FEW_IDS:
        docs = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("cid"), "left_semi")
    with_text = chosen.join(docs.select(F.col("doc_id").alias("cid"), "t"), "cid")
    return sets_in_blocks(dealt(with_text, block, block_bytes, scratch), confirm=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, refine: int = REFINE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    scratch: list = []
    profile = durable(profiles(docs, id_col, text_col))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    some = F.col("n_shingles") > 0
    classes = durable(profile.where(some).groupBy("h1", "h2").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig"), F.max("size").alias("size")))
    buckets = index(classes)
    shared = buckets.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).where("least <> most")
    members = durable(buckets.join(shared, "key"), scratch)
    star = members.select(F.col("least").alias("a"), F.col("cid").alias("b")).union(members.select(F.col("most").alias("a"), F.col("cid").alias("b")))
    star = star.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = durable(near(star, classes), scratch)
    links = durable(confirmed(pairs, texts), scratch)
    label = components(links)
    labelled = members.select("key", "cid").join(label, F.col("cid") == F.col("id"), "left").select("key", "cid", F.coalesce("label", "cid").alias("label"))
    more = durable(remaining_links(labelled, classes, texts, block, refine, block_bytes, scratch), scratch)
    if more.limit(1).count():
        label = components(links.union(more))
    release(scratch)  # what follows reads the profiles, classes and labels only
    named = classes.select("h1", "h2", "cid").join(label, F.col("cid") == F.col("id"), "left").select("h1", "h2", F.coalesce("label", "cid").alias("component"))
    empty = profile.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = profile.where(some).join(named, ["h1", "h2"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return full.union(empty).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


OP1_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(ws[i:i + least(len(ws), 5) - 1]) AS x
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT u, v FROM e JOIN n p ON p.doc_id = u JOIN n q ON q.doc_id = v WHERE 100 * k >= 75 * (p.n + q.n - k)),
r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.reach = l.u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""
