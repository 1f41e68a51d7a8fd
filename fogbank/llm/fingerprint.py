"""Document fingerprints by consistent weighted sampling (operator 6).

A text is the multiset of its words (lower-cased A-Z, split at ASCII white space), each weighted by its count. For
each of SAMPLES hash functions every word draws, from its own hash, r and c from Gamma(2, 1) and b from U(0, 1);
with t = floor(ln(weight) / r + b) the word with the least c * exp(-r * (t - b + 1)) is the sample, together with its t.
Two texts' samples agree with probability sum(min weights) / sum(max weights), the generalised Jaccard similarity.
A sample is kept as 16 bits, a fingerprint is their hexadecimal text.

The query edits each text with its successor in descending id order. Ids are cut into blocks at approximate
quantiles (one per shuffle partition, or more where a block would pass BLOCK_BYTES), each block is a partition that is
sorted and streamed, and the first document of a block is sent to the block before it as well, so no order over the whole
table is needed and memory is one Arrow batch.

Null text is the empty text; a text without words has the empty fingerprint word "-" repeated (two of them agree);
equal texts have equal fingerprints; rows with one id are ordered by text; a null id comes last; a lone document
follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents, partitions

SAMPLES = 64
CACHE_WORDS = 30_000
MAX_BLOCKS = 10_000
#: Bytes of text in a block, about, however few shuffle partitions are set.
BLOCK_BYTES = 32 << 20
NULL_ID = -(1 << 63)
EMPTY = "-" * (4 * SAMPLES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Draws of recent words, and fingerprints from them."""

    def __init__(self, capacity: int = CACHE_WORDS):
        self.capacity, self.at = capacity, {}
        self.hashes = np.empty(capacity, dtype=np.uint64)
        # r, b, ln c, and the score of weight 1, which most words have
        self.r, self.b, self.ln_c, self.once = (np.empty((capacity, SAMPLES), dtype=np.float32) for _ in range(4))

    def _draw(self, words: list[bytes]) -> None:
        rows = np.arange(len(self.at), len(self.at) + len(words))
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)
        seeds = _mixed(h[:, None] + np.arange(1, SAMPLES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
        u = [(_mixed(seeds + np.uint64(i * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> np.uint64(40)).astype(np.float32) for i in range(1, 6)]
        u = [(x + 0.5) / (1 << 24) for x in u]
        self.hashes[rows] = h
        self.r[rows] = -np.log(u[0] * u[1])
        self.ln_c[rows] = np.log(-np.log(u[2] * u[3]))
        self.b[rows] = u[4]
        self.once[rows] = self.ln_c[rows] - self.r[rows] * (1 - self.b[rows])
        self.at.update(zip(words, rows.tolist(), strict=True))

    def fingerprint(self, text: str) -> str:
        counts = Counter(text.encode().lower().split())
        if not counts:
            return EMPTY
        words = list(counts)
        if len(words) > self.capacity // 2:  # very many words: the minimum over parts is the minimum over all
            parts = [self._least(words[i : i + self.capacity // 2], counts) for i in range(0, len(words), self.capacity // 2)]
            score = np.stack([p[0] for p in parts])
            pick = score.argmin(0)
            digest = np.stack([p[1] for p in parts])[pick, np.arange(SAMPLES)]
        else:
            digest = self._least(words, counts)[1]
        return digest.astype(">u2").tobytes().hex()

    def _least(self, words: list[bytes], counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The least score of each hash function and its sample's digest."""
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.capacity:
            self.at.clear()
            new = words
        if new:
            self._draw(new)
        rows = np.array([self.at[w] for w in words])
        n = np.array([counts[w] for w in words])
        score = self.once[rows]
        t = None
        more = np.flatnonzero(n > 1)
        if len(more):
            k = rows[more]
            t = np.floor(np.log(n[more]).astype(np.float32)[:, None] / self.r[k] + self.b[k])
            score[more] = self.ln_c[k] - self.r[k] * (t - self.b[k] + 1)
        best = score.argmin(0)
        level = np.zeros(SAMPLES, dtype=np.uint64)
        if t is not None:
            place = np.full(len(words), -1)
            place[more] = np.arange(len(more))
            of = place[best]
            some = of >= 0
            level[some] = t[of[some], np.flatnonzero(some)].astype(np.int64).astype(np.uint64)
        digest = _mixed(self.hashes[rows[best]] + _mixed(level + np.uint64(1)))
        return score[best, np.arange(SAMPLES)], (digest >> np.uint64(48)).astype(np.uint16)


def likeness(a: str, b: str) -> float:
    """The share of samples that agree."""
    x, y = (np.frombuffer(s.encode(), dtype="S4") for s in (a, b))
    return float((x == y).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint for each row of docs, without any shuffle."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [sampler.fingerprint(t) for t in batch["t"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(
        rows, f"doc_id {kind}, fingerprint string"
    )


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the start of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edit's, and their likeness; the successor is next in descending id order."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    size = 0 if blocks else rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = min(MAX_BLOCKS, blocks or max(partitions(spark), -(-size // BLOCK_BYTES)))
    # At most n ids come to the driver.
    cuts = rows.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n + 1)]), 100 * n).alias("q"), F.max("id").alias("m")).first()
    tops = np.array(sorted({*(cuts.q or []), *([] if cuts.m is None else [cuts.m])}), dtype=np.int64)  # the highest id of each block

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(tops, ids.to_numpy()).astype(np.int32))

    own = rows.withColumn("block", block("id"))
    # A block's first document also ends the block above it; the very first ends the last.
    ahead = own.where(F.col("id").isin([int(x) for x in tops])).withColumn("block", F.pmod(F.col("block") + 1, F.lit(max(1, len(tops)))))
    both = own.withColumn("own", F.lit(0)).unionByName(ahead.withColumn("own", F.lit(1)))
    # A block is a partition: no two of them meet in one task by chance.
    placed = both.repartitionById(max(1, len(tops)), F.col("block")).sortWithinPartitions("block", "own", F.col("id").desc(), "t")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler()
        held = None  # the row whose successor is still to come
        for batch in batches:
            out = []
            for doc, text, at, guest in zip(batch["id"], batch["t"], batch["block"], batch["own"], strict=True):
                if held is None and guest:
                    continue  # the block's further guests
                here = (at, doc, text, sampler.fingerprint(text))
                if held is not None:
                    out.append(pair(sampler, held, here))
                held = None if guest else here
            yield pd.DataFrame(out, columns=NAMES)

    def pair(sampler: Sampler, this, following):
        _, doc, text, print_ = this
        changed = edited(text, following[2])
        changed_print = sampler.fingerprint(changed)
        return (
            None if doc == NULL_ID else doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), print_, changed_print,
            likeness(print_, changed_print), likeness(print_, following[3]),
        )

    return placed.mapInPandas(stream, SCHEMA)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successors(documents(spark, sf_dir))
