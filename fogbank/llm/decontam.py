"""Benchmark decontamination (operator 7): a generalised suffix automaton of the normalised test items.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII bytes. The automaton of all items' word
sequences is built once and sent to the executors; each document's words are streamed through it, keeping the
longest suffix that occurs in some item. Where that length reaches 13 (or the whole of a shorter item) the last
words are hit, and the state names the items. Words outside the items' vocabulary, and pairs of neighbours that
no item has, end any match, so only runs of known pairs need streaming: an exact shortcut.

The items are a query set held in blocks of BLOCK_BYTES, each with its own automaton of flat arrays; a document's hits are
the union over blocks. A pass over the documents holds at most HELD automata in a worker: a larger benchmark takes more
passes, each of which leaves only the hit stretches of the documents that have any, and a join by id and text hash brings
them together.

Null or empty text has no words and no hits; items without words have no window; a null item id counts in hits but
is written as an empty id; repeated rows are judged alike; empty tables give no rows or no hits.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents, durable

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Word bytes to their lower case, all others to a space.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
WINDOW = 13
MAX_COVERAGE = 0.05
#: Bytes of item text in one automaton; more items make more blocks.
BLOCK_BYTES = 1 << 20
#: Automata that one pass holds: with BLOCK_BYTES some 25 MB each.
HELD = 8
PAIR_BITS = 22
TEXTS_AT_ONCE = 64


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Suffix automaton over several word sequences, with the items that hold each state's substrings."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self._next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.names: list[str] = []
        coded = []
        for name, ws in items:
            if ws:
                self.names.append(name)
                coded.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws])
        for seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        # Items by the state of each of their windows: at most one entry per item word.
        found: set[tuple[int, int]] = set()
        self.short: dict[tuple[int, int], list[int]] = {}
        for k, seq in enumerate(coded):
            s = 0
            for n, c in enumerate(seq, 1):
                s = self._next[s][c]
                if n >= window:
                    found.add((self.holding(s, window), k))
            if len(seq) < window:
                self.short.setdefault((s, len(seq)), []).append(k)
        self.short_lengths = sorted({n for _, n in self.short})
        self.least = min([window, *self.short_lengths])
        self.owners, self.owned = (array("i", x) for x in zip(*sorted(found), strict=True)) if found else (array("i"), array("i"))
        self._pack()
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        for seq in coded:
            a = np.array(seq, dtype=np.int64)
            self.pairs[self._pair(a[:-1], a[1:])] = True

    def _pack(self) -> None:
        """The transitions as two flat arrays, sorted by state and word, instead of a dictionary per state."""
        self.words = len(self.vocab) + 1
        keys = np.fromiter((s * self.words + c for s, to in enumerate(self._next) for c in to), dtype=np.int64)
        goes = np.fromiter((t for to in self._next for t in to.values()), dtype=np.int32)
        order = np.argsort(keys)
        self.keys, self.goes = array("q", keys[order].tobytes()), array("i", goes[order].tobytes())
        del self._next

    def step(self, state: int, c: int) -> int:
        """The state after c, or -1."""
        key = state * self.words + c
        i = bisect_left(self.keys, key)
        return self.goes[i] if i < len(self.keys) and self.keys[i] == key else -1

    def holders(self, state: int) -> set[str]:
        """The items that have the window of this state."""
        i, out = bisect_left(self.owners, state), set()
        while i < len(self.owners) and self.owners[i] == state:
            out.add(self.names[self.owned[i]])
            i += 1
        return out

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 2654435761 + b * 40503) & ((1 << PAIR_BITS) - 1)

    def _extend(self, last: int, c: int) -> int:
        """Append c after state last; reuses states that other items made."""
        if (q := self._next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and c not in self._next[p]:
            self._next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self._next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, length: int, to: dict[int, int]) -> int:
        self._next.append(to)
        self.link.append(0)
        self.length.append(length)
        return len(self._next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The part of state q that follows p becomes a state of its own."""
        part = self._state(self.length[p] + 1, dict(self._next[q]))
        self.link[part], self.link[q] = self.link[q], part
        while p != -1 and self._next[p].get(c) == q:
            self._next[p][c] = part
            p = self.link[p]
        return part

    def holding(self, state: int, n: int) -> int:
        """The state of the last n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Maximal stretches of words that may match, at least as long as the shortest window."""
        if len(ids) < self.least:
            return []
        known = ids > 0
        joined = known[:-1] & known[1:]
        joined[joined] = self.pairs[self._pair(ids[:-1][joined], ids[1:][joined])]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        spans = [(int(a), int(b) + 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a + 1 >= self.least]
        if self.least == 1:  # one-word items: words without a known neighbour count as well
            alone = known & ~np.concatenate((joined, [False])) & ~np.concatenate(([False], joined))
            spans += [(int(i), int(i) + 1) for i in np.flatnonzero(alone)]
        return spans

    def stream(self, ids: np.ndarray, hit: np.ndarray) -> tuple[set[str], int]:
        """Marks hit words; the items with occurring windows, and the longest match."""
        items: set[str] = set()
        longest = 0
        for start, end in self.runs(ids):
            state = matched = 0
            for i, c in enumerate(ids[start:end].tolist(), start):
                while (to := self.step(state, c)) < 0 and state:
                    state = self.link[state]
                    matched = self.length[state]
                state, matched = (to, matched + 1) if to >= 0 else (0, 0)
                longest = max(longest, matched)
                if matched >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    items |= self.holders(self.holding(state, self.window))
                for n in self.short_lengths:
                    if n > matched:
                        break
                    if found := self.short.get((self.holding(state, n), n)):
                        hit[i + 1 - n : i + 1] = True
                        items.update(self.names[k] for k in found)
        return items, longest


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list:
    """One broadcast automaton for each block of at most about block_bytes of item text."""
    spark = items.sparkSession
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    keyed = rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    out = []
    for b in range(blocks):
        part = keyed.where(F.col("b") == b).select("i", "t").toLocalIterator()
        out.append(spark.sparkContext.broadcast(Automaton(((r.i, words(r.t)) for r in part), window)))
    return out


def judge(docs: DataFrame, blocks: list, id_col: str = "doc_id", text_col: str = "text", max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), longest, contaminated, cleaned.

    cleaned is the text without its hit spans where the hit words reach max_coverage of all words, else null: the
    text is to be kept as it is.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    several = len(blocks) > HELD
    if several:
        rows = with_hits(rows, blocks)

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = list(zip(batch["hits"], batch["names"], batch["longest"], strict=True)) if several else None
            found = verdicts(batch["t"].tolist(), [] if several else blocks, max_coverage, known)
            yield pd.DataFrame([(d, *v) for d, v in zip(batch["doc_id"], found, strict=True)], columns=["doc_id", *VERDICT])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(judged, f"doc_id {kind}, n_words long, n_hit long, items array<string>, longest int, contaminated boolean, cleaned string")


def with_hits(rows: DataFrame, blocks: list) -> DataFrame:
    """rows (doc_id, t) with hits (first and last word of each hit stretch, in turn), names and longest over all blocks."""
    key = lambda df: df.withColumn("h", F.sha2("t", 256))
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = None
    for i in range(0, len(blocks), HELD):
        group = blocks[i : i + HELD]

        def one_pass(batches: Iterator[pd.DataFrame], group=group) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for d, h, (hit, names, longest) in zip(batch["doc_id"], batch["h"], matches(batch["t"].tolist(), group), strict=True):
                    if longest:
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                        out.append((d, h, edge.astype(np.int32), sorted(names), longest))
                yield pd.DataFrame(out, columns=["doc_id", "h", "hits", "names", "longest"])

        part = durable(key(rows).mapInPandas(one_pass, f"doc_id {kind}, h string, hits array<int>, names array<string>, longest int"))
        for b in group:
            b.unpersist()
        parts = part if parts is None else parts.unionByName(part)
    # A document has one row per pass here; repeated rows give the same ones.
    merged = parts.distinct().groupBy("doc_id", "h").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("names")).alias("names"), F.max("longest").alias("longest"))
    merged = merged.withColumnsRenamed({"doc_id": "doc_of", "h": "h_of"})
    joined = key(rows).join(merged, F.col("doc_id").eqNullSafe(F.col("doc_of")) & F.col("h").eqNullSafe(F.col("h_of")), "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    return joined.select("doc_id", "t", none("hits", "array<int>"), none("names", "array<string>"), F.coalesce("longest", F.lit(0)).alias("longest"))


VERDICT = ["n_words", "n_hit", "items", "longest", "contaminated", "cleaned"]


def matches(texts: list[bytes | None], blocks: list) -> Iterator[tuple[np.ndarray, set[str], int]]:
    """The hit words, items and longest match of each text; TEXTS_AT_ONCE are split at a time, which bounds the memory."""
    for i in range(0, len(texts), TEXTS_AT_ONCE):
        split = [words(t) for t in texts[i : i + TEXTS_AT_ONCE]]
        hits = [np.zeros(len(w), dtype=bool) for w in split]
        items: list[set[str]] = [set() for _ in split]
        longest = [0] * len(split)
        for block in blocks:
            sam = block.value
            for k, ws in enumerate(split):
                ids = np.fromiter(map(sam.vocab.get, ws, repeat(0)), dtype=np.int64, count=len(ws))
                found, n = sam.stream(ids, hits[k])
                items[k] |= found
                longest[k] = max(longest[k], n)
        yield from zip(hits, items, longest, strict=True)


def verdicts(texts: list[bytes | None], blocks: list, max_coverage: float = MAX_COVERAGE, known: list | None = None) -> list[tuple]:
    """VERDICT of each text, from the blocks and from what is known of it: hit stretches, items and longest match."""
    share = Fraction(str(max_coverage))
    out = []
    for k, (text, (hit, names, n)) in enumerate(zip(texts, matches(texts, blocks), strict=True)):
        if known:
            stretches, more, longest = known[k]
            for a, b in zip(stretches[::2], stretches[1::2], strict=True):
                hit[a:b] = True
            names, n = names | set(more), max(n, int(longest))
        n_hit = int(hit.sum())
        bad = n_hit > 0 and n_hit * share.denominator >= share.numerator * len(hit)
        out.append((len(hit), n_hit, sorted(names), n, bad, without(text, hit) if bad else None))
    return out


def without(text: bytes, hit: np.ndarray) -> str:
    """The text without its hit words."""
    keep, at = [], 0
    for gone, m in zip(hit.tolist(), WORD.finditer(text), strict=True):
        if gone:
            keep.append(text[at : m.start()])
            at = m.end()
    return (b"".join(keep) + text[at:]).decode()


def contaminated(docs: DataFrame, blocks: list, text_col: str = "text", max_coverage: float = MAX_COVERAGE) -> Column:
    """Whether a text is contaminated, as a column: filters documents without moving them."""

    @F.pandas_udf("boolean")
    def bad(texts: pd.Series) -> pd.Series:
        return pd.Series([v[4] for v in verdicts(texts.tolist(), blocks, max_coverage)], dtype=bool)

    return bad(F.col(text_col).cast("binary"))


def uncontaminated(docs: DataFrame, blocks: list, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't contaminated; they stay where they are, unless the blocks take several passes."""
    if len(blocks) <= HELD:
        return docs.where(~contaminated(docs, blocks, text_col))
    of_text = F.sha2(F.col(text_col).cast("binary"), 256)  # the verdict depends on the text only
    bad = judge(docs.select(of_text.alias("doc_id"), F.col(text_col).alias("text")), blocks).where("contaminated")
    return docs.join(bad.select(F.col("doc_id").alias("bad_text")).distinct(), of_text == F.col("bad_text"), "left_anti")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = automata(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judge(documents(spark, sf_dir), blocks).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP7_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + n - 1] AS x, n FROM (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS x FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, x)),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
