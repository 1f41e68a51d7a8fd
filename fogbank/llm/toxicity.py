"""Toxicity (operator 10): a linear-chain conditional random field that tags toxic words.

1. Labelled tokens. The labels are of documents, so a lexicon is induced first: word and prefix features are chosen
   greedily so that they cover the toxic training documents and (almost) none of the others. Words of toxic
   documents that carry a chosen feature are tagged toxic, all others clean.
2. The field. Two tags along each sentence; a word's emission is the sum of the weights of its features (the word,
   its prefixes and suffix), transitions are a 2 x 2 table. It is fitted to the tagged sentences by gradient ascent
   on the conditional likelihood, with forward-backward marginals as expectations.
3. Scores. Forward-backward runs over every sentence of every whole text; a document's largest marginal, expected
   number and expected share of toxic words go through a logistic function fitted on the training documents.
   Words whose marginal reaches a half give the offending offsets (code points, end exclusive).

The fit uses at most MAX_TOXIC and MAX_CLEAN labelled documents (least hash of their id), of each kind as many as fit into
MAX_BYTES of text: documented bounds. It takes every chain of theirs, in batches of 256. Chains end at sentence marks,
line ends, or after MAX_CHAIN words.

Scoring holds one Arrow batch and makes Python objects of at most LOT_BYTES of its text at a time; a longer text is read
in pieces that end where a chain ends, so the result is that of the whole text.

Null or empty text has no words and gets the score of no evidence; without toxic training rows every score is 0;
null labels and labels of absent documents are ignored; repeated rows are scored alike; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents, id_remainder, least_by_hash, lots, within_bytes

MAX_TOXIC, MAX_CLEAN = 1200, 2400
#: Bytes of text, of toxic and of clean documents each, that the fit takes at most.
MAX_BYTES = 12 << 20
MAX_CHAIN = 128
#: Bytes of text that are made into words at once.
LOT_BYTES = 1 << 20
#: Toxic documents that share this much of their word pairs count as copies of one text.
ALIKE = 0.4
HASH_BITS = 18
PREFIXES = (4, 5, 6)
CACHE_WORDS = 200_000
EDGE = b"\x01"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Word bytes to lower case, sentence marks to EDGE, all others to a space.
FOLD = bytes(1 if chr(b) in ".!?\n" else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def tokens(text: bytes | None) -> list[bytes]:
    """Words with EDGE between sentences."""
    return text.translate(FOLD).replace(EDGE, b" \x01 ").split() if text else []


def pieces(text: bytes, most: int = LOT_BYTES) -> Iterator[tuple[int, int]]:
    """Byte spans of at most about ``most`` bytes that end where a chain ends anyway: at a sentence mark or, where there is
    none, after a multiple of MAX_CHAIN words."""
    at = 0
    while len(text) - at > most:
        end = 1 + max(text.rfind(mark, at, at + most) for mark in (b".", b"!", b"?", b"\n"))
        if end <= at:
            long = most
            while not end and at + long < len(text):
                found = [m.end() for m in WORD.finditer(text, at, at + long)][:-1]  # the last one may go on
                whole = len(found) // MAX_CHAIN * MAX_CHAIN
                end = found[whole - 1] if whole else 0
                long *= 2
            if not end:
                break
        yield at, end
        at = end
    yield at, len(text)


def features(word: bytes) -> list[bytes]:
    return [b"w" + word, *(b"p%d" % n + word[:n] for n in PREFIXES if len(word) > n), b"s" + word[-3:]]


def slots(word: bytes) -> list[int]:
    return [zlib.crc32(f) & ((1 << HASH_BITS) - 1) for f in features(word)]


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # 2 x 2 log potentials, from tag to tag
    doc: np.ndarray | None = None  # logistic weights of a document's evidence
    cache: dict = field(default_factory=dict)
    flat: list | None = None  # the weights as Python numbers, which single look-ups read faster

    def __getstate__(self):
        return self.__dict__ | {"cache": {}, "flat": None}

    def emission(self, word: bytes) -> float:
        """Log potential of the toxic tag against the clean one; NaN at a sentence's edge."""
        e = self.cache.get(word)
        if e is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            if self.flat is None:
                self.flat = self.weights.tolist()
            flat = self.flat
            e = float("nan") if word == EDGE else min(30.0, max(-30.0, self.bias + sum([flat[s] for s in slots(word)])))
            self.cache[word] = e
        return e

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """P(toxic) of each word; chains are the stretches between NaNs (whose own value is 0)."""
        out = np.zeros(len(e))
        edge = np.isnan(e)
        real = np.flatnonzero(~edge)
        if not len(real):
            return out
        start = real[np.concatenate(([True], np.diff(real) > 1))]
        end = real[np.concatenate((np.diff(real) > 1, [True]))] + 1
        pieces = -(-(end - start) // MAX_CHAIN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(start, pieces) + nth * MAX_CHAIN
        length = np.minimum(np.repeat(end, pieces) - begin, MAX_CHAIN)
        order = np.argsort(length, kind="stable")
        begin, length = begin[order], length[order]
        a = np.exp(self.moves)
        # Chains of like length advance together.
        cut = [0, *np.searchsorted(length, [2, 4, 7, 11, 16, 24, 36, 64], side="right").tolist(), len(length)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            for k in range(i, j, 4096):
                b, n = begin[k : min(j, k + 4096)], length[k : min(j, k + 4096)]
                m = int(n.max())
                at = np.minimum(b[None, :] + np.arange(m)[:, None], len(e) - 1)
                live = np.arange(m)[:, None] < n[None, :]
                x = np.exp(np.where(live, e[at], 0.0))
                x[~live] = 1.0
                r = np.empty_like(x)  # forward odds
                r[0] = x[0]
                for s in range(1, m):
                    r[s] = x[s] * (a[0, 1] + a[1, 1] * r[s - 1]) / (a[0, 0] + a[1, 0] * r[s - 1])
                back = np.ones(x.shape[1])
                for s in range(m - 1, -1, -1):
                    if s < m - 1:
                        y = x[s + 1] * back
                        back = np.where(s < n - 1, (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y), 1.0)
                    r[s] *= back
                odds = r[live]
                out[at[live]] = odds / (1 + odds)
        return out

    def evidence(self, most: float, total: float, n_words: int) -> tuple[float, float, float]:
        """A document's largest marginal, expected number (its logarithm) and expected share of toxic words."""
        return (most, float(np.log1p(total)), total / n_words) if n_words else (0.0, 0.0, 0.0)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.doc is None:
            return np.zeros(len(evidence))
        z = np.concatenate((evidence, np.ones((len(evidence), 1))), axis=1) @ self.doc
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def induce(docs: list[list[bytes]], toxic: list[bool]) -> set[bytes]:
    """Features that cover the toxic documents and hardly any other."""
    good: Counter = Counter()
    held: dict[bytes, set[int]] = defaultdict(set)
    for i, (ws, bad) in enumerate(zip(docs, toxic, strict=True)):
        found = {f for w in set(ws) if w != EDGE for f in features(w)[:-1]}
        if bad:
            for f in found:
                held[f].add(i)
        else:
            good.update(found)
    n_bad = sum(toxic)
    text_of = groups(docs, [i for i, bad in enumerate(toxic) if bad])
    spread = lambda holders: len({text_of[i] for i in holders})  # noqa: E731  copies of one text are one witness
    least = 2 if n_bad < 60 else 3 + n_bad // 300
    usable = {f: s for f, s in held.items() if len(s) >= least and good[f] <= 0.01 * len(s)}
    # A near-copied document repeats all its words, so the features with wide cover come first.
    left = set().union(*usable.values()) if usable else set()
    chosen: set[bytes] = set()
    while left:
        f = max(usable, key=lambda f: (len(usable[f] & left), len(usable[f]), -len(f), f))
        if len(usable[f] & left) < least:
            break
        holders = usable.pop(f)
        if spread(holders) >= least:
            chosen.add(f)
            left -= holders
        usable = {k: s for k, s in usable.items() if len(s & left) >= least}
        if not usable:
            break
    # Words that occur about as widely as the chosen ones are of the same lexicon, though already covered.
    if chosen:
        wide = sorted(spread(held[f]) for f in chosen)
        bar = max(least + 1, wide[len(wide) // 4] // 2)
        chosen |= {f for f, s in held.items() if len(s) >= bar and good[f] <= 0.002 * len(s) and spread(s) >= bar}
    return chosen


def groups(docs: list[list[bytes]], of: list[int]) -> dict[int, int]:
    """The first of its near copies for each of the documents ``of``; copies share at least ALIKE of their word pairs."""
    sets = [set(zip(docs[i], docs[i][1:], strict=False)) or {(w, EDGE) for w in docs[i]} for i in of]
    holders: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for k, pairs in enumerate(sets):
        for pair in pairs:
            holders[pair].append(k)
    both = np.zeros((len(of), len(of)), dtype=np.int32)
    for ks in holders.values():
        if len(ks) > 1:
            both[np.ix_(ks, ks)] += 1
    size = np.array([len(x) for x in sets])
    first = np.arange(len(of))
    for k in range(len(of)):
        for j in np.flatnonzero(both[k, :k] >= ALIKE * np.maximum(1, size[k] + size[:k] - both[k, :k])):
            if first[j] != first[k]:
                a, b = sorted((first[j], first[k]))
                first[first == b] = a
    return dict(zip(of, first.tolist(), strict=True))


def chains(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words between edges, in stretches of at most MAX_CHAIN."""
    chain: list[bytes] = []
    for w in [*words, EDGE]:
        if w != EDGE and len(chain) < MAX_CHAIN:
            chain.append(w)
            continue
        if chain:
            yield chain
        chain = [] if w == EDGE else [w]


def train(docs: list[list[bytes]], toxic: list[bool], epochs: int = 6, seed: int = 7) -> Field:
    out = Field(np.zeros(1 << HASH_BITS), -4.0, np.zeros((2, 2)))
    if not any(toxic):
        return out
    chosen = induce(docs, toxic)
    rng = np.random.default_rng(seed)
    # Chains hold numbers of words; a batch's features are looked up when it is used.
    number: dict[bytes, int] = {}
    tag: dict[bytes, int] = {}
    coded, quiet = [], []
    for ws, bad in zip(docs, toxic, strict=True):
        for chain in chains(ws):
            y = np.zeros(len(chain), dtype=np.int8)
            if bad:
                for i, c in enumerate(chain):
                    if c not in tag:
                        tag[c] = int(any(f in chosen for f in features(c)[:-1]))
                    y[i] = tag[c]
            (coded if y.any() else quiet).append((np.array([number.setdefault(w, len(number)) for w in chain], dtype=np.int32), y))
    coded += quiet
    pad = len(PREFIXES) + 2
    table = np.full((len(number) + 1, pad), 1 << HASH_BITS, dtype=np.int32)
    for w, i in number.items():
        s = slots(w)
        table[i, : len(s)] = s

    weights = np.zeros((1 << HASH_BITS) + 1)
    square = np.full(len(weights), 1e-6)
    bias, moves = -4.0, np.zeros((2, 2))
    coded.sort(key=lambda c: len(c[0]))
    batches = [coded[i : i + 256] for i in range(0, len(coded), 256)]
    # Few chains make few batches: they are passed over more often, so that a small corpus still takes enough steps.
    epochs = max(epochs, 200 // max(1, len(batches)))
    for epoch in range(epochs):
        rate = 0.5 / (1 + 1.8 * epoch / epochs)
        for b in rng.permutation(len(batches)):
            n = np.array([len(c) for c, _ in batches[b]])
            words = np.full((len(n), n.max()), len(number), dtype=np.int32)
            y = np.zeros(words.shape, dtype=int)
            for i, (c, tags) in enumerate(batches[b]):
                words[i, : len(c)], y[i, : len(c)] = c, tags
            idx = table[words]
            e = np.clip(weights[idx].sum(2) + bias, -30, 30)
            live = np.arange(y.shape[1])[None, :] < n[:, None]
            p, pairs = expectations(e, n, moves)
            d = np.where(live, y - p, 0.0)
            seen = np.zeros((2, 2))
            both = live[:, 1:]
            for s in (0, 1):
                for t in (0, 1):
                    seen[s, t] = ((y[:, :-1] == s) & (y[:, 1:] == t) & both).sum()
            total = live.sum()
            bias += rate * d.sum() / total
            moves += rate * (seen - pairs) / max(1, both.sum()) - 1e-4 * moves
            g = np.bincount(idx.reshape(-1), np.repeat(d.reshape(-1), pad), len(weights))
            g[-1] = 0
            square += g * g
            weights += rate * g / np.sqrt(square)
            weights *= 1 - 1e-4
    out = Field(weights[:-1], float(bias), moves)
    x = []
    for ws in docs:
        e = np.array([out.emission(w) for w in ws])
        p = out.marginals(e)
        x.append(out.evidence(float(p.max(initial=0)), float(p.sum()), int((~np.isnan(e)).sum())))
    out.doc = logistic(np.array(x), np.array(toxic, dtype=float))
    return out


def expectations(e: np.ndarray, n: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals of padded chains (rows) and the expected counts of tag pairs."""
    a, x = np.exp(moves), np.exp(e)
    rows, m = e.shape
    r, back = np.empty((m, rows)), np.ones((m, rows))
    r[0] = x[:, 0]
    for s in range(1, m):
        r[s] = x[:, s] * (a[0, 1] + a[1, 1] * r[s - 1]) / (a[0, 0] + a[1, 0] * r[s - 1])
    pairs = np.zeros((2, 2))
    for s in range(m - 2, -1, -1):
        y = x[:, s + 1] * back[s + 1]
        inside = s < n - 1
        back[s] = np.where(inside, (a[1, 0] + a[1, 1] * y) / (a[0, 0] + a[0, 1] * y), 1.0)
        joint = np.array([[a[0, 0] + 0 * y, a[0, 1] * y], [a[1, 0] * r[s], a[1, 1] * r[s] * y]])
        pairs += (joint / joint.sum((0, 1)))[:, :, inside].sum(2)
    odds = r * back
    return (odds / (1 + odds)).T, pairs


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of a logistic fit, the classes weighted alike; the last one is the intercept."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    share = max(1e-9, y.mean())
    weight = np.where(y > 0, 0.5 / share, 0.5 / max(1e-9, 1 - share)) / len(y)
    for _ in range(steps):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (y - p)) - 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> Field:
    """A field from at most max_toxic + max_clean labelled documents, max_bytes of each kind, where usable (a condition on the labels) holds."""
    marked = labels.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    ids = {y: least_by_hash(marked.where(F.col("y") == y), "i", most) for y, most in ((1, max_toxic), (0, max_clean))}
    if not any(ids.values()):
        return train([], [])
    # The ids are bounded by the parameters; their sizes decide which texts come back, bounded in bytes.
    some = docs.where(F.col(id_col).isin([*ids[1], *ids[0]])).select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t"))
    sizes = {r.i: r.n for r in some.groupBy("i").agg(F.sum(F.coalesce(F.length("t"), F.lit(0))).alias("n")).collect()}
    want: dict = {}
    for y in (1, 0):
        for i in within_bytes(ids[y], sizes, max_bytes):
            want.setdefault(i, y)
    rows = some.where(F.col("i").isin(list(want))).collect() if want else []
    seen: dict[tuple[bytes, int], None] = {}
    for r in sorted(rows, key=lambda r: (r.i, bytes(r.t or b""))):
        seen.setdefault((bytes(r.t or b""), want[r.i]))  # copies of one text teach nothing new
    own: dict[bytes, bytes] = {}  # equal words are one object
    return train([[own.setdefault(w, w) for w in tokens(t)] for t, _ in seen], [y == 1 for _, y in seen])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def judged(m: Field, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[dict]]]:
    """The evidence and the offending spans of each text."""
    evidence, spans = np.zeros((len(texts), 3)), [[] for _ in texts]
    most, total, count, chars = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64), [0] * len(texts)

    def run(held: list[tuple[int, bytes, np.ndarray]]) -> None:
        # an edge at each piece's end keeps chains apart
        p = m.marginals(np.concatenate([x for _, _, e in held for x in (e, [np.nan])]))
        at = 0
        for k, part, e in held:
            mine = p[at : at + len(e)]
            at += len(e) + 1
            real = ~np.isnan(e)
            top = float(mine.max(initial=0))
            most[k], total[k], count[k] = max(most[k], top), total[k] + mine.sum(), count[k] + real.sum()
            if top >= 0.5:
                done = 0
                here = chars[k]
                for w, b in zip(WORD.finditer(part), mine[real] >= 0.5, strict=True):
                    if b:
                        start = here + len(part[done : w.start()].decode())
                        done, here = w.end(), start + len(w.group().decode())
                        spans[k].append({"start": start, "end": here})
                chars[k] = here + len(part[done:].decode())
            else:
                chars[k] += len(part.decode())

    held, size = [], 0
    for k, text in enumerate(texts):
        for a, b in pieces(text) if text else ():
            part = text[a:b]
            ws = tokens(part)
            held.append((k, part, np.fromiter(map(m.emission, ws), dtype=float, count=len(ws))))
            size += b - a
            if size >= LOT_BYTES:
                run(held)
                held, size = [], 0
    if held:
        run(held)
    for k in range(len(texts)):
        evidence[k] = m.evidence(most[k], total[k], int(count[k]))
    return evidence, spans


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans (start, end of each offending word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at, texts in lots(batch, 1, LOT_BYTES):
                evidence, spans = judged(m, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(m.score(evidence)), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        rows, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans")
    )
