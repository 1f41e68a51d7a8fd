"""Language identification (operator 3): a byte convolutional network, trained and applied in numpy.

A text's UTF-8 bytes are cut into fixed-length windows (the last one padded with zeros; windows overlap by the
widest filter less one byte, so no n-gram is lost). Bytes are embedded, filters of several widths slide over them,
each filter's maximum over the window goes through ReLU to a softmax layer. A document's probabilities are the mean
over its windows, weighted by their bytes, so the whole text counts.

Training uses at most ``max_rows`` labelled rows, shared evenly among the languages so that rare ones are learned (of each
the least by a hash of their id; of rows that repeat an id one is taken), and ``windows_per_row`` windows of each, spread evenly
over its text: a documented bound, so the fit is the same work at any corpus size. A language needs a row, so with more
languages than ``max_rows`` the most frequent are learned. Prediction covers every document and makes Python objects of LOT_BYTES
of text at a time.

Null text or text without a letter is ``und`` with score 0, which is no language to learn, either; with no labelled row at all
everything is ``und``; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents, id_remainder, lots

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 10
EMBED = 8
MAX_ROWS = 3000
WINDOWS_PER_ROW = 3
LOT_BYTES = 4 << 20
EPOCHS = 4
BATCH = 64
#: Windows that go through the filters at once.
CHUNK = 512
UNKNOWN = "und"
STEP = WINDOW - max(WIDTHS) + 1


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # max width * EMBED x filters; a narrow filter's other rows are zero
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over each window and where it is; windows: n x WINDOW bytes."""
        patches = self.patches(windows)
        out = (patches.reshape(-1, patches.shape[2]) @ self.filters).reshape(len(windows), STEP, -1)
        at = out.argmax(1)
        return np.take_along_axis(out, at[:, None, :], 1)[:, 0, :] + self.bias, at

    def patches(self, windows: np.ndarray) -> np.ndarray:
        e = self.embed[windows]
        w = max(WIDTHS)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e.reshape(len(e), -1), w * EMBED, axis=1)[:, ::EMBED])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), dtype=np.float32)
        for i in range(0, len(windows), CHUNK):
            part = windows[i : i + CHUNK]
            flat = self.patches(part).reshape(-1, max(WIDTHS) * EMBED)
            top = (flat @ self.filters).reshape(len(part), STEP, -1).max(1) + self.bias
            out[i : i + CHUNK] = softmax(np.maximum(top, 0) @ self.dense + self.dense_bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def width_mask() -> np.ndarray:
    """Rows of the filter matrix that each filter's width reaches."""
    rows = np.arange(max(WIDTHS) * EMBED)[:, None]
    return (rows < np.repeat(WIDTHS, FILTERS)[None, :] * EMBED).astype(np.float32)


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy; the pooling passes them to each filter's best position only."""
    top, at = net.pooled(x)
    hidden = np.maximum(top, 0)
    d = softmax(hidden @ net.dense + net.dense_bias)
    d[np.arange(len(y)), y] -= 1
    d *= weight[:, None]
    back = (d @ net.dense.T) * (top > 0)
    best = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]  # window, filter, offset
    seen = net.embed[best].reshape(len(x), mask.shape[1], -1)
    out = {"dense": hidden.T @ d, "dense_bias": d.sum(0), "bias": back.sum(0), "filters": np.einsum("bf,bfk->kf", back, seen) * mask}
    out["embed"] = np.zeros_like(net.embed)
    np.add.at(out["embed"], best.reshape(-1), (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED))
    out["embed"][0] = 0
    return out


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    mask = width_mask()
    n_filters = mask.shape[1]
    draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    net = Network(langs, draw(256, EMBED, s=0.5), draw(*mask.shape, s=0.2) * mask, np.zeros(n_filters, np.float32), draw(n_filters, len(langs), s=0.3), np.zeros(len(langs), np.float32))
    net.embed[0] = 0
    names = ("embed", "filters", "bias", "dense", "dense_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    t = 0
    # Small samples get more passes, so that a tiny corpus still takes enough steps.
    epochs = max(epochs, -(-250 * BATCH // max(1, len(windows))))
    # Windows of rare languages weigh more, within bounds.
    share = np.bincount(labels, minlength=len(langs)) / max(1, len(labels))
    weight = np.clip(1 / np.maximum(share * len(langs), 1e-9), 0.2, 5).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            x, y = windows[pick], labels[pick]
            grads = gradients(net, x, y, weight[y] / len(y), mask)
            t += 1
            for k in names:
                g = grads[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                step = 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, getattr(net, k) - step.astype(np.float32))
    return net


def windows_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows over a text (n x WINDOW) and the bytes that each covers."""
    n = max(1, -(-(len(text) - (WINDOW - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, dtype=np.uint8)
    padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]
    return view, np.minimum(STEP, np.maximum(1, len(text) - STEP * np.arange(n)))


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each language to take: as even as the counts allow, ``most`` together."""
    out, left = {}, most
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - i))
        left -= out[lang]
    return out


def sample(rows: DataFrame, id_col: str, lang_col: str, most: int) -> list:
    """At most ``most`` ids of rows, the least by hash of each language: two passes over narrow columns."""
    h = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    counted = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), h.alias("h"))
    # ``most`` rows come back at most, and then about as many ids as are wanted.
    counts = {r.lang: r["count"] for r in counted.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}
    if not counts:
        return []
    want = shares(counts, most)
    bar = {lang: int((1 << 40) * min(1.0, (n + 8 * n**0.5 + 20) / counts[lang])) for lang, n in want.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in bar.items() for x in kv]), F.col("lang"))
    near: dict[str, list] = {lang: [] for lang in want}
    for r in counted.where(F.col("h") <= limit).distinct().collect():
        near[r.lang].append((r.h, r.i))
    return sorted({i for lang, n in want.items() for _, i in sorted(near[lang])[:n]})


def fit(docs: DataFrame, usable, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, windows_per_row: int = WINDOWS_PER_ROW) -> Network | None:
    """A network from at most max_rows rows of docs where usable holds and the language is given."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text in zip(batch["lang"], batch["t"], strict=True):
                if text is not None and has_letter(text):
                    w, _ = windows_of(text)
                    for i in sorted({int(x) for x in np.linspace(0, len(w) - 1, windows_per_row)}):
                        out.append((lang, w[i].tobytes()))
            yield pd.DataFrame(out, columns=["lang", "w"])

    rows = docs.where(usable & F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN) & F.col(text_col).isNotNull())
    # At most max_rows ids: the list is bounded by that parameter.
    chosen = sample(rows, id_col, lang_col, max_rows)
    if not chosen:
        return None
    # One row of each id: an id that is repeated often brings no more than its share.
    one = rows.where(F.col(id_col).isin(chosen)).groupBy(F.col(id_col).alias("i")).agg(F.min(F.struct(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("t"))).alias("r"))
    labelled = one.select("r.lang", "r.t")
    got = labelled.mapInPandas(pick, "lang string, w binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.w)))
    langs = sorted({r.lang for r in got})
    windows = np.frombuffer(b"".join(bytes(r.w) for r in got), dtype=np.uint8).reshape(-1, WINDOW)
    return train(windows, np.array([langs.index(r.lang) for r in got]), langs)


def classify(model: Network | None, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The language and score of each text; texts share matrix products."""
    lang = np.full(len(texts), UNKNOWN, dtype=object)
    score = np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
    i = 0
    while i < len(some):
        group, cuts, covers, size = [], [], [], 0
        while i < len(some) and size < 8 * CHUNK:
            w, c = windows_of(texts[some[i]])
            group.append(some[i])
            cuts.append(w)
            covers.append(c)
            size += len(w)
            i += 1
        p = model.probabilities(np.concatenate(cuts)) * np.concatenate(covers)[:, None]
        starts = np.concatenate(([0], np.cumsum([len(c) for c in covers])[:-1]))
        p = np.add.reduceat(p, starts, axis=0)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        lang[group] = np.array(model.langs, dtype=object)[best]
        score[group] = np.clip(p[np.arange(len(p)), best], 0, 1)
    return lang, score


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in lots(batch, 1, LOT_BYTES):
                lang, score = classify(shared.value, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        rows, f"doc_id {kind}, lang_pred string, score double"
    )


def language(docs: DataFrame, net: Network | None, text_col: str = "text") -> Column:
    """The predicted language as a column: labels and filters documents without moving them.

    Marked as not deterministic, so that a filter on it doesn't classify a second time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("string")
    def lang(texts: pd.Series) -> pd.Series:
        return pd.Series(classify(shared.value, texts.tolist())[0])

    return lang.asNondeterministic()(F.col(text_col).cast("binary"))


def lettered(docs: DataFrame, text_col: str = "text") -> Column:
    """Whether a text has a letter, which is when a network tells a language."""

    @F.pandas_udf("boolean")
    def some(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and has_letter(t) for t in texts], dtype=bool)

    return some(F.col(text_col).cast("binary"))


def fold_held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(id_remainder(id_col, 4) == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit(docs, ~fold_held_out())
    return predict(docs, net).select("doc_id", fold_held_out().alias("held_out"), "lang_pred", "score")
