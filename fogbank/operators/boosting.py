"""Boosted regression trees, grown leaf by leaf over histograms, as Spark jobs.

Training rows are cut into bins once (quantiles of every input, a bin of its own for missing values, stations by number) and
written as blocks of packed columns. A table of at most ``one_task_rows`` rows is held by one task (some 100 bytes a row), for many rounds
a job. Larger ones go step by step. While nodes are large, a step of a tree is one job: every task adds up, for the leaves
whose best split isn't known yet, the gradients and counts per input and bin, and a DataFrame aggregation sums them over the
tasks; what comes to the driver is bounded by leaves x inputs x bins. Nodes of at most ``task_rows`` rows are dealt to a task
each, which grows their whole subtrees; so each row is shuffled once a tree at most, and a tree takes as many jobs as it has
levels of large nodes, and one more. The driver only picks splits, best first, until the tree has its leaves.

Gradients are fixed-point numbers, so their sums are exact and don't depend on tasks or their order; which rows a round leaves
out is decided by a hash of the row's own key. The same rows give the same trees on any cluster.

Loss: squared error. A split's gain is GL^2/(NL+l2) + GR^2/(NR+l2) - G^2/(N+l2); missing values go to the side where that is
greater; a category's values are ordered by gradient and split like numbers, with an l2 of their own. Training ends
``patience`` rounds after the best loss on the held rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank.session import durable, release

#: Gradients are whole multiples of the largest first one divided by this.
STEPS = 1 << 28
#: Held losses are whole multiples of the largest first one divided by this.
LOSS_STEPS = 1 << 20
UNSEEN = -1
#: Rows of a packed block: a step's arrays are made once for each.
BLOCK_ROWS = 100_000
#: Rounds of a job whose one task holds the table.
ROUNDS = 100


@dataclass(frozen=True)
class Settings:
    rate: float = 0.03
    leaves: int = 31
    least_rows: int = 50
    l2: float = 1.0
    category_l2: float = 10.0
    category_smooth: float = 10.0
    category_rows: int = 100
    category_values: int = 32
    bins: int = 64
    share_of_inputs: float = 0.8
    share_of_rows: float = 0.8
    rounds: int = 2000
    patience: int = 100
    seed: int = 7
    #: Residuals are written down after so many trees; in between they are kept, and made again from there if lost.
    rewrite: int = 25
    #: Rows of a task: a node of fewer rows is grown to its end by one task.
    task_rows: int = 250_000
    #: A table of at most so many rows, in task_rows, is one task for many rounds; 0: no table.
    one_task: int = 16


@dataclass
class Split:
    """Rows of a node with bin <= bar (or a category in ``chosen``) go to ``low``, others to ``high``."""

    node: int
    feature: int
    bar: int
    missing_low: bool
    low: int
    high: int
    gain: float
    sums: tuple  # gradient and count of both sides
    chosen: np.ndarray | None = None

    def goes_low(self, bins: np.ndarray, category: np.ndarray | None, at: np.ndarray) -> np.ndarray:
        if self.chosen is not None:
            return np.isin(category[at], self.chosen)
        b = bins[self.feature, at]
        return np.where(b == 0, self.missing_low, b <= self.bar)


@dataclass
class Tree:
    splits: list[Split] = field(default_factory=list)
    values: dict[int, float] = field(default_factory=dict)

    def apply(self, bins: np.ndarray, category: np.ndarray | None) -> np.ndarray:
        node = placed(self.splits, bins, category)
        table = np.zeros(max(self.values) + 1)
        table[list(self.values)] = list(self.values.values())
        return table[node]


def placed(splits: list[Split], bins: np.ndarray, category: np.ndarray | None) -> np.ndarray:
    """Each row's node after the splits, which are in order of growth."""
    node = np.zeros(bins.shape[1], dtype=np.int32)
    for s in splits:
        at = np.flatnonzero(node == s.node)
        node[at] = np.where(s.goes_low(bins, category, at), s.low, s.high)
    return node


@dataclass
class Model:
    inputs: list[str]
    edges: list[np.ndarray]
    category: str | None
    base: float
    trees: list[Tree]
    losses: list[float]
    settings: Settings

    def predict_arrays(self, x: list[np.ndarray], category: np.ndarray | None) -> np.ndarray:
        bins = np.stack([binned(v, e) for v, e in zip(x, self.edges, strict=True)]) if x else np.zeros((0, len(category)), np.uint8)
        out = np.full(bins.shape[1], self.base)
        for t in self.trees:
            out += t.apply(bins, category)
        return out

    def column(self, df: DataFrame) -> Column:
        """The prediction for df's rows (their inputs as doubles, the category as a whole number or null)."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # trees of 31 leaves: some kB each

        @F.pandas_udf("double")
        def predict(x: pd.DataFrame) -> pd.Series:
            model = shared.value
            category = x[model.category].fillna(UNSEEN).to_numpy(dtype=np.int64) if model.category else None
            return pd.Series(model.predict_arrays([x[c].to_numpy(dtype=float) for c in model.inputs], category))

        return predict(F.struct(*self.inputs, *([self.category] if self.category else [])))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for missing values, else 1 + the number of edges below the value."""
    return np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, side="left")).astype(np.uint8)


def quantile_edges(rows: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """At most bins - 2 distinct cuts of each input, at its quantiles over all rows: one aggregation."""
    at = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    got = rows.agg(*[F.percentile_approx(c, at, 10_000).alias(c) for c in inputs]).first() if inputs else {}
    return [np.unique(np.array(got[c] or [], dtype=float)) for c in inputs]


def _blocks(rows: DataFrame, inputs: list[str], edges: list[np.ndarray], category: str | None, scratch: list) -> DataFrame:
    """The rows (columns target, held, key and the inputs) as packed blocks of about BLOCK_ROWS each."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for b in batches:
            some.append(b)
            if sum(x.num_rows for x in some) >= BLOCK_ROWS:
                yield pa.concat_batches(some)
                some = []
        if some:
            yield pa.concat_batches(some)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in joined(batches):
            column = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
            bins = np.stack([binned(column[c].astype(float), e) for c, e in zip(inputs, edges, strict=True)]) if inputs else np.zeros((0, b.num_rows), np.uint8)
            numbers = np.nan_to_num(column["category"].astype(float), nan=UNSEEN).astype(np.int32)
            parts = (bins, numbers, column["target"].astype(np.float64), column["key"].astype(np.int64), column["held"].astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=list(PARTS))

    read = rows.select("target", "held", "key", (F.col(category).cast("double") if category else F.lit(0.0)).alias("category"), *inputs)
    return durable(read.mapInArrow(pack, ", ".join(f"{p} binary" for p in PARTS)), scratch)


PARTS = ("bins", "category", "residual", "key", "held")


def _unpacked(batches: Iterator[pa.RecordBatch], n_inputs: int) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        for i in range(batch.num_rows):  # a row is a block of rows
            raw = [batch.column(k)[i].as_buffer() for k in range(len(PARTS))]
            bins, category, residual, key, held = (np.frombuffer(r, t) for r, t in zip(raw, (np.uint8, np.int32, np.float64, np.int64, np.uint8), strict=True))
            yield bins.reshape(n_inputs, len(category)), category, residual, key, held.astype(bool)


def _drawn(key: np.ndarray, seed: int, rnd: int, share: float) -> np.ndarray:
    """Whether a row takes part in a round, by a hash of its key."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) + np.uint64((seed * 1_000_003 + rnd) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


@dataclass
class Histogram:
    """Gradients (whole steps) and counts by input and bin, and by category, of one node's rows over the chosen inputs."""

    g: np.ndarray  # inputs x bins
    n: np.ndarray
    category: np.ndarray  # the categories' numbers, in order
    category_g: np.ndarray
    category_n: np.ndarray

    def less(self, other: Histogram) -> Histogram:
        """Of this node's rows without those of one of its children; the sums are exact."""
        at = np.searchsorted(self.category, other.category)
        cg, cn = self.category_g.copy(), self.category_n.copy()
        cg[at] -= other.category_g
        cn[at] -= other.category_n
        keep = cn > 0
        return Histogram(self.g - other.g, self.n - other.n, self.category[keep], cg[keep], cn[keep])


def _pairs(slot: np.ndarray, category: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, as two rows, and each row's place among them."""
    both, where = np.unique(slot.astype(np.int64) << 32 | category.astype(np.int64) - UNSEEN, return_inverse=True)
    return np.stack([both >> 32, (both & 0xFFFFFFFF) + UNSEEN]), where


@dataclass
class _Fit:
    """What all steps of a fit share."""

    inputs: int
    has_category: bool
    scale: float  # a gradient's step
    settings: Settings

    def count(self, bins: np.ndarray, at: np.ndarray, named: tuple[np.ndarray, np.ndarray], g: np.ndarray, chosen: list[int]) -> Histogram:
        """Of the rows at these places. named: all categories in order, and each of the rows' place among them."""
        numeric, width = [f for f in chosen if f < self.inputs], self.settings.bins
        gs, ns = np.zeros((len(numeric), width), np.int64), np.zeros((len(numeric), width), np.int64)
        for i, f in enumerate(numeric):
            b = bins[f, at].astype(np.intp)
            gs[i], ns[i] = np.bincount(b, g, width), np.bincount(b, minlength=width)
        if self.inputs not in chosen:
            return Histogram(gs, ns, *np.zeros((3, 0), np.int64))
        values, where = named
        cg, cn = np.bincount(where, g, len(values)).astype(np.int64), np.bincount(where, minlength=len(values))
        return Histogram(gs, ns, values[cn > 0], cg[cn > 0], cn[cn > 0])

    def best_split(self, node: int, h: Histogram, chosen: list[int], g: int, n: int) -> Split | None:
        """The split of the greatest gain, if any gains; ties go to the first input and the lowest bar."""
        st, best, top = self.settings, None, 1e-12
        numeric = [f for f in chosen if f < self.inputs]

        def gains(low_g, low_n, l2):
            a, b = low_g * self.scale, (g - low_g) * self.scale
            gain = a**2 / (low_n + l2) + b**2 / (n - low_n + l2) - (g * self.scale) ** 2 / (n + l2)
            return np.where((low_n >= st.least_rows) & (n - low_n >= st.least_rows), gain, 0.0)

        if numeric:
            low_g, low_n = np.cumsum(h.g[:, 1:], 1), np.cumsum(h.n[:, 1:], 1)
            low_g, low_n = np.stack([low_g, low_g + h.g[:, :1]], 1), np.stack([low_n, low_n + h.n[:, :1]], 1)  # missing values high, or low
            gain = gains(low_g, low_n, st.l2)
            f, missing_low, b = (int(i) for i in np.unravel_index(gain.argmax(), gain.shape))
            if gain[f, missing_low, b] > top:
                top, low = gain[f, missing_low, b], (int(low_g[f, missing_low, b]), int(low_n[f, missing_low, b]))
                if not h.n[f, 0]:  # where nothing is missing, what is missing later goes with the larger side
                    missing_low = 2 * low[1] > n
                best = Split(node, numeric[f], b + 1, bool(missing_low), 0, 0, float(top), (low, (g - low[0], n - low[1])))
        if self.inputs in chosen:
            known = h.category != UNSEEN
            value, gs, ns = h.category[known], h.category_g[known], h.category_n[known]
            order = np.lexsort((value, gs * self.scale / (ns + st.category_smooth)))
            low_g, low_n = np.cumsum(gs[order]), np.cumsum(ns[order])
            # Cuts a group of rows apart, with few values on one of the sides: finer ones fit noise.
            far = np.diff(low_n // st.category_rows, prepend=0) > 0
            i = np.arange(1, len(order) + 1)
            gain = np.where(far & (np.minimum(i, len(order) - i) <= st.category_values), gains(low_g, low_n, st.l2 + st.category_l2), 0.0)
            if len(gain) and gain.max() > top:
                k = int(gain.argmax())
                low = (int(low_g[k]), int(low_n[k]))
                best = Split(node, self.inputs, 0, False, 0, 0, float(gain[k]), (low, (g - low[0], n - low[1])), np.sort(value[order[: k + 1]]))
        return best

    def wide_step(self, blocks: DataFrame, rnd: int, splits: list[Split], wanted: list[int], chosen: list[int]) -> tuple[dict[int, Histogram], float]:
        """One job: the wanted nodes' histograms over the chosen inputs, and the loss on the held rows."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int, int], list[int]] = {}
            loss = 0
            numeric = [f for f in chosen if f < self.inputs]
            g_sum, n_sum = np.zeros((2, len(wanted), len(numeric), self.settings.bins), np.int64)
            width, shape = self.settings.bins, (len(wanted), self.settings.bins)
            slot_of = np.full(max([0, *wanted, *(x for s in splits for x in (s.low, s.high))]) + 1, -1)
            slot_of[wanted] = np.arange(len(wanted))
            for bins, category, g, node, missed in self.placed_rows(batches, rnd, splits):
                loss += missed
                # All wanted nodes in one count: a row's place is its node's slot and its bin.
                at = np.flatnonzero(slot_of[node] >= 0)
                first, g = slot_of[node[at]] * width, g[at]
                for i, f in enumerate(numeric):
                    place = first + bins[f, at]
                    g_sum[:, i] += np.bincount(place, g, len(wanted) * width).astype(np.int64).reshape(shape)
                    n_sum[:, i] += np.bincount(place, minlength=len(wanted) * width).reshape(shape)
                if self.inputs not in chosen:
                    continue
                pair, where = _pairs(first // width, category[at])
                cgs, cns = np.bincount(where, g, pair.shape[1]).astype(np.int64), np.bincount(where, minlength=pair.shape[1])
                for k, c, cg, cn in zip(*pair.tolist(), cgs.tolist(), cns.tolist(), strict=True):
                    have = sums.setdefault((k, self.inputs, c), [0, 0])  # as many as this task's rows have stations
                    have[0] += cg
                    have[1] += cn
            slot, f, b = np.nonzero(n_sum)
            kept = np.array(list(sums), np.int64).reshape(-1, 3)
            had = np.array(list(sums.values()), np.int64).reshape(-1, 2)
            out = np.concatenate([
                np.stack([slot, np.array(numeric, np.int64)[f], b, g_sum[slot, f, b], n_sum[slot, f, b]], 1), np.concatenate([kept, had], 1), np.array([[-1, 0, 0, loss, 0]]),
            ])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=["slot", "input", "bin", "g", "n"])

        parts = blocks.mapInArrow(count, "slot bigint, input bigint, bin bigint, g bigint, n bigint")
        table = parts.groupBy("slot", "input", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toArrow()
        slot, f, b, g, n = (table.column(c).to_numpy() for c in ("slot", "input", "bin", "g", "n"))
        numeric = [x for x in chosen if x < self.inputs]
        place = np.zeros(self.inputs + 1, np.int64)
        place[numeric] = np.arange(len(numeric))
        out = {}
        for i, w in enumerate(wanted):
            h = Histogram(*np.zeros((2, len(numeric), self.settings.bins), np.int64), *np.zeros((3, 0), np.int64))
            at = (slot == i) & (f < self.inputs)
            h.g[place[f[at]], b[at]], h.n[place[f[at]], b[at]] = g[at], n[at]
            at = np.flatnonzero((slot == i) & (f == self.inputs))
            at = at[np.argsort(b[at])]
            h.category, h.category_g, h.category_n = b[at], g[at], n[at]
            out[w] = h
        return out, float(g[slot < 0].sum()) / LOSS_STEPS

    def placed_rows(self, batches: Iterator[pa.RecordBatch], rnd: int, splits: list[Split]):
        """Each block's rows of the round: bins, category, gradient, node; and the loss of the block's held rows."""
        st = self.settings
        for bins, category, residual, key, held in _unpacked(batches, self.inputs):
            loss = self.loss(residual[held])
            at = np.flatnonzero(~held & _drawn(key, st.seed, rnd, st.share_of_rows))
            bins, category = bins[:, at], category[at]
            yield bins, category, np.rint(-residual[at] / self.scale), placed(splits, bins, category), loss

    def narrow_step(self, blocks: DataFrame, rnd: int, splits: list[Split], wanted: list[int], chosen: list[int]) -> tuple[dict[int, list[Split]], float]:
        """One job: the whole subtrees of nodes that are small enough for a task each, and the loss on the held rows."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss = 0
            for bins, category, g, node, missed in self.placed_rows(batches, rnd, splits):
                loss += missed
                for w in wanted:
                    at = np.flatnonzero(node == w)
                    if len(at):
                        yield row(w, 0, bins[:, at].tobytes(), category[at].tobytes(), g[at].astype(np.int64).tobytes())
            yield row(-1, loss, b"", b"", b"")

        def row(node: int, loss: int, *parts: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([loss], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]], names=["node", "loss", "bins", "category", "g"])

        def grown(rows: pa.Table) -> pa.Table:
            node = rows.column("node")[0].as_py()
            out = []
            if node >= 0:
                rows = rows.sort_by("g")  # sums don't depend on it; only for the same arrays anywhere
                raw = [[x.as_buffer() for x in rows.column(c)] for c in ("bins", "category", "g")]
                bins = np.concatenate([np.frombuffer(x, np.uint8).reshape(self.inputs, -1) for x in raw[0]], 1) if self.inputs else None
                category, g = (np.concatenate([np.frombuffer(x, t) for x in xs]) for xs, t in zip(raw[1:], (np.int32, np.int64), strict=True))
                out = self.subtree(np.zeros((0, len(g)), np.uint8) if bins is None else bins, category, g, chosen)
            loss = sum(rows.column("loss").to_pylist())
            return pa.table({"node": pa.array([node]), "loss": pa.array([loss], pa.int64()), "splits": pa.array([pickle.dumps(out)], pa.binary())})

        table = blocks.mapInArrow(part, "node bigint, loss bigint, bins binary, category binary, g binary").groupBy("node").applyInArrow(grown, "node bigint, loss bigint, splits binary").toArrow().to_pylist()
        return {r["node"]: pickle.loads(r["splits"]) for r in table if r["node"] >= 0}, sum(r["loss"] for r in table) / LOSS_STEPS

    def subtree(self, bins: np.ndarray, category: np.ndarray, g: np.ndarray, chosen: list[int]) -> list[Split]:
        """A node's splits, best first, until it alone would have all of a tree's leaves; node 0 is the node itself."""
        heap: list[tuple[float, int]] = []
        held: dict[int, tuple[np.ndarray, Histogram, Split]] = {}
        splits: list[Split] = []
        made = 1

        def look(node: int, at: np.ndarray, h: Histogram, sums: tuple[int, int]) -> None:
            s = self.best_split(node, h, chosen, *sums) if sums[1] >= 2 * self.settings.least_rows else None
            if s:
                held[node] = (at, h, s)
                heapq.heappush(heap, (-s.gain, node))

        # Categories are sorted once, not in each node.
        values, where = np.unique(category, return_inverse=True)
        values, weight = values.astype(np.int64), g.astype(np.float64)
        every = np.arange(len(g))
        look(0, every, self.count(bins, every, (values, where), weight, chosen), (int(g.sum()), len(g)))
        while heap and len(splits) < self.settings.leaves - 1:
            at, h, s = held.pop(heapq.heappop(heap)[1])
            s.low, s.high = made, made + 1
            made += 2
            splits.append(s)
            low = s.goes_low(bins, category, at)
            sides = [at[low], at[~low]]
            small = int(len(sides[0]) > len(sides[1]))
            least = sides[small]
            less = self.count(bins, least, (values, where[least]), weight[least], chosen)
            both = [less, h.less(less)] if small == 0 else [h.less(less), less]
            for k, node in enumerate((s.low, s.high)):
                look(node, sides[k], both[k], s.sums[k])
        return splits

    def grow(self, blocks: DataFrame, rnd: int, rows: int) -> tuple[Tree, float]:
        """The round's tree, and the loss on the held rows before it. rows: about as many as the round draws."""
        st, chosen = self.settings, self.drawn_inputs(rnd)
        known: dict[int, Split | None] = {}  # each node's best split
        sums: dict[int, tuple[int, int]] = {0: (0, rows)}
        splits, leaves, wanted, loss = [], [0], [0], None

        def add(node: int, s: Split | None) -> None:
            known[node] = s
            if s:
                s.node, s.low, s.high = node, len(sums), len(sums) + 1
                sums[s.low], sums[s.high] = s.sums

        while wanted:
            wide = [x for x in wanted if sums[x][1] > st.task_rows]
            step = self.wide_step if wide else self.narrow_step
            found, held = step(blocks, rnd, _towards(wanted, known), wide or wanted, chosen)
            loss = held if loss is None else loss
            for node in wide or wanted:
                if wide:
                    h = found[node]
                    if node == 0:
                        sums[0] = (int(h.g[0].sum()), int(h.n[0].sum())) if len(h.g) else (int(h.category_g.sum()), int(h.category_n.sum()))
                    add(node, self.best_split(node, h, chosen, *sums[node]))
                    continue
                number = {0: node}
                for s in found.get(node, []):
                    local, low, high = s.node, s.low, s.high
                    add(number[local], s)
                    number |= {low: s.low, high: s.high}
                for x in number.values():  # nothing more to find below
                    known.setdefault(x, None)
            splits, leaves, wanted = self._best_first(known, sums)
        return self.tree(splits, leaves, sums), loss

    def drawn_inputs(self, rnd: int) -> list[int]:
        every = list(range(self.inputs + self.has_category))
        rng = np.random.default_rng([self.settings.seed, rnd])
        return sorted(rng.choice(every, max(1, round(self.settings.share_of_inputs * len(every))), replace=False).tolist())

    def tree(self, splits: list[Split], leaves: list[int], sums: dict[int, tuple[int, int]]) -> Tree:
        if not splits:
            return Tree([], {0: 0.0})
        return Tree(splits, {i: -self.settings.rate * sums[i][0] * self.scale / (sums[i][1] + self.settings.l2) for i in leaves})

    def loss(self, residual: np.ndarray) -> int:
        return int(np.rint(np.square(residual / self.scale / STEPS) * LOSS_STEPS).sum())

    def rounds(self, first: int, upto: int, block: tuple[np.ndarray, ...], losses: list[float], best: int) -> tuple[np.ndarray, list[Tree], list[float], int, bool]:
        """These rounds over a whole table: the residuals that they leave, their trees, all losses, the best round, and whether the training is over."""
        st, trees = self.settings, []
        bins, category, residual, key, held = block
        for rnd in range(first, min(upto, st.rounds + 1)):
            losses.append(self.loss(residual[held]) / LOSS_STEPS)
            tree = Tree()
            if rnd < st.rounds:
                at = np.flatnonzero(~held & _drawn(key, st.seed, rnd, st.share_of_rows))
                g = np.rint(-residual[at] / self.scale).astype(np.int64)
                known: dict[int, Split | None] = {}
                sums = {0: (int(g.sum()), len(g))}
                for s in self.subtree(bins[:, at], category[at], g, self.drawn_inputs(rnd)):
                    known[s.node] = s
                    sums[s.low], sums[s.high] = s.sums
                tree = self.tree(*self._best_first(known | {x: None for x in sums if x not in known}, sums)[:2], sums)
            if rnd and (best == 0 or losses[rnd] < losses[best]):
                best = rnd
            if not tree.splits or rnd - best >= st.patience:
                return residual, trees, losses, best, True
            trees.append(tree)
            residual = residual - tree.apply(bins, category)
        return residual, trees, losses, best, False

    def _best_first(self, known: dict, sums: dict) -> tuple[list[Split], list[int], list[int]]:
        """Splits in order of gain until the tree has its leaves; the leaves, and those whose best split must be known.

        A leaf of the last split can't be split any more, nor one of too few rows.
        """
        heap, splits, leaves, unknown = [], [], {0}, []

        def look(node: int) -> None:
            if node not in known:
                if sums[node][1] >= 2 * self.settings.least_rows:
                    unknown.append(node)
            elif known[node]:
                heapq.heappush(heap, (-known[node].gain, node))

        look(0)
        while heap and len(leaves) < self.settings.leaves:
            s = known[heapq.heappop(heap)[1]]
            splits.append(s)
            leaves = leaves - {s.node} | {s.low, s.high}
            look(s.low)
            look(s.high)
        last = {splits[-1].low, splits[-1].high} if len(leaves) == self.settings.leaves else set()
        return splits, sorted(leaves), [x for x in unknown if x not in last]


def _towards(wanted: list[int], known: dict[int, Split | None]) -> list[Split]:
    """The splits on the way to the wanted nodes, parents first."""
    parent = {x: s for s in known.values() if s for x in (s.low, s.high)}
    out: dict[int, Split] = {}
    for node in wanted:
        while node in parent:
            s = parent[node]
            out[s.node] = s
            node = s.node
    return [out[k] for k in sorted(out)]


def lessened(blocks: DataFrame, tree: Tree, n_inputs: int) -> DataFrame:
    """The blocks with the residuals that a tree leaves."""

    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, category, residual, key, held in _unpacked([batch], n_inputs):
                parts = (bins, category, residual - tree.apply(bins, category), key, held.astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=list(PARTS))

    return blocks.mapInArrow(less, blocks.schema)


def _fit_in_one_task(work: _Fit, model: Model, blocks: DataFrame, scratch: list) -> int:
    """Adds trees and losses to the model; the best round. A job makes ROUNDS rounds and writes down the blocks that they leave."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(zip(*[[np.copy(x) for x in p] for b in batches for p in _unpacked([b], work.inputs)], strict=True))
        block = tuple(np.concatenate(x, -1) for x in parts)
        del parts
        residual, *made = work.rounds(first, upto, block, losses, best)
        yield row(*[b""] * len(PARTS), pickle.dumps(made))
        if not made[-1]:
            bins, category, _, key, held = block
            for at in range(0, len(key), BLOCK_ROWS):
                to = slice(at, at + BLOCK_ROWS)
                yield row(*[x.tobytes() for x in (bins[:, to], category[to], residual[to], key[to], held[to].astype(np.uint8))], None)

    def row(*parts: bytes | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=[*PARTS, "made"])

    first, losses, best, over = 0, [], 0, False
    while not over:
        upto, written = first + ROUNDS, []
        out = durable(blocks.coalesce(1).mapInArrow(train, ", ".join(f"{p} binary" for p in (*PARTS, "made"))), written)
        release(scratch)
        scratch += written
        trees, losses, best, over = pickle.loads(out.where("made IS NOT NULL").first().made)
        model.trees += trees
        first, blocks = upto, out.where("made IS NULL").select(*PARTS)
    model.losses += losses
    return best


def fit(rows: DataFrame, inputs: list[str], target: str, held: Column, key: list[str | Column], category: str | None = None, settings: Settings | None = None) -> Model:
    """A model from the rows where held is false; the others end the training. category: a column of whole numbers.

    key: columns that tell rows apart, for the rounds' draws. Rows without a target are left out.
    """
    st = settings or Settings()
    flagged = rows.where(F.col(target).isNotNull()).select(
        F.col(target).cast("double").alias("target"), F.coalesce(held, F.lit(False)).alias("held"), F.xxhash64(*key).alias("key"), *([category] if category else []), *inputs
    )
    train = flagged.where(~F.col("held"))
    first = flagged.agg(F.count("*").alias("n"), *[f(F.when(~F.col("held"), F.col("target"))).alias(k) for k, f in (("base", F.avg), ("top", F.max), ("low", F.min), ("rows", F.count))]).first()
    if not first.rows:
        raise ValueError("no rows to train on")
    base = float(f"{first.base:.9e}")  # a sum of doubles depends on their order in its last digits
    edges = quantile_edges(train, inputs, st.bins)
    work = _Fit(len(inputs), category is not None, max(abs(first.top - base), abs(first.low - base), 1e-12) / STEPS, st)
    tasks = -(-first.n // st.task_rows)
    scratch: list = []
    model = Model(inputs, edges, category, base, [], [], st)
    blocks = _blocks(flagged.withColumn("target", F.col("target") - F.lit(base)), inputs, edges, category, scratch)
    if first.n <= st.one_task * st.task_rows:
        try:
            best = _fit_in_one_task(work, model, blocks, scratch)
        finally:
            release(scratch)
        model.trees = model.trees[:best]
        return model
    blocks = blocks.coalesce(tasks).persist()
    before, best = None, 0
    try:
        for rnd in range(st.rounds + 1):
            if rnd < st.rounds:
                tree, loss = work.grow(blocks, rnd, round(first.rows * st.share_of_rows))
            else:
                tree, loss = Tree(), work.narrow_step(blocks, rnd, [], [], [])[1]
            model.losses.append(loss)
            if before is not None:
                before.unpersist()
            if rnd and (best == 0 or loss < model.losses[best]):
                best = rnd
            if not tree.splits or rnd - best >= st.patience:
                break
            model.trees.append(tree)
            before, blocks = blocks, lessened(blocks, tree, len(inputs))  # made by the next round's first job
            if (rnd + 1) % st.rewrite == 0:
                done, scratch = scratch, []
                blocks = durable(blocks, scratch).coalesce(tasks)
                release(done)
            blocks = blocks.persist()
    finally:
        for b in (before, blocks):
            if b is not None:
                b.unpersist()
        release(scratch)
    model.trees = model.trees[:best]
    return model
