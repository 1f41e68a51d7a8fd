"""Mixing sources to target weights (operator 8), with DataFrame operations only.

Tokens are summed by source, language and topic. Iterative proportional fitting rakes the cells: in turn each
marginal's cells are scaled to its target, for a stated number of rounds or, with a tolerance, until no category's share
is further from its target than that (residual; targets that contradict each other stop at the number of rounds). A cell's ratio of raked to observed tokens,
divided by the largest ratio, is the probability that its documents are kept, so the kept tokens have the raked
mixture in expectation. The draw is a hash of the document's id, so it can be repeated.

With that scale the rarest cell sets how much stays. Where a share of tokens to keep is stated, the scale is the one that
keeps it: cells whose ratio would pass a probability of 1 stay whole and the others share the rest by their ratios, so
the mixture is met but for what whole cells fall short of.

Only cell totals are raked: aggregation combines before the shuffle, so a hot source costs no more than others. While
the cells are at most SMALL_CELLS they stay in one task, without shuffles, and are broadcast back to the documents;
beyond that they are shuffled by axis, sums over all cells are scalars, and the documents join them with a salt, so that
no cell's documents meet in one task. Only the order for a stated share to keep takes all cells through one sort.

A null source, language or topic is a category of its own, "(none)"; a document counts at least one token; a target
for a category without documents is left out and the rest are scaled up; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogbank.llm.common import documents, durable

AXES = ("source", "lang", "topic")
ROUNDS = 10
#: Rounds at most, and the largest distance from a target, where the pipeline rakes.
ROUNDS_MOST, TOLERANCE = 60, 1e-6
SMALL_CELLS = 50_000
#: Parts that a cell's documents are dealt to where the cells are too many to broadcast.
SALTS = 64
#: Targets of the query: each observed share to this power, so that small categories gain.
TEMPER = {"source": 0.75, "lang": 0.85, "topic": 0.85}
NONE = "(none)"
SHORT_CHARS = 300
#: The share of tokens that the pipeline keeps.
KEEP = 0.75


def topic_of(text: Column) -> Column:
    """The form of a text, which stands for its topic: the tables have none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("license") | low.contains("copyright"), "legal")
        .when(low.contains(" | "), "table")
        .when(low.contains("@"), "contact")
        .when(F.char_length(low) < SHORT_CHARS, "note")
        .otherwise("prose")
    )


def weighed(docs: DataFrame, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, source, lang, topic, tokens and the whole row of docs as ``row``."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        part(F.col("source")).alias("source"),
        part(F.col("lang")).alias("lang"),
        part(topic if topic is not None else topic_of(F.col(text_col))).alias("topic"),
        F.greatest(F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long").alias("tokens"),
        F.struct("*").alias("row"),
    )


def rake(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, keep: float | None = None, tolerance: float | None = None, together: bool = False, scratch: list | None = None
) -> DataFrame:
    """source, lang, topic, ratio, prob for each cell of source, lang, topic, tokens.

    targets: a weight for each category of an axis; an axis without them is tempered (TEMPER). keep: the share of tokens
    to keep, else the largest ratio has a probability of 1. tolerance: rake no further once the residual is at most that.
    together: all cells go through one task.
    """
    written = lambda df: durable(df, scratch).coalesce(1) if together else durable(df, scratch)

    def over_all(df: DataFrame, total: Column) -> Column:
        """An aggregate over all cells: a scalar where they are in many tasks."""
        return total.over(Window.partitionBy()) if together else F.lit(df.agg(total.alias("x")).first()["x"]).cast("double")

    out = written(cells)
    out = out.withColumn("w", F.col("tokens") / over_all(out, F.sum("tokens")))
    for axis in AXES:
        of = Window.partitionBy(axis)
        given = (targets or {}).get(axis)
        if given:
            pairs = [F.lit(x) for kv in given.items() for x in kv]
            aim = F.coalesce(F.element_at(F.create_map(*pairs).cast("map<string,double>"), F.col(axis)), F.lit(0.0))
        else:
            aim = F.pow(F.sum("w").over(of), F.lit(TEMPER[axis]))
        # each category's aim counts once, though it stands on all its cells
        out = out.withColumn("aim", aim).withColumn("nth", F.row_number().over(of.orderBy(*[a for a in AXES if a != axis])))
        total = over_all(out, F.sum(F.when(F.col("nth") == 1, F.col("aim"))))
        out = out.withColumn(f"goal_{axis}", F.try_divide("aim", total)).drop("aim", "nth")
    out = written(out)
    for i in range(rounds):
        for axis in AXES:
            now = F.sum("w").over(Window.partitionBy(axis))
            out = out.withColumn("w", F.coalesce(F.try_divide(F.col("w") * F.col(f"goal_{axis}"), now), F.lit(0.0)))
        if i % 5 == 4 or i + 1 == rounds:
            out = written(out)
            if tolerance is not None and residual(out) <= tolerance:
                break
    out = out.withColumn("ratio", F.col("w") / (F.col("tokens") / over_all(out, F.sum("tokens"))))
    if keep is None:
        return out.select(*AXES, "ratio", F.try_divide("ratio", over_all(out, F.max("ratio"))).alias("prob"))
    return scaled(out, keep).select(*AXES, "ratio", F.least(F.lit(1.0), F.col("ratio") * F.col("scale")).alias("prob"))


def residual(raked: DataFrame) -> float:
    """The largest distance of a category's share (w) from its goal, of all axes."""
    gaps = [F.abs(F.sum("w").over(Window.partitionBy(a)) - F.col(f"goal_{a}")).alias(f"gap_{a}") for a in AXES]
    return raked.select(*gaps).agg(F.max(F.greatest(*[f"gap_{a}" for a in AXES])).alias("gap")).first()["gap"] or 0.0


def scaled(cells: DataFrame, keep: float) -> DataFrame:
    """Adds scale: with probabilities min(1, scale * ratio) the share keep of all tokens stays.

    If the cells of the largest ratios stay whole, what is left to keep over the ratio-weighted rest is the scale; the
    right number of whole cells is the first at which the next cell's probability is at most 1.
    """
    all_, down, up = Window.partitionBy(), Window.orderBy(F.desc("ratio"), *AXES), Window.orderBy("ratio", *[F.desc(a) for a in AXES])
    whole = F.sum("tokens").over(down) - F.col("tokens")
    rest = F.sum(F.col("tokens") * F.col("ratio")).over(up)
    tried = cells.withColumn("nth", F.row_number().over(down)).withColumn("scale", F.try_divide(keep * F.sum("tokens").over(all_) - whole, rest))
    first = F.min(F.when(F.col("scale") * F.col("ratio") <= 1, F.struct("nth", "scale"))).over(all_)
    # None fits where all that has a target is to stay.
    return tried.withColumn("scale", F.coalesce(first["scale"], F.lit(float("inf")))).withColumn("scale", F.when(F.col("ratio") > 0, F.col("scale")).otherwise(0.0)).drop("nth")


def drawn(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, rounds: int = ROUNDS, keep: float | None = None, tolerance: float | None = None, small_cells: int = SMALL_CELLS) -> DataFrame:
    """Adds ratio, prob and sampled to the rows of weighed()."""
    cells = durable(rows.groupBy(*AXES).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    small = cells.count() <= small_cells
    raked = rake(cells, targets, rounds, keep, tolerance, small)
    draw = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    if small:
        joined = rows.join(F.broadcast(raked), list(AXES))
    else:
        every = raked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(every, [*AXES, "salt"])
    rest = [c for c in rows.columns if c == "row"]
    return joined.select("doc_id", *AXES, "tokens", "ratio", "prob", (draw < F.col("prob")).alias("sampled"), *rest)


def calibrated(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **raking) -> DataFrame:
    """doc_id, source, lang, topic, tokens, ratio, prob, sampled and row (all of docs' columns) for each row of docs."""
    return drawn(weighed(docs, topic, id_col, text_col), targets, **raking)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without the texts the weighed rows are narrow: written once, so that the texts are read once.
    out = drawn(durable(weighed(documents(spark, sf_dir)).drop("row")))
    return out.withColumn("ratio", F.round("ratio", 6)).withColumn("prob", F.round("prob", 6))


def _op8_sql() -> str:
    goals = ", ".join(f"pow(sum(w) OVER (PARTITION BY {a}), {TEMPER[a]}) AS aim_{a}, row_number() OVER (PARTITION BY {a} ORDER BY {', '.join(b for b in AXES if b != a)}) AS nth_{a}" for a in AXES)
    scaled = ", ".join(f"aim_{a} / sum(aim_{a}) FILTER (WHERE nth_{a} = 1) OVER () AS goal_{a}" for a in AXES)
    steps = [f"r{i} AS (SELECT * REPLACE (w * goal_{a} / sum(w) OVER (PARTITION BY {a}) AS w) FROM r{i - 1})" for i, a in enumerate(list(AXES) * ROUNDS, 1)]
    return f"""WITH d AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
    CASE WHEN low LIKE '%license%' OR low LIKE '%copyright%' THEN 'legal' WHEN low LIKE '% | %' THEN 'table'
      WHEN low LIKE '%@%' THEN 'contact' WHEN length(low) < {SHORT_CHARS} THEN 'note' ELSE 'prose' END AS topic,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1)::BIGINT AS tokens
  FROM (SELECT *, lower(coalesce(text, '')) AS low FROM documents)),
c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
g AS (SELECT *, tokens / sum(tokens) OVER () AS w FROM c),
h AS (SELECT *, {goals} FROM g),
r0 AS (SELECT source, lang, topic, tokens, w, {scaled} FROM h),
{', '.join(steps)},
k AS (SELECT source, lang, topic, w / (tokens / sum(tokens) OVER ()) AS ratio FROM r{3 * ROUNDS}),
p AS (SELECT *, ratio / max(ratio) OVER () AS prob FROM k)
SELECT doc_id, source, lang, topic, tokens, round(ratio, 6) AS ratio, round(prob, 6) AS prob,
  ('0x' || substr(sha256(doc_id::VARCHAR), 1, 13))::BIGINT / {float(1 << 52)} < prob AS sampled
FROM d JOIN p USING (source, lang, topic)"""


OP8_SQL = _op8_sql()
