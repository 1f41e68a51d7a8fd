"""Incremental secret scan (operator 9), with DataFrame operations only.

Every version of every path is content-addressed (SHA-256 of its UTF-8 bytes). The ledger holds the
(blob, rule set) pairs already scanned with their findings; only pairs absent from it are scanned, each blob once however
many paths and versions carry it, and findings are joined back to all paths. Rule sets have versions of their own, so a
new set doesn't make the old ones run again: the base rules, and added ones that find more kinds.

The query has a history: an earlier scan of the documents, when there were only the base rules, left a ledger; the documents are
scanned again now that there are added rules, and so are later versions of those paths whose assigned secrets were redacted. Each
scan takes the pairs that the ledger lacks; a pair scanned twice would stand in it twice and be found twice. A row has the findings
of its document and, if it has one, of the later version.

Spans come from built-in functions: ``split`` by a rule's pattern gives the text between matches and
``regexp_extract_all`` the matches, so running sums of their lengths are the code-point offsets. The sums go through
blocks of BLOCK matches, as appending to one list would copy it at every match.

Null text is the empty blob; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import documents, durable

# The rules (kind, pattern, shortest accepted match, group whose length counts).
# Hex and access runs are greedy to their end, so the length can stand in the pattern itself; an assignment that
# is too short still uses up its text, so its length is checked afterwards.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_RE2 = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# A private key's first line, and a name with a password in an address.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
# The address's scheme has at most 31 characters (of a longer run its end counts), so that a run without one is passed in linear time.
LOGIN = r"[a-z][a-z0-9+.-]{0,30}://[A-Za-z0-9_.%+-]+:[A-Za-z0-9_.%+!$*-]+@"
RULES = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
ADDED = (("pem", PEM), ("login", LOGIN))
RANK = {kind: i for i, (kind, _) in enumerate((*RULES, *ADDED))}
#: Text that any match of a rule contains: it is looked for before the pattern.
LITERAL = {"access": "AKIA", "pem": "PRIVATE KEY-----", "login": "://"}
RULE_VERSION, ADDED_VERSION = "base-1", "added-1"
RULE_SETS = {RULE_VERSION: RULES, ADDED_VERSION: ADDED}
ASSIGN_MIN = 8
BLOCK = 256

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: str, pattern: str) -> str:
    """SQL of all accepted matches of one rule in ``text`` as (start, rank, kind, end), in order."""
    rx = _literal(pattern)
    none = f"CAST(array() AS {SPAN})"
    size = "char_length(x['0']) + char_length(x['h'])"
    start = "acc.pos + char_length(x['0'])"
    end = f"{start} + char_length(x['h'])"
    keep = f"char_length(regexp_extract(x['h'], {rx}, 1)) >= {ASSIGN_MIN}" if kind == "assign" else "true"
    span = f"named_struct('start', {start}, 'rank', {RANK[kind]}, 'kind', '{kind}', 'end', {end})"
    # p: the (gap, match) pairs, fields '0' and 'h'; a block's number and the offset at which it starts are '0' and '1'.
    pairs = f"transform(array(regexp_extract_all(text, {rx}, 0)), h -> arrays_zip(slice(split(text, {rx}, -1), 1, size(h)), h))"
    last = f"((size(p) - 1) div {BLOCK})"
    starts = f"""aggregate(slice(sequence(0, CAST({last} AS INT)), 2, CAST({last} AS INT)), array(0),
      (s, k) -> array_append(s, element_at(s, -1) + aggregate(slice(p, (k - 1) * {BLOCK} + 1, {BLOCK}), 0, (t, x) -> t + {size})))"""
    block = f"""aggregate(slice(p, b['0'] * {BLOCK} + 1, {BLOCK}), named_struct('pos', b['1'], 'out', {none}),
      (acc, x) -> named_struct('pos', {end}, 'out', CASE WHEN {keep} THEN array_append(acc.out, {span}) ELSE acc.out END), acc -> acc.out)"""
    there = f"contains(text, '{LITERAL[kind]}') AND " if kind in LITERAL else ""
    return f"""CASE WHEN {there}text RLIKE {rx} THEN
      transform({pairs}, p -> flatten(transform(arrays_zip(sequence(0, CAST({last} AS INT)), {starts}), b -> {block})))[0] ELSE {none} END"""


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob binary, rules string, found {SPAN}")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, blob, text: each version's content address."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"), text.alias("text"))


def scan_unseen(versioned: DataFrame, ledger: DataFrame | None = None, rules: str | tuple[str, ...] = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rules, found) for the pairs of a blob and a rule set that the ledger doesn't have.

    A rule set that RULE_SETS doesn't name runs the base rules.
    """
    wanted = (rules,) if isinstance(rules, str) else tuple(rules)
    todo = F.array(*[F.lit(r) for r in wanted])
    # Map-side combine: each task sends one copy of a blob, however often the blob occurs, and the ledger meets it after that.
    once = versioned.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        once = once.withColumn("todo", todo)
    else:  # a blob has a row per rule set, so its list is short
        seen = ledger.where(F.col("rules").isin(*wanted)).groupBy("blob").agg(F.collect_set("rules").alias("seen"))
        once = once.join(seen, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    found = " ".join(f"WHEN '{r}' THEN array_sort(concat({', '.join(_spans(k, p) for k, p in RULE_SETS.get(r, RULES))}))" for r in wanted)
    return once.select("blob", "text", F.explode("todo").alias("rules")).select("blob", "rules", F.expr(f"CASE rules {found} END").alias("found"))


def findings(versioned: DataFrame, ledger: DataFrame, rules: str | tuple[str, ...] = RULE_VERSION) -> DataFrame:
    """doc_id, found: the ledger's findings under the rule sets for every path, empty where there is none."""
    wanted = (rules,) if isinstance(rules, str) else tuple(rules)
    hits = ledger.where(F.col("rules").isin(*wanted) & (F.size("found") > 0)).select("blob", "found")
    if len(wanted) > 1:
        hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    return versioned.select("doc_id", "blob").join(hits, "blob", "left").select(
        "doc_id", F.coalesce("found", F.array().cast(SPAN)).alias("found")
    )


def without_secrets(text: str) -> Column:
    """A text with its assigned secrets redacted; null where it has none."""
    rx = _literal(ASSIGN)
    return F.expr(f"CASE WHEN {text} RLIKE {rx} THEN regexp_replace({text}, {rx}, '[redacted]') END")


def redacted(versioned: DataFrame) -> DataFrame:
    """The later versions of those paths that have an assigned secret: doc_id, blob, text without it."""
    return versions(versioned.select("doc_id", without_secrets("text").alias("text")).where("text IS NOT NULL"))


def scanned(history: list[tuple[DataFrame, tuple[str, ...]]], scratch: list | None = None) -> DataFrame:
    """The ledger after scans of (versions, rule sets), one after another; each takes what the ledger lacks by then."""
    ledger = None
    for versioned, sets in history:
        new = durable(scan_unseen(versioned, ledger, sets), scratch)
        ledger = new if ledger is None else ledger.unionByName(new)
    return ledger


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = tuple(RULE_SETS)
    first = versions(documents(spark, sf_dir))
    ledger = scanned([(first, (RULE_VERSION,)), (first, sets), (redacted(first), sets)])
    # A path's row holds the addresses of both of its versions, so that repeated ids don't meet each other's.
    # Written down, so that the joins stand on plain exchanges, which Spark splits where many paths have one blob.
    hits = durable(ledger.where(F.size("found") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found")))
    later = F.when(F.col("clean").isNotNull(), F.unhex(F.sha2(F.col("clean").cast("binary"), 256)))
    paths = first.select("doc_id", "blob", without_secrets("text").alias("clean")).select("doc_id", "blob", later.alias("later"))
    found = paths.join(hits, "blob", "left").join(hits.select(F.col("blob").alias("later"), F.col("found").alias("later_found")), "later", "left")
    found = found.withColumn("found", F.coalesce("found", F.array().cast(SPAN)))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("found", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k, _ in RULES],
        F.sha2(listed(of(*[k for k, _ in RULES])).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.when(F.col("later").isNotNull(), F.coalesce(listed(F.col("later_found")), F.lit(""))).alias("later_spans"),
    )


def _duck_spans(kind: str, rx: str, table: str) -> str:
    keep = f"length(regexp_extract(hit, '{rx}', 2)) >= {ASSIGN_MIN}" if kind == "assign" else "true"
    return f"""SELECT doc_id, {RANK[kind]} AS rank, '{kind}' AS kind, stop - length(hit) AS start, stop FROM (
      SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
        SELECT doc_id, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(range(len(hits))) AS i FROM (
          SELECT doc_id, regexp_split_to_array(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS hits FROM {table})))
    WHERE {keep}"""


_RE2 = {"assign": ASSIGN_RE2, "access": ACCESS, "hex": HEX, "pem": PEM, "login": LOGIN}
_BASE = "(" + ", ".join(f"'{k}'" for k, _ in RULES) + ")"
_ALL = lambda table: " UNION ALL ".join(_duck_spans(k, rx, table) for k, rx in _RE2.items())
_LIST = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
OP9_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, regexp_replace(text, '{ASSIGN_RE2}', '[redacted]', 'g') AS text FROM d WHERE regexp_matches(text, '{ASSIGN_RE2}')),
s AS ({_ALL('d')}),
g AS (
  SELECT doc_id, sum((kind = 'assign')::INT)::BIGINT AS n_assign, sum((kind = 'access')::INT)::BIGINT AS n_access,
    sum((kind = 'hex')::INT)::BIGINT AS n_hex, {_LIST} FILTER (WHERE kind IN {_BASE}) AS base, {_LIST} AS spans
  FROM s GROUP BY doc_id),
h AS (SELECT doc_id, {_LIST} AS later_spans FROM ({_ALL('e')}) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CASE WHEN e.doc_id IS NOT NULL THEN coalesce(later_spans, '') END AS later_spans
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id"""
