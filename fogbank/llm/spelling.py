"""Spelling variant grouping (operator 12): words one error apart, by forward and backward minimal automata.

Words are near if one inserted, deleted or replaced character turns one into the other. The error lies in one half of a word,
so the other half is matched exactly: the forward automaton is entered by a word's first half and completes the rest with
one error, the backward one, of the reversed words, is entered by the last half. What the backward one finds with the first
half intact too is left out, as the forward one has it (the deduplication).

The vocabulary is dealt by halves: a word stands as a dictionary entry under the two lengths of half that a near word (one
character shorter, as long, one longer) can have, and as a query under its own. Halves are hashed to blocks of about
``block`` entries; a half with more entries has blocks of its own, among which its entries are dealt by hash and to all of
which its queries go, so nothing is capped and no task holds more entries than a block. Each block is one minimal acyclic
automaton (states merged by hash, the merge verified), whose words are numbered in order by counts along the path: a
search yields numbers, which index counts and spellings. Construction and search work on arrays, a character at a time for
all words. Characters are single bytes (ISO-8859-1), as words are of its letters only.

Null text has no words, a null id stands as an empty one in the deletion rule, repeated rows count again, an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm.common import ASCII_LOWER, ASCII_UPPER, ascii_lower, documents, durable, release
from fogbank.llm.sharding import CRC32_SQL

RUN_BREAK = r"[^A-Za-zÀ-ÿ]+"
#: A run whose hash this divides loses a character.
DELETED_EVERY = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A word's form has at least so many times its occurrences.
RATIO = 2
#: Entries of a block, and queries that are searched at once.
BLOCK = 50_000
CHUNK = 8192
#: With more characters than this left, and no more words than characters, words are compared instead of searched for, so that a
#: very long word's time doesn't grow with the square of its length.
LONG = 64

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser by multiplications and shifts."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' characters one after another, and each word's start and length."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(size) - size, size


class Automaton:
    """The minimal acyclic automaton of distinct, sorted words, with their numbers as a perfect hash.

    ``keys`` are state * 256 + character of all transitions in order, ``target`` and ``skipped`` where each leads and how many
    words come before those through it; ``first`` is each state's first transition.
    """

    def __init__(self, words: list[bytes]):
        self.words, self.spelled = len(words), words
        for salt in range(1, 100):
            if self._merge(*self._tree(words), np.uint64(salt)):
                return
        raise RuntimeError("no salt tells the states apart")

    @staticmethod
    def _tree(words: list[bytes]):
        """The words' prefix tree, a level at a time: (parents, characters, first child) of each level, and the final nodes."""
        text, start, size = _flat(words)
        at = np.zeros(len(words), dtype=np.int64)  # each word's node at the present depth
        same = np.ones(len(words), dtype=bool)  # shares it with the word before
        same[:1] = False
        alive, levels, nodes, depth = np.flatnonzero(size > 0), [], 1, 0
        while len(alive):
            c = text[start[alive] + depth]
            before = alive - 1
            there = (before >= 0) & (size[before] > depth)
            same[alive] &= there & (text[np.where(there, start[before] + depth, 0)] == c)
            new = ~same[alive]
            levels.append((at[alive[new]], c[new].astype(np.int64), nodes))
            at[alive] = nodes - 1 + np.cumsum(new)
            nodes += int(new.sum())
            depth += 1
            alive = alive[size[alive] > depth]
        return levels, at, nodes

    def _merge(self, levels, ends: np.ndarray, nodes: int, salt: np.uint64) -> bool:
        """Merges nodes with equal futures; False if two hashes met by chance."""
        final = np.zeros(nodes, dtype=np.int64)
        final[ends] = 1
        counts, hashes = final.copy(), final.astype(np.uint64) * _MIX[0]
        for parent, c, low in reversed(levels):
            child = slice(low, low + len(parent))
            np.add.at(counts, parent, counts[child])
            hashes[child] = _mixed(hashes[child] + salt)
            np.add.at(hashes, parent, _mixed(hashes[child] + (c.astype(np.uint64) + np.uint64(1)) * _MIX[0]))
        hashes[:1] = _mixed(hashes[:1] + salt)
        _, one, state = np.unique(hashes, return_index=True, return_inverse=True)
        parent = np.concatenate([x[0] for x in levels] or [np.zeros(0, np.int64)])
        c = np.concatenate([x[1] for x in levels] or [np.zeros(0, np.int64)])
        self.keys, pick = np.unique(state[parent] * 256 + c, return_index=True)
        self.target = state[pick + 1]  # transition i leads to node i + 1
        of = self.keys >> 8
        self.first = np.searchsorted(of, np.arange(len(one) + 1))
        self.final, self.root = final[one].astype(bool), int(state[0])
        # Exact check: all nodes of a state agree in their end, their number of transitions and where those lead.
        degree = np.bincount(parent, minlength=nodes)
        if not (
            (final == final[one][state]).all() and (degree == np.diff(self.first)[state]).all() and (self.target[np.searchsorted(self.keys, state[parent] * 256 + c)] == state[1:]).all()
        ):
            return False
        self.below = counts[one]  # words that end in or after each state
        below = self.below[self.target]
        upto = np.cumsum(below)
        self.skipped = upto - below + final[one][of]
        begin = self.first[of]  # the words before a state's first transition aren't its own
        self.skipped -= np.where(begin > 0, upto[begin - 1], 0)
        return True

    def follow(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each state has a transition by its character, and which."""
        key = state * 256 + c
        i = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return self.keys[i] == key if len(self.keys) else np.zeros(len(key), bool), i

    def number(self, word: bytes) -> int | None:
        """The word's place in order, None if it isn't a word."""
        state, n = np.array([self.root]), 0
        for c in word:
            there, i = self.follow(state, np.array([c]))
            if not there[0]:
                return None
            n, state = n + int(self.skipped[i[0]]), self.target[i]
        return n if self.final[state[0]] else None

    def one_error(self, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's place and the number of a word that has its first ``exact`` characters and one error after them."""
        found = [self._search(queries[i : i + CHUNK], exact[i : i + CHUNK]) + i * self.words for i in range(0, len(queries), CHUNK)]
        both = np.concatenate(found or [np.zeros(0, np.int64)])
        return both // max(1, self.words), both % max(1, self.words)

    def _search(self, queries: list[bytes], exact: np.ndarray) -> np.ndarray:
        """query * words + number, each once."""
        text, start, size = _flat(queries)
        out = [np.zeros(0, np.int64)]

        def complete(q, at, state, n) -> None:
            """After the error: the rest of each query exactly."""
            while len(q):
                done = at == size[q]
                hit = done & self.final[state]
                out.append(q[hit] * self.words + n[hit])
                q, at, state, n = q[~done], at[~done], state[~done], n[~done]
                there, i = self.follow(state, text[start[q] + at])
                i = i[there]
                q, at, state, n = q[there], at[there] + 1, self.target[i], n[there] + self.skipped[i]

        q = np.arange(len(queries))
        state, n, depth = np.full(len(q), self.root), np.zeros(len(q), np.int64), 0
        while len(q):  # one path per query without an error yet; all of them are at this depth
            late = exact[q] <= depth
            left = size[q] - depth
            plain = late & (left > LONG) & (self.below[state] <= left)
            for i in np.flatnonzero(plain):  # what is left is long, and few words are: they are numbered one after another
                asked = queries[q[i]]
                near = [k for k in range(n[i], n[i] + self.below[state[i]]) if one_apart(asked, self.spelled[k])]
                out.append(q[i] * self.words + np.array(near, dtype=np.int64))
            if plain.any():
                q, state, n, late = q[~plain], state[~plain], n[~plain], late[~plain]
            branch = np.repeat(np.flatnonzero(late), (self.first[state + 1] - self.first[state])[late])
            edge = self.first[state[branch]] + _ranks(branch)
            to, m = self.target[edge], n[branch] + self.skipped[edge]
            complete(q[branch], np.full(len(branch), depth), to, m)  # the word has a character more
            more = size[q] > depth
            skip = late & more
            complete(q[skip], np.full(skip.sum(), depth + 1), state[skip], n[skip])  # a character less
            own = np.where(more, text[np.where(more, start[q] + depth, 0)], 0)
            other = more[branch] & (own[branch] != self.keys[edge] & 255)
            complete(q[branch[other]], np.full(other.sum(), depth + 1), to[other], m[other])  # another character
            there, i = self.follow(state, own.astype(np.int64))
            there &= more
            i = i[there]
            q, state, n = q[there], self.target[i], n[there] + self.skipped[i]
            depth += 1
        return np.unique(np.concatenate(out))


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether one error turns a into b: the first difference is looked for, and the rests must be equal after it."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    m = min(len(a), len(b))
    other = np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)
    i = int(other.argmax()) if other.any() else m
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def _ranks(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal numbers."""
    begins = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))


def words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, deleted_every: int | None = DELETED_EVERY
) -> DataFrame:
    """word, n: the runs of letters of all texts in lower case, some with a character deleted, and how often each occurs."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.split(F.col(text_col), RUN_BREAK)).alias("run")).where(F.char_length("run") >= least_chars)
    # Most runs are ASCII, where lower() does what translate() does, only faster.
    low = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(ascii_lower(F.col("run")))
    found = runs.select("key", low.alias("word"))
    if deleted_every:
        found = found.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "word").cast("binary")))
        place = (F.col("h") % F.char_length("word")).cast("int")
        shorter = F.concat(F.col("word").substr(F.lit(1), place), F.col("word").substr(place + 2, F.char_length("word")))
        found = found.select(F.when(F.col("h") % deleted_every == 0, shorter).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= least_chars)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _entries(vocabulary: DataFrame, backward: bool) -> DataFrame:
    """Each word (reversed for the backward direction) under its two halves: key, word, n, exact (null if no query)."""
    size = F.char_length("word")
    own = F.floor((size + 1) / 2) if backward else F.floor(size / 2)
    low = F.floor(size / 2) if backward else F.floor((size - 1) / 2)
    turned = F.reverse("word") if backward else F.col("word")
    rows = vocabulary.select(turned.alias("word"), "n", own.cast("int").alias("own"), F.explode(F.array(low, low + 1)).alias("half"))
    half = F.col("half").cast("int")
    key = F.concat(F.lit("b" if backward else "f"), F.col("word").substr(F.lit(1), half))
    return rows.select(key.alias("key"), F.encode("word", "ISO-8859-1").alias("word"), "n", F.when(half == F.col("own"), half).alias("exact"))


def _match(block: pa.Table) -> pa.Table:
    """word, n_near, form, form_n of each query of a block with a near word in it."""
    backward = block.column("backward")[0].as_py()
    spelled, n = block.column("word").to_pylist(), block.column("n").to_numpy()
    is_entry = block.column("entry").to_numpy(zero_copy_only=False)
    count = {spelled[i]: n[i] for i in np.flatnonzero(is_entry)}
    listed = sorted(count)
    exact = block.column("exact")
    asked = np.flatnonzero(exact.is_valid().to_numpy(zero_copy_only=False))
    queries, half = [spelled[i] for i in asked], exact.drop_null().to_numpy().astype(np.int64)
    q, number = Automaton(listed).one_error(queries, half)
    if backward:  # with the first half intact, too, the forward direction has it
        rest = [len(queries[i]) - half[i] for i in range(len(queries))]
        fresh = np.array([queries[i][-rest[i] :] != listed[k][-rest[i] :] for i, k in zip(q.tolist(), number.tolist(), strict=True)], dtype=bool)
        q, number = q[fresh], number[fresh]
        straight = [w[::-1] for w in listed]
        rank = np.empty(len(listed), dtype=np.int64)
        rank[sorted(range(len(listed)), key=straight.__getitem__)] = np.arange(len(listed))
    else:
        straight, rank = listed, np.arange(len(listed))
    weight = np.array([count[w] for w in listed], dtype=np.int64)
    order = np.lexsort((rank[number], -weight[number], q))
    q, number = q[order], number[order]
    begins = np.flatnonzero(np.diff(q, prepend=-1))
    at, best = q[begins], number[begins]
    read = lambda w: (w[::-1] if backward else w).decode("latin-1")
    return pa.table(
        {
            "word": pa.array([read(queries[i]) for i in at.tolist()], pa.string()),
            "n_near": pa.array(np.diff(np.append(begins, len(q))), pa.int64()),
            "form": pa.array([straight[k].decode("latin-1") for k in best.tolist()], pa.string()),
            "form_n": pa.array(weight[best], pa.int64()),
        }
    )


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form, form_n: parts of each word's near words, one row for each block that found any.

    vocabulary: word (distinct), n; it is read several times, so it should be a table.
    """
    total = vocabulary.count()
    rows = _entries(vocabulary, False).unionByName(_entries(vocabulary, True))
    buckets = max(1, -(-2 * total // block))
    # Of 4 * total rows, fewer than 4 * total / block keys can be that large.
    large = rows.groupBy("key").count().where(F.col("count") > block).select(F.col("key").alias("large"), F.ceil(F.col("count") / block).cast("int").alias("parts"))
    dealt = rows.join(large, rows["key"] == large["large"], "left")
    bucket = F.concat(F.substring("key", 1, 1), F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("string"))
    salt = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    hot, is_query = F.col("parts").isNotNull(), F.col("exact").isNotNull()
    # A large half's entry goes to one of its blocks, its query to all of them.
    blocks = F.when(~hot, F.array(F.lit(-1))).when(is_query, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(salt))
    placed = dealt.select("key", "word", "n", "exact", hot.alias("hot"), salt.alias("salt"), bucket.alias("bucket"), F.explode(blocks).alias("part"))
    name = F.when(F.col("hot"), F.concat(F.lit("="), "key", F.lit("/"), F.col("part").cast("string"))).otherwise(F.col("bucket"))
    ready = placed.select(
        name.alias("block"), "word", "n", "exact", (~F.col("hot") | (F.col("part") == F.col("salt"))).alias("entry"), (F.substring("key", 1, 1) == "b").alias("backward")
    )
    return ready.groupBy("block").applyInArrow(_match, "word string, n_near bigint, form string, form_n bigint")


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, block: int = BLOCK, scratch: list | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of vocabulary (word, n).

    A form occurs ``ratio`` times as often as its word, so chains are as long as a logarithm of the largest count, and
    following them with doubled steps takes the logarithm of that many joins.
    """
    own, scratch = [], [] if scratch is None else scratch
    alone = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    parts = near_words(vocabulary, block).withColumn("n", F.lit(None).cast("long"))
    best = F.min(F.when(F.col("form_n").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form")))).alias("best")
    summed = alone.unionByName(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    often = -F.col("best.less") >= ratio * F.col("n")
    formed = durable(summed.select("word", "n", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), scratch)
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        done, own = own, []
        stepped = durable(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), own)
        release(done)
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    scratch += own
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(durable(words(documents(spark, sf_dir))))


#: Another way: words share a deletion at the same place (replaced), or one is the other's deletion (inserted, deleted).
OP12_SQL = f"""WITH RECURSIVE {CRC32_SQL},
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(run, '{ASCII_UPPER}', '{ASCII_LOWER}') AS run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(
      regexp_extract_all(hex(encode(k || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM runs, crc_table),
vocabulary AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % {DELETED_EVERY} = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
shorter AS (
  SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN vocabulary b ON a.rest = b.word),
picked AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word, n),
formed AS (
  SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * v.n THEN form END AS form, CASE WHEN form_n >= {RATIO} * v.n THEN form_n END AS form_n
  FROM vocabulary v LEFT JOIN picked USING (word)),
chain(word, step, reached) AS (
  SELECT word, 0, word FROM formed
  UNION ALL SELECT c.word, c.step + 1, f.form FROM chain c JOIN formed f ON c.reached = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""
