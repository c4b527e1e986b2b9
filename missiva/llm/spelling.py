"""Operator 12, spelling variant grouping: words one edit apart, by Levenshtein automata over broadcast trie shards.

Words are counted (partially before the shuffle). The dictionary is then sorted by range, so each partition holds words of
close prefixes, and every SHARD_WORDS words (or SHARD_LETTERS letters) become one shard: a trie in flat arrays, its nodes level by level, a node's
children side by side (one byte of label, four of first child, four of word number a node). Shards are broadcast in waves of
at most WAVE_BYTES, whatever the dictionary's size, and each word's distance-one automaton is run depth-first through
every shard of the wave: along the word's own path, where each node allows one inserted, deleted or replaced letter, after
which the rest must follow as it is. Accepted neighbours come out as rows; counts and the best form are reduced by Spark.
Roots are found by doubling: forms at least ``ratio`` times as frequent in every step make chains of at most log n.

Defined results: a null or empty text has no words; a null doc_id reads as '' in the damaged runs' hash; repeated rows
count as often as they stand there; ties of n go to the smallest word in code-point order; an empty table gives an empty
result; extra columns are not read. Memory: one wave a process, and one shard's words while it is built. Only a single word of
millions of letters makes a shard that is larger than others: nine bytes a letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.llm.common import drop, written
from missiva.llm.line_dedup import LOWER, UPPER

#: Letters of words: ASCII's and U+00C0 to U+00FF, one byte each in Latin-1.
LETTERS = r"A-Za-z\x{00C0}-\x{00FF}"
MIN_CHARS, MIN_COUNT, RATIO = 7, 2, 10
#: A run whose hash with its document is divisible by this loses one letter.
DAMAGED = 31
#: A shard is closed at so many words or letters; a wave holds so many bytes of shards.
SHARD_WORDS, SHARD_LETTERS = 1 << 16, 1 << 20
WAVE_BYTES = 64 << 20
#: Words that one task walks.
TASK_WORDS = 1 << 14


def runs(docs: DataFrame, *, min_chars: int = MIN_CHARS, damaged: int = DAMAGED) -> DataFrame:
    """word: each maximal run of at least min_chars letters, lower-cased, with its letter lost where the hash says so."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))  # no shorter run can give a word
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(found).alias("run"))
    lowered = rows.select("d", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = lowered.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % damaged == 0, lost).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the distinct words with their occurrences."""
    counted = runs(docs, min_chars=min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.length("word") >= min_chars) & (F.col("n") >= min_count))


@dataclass
class Trie:
    """A shard: children of node i are first[i] to first[i + 1], ``labels`` their letters in Latin-1, ``word`` the number of the word that ends in a node or -1."""

    labels: bytes
    first: np.ndarray
    word: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, sorted_words: list[bytes], counts: list[int]) -> Trie:
        labels, first, ends = bytearray(b"\0"), [], []
        level, depth = [(0, len(sorted_words))], 0  # ranges of words that share a prefix, level by level
        while level:
            below = []
            for low, high in level:
                done = len(sorted_words[low]) == depth
                ends.append(low if done else -1)
                first.append(len(labels))
                low += done
                while low < high:
                    letter, up = sorted_words[low][depth], low + 1
                    while up < high and sorted_words[up][depth] == letter:
                        up += 1
                    labels.append(letter)
                    below.append((low, up))
                    low = up
            level, depth = below, depth + 1
        return cls(bytes(labels), np.array([*first, len(labels)], "<i4"), np.array(ends, "<i4"), np.array(counts, "<i8"))

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.labels, self.first.tobytes(), self.word.tobytes(), self.counts.tobytes()

    @classmethod
    def unpacked(cls, labels: bytes, first: bytes, word: bytes, counts: bytes) -> Trie:
        return cls(labels, np.frombuffer(first, "<i4"), np.frombuffer(word, "<i4"), np.frombuffer(counts, "<i8"))


class Walker:
    """Runs distance-one automata through one trie."""

    def __init__(self, trie: Trie):
        self.labels, self.counts = trie.labels, trie.counts
        self.first, self.word = memoryview(trie.first), memoryview(trie.word)

    def _rest(self, node: int, letters: bytes, at: int) -> int:
        """The number of the word that ends after letters[at:] below node, or -1."""
        labels, first = self.labels, self.first
        for i in range(at, len(letters)):
            node = labels.find(letters[i], first[node], first[node + 1])
            if node < 0:
                return -1
        return self.word[node]

    def near(self, letters: bytes) -> dict[bytes, int]:
        """The words exactly one edit away, with their counts."""
        labels, first, word, rest = self.labels, self.first, self.word, self._rest
        out, node, size = {}, 0, len(letters)
        for at in range(size + 1):
            low, high = first[node], first[node + 1]
            own = letters[at] if at < size else -1
            if own >= 0 and (i := rest(node, letters, at + 1)) >= 0:  # one letter less
                out[letters[:at] + letters[at + 1 :]] = i
            for child in range(low, high):
                letter = labels[child]
                if letter == own:  # the same letter once more gives what the next place gives
                    continue
                if (i := rest(child, letters, at)) >= 0:  # one letter more
                    out[letters[:at] + bytes((letter,)) + letters[at:]] = i
                if own >= 0 and (i := rest(child, letters, at + 1)) >= 0:  # another letter
                    out[letters[:at] + bytes((letter,)) + letters[at + 1 :]] = i
            node = labels.find(own, low, high) if own >= 0 else -1
            if node < 0:
                break
        out.pop(letters, None)
        return {w: int(self.counts[i]) for w, i in out.items()}


SHARD = "bytes long, labels binary, first binary, word binary, counts binary"


def shards(dictionary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """dictionary (word, n) as tries of at most shard_words words of close prefixes each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bytes", pa.int64()), *((c, pa.binary()) for c in ("labels", "first", "word", "counts"))])

        def made(held: list[tuple[bytes, int]]) -> pa.RecordBatch:
            parts = Trie.of([w for w, _ in held], [n for _, n in held]).packed()
            return pa.RecordBatch.from_arrays([pa.array([sum(map(len, parts))], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], schema=schema)

        held: list[tuple[bytes, int]] = []
        letters = 0
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((w.encode("latin-1"), n))
                letters += len(w)
                if len(held) == shard_words or letters >= SHARD_LETTERS:
                    yield made(held)
                    held, letters = [], 0
        if held:
            yield made(held)

    parts = -(-dictionary.count() // shard_words) or 1
    return dictionary.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(build, SHARD)


def _waves(sizes: list[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Shard ids in waves of at most ``most`` bytes (a shard alone may be larger only if it is one)."""
    wave, held = [], 0
    for shard, size in sizes:
        if wave and held + size > most:
            yield wave
            wave, held = [], 0
        wave.append(shard)
        held += size
    if wave:
        yield wave


def neighbours(dictionary: DataFrame, *, shard_words: int = SHARD_WORDS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """word, near, near_n: each pair of words exactly one edit apart, in both directions."""
    spark = dictionary.sparkSession
    built = written(shards(dictionary, shard_words).withColumn("shard", F.monotonically_increasing_id()), "shards")
    sizes = [(r.shard, r.bytes) for r in built.select("shard", "bytes").orderBy("shard").collect()]  # two numbers a shard
    tasks = max(spark.sparkContext.defaultParallelism, -(-dictionary.count() // TASK_WORDS))
    dealt = dictionary.select("word").repartition(tasks, "word")
    out = None
    for wave in _waves(sizes, wave_bytes):
        rows = built.filter(F.col("shard").between(wave[0], wave[-1])).select("labels", "first", "word", "counts").collect()  # at most wave_bytes
        tries = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in rows])
        found = dealt.mapInArrow(_walk(tries), "word string, near string, near_n long")
        found = written(found, "neighbours")
        tries.destroy()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "word string, near string, near_n long") if out is None else out


def _walk(tries):
    """A task's work: every word of its rows through every shard of the wave."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walkers = [Walker(Trie.unpacked(*parts)) for parts in tries.value]
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                out: tuple[list, list, list] = ([], [], [])
                for w in batch.column(0).slice(low, 2000).to_pylist():
                    letters = w.encode("latin-1")
                    for walker in walkers:
                        for near, n in walker.near(letters).items():
                            out[0].append(w)
                            out[1].append(near.decode("latin-1"))
                            out[2].append(n)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])

    return walk


def _roots(formed: DataFrame) -> DataFrame:
    """word, root from (word, form): forms followed to the last one, twice as far in each round."""
    now = written(formed.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = written(further, "roots")
        drop(now)
        if further.filter("moved").isEmpty():
            return further.drop("moved")
        now = further.drop("moved")


def variants(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, shard_words: int = SHARD_WORDS, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    dictionary = written(words(docs, min_chars=min_chars, min_count=min_count), "words")
    pairs = neighbours(dictionary, shard_words=shard_words, wave_bytes=wave_bytes)
    # the largest n, then the smallest word: its letters' order turned round would do too, but min is plainer on a struct
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    is_form: Column = -F.col("best.minus") >= ratio * F.col("n")
    joined = dictionary.join(best, "word", "left")
    groups = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"),
    )
    groups = written(groups, "groups")
    drop(dictionary)
    roots = _roots(groups.filter("form is not null"))
    return groups.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: crc32 is worked out over the UTF-8 bytes, of which letters over U+00BF have two, from a table made by the usual rule.
ORACLE_SQL = r"""
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
u AS (SELECT d, run, count(*) AS times FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (
  SELECT *, list_prepend(4294967295, flatten(list_transform(string_split(d || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))) AS bytes FROM u),
h AS (SELECT b.*, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t.t[xor(c & 255, x) + 1])), 4294967295) AS h FROM b, t),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(times) AS BIGINT) AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM x),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM gap a JOIN w b ON a.less = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM gap a JOIN w b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY 1),
form AS (SELECT word, n_near, top, min(near) AS near FROM best JOIN pairs USING (word) WHERE near_n = top GROUP BY ALL),
g AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN near END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
  FROM w LEFT JOIN form USING (word)),
chain AS (
  WITH RECURSIVE c AS (SELECT word, word AS root, form AS next FROM g UNION ALL SELECT c.word, c.next, g.form FROM c JOIN g ON c.next = g.word)
  SELECT word, root FROM c WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM g JOIN chain USING (word)
"""
