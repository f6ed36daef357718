"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by pairs of trie nodes.

All words stand in two tries, one read forwards and one backwards. A node of
either is a whole number, so a word cut at a place is the pair (node of what is
before, node of what is behind). Words that leave out one letter each at the same
place have an equal pair there: they differ by a replacement. A word that leaves
out one letter has the pair of another word cut at that place: a deletion. So one
grouping by pairs finds all neighbours and nothing else.

Nodes of at most SHALLOW letters are numbered by their letters (every letter is
below 256); deeper ones by a table of all distinct nodes, told apart by 128-bit
hashes. A pair has at most one word that is cut there, and no more words that
leave out a letter than there are letters (90), so no group grows with the input.
Deleting any letter of a run of equal ones gives the same word: only the first of
a run is left out for that, so each pair of neighbours is found once.

* Missing and empty texts have no words; an empty table gives no rows. A missing
  id counts as the empty text where it is hashed.
* Repeated rows count as often as they stand. Words that are frequent are counted
  in each task first, so one word may fill a third of the corpus.
* Very long words have as many nodes as letters; their hashes are made along the
  word, in time in proportion to its length.
* Ties for a form go to the smallest word in code-point order. Further columns of
  the documents, whatever their names, are not read.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import LOWER_BYTES, documents, slices, text_of, written

RUN = "[a-zÀ-ÿ]+"     # of a text whose A-Z are in lower case
EVERY = 97                      # one of so many runs loses a letter
LEAST_CHARS, LEAST_N = 5, 3
SHALLOW = 7                     # letters of a node that is numbered by them
HELD = 1 << 18                  # words that a task counts before it passes them on
HELD_CHARS = 1 << 24            # and their code points
FORWARD, BACKWARD = 0, 1
CUT, SKIP, FIRST = 0, 1, 2      # what a word does at a place: is cut, leaves out a letter, the first of equal ones


def varied(run: str, h: int) -> str:
    """The run without one letter, where ``EVERY`` divides the hash."""
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that stand LEAST_N times or more in all texts."""
    def work(batches):
        find, n, chars = re.compile(RUN).findall, Counter(), 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for b in slices(batches):
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("_text").to_pylist()):
                before = zlib.crc32(b":" if d is None else b"%d:" % d)
                for run, times in Counter(find(text.encode().translate(LOWER_BYTES).decode())).items():
                    if len(run) >= LEAST_CHARS:
                        h = zlib.crc32(run.encode(), before)
                        word = run if h % EVERY else varied(run, h)
                        if len(word) >= LEAST_CHARS:
                            n[word] += times
                            chars += len(word)
                if len(n) >= HELD or chars >= HELD_CHARS * 16 or chars >= HELD_CHARS and sum(map(len, n)) >= HELD_CHARS:
                    yield rows()
                    n, chars = Counter(), 0
        yield rows()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("_text"))
    parts = rows.mapInArrow(work, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def numbered(words: DataFrame) -> DataFrame:
    """Words with ``word_id``, a number of their own."""
    return written(words.withColumn("word_id", F.monotonically_increasing_id()))


def by_letters(letters: bytes) -> int:
    """The number of a node of few letters, in the order from its root."""
    return int.from_bytes(letters, "big")


def deep_nodes(words: DataFrame) -> DataFrame:
    """The nodes of more than SHALLOW letters on every word's paths: word_id, side, depth and hash."""
    def work(batches):
        import xxhash

        for b in batches:
            out = [[], [], [], [], []]
            for i, word in zip(b.column("word_id").to_pylist(), b.column("word").to_pylist()):
                letters = word.encode("latin-1")
                for side, path in ((FORWARD, letters), (BACKWARD, letters[::-1])):
                    h = xxhash.xxh3_128(path[:SHALLOW])
                    for depth in range(SHALLOW + 1, len(path) + 1):
                        h.update(path[depth - 1:depth])
                        d = h.intdigest()
                        for c, x in zip(out, (i, side, depth, (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63))):
                            c.append(x)
                    if len(out[0]) > 1 << 16:
                        yield node_rows(out)
                        out = [[], [], [], [], []]
            yield node_rows(out)

    return words.select("word_id", "word").where(F.char_length("word") > SHALLOW).mapInArrow(
        work, "word_id bigint, side int, depth int, d1 bigint, d2 bigint")


def node_rows(columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word_id", "side", "depth", "d1", "d2"])


def with_nodes(words: DataFrame) -> DataFrame:
    """Words with the numbers of their deeper nodes, ascending by side and depth; below 0, apart from those by letters."""
    deep = written(deep_nodes(words))
    key = ["side", "depth", "d1", "d2"]
    table = written(deep.select(*key).distinct().withColumn("node", -1 - F.monotonically_increasing_id()))
    paths = deep.join(table, key).groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("side", "depth", "node"))).alias("path"))
    return words.select("word_id", "word").join(paths.select("word_id", F.col("path.node").alias("deep")), "word_id", "left")


def places(words: DataFrame) -> DataFrame:
    """The pairs of nodes of every word: (before, behind, what, word_id)."""
    def work(batches):
        for b in slices(batches, 4096):
            out = [[], [], [], []]
            for i, word, deep in zip(b.column("word_id").to_pylist(), b.column("word").to_pylist(), b.column("deep").to_pylist()):
                letters, size, deep = word.encode("latin-1"), len(word), deep or []
                n = min(size, SHALLOW) + 1
                before = [by_letters(letters[:k]) for k in range(n)] + deep[:len(deep) // 2]
                back = letters[::-1]
                behind = [by_letters(back[:k]) for k in range(n)] + deep[len(deep) // 2:]
                behind.reverse()  # now by the place where the rest begins
                out[0] += before
                out[1] += behind
                out[2] += [CUT] * (size + 1)
                out[0] += before[:-1]
                out[1] += behind[1:]
                out[2] += [FIRST if not k or letters[k] != letters[k - 1] else SKIP for k in range(size)]
                out[3] += [i] * (2 * size + 1)
                if len(out[0]) > 1 << 16:
                    yield place_rows(out)
                    out = [[], [], [], []]
            yield place_rows(out)

    return with_nodes(words).select("word_id", "word", "deep").mapInArrow(work, "before bigint, behind bigint, what int, word_id bigint")


def place_rows(columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["before", "behind", "what", "word_id"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word_id, near): all pairs of neighbours, each in both directions and once."""
    groups = places(words).groupBy("before", "behind").agg(
        F.collect_list(F.when(F.col("what") != CUT, F.col("word_id"))).alias("skips"),
        F.collect_list(F.when(F.col("what") == FIRST, F.col("word_id"))).alias("longer"),
        F.max(F.when(F.col("what") == CUT, F.col("word_id"))).alias("shorter"))
    groups = groups.where((F.size("skips") > 1) | F.col("shorter").isNotNull() & (F.size("longer") > 0))
    replaced = F.flatten(F.transform("skips", lambda a: F.transform(
        F.filter("skips", lambda b: b != a), lambda b: F.struct(a.alias("word_id"), b.alias("near")))))
    shorter = F.col("shorter")
    both_ways = F.flatten(F.transform("longer", lambda a: F.array(
        F.struct(a.alias("word_id"), shorter.alias("near")), F.struct(shorter.alias("word_id"), a.alias("near")))))
    all_pairs = F.concat(replaced, F.when(shorter.isNotNull(), both_ways).otherwise(F.array()))
    return groups.select(F.inline(all_pairs))


def roots(forms: DataFrame) -> DataFrame:
    """(word_id, root_id) for words with a form (word_id, form_id): the last of the chain of forms.

    Paths are doubled until none gets longer. Each form is at least twice as frequent
    as its word, so chains are short and have no circles.
    """
    steps = written(forms.select("word_id", F.col("form_id").alias("root_id"), F.lit(True).alias("moved")))
    while not steps.where("moved").isEmpty():
        further = steps.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next"))
        steps = written(steps.join(further, "root_id", "left").select(
            "word_id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
    return steps.select("word_id", "root_id")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = numbered(counted(docs))
    other = words.select(F.col("word_id").alias("near"), F.col("n").alias("near_n"), F.col("word").alias("near_word"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word", "near")).alias("best")
    near = near_pairs(words).join(other, "near").groupBy("word_id").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word_id", "left").withColumn("_form", -F.col("best.less") >= 2 * F.col("n"))
    rows = written(rows.select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                               *(F.when(F.col("_form"), c).alias(a) for c, a in (
                                   (F.col("best.near"), "form_id"), (F.col("best.near_word"), "form"), (-F.col("best.less"), "form_n")))))
    ends = roots(rows.where("form_id is not null")).join(
        words.select(F.col("word_id").alias("root_id"), F.col("word").alias("root")), "root_id")
    return rows.join(ends, "word_id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir):
    return variants(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
             ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc),
word AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
              ELSE run END AS word, sum(times)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(times) >= 3),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word),
skip AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM place),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM skip x JOIN skip y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM skip x JOIN word y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM skip x JOIN word y ON x.a || x.b = y.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * w.n THEN top_n END AS form_n,
         CASE WHEN top_n >= 2 * w.n THEN (SELECT min(other) FROM near WHERE near.word = w.word AND other_n = top_n) END AS form
  FROM word w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM formed UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""
