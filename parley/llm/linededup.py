"""Line dedup over all documents, answered with keep bitmaps instead of texts.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys of 20 code points or more that stand in 3 documents or more keep their
lines in the document with the largest id only.

Hashes are dealt to ranges of (hash, document, position) and sorted there with
the largest document first, so a task streams over runs of one hash and holds
no more than the lines of one document. A frequent hash spreads over as many
ranges as its rows need: each range first tells which documents it saw of the
hash at its two edges (six rows at most), and those are put together before the
second pass. The bitmaps of dropped lines are compressed and joined with the
texts once.

* Missing and empty texts are one empty line, which is too short to drop.
* Rows without an id count as one document that is smaller than all others.
  Rows that share an id count as one document; lines are told apart by the text.
* Documents without dropped lines have no bitmap: all lines stay.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import SPACE, batch, kept, lower_ascii, slices, text_of

LEAST_CHARS, LEAST_DOCS = 20, 3
NO_ID = -(2 ** 63)  # stands for a missing id: below every other
EDGES = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("doc", pa.int64())])
DROPPED = pa.schema([("doc", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("pos", pa.int32())])


def line_hashes(docs: DataFrame) -> DataFrame:
    """One row for each line with a long enough key: two hashes of the key, document, text key, lines, position."""
    text = text_of()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(text).alias("text_key"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.select("doc", "text_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    rows = rows.withColumn("key", lower_ascii(F.btrim("line", F.lit(SPACE)))).where(F.char_length("key") >= LEAST_CHARS)
    return rows.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "doc", "text_key", "n_lines", "pos")


def in_ranges(rows: DataFrame) -> DataFrame:
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("pos"), F.col("text_key")]
    return kept(rows.repartitionByRange(*order).sortWithinPartitions(*order))


def runs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Both hashes of a batch, and where their runs begin, with the end."""
    h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
    cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
    return h1, h2, [0, *cut.tolist(), b.num_rows]


def edges(batches):
    """The three largest documents of the first and of the last hash of a range."""
    first = last = None  # [hash pair, documents]
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, starts = runs(b)
        doc = b.column("doc").to_numpy()
        for k in sorted({0, len(starts) - 2}):
            key = (int(h1[starts[k]]), int(h2[starts[k]]))
            seen = np.unique(doc[starts[k]:starts[k + 1]])[::-1][:LEAST_DOCS].tolist()
            if last is None or last[0] != key:
                last = [key, seen]
            else:
                last[1] = sorted({*last[1], *seen}, reverse=True)[:LEAST_DOCS]
            if first is None or first[0] == key:
                first = [key, list(last[1])]
    found = [(*key, d) for key, docs in {x[0]: x[1] for x in (first, last) if x}.items() for d in docs]
    yield batch(EDGES, list(zip(*found)) if found else [[], [], []])


def border(ranges: DataFrame) -> dict[tuple[int, int], tuple[int, bool]]:
    """For each hash at an edge of a range: its largest document, and whether there are enough documents.

    At most two hashes for each range of the shuffle, whatever the data.
    """
    seen = ranges.select("h1", "h2", "doc").mapInArrow(edges, "h1 bigint, h2 int, doc bigint")
    rows = seen.groupBy("h1", "h2").agg(F.max("doc").alias("largest"), F.count_distinct("doc").alias("n")).collect()
    return {(r.h1, r.h2): (r.largest, r.n >= LEAST_DOCS) for r in rows}


def streamed(at_edges: dict):
    """Streams over sorted rows and passes on the lines to drop."""

    def work(batches):
        key, docs, held = None, [], []  # of the run so far: hash pair, its first documents, rows of the second

        for b in batches:
            if not b.num_rows:
                continue
            h1, h2, starts = runs(b)
            doc = b.column("doc").to_numpy()
            out = []
            # runs of one row inside the batch are seen once in all: they stay
            lengths = np.diff(starts)
            for k in sorted({0, len(lengths) - 1, *np.flatnonzero(lengths > 1).tolist()}):
                s, e = starts[k], starts[k + 1]
                now = (int(h1[s]), int(h2[s]))
                if now in at_edges:
                    largest, many = at_edges[now]
                    if many:
                        out.append(b.slice(s, e - s).filter(pa.array(doc[s:e] != largest)))
                    continue
                if now != key:
                    key, docs, held = now, [], []
                docs = list(dict.fromkeys([*docs, *doc[s:e][np.flatnonzero(np.diff(doc[s:e], prepend=doc[s] - 1))].tolist()]))[:LEAST_DOCS]
                later = b.slice(s, e - s).filter(pa.array(doc[s:e] != docs[0]))
                if len(docs) >= LEAST_DOCS:
                    out += [*held, later]
                    held = []
                else:
                    held.append(later)
            for x in out:
                if x.num_rows:
                    yield x.select(DROPPED.names)

    return work


def bitmap(batches):
    """Positions of dropped lines as compressed bitmaps: bit 1 keeps the line."""
    for b in batches:
        bits = []
        for n, pos in zip(b.column("n_lines").to_pylist(), b.column("pos").to_pylist()):
            keep = np.ones(n, bool)
            keep[pos] = False
            bits.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc"), b.column("text_key"), b.column("n_lines"), pa.array([len(set(p)) for p in b.column("pos").to_pylist()], pa.int32()),
             pa.array(bits, pa.binary())], names=["doc", "text_key", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc (id, or the stand-in of a missing one), text_key, n_lines, n_dropped and bitmap of documents that lose lines."""
    ranges = in_ranges(line_hashes(docs))
    dropped = ranges.mapInArrow(streamed(border(ranges)), "doc bigint, text_key bigint, n_lines int, pos int")
    lists = dropped.groupBy("doc", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))
    return lists.mapInArrow(bitmap, "doc bigint, text_key bigint, n_lines int, n_dropped int, keep binary")


def cut(batches):
    """Replaces the last two columns, text and bitmap, by the kept text and two counts."""
    for b in slices(batches):
        texts, n_lines, n_dropped = [], [], []
        for text, keep in zip(b.column("_text").to_pylist(), b.column("_keep").to_pylist()):
            lines = text.split("\n")
            n_lines.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).tolist()
                lines = [x for x, bit in zip(lines, bits) if bit]
                text = "\n".join(lines)
            texts.append(text)
            n_dropped.append(n_lines[-1] - len(lines))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[:-2], pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
            names=[*b.schema.names[:-2], "kept_text", "n_lines", "n_dropped"])


def deduplicated(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` (``columns`` of them) with kept_text, n_lines (before) and n_dropped."""
    columns = ["doc_id"] if columns is None else columns
    rows = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)], F.xxhash64(text_of()).alias("_key"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_doc"), text_of().alias("_text"))
    bits = keep_bitmaps(docs).select(F.col("doc").alias("_doc"), F.col("text_key").alias("_key"), F.col("keep").alias("_keep"))
    own = [f"_c{k}" for k in range(len(columns))]
    joined = rows.join(bits, ["_doc", "_key"], "left").select(*own, "_text", "_keep")
    schema = ", ".join([*(f"{c} {joined.schema[c].dataType.simpleString()}" for c in own), "kept_text string", "n_lines bigint, n_dropped bigint"])
    return joined.mapInArrow(cut, schema).withColumnsRenamed(dict(zip(own, columns)))


def query(spark, sf_dir):
    made = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line),
many AS (
  SELECT key, max(doc_id) AS largest FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, line, pos, many.key IS NOT NULL AND doc_id <> largest AS dropped
  FROM keyed LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
