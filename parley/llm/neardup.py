"""Near-duplicates by b-bit MinHash, confirmed on full shingle sets.

A task turns each text into its set of word shingles, a 128-bit digest of the set,
MinHash minima joined into bands, and the low bits of the minima packed into whole
numbers. From there on only these travel:

1. Texts with the same set form one class with one representative.
2. Classes that share a band are candidates. Their similarity is estimated by
   counting equal low bits, corrected for bits that are equal by chance; pairs far
   below the limit go. For sets of up to MAPPED shingles a map of 2048 bits marks
   their hashes: a bit that only one of two sets has tells of a shingle that the
   other lacks, so the maps bound the similarity from above, and pairs bound below
   the limit go without any loss. The rest are confirmed on the full sets.
3. A group of copies is never expanded into all pairs. In each round every bucket
   that still holds several components tests its members against one of them; what
   links joins its component. Once a round no longer halves the pairs between
   different components, or they are few, these remaining pairs are compared inside
   a join by their packed bits, and those near the limit confirmed. No pair of a
   bucket is left out unless both are in one component already.
4. Components come from hooking to the smallest neighbour and doubling of paths.

With 32 bands of 5 minima, a pair with a similarity of 0.8 misses all bands with a
probability of 3e-6, one with 0.85 with 7e-9.

* Missing texts and texts without words have no shingles and stay alone.
* Repeated rows are in one class. Rows without an id count as one document that is
  smaller than all others; rows that share an id count as one document.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import LOWER_BYTES, slices, text_of, written

BANDS, ROWS = 32, 5
BITS = 2                        # low bits retained of each minimum
PACKED = BANDS * ROWS * BITS // 64
WORDS = 2                       # in a shingle, by the contract of the query
LIMIT = 80                      # per cent
MARGIN = 18                     # per cent: estimates this far below the limit are not confirmed
FEW = 4                         # open pairs for a member of a bucket that are tested all at once
REMEMBERED = 1 << 22            # hashes of sets that a task keeps at hand while it confirms pairs
SIEVE = 1 << 26                 # bits of the map of wanted texts that is sent to the tasks, whatever their number
NO_ID = -(2 ** 63)
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SIGNATURE = [f"s{k}" for k in range(PACKED)]
MAPPED = 1024                   # shingles of a set that has a map at most
MAP = [f"m{k}" for k in range(32)]  # 2048 bits


class Hashes(dict):
    """Hashes of words, made once while they are remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: int, known: Hashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    tokens = text.encode().translate(LOWER_BYTES).split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, n)
    size = min(words, n)
    mixed = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k:n - size + 1 + k]) * A
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def minima(values: np.ndarray) -> np.ndarray:
    """Upper halves of the smallest products with each multiplier."""
    factors = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        np.minimum(low, np.multiply.outer(factors, values[at:at + 512]).min(1), out=low)
    return low >> np.uint64(32)


def bands_of(low: np.ndarray) -> np.ndarray:
    mixed = np.arange(BANDS, dtype=np.uint64) * C
    for row in low.reshape(BANDS, ROWS).T:
        mixed = (mixed ^ row) * B
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 / BITS of them in each whole number."""
    each = (low & np.uint64((1 << BITS) - 1)).reshape(PACKED, -1)
    return np.bitwise_or.reduce(each << (np.arange(each.shape[1], dtype=np.uint64) * np.uint64(BITS)), 1).view(np.int64)


def marked(values: np.ndarray) -> np.ndarray:
    """The map of a set: a bit for the first 11 bits of each hash; empty for larger sets."""
    bits = np.zeros(2048, np.uint8)
    if len(values) <= MAPPED:
        bits[(values >> np.uint64(53)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows with id, text key, n_shingles, digest of the set (d1, d2), bands, signature and map."""
    def work(batches):
        import xxhash

        known = Hashes()
        for b in slices(batches):
            n, d1, d2, bands, signature, maps = [], [], [], [], [], []
            for text in b.column("_text").to_pylist():
                values = shingles(text, words, known)
                digest = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), np.int64)
                low = minima(values) if len(values) else np.zeros(BANDS * ROWS, np.uint64)
                n.append(len(values)), d1.append(int(digest[0])), d2.append(int(digest[1]))
                bands.append(bands_of(low) if len(values) else None), signature.append(packed(low))
                maps.append(marked(values))
            cells, bits = np.array(signature, np.int64).reshape(-1, PACKED), np.array(maps, np.int64).reshape(-1, len(MAP))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64())), *(pa.array(cells[:, k]) for k in range(PACKED)),
                 *(pa.array(bits[:, k]) for k in range(len(MAP)))],
                names=["id", "text_key", "n_shingles", "d1", "d2", "bands", *SIGNATURE, *MAP])

    cells = ", ".join(f"{s} bigint" for s in (*SIGNATURE, *MAP))
    return identified(docs).mapInArrow(
        work, f"id bigint, text_key bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, {cells}")


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(text_of()).alias("text_key"), text_of().alias("_text"))


def estimate(a: str, b: str) -> Column:
    """Similarity in per cent by the share of equal low bits, corrected for chance."""
    unequal = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        unequal = unequal + F.bit_count(folded.bitwiseAND(F.lit(sum(1 << k for k in range(0, 63, BITS)))))
    chance = 1 / 2 ** BITS
    return (1 - unequal / (BANDS * ROWS) - chance) / (1 - chance) * 100


def most_common(a: str, b: str) -> Column:
    """An upper bound for the shingles that two sets have in common, by their maps."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")

    def lacking(x: str, y: str) -> Column:
        total = F.lit(0)
        for k in MAP:
            total = total + F.bit_count(F.col(f"{x}.{k}").bitwiseAND(F.bitwise_not(f"{y}.{k}")))
        return total

    return F.when((n <= MAPPED) & (m <= MAPPED), F.least(n - lacking(a, b), m - lacking(b, a))).otherwise(F.least(n, m))


def may_link(a: str, b: str, limit: int) -> Column:
    """Whether the sizes of both sets, the estimate and the maps leave a link possible."""
    n, m, common = F.col(f"{a}.n"), F.col(f"{b}.n"), most_common(a, b)
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * limit) & (estimate(a, b) >= limit - MARGIN)
            & (common * (100 + limit) >= (n + m) * limit))  # named once, so counted once for a pair


def smallest_labels(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the smallest node that can be reached."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(nodes.withColumn("label", F.col("node")))
    while not links.isEmpty():
        # every node hooks to its smallest neighbour; paths are doubled until they end at a root
        up = written(links.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to")).withColumn("moved", F.lit(True)))
        while not up.where("moved").isEmpty():
            again = up.select(F.col("root").alias("to"), F.col("to").alias("further"))
            up = written(up.join(again, "to", "left").select(
                "root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
        up = up.select("root", "to")
        labels = written(labels.join(up.withColumnRenamed("root", "label"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label")))
        for side in ("a", "b"):
            links = links.join(up.withColumnRenamed("root", side), side, "left").withColumn(
                side, F.coalesce("to", side)).drop("to")
        links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return labels


def sieve_of(wanted: DataFrame) -> np.ndarray:
    """SIEVE bits, of which each wanted (id, text_key) sets one: a text whose bit is not set isn't wanted."""
    bits = wanted.select(F.pmod(F.xxhash64("id", "text_key"), F.lit(SIEVE)).alias("bit"))
    cells = bits.groupBy(F.shiftright("bit", 5).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits")).toPandas()
    made = np.zeros(SIEVE // 32, np.uint32)
    made[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint32)
    return made


def texts_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Compressed texts of some classes, by the id and text key of their representatives.

    Texts that can't be wanted are left where they are read: a map of bits, of one size
    for any number of classes, tells most of them. What passes is compressed before it is
    shuffled, and joined exactly.
    """
    wanted = classes.select(F.col("node").alias("id"), "text_key")
    sent = docs.sparkSession.sparkContext.broadcast(sieve_of(wanted))

    def squeeze(batches):
        cells = sent.value
        for b in slices(batches):
            bit = b.column("bit").to_numpy()
            b = b.filter(pa.array((cells[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            data = [zlib.compress(t.encode(), 1) for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(data, pa.binary())],
                                             names=["id", "text_key", "text"])

    rows = identified(docs).withColumn("bit", F.pmod(F.xxhash64("id", "text_key"), F.lit(SIEVE)))
    found = rows.mapInArrow(squeeze, "id bigint, text_key bigint, text binary").join(wanted, ["id", "text_key"], "left_semi")
    return found.dropDuplicates(["id", "text_key"]).select(F.col("id").alias("node"), "text")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, limit: int) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of ``limit`` per cent or more."""
    def work(batches):
        known, sets = Hashes(), {}  # sets of a task's last texts, of REMEMBERED hashes in all
        room = REMEMBERED

        def set_of(node, data):
            nonlocal room
            found = sets.get(node)
            if found is None:
                if room < 0:
                    sets.clear()
                    room = REMEMBERED
                found = sets[node] = shingles(zlib.decompress(data.as_py()).decode(), words, known)
                room -= len(found)
            return found

        for b in batches:
            keep = []
            for k, (x, y) in enumerate(zip(b.column("a").to_pylist(), b.column("b").to_pylist())):
                p, q = set_of(x, b.column("text_a")[k]), set_of(y, b.column("text_b")[k])
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= limit * (len(p) + len(q) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the side with few texts for many pairs comes last, so pairs arrive sorted by it
    of_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    of_a = of_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return of_a.select("a", "b", "text_a", "text_b").mapInArrow(work, "a bigint, b bigint")


def linked(docs: DataFrame, classes: DataFrame, words: int, limit: int) -> DataFrame:
    """Labels (node, label) of the classes that are linked with others."""
    ids = classes.select("node", F.explode("bands").alias("band"))
    shared = ids.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = written(ids.join(shared, "band"))
    signatures = written(classes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", "text_key", F.struct("n", *SIGNATURE, *MAP).alias("s")))
    texts = written(texts_of(docs, signatures))
    links = members.sparkSession.createDataFrame([], "a bigint, b bigint")
    tested, labels, turn, before = links, None, 0, None

    def near(pairs: DataFrame) -> DataFrame:
        """New pairs whose estimate doesn't rule them out."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
        for side in ("a", "b"):
            pairs = pairs.join(signatures.select(F.col("node").alias(side), F.col("s").alias(f"s_{side}")), side)
        return written(pairs.where(may_link("s_a", "s_b", limit)).select("a", "b"))

    while True:
        now = members if labels is None else members.join(labels, "node", "left")
        now = now.select("band", "node", (F.col("node") if labels is None else F.coalesce("label", "node")).alias("label"))
        parts = now.groupBy("band", "label").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("lead"))
        buckets = parts.groupBy("band").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("labels"),
            F.max_by("lead", "n").alias("lead"), F.max_by("label", "n").alias("lead_label")).where("labels > 1")
        buckets = written(buckets)
        size = buckets.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("open")).first()
        if not size.n:
            break
        last = turn > 0 and (size.open <= FEW * size.n or 2 * size.open > before)
        before = size.open
        if last:  # all pairs of different components; the condition is checked inside the join
            open_members = now.join(buckets.select("band"), "band").join(signatures.select("node", "s"), "node")
            a, b = (open_members.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "label", "s"))) for x in "ab")
            pairs = a.join(b, "band").where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b"))
                                            & may_link("s_a", "s_b", limit))
            pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        else:
            pairs = now.join(buckets.select("band", "lead", "lead_label"), "band").where("label <> lead_label")
            pairs = pairs.select(F.col("node").alias("a"), F.col("lead").alias("b"))
        pairs = near(pairs)
        links = written(links.union(confirmed(pairs, texts, words, limit)))
        tested = written(tested.union(pairs))
        labels = smallest_labels(links)
        turn += 1
        if last:
            break
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))


def grouped(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """Every row's id (NO_ID where missing), text key, n_shingles and component, the smallest id it is linked with."""
    rows = written(sketched(docs, words))
    classes = rows.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("id").alias("node"), F.min_by("text_key", "id").alias("text_key"), F.first("bands").alias("bands"),
        F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in (*SIGNATURE, *MAP)))
    classes = written(classes)
    labels = linked(docs, classes, words, limit)
    of_class = classes.join(labels, "node", "left").select("d1", "d2", F.coalesce("label", "node").alias("component"))
    return rows.join(of_class, ["d1", "d2"], "left").select(
        "id", "text_key", "n_shingles", F.coalesce("component", "id").alias("component"))


def survivors(docs: DataFrame, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """Rows of ``docs`` with the smallest id of their group; one row where that id repeats."""
    kept_keys = grouped(docs, words, limit).where("id = component").select("id", "text_key").dropDuplicates(["id"])
    own = [f"_c{k}" for k in range(len(docs.columns))]  # whatever their names, the documents' columns are numbered
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_of()).alias("_key"),
                       *(F.col(c).alias(n) for c, n in zip(docs.columns, own)))
    found = rows.join(kept_keys, (rows["_id"] == kept_keys["id"]) & (rows["_key"] == kept_keys["text_key"]), "left_semi")
    return found.dropDuplicates(["_id"]).select(*own).withColumnsRenamed(dict(zip(own, docs.columns)))


def query(spark, sf_dir):
    made = grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return made.select(known("id").alias("doc_id"), "n_shingles", known("component").alias("component_id"),
                       (F.col("id") == F.col("component")).alias("kept"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE
         list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS r FROM shingle JOIN size USING (doc_id)
  JOIN (SELECT s, count(*) AS f FROM shingle GROUP BY s) USING (s)),
prefix AS (SELECT * FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
candidate AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
overlap AS (
  SELECT a, b, count(*) AS c FROM candidate JOIN shingle x ON x.doc_id = a JOIN shingle y ON y.doc_id = b AND x.s = y.s
  GROUP BY a, b),
link AS (
  SELECT a, b FROM overlap JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM comp LEFT JOIN size USING (doc_id)
"""
