"""Mixing sources to target weights, in DataFrame functions only.

Every source's documents are laid end to end and cut into blocks of a fixed
number of words. The mix is a row of slots of one block each, cut into shards.
Its source counts per shard are multinomial draws under fixed totals: every
source owns as many slots as its target asks for, and one pseudorandom
permutation of all slots deals them to the shards. A source's slots walk through
its blocks by a pseudorandom permutation of their indices, a new one for every
pass, and are joined with the blocks by index.

* Missing texts have no words; they and empty texts are never taken.
* Rows without a source form the last source. Repeated rows are documents of
  their own. Sources without words have target 0.
* The largest source may hold any share of the rows: offsets are running sums
  within hashed groups of its documents plus the sums of the groups before.
* Results depend on the rows only, not on their order or partitions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import WORD, kept, text_of

BLOCK = 32          # words in a block
SHARD = 8192        # slots in an output shard
GROUPS = 1024       # hashed groups of documents in a source
STRETCH = 16384     # slots that one row is expanded to at once
TASK = 1 << 20      # slots of one task at most, on average
ROUNDS = 12         # rounds of a permutation
UNIT = 1 << 20      # parts that a copy of a document is counted in
PARTS = 64          # hashed parts of a source's documents of about one size
SEED = 17


def permuted(index: Column, size: Column, seed: Column, backwards: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. size-1 by the swap-or-not shuffle.

    Each round pairs an index with (key - index) mod size and a bit that both of
    the pair see decides whether they change places, so each round, and the
    whole, is one-to-one for any size.
    """
    rounds = range(ROUNDS)[::-1] if backwards else range(ROUNDS)

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), size) - at, size)
        bit = F.xxhash64(seed, r, F.greatest(at, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in rounds]), index.cast("bigint"), step)


def sized(docs: DataFrame) -> DataFrame:
    """Every row with its number of words; texts end here."""
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("bigint").alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources (one row each) with their place by code point, null last, from 0.

    Places are found without one task that sees all: sources are dealt to ranges
    of their order, ranked there, and the sizes of the ranges before are added.
    """
    spread = kept(sources.repartitionByRange(F.col("source").asc_nulls_last())
                  .withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row for each range
    here = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return (spread.withColumn("_row", F.row_number().over(here)).join(starts, "_range")
            .withColumn("place", F.col("_start") + F.col("_row") - 1).drop("_range", "_start", "_row"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Sources with ``target`` words: shares by weight of all words, at most ``most`` times what there is.

    A source above its limit stays at the limit and the others share the rest by
    weight. The level (words for a unit of weight) only rises from step to step,
    so a source once at its limit stays there; each step is one sum over sources.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = kept(numbered(sources).withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most)))
    level, capped = 0.0, -1
    while True:
        full = F.col("limit") <= F.col("weight") * level
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("limit"))).alias("held"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if row.n == capped or not row.open:
            break
        level, capped = ((row["all"] or 0) - (row.held or 0.0)) / row.open, row.n
    return table.withColumn("target", F.least("limit", F.col("weight") * F.lit(float(level))))


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows with the place of their first word in their source's run of words (``start``).

    Ties are rows alike in id and size; which of them comes first changes nothing.
    """
    rows = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(GROUPS)))
    groups = rows.groupBy("source", "_group").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("source", "_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = (Window.partitionBy("source", "_group").orderBy("doc_id", "size", "row_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.withColumn("_local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = [local["source"].eqNullSafe(starts["source"]), local["_group"] == starts["_group"]]
    return (local.join(starts, same).select(local["*"], (F.col("_start") + F.col("_local")).alias("start"))
            .drop("_group", "_local"))


def quotas(plan: DataFrame) -> tuple[DataFrame, int]:
    """Slots of every source, the first of them in the order of sources, and the number of all slots."""
    made = plan.where("source_size > 0").withColumn(
        "n_blocks", F.ceil(F.col("source_size") / BLOCK).cast("bigint")).withColumn(
        "n_slots", F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("bigint"),
                           F.col("n_blocks") * 3)).where("n_slots > 0")
    # running sum over sources in two levels, a bounded number of places in each group
    made = kept(made.withColumn("_far", F.floor(F.col("place") / GROUPS)))
    far = made.groupBy("_far").agg(F.sum("n_slots").alias("_sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("_far", F.coalesce(F.sum("_sum").over(before(Window.orderBy("_far"))), F.lit(0)).alias("_base"))
    near = made.withColumn("_in", F.coalesce(
        F.sum("n_slots").over(before(Window.partitionBy("_far").orderBy("place"))), F.lit(0)))
    total = made.agg(F.sum("n_slots")).first()[0] or 0
    return near.join(far, "_far").withColumn("first_slot", F.col("_base") + F.col("_in")).select(
        "source", "place", "n_blocks", "n_slots", "first_slot"), total


def draw(plan: DataFrame) -> DataFrame:
    """The slots of the mix: shard, position in it, source place and block index."""
    quota, total = quotas(plan)
    # an explicit number of partitions, as the few rows here become many slots
    parts = max(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    stretches = quota.select("*", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("n_slots") - 1) / STRETCH).cast("bigint"))).alias("_stretch")).repartition(parts, "place", "_stretch")
    low = F.col("_stretch") * STRETCH
    slots = stretches.select("place", "n_blocks", "first_slot", F.explode(F.sequence(
        low, F.least(low + STRETCH, F.col("n_slots")) - 1)).alias("k"))
    at = permuted(F.col("first_slot") + F.col("k"), F.lit(total), F.lit(SEED))
    turn = F.floor(F.col("k") / F.col("n_blocks"))
    block = permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.xxhash64(F.lit(SEED), "place", turn))
    return slots.select(F.floor(at / SHARD).alias("shard"), (at % SHARD).alias("position"), "place", block.alias("block"))


def packed(rows: DataFrame) -> DataFrame:
    """The part of every document in every block: place, block, row, first word of the document there, words."""
    last = F.col("start") + F.col("size") - 1
    parts = rows.where("size > 0").select("place", "row_id", "doc_id", "start", "size", F.explode(
        F.sequence(F.floor(F.col("start") / BLOCK), F.floor(last / BLOCK))).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return parts.select("place", "block", "row_id", "doc_id", (begin - F.col("start")).alias("from_word"),
                        (end - begin).alias("words"))


def planned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with size, place, start, source_size and target; sources with the same)."""
    rows = kept(sized(docs).withColumn("row_id", F.monotonically_increasing_id()))
    plan = kept(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    laid = laid_out(rows)
    full = laid.join(plan, laid["source"].eqNullSafe(plan["source"])).select(
        laid["*"], "place", "source_size", "target")
    return kept(full), plan


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: for each slot the documents' words that fill it (shard, position, doc_id, from_word, words)."""
    rows, plan = planned(docs)
    return draw(plan).join(packed(rows), ["place", "block"]).select(
        "shard", "position", "place", "block", "doc_id", "row_id", "from_word", "words")


def taken_rows(docs: DataFrame) -> DataFrame:
    """Rows with place, size, source_size, target and ``taken``, the words that the mix takes from them.

    Slots are counted by block before the join, so a block that is taken again
    is one row.
    """
    rows, plan = planned(docs)
    counts = draw(plan).groupBy("place", "block").agg(F.count("*").alias("times"))
    taken = packed(rows).join(counts, ["place", "block"]).groupBy("row_id").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(taken, "row_id", "left").select(
        "place", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def taken_words(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, size, source_size, target and ``taken``, the words that the mix takes from it."""
    return taken_rows(docs).drop("place")


def in_copies(rows: DataFrame) -> DataFrame:
    """Rows of ``taken_rows`` that hold words, with ``copies``: taken words over words, in whole copies.

    A source's documents stand in the order of their sizes, and what a document lacks of
    a whole copy goes to the next one. So a document has its share of copies rounded up
    or down, and what the source has too many or too few is about one long document.
    """
    share = F.floor(F.col("taken") * UNIT / F.col("size")).cast("bigint")
    rows = kept(rows.where("size > 0").withColumn("_share", share).withColumn(
        "_class", F.floor(F.log2("size") * 4)).withColumn("_part", F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "size"), F.lit(PARTS))))
    group = ["place", "_class", "_part"]
    before = Window.partitionBy("place").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group).agg(F.sum("_share").alias("_sum")).select(
        *group, (F.coalesce(F.sum("_sum").over(before), F.lit(0)) + F.pmod(F.xxhash64(F.lit(SEED), "place"), F.lit(UNIT))).alias("_start"))
    upto = Window.partitionBy(*group).orderBy("size", "doc_id", "taken").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_start") + F.col("_upto")
    return rows.withColumn("_upto", F.sum("_share").over(upto)).join(starts, group).withColumn("copies", (
        F.floor(end / UNIT) - F.floor((end - F.col("_share")) / UNIT)).cast("bigint")).drop(*group[1:], "_share", "_upto", "_start")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, in whole copies that keep to the words taken from each source.

    Keeps the columns of ``docs``. Copies of one id that differ in size are told apart by
    size; rows alike in both share their copies evenly, the rest by a hash of the text.
    """
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("bigint")
    times = in_copies(taken_rows(docs)).groupBy("doc_id", "size").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).select(
        F.col("doc_id").alias("_mix_id"), F.col("size").alias("_mix_size"), (F.col("_copies") / F.col("_rows")).alias("_mix_copies"))
    left = docs.withColumn("_own_size", size)
    joined = left.join(times.where("_mix_copies > 0"), F.col("doc_id").eqNullSafe(F.col("_mix_id"))
                       & (F.col("_own_size") == F.col("_mix_size")))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), text_of()), F.lit(UNIT)) / UNIT
    joined = joined.withColumn("_mix_copies", F.floor("_mix_copies") + (drawn < F.col("_mix_copies") % 1).cast("int"))
    copies = joined.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_copies"))))
    return copies.drop("_own_size", "_mix_id", "_mix_size", "_mix_copies", "_mix_copy")


def query(spark, sf_dir):
    return taken_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
