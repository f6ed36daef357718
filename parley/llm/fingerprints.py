"""Document fingerprints that can be subtracted: invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut into pieces that end where the hash of a word says so: the cuts follow
the content and meet again after an edit. How many words a piece has goes by the
length of the text (its level), so short texts have small pieces, long ones have
paragraphs of many words, and most texts have 7 to 15 pieces. A digest names a piece
and how often it stands in the text.

A fingerprint has three tables of cells. Every digest adds 1 and, by xor, a check
value and itself to one cell of each table. Two fingerprints subtract cell by cell;
what both texts share cancels, and peeling takes out cells that hold one digest
until none is left. Where peeling stops early, the digests of both texts are sketched
anew in sections of such cells, enough of them for all digests; the digests of
sections that still can't be peeled are sketched again with another seed.

* Missing texts count as empty. An empty text has an empty sketch.
* Likeness is shared over all digests of the two texts; two empty ones have 1. Texts
  of different levels are compared by pieces of the higher one, texts with and without
  blanks by finer words.
* The next document goes by id, ties by the hash of the text, missing ids first;
  the last is followed by the first. Equal rows are documents of their own. Ids that
  many rows share, or many rows without an id, are dealt to tasks by their texts.
* An empty table gives no rows. Further columns, whatever their names, are not read.
* Very long texts have few pieces like others; where a text has very many pieces
  (its words end pieces unusually often), the work grows with their number to the
  power of 1.5.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import text_of, written

CUT = "0-9A-Zjqxz\\x{2E80}-\\x{10FFFF}"  # characters that end a token, for runs without blanks
TOKEN = rf"[^\s{CUT}]+(?:[{CUT}]\s*|\s*)|[{CUT}]\s*|\s+"  # for texts with few blanks
BLANKS = 16         # a text with a blank in so many bytes is cut at blanks first, another one by TOKEN
LEAF = 384          # bytes of a text of level 0 at most; every level has twice as many
EVERY = 8           # one of so many tokens ends a piece at level 0, and a piece has as many at most
TABLE = 16          # cells in a table
CELLS = 3 * TABLE   # of a fingerprint and of a section of a larger sketch
PEELS = 12          # times that all single digests are taken out together
PER_SECTION = 8     # digests in a section of a larger sketch, on average at most
RETRIES = 8         # with twice the sections for the digests that are left, each time
SEED = 29
BUCKET = 5          # ids are put into groups of 2**BUCKET neighbours
CROWDED = 1024      # rows in a group that is dealt out further
LEVEL = 10          # and groups into groups of 2**LEVEL above that
NO_ID = -(2 ** 63)


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def none() -> Column:
    return F.array().cast("array<bigint>")


def grain_of(text: Column) -> Column:
    """How a text is cut: twice its level, and 1 more where blanks alone would leave long words."""
    size = F.greatest(F.octet_length(text), F.lit(1))
    level = F.greatest(F.ceil(F.log2(size / LEAF)), F.lit(0)).cast("int")
    blanks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return level * 2 + (blanks * BLANKS < F.octet_length(text)).cast("int")


def common_grain(a: Column, b: Column) -> Column:
    """The higher level, and cut finely if one of them is."""
    return F.greatest(F.shiftright(a, 1), F.shiftright(b, 1)) * 2 + a.bitwiseOR(b).bitwiseAND(F.lit(1))


def tokens_of(text: Column, grain: Column) -> Column:
    return F.when(grain.bitwiseAND(F.lit(1)) == 0, F.split(text, " ", -1)).otherwise(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def pieces(tokens: Column, every: Column) -> Column:
    """Hashes of the runs of tokens up to one whose hash ends a piece; longer runs in pieces of ``every`` tokens."""
    last = F.size(tokens)
    ends = F.filter(F.transform(tokens, lambda w, i: F.when(
        (F.xxhash64(w, F.lit(SEED)).bitwiseAND(every - 1) == 0) | (i + 1 == last), i + 1)), lambda e: e.isNotNull())

    def cut(ends: Column) -> Column:
        def run(e: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(1)).otherwise(F.get(ends, k - 1) + 1)
            return F.transform(F.sequence(start, e, every), lambda at: F.xxhash64(
                F.slice(tokens, at, F.least(every, e - at + 1))))

        return F.flatten(F.transform(ends, run))

    return let(ends, cut)


def digests(text: Column, grain: Column) -> Column:
    """Digests of the distinct pieces of a text with the numbers of times they stand there."""
    every = F.lit(EVERY) * F.pow(F.lit(2), F.shiftright(grain, 1)).cast("int")
    hashes = let(every, lambda e: let(tokens_of(text, grain), lambda tokens: pieces(tokens, e)))
    return let(F.array_sort(hashes), counted)


def counted(plain: Column) -> Column:
    """Sorted hashes; each distinct one becomes a digest of itself and its number."""
    starts = F.filter(F.transform(plain, lambda h, i: F.when((i == 0) | (F.get(plain, i - 1) != h), i)), lambda i: i.isNotNull())
    return let(starts, lambda at: F.transform(at, lambda i, k: F.xxhash64(
        F.get(plain, i), F.coalesce(F.get(at, k + 1), F.size(plain)) - i)))


def check_of(key: Column) -> Column:
    return F.xxhash64(key, F.lit(SEED))


def placed(key: Column, seed: Column, sign: Column) -> Column:
    """A digest with its check value and its cell in each of three tables, by slices of one hash."""
    return let(F.xxhash64(key, seed), lambda h: F.struct(
        key.alias("key"), check_of(key).alias("check"), sign.cast("bigint").alias("sign"),
        *[(F.pmod(F.shiftright(h, 20 * t), F.lit(TABLE)) + TABLE * t).cast("int").alias(f"q{t}") for t in range(3)]))


def put(cell: Column, some: Column, out: bool = False) -> Column:
    """A cell with placed digests put in, or taken out."""
    return F.when(F.size(some) == 0, cell).otherwise(F.aggregate(some, cell, lambda c, k: F.struct(
        (c["count"] - k["sign"] if out else c["count"] + k["sign"]).alias("count"),
        c["check"].bitwiseXOR(k["check"]).alias("check"), c["key"].bitwiseXOR(k["key"]).alias("key"))))


def sketch(keys: Column, seed: Column | int = 0) -> Column:
    """The cells of some digests: counts, and checks and digests joined by xor."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    zero = F.lit(0).cast("bigint")
    empty = F.struct(zero.alias("count"), zero.alias("check"), zero.alias("key"))

    def tables(info: Column) -> Column:
        return F.concat(*[F.transform(F.sequence(F.lit(t * TABLE), F.lit(t * TABLE + TABLE - 1)), lambda i: let(
            F.filter(info, lambda k: k[f"q{t}"] == i), lambda some: put(empty, some))) for t in range(3)])

    return let(F.transform(keys, lambda k: placed(k, seed, F.lit(1))), tables)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["count"] - y["count"]).alias("count"), x["check"].bitwiseXOR(y["check"]).alias("check"), x["key"].bitwiseXOR(y["key"]).alias("key")))


def peeled(cells: Column, seed: Column | int = 0) -> Column:
    """(left, right): the digests that the cells of a difference hold; null where peeling leaves some over.

    Every step takes out all digests that are alone in a cell.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)

    def alone(cells: Column) -> Column:
        pure = F.filter(cells, lambda c: (F.abs(c["count"]) == 1) & (c["check"] == check_of(c["key"])))
        return F.array_distinct(F.transform(pure, lambda c: placed(c["key"], seed, c["count"])))

    def step(state: Column, _) -> Column:
        def without(out: Column) -> Column:
            cells = F.transform(state["cells"], lambda c, i: let(F.filter(
                out, lambda k: (k["q0"] == i) | (k["q1"] == i) | (k["q2"] == i)), lambda some: put(c, some, out=True)))
            side = lambda name, own: F.concat(state[name], F.transform(
                F.filter(out, lambda k: (k["sign"] > 0) == own), lambda k: k["key"])).alias(name)
            return F.struct(cells.alias("cells"), side("left", True), side("right", False))

        return let(alone(state["cells"]), lambda out: F.when(F.size(out) == 0, state).otherwise(without(out)))

    start = F.struct(cells.alias("cells"), none().alias("left"), none().alias("right"))
    over = F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, step)
    return let(over, lambda s: F.when(
        F.forall(s["cells"], lambda c: (c["count"] == 0) & (c["check"] == 0) & (c["key"] == 0)),
        F.struct(s["left"].alias("left"), s["right"].alias("right"))))


def enlarged(a: Column, b: Column) -> Column:
    """The difference by a sketch large enough for all digests of both sides.

    It is kept in sections of CELLS cells, to which a digest belongs by its hash. The
    digests of sections that can't be peeled are sketched anew, with another seed and
    twice the sections for their number. Should the last retry leave some, with a
    chance far below one in 10**12, they are compared directly.
    """
    def attempt(state: Column, t: Column) -> Column:
        n = F.greatest(F.ceil((F.size(state["a"]) + F.size(state["b"])) * t / PER_SECTION), F.lit(1)).cast("bigint")

        def section(y: Column) -> Column:
            cells = subtracted(sketch(y["a"], t), sketch(y["b"], t))
            return F.struct(y["a"].alias("a"), y["b"].alias("b"), let(cells, lambda c: peeled(c, t)).alias("found"))

        def sections(n: Column) -> Column:
            def of(keys: Column) -> Column:
                return F.transform(keys, lambda k: F.struct(k.alias("k"), F.pmod(F.xxhash64(k, -t), n).alias("s")))

            def some(x: Column, g: Column, wide: Column) -> Column:
                near = F.struct(*[F.filter(x[c], lambda k: F.floor(k["s"] / wide) == g).alias(c) for c in "ab"])
                return let(near, lambda y: F.transform(
                    F.sequence(g * wide, F.least((g + 1) * wide, n) - 1), lambda s: let(
                        F.struct(*[F.transform(F.filter(y[c], lambda k: k["s"] == s), lambda k: k["k"]).alias(c) for c in "ab"]), section)))

            # in groups of about as many sections as there are groups
            def grouped(x: Column) -> Column:
                return let(F.ceil(F.sqrt(n)).cast("bigint"), lambda wide: F.flatten(F.transform(
                    F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / wide)), lambda g: some(x, g, wide))))

            return let(F.struct(of(state["a"]).alias("a"), of(state["b"]).alias("b")), grouped)

        def put_together(parts: Column) -> Column:
            done = F.filter(parts, lambda p: p["found"].isNotNull())
            rest = F.filter(parts, lambda p: p["found"].isNull())
            return F.struct(F.flatten(F.transform(rest, lambda p: p["a"])).alias("a"),
                            F.flatten(F.transform(rest, lambda p: p["b"])).alias("b"),
                            F.concat(state["left"], F.flatten(F.transform(done, lambda p: p["found"]["left"]))).alias("left"),
                            F.concat(state["right"], F.flatten(F.transform(done, lambda p: p["found"]["right"]))).alias("right"))

        return F.when((F.size(state["a"]) == 0) & (F.size(state["b"]) == 0), state).otherwise(
            let(let(n, sections), put_together))

    start = F.struct(a.alias("a"), b.alias("b"), none().alias("left"), none().alias("right"))
    over = F.aggregate(F.array(*[F.lit(2 ** t) for t in range(RETRIES)]), start, attempt)
    return let(over, lambda s: F.struct(F.concat(s["left"], F.array_except(s["a"], s["b"])).alias("left"),
                                        F.concat(s["right"], F.array_except(s["b"], s["a"])).alias("right")))


def differing(pair: Column) -> Column:
    """left and right of a pair: from its fingerprints (``by_fingerprint``), or by larger sketches where that fails.

    The first step is passed over where the numbers of digests alone differ by more
    than a fingerprint has cells, as no peeling could succeed there.
    """
    first = F.when(F.abs(F.size(pair["a"]) - F.size(pair["b"])) <= CELLS,
                   let(subtracted(pair["a_cells"], pair["b_cells"]), peeled))
    found = lambda d, by: F.struct(d["left"].alias("left"), d["right"].alias("right"), F.lit(by).alias("by_fingerprint"))
    return let(first, lambda d: F.when(d.isNotNull(), found(d, True)).otherwise(
        let(enlarged(pair["a"], pair["b"]), lambda e: found(e, False))))


def likeness(pair: Column, apart: Column) -> Column:
    n = F.size(pair["a"]) + F.size(pair["b"])
    d = F.size(apart["left"]) + F.size(apart["right"])
    return F.when(n == 0, F.lit(1.0)).otherwise((n - d) / (n + d))


def as_string(keys: Column, cells: Column) -> Column:
    """The number of digests and the cells (count, check and xor) in hexadecimal; nothing for an empty cell."""
    return F.concat_ws(",", F.lower(F.hex(F.size(keys))), F.transform(cells, lambda c: F.when(
        (c["count"] == 0) & (c["key"] == 0), F.lit("")).otherwise(
            F.lower(F.concat_ws(".", F.hex(c["count"]), F.hex(c["check"]), F.hex(c["key"]))))))


def successors(keys: DataFrame) -> DataFrame:
    """(key, next) for distinct whole numbers; the largest has the smallest as its next.

    Keys meet in groups of 2**LEVEL neighbours at most. The largest of a group gets
    the smallest of the next group that isn't empty, found in the same way one
    level up, so no task orders all of them. Groups are counted from the smallest
    number there is, so they are never negative and end in a single one.
    """
    keys = written(keys)
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return keys.withColumn("next", F.col("key"))
    low, high = low + 2 ** 63, high + 2 ** 63
    levels, above = [], F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(2 ** 63))), LEVEL)
    while low != high:
        groups = written(keys.groupBy(above.alias("above")).agg(F.min("key").alias("least")))
        levels.append((keys, groups, above))
        keys = groups.select(F.col("above").alias("key"))
        low, high, above = low >> LEVEL, high >> LEVEL, F.shiftright("key", LEVEL)
    found = keys.withColumn("next", F.col("key"))  # one key: its next is itself, which closes the circle
    for keys, groups, above in reversed(levels):
        within = Window.partitionBy("above").orderBy("key")
        rows = keys.select("key", above.alias("above")).withColumn("_next", F.lead("key").over(within))
        after = found.select(F.col("key").alias("above"), "next").join(
            groups.select(F.col("above").alias("next"), "least"), "next").select("above", "least")
        found = written(rows.join(after, "above").select("key", F.coalesce("_next", "least").alias("next")))
    return found


def dealt(docs: DataFrame) -> DataFrame:
    """Rows in groups (_bucket, _part) of neighbours in the order of ids and ties.

    A crowded bucket, one whose ids many rows share, is parted by id and tie; the
    ids of other buckets are few, so their one part is 0.
    """
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = docs.select("doc_id", text_of().alias("text"), order.alias("_order"), F.xxhash64(text_of()).alias("_tie"),
                       F.shiftright(order, BUCKET).alias("_bucket"))
    crowded = written(rows.groupBy("_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select(
        "_bucket", F.lit(True).alias("_crowded")))
    if crowded.isEmpty():
        return rows.withColumn("_part", F.lit(0).cast("bigint"))
    within = F.col("_order").bitwiseAND((1 << BUCKET) - 1) * 2 ** 32 + F.shiftright("_tie", 32) + 2 ** 31
    return rows.join(F.broadcast(crowded) if crowded.count() <= CROWDED else crowded, "_bucket", "left").withColumn(
        "_part", F.when(F.col("_crowded"), within).otherwise(0).cast("bigint")).drop("_crowded")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows with ``text`` and ``next_text``, the whole text of the following document.

    Texts are dealt once to groups of neighbouring ids, in which a window looks one
    row ahead; only the first text of each group travels again, to the group before.
    """
    rows = dealt(docs)
    group = ["_bucket", "_part"]
    heads = rows.groupBy(*group).agg(F.min(F.struct("_order", "_tie")).alias("_first"))
    heads = written(heads.select(*group, "_first.*"))
    buckets = heads.groupBy("_bucket").agg(F.min("_part").alias("_least"))
    chain = successors(buckets.select(F.col("_bucket").alias("key"))).join(
        buckets.select(F.col("_bucket").alias("next"), "_least"), "next").select(
            F.col("key").alias("_bucket"), F.col("next").alias("_then"), F.col("_least").alias("_then_part"))
    later = F.lead("_part").over(Window.partitionBy("_bucket").orderBy("_part"))
    after = heads.select(*group).withColumn("_later", later).join(chain, "_bucket").select(
        *group, F.when(F.col("_later").isNull(), F.col("_then")).otherwise(F.col("_bucket")).alias("_to"),
        F.coalesce("_later", "_then_part").alias("_to_part"))
    # the first text of every group, named by the group before it
    first = rows.join(heads, [*group, "_order", "_tie"], "left_semi").dropDuplicates(group).select(
        F.col("_bucket").alias("_to"), F.col("_part").alias("_to_part"), F.col("text").alias("_head"))
    first = first.join(after, ["_to", "_to_part"]).select(*group, "_head")
    ahead = rows.withColumn("_ahead", F.lead("text").over(Window.partitionBy(*group).orderBy("_order", "_tie")))
    return ahead.join(first, group, "left").select("doc_id", "text", F.coalesce("_ahead", "_head").alias("next_text"))


def edited(text: Column, after: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def paired(keys: Column, cells: Column, grain: Column, text: Column, other: Column, other_grain: Column,
           other_keys: Column | None = None, other_cells: Column | None = None) -> Column:
    """Digests and cells (a, b, a_cells, b_cells) of two texts cut alike.

    What was made of a text by its own grain is used where that is the one wanted.
    """
    wanted = common_grain(grain, other_grain)

    def side(name: str, keys, cells, own_grain, text) -> Column:
        made = let(digests(text, wanted), lambda k: F.struct(k.alias("k"), sketch(k).alias("c")))
        both = made if keys is None else F.when(own_grain == wanted, F.struct(keys.alias("k"), cells.alias("c"))).otherwise(made)
        return both.alias(name)

    return let(F.struct(side("x", keys, cells, grain, text), side("y", other_keys, other_cells, other_grain, other)), lambda p: F.struct(
        p["x"]["k"].alias("a"), p["y"]["k"].alias("b"), p["x"]["c"].alias("a_cells"), p["y"]["c"].alias("b_cells")))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Every row with text, next_text and edited text; own and new (digests and cells of the text and the
    edited one), and the pairs to_edited and to_next with their differences edit_apart and next_apart.

    Each step is a projection of its own, worked out once.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumns({f"{n}_grain": grain_of(F.col(t)) for n, t in (("own", "text"), ("new", "edited"), ("next", "next_text"))})
    rows = rows.withColumns({f"{n}_keys": digests(F.col(t), F.col(f"{n}_grain")) for n, t in (("own", "text"), ("new", "edited"))})
    rows = rows.withColumns({f"{n}_cells": sketch(F.col(f"{n}_keys")) for n in ("own", "new")})
    own = (F.col("own_keys"), F.col("own_cells"), F.col("own_grain"), F.col("text"))
    rows = rows.withColumns({
        "to_edited": paired(*own, F.col("edited"), F.col("new_grain"), F.col("new_keys"), F.col("new_cells")),
        "to_next": paired(*own, F.col("next_text"), F.col("next_grain"))})
    return rows.withColumns({"edit_apart": differing(F.col("to_edited")), "next_apart": differing(F.col("to_next"))})


def query(spark, sf_dir):
    rows = fingerprinted(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("own_keys"), F.col("own_cells")).alias("fingerprint"),
        as_string(F.col("new_keys"), F.col("new_cells")).alias("edited_fingerprint"),
        likeness(F.col("to_edited"), F.col("edit_apart")).alias("near_edited"),
        likeness(F.col("to_next"), F.col("next_apart")).alias("near_next"))
