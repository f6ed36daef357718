"""Line dedup, source mix and fingerprints against plain versions."""
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import fingerprints as fp
from parley.llm import linededup, mixing
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def plain_line_dedup(corpus):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(SPACE))
    holders = defaultdict(set)
    for d, t, *_ in corpus:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    out = []
    for d, t, *_ in corpus:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or d == max(holders[key(x)])]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def digests(df):
    made = linededup.deduplicated(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
    return sorted(map(tuple, made.collect()))


def test_line_dedup_equals_plain(docs, corpus):
    assert digests(docs) == plain_line_dedup(corpus)


@pytest.mark.parametrize("partitions", [1, 40])
def test_line_dedup_spreads_one_frequent_line(spark, partitions):
    """A line in every document spans all ranges; the largest id keeps it, twice where it stands twice."""
    line = "this line of text is found in every document"
    corpus = [(d, f"{line}\nown line of document number {d}\n{line}", None, None, 0) for d in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        assert digests(df) == plain_line_dedup(corpus)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_line_dedup_without_ids_and_shared_ids(spark):
    line = "a line that is long enough to count here"
    rows = [(None, line), (None, line + "\nx"), (1, line), (1, "y\n" + line), (2, line)]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_dropped) for r in got) == [(0, 1), (0, 1), (1, 1), (1, 1), (2, 0)]


def test_empty_tables(nothing):
    assert digests(nothing) == []
    assert mixing.taken_words(nothing).collect() == []
    assert mixing.mix(nothing).collect() == []
    assert mixing.mixed_documents(nothing).collect() == []
    assert fp.fingerprinted(nothing).collect() == []


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1.0 for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    rest = float(total)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        free -= over
    return target


def test_source_mix_meets_targets(docs, corpus):
    sizes = Counter()
    for _, t, _, source, _ in corpus:
        sizes[source] += len(WORD.findall(t or ""))
    target = plain_targets(sizes)
    got = mixing.taken_words(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in corpus)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3 * mixing.BLOCK
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert sorted(map(key, mixing.taken_words(docs.repartition(3)).collect())) == sorted(map(key, got))


def test_mix_slots_are_the_taken_words(docs):
    rows = mixing.mix(docs).collect()
    by_slot = defaultdict(int)
    for r in rows:
        by_slot[r.shard, r.position] += r.words
    assert len(by_slot) == max(p for _, p in by_slot) + 1 and max(by_slot.values()) == mixing.BLOCK
    taken = mixing.taken_words(docs).agg(F.sum("taken")).first()[0]
    assert sum(by_slot.values()) == taken


def test_mixed_documents_keep_columns(docs):
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    per = Counter(r.doc_id for r in made.collect())
    assert max(per.values()) <= 6 and set(per) <= {r.doc_id for r in docs.collect()}  # two equal rows, three times each


def test_mixed_documents_meet_targets(spark):
    """Long documents of a source with a share below a half stay in the mix, and words follow the targets."""
    rng = random.Random(12)
    sizes = {"a": [rng.randint(300, 900) for _ in range(400)], "b": [rng.randint(1, 400) for _ in range(300)], "c": [rng.randint(1, 50) for _ in range(200)]}
    rows = [(s, " ".join(["word"] * n)) for s, of in sizes.items() for n in of]
    df = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    target = plain_targets({s: sum(of) for s, of in sizes.items()})
    assert target["a"] < 0.5 * sum(sizes["a"])
    words = Counter()
    for r in mixing.mixed_documents(df).collect():
        words[r.source] += len(WORD.findall(r.text))
    for s, of in sizes.items():
        assert abs(words[s] - target[s]) <= 2 * max(of) + 3 * mixing.BLOCK, (s, words[s], target[s])


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_permutation_is_one_to_one(spark, size):
    df = spark.range(size).select(mixing.permuted(F.col("id"), F.lit(size), F.lit(9)).alias("x"))
    assert sorted(r.x for r in df.collect()) == list(range(size))


@pytest.mark.parametrize("more", [[], [-2 ** 63], [-2 ** 63, 2 ** 63 - 1], [-2 ** 58, -1, -40]])
def test_successors(spark, more):
    rng = random.Random(1)
    keys = sorted({0, -5, 2 ** 40, *(rng.randrange(-3000, 10 ** 7) for _ in range(500)), *range(2000), *more})
    got = dict(map(tuple, fp.successors(spark.createDataFrame([(k,) for k in keys], "key bigint")).collect()))
    assert got == dict(zip(keys, keys[1:] + keys[:1]))


def spark_hash(values, seed=42):
    """xxhash64 of Spark over several values: strings, 32- and 64-bit numbers, one after the other."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2 ** 64 if seed >= 2 ** 63 else seed


def plain_grain(text):
    size = len(text.encode())
    return 2 * max(0, math.ceil(math.log2(max(size, 1) / fp.LEAF))) + (text.count(" ") * fp.BLANKS < size)


def plain_digests(text, grain):
    """Pieces, their hashes and numbers, by a loop over the tokens."""
    cut = fp.CUT.replace("\\x{2E80}", "\u2e80").replace("\\x{10FFFF}", "\U0010ffff")
    blank = r"[ \t\n\x0b\f\r]"
    token = rf"[^ \t\n\x0b\f\r{cut}]+(?:[{cut}]{blank}*|{blank}*)|[{cut}]{blank}*|{blank}+"
    tokens = re.findall(token, text) if grain & 1 else text.split(" ")
    every, piece, made = fp.EVERY << (grain >> 1), [], Counter()
    for k, t in enumerate(tokens):
        piece.append(t)
        ends = (spark_hash([t, (fp.SEED, 4)]) & (every - 1)) == 0 or k + 1 == len(tokens)
        if ends or len(piece) == every:
            made[spark_hash(piece)] += 1
            piece = []
    return {spark_hash([(h, 8), (n, 4)]) for h, n in made.items()}


def plain_likeness(x, y):
    a, b = plain_grain(x), plain_grain(y)
    grain = max(a >> 1, b >> 1) * 2 + ((a | b) & 1)
    p, q = plain_digests(x, grain), plain_digests(y, grain)
    n, d = len(p) + len(q), len(p ^ q)
    return (n - d) / (n + d) if n else 1.0


def plain_fingerprint_rows(corpus):
    """Every row of the contract but the fingerprints, for rows in the order of ids and of text hashes."""
    rows = sorted(((-2 ** 63 if r[0] is None else r[0], spark_hash([r[1] or ""]), r[0], r[1] or "") for r in corpus), key=lambda r: r[:2])
    out = []
    for (_, _, d, text), (_, _, _, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_likeness(text, edited), plain_likeness(text, after)))
    return sorted(out, key=repr)


def made_rows(df):
    return df.select("doc_id", F.char_length("text").alias("n"), F.sha2("edited", 256), fp.likeness(F.col("to_edited"), F.col("edit_apart")),
                     fp.likeness(F.col("to_next"), F.col("next_apart")), "edit_apart", "next_apart", "to_edited", "to_next",
                     fp.as_string(F.col("own_keys"), F.col("own_cells")).alias("f"), "text").collect()


def test_fingerprints_equal_plain(docs, corpus):
    rows = made_rows(fp.fingerprinted(docs))
    got = sorted(((r.doc_id, r.n, r[2], r[3], r[4]) for r in rows), key=repr)
    want = plain_fingerprint_rows(corpus)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(math.isclose(x, y, abs_tol=1e-12) for g, w in zip(got, want) for x, y in zip(g[3:], w[3:]))
    for r in rows:
        for pair, apart in ((r.to_edited, r.edit_apart), (r.to_next, r.next_apart)):
            assert sorted(apart.left) == sorted(set(pair.a) - set(pair.b)) and sorted(apart.right) == sorted(set(pair.b) - set(pair.a))
    assert sum(r.edit_apart.by_fingerprint for r in rows) >= 0.9 * len(rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text].add(r.f)
    assert all(len(f) == 1 for f in by_text.values()) and len(set.union(*by_text.values())) == len(by_text)


def test_fingerprints_without_and_with_shared_ids(spark, monkeypatch):
    """Missing, negative and shared ids, in groups that are crowded and dealt out further."""
    monkeypatch.setattr(fp, "CROWDED", 20)
    rng = random.Random(3)
    rows = [(rng.choice([None, None, 7, 7, 9, -3, -2 ** 63 + 5, 2 ** 62, k]), prose(rng, rng.randint(0, 30))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = plain_fingerprint_rows(rows)
    got = sorted(((r.doc_id, r.n, r[2], r[3], r[4]) for r in made_rows(fp.fingerprinted(df))), key=repr)
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_fingerprints_of_very_long_texts(spark):
    """Texts of some megabytes, with many pieces too, end soon: sketches are enlarged in parts."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(400000)]
    ender = next(w for w in (f"v{k}" for k in range(10 ** 6)) if spark_hash([w, (fp.SEED, 4)]) & ((1 << 18) - 1) == 0)
    often = " ".join(f"{w} {ender}" for w in words[:20000])
    df = spark.createDataFrame([(1, " ".join(words)), (2, often), (3, "x" * 3000000)], "doc_id bigint, text string")
    started = time.time()
    rows = {r.doc_id: r for r in made_rows(fp.fingerprinted(df))}
    assert time.time() - started < 100
    assert len(rows[2].to_edited.a) > 15000 and not rows[2].edit_apart.by_fingerprint
    for r in rows.values():
        assert sorted(r.edit_apart.left) == sorted(set(r.to_edited.a) - set(r.to_edited.b))


def test_sketches_recover_differences(spark):
    """Peeling finds the differences of most pairs with up to 20 of them, and never a wrong one."""
    rng = random.Random(8)
    rows = []
    for k in range(400):
        both = [rng.randrange(2 ** 62) for _ in range(30)]
        rows.append((both + [rng.randrange(2 ** 62) for _ in range(k % 11)], both + [rng.randrange(2 ** 62) for _ in range(k % 10)]))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>")
    cells = df.withColumns({"x": fp.sketch(F.col("a")), "y": fp.sketch(F.col("b"))})
    got = cells.select("a", "b", fp.peeled(fp.subtracted(F.col("x"), F.col("y"))).alias("d"), fp.enlarged(F.col("a"), F.col("b")).alias("e")).collect()
    for r in got:
        want = sorted(set(r.a) - set(r.b)), sorted(set(r.b) - set(r.a))
        assert (sorted(r.e.left), sorted(r.e.right)) == want and (r.d is None or (sorted(r.d.left), sorted(r.d.right)) == want)
    assert sum(r.d is not None for r in got) > 0.93 * len(got)


def test_half_equal_texts_share_digests_at_every_length(spark):
    rng = random.Random(9)
    rows = []
    for n in (20, 40, 80, 160, 300, 600):
        for blank in (" ", "漢"):
            half, one, other = (blank.join("".join(rng.choice("abcdefghio") for _ in range(5)) for _ in range(n // 2)) for _ in range(3))
            rows += [(half + blank + one, half + blank + other), (one + blank + half, "moved by this " + one[7:] + blank + half)]
    rows += [("".join(rng.choice("漢字文化日本語") for _ in range(200)) + e, "") for e in ("", "x")]
    passage = "one passage of eight words that stands twice "
    rows.append((passage * 2 + rows[4][0], rows[4][0]))  # repeats on one side only
    df = spark.createDataFrame(rows, "a string, b string").withColumn("g", fp.common_grain(fp.grain_of(F.col("a")), fp.grain_of(F.col("b"))))
    df = df.select("a", "b", "g", fp.digests(F.col("a"), F.col("g")).alias("x"), fp.digests(F.col("b"), F.col("g")).alias("y"),
                   fp.tokens_of(F.col("a"), F.col("g")).alias("t"))
    for r in df.collect():
        assert ("" if r.g & 1 else " ").join(r.t) == r.a and len(set(r.x)) == len(r.x)
        assert set(r.x) == plain_digests(r.a, r.g)
        assert not r.b or len(r.t) < 40 or set(r.x) & set(r.y), r.a
        assert not r.b or r.a[:10] != r.b[:10] or set(r.x) & set(r.y), r.a


def test_cells_of_very_many_digests(spark):
    keys = F.transform(F.sequence(F.lit(1), F.lit(150000)), lambda k: F.xxhash64(k))
    made = spark.range(1).select(keys.alias("k")).select(fp.sketch(F.col("k")).alias("c")).first().c
    assert sum(c["count"] for c in made) == 3 * 150000 and len(made) == fp.CELLS


def test_native_queries_have_no_python(docs):
    for df in (mixing.taken_words(docs), fp.fingerprinted(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
