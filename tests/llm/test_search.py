"""Ranked search, token files and spelling variants against plain versions."""
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from parley.llm import ranked, spelling, tokenfiles
from tests.conftest import DATA
from tests.llm.conftest import CLASHES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# -- ranked search

def plain_search(docs, items, top=10):
    """The contract's formula over every document and item: rows (item_id, rank, doc_id, score)."""
    terms = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_docs, every = sum(s > 0 for s in sizes), sum(sizes)
    df, out = Counter(t for _, c in terms for t in c), []
    for item, text in items:
        scores = []
        for (d, c), n in zip(terms, sizes):
            m = 100 - 75 + 75 * n * n_docs // every if every else 1
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in TERM.findall(lower(text)) if t in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d, s))
        out += [(item, k + 1, d, s) for k, (_, _, _, d, s) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


ITEMS = [(1, "the STONE light, river-stone of 漢字 É"), (2, "garden garden music"), (3, None), (4, ""), (None, "one"),
         (5, "not-there"), (6, "changed lantern thunder; valley copper doctor planet signal engine island forest silver")]


@pytest.mark.parametrize("limit", [1 << 14, 7])
def test_search_equals_plain(spark, docs, corpus, nothing, monkeypatch, limit):
    monkeypatch.setattr(ranked, "RUN_DOCS", limit)
    monkeypatch.setattr(ranked, "AHEAD", 2)
    items = spark.createDataFrame([(*i, *range(3)) for i in ITEMS], "item_id bigint, text string, row int, rank int, score int")
    assert found(ranked.search(docs, items)) == plain_search([r[:2] for r in corpus], ITEMS)
    assert found(ranked.search(nothing, items)) == [] and found(ranked.search(docs, items.limit(0))) == []


def test_search_ties_repeats_and_missing_ids(spark):
    rows = [(k, "same words here") for k in range(30)] + [(None, "same words here")] * 2 + [(3, "same words here"), (50, "other"), (51, "x" * 10 ** 6)]
    items = [(1, "same words"), (1, "here other"), (2, "x" * 10 ** 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = found(ranked.search(df, spark.createDataFrame(items, "item_id bigint, text string")))
    assert got == plain_search(rows, items)


def test_blocks_of_items_make_no_difference(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    want = found(ranked.search(docs, items))
    monkeypatch.setattr(ranked, "ITEMS", 2)
    assert found(ranked.search(docs, items)) == want


def test_intervals_read_less_than_all():
    """Reading ends early where the best are far ahead, with the same result as reading everything."""
    rng = np.random.default_rng(4)
    n, size = 20000, 6
    terms = np.concatenate([np.full(n // (k + 1), k) for k in range(size)])
    docs = np.concatenate([rng.permutation(n)[:n // (k + 1)] for k in range(size)])
    times = rng.zipf(1.6, len(docs)).clip(max=50).astype(np.int64)
    lists = ranked.Lists(rng.integers(20, 2000, n), terms, docs, times, n, n * 1000, size)
    factors = [(k, 1000 * (k + 1)) for k in range(size)]
    whole = np.zeros(n, np.int64)
    for t, f in factors:
        part = slice(*lists.bounds[t:t + 2])
        whole[lists.docs[part]] += lists.impact[part] * f
    want = np.lexsort((np.arange(n), -whole))[:10]
    found, scores = lists.best(factors, 10, np.arange(n))
    assert found.tolist() == want.tolist() and scores.tolist() == whole[want].tolist()


# -- token files

@pytest.mark.parametrize("n, top", [(0, 5), (1, 0), (1, 10 ** 12), (1000, 1000), (3000, 2 ** 40), (700, 2 ** 64 - 1)])
def test_sequences(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n, dtype=np.uint64, endpoint=True))
    data = tokenfiles.fano(values, top + 1)
    f = tokenfiles.Fano(data)
    assert f.all().tolist() == values.tolist() == [f[k] for k in range(n)] and len(f) == n
    if n > 500:  # close to the least space that n ascending numbers need
        assert len(data) * 8 <= n * (2 + max(math.log2(top / n), 0) + 1) + 32 * (n / tokenfiles.SAMPLE + 1) + 300
    with pytest.raises(IndexError):
        f[n]


def encoder(name="byte_bpe_50k.json"):
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return tokenfiles.Encoder(f.read(), public_tokenizers.PATTERN)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, corpus):
    rng, letters = random.Random(2), "ab Z.,'\n\t\x1e\x85\xa0 é漢　1２-sllß<|endoftext|>́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a's b'll c'x", "x <|endoftext|> y", "a\nb", "a \nb", *(r[1] for r in corpus if r[1])]
    e = encoder(name)
    ids, n = e(pa.array(texts))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert e(pa.array([], pa.string()))[0].tolist() == []


def plain_rows(rows):
    e, at, out = encoder(), 0, []
    for d, t in rows:
        ids = e.tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    return out


def test_token_files_equal_plain(spark, docs, corpus, nothing, tmp_path):
    manifest = tokenfiles.write_tokens(docs, str(tmp_path / "ids"))
    rows = sorted(((r[0], r[1]) for r in corpus), key=lambda r: r[0])
    got = sorted(map(tuple, tokenfiles.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert got == plain_rows(rows)  # the repeated rows of an id are alike
    files = [tokenfiles.TokenFile(r.path) for r in manifest.orderBy("part").collect()]
    assert sum(map(len, files)) == len(corpus)
    for f in files:
        whole = f.span(0, f.n_ids).tolist()
        for k in range(len(f)):
            ids = f.ids(k).tolist()
            assert ids == whole[f.start(k):f.start(k) + len(ids)] and ids[-1] == 2 and f.doc_id(k) == f.doc_ids()[k]
        f.close()
    empty = tokenfiles.write_tokens(nothing, str(tmp_path / "none"))
    assert empty.count() == 0 and tokenfiles.read_tokens(empty).collect() == []


def test_token_files_of_missing_and_negative_ids(spark, tmp_path):
    rows = [(None, "first"), (None, "first"), (-2 ** 63, "least"), (-5, None), (2 ** 63 - 1, "largest"), (7, "a"), (7, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(map(tuple, tokenfiles.read_tokens(tokenfiles.write_tokens(df, f"file://{tmp_path}/x")).collect()), key=lambda r: r[1])
    assert got == plain_rows([(None, "first"), (None, "first"), (-2 ** 63, "least"), (-5, ""), (7, "a"), (7, "a"), (2 ** 63 - 1, "largest")])


def test_token_files_without_ids_fill_several_ranges(spark, tmp_path):
    """Rows without an id are dealt to ranges like others, and a file left by a failed task isn't read."""
    df = spark.createDataFrame([(None, f"text number {k}") for k in range(400)], "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = tokenfiles.write_tokens(df, str(tmp_path / "y"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (tmp_path / "y" / "part-000000-left.ids").write_bytes(b"half a file")
    rows = sorted(map(tuple, tokenfiles.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert manifest.count() > 2 and len(rows) == 400 and Counter(r[3] for r in rows) == Counter(
        r[3] for r in plain_rows([(None, f"text number {k}") for k in range(400)]))
    assert [r[1] for r in rows[1:]] == [r[1] + r[2] for r in rows[:-1]]


# -- spelling variants

def plain_words(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(t)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(n):
    out, form = {}, {}
    for w, k in n.items():
        others = sorted((-n[x], x) for x in n if near(w, x))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * k else None
        out[w] = (k, len(others), n[form[w]] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def variants(df):
    rows = spelling.variants(df).collect()
    made = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(made) == len(rows)
    return made


def test_variants_equal_plain(spark, docs, corpus, nothing):
    assert variants(docs) == plain_variants(plain_words([r[:2] for r in corpus]))
    assert variants(nothing) == {}


def test_variants_of_random_words(spark):
    """Runs of equal letters, letters beyond ASCII, deep nodes, chains of forms and missing ids."""
    rng, rows = random.Random(7), []
    words = ["".join(rng.choice("abÿ") for _ in range(rng.randint(4, 14))) for _ in range(250)]
    for w in list(words):
        k = rng.randrange(len(w))
        words += [w[:k] + w[k + 1:], w[:k] + "c" + w[k:], w[:k] + "é" + w[k + 1:], w[:k] + w[k] + w[k:]]
    for d in range(60):
        picked = [w for w in words for _ in range(rng.choice([0, 0, 1, 3]))]
        rows.append((None if d % 10 == 0 else d, " ".join(picked)))
    rows += [(1000, None), (1001, ""), (1002, "AbĀcdefgh ABCDE×÷ abcde×÷ abcde×÷")]
    df = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], "doc_id bigint, text string, " + ", ".join(f"{c} int" for c in CLASHES))
    got = variants(df.repartition(6))
    want = plain_variants(plain_words(rows))
    assert got == want and max(len(w) for w in want) > 10 and any(v[0] and v[0] != v[1] for v in want.values())


def test_one_word_in_a_third_of_all_rows_and_a_very_long_one(spark):
    long = "abcdefghij" * 3000
    rows = [(d, "frequent frequemt") for d in range(400)] + [(1000 + d, long) for d in range(4)] + [(2000 + d, long + "x") for d in range(9)]
    got = variants(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    words = plain_words(rows)
    assert {w: v[2] for w, v in got.items()} == words
    assert got[long][0] == long + "x" and got[long + "x"][3] == 1


def test_groups_of_pairs_are_bounded(spark):
    """However many words there are, a pair of nodes has at most one word for each letter."""
    words = spark.createDataFrame([(k, w) for k, w in enumerate(sorted({f"stem{a}{b}" for a in "abcdefgh" for b in "ijklmnop"}))], "word_id bigint, word string")
    sizes = defaultdict(int)
    for r in spelling.places(words).collect():
        sizes[r.before, r.behind] += r.what != spelling.CUT
    assert max(sizes.values()) == 8


def test_queries_return_the_columns_of_the_contract(spark):
    want = {"op11": ["item_id", "rank", "doc_id", "score"], "op12": ["doc_id", "start", "n_tokens", "ids_crc32"],
            "op13": ["word", "form", "root", "n", "n_near", "form_n"]}
    rows = {k: q(spark, DATA) for k, q in (("op11", ranked.query), ("op12", tokenfiles.query), ("op13", spelling.query))}
    assert {k: df.columns for k, df in rows.items()} == want
    documents = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    got = sorted(map(tuple, rows["op12"].collect()), key=lambda r: r[1])
    assert got == plain_rows(sorted((r.doc_id, r.text) for r in documents))
