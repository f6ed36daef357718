"""Quality rules, near-duplicates, surrogates and the pipeline against plain versions."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from parley.llm import mixing, neardup, queries, rules, surrogates
from tests.conftest import DATA
from tests.llm.conftest import CLASHES, WORDS, prose
from tests.llm.test_native import plain_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    text, ok = compare(spark, connect(DATA), DATA, name, queries.queries()[name], queries.oracle_sql()[name])
    assert ok, text


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_groups(corpus, size=2, limit=80):
    sets = {}
    for d, t, *_ in corpus:
        w = WORD.findall(lower(t))
        sets[d] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= limit * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def groups(df, **more):
    return {r.id: (r.n_shingles, r.component) for r in neardup.grouped(df, **more).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_plain(docs, corpus, size):
    assert groups(docs, words=size) == plain_groups(corpus, size)
    stay = [r.doc_id for r in neardup.survivors(docs, words=size).collect()]
    assert sorted(stay) == sorted(d for d, (_, c) in plain_groups(corpus, size).items() if d == c)
    assert neardup.survivors(docs).columns == docs.columns


def test_near_duplicates_of_families_near_the_limit(spark):
    """Copies of several originals with so many edits that many pairs of copies fall below the limit."""
    rng, corpus = random.Random(8), []
    for _ in range(4):
        words = prose(rng, 150).split()
        for _ in range(60):
            own = list(words)
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = rng.choice(WORDS) + str(rng.randint(0, 9))
            corpus.append((len(corpus), " ".join(own), None, None, 0))
    rng.shuffle(corpus)
    df = spark.createDataFrame(corpus, SCHEMA)
    want = plain_groups(corpus)
    assert 4 < len({c for _, c in want.values()}) < 200
    assert groups(df) == want


def test_near_duplicates_of_a_drifting_chain(spark):
    """Each text is near the next one only: one component across many steps."""
    rng = random.Random(2)
    words, corpus = prose(rng, 100).split(), []
    for k in range(40):
        corpus.append((k, " ".join(words), None, None, 0))
        for _ in range(4):
            words[rng.randrange(100)] = f"w{rng.randint(0, 999)}"
    assert groups(spark.createDataFrame(corpus, SCHEMA)) == plain_groups(corpus)


def test_near_duplicates_edges(spark, nothing):
    assert groups(nothing) == {} and neardup.survivors(nothing).collect() == []
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "x y z"), (5, ""), (None, ""), (6, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.id, r.component) for r in neardup.grouped(df).collect())
    no = neardup.NO_ID
    assert got == Counter({(no, no): 2, (4, no): 1, (4, 4): 1, (5, 5): 1, (6, 6): 1}) or got == Counter(
        {(no, no): 2, (4, no): 2, (5, 5): 1, (6, 6): 1})


def test_estimate_follows_similarity(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    other = [w if rng.random() < 0.93 else f"v{k}" for k, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id bigint, text string")
    rows = neardup.sketched(df).select("id", F.struct(*neardup.SIGNATURE).alias("s"))
    a, b = rows.where("id = 1").select(F.col("s").alias("a")), rows.where("id = 2").select(F.col("s").alias("b"))
    got = a.join(b, F.lit(True)).select(neardup.estimate("a", "b").alias("x")).first().x
    x, y = ({tuple(t[k:k + 2]) for k in range(399)} for t in (words, other))
    assert abs(got - 100 * len(x & y) / len(x | y)) < 12


def test_maps_bound_what_sets_have_in_common(spark):
    """The bound is never below the truth, and close to it for sets of a few hundred shingles."""
    rng, rows, sets = random.Random(9), [], []
    for k in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 30, 150, 900, 2000]) if k % 2 else 150)]
        rows.append((k, " ".join(words)))
        sets.append({tuple(words[j:j + 2]) for j in range(len(words) - 1)})
    s = neardup.sketched(spark.createDataFrame(rows, "doc_id bigint, text string")).select(
        "id", F.struct(F.col("n_shingles").alias("n"), *neardup.SIGNATURE, *neardup.MAP).alias("s"))
    a, b = (s.select(F.col("id").alias(f"id_{x}"), F.col("s").alias(x)) for x in "ab")
    got = a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", neardup.most_common("a", "b").alias("most")).collect()
    assert len(got) == 780
    for r in got:
        x, y = sets[r.id_a], sets[r.id_b]
        assert r.most >= len(x & y)
        if len(x) == len(y) == 149:
            assert r.most <= len(x & y) + 30


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for p in links if p[0] != p[1] for x in p}
    got = dict(map(tuple, neardup.smallest_labels(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == want


def test_repeated_words():
    rng = random.Random(1)
    for _ in range(40):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        seen = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        want = {k + j for k in range(len(words) - 7) if seen[tuple(words[k:k + 8])] > 1 for j in range(8)}
        assert rules.repeated(words) == len(want)


def test_rules_reject_depleted_documents_only(spark, docs, corpus, nothing):
    rng = random.Random(4)
    menu = "home page news sport weather contact imprint privacy search login basket help"
    rows = [(k, "\n".join([menu] * 3 + [f"only {WORDS[k]} words left"]), None, "host", 0) for k in range(30)]
    rows += [(400 + k, "\n".join([menu] * 3 + [f"only {k} words left"]), None, "numbers", 0) for k in range(30)]  # one line, numbers aside
    rows += [(100 + k, menu + "\n" + prose(rng, 60), None, "host", 0) for k in range(10)]
    rows += [(200 + k, menu + "\nfive more words stand here " * 4, None, "other", 0) for k in range(5)]
    copy = prose(rng, 80)
    rows += [(300 + k, copy, None, "host", 0) for k in range(40)]
    got = {r.doc_id: r for r in rules.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[k].kept for k in range(30)) and all(got[k].kept for k in range(100, 110))
    assert all(got[k].kept for k in range(300, 340)) and got[5].n_boilerplate == 36
    assert all(got[k].n_boilerplate == 40 for k in range(400, 430))
    assert Counter(r.doc_id for r in rules.judged(docs).collect()) == Counter(d for d, *_ in corpus)
    assert rules.judged(nothing).collect() == []


def test_surrogates_keep_type_format_and_identity(spark, docs, corpus, nothing):
    text = ("Mail Ann.Lee42@Mail.example.org or ann.lee42@mail.example.org, call +1 (017) 555-7713, card 4111 1111 1111 1111, "
            "host 97.51.17.173. Frau Müller met Mr Smith. Müller left, Smith stayed. Herr SCHULZ; господин Иванов.")
    made, counts = surrogates.replaced(text, b"k", {})
    assert counts == [2, 1, 1, 1, 6]
    for private in ("Ann", "ann.lee", "555-7713", "4111", "97.51", "Müller", "Smith", "SCHULZ", "Иванов"):
        assert private not in made
    m = re.search(r"Mail (\S+) or (\S+), call (\+1 \(\d{3}\) \d{3}-\d{4}), card (\d{4} \d{4} \d{4} \d{4}), host (\S+)\. Frau (\w+) "
                  r"met Mr (\w+)\. (\w+) left, (\w+) stayed\. Herr ([A-Z]+); господин ([А-Я][а-я]+)\.$", made)
    assert m and m[1].lower() == m[2] and m[6] == m[8] and m[7] == m[9] and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d\d@mail\d+\.example\.com", m[1])
    assert surrogates.luhn(m[4].replace(" ", "")) and all(int(x) < 256 for x in m[5].split("."))
    assert surrogates.replaced(text, b"k", {})[0] == made != surrogates.replaced(text, b"other", {})[0]
    assert surrogates.replaced("Nothing private here.", b"k", {}) == ("Nothing private here.", [0] * 5)
    got = surrogates.pseudonymised(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in corpus)
    assert surrogates.pseudonymised(nothing).collect() == []


@pytest.mark.parametrize("private", ["a@b.org", "8.8.8.8", "97.51.17.173", "4111 1111 1111 1111", "+1 (017) 555-7713", "(017) 555-7713", "017-555-7713", "Smith"])
def test_each_pattern_alone_in_a_text(private):
    before = "Mr " if private == "Smith" else "dns at "
    made, counts = surrogates.replaced(f"{before}{private} now", b"k", {})
    assert private not in made and sum(counts) == 1


def test_numbers_have_distinct_surrogates():
    cards = [f"{k:016d}" for k in range(3000)]
    assert len({surrogates.card(b"k", c) for c in cards}) == len(cards)
    assert len({surrogates.ip(b"k", f"10.0.{k // 256}.{k % 256}") for k in range(3000)}) == 3000
    assert len({surrogates.permuted(b"k", "phone", k, 3) for k in range(1000)}) == 1000


def test_colliding_names_draw_again(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "SYLLABLES", {"latin": ("ba", "den"), "cyrillic": ("ба",)})  # 32 family names
    names = [f"Herr Name{chr(97 + k)}{chr(97 + k)}" for k in range(14)]
    names = [re.sub(r"\d", "", n) for n in names] + ["Frau Babababababa", "Mr Babababaden"]
    df = spark.createDataFrame([(k, f"Here is {n} again.") for k, n in enumerate(names)], "doc_id bigint, text string")
    rows = surrogates.pseudonymised(df).collect()
    used = [re.search(r"(\w+) again", r.text)[1].lower() for r in rows]
    assert len(set(used)) == len(names) and not set(used) & {n.split()[-1].lower() for n in names}


def test_whole_names_are_replaced_and_stay_distinct(spark):
    made, counts = surrogates.replaced("Mr John Smith came. John Smith left, then John. Smith and Mr John Smith. Ms Mary Ann Lee, Mary Ann Lee.", b"k", {})
    assert not re.search("John|Smith|Mary|Ann|Lee", made) and counts == [0, 0, 0, 0, 7]
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. \1 \2 left, then \1\. \2 and Mr \1 \2\. Ms (\w+) (\w+) (\w+), \3 \4 \5\.", made)
    assert m and m[3] != m[4]
    firsts = ["John", "James", "Peter", "Bruno", *(f"Given{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(6))]
    df = spark.createDataFrame([(k, f"Mr {n} Smith here") for k, n in enumerate(firsts)], "doc_id bigint, text string")
    used = [re.fullmatch(r"Mr (\w+) (\w+) here", r.text).groups() for r in surrogates.pseudonymised(df).collect()]
    assert len(set(used)) == len(firsts) and len({f for _, f in used}) == 1 and "Bruno" not in {g for g, _ in used}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    previous, first = docs, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, previous, DATA)
        assert made.columns == docs.columns and dict(made.dtypes) == dict(docs.dtypes), name
        rows, before = [r.asDict() for r in made.collect()], [r.asDict() for r in previous.collect()]
        ids = {r["doc_id"] for r in before}
        assert rows and {r["doc_id"] for r in rows} <= ids
        if name == "quality classifier":
            stay = {r["doc_id"] for r in rows}
            assert sum(q == 1 and d not in stay for d, q in labels.items() if d in first) <= 2
        if name == "line dedup":
            assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
            holders = defaultdict(set)
            for r in rows:
                for x in (r["text"] or "").split("\n"):
                    holders[lower(x.strip(" \t\n\x0b\x0c\r"))].add(r["doc_id"])
            assert all(len(h) < 3 for x, h in holders.items() if len(x) >= 20)
        if name == "MinHash near-dedup":
            want = plain_groups([tuple(r.values()) for r in before], 5)
            assert sorted(r["doc_id"] for r in rows) == sorted(d for d, (_, c) in want.items() if d == c)
        if name == "source mix":
            size = lambda r: len(WORD.findall(r["text"] or ""))
            own, words, most = Counter(), Counter(), Counter()
            for r in before:
                own[r["source"]] += size(r)
                most[r["source"]] = max(most[r["source"]], size(r))
            for r in rows:
                words[r["source"]] += size(r)
            for s, target in plain_targets(own).items():  # the words of a source miss its target by two of its documents at most
                assert abs(words[s] - target) <= 2 * most[s] + 3 * mixing.BLOCK, (s, words[s], target)
            held = Counter(r["doc_id"] for r in before)
            assert all(n <= 3 * held[d] for d, n in Counter(r["doc_id"] for r in rows).items())
        previous = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, previous, DATA)
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, last.collect()))


def test_pipeline_stages_with_odd_rows(spark, docs, corpus, nothing):
    """Missing and very long texts, repeated rows, an empty table and clashing columns, which every stage keeps."""
    kinds, numbers = dict(docs.dtypes), dict(zip(CLASHES, range(len(CLASHES))))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        made = stage(spark, docs, DATA)
        assert made.columns == docs.columns and dict(made.dtypes) == kinds, name
        rows = made.collect()
        assert rows and {r.doc_id for r in rows} <= {r[0] for r in corpus}, name
        assert all(r[c] == k for r in rows for c, k in numbers.items()), name
        assert stage(spark, nothing, DATA).collect() == []
    texts = {r[0]: r[1] or "" for r in corpus}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in last) == Counter(r[0] for r in corpus)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in last)


def test_sieve_passes_every_wanted_text(docs):
    rows = neardup.identified(docs)
    wanted = rows.select("id", "text_key").distinct().where("id % 3 = 0")
    bit = F.pmod(F.xxhash64("id", "text_key"), F.lit(neardup.SIEVE)).alias("bit")
    cells = neardup.sieve_of(wanted)
    inside = lambda df: [int(cells[r.bit >> 5]) >> (r.bit & 31) & 1 for r in df.select(bit).collect()]
    assert min(inside(wanted)) == 1 and sum(inside(rows.where("id % 3 <> 0"))) == 0
    classes = wanted.withColumnRenamed("id", "node")
    got = {r.node: zlib.decompress(r.text).decode() for r in neardup.texts_of(docs, classes).collect()}
    assert got == {r.id: r["_text"] for r in rows.where("id % 3 = 0").collect()}
    assert not neardup.sieve_of(wanted.limit(0)).any()
