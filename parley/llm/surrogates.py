"""Personal data replaced by surrogates of the same type, gender, script and format.

Found are e-mail addresses, telephone numbers, card numbers, IPv4 addresses and names
after a title. A surrogate follows from a key and the entity alone, so one entity
gets one surrogate in all documents, however it is written, and nothing of it is
kept. Numbers are permuted by a keyed Feistel network over their own digits, which
never maps two to one; what it leaves at itself is mapped on. E-mail addresses and
the words of names are drawn, and may collide: the distinct addresses, family names
and given names of all documents are checked by Spark for surrogates that two of
them share or that are an entity themselves; all but one of them draw again until
none is left. As no two words share a surrogate, no two whole names do.

* Missing texts count as empty. Rows are independent of each other but for the check.
* Formats stay: digits for digits, case and length in addresses, country codes,
  valid check digits of cards. Names stay in their script and the gender of the title.
* Without entities the text is returned as it is.
"""
from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import kept, slices, text_of

KEY = b"parley surrogates"
ATTEMPTS = 20
# fixed values: titles by gender, and given names of the surrogates by script and gender
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"),
          "": ("Dr", "Prof")}
GIVEN = {("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Karl", "Leo", "Max", "Oscar", "Paul"),
         ("latin", "f"): ("Alma", "Berta", "Clara", "Diana", "Elsa", "Flora", "Hanna", "Julia", "Lena", "Maria", "Olga", "Paula"),
         ("cyrillic", "m"): ("Антон", "Борис", "Денис", "Иван", "Олег", "Павел"),
         ("cyrillic", "f"): ("Алла", "Вера", "Дарья", "Инна", "Ольга", "Полина")}
SYLLABLES = {"latin": ("ba", "den", "fel", "gor", "hal", "kin", "lor", "man", "nes", "per", "rin", "sol", "tam", "ver", "wes", "zan"),
             "cyrillic": ("ба", "ден", "фел", "гор", "кин", "лор", "ман", "нес", "пер", "рин", "сол", "там", "вер", "зан", "мир", "ток")}

EMAIL = r"(?P<email>[A-Za-z0-9._%+\-À-ɏ]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})"
IP = r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
CARD = r"(?P<card>(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d))"
PHONE = r"(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<!\d)\d{3}[-.]\d{3}[-.]\d{4}(?!\d))"
NAME = r"\b(?P<title>%s)\.? (?P<name>[^\W\d_a-zа-я][^\W\d_]+(?: [^\W\d_a-zа-я][^\W\d_]+)*)" % "|".join(t for g in TITLES.values() for t in g)
ENTITY = re.compile("|".join((EMAIL, IP, CARD, PHONE, NAME)))
HINT = re.compile(r"@|\d\d|\d\.\d|\b(?:%s)\.? " % "|".join(t for g in TITLES.values() for t in g))
KINDS = ("email", "phone", "card", "ip", "name")


def drawn(key: bytes, *parts) -> int:
    """A large keyed number that follows from the parts."""
    return int.from_bytes(hmac.new(key, "\x00".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def permuted(key: bytes, kind: str, number: int, digits: int) -> int:
    """A keyed one-to-one map of the numbers below 10**digits (Feistel over the two halves)."""
    low = 10 ** (digits // 2)
    high = 10 ** (digits - digits // 2)
    a, b = divmod(number, low)
    for r in range(10):
        if r % 2:
            b = (b + drawn(key, kind, digits, r, a)) % low
        else:
            a = (a + drawn(key, kind, digits, r, b)) % high
    return a * low + b


def luhn(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def number_surrogate(key: bytes, kind: str, digits: str, allowed) -> str:
    """Other digits of the same length for which ``allowed`` holds, as it does for these: the map is walked until it does."""
    now = digits
    while True:
        now = str(permuted(key, kind, int(now), len(digits))).zfill(len(digits))
        if allowed(now):
            return now


def in_format(text: str, digits: str) -> str:
    """``text`` with its last digits replaced."""
    out, left = [], list(digits)
    for c in reversed(text):
        out.append(left.pop() if c.isdigit() and left else c)
    return "".join(reversed(out))


def phone(key: bytes, text: str) -> str:
    code = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
    digits = re.sub(r"\D", "", text)[len(code[1]) if code else 0:]
    return in_format(text, number_surrogate(key, "phone", digits, lambda d: True))


def card(key: bytes, text: str) -> str:
    digits = re.sub(r"\D", "", text)
    valid = luhn(digits)
    return in_format(text, number_surrogate(key, "card", digits, lambda d: luhn(d) == valid))


def ip(key: bytes, text: str) -> str:
    a, b = (int(x) * 256 + int(y) for x, y in zip(text.split(".")[::2], text.split(".")[1::2]))
    for r in range(8):
        a, b = b, a ^ drawn(key, "ip", r, b) % 65536
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def email(key: bytes, text: str, attempt: int) -> str:
    """Letters for letters and digits for digits in the local part, another host below example.com."""
    local, _, host = text.lower().partition("@")
    n, out = drawn(key, "email", local, host, attempt), []
    for c in text.partition("@")[0]:
        base = "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else c
        n, k = divmod(n, len(base))
        out.append(base[k].upper() if c.isupper() else base[k])
    return "".join(out) + f"@mail{drawn(key, 'host', host, attempt) % 10 ** 6}.example.com"


def script_of(word: str) -> str:
    return "cyrillic" if re.search("[а-яА-Я]", word) else "latin"


def syllables(n: int, script: str, count: int) -> str:
    out = ""
    for _ in range(count):
        n, k = divmod(n, len(SYLLABLES[script]))
        out += SYLLABLES[script][k]
    return out


def given(key: bytes, word: str, gender: str, attempt: int) -> str:
    """A given name by gender, from the second attempt on with a syllable more before it each time."""
    script = script_of(word)
    pool = GIVEN[script, gender] if gender else GIVEN[script, "m"] + GIVEN[script, "f"]
    out = pool[drawn(key, "given", word.lower(), *[attempt] * (attempt > 0)) % len(pool)]
    if attempt:
        out = (syllables(drawn(key, "before", word.lower(), attempt), script, attempt) + out.lower()).capitalize()
    return out.upper() if word.isupper() else out


def family(key: bytes, word: str, attempt: int) -> str:
    out = syllables(drawn(key, "family", word.lower(), attempt), script_of(word), 5)
    return out.upper() if word.isupper() else out.capitalize()


def known_by(kind: str, word: str, gender: str = "") -> str:
    """What a drawn entity is known by: lower case, given names with the gender before them."""
    return f"{gender}:{word.lower()}" if kind == "given" else word.lower()


def gender_of(title: str) -> str:
    return next(g for g, titles in TITLES.items() if title in titles)


def name_parts(name: str, gender: str) -> list[tuple[str, str, str]]:
    """(kind, word, gender) of the words of a name: given names, then the family name."""
    *before, last = name.split(" ")
    return [*(("given", w, gender) for w in before), ("family", last, "")]


def found(text: str) -> list[tuple[str, str, int, int, list[tuple[str, str, str]]]]:
    """(kind, entity, start, end, drawn parts) of the entities of a text, in order."""
    if not HINT.search(text):
        return []
    made, names = [], {}
    for m in ENTITY.finditer(text):
        kind = "name" if m.lastgroup in ("name", "title") else m.lastgroup
        parts = [("email", m[kind], "")] if kind == "email" else []
        if kind == "name":
            parts = names[m[kind]] = name_parts(m[kind], gender_of(m["title"]))
        made.append((kind, m[kind], *m.span(kind), parts))
    if names:
        made += later_mentions(text, names, made)
    return sorted(made, key=lambda x: x[2])


def later_mentions(text: str, names: dict, made: list) -> list:
    """The same persons without a title: by the whole name, the family name, or given names."""
    given_names = {w: (k, w, g) for parts in names.values() for k, w, g in parts if k == "given"}
    families = {w: (k, w, g) for parts in names.values() for k, w, g in parts if k == "family"}
    words = "|".join(map(re.escape, sorted(given_names.keys() | families.keys(), key=len, reverse=True)))
    spans, out, at = [(s, e) for _, _, s, e, _ in made], [], 0
    for m in re.finditer(rf"(?<!\w)(?:{words})(?!\w)(?: (?:{words})(?!\w))*", text):
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        if at < len(spans) and spans[at][0] < m.end():
            pieces = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"\S+", m[0])]
            pieces = [p for p in pieces if not any(s < p[1] and e > p[0] for s, e in spans[at:at + len(pieces) + 1])]
        else:
            pieces = [m.span()]
        for s, e in pieces:
            own = text[s:e].split(" ")
            parts = names.get(text[s:e]) or [families[w] if w in families and (k + 1 == len(own) or w not in given_names) else
                                             given_names.get(w) or families[w] for k, w in enumerate(own)]
            out.append(("name", text[s:e], s, e, parts))
    return out


def drawn_surrogate(key: bytes, kind: str, word: str, gender: str, attempt: int) -> str:
    if kind == "given":
        return given(key, word, gender, attempt)
    return (email if kind == "email" else family)(key, word, attempt)


def surrogate(key: bytes, kind: str, entity: str, parts: list, attempts: dict[str, int]) -> str:
    if parts:
        return " ".join(drawn_surrogate(key, *p, attempts.get(f"{p[0]}:{known_by(*p)}", 0)) for p in parts)
    now = entity
    while now == entity:  # a fixed point of the map is mapped with another key
        now = {"phone": phone, "card": card, "ip": ip}[kind](key, entity)
        key += b"+"
    return now


def replaced(text: str, key: bytes, attempts: dict[str, int]) -> tuple[str, list[int]]:
    out, upto, counts = [], 0, dict.fromkeys(KINDS, 0)
    for kind, entity, s, e, parts in found(text):
        out += [text[upto:s], surrogate(key, kind, entity, parts, attempts)]
        upto = e
        counts[kind] += 1
    return "".join([*out, text[upto:]]), list(counts.values())


def drawn_in(text: str) -> set[tuple[str, str]]:
    """(kind, what it is known by) of everything drawn in a text."""
    return {(p[0], known_by(*p)) for *_, parts in found(text) for p in parts}


def drawn_entities(docs: DataFrame) -> DataFrame:
    """The distinct entities whose surrogates are drawn: (kind, entity in canonical form)."""
    def work(batches):
        seen: set[tuple[str, str]] = set()
        for b in slices(batches):
            new = {x for t in b.column("_text").to_pylist() for x in drawn_in(t)} - seen
            seen = new | seen if len(seen) < 1 << 18 else new
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in sorted(new)], pa.string()) for j in range(2)], names=["kind", "entity"])

    return docs.select(text_of().alias("_text")).mapInArrow(work, "kind string, entity string").distinct()


def later_attempts(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, attempt) of the entities that must not use their first surrogate.

    An entity gives way where its surrogate is an entity of the documents itself, or
    where another entity with a smaller name has the same surrogate.
    """
    def draw(batches):
        for b in slices(batches, 4096):
            rows = zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt")))
            made = []
            for k, e, a in rows:
                gender, _, word = e.rpartition(":") if k == "given" else ("", "", e)
                made.append(drawn_surrogate(key, k, word, gender, a).lower())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "surrogate"])

    entities = kept(drawn_entities(docs).withColumn("attempt", F.lit(0)))
    taken = entities.select("kind", F.when(F.col("kind") == "given", F.regexp_replace("entity", "^[mf]?:", "")).otherwise(
        F.col("entity")).alias("surrogate")).distinct()
    for _ in range(ATTEMPTS):
        made = kept(entities.mapInArrow(draw, "kind string, entity string, attempt int, surrogate string"))
        winner = made.groupBy("kind", "surrogate").agg(F.min_by("entity", F.struct(-F.col("attempt"), F.col("entity"))).alias("winner"))
        clash = taken.withColumn("clash", F.lit(True))
        checked = made.join(winner, ["kind", "surrogate"]).join(clash, ["kind", "surrogate"], "left")
        loses = F.coalesce("clash", F.lit(False)) | (F.col("winner") != F.col("entity"))
        entities = kept(checked.select("kind", "entity", (F.col("attempt") + loses.cast("int")).alias("attempt"), loses.alias("again")))
        going = not entities.where("again").isEmpty()
        entities = entities.drop("again")
        if not going:
            return entities.where("attempt > 0")
    raise ValueError(f"surrogates still collide after {ATTEMPTS} attempts")


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, the text with surrogates, and the number of replaced entities by kind."""
    later = later_attempts(docs, key)

    def occur(batches):
        for b in slices(batches):
            got = [(r, k, e) for r, t in zip(b.column("text_key").to_pylist(), b.column("_text").to_pylist())
                   for k, e in drawn_in(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string()))],
                                             names=["text_key", "kind", "entity"])

    def replace(batches):
        for b in slices(batches):
            got = [replaced(t, key, dict(a or ())) for t, a in zip(b.column("_text").to_pylist(), b.column("_again").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([t for t, _ in got], pa.string()), *(pa.array([n[j] for _, n in got], pa.int64()) for j in range(len(KINDS)))],
                names=["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), text_of().alias("_text"))
    # only entities that draw again reach the texts by a join; most often there are none
    again = rows.select("text_key", "_text").mapInArrow(occur, "text_key bigint, kind string, entity string").join(later, ["kind", "entity"])
    again = again.distinct().groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat("kind", F.lit(":"), "entity"), "attempt"))).alias("_again"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.join(again, "text_key", "left").select("doc_id", "_text", "_again").mapInArrow(replace, f"doc_id {kind}, text string, {counts}")


def query(spark, sf_dir):
    return pseudonymised(spark.read.parquet(f"{sf_dir}/documents.parquet"))
