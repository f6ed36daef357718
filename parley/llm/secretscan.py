"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags every token as the begin of a secret, inside one, or outside. Its
features are the token's shape, the neighbouring tokens (two on either side) and
figures of the whole text. It is fitted on windows around pattern matches in a
bounded sample: up to ``HINTED`` documents with a word that hints at secrets and up to
``PLAIN`` others, those with the smallest hash of their id. A token's share in the
scores depends on its spelling only, so a task works it out once per spelling;
tokens that no transition could turn from outside are settled at once, and the
Viterbi algorithm runs over what lies between them, which gives the best path of
the whole text.

Pattern matches always stay; tagged runs that touch none of them are added as kind
``crf``.

* Missing and empty texts have no spans. Repeated rows have equal results.
* Without a pattern match in the sample there is no field and nothing is added.
"""
from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import slices, text_of

# fixed values of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]+")
HINTED, PLAIN = 2000, 1000
REACH = 15                 # tokens on either side of a match in a window
STEPS, RATE, RIDGE = 80, 0.3, 1e-4
REMEMBERED = 1 << 20       # spellings
OUT, BEGIN, IN = 0, 1, 2
OFFSETS = (-2, -1, 0, 1, 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves are: the values of assignments, keys and hexadecimal runs."""
    found = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found + [m.span() for m in ACCESS.finditer(text)] + [m.span() for m in HEX.finditer(text)]


def shape(token: str) -> tuple[str, ...]:
    """Features of one spelling; few different ones for plain words."""
    n = len(token)
    size = f"n{min(n.bit_length(), 7)}"
    if token.isalpha():
        upper = 0 if token.islower() else sum(map(str.isupper, token))
        return size, "letters", f"u{upper * 4 // n}"
    digits = sum(map(str.isdigit, token))
    upper = sum(map(str.isupper, token))
    letters = sum(map(str.isalpha, token))
    classes = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", token)))
    spread = -sum(c / n * np.log2(c / n) for c in Counter(token).values())
    made = [size, f"d{digits * 4 // n}", f"u{upper * 4 // n}", f"l{letters * 4 // n}",
            f"t{min(len(classes), 12) // 2}", f"e{int(spread)}", f"c{classes[:6]}"]
    if n >= 8 and 0 < digits < n and re.fullmatch(r"[0-9a-f]+", token):
        made.append("hex")
    if digits == n:
        made.append(f"number{min(n, 20) // 4}")
    if token.count(".") > 1:
        made.append("dotted")
    return tuple(made)


def neighbour(token: str) -> tuple[str, ...]:
    """What a token says about those beside it."""
    if len(token) <= 2 and not token.isalnum():
        return (f"mark{token}",)
    low = token.lower()
    if any(h in low for h in HINTS):
        return ("hint",)
    if len(token) > 3 and not token.isalpha() and any(map(str.isdigit, token)):
        return ("numbers",)
    return ("word",)


def file_features(tokens: list[str]) -> list[str]:
    n = max(len(tokens), 1)
    return [f"size{min(n.bit_length(), 12)}", f"marks{min(sum(1 for t in tokens if t in ('=', ':', '|')) * 20 // n, 4)}"]


def features(token: str, offset: int) -> list[str]:
    return [f"{offset}{f}" for f in (shape(token) if offset == 0 else neighbour(token))]


def windows(text: str, positives: bool) -> list[tuple[list[str], list[int], list[str]]]:
    """(tokens, tags, file features) around the secrets of a text, and a few windows elsewhere."""
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    tokens = [text[s:e] for s, e in spans]
    parts = sorted(secret_parts(text))
    tags, inside = [], 0
    for s, e in spans:
        own = [p for p in parts if s < p[1] and e > p[0]]
        tags.append(OUT if not own else IN if inside and own[0] == inside else BEGIN)
        inside = own[0] if own else 0
    marked = [k for k, t in enumerate(tags) if t] if positives else []
    step = max(len(tokens) // 3, 2 * REACH)
    centres = marked + list(range(REACH, len(tokens) + REACH, step))[:3]
    whole = file_features(tokens)
    made, upto = [], -1
    for c in sorted(centres):
        lo, hi = max(c - REACH, upto), min(c + REACH + 1, len(tokens))
        if lo < hi:
            made.append((tokens[lo:hi], tags[lo:hi], whole))
            upto = hi
    return made


class Field:
    """Weights of the features (rows of three tags) and of tag pairs."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.index, self.weights, self.pairs = index, weights, pairs
        # the most that the two transitions of a token could gain by leaving OUT
        self.gain = max(pairs[a, x] + pairs[x, c] - pairs[a, OUT] - pairs[OUT, c]
                        for a in range(3) for x in (BEGIN, IN) for c in range(3))

    def total(self, names: list[str]) -> np.ndarray:
        rows = [self.index[n] for n in names if n in self.index]
        return self.weights[rows].sum(0) if rows else np.zeros(3)


def fitted(samples: list[tuple[list[str], list[int], list[str]]]) -> Field | None:
    """Maximum likelihood with a small ridge, by AdaGrad on all windows at once."""
    if not any(t for _, tags, _ in samples for t in tags):
        return None
    width = max(len(tokens) for tokens, _, _ in samples)
    index: dict[str, int] = {}
    token_at, feature_at, tags, mask = [], [], np.zeros((len(samples), width), int), np.zeros((len(samples), width), bool)
    for k, (tokens, own, whole) in enumerate(samples):
        tags[k, :len(own)], mask[k, :len(own)] = own, True
        for t in range(len(tokens)):
            names = [*whole, "bias"]
            for o in OFFSETS:
                if 0 <= t + o < len(tokens):
                    names += features(tokens[t + o], o)
            for name in names:
                token_at.append(k * width + t)
                feature_at.append(index.setdefault(name, len(index)))
    token_at, feature_at = np.array(token_at), np.array(feature_at)
    n = mask.sum()
    weights, pairs = np.zeros((len(index), 3)), np.zeros((3, 3))
    seen_w, seen_p = np.full(weights.shape, 1e-8), np.full((3, 3), 1e-8)
    truth = np.eye(3)[tags] * mask[..., None]
    both = mask[:, 1:]
    true_pairs = np.einsum("kti,ktj->ij", truth[:, :-1] * both[..., None], truth[:, 1:])
    for _ in range(STEPS):
        scores = np.stack([np.bincount(token_at, weights[feature_at, y], mask.size) for y in range(3)], 1).reshape(*mask.shape, 3)
        marginal, expected = marginals(scores, pairs, mask)
        off = (marginal - truth).reshape(-1, 3)
        grad = np.stack([np.bincount(feature_at, off[token_at, y], len(index)) for y in range(3)], 1) / n + RIDGE * weights
        grad_p = (expected - true_pairs) / n + RIDGE * pairs
        seen_w += grad ** 2
        seen_p += grad_p ** 2
        weights -= RATE * grad / np.sqrt(seen_w)
        pairs -= RATE * grad_p / np.sqrt(seen_p)
    return Field(index, weights, pairs)


def marginals(scores: np.ndarray, pairs: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tag marginals and expected tag pairs of padded windows, by the forward-backward algorithm."""
    width = scores.shape[1]
    local = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(pairs)
    forward, backward = np.zeros_like(local), np.zeros_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(1, keepdims=True)
    for t in range(1, width):
        now = (forward[:, t - 1] @ step) * local[:, t]
        forward[:, t] = np.where(mask[:, t, None], now / now.sum(1, keepdims=True), forward[:, t - 1])
    backward[:, -1] = 1
    for t in range(width - 2, -1, -1):
        now = (local[:, t + 1] * backward[:, t + 1]) @ step.T
        backward[:, t] = np.where(mask[:, t + 1, None], now / now.sum(1, keepdims=True), 1)
    both = forward * backward
    marginal = both / both.sum(2, keepdims=True) * mask[..., None]
    joint = forward[:, :-1, :, None] * step * (local * backward)[:, 1:, None, :]
    joint = joint / joint.sum((2, 3), keepdims=True) * mask[:, 1:, None, None]
    return marginal, joint.sum((0, 1))


class Tagger:
    """Tags whole texts; remembers the score parts of each spelling."""

    def __init__(self, field: Field):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}               # spelling: row of ``parts``
        self.alike: dict[tuple, int] = {}           # features: row of ``parts``
        self.parts = np.zeros((1024, len(OFFSETS), 3))

    def learn(self, token: str) -> None:
        """Gives a spelling its row; spellings with equal features share one."""
        own = shape(token), neighbour(token)
        k = self.alike.get(own)
        if k is None:
            k = self.alike[own] = len(self.alike)
            if k >= len(self.parts):
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            for j, o in enumerate(OFFSETS):
                self.parts[k, j] = self.field.total([f"{o}{f}" for f in own[o != 0]])
        self.ids[token] = k

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Tagged runs as (start, end) in code points."""
        tokens = TOKEN.findall(text)
        n = len(tokens)
        if not n:
            return []
        if len(self.ids) > REMEMBERED:
            self.forget()
        for t in set(tokens).difference(self.ids):
            self.learn(t)
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, n)
        scores = np.tile(self.field.total([*file_features(tokens), "bias"]), (n, 1))
        for j, o in enumerate(OFFSETS):
            lo, hi = max(0, -o), min(n, n - o)
            if lo < hi:
                scores[lo:hi] += self.parts[ids[lo + o:hi + o], j]
        loose = np.flatnonzero(scores[:, OUT] - scores[:, 1:].max(1) <= self.field.gain + 1e-9)
        if not len(loose):
            return []
        tags = np.zeros(n, np.int64)
        for run in np.split(loose, np.flatnonzero(np.diff(loose) > 1) + 1):
            tags[run] = viterbi(scores[run], self.field.pairs, run[0] > 0, run[-1] < n - 1)
        if not tags.any():
            return []
        made, last = [], -2
        for k, m in enumerate(TOKEN.finditer(text)):
            if tags[k]:
                if tags[k] == IN and last == k - 1:
                    made[-1] = (made[-1][0], m.end())
                else:
                    made.append(m.span())
                last = k
        return made


def viterbi(scores: np.ndarray, pairs: np.ndarray, before: bool, after: bool) -> np.ndarray:
    """The best tags of a run; before and after it stand outside tokens, or the ends of the text."""
    best = scores[0] + (pairs[OUT] if before else 0)
    back = []
    for row in scores[1:]:
        way = best[:, None] + pairs
        back.append(way.argmax(0))
        best = way.max(0) + row
    tag = int((best + (pairs[:, OUT] if after else 0)).argmax())
    tags = [tag]
    for choice in reversed(back):
        tag = int(choice[tag])
        tags.append(tag)
    return np.array(tags[::-1])


def training_windows(docs: DataFrame) -> list[tuple[list[str], list[int], list[str]]]:
    """Windows of a bounded sample: the ids are chosen first, then their texts read."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    low = F.lower(text_of())
    hinted = F.col("text").contains("AKIA")
    for h in HINTS:
        hinted = hinted | low.contains(h)
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce(hinted, F.lit(False)).alias("hinted"))
    some = ids.where("hinted").orderBy(*order).limit(HINTED).union(ids.where("not hinted").orderBy(*order).limit(PLAIN))
    rows = docs.select("doc_id", text_of().alias("_text")).join(F.broadcast(some.distinct()), "doc_id")

    def work(batches):
        for b in slices(batches):
            got = [(d, i, w) for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("hinted").to_pylist(), b.column("_text").to_pylist())
                   for i, w in enumerate(windows(t, h))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(d) for d, _, _ in got]), pa.array([i for _, i, _ in got], pa.int32()),
                 *(pa.array([w[k] for _, _, w in got], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32(), pa.string())))],
                names=["id", "nth", "tokens", "tags", "whole"])

    made = rows.select("doc_id", "hinted", "_text").mapInArrow(
        work, "id string, nth int, tokens array<string>, tags array<int>, whole array<string>")
    return [(r.tokens, r.tags, r.whole) for r in sorted(made.collect(), key=lambda r: (r.id, r.nth, r.tokens))]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the kinds, digest of the pattern spans, and all spans of every row."""
    field = fitted(training_windows(docs))

    def work(batches):
        tagger = Tagger(field) if field else None
        for b in slices(batches):
            counts, digests, spans = [], [], []
            for text in b.column("_text").to_pylist():
                base = base_spans(text)
                more = [(s, 3, e) for s, e in tagger.spans(text) if not any(s < q and e > p for p, _, q in base)] if tagger else []
                n = Counter(k for _, k, _ in base)
                counts.append((n[0], n[1], n[2]))
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                spans.append(shown(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * 3)),
                 pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(
        work, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def query(spark, sf_dir):
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
