"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions; each decision has a context tree of its own
over the bytes before it. A node's Krichevsky-Trofimov estimate of its counts is
mixed half and half with what its longer contexts give, over all depths from 0 to
``DEPTH``. Scores are log10 probabilities of whole texts with an end mark; the code
length per byte follows from them.

All contexts are told apart, however rare, and the tree is never in one place.
Documents are packed into blocks of about ``BLOCK`` bytes; a block asks for the
probability of each distinct sequence of ``DEPTH + 1`` bytes in it, and says how
often training texts of the block hold it. Requests are dealt by the last ``ROOT``
bytes of the context, so each subtree below such a context lies whole in one
bucket, where it is weighted from its leaves up. Contexts of fewer than ``ROOT``
bytes (256 ** (ROOT - 1) at most) are weighted in the driver out of sums over the
subtrees and sent to the buckets, which answer the blocks. A sequence that no
training text holds is asked for with a count of 0.

``scored(docs, bounded=True)`` is cheaper and coarser: there a context with less than
``SHARE`` of all training bytes isn't told apart further, so that a tree of no more
than 1 / SHARE contexts a depth may be sent to the tasks.

The plain word score beside it uses exact counts of all words: words with at least
``WORD_SHARE`` of all tokens (no more than 1 / WORD_SHARE of them) are sent to the
tasks, all rarer ones are asked for by the blocks and answered out of buckets.

* Missing and empty texts have one token, the end, and the score of an end mark.
* A missing id counts as the empty text for the hold-out rule. Repeated rows are
  rows of their own, in training and in the result.
* Without training rows, N and V are 0: no token is known, and every estimate is 1/2.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import LOWER_BYTES, crc_remainder, slices, text_of, written

DEPTH = 5
SHARE = 2.0 ** -15
WORD_SHARE = 2.0 ** -17
END = 255               # a byte that UTF-8 never uses
FLUSH = 4_000_000       # distinct keys that a task holds before it passes them on
END_WORD = b"\x00 end"  # no word holds a blank
BATCH = 64
BLOCK = 32 << 20        # bytes of text that are scored together
ROOT = 3                # subtrees below contexts of so many bytes stay together
BUCKETS = 256
ANSWER = "block bigint, bucket int, data binary"


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def codes(texts: list[bytes]) -> np.ndarray:
    """For every byte of every text and each end mark: the DEPTH bytes before it and itself, as one number."""
    lead = b"\x00" * DEPTH
    raw = np.frombuffer(lead + b"".join(t + bytes([END]) + lead for t in texts), np.uint8)
    code = np.zeros(len(raw) - DEPTH, np.int64)
    for k in range(DEPTH + 1):
        code = code << 8 | raw[k:len(raw) - DEPTH + k]
    inside = np.ones(len(code), bool)
    at = np.cumsum([len(t) + 1 + DEPTH for t in texts], dtype=np.int64)
    for k in range(1, DEPTH + 1):
        inside[at - k] = False  # padding after an end mark predicts nothing
    return code[inside]


def counted(docs: DataFrame) -> DataFrame:
    """(key, n): the byte sequences of the training texts."""
    def work(batches):
        grams = []
        for b in slices(batches, BATCH):
            grams.append(np.unique(codes([t.encode() for t in b.column("_text").to_pylist()]), return_counts=True))
            if sum(len(k) for k, _ in grams) > FLUSH // 2:
                grams = [merged(grams)]
            if len(grams[0][0]) > FLUSH:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, merged(grams))), names=["key", "n"])
                grams = []
        yield pa.RecordBatch.from_arrays(list(map(pa.array, merged(grams))), names=["key", "n"])

    rows = docs.where(crc_remainder() != 1).select(text_of().alias("_text"))
    return rows.mapInArrow(work, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def kept_contexts(grams: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth: the contexts that hold their share (sorted), and how often each byte follows them."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    made = []
    for depth in range(DEPTH + 1):
        context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1))
        pairs = grams.select(context.alias("context"), F.col("key").bitwiseAND(F.lit(255)).alias("byte"), "n")
        pairs = pairs.groupBy("context", "byte").agg(F.sum("n").alias("n"))
        large = pairs.groupBy("context").agg(
            F.sum("n").alias("all"), F.collect_list(F.struct("byte", "n")).alias("follow")).where(F.col("all") >= max(1, total * SHARE))
        rows = large.select("context", "follow.byte", "follow.n").toPandas()
        order = np.argsort(rows["context"].to_numpy(np.int64), kind="stable")
        table = np.zeros((len(rows), 256), np.int64)
        for k, row in enumerate(order):
            table[k, rows["byte"].iloc[row]] = rows["n"].iloc[row]
        made.append((rows["context"].to_numpy(np.int64)[order], table))
    return made


def decisions(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 at the 255 inner nodes of the byte tree (node 1 is the root, 2k and 2k+1 follow k)."""
    nodes = np.zeros((len(table), 512))
    nodes[:, 256:] = table
    for k in range(255, 0, -1):
        nodes[:, k] = nodes[:, 2 * k] + nodes[:, 2 * k + 1]
    return nodes[:, 2:512:2], nodes[:, 3:512:2]


def log_factorials(n: np.ndarray) -> np.ndarray:
    """log Gamma for positive numbers by Stirling's series, with small arguments moved up."""
    shift, x = np.zeros_like(n), n.astype(float).copy()
    for _ in range(6):
        low = x < 6
        shift -= np.where(low, np.log(np.where(low, x, 1)), 0)
        x += low
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3)


def in_parts(table: np.ndarray, of, kind=np.float64) -> np.ndarray:
    """``of(zeros, ones)`` at the inner nodes for all rows of a table, some rows at a time."""
    out = np.empty((len(table), 255), kind)
    for at in range(0, len(table), 2048):
        out[at:at + 2048] = of(*decisions(table[at:at + 2048]))
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_factorials(zeros + 0.5) + log_factorials(ones + 0.5) - log_factorials(zeros + ones + 1) - 1.1447298858494002


def next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


class Tree:
    """The weighted tree, as the log10 probability of each byte after each kept context.

    ``contexts[d]`` are the kept contexts of depth d in order, ``tables[d]`` has a row
    of 256 for each: for d < DEPTH when no longer context is kept.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        if not len(levels[0][0]):
            levels = [(np.zeros(1, np.int64), np.zeros((1, 256), np.int64)), *levels[1:]]
        self.contexts = [c for c, _ in levels]
        parents = [None] + [np.searchsorted(self.contexts[d - 1], self.contexts[d] & ((1 << 8 * (d - 1)) - 1))
                            for d in range(1, DEPTH + 1)]
        shares, leaves = [None] * (DEPTH + 1), [None] * (DEPTH + 1)
        weighted = None  # log of the weighted probability of the nodes one level down
        for d in range(DEPTH, -1, -1):
            own = in_parts(levels[d][1], kt)
            if d < DEPTH:
                rest = levels[d][1].copy()  # what no kept longer context has: one leaf more
                np.subtract.at(rest, parents[d + 1], levels[d + 1][1])
                longer = in_parts(rest, kt)
                np.add.at(longer, parents[d + 1], weighted)
                leaves[d] = in_parts(rest, next_one, np.float32)
                # the share of the node's own estimate in the mixture, of a half each at first
                shares[d] = (1 / (1 + np.exp(np.clip(longer - own, -700, 700)))).astype(np.float32)
                own = np.logaddexp(own, longer) - np.log(2)
            weighted = own
        self.tables, above = [], []  # above: (share, estimate) of all shorter contexts, row by row
        for d in range(DEPTH + 1):
            path = [x[parents[d]] for x in above]
            if d < DEPTH:
                path += [shares[d], in_parts(levels[d][1], next_one, np.float32)]
                last = leaves[d]
            else:
                last = in_parts(levels[d][1], next_one, np.float32)
            self.tables.append(bytes_of(mixed(path, last)))
            above = path

    @classmethod
    def of(cls, contexts: list[np.ndarray], tables: list[np.ndarray]) -> Tree:
        """The tree whose arrays were sent to a task."""
        made = cls.__new__(cls)
        made.contexts, made.tables = contexts, tables
        return made

    def rows(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each sequence after the others."""
        out = self.tables[0][0][code & 255].copy()
        left = np.arange(len(code))
        for d in range(1, DEPTH + 1):
            known = self.contexts[d]
            if not len(known):
                break
            own = code[left] >> 8 & ((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            left, at = left[hit], at[hit]
            out[left] = self.tables[d][at, code[left] & 255]
        return out


def text_scores(tree: Tree, texts: list[bytes]) -> np.ndarray:
    """log10 probability of each text with its end mark; equal sequences are looked up once."""
    if not texts:
        return np.zeros(0)
    keys, at = np.unique(codes(texts), return_inverse=True)
    value = tree.rows(keys).astype(float)[at]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.add.reduceat(value, np.r_[0, ends[:-1]])


def mixed(path: list[np.ndarray], last: np.ndarray) -> np.ndarray:
    """The mixture along a path of (share, estimate) from the root, ending in a leaf's estimate."""
    for share, p in zip(path[-2::-2], path[::-2]):
        last = share * p + (1 - share) * last
    return last


def bytes_of(ones: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from those of a 1 at the inner nodes."""
    p = np.zeros((len(ones), 512), np.float32)
    ones = np.clip(ones, 1e-7, 1 - 1e-7)  # what 32 bits can tell from 0 and 1
    for k in range(1, 256):
        p[:, 2 * k] = p[:, k] + np.log10(1 - ones[:, k - 1])
        p[:, 2 * k + 1] = p[:, k] + np.log10(ones[:, k - 1])
    return p[:, 256:].copy()


def fitted(grams: DataFrame) -> Tree:
    return Tree(kept_contexts(grams))


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys and a value for each, compressed; steps between keys go byte by byte."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T)
    return packed_table(pa.table({"values": values, **{f"k{i}": x for i, x in enumerate(planes)}}))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = unpacked_table(data)
    planes = np.stack([table[f"k{i}"].to_numpy() for i in range(8)])
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel()), table["values"].to_numpy()


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return ((keys >> 8 & ((1 << 8 * ROOT) - 1)) * 2654435761 >> 16) % BUCKETS


def blocks(rows: DataFrame, with_grams: bool = True) -> DataFrame:
    """(block, bucket, tokens, data): the packed documents of each block under bucket -1, with the number of its
    training tokens, and its requests: sequences by bucket, words by hash from bucket BUCKETS on."""
    def work(batches):
        part, seq, size, held, grams, words, tokens = TaskContext.get().partitionId(), 0, 0, [], [], Counter(), 0

        def out():
            hashes = np.fromiter(map(word_hash, words), np.int64, len(words))
            hashes, times = merged([(hashes, np.fromiter(words.values(), np.int64, len(words)))])
            keys, n = merged(grams) if with_grams else (hashes[:0], times[:0])
            made = [(-1, tokens, packed_table(pa.Table.from_batches(held)))]
            for low, k, c, dealt in ((0, keys, n, bucket_of(keys)), (BUCKETS, hashes, times, hashes % BUCKETS)):
                order = np.argsort(dealt, kind="stable")  # keys stay in order within a bucket
                ends = np.searchsorted(dealt[order], np.arange(BUCKETS + 1))
                rows = (order[i:j] for i, j in zip(ends[:-1], ends[1:]))
                made += [(low + i, 0, packed(k[own], c[own])) for i, own in enumerate(rows) if len(own)]
            bucket, count, data = zip(*made)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq] * len(made), pa.int64()), pa.array(bucket, pa.int32()), pa.array(count, pa.int64()), pa.array(data, pa.binary())],
                names=["block", "bucket", "tokens", "data"])

        for b in slices(batches, BATCH):
            texts = [t.encode() for t in b.column("_text").to_pylist()]
            apart = b.column("held_out").to_pylist()
            for t, held_out in zip(texts, apart):  # what is held out is asked for, not counted
                own = [*t.translate(LOWER_BYTES).split(), END_WORD]
                words.update(dict.fromkeys(own, 0) if held_out else own)
                tokens += 0 if held_out else len(own)
            for held_out in (False, True) if with_grams else ():
                keys, n = np.unique(codes([t for t, h in zip(texts, apart) if h == held_out]), return_counts=True)
                grams.append((keys, n * (not held_out)))
            held.append(b)
            size += sum(map(len, texts))
            if sum(len(k) for k, _ in grams) > FLUSH // 2:
                grams = [merged(grams)]
            if size >= BLOCK or sum(len(k) for k, _ in grams[:1]) + len(words) > FLUSH:
                yield out()
                seq, size, held, grams, words, tokens = seq + 1, 0, [], [], Counter(), 0
        if held:
            yield out()

    return rows.mapInArrow(work, "block bigint, bucket int, tokens bigint, data binary")


def backwards(keys: np.ndarray) -> np.ndarray:
    """Sequences with the bytes of the context in reverse, so that contexts with the same end are neighbours in order."""
    out = keys & 255
    for k in range(DEPTH):
        out |= (keys >> 8 * (k + 1) & 255) << 8 * (DEPTH - k)
    return out


LOG_HALVES, LOG_WHOLES = log_factorials(np.arange(1 << 12) + 0.5), log_factorials(np.arange(1 << 12) + 1.0)


def kt_of(n: np.ndarray, others: np.ndarray) -> np.ndarray:
    """``kt`` of whole numbers; small ones are looked up."""
    def log_gamma(k, known, plus):
        out = known[np.minimum(k, len(known) - 1)]
        large = np.flatnonzero(k >= len(known))
        out[large] = log_factorials(k[large] + plus)
        return out

    return log_gamma(n, LOG_HALVES, 0.5) + log_gamma(others, LOG_HALVES, 0.5) - log_gamma(n + others, LOG_WHOLES, 1.0) - 1.1447298858494002


def own_share(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """The share of a node's own estimate in its mixture with longer contexts, of a half each at first."""
    return 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))


class Subtrees:
    """The weighted subtrees below contexts of ROOT bytes, of sequences in order (backwards) and their counts.

    ``keys`` and ``n`` are the counts at depth ROOT, ``nodes`` for each of the 8 bits the
    first row of each node there and its weighted log probability. ``row`` says which row of
    ``keys`` a sequence belongs to and ``p[l]`` the probability of its bit l by the subtree.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.p, self.row, below = np.empty((8, len(keys))), np.arange(len(keys)), None
        for d in range(DEPTH, ROOT - 1, -1):
            if d < DEPTH:
                keys, up = np.unique(keys >> 16 << 8 | keys & 255, return_inverse=True)
                n, self.row = np.bincount(up, n, len(keys)).astype(np.int64), up[self.row]
            nodes, side = [None] * 8, n
            for bit in range(7, -1, -1):
                prefix = keys >> 8 - bit
                first = np.r_[True, prefix[1:] != prefix[:-1]]
                starts, node = np.flatnonzero(first), np.cumsum(first) - 1
                total = np.add.reduceat(n, starts)
                weighted = own = kt_of(side[starts], total - side[starts])
                whole = total[node]
                p = (side + 0.5) / (whole + 1)
                if below is None:
                    self.p[bit] = p
                else:
                    longer = np.bincount(node[up[below[bit][0]]], below[bit][1], len(starts))
                    share = own_share(own, longer)[node][self.row]
                    self.p[bit] = share * p[self.row] + (1 - share) * self.p[bit]
                    weighted = np.logaddexp(own, longer) - np.log(2)
                nodes[bit], side = (starts, weighted), whole
            below = nodes
        self.keys, self.n, self.nodes = keys, n, below

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """For the contexts of ROOT - 1 bytes, by context << 9 | node: log probabilities of the subtrees; from node 256 on counts of bytes."""
        code = [self.keys >> 16 << 9 | 256 | self.keys & 255]
        value = [self.n.astype(float)]
        for bit, (starts, weighted) in enumerate(self.nodes):
            own = self.keys[starts]
            code.append(own >> 16 << 9 | 1 << bit | (own & 255) >> 8 - bit)
            value.append(weighted)
        codes_, at = np.unique(np.concatenate(code), return_inverse=True)
        return codes_, np.bincount(at, np.concatenate(value), len(codes_))


def above_roots(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of ROOT - 1 bytes, and for their 255 inner nodes (a, b): a one has probability a + b * p if the subtree says p."""
    contexts = np.unique(code >> 9)
    at, node = np.searchsorted(contexts, code >> 9), code & 511
    table, longer = np.zeros((len(contexts), 256), np.int64), np.zeros((len(contexts), 255))
    is_count = node >= 256
    table[at[is_count], node[is_count] - 256] = np.rint(value[is_count])
    longer[at[~is_count], node[~is_count] - 1] = value[~is_count]
    a, b, up, here = np.zeros(longer.shape), np.ones(longer.shape), np.arange(len(contexts)), contexts
    for d in range(ROOT - 1, -1, -1):
        own, one = in_parts(table, kt), in_parts(table, next_one)
        share = own_share(own, longer)
        a, b = (share * one)[up] + (1 - share)[up] * a, (1 - share)[up] * b
        if d:
            weighted = np.logaddexp(own, longer) - np.log(2)
            here, parent = np.unique(here >> 8, return_inverse=True)
            counts, longer = np.zeros((len(here), 256), np.int64), np.zeros((len(here), 255))
            np.add.at(counts, parent, table)
            np.add.at(longer, parent, weighted)
            table, up = counts, parent[up]
    return contexts, a, b


def requested(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, Subtrees]:
    """The distinct sequences of the requests, their order backwards, and the subtrees that they form."""
    keys, n = merged([unpacked(x) for x in data])
    turned = backwards(keys)
    order = np.argsort(turned)
    return keys, order, Subtrees(turned[order], n[order])


def subtree_sums(requests: pa.Table) -> pa.Table:
    code, value = requested(requests["data"].to_pylist())[2].sums()
    return pa.table({"code": code, "value": value})


def answered(requests: pa.Table, contexts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(block, bucket, data): log10 probabilities of the sequences that each block asked for."""
    data = requests["data"].to_pylist()
    keys, order, trees = requested(data)
    at, byte = np.searchsorted(contexts, trees.keys >> 16)[trees.row], trees.keys[trees.row] & 255
    log_p = np.zeros(len(keys))
    for bit in range(8):
        node = (1 << bit | byte >> 8 - bit) - 1
        one, rest = a[at, node], b[at, node]
        log_p += np.log10(np.where(byte >> 7 - bit & 1, one, 1 - one - rest) + rest * trees.p[bit])
    value = np.empty(len(keys), np.float32)
    value[order] = log_p
    own = [unpacked(x)[0] for x in data]
    return pa.table({"block": requests["block"], "bucket": requests["bucket"],
                     "data": pa.array([packed(k, value[np.searchsorted(keys, k)]) for k in own], pa.binary())})


def word_figures(requests: pa.Table, least: float) -> pa.Table:
    """(key, n) of the words with ``least`` occurrences; under a missing key the number of words."""
    keys, n = merged([unpacked(x) for x in requests["data"].to_pylist()])
    often = n >= least
    return pa.table({"key": pa.array([None, *keys[often].tolist()], pa.int64()), "n": pa.array([int((n > 0).sum()), *n[often].tolist()], pa.int64())})


def words_answered(requests: pa.Table, least: float) -> pa.Table:
    """(block, bucket, data): counts of the words that each block asked for, without those with ``least`` occurrences."""
    asked = [unpacked(x) for x in requests["data"].to_pylist()]
    keys, n = merged(asked)
    data = []
    for own, _ in asked:
        count = n[np.searchsorted(keys, own)]
        data.append(packed(own[count < least], count[count < least]))
    return pa.table({"block": requests["block"], "bucket": requests["bucket"], "data": pa.array(data, pa.binary())})


def probabilities(requests: DataFrame) -> DataFrame:
    """(block, bucket, data): the answers of the weighted tree of all contexts."""
    sums = requests.groupBy("bucket").applyInArrow(subtree_sums, "code bigint, value double")
    sums = sums.groupBy("code").agg(F.sum("value").alias("value")).toPandas()  # contexts of ROOT - 1 bytes only
    sent = requests.sparkSession.sparkContext.broadcast(above_roots(sums["code"].to_numpy(np.int64), sums["value"].to_numpy(float)))
    return requests.groupBy("bucket").applyInArrow(lambda t: answered(t, *sent.value), ANSWER)


class Known:
    """The log10 probabilities that a block got for its sequences."""

    def __init__(self, data: list[bytes]):
        keys, value = (np.concatenate(x) for x in zip(*map(unpacked, data)))
        order = np.argsort(keys)
        self.keys, self.value = keys[order], value[order]

    def rows(self, code: np.ndarray) -> np.ndarray:
        return self.value[np.searchsorted(self.keys, code)]


def scored(docs: DataFrame, *, bounded: bool = False) -> DataFrame:
    """doc_id, held_out, token counts, word score and model score of every row; ``bounded`` pools rare contexts."""
    rows = docs.select("doc_id", (crc_remainder() == 1).alias("held_out"), text_of().alias("_text"))
    parts = written(blocks(rows, not bounded))
    tokens = parts.agg(F.sum("tokens")).first()[0] or 0
    asked = parts.where(F.col("bucket") >= BUCKETS).select("block", "bucket", "data").groupBy("bucket")
    least = max(1, tokens * WORD_SHARE)
    figures = asked.applyInArrow(lambda t: word_figures(t, least), "key bigint, n bigint")
    figures = figures.groupBy("key").agg(F.sum("n").alias("n")).collect()  # at most 1 / WORD_SHARE words
    frequent = {r.key: r.n for r in figures if r.key is not None}
    below = tokens + 0.5 * (sum(r.n for r in figures if r.key is None) + 1)
    answers, tree = asked.applyInArrow(lambda t: words_answered(t, least), ANSWER), None
    if bounded:
        tree = fitted(written(counted(docs)))
        tree = (tree.contexts, tree.tables)
    else:
        answers = answers.unionByName(probabilities(parts.where((F.col("bucket") >= 0) & (F.col("bucket") < BUCKETS))
                                                    .select("block", "bucket", "data")))
    sent = docs.sparkSession.sparkContext.broadcast((frequent, tree))

    def in_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        frequent, tree = sent.value
        of_words = pa.compute.greater_equal(answers["bucket"], BUCKETS)
        tree = Tree.of(*tree) if tree else Known(answers.filter(pa.compute.invert(of_words))["data"].to_pylist())
        counts = dict(frequent)
        for data in answers.filter(of_words)["data"].to_pylist():
            counts.update(zip(*(x.tolist() for x in unpacked(data))))
        met: dict[bytes, tuple[bool, float]] = {}
        made = []
        for b in slices(unpacked_table(texts["data"][0].as_py()).to_batches(), BATCH):
            texts_ = [t.encode() for t in b.column("_text").to_pylist()]
            n_tokens, n_known, base = [], [], []
            for t in texts_:
                own = Counter(t.translate(LOWER_BYTES).split())
                own[END_WORD] = 1
                known, total = 0, 0.0
                for w, times in own.items():
                    if w not in met:
                        n = counts[word_hash(w)]
                        met[w] = n > 0, float(np.log10((n + 0.5) / below))
                    seen, p = met[w]
                    known += times * seen
                    total += times * p
                n_tokens.append(sum(own.values())), n_known.append(known), base.append(total)
            made.append(pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                 pa.array([tokens] * len(texts_), pa.int64()), pa.array(base, pa.float64()), pa.array(text_scores(tree, texts_), pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(made)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return parts.where("bucket < 0").select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        in_block, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark, sf_dir):
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
