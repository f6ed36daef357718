"""Token ids of all documents in binary files, with Elias-Fano coded document boundaries.

Documents are dealt to ranges of ascending id and sorted there. Each task encodes
its documents, appends the end id to each, and writes one file:

    ids of all documents, one after the other (little-endian, 16 or 32 bits)
    where each document ends (Elias-Fano), the documents' own ids (Elias-Fano)
    a footer of fixed length with the lengths of these parts

An Elias-Fano sequence of n ascending numbers below u keeps the low bits of each,
about log2(u / n) of them, as they are, and the high parts as a bit vector with n
ones, some 2 + log2(u / n) bits for a number in all. The place of every 256th one
is kept in 32 bits, so that any offset is found by counting ones in a few words.

A file's name is new for every attempt of a task, and only the names that the
manifest (a table, one row for each file) holds are part of the result. So a task
that is run again does no harm. Files are written through Arrow's file systems.

Regular texts (no white space next to white space) are cut before blanks and
around line ends, where no pre-token can cross; units are numbered by Arrow, and
each distinct one is encoded once and remembered by its task. Pre-tokens go to the
library's own model. All other texts go to the library whole, as do all texts of
a tokenizer that isn't plain byte-level BPE.

* Missing and empty texts hold the end id only; an empty table has no files.
* Rows without an id come first; rows that share an id are documents of their own,
  ordered by a hash of the text. Ties and missing ids may fill any number of ranges.
* Strings of special tokens in a text are ordinary text.
* A very long text needs memory in proportion to its own length. Further columns
  of the documents, whatever their names, are not read.
"""
from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from itertools import chain
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import by_bytes, documents, new_folder, text_of, written

END = 2                         # the id after each document
SAMPLE = 256                    # ones between two known places of a bit vector
REMEMBERED = 1 << 20            # units a task remembers before it starts anew
MOST_BYTES = 8 << 20            # of texts encoded, or of ids read, at once
UNITS = "\x1e"                  # stands between units while a text is cut
#: White space by any library's definition.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IRREGULAR = f"^{BLANK}|{BLANK}{BLANK}|{BLANK}$|{UNITS}"
FOOTER = "<4sHHqqqqqq"  # mark, version, bytes an id, documents, those without id, least id, ids, bytes of both sequences
MARK, VERSION = b"EFID", 1
MANIFEST = "part int, path string, n_docs bigint, n_ids bigint"


# -- Elias-Fano sequences

def fano(values: np.ndarray, below: int) -> bytes:
    """Ascending numbers (uint64) smaller than ``below`` as a sequence."""
    n = len(values)
    low = max((below // n).bit_length() - 1, 0) if n else 0
    bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    marks[ones] = 1
    upper = np.packbits(marks, bitorder="little").tobytes()
    return struct.pack("<qqqq", n, low, len(lower), len(upper)) + ones[::SAMPLE].astype("<u4").tobytes() + lower + upper


class Fano:
    """A sequence read from its bytes: numbers by index, or all at once."""

    def __init__(self, data: bytes):
        self.n, self.low, of_lower, of_upper = struct.unpack_from("<qqqq", data)
        at = 32 + 4 * -(-self.n // SAMPLE)
        self.places = np.frombuffer(data, "<u4", -(-self.n // SAMPLE), 32)
        self.lower, self.upper = data[at:at + of_lower], np.frombuffer(data, np.uint8, of_upper, at + of_lower)

    def __len__(self) -> int:
        return self.n

    def select(self, k: int) -> int:
        """Place of the k-th one of the high parts: from the last known place, counting ones on the way."""
        at, left = int(self.places[k // SAMPLE]), k % SAMPLE
        byte = at >> 3
        left += int(np.bitwise_count(self.upper[byte] & np.uint8((1 << (at & 7)) - 1)))
        while True:
            ones = np.cumsum(np.bitwise_count(self.upper[byte:byte + 64]), dtype=np.int64)
            if ones[-1] > left:
                break
            left, byte = left - int(ones[-1]), byte + 64
        inside = int(np.searchsorted(ones, left, "right"))
        left -= int(ones[inside - 1]) if inside else 0
        bits = np.flatnonzero(np.unpackbits(self.upper[byte + inside:byte + inside + 1], bitorder="little"))
        return (byte + inside) * 8 + int(bits[left])

    def __getitem__(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        first, last = k * self.low, (k + 1) * self.low
        part = int.from_bytes(self.lower[first >> 3:(last + 7) >> 3], "little") >> (first & 7)
        return (self.select(k) - k) << self.low | part & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[:self.n] - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.lower, np.uint8), count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        part = (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (high.astype(np.uint64) << np.uint64(self.low)) | part


# -- encoding

def byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of texts by a tokenizer file of the library."""

    def __init__(self, content: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        self.model, self.chars = self.tokenizer.model, byte_chars()
        self.cut, self.known, self.pieces = regex.compile(pattern).findall, {}, {}
        said = json.loads(content)
        before = said["pre_tokenizer"] or {}
        self.by_units = (said["normalizer"] is None and said["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
                         and before.get("use_regex", True) and not before.get("add_prefix_space", True)
                         and all(t["special"] for t in said["added_tokens"]) and said.get("truncation") is None)
        # a word of Latin letters, with a mark of one character behind it or none
        self.word = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)").fullmatch

    def piece(self, p: str) -> list[int]:
        """Ids of one pre-token."""
        plain = p.isascii() and p.isprintable()
        mapped = p.replace(" ", self.chars[32]) if plain else p.encode().decode("latin-1").translate(self.chars)
        found = [t.id for t in self.model.tokenize(mapped)]
        if len(p) < 64:
            self.pieces[p] = found
        return found

    def unit(self, u: str) -> list[int]:
        m, pieces = self.word(u), self.pieces
        if not m:
            return [i for p in self.cut(u) for i in pieces.get(p) or self.piece(p)]
        word, mark = m.groups()
        ids = pieces.get(word) or self.piece(word)
        return ids + (pieces.get(mark) or self.piece(mark)) if mark else ids

    def regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without neighbouring white space, one after the other, and how many each text has."""
        marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{UNITS} "), "\n", f"{UNITS}\n{UNITS}")
        cut = pc.split_pattern(marked, UNITS)
        numbers = cut.values.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known, self.pieces = {}, {}
        known, lists = self.known, []
        for u in numbers.dictionary.to_pylist():
            ids = known.get(u)
            if ids is None:
                ids = self.unit(u)
                if len(u) < 64:
                    known[u] = ids
            lists.append(ids)
        at = numbers.indices.to_numpy()
        of_unit = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(of_unit) - of_unit
        n = of_unit[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        flat = np.array(list(chain.from_iterable(lists)), np.uint32)
        ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(total)]
        return ids, np.diff(np.concatenate([[0], ends])[cut.offsets.to_numpy()])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False) if self.by_units else np.ones(len(texts), bool)
        ids, n = self.regular(texts.filter(pa.array(~odd)))
        if not odd.any():
            return ids, n
        whole = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        others, both = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else []), iter(whole)
        lists = [next(both) if o else next(others) for o in odd]
        return np.concatenate(lists), np.array([len(x) for x in lists])


# -- files

def opened(uri: str) -> tuple[files.FileSystem, str]:
    """Arrow's file system and the path there for a folder or file, named as Spark names it."""
    scheme, _, path, *_ = urlsplit(uri)
    if scheme in ("", "file"):
        return files.LocalFileSystem(), path
    return files.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def little(a: np.ndarray) -> bytes:
    return (a.byteswap() if sys.byteorder == "big" else a).tobytes()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes the ids of all documents to files in ``folder``; returns the manifest (part, path, n_docs, n_ids)."""
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    pattern = public_tokenizers.PATTERN
    largest = max(end, *json.loads(content)["model"]["vocab"].values(), *(t["id"] for t in json.loads(content)["added_tokens"]))
    kind = np.uint16 if largest < 1 << 16 else np.uint32

    def work(batches):
        part, out, encode = TaskContext.get().partitionId(), None, None
        lengths, own, missing, n_ids = [], [], 0, 0
        for b in by_bytes(batches, "_text", MOST_BYTES):
            if out is None:
                system, base = opened(folder)
                system.create_dir(base, recursive=True)
                path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                out, encode = system.open_output_stream(path), Encoder(content, pattern)
            ids, n = encode(b.column("_text"))
            out.write(little(np.insert(ids, np.cumsum(n), end).astype(kind)))
            n_ids += len(ids) + len(n)
            lengths.append(n + 1)
            missing += b.column("doc_id").null_count
            own.append(b.column("doc_id").drop_null().to_numpy())
        if out is None:
            return
        ends, own = np.cumsum(np.concatenate(lengths)), np.concatenate(own)
        least = int(own[0]) if len(own) else 0
        shifted = own.view(np.uint64) - np.array(least, np.int64).view(np.uint64)
        bounds = fano(ends.astype(np.uint64), n_ids + 1)
        names = fano(shifted, int(shifted[-1]) + 1 if len(own) else 1)
        out.write(bounds + names + struct.pack(FOOTER, MARK, VERSION, kind().itemsize, len(ends), missing, least, n_ids, len(bounds), len(names)))
        out.close()
        name = path if "://" not in folder else f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_docs": [len(ends)], "n_ids": [n_ids]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("_text"),
                       F.xxhash64(text_of()).alias("_tie"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "_text")
    return written(ranges.mapInArrow(work, MANIFEST))


class TokenFile:
    """One file of ids, open for reading."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.data = system.open_input_file(inner)
        size = self.data.size()
        footer = struct.calcsize(FOOTER)
        mark, version, self.width, self.n_docs, self.missing, self.least, self.n_ids, of_bounds, of_names = struct.unpack(
            FOOTER, self.data.read_at(footer, size - footer))
        if (mark, version) != (MARK, VERSION):
            raise ValueError(f"{path} is no file of token ids")
        both = self.data.read_at(of_bounds + of_names, size - footer - of_bounds - of_names)
        self.bounds, self.names = Fano(both[:of_bounds]), Fano(both[of_bounds:])

    def __len__(self) -> int:
        return self.n_docs

    def start(self, k: int) -> int:
        """Where document ``k`` of this file begins."""
        return self.bounds[k - 1] if k else 0

    def doc_id(self, k: int) -> int | None:
        return None if k < self.missing else self.least + self.names[k - self.missing]

    def span(self, first: int, last: int) -> np.ndarray:
        """Ids from one offset up to another."""
        raw = self.data.read_at((last - first) * self.width, first * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def ids(self, k: int) -> np.ndarray:
        return self.span(self.start(k), self.bounds[k])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.missing + [self.least + int(x) for x in self.names.all()]

    def close(self) -> None:
        self.data.close()


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all files before; its only row order is that of files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; a task for each file."""
    def work(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                f = TokenFile(path)
                ends, names = f.bounds.all().astype(np.int64), f.doc_ids()
                starts = np.concatenate([[0], ends[:-1]])
                k = 0
                while k < len(ends):
                    upto = max(k + 1, int(np.searchsorted(ends, starts[k] + MOST_BYTES // 4, "right")))
                    raw = memoryview(little(f.span(int(starts[k]), int(ends[upto - 1])).astype(np.uint32)))
                    at = ((starts[k:upto] - starts[k]) * 4).tolist()
                    sums = [zlib.crc32(raw[x:y]) for x, y in zip(at, [*at[1:], len(raw)])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[k:upto], pa.int64()), pa.array(starts[k:upto] + start), pa.array((ends - starts)[k:upto]), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = upto
                f.close()

    parts = max(manifest.count(), 1)
    spread = located(manifest).repartitionByRange(parts, "part").select("path", "start")
    return spread.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark, sf_dir):
    return read_tokens(write_tokens(documents(spark, sf_dir), new_folder(spark, "ids")))
