"""Best-fit decreasing packing of tokenized documents into sequences of a fixed length.

Best-fit decreasing looks at lengths only, and there are no more lengths than tokens in a sequence. So the plan is made
from the histogram of lengths: a segment tree over remaining capacities gives, in logarithmic time, the tightest open
sequences that take the next length, and a whole run of equal lengths goes there at once. This is exactly the outcome of
placing document by document. The plan is a table of runs whose number depends on the sequence length, not on the number
of documents. Each piece then finds its place from its length and its rank among the pieces of that length, which is
taken within salted groups, so that no length needs to meet in one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep, lean

CAPACITY = 2048
#: Groups into which the pieces of one length are dealt for ranking: so many at least, and one for so many pieces.
SALTS, SALTED = 256, 50_000
#: Bytes of word forms and their ids that a worker remembers, about; when there are more it starts anew.
REMEMBERED = 320 << 20

_ODD = "\x1c\x1d\x1e\x1f"
#: White space in Unicode, which is what the vocabulary's splitting pattern drops.
_SPACE = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: The vocabulary's splitting pattern on lower-case Latin-1 text, with its letters and numbers spelt out.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def _visible() -> dict[int, str]:
    """Byte-level vocabularies show a byte as a printable character: itself, or the next one from 256 on if it is none."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class Words(dict):
    """Ids by white-space separated part of a text, learned as they are asked for.

    The vocabulary's normalizer and splitting pattern work on each such part alone, so a text's ids are those of its
    parts, one after the other; a part is looked up once and then remembered. Parts of Latin-1 characters, which the
    normalizer only makes lower-case, are split here, and each piece goes to the vocabulary's model; other parts go
    through the whole tokenizer, and so do whole texts that hold one of its special tokens. Ids are little-endian 32-bit
    numbers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.base = Tokenizer.from_file(path)
        self.model, self.visible = self.base.model, _visible()
        self.special = [x.content for x in self.base.get_added_tokens_decoder().values()]
        self.number = [struct.pack("<I", i) for i in range(self.base.get_vocab_size())]
        self.pieces: dict[str, bytes] = {}
        self.size = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.size > REMEMBERED:
            self.clear()
            self.pieces.clear()
            self.size = 0
        return [b"".join(map(self.__getitem__, self._parts(x))) if not any(t in x for t in self.special) else self._whole(x) for x in texts]

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.number.__getitem__, self.base.encode(text, add_special_tokens=False).ids))

    def _parts(self, text: str) -> list[str]:
        if _latin(text):
            text = text.lower()
        return _SPACE.findall(text) if any(x in text for x in _ODD) else text.split()

    def __missing__(self, x: str) -> bytes:
        if x.isascii() and x.isalpha() and x.islower():
            found = self._piece(x)
        else:
            found = b"".join(map(self._piece, _SPLIT.findall(x.lower()))) if _latin(x) else self._whole(x)
            self.size += 200 + len(x) + len(found)
        self[x] = found
        return found

    def _piece(self, x: str) -> bytes:
        found = self.pieces.get(x)
        if found is None:
            shown = x if x.isascii() and x.isalpha() else x.encode().decode("latin-1").translate(self.visible)
            found = self.pieces[x] = b"".join([self.number[t.id] for t in self.model.tokenize(shown)])
            self.size += 350 + len(x) + len(found)
        return found


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def _pieces(path: str, capacity: int, end: int, texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tail, step = np.array([end], "<u4").tobytes(), 4 * capacity
    for part in texts:
        rows: list[list[dict]] = []
        for at in range(0, len(part), 256):
            for ids in words(path).encode([x or "" for x in part.iloc[at : at + 256]]):
                ids += tail
                rows.append([{"length": len(ids[k : k + step]) // 4, "ids_crc32": zlib.crc32(ids[k : k + step])} for k in range(0, len(ids), step)])
        yield pd.Series(rows)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the id ``end``, cut where longer than ``capacity``."""
    kind = F.pandas_udf(partial(_pieces, vocabulary, capacity, end), "array<struct<length: bigint, ids_crc32: bigint>>", F.PandasUDFType.SCALAR_ITER)
    rows = docs.select(F.col(id_col), F.posexplode(kind(F.col(text))).alias("piece", "p"))
    return rows.select(id_col, "piece", (F.col("piece").cast("long") * capacity).alias("start"), "p.length", "p.ids_crc32")


class Capacities:
    """Segment tree over remaining capacities 0..n: the tightest one that is open and at least as large as asked."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [False] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]

    def _mark(self, r: int) -> None:
        at = r + self.size
        self.open[at] = bool(self.groups[r])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def put(self, r: int, first: int, count: int) -> None:
        if r and count:
            self.groups[r].append((first, count))
            self._mark(r)

    def take(self, r: int) -> tuple[int, int]:
        got = self.groups[r].pop()
        self._mark(r)
        return got

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        while not self.open[at]:
            while at & 1:  # a right child: go up until there is a right neighbour
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``histogram`` (pieces by length) as runs (length, first rank, ranks, first sequence, pieces
    of the run in each sequence, offset of the first of them there)."""
    tree, runs, sequences = Capacities(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            r = tree.tightest(length)
            if r is None:
                r = capacity
                first, count = sequences, -(-left // (capacity // length))
                sequences += count
            else:
                first, count = tree.take(r)
            each = r // length
            used = min(count, -(-left // each))
            tree.put(r, first + used, count - used)
            full, rest = divmod(min(left, used * each), each)
            for bins, n, at in ((full, each, first), (1, rest, first + full)):
                if bins and n:
                    runs.append((length, rank, bins * n, at, n, capacity - r))
                    tree.put(r - n * length, at, bins)
                    rank, left = rank + bins * n, left - bins * n
    return runs


def stretches(histogram: dict[int, int], runs: list[tuple[int, int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple]]:
    """(length, width) and (length, stretch, run): the ranks of each length are cut into as many stretches of equal width
    as it has runs, and a run is listed under all that it touches. So a rank needs to meet only its stretch's runs, two
    on average."""
    number = Counter(r[0] for r in runs)
    width = {length: -(-n // number[length]) for length, n in histogram.items()}
    touched = [(r[0], s, *r[1:]) for r in runs for s in range(r[1] // width[r[0]], (r[1] + r[2] - 1) // width[r[0]] + 1)]
    return list(width.items()), touched


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    A null or blank text is the id ``end`` alone. Repeated rows are packed each; equal pieces of equal ids may swap
    places between runs. An empty table gives no rows.
    """
    lean(docs.sparkSession)
    spark = docs.sparkSession
    cut = keep(pieces(docs, vocabulary, capacity, end, id_col, text), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    salts = max(SALTS, -(-max(histogram.values(), default=0) // SALTED))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    by = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(by) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("k") + F.col("base"))
    # the runs depend on the capacity alone, some tens of thousands at most, and so do their stretches
    widths, runs = stretches(histogram, plan(histogram, capacity))
    widths = spark.createDataFrame(widths, "length long, width long")
    runs = spark.createDataFrame(runs, "length long, stretch long, r0 long, ranks long, s0 long, each long, o0 long")
    near = ranked.join(F.broadcast(widths), "length").withColumn("stretch", F.expr("rank div width")).join(F.broadcast(runs), ["length", "stretch"])
    found = near.where("rank >= r0 and rank < r0 + ranks").withColumn("t", F.col("rank") - F.col("r0"))
    place = (F.col("o0") + F.col("t") % F.col("each") * F.col("length")).alias("offset")
    return found.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("s0") + F.expr("t div each")).alias("sequence_id"), place)
