"""Byte-level BPE by monoid tree reduction.

A text is encoded by encoding its halves and joining the two results. Near the cut both results may be wrong, so the join
re-encodes a window around it and keeps the tokens outside. A window is stable when both its edges are places where a
non-space is followed by white space, because every alternative of the pattern either takes no white space after a
non-space or takes white space alone: no match spans such a place, so a match starts there whatever stands around it, and
the tokens on its two sides don't depend on each other. The window grows until it has such edges, if need be to both
whole parts; at most log2(length) joins touch a character, so even a text without white space costs no more than
n log n. Decoding concatenates the bytes of the two halves of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm.scratch import lean

#: Characters of a text, and ids of a list, that are handled without halving: some dozens of tokens.
LEAF, LEAF_IDS = 128, 64
#: First length of the window on each side of a cut.
WINDOW = 32

_EDGE = re.compile(r"(?<=\S)(?=\s)")
#: White space to Python's ``re`` but not to the pattern, whose ``\s`` is Unicode's White_Space.
_ODD = re.compile("[\x1c-\x1f]")


class Codec:
    """Encoder and decoder for one file of ranks (base64 token, space, rank) and one splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.base = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {r: t for t, r in ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= LEAF:
            return self.base.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a, b = self._before(text, lo, mid), self._after(text, mid, hi)
        return left[: self._count(left, text[a:mid], -1)] + self.base.encode_ordinary(text[a:b]) + right[self._count(right, text[mid:b], 1) :]

    def _before(self, text: str, lo: int, mid: int) -> int:
        """The last edge before the cut, looked for in a growing window; the part's start if it has none."""
        size = WINDOW
        while mid - size > lo:
            at = mid
            while (at := text.rfind(" ", mid - size + 1, at)) > 0:  # most edges are blanks
                if not text[at - 1].isspace():
                    return at
            found = [m.start() for m in _EDGE.finditer(text, mid - size, mid) if mid - size < m.start() < mid and not _ODD.search(text, m.start() - 1, m.start() + 1)]
            if found:
                return found[-1]
            size *= 2
        return lo

    def _after(self, text: str, mid: int, hi: int) -> int:
        """The first edge after it, or the part's end."""
        size = WINDOW
        while mid + size < hi:
            at = mid
            while (at := text.find(" ", at + 1, mid + size)) > 0:
                if not text[at - 1].isspace():
                    return at
            found = next((m.start() for m in _EDGE.finditer(text, mid + 1, mid + size) if m.start() > mid and not _ODD.search(text, m.start() - 1, m.start() + 1)), None)
            if found is not None:
                return found
            size *= 2
        return hi

    def _count(self, ids: list[int], part: str, step: int) -> int:
        """Index in ``ids`` of the token border that cuts ``part`` off their end (step -1) or start (step 1)."""
        left, at = len(part.encode()), len(ids) if step < 0 else 0
        while left > 0:
            left -= len(self.bytes[ids[at - 1 if step < 0 else at]])
            at += step
        return at

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def _encoded(ranks_path: str, pattern: str, texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    c = codec(ranks_path, pattern)
    for part in texts:
        yield pd.Series([c.encode(x or "") for x in part])


def _decoded(ranks_path: str, pattern: str, ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
    c = codec(ranks_path, pattern)
    for part in ids:
        yield pd.Series([c.decode(list(x)) if x is not None else b"" for x in part])


def _digests(ranks_path: str, pattern: str, texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    c = codec(ranks_path, pattern)
    for part in texts:
        rows = []
        for x in part:
            ids = c.encode(x or "")
            rows.append((len(ids), hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text; null counts as empty, which has no ids. No shuffle."""
    lean(docs.sparkSession)
    kind = F.pandas_udf(partial(_encoded, ranks_path, pattern), "array<int>", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(ids, kind(F.col(text)))


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the ids stand for; null ids count as none."""
    kind = F.pandas_udf(partial(_decoded, ranks_path, pattern), "binary", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(out, kind(F.col(ids)))


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded, as digests.

    One row for each row, repeated ids included; a null text is an empty one.
    """
    lean(docs.sparkSession)
    kind = F.pandas_udf(partial(_digests, ranks_path, pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string", F.PandasUDFType.SCALAR_ITER)
    return docs.select(F.col(id_col), kind(F.col(text)).alias("d")).select(id_col, "d.*")
