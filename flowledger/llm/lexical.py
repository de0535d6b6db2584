"""Ranked lexical search with pair-bound MaxScore.

Documents are read once for the terms that the items ask for. From their postings an index of blocks is built and written:
for each term of a block its list of documents with impacts and the largest impact, and for each pair of terms that some
item pairs up their intersection list with the largest joint impact. An item's terms are paired by frequency, the rarest
two first, so that a pair seldom meets and its joint bound is far below the sum of both terms' own.

A search goes through the blocks of a partition. A pair adds to a document at most the largest of both terms' own maxima
and the joint maximum; the pairs with the least bounds, whose sum can't reach the k-th best score so far, are not
essential: only documents of the other pairs' lists are candidates, and they leave as soon as their score and the bounds
of the pairs to come, by intersection list the joint one, else the larger of both, stay below it. Each partition gives its
best few, of which the best of all are taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep, lean

TOP = 10
#: Of a block of the index: documents and postings at most, more only in a block of one document.
DOCUMENTS, POSTINGS = 8192, 1 << 19
#: Of one pass over the documents: distinct terms and items that it serves at most; more items take further passes.
TERMS, ITEMS = 1 << 19, 1 << 14
#: Parts in which an item's candidates are ranked first.
SALTS = 64

_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()

INDEX = "docs array<long>, terms array<int>, ends array<int>, places array<int>, impacts array<long>, pairs array<int>, joint array<long>, pair_ends array<int>, pair_places array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters and digits, of which ASCII's are lower-cased, and of other characters."""
    return text.translate(_PLAIN).split()


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def _postings(words: dict[bytes, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n, terms, tfs) of each document with a term: all its terms counted, those asked for with their frequencies."""
    for batch in batches:
        keepers, ns, terms, tfs = [], [], [], []
        for i, text in enumerate(batch.column(1)):
            found = terms_of(text.as_py() or b"")
            if found:
                t, c = np.unique(np.fromiter((k for w in found if (k := words.get(w)) is not None), np.int32), return_counts=True)
                keepers.append(i)
                ns.append(len(found))
                terms.append(t)
                tfs.append(c.astype(np.int32))
        columns = [batch.column(0).take(pa.array(keepers, pa.int32())), pa.array(ns, pa.int64()), _lists(terms, pa.int32()), _lists(tfs, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "terms", "tfs"])


def _block(docs: list, ns: list[int], terms: list, tfs: list, weights: np.ndarray, both: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """One row of the index; ``both``: the pairs of terms."""
    size = np.array([len(t) for t in terms])
    term, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.int64)
    place = np.repeat(np.arange(len(docs)), size)
    m = 10 + 90 * np.array(ns, np.int64) * n_docs // n_terms
    impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
    order = np.argsort(term, kind="stable")
    term, place, impact = term[order], place[order], impact[order]
    known, starts = np.unique(term, return_index=True)
    ends = np.append(starts[1:], len(term))
    at = np.full(len(weights), -1)
    at[known] = np.arange(len(known))
    here = np.flatnonzero((at[both[:, 0]] >= 0) & (at[both[:, 1]] >= 0))
    lists, joint = [], []
    for a, b in at[both[here]]:
        pa_, pb = place[starts[a] : ends[a]], place[starts[b] : ends[b]]
        k = np.minimum(np.searchsorted(pb, pa_), len(pb) - 1)
        met = pb[k] == pa_
        lists.append(pa_[met])
        joint.append(int((impact[starts[a] : ends[a]][met] + impact[starts[b] : ends[b]][k[met]]).max(initial=0)))
    return {
        "docs": docs, "terms": known, "ends": ends, "places": place, "impacts": impact, "pairs": here,
        "joint": joint, "pair_ends": np.cumsum([len(x) for x in lists]), "pair_places": np.concatenate(lists) if lists else [],
    }


def _index(weights: np.ndarray, both: np.ndarray, n_docs: int, n_terms: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, ns, terms, tfs, held = [], [], [], [], 0

    def out() -> pa.RecordBatch:
        row = _block(docs, ns, terms, tfs, weights, both, n_docs, n_terms)
        arrays = (pa.array(row[f.name], f.type.value_type) for f in schema)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays], schema=schema)

    for batch in batches:
        for i, n in enumerate(batch.column(1).to_pylist()):
            t = batch.column(2)[i].values.to_numpy()
            if not len(t):
                continue
            if docs and (len(docs) >= DOCUMENTS or held + len(t) > POSTINGS):
                yield out()
                docs, ns, terms, tfs, held = [], [], [], [], 0
            docs.append(batch.column(0)[i].as_py())
            ns.append(n)
            terms.append(t)
            tfs.append(batch.column(3)[i].values.to_numpy())
            held += len(t)
    if docs:
        yield out()


class Block:
    """A row of the index, ready for searches."""

    def __init__(self, row: dict, n_words: int, n_pairs: int):
        arrays = {k: np.asarray(v, np.int64) for k, v in row.items() if k != "docs"}
        self.docs, self.places, self.impacts, self.pair_places = row["docs"], arrays["places"], arrays["impacts"], arrays["pair_places"]
        self.span = np.zeros((n_words, 2), np.int64)
        self.span[arrays["terms"], 1] = arrays["ends"]
        self.span[arrays["terms"], 0] = np.append(0, arrays["ends"])[:-1]
        self.most = np.zeros(n_words, np.int64)
        if len(self.impacts):
            self.most[arrays["terms"]] = np.maximum.reduceat(self.impacts, self.span[arrays["terms"], 0])
        self.joint = np.zeros(n_pairs, np.int64)
        self.joint[arrays["pairs"]] = arrays["joint"]
        self.met = np.zeros((n_pairs, 2), np.int64)
        self.met[arrays["pairs"], 1] = arrays["pair_ends"]
        self.met[arrays["pairs"], 0] = np.append(0, arrays["pair_ends"])[:-1]

    def search(self, own: np.ndarray, both: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that score ``bar`` or more, by the pairs of terms ``both[own]``."""
        a, b = both[own].T
        apart = np.maximum(self.most[a], self.most[b])
        bound = np.maximum(apart, self.joint[own])
        order = np.argsort(bound, kind="stable")
        sums = np.cumsum(bound[order])
        first = int(np.searchsorted(sums, bar))  # the pairs before it reach less than ``bar`` together
        score, seen = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), bool)
        for u in order[first:]:
            for t in {int(a[u]), int(b[u])}:
                s, e = self.span[t]
                score[self.places[s:e]] += self.impacts[s:e]
                seen[self.places[s:e]] = True
        left = np.flatnonzero(seen)
        for k in range(first - 1, -1, -1):
            u = order[k]
            s, e = self.met[own[u]]
            tight = np.where(np.isin(left, self.pair_places[s:e]), self.joint[own[u]], apart[u]) if e > s else apart[u]
            left = left[score[left] + tight + (sums[k] - bound[u]) >= bar]
            if not len(left):
                break
            for t in {int(a[u]), int(b[u])}:
                s, e = self.span[t]
                if e > s:
                    at = np.minimum(np.searchsorted(self.places[s:e], left), e - s - 1) + s
                    score[left] += np.where(self.places[at] == left, self.impacts[at], 0)
        left = left[score[left] >= bar]
        return left, score[left]


def _search(top: int, items: list[np.ndarray], both: np.ndarray, n_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best: list[list[tuple]] = [[] for _ in items]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: c[i].values for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            block = Block(row | {"docs": row["docs"].to_pylist()}, n_words, len(both))
            for q, own in enumerate(items):
                bar = max(1, -best[q][top - 1][0]) if len(best[q]) >= top else 1
                places, scores = block.search(own, both, bar)
                if len(places):
                    found = ((-s, block.docs[p] is None, block.docs[p] or 0) for p, s in zip(places.tolist(), scores.tolist(), strict=True))
                    best[q] = sorted([*best[q], *found])[:top]
    rows = [(q, None if null else d, -s) for q, found in enumerate(best) for s, null, d in found]
    for i in range(0, len(rows), 10_000):
        q, d, s = zip(*rows[i : i + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], names=["q", "doc", "score"])


def _passes(items: DataFrame, item_col: str, text: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(item ids, their terms) for one pass over the documents after the other; items without a term have no result."""
    ids, terms, known = [], [], set()
    for i, t in items.select(F.col(f"`{item_col}`"), F.col(f"`{text}`").cast("binary")).toLocalIterator():
        own = sorted(set(terms_of(bytes(t or b""))))
        if own and ids and (len(ids) >= ITEMS or len(known) + len(own) > TERMS):
            yield ids, terms
            ids, terms, known = [], [], set()
        if own:
            ids.append(i)
            terms.append(own)
            known.update(own)
    if ids:
        yield ids, terms


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, doc id, score): each item's ``top`` documents with a score above 0, highest first.

    Ties go by ascending doc id, a null one last. Null, blank and empty texts have no term: such documents don't count and
    are not found, such items have no rows. Rows of equal ids are documents, or items, of their own. Texts of any length
    are read whole. Empty tables give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    lean(spark)
    result = None
    item_type = dict(items.dtypes)[item_col]
    for ids, terms in _passes(items, item_col, item_text):
        words = {w: k for k, w in enumerate(sorted(set().union(*terms)))}
        texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
        postings = keep(texts.mapInArrow(partial(_postings, words), "doc long, n long, terms array<int>, tfs array<int>"), "postings")
        n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # TERMS rows at most
            df[r["t"]] = r["n"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        asked = []
        for own in terms:
            k = sorted((words[w] for w in own), key=lambda t: (df[t], t))
            k += k[-1:] * (len(k) % 2)  # an odd one is paired with itself
            asked.append(np.array([pairs.setdefault((x, y), len(pairs)) for x, y in zip(k[::2], k[1::2], strict=True)]))
        both = np.array(list(pairs))
        for (a, b), k in pairs.items():
            both[k] = a, b
        schema = pa.schema([(f.split()[0], pa.list_(pa.int64() if "long" in f else pa.int32())) for f in INDEX.split(", ")])
        index = keep(postings.mapInArrow(partial(_index, weights, both, n_docs, n_terms, schema), INDEX), "index")
        found = index.mapInArrow(partial(_search, top, asked, both, len(words)), "q int, doc long, score long").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
        by = [F.desc("score"), F.asc_nulls_last("doc")]
        some = found.withColumn("k", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*by))).where(F.col("k") <= top)
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*by))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(ids)), f"q int, item {item_type}")  # ITEMS rows at most
        rows = best.join(F.broadcast(names), "q").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        result = rows if result is None else result.unionAll(rows)
    return spark.createDataFrame([], f"`{item_col}` {item_type}, rank int, `{id_col}` long, score long") if result is None else result
