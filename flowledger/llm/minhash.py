"""Near-duplicates by the Jaccard similarity of word shingles: candidates by SimHash, then by MinHash bands, links by the
exact value.

SimHash comes first: fingerprints of the same shingles within simhash.BITS bits meet at anchor points, and their texts are
checked. It can't find all: at a similarity of 0.8 fingerprints differ in about 10 of 64 bits, with a deviation of 3, and
a covering for 16 bits has anchors that hold much of the table. For the rest, those linked by SimHash counting as one, a text has BANDS keys, each the hash of ROWS minimums;
two texts with the similarity s meet under some key with the probability 1 - (1 - s^5)^20: 0.9996 at 0.8, all but never
below 0.2. Under a key all pairs are compared by a sketch of one byte for each minimum, and those that may be similar are
reduced to a forest in the order of the sketches' agreement. Every pair of a forest is then checked on the two texts
themselves, so that no text is linked below the threshold. A pair that fails may have stood for others: so the groups that
one touches, those linked by now as one, are compared once more. There the texts' shingles themselves meet under the keys,
every pair of two groups that may be similar is checked where it meets, and only links come out: as many pairs can fail as
a key has, but no row is made of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowledger.llm import simhash
from flowledger.llm.components import components
from flowledger.llm.scratch import keep, lean

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Agreeing bytes of a sketch, of BANDS * ROWS, from which a pair is a candidate: at 0.8, four deviations below the mean.
AGREE = 64
#: Texts at home under one key that are held in memory together; more are split.
HOMES = 8192
#: Pairs compared at once, and candidates held before they are reduced to a forest.
PAIRS, LINKS = 1 << 14, 1 << 18
#: Bytes of shingles at home under one key that are held in memory together, about.
HELD = 32 << 20
#: Texts in candidate pairs, of 16 bytes each, that are broadcast at most.
FEW = 1_000_000

_digest = partial(xxhash.xxh64_intdigest, seed=7)
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None]
_MUL = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)[:, None] | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, in order; a shorter text is one shingle, one without words has none."""
    w = (text or "").encode().lower().split()  # on bytes, as for fingerprints
    if not w:
        return np.empty(0, np.uint64)
    whole = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(_digest, whole), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two results of ``shingles``; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similarities(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """``similarity`` of one result of ``shingles`` and each of ``others``, none of which is empty."""
    sizes, flat = np.array([len(b) for b in others]), np.concatenate(others)
    same = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
    both = np.add.reduceat(same, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both / (len(a) + sizes - both)


def signature(h: np.ndarray) -> tuple[bytes, list[int]]:
    """(sketch, keys of the bands) of some shingles; without any, the largest minimums."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, ((h[None, at : at + 1024] ^ _XOR) * _MUL).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), seed=k) for k in range(BANDS)]
    return (least * _MIX >> np.uint64(56)).astype(np.uint8).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


def _signatures(words: int, parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        rows = []
        for x in texts:
            h = shingles(x, words)
            code = int(np.uint64(simhash.fingerprint(x, words)).astype(np.int64))
            rows.append((int(np.uint64(_digest(h.tobytes())).astype(np.int64)), *signature(h), code))
        yield pd.DataFrame(rows, columns=["fp", "sketch", "keys", "code"])


def forests(a: np.ndarray, b: np.ndarray, agree: np.ndarray, times: int) -> np.ndarray:
    """Places of the pairs that make a spanning forest, then one of the others, and so on, so many ``times``."""
    taken, left = [], np.arange(len(a))
    for _ in range(times):
        k = spanning(a[left], b[left], agree[left])
        taken.append(left[k])
        left = np.delete(left, k)
        if not len(left):
            break
    return np.concatenate(taken)


def spanning(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) that make a spanning forest, those that agree more being taken first."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label, taken = np.arange(len(nodes)), []
    for level in np.unique(agree)[::-1]:
        e = np.flatnonzero(agree == level)
        while True:
            x, y = label[u[e]], label[v[e]]
            e, x, y = e[x != y], x[x != y], y[x != y]
            if not len(e):
                break
            high, first = np.unique(np.maximum(x, y), return_index=True)
            taken.append(e[first])
            up = np.arange(len(nodes))
            up[high] = np.minimum(x, y)[first]  # always to a smaller label, so no pair closes a ring
            while not np.array_equal(up, up[up]):
                up = up[up]
            label = up[label]
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """For each batch its rows, and the pairs (x, y) of their places that meet: each row and every home before it in its
    group, some PAIRS at once. Rows come sorted by group, those at home first; the homes of the last group are carried from
    one batch to the next, and stand before its rows."""
    held = None
    for pdf in batches:
        if pdf.empty:
            continue
        n0 = 0 if held is None else len(held)
        rows = pd.concat([held, pdf], ignore_index=True) if n0 else pdf
        key, home = rows[["anchor", "chunk"]].to_numpy(np.int64), rows["home"].to_numpy(bool)
        new = np.r_[True, (key[1:] != key[:-1]).any(1)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        before = np.cumsum(home) - home
        prior = before - before[first]
        prior[:n0] = 0  # compared in an earlier batch
        yield rows, _steps(first, prior)
        held = rows.iloc[np.flatnonzero(home[first[-1] :]) + first[-1]]


def _steps(first: np.ndarray, prior: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each place with the ``prior`` places that follow its group's ``first``."""
    rows = np.flatnonzero(prior)
    ends = np.cumsum(prior[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        r, p = rows[at:to], prior[rows[at:to]]
        x = np.repeat(r, p)
        yield x, np.repeat(first[r], p) + np.arange(len(x)) - np.repeat(np.cumsum(p) - p, p)
        at = to


def _sketches(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, BANDS * ROWS)


def _compare(times: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates of each group, reduced to ``times`` forests of labels. Pairs of one label, and those named in ``failed``,
    which lists texts by the larger of both, are no candidates."""
    found = [np.empty(0, np.int64)] * 5
    more: list[tuple] = []
    count, failed = 0, {}

    def reduced() -> list[np.ndarray]:
        a, b, n, x, y = (np.concatenate([x, *y]) for x, y in zip(found, zip(*more, strict=True) if more else ((),) * 5, strict=True))
        k = forests(x, y, n, times)
        return [z[k] for z in (a, b, n, x, y)]

    for rows, steps in _met(batches):
        fp, label, sk = rows["fp"].to_numpy(), rows["label"].to_numpy(), _sketches(rows)
        failed |= {u: set(map(int, v)) for u, v in zip(rows["fp"], rows["failed"], strict=True) if v is not None and len(v)}
        for x, y in steps:
            same = (sk[x] == sk[y]).sum(1)
            hit = (same >= AGREE) & (label[x] != label[y])
            if failed and hit.any():
                h = np.flatnonzero(hit)
                a, b = np.maximum(fp[x[h]], fp[y[h]]), np.minimum(fp[x[h]], fp[y[h]])
                hit[h] = [v not in failed.get(u, ()) for u, v in zip(a.tolist(), b.tolist(), strict=True)]
            if hit.any():
                x, y, same = x[hit], y[hit], same[hit]
                more.append((fp[x], fp[y], same, label[x], label[y]))
                count += len(x)
                if count > LINKS + len(found[0]):
                    found, more, count = reduced(), [], 0
    a, b, _, x, y = reduced()
    if len(a):
        yield pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b), "lu": np.where(a > b, x, y), "lv": np.where(a > b, y, x)})


def candidates(texts: DataFrame, times: int = 1) -> DataFrame:
    """Pairs (u, v, lu, lv), u > v, with their labels, of the distinct texts (long fp, binary sketch, array<long> keys, long label, array<long> failed)
    that may be similar: of all pairs under one key that have different labels and haven't failed, ``times`` forests. A key
    with more than HOMES texts is split into chunks, and all its texts meet each."""
    rows = texts.select("fp", "sketch", "label", "failed", F.explode("keys").alias("anchor"))
    sizes = keep(texts.select(F.explode("keys").alias("anchor")).groupBy("anchor").count().where("count > 1"), "keys")
    live = sizes.select("anchor", F.ceil(F.col("count") / HOMES).cast("int").alias("chunks"))
    rows = rows.join(live, "anchor")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.select("anchor", "fp", "sketch", "label", "failed", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = rows.select("anchor", "chunk", "fp", "sketch", "label", "failed", (F.col("own") == F.col("chunk")).alias("home"))
    rows = rows.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home"))
    return rows.mapInPandas(partial(_compare, times), "u long, v long, lu long, lv long").distinct()


def _link(least: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A forest of the labels of which texts that meet are similar, each pair being checked on the shingles unless its labels
    are linked already."""
    up: dict[int, int] = {}
    found = []

    def root(label: int) -> int:
        while (to := up.get(label, label)) != label:
            up[label] = label = up.get(to, to)
        return label

    for rows, steps in _met(batches):
        label, sk = rows["label"].to_numpy(), _sketches(rows)
        own, sets = label.tolist(), [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        n = np.array([len(a) for a in sets])
        for x, y in steps:
            other = label[x] != label[y]
            x, y = x[other], y[other]
            may = (np.minimum(n[x], n[y]) / np.maximum(np.maximum(n[x], n[y]), 1) >= least) & ((sk[x] == sk[y]).sum(1) >= AGREE)
            x, y = x[may], y[may]
            for i, them in zip(np.unique(x).tolist(), np.split(y, np.flatnonzero(np.diff(x)) + 1), strict=False):
                mine = root(own[i])
                apart = [j for j in them.tolist() if root(own[j]) != mine]
                if not apart:
                    continue
                for j in np.array(apart)[similarities(sets[i], [sets[j] for j in apart]) >= least].tolist():
                    if (a := root(own[i])) != (b := root(own[j])):
                        up[max(a, b)] = min(a, b)
                        found.append((max(own[i], own[j]), min(own[i], own[j])))
    if found:
        yield pd.DataFrame(found, columns=["u", "v"])


def links(texts: DataFrame, shingled: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v), u > v, that connect the labels of ``texts`` (long fp, binary sketch, array<long> keys, long label) as all
    similar pairs of different labels under one key would. ``shingled`` (fp, shingles, size) has their shingles.

    Under a key, texts of the label that has most there meet the others alone, who are at home, in chunks of HOMES of them
    and HELD bytes: a large group costs no more than its pairs with other groups. A key of one label is left out."""
    met = texts.select("fp", "label", F.explode("keys").alias("anchor"))
    part = met.join(shingled.select("fp", "size"), "fp").groupBy("anchor", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    most = F.max(F.struct("n", "label", "size"))
    sums = part.groupBy("anchor").agg(most.alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("n > most.n")
    chunks = F.greatest(F.ceil((F.col("n") - F.col("most.n")) / HOMES), F.ceil((F.col("size") - F.col("most.size")) / HELD), F.lit(1)).cast("int")
    live = keep(sums.select("anchor", F.col("most.label").alias("main"), chunks.alias("chunks")), "keys")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = met.join(live, "anchor").select("anchor", "fp", "label", "main", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    rows = rows.select("anchor", "chunk", "fp", "label", ((F.col("own") == F.col("chunk")) & (F.col("label") != F.col("main"))).alias("home"))
    rows = rows.join(texts.select("fp", "sketch").join(shingled.select("fp", "shingles"), "fp"), "fp")
    rows = rows.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home"))
    return rows.mapInPandas(partial(_link, similarity), "u long, v long").distinct()


def _shingled(words: int, parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series([shingles(x, words).tobytes() for x in texts])


def _similar(words: int, least: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = lru_cache(64)(partial(shingles, words=words))
    for pdf in batches:
        ok = [similarity(known(a), known(b)) >= least for a, b in zip(pdf["a"], pdf["b"], strict=True)]
        yield pdf.drop(columns=["a", "b"]).assign(ok=ok)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, text_hash, fp, root, component_id) for each row of ``docs``, as simhash.near_duplicates gives them; ``fp`` is
    the hash of the set of shingles, and two texts are linked where their sets' similarity is at least ``similarity``.

    Texts without words are alike. ``similarity`` below SIMILARITY loses pairs: AGREE and the bands are made for that.
    """
    lean(docs.sparkSession)
    sign = F.pandas_udf(partial(_signatures, words), "fp long, sketch binary, keys array<long>, code long", F.PandasUDFType.SCALAR_ITER)
    rows = docs.select(F.col(id_col), F.xxhash64(text).alias("text_hash"), sign(F.col(text)).alias("s"))
    signed = keep(rows.select(id_col, "text_hash", "s.*"), "signatures")
    first = keep(signed.groupBy("fp").agg(F.min(id_col).alias("first"), F.min("text_hash").alias("text_hash"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys"), F.min("code").alias("code")), "distinct")
    roots = _roots(docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("t")), first, words, similarity)
    return simhash.grouped(signed.select(id_col, "text_hash", "fp"), first.select("fp", "first"), roots, id_col)


def _texts(docs: DataFrame, some: DataFrame) -> DataFrame:
    """(fp, t): a text of each fp of ``some`` (fp, text_hash)."""
    few = F.broadcast(some) if some.count() <= FEW else some
    return docs.join(few, "text_hash").dropDuplicates(["fp"]).select("fp", "t")


def _checked(docs: DataFrame, first: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs``, and in ``ok`` whether they are similar."""
    some = keep(first.join(pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct(), "fp", "left_semi").select("fp", "text_hash"), "some")
    plain = keep(_texts(docs, some), "texts")
    both = pairs.join(plain.toDF("u", "a"), "u").join(plain.toDF("v", "b"), "v").select(*pairs.columns, "a", "b")
    return keep(both.mapInPandas(partial(_similar, words, similarity), "".join(f"{c} long, " for c in pairs.columns) + "ok boolean"), "checked")


def _close(first: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of texts that SimHash takes for near-duplicates: each text with the least of its fingerprint, and
    that with the least of the fingerprints that it is linked to."""
    least = keep(first.groupBy("code").agg(F.min("fp").alias("least")), "codes")
    own = first.join(least, "code").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    found = keep(simhash.links(least.select(F.col("code").alias("fp"))), "links")
    other = found.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v").select("a", "b")
    return own.unionAll(other).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _roots(docs: DataFrame, first: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, root) for every text but the smallest of its group: what SimHash finds and the texts confirm, then what bands
    find. Between two texts of different groups no pair may be left that a key brings together, that agrees enough, and
    that has not been checked. After a forest of these, only the groups that a failed pair touches are compared in full: a
    forest joins all groups that have candidates between them, so where two of them stay apart, a pair has failed at each."""
    seen = _checked(docs, first, keep(_close(first), "close"), words, similarity)
    roots = components(seen.where("ok"))
    failed = seen.where("not ok").groupBy(F.col("u").alias("fp")).agg(F.collect_set("v").alias("failed"))
    texts = first.join(roots.withColumnRenamed("u", "fp"), "fp", "left").join(failed, "fp", "left")
    texts = keep(texts.select("fp", "text_hash", "sketch", "keys", F.coalesce("root", "fp").alias("label"), "failed"), "active")
    pairs = keep(candidates(texts), "candidates")
    if pairs.isEmpty():
        return roots
    seen = _checked(docs, first, pairs, words, similarity)
    merged = components(seen.where("ok").select(F.col("lu").alias("u"), F.col("lv").alias("v")))
    roots = _joined(roots, merged)
    bad = seen.where("not ok").select(F.explode(F.array("lu", "lv")).alias("u")).distinct()
    torn = keep(bad.join(merged, "u", "left").select(F.coalesce("root", "u").alias("root")).distinct(), "torn")
    if torn.isEmpty():
        return roots
    old = merged.join(torn, "root", "left_semi").select("u", "root").unionAll(torn.select(F.col("root").alias("u"), "root"))
    active = keep(texts.join(old.toDF("label", "to"), "label").select("fp", "text_hash", "sketch", "keys", F.col("to").alias("label")), "active")
    cut = F.pandas_udf(partial(_shingled, words), "binary", F.PandasUDFType.SCALAR_ITER)
    sets = _texts(docs, active.select("fp", "text_hash")).select("fp", cut("t").alias("shingles"))
    shingled = keep(sets.select("fp", "shingles", F.length("shingles").alias("size")), "shingles")
    return _joined(roots, components(links(active, shingled, similarity)))


def _joined(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """``roots`` (u, root) after groups have been joined to others: ``merged`` (u, root) has their smallest texts."""
    now = merged.toDF("root", "to")
    return keep(roots.join(now, "root", "left").select("u", F.coalesce("to", "root").alias("root")).unionAll(merged), "roots")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, as simhash.first_of_each takes it."""
    return simhash.first_of_each(docs, near_duplicates(docs, id_col, text, words, similarity), id_col, text)
