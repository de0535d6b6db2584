"""Phrase collocations by dynamic itemset counting.

The texts are dealt into shards, which are scanned in turn, again and again; one step scans one shard and counts phrases of
all lengths together. A phrase of several words is looked out for from the step after both its subphrases (all but the last
word, all but the first) have reached the threshold, for one full cycle of shards; single words from the first step on. As
a phrase that reaches the threshold over all shards must reach that over the number of shards in one of them, only such
phrases are noted, and from there on counted exactly in every shard until they have completed one full cycle themselves.
So no step holds the counts of more than one shard, and a phrase activates longer ones as soon as its count so far is
enough, whatever the cycle. The scans end when nothing is open.

Which phrases are open is told to the tasks by a table of bytes at hashes of phrases, of 2 ** BITS bytes at most for any
corpus. Two phrases in one slot only make a task count a phrase in vain: counts go by the words' hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache, partial, reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowledger.llm.scratch import keep, lean, place

LONGEST, LEAST, TOP = 4, 30, 2000
#: Shards of a cycle.
SHARDS = 2
#: Bits of a slot's number: at least, at most, and bytes of text for which there is one slot in between. What a slot says:
#: reached, reached within the last cycle; being counted, in three slots of a phrase, so that few others seem to be.
FEWEST, BITS, SLOT_BYTES = 16, 26, 64
REACHED, FRESH = 1, 2
COUNTED = (4, 8, 16)
#: Phrases of a task that are counted together before they are shuffled, and bytes of text for which there is one part of
#: the phrases, of MOST parts at least.
TOGETHER, PART_BYTES, PARTS = 3_000_000, 16 << 20, 64
#: Parts in which a language's phrases are ranked first.
SALTS = 64

#: Longer words are hashed one by one, and so many bytes at once.
_LONG, _SLICE = 64, 1 << 18
_LOWER = bytes(range(256)).lower()
_KIND = bytes(2 if c in b".,;:!?\n\x0b\x0c\r" else 1 if c in b" \t" else 0 for c in range(256))
_KEY = [f"w{i}" for i in range(1, LONGEST + 1)]
_FACTS = "m int, " + ", ".join(f"{w} long" for w in _KEY) + ", k long, lang string, word string, c long"


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, and the powers of a random odd number and of its inverse, modulo 2 ** 64."""
    rng = np.random.default_rng(20)
    r = int(rng.integers(1 << 62)) * 2 + 1
    of = lambda x: np.multiply.accumulate(np.array([1] + [x] * _SLICE, np.uint64))
    return rng.integers(1, 1 << 63, 256, np.uint64), of(r), of(pow(r, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(columns: Sequence[np.ndarray]) -> np.ndarray:
    """One hash for each phrase, from its words' hashes."""
    k = columns[0]
    for w in columns[1:]:
        k = _mix(k * np.uint64(0x9E3779B97F4A7C15) + w)
    return k


def words(texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of all words of the texts: hash (of language and word), number of the piece and of the text, first byte and end in
    the lower-cased bytes, which come last."""
    raw = b"\n".join(texts).translate(_LOWER)
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    value, up, down = _powers()
    low, h = np.frombuffer(raw, np.uint8), np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, side="right")))
        first = starts[at]
        if ends[to - 1] - first <= _SLICE:
            own = value[low[first : ends[to - 1]]] * up[: ends[to - 1] - first]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
            h[at:to] = (sums[ends[at:to] - first] - sums[starts[at:to] - first]) * down[starts[at:to] - first]
        at = to
    for i in np.flatnonzero(ends - starts > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]])
    seed = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)
    return _mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + seed[text]), piece, text, starts, ends, raw


def _summed(columns: list[np.ndarray], counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal phrases together: order of the rows, where each phrase starts in it, its count, its hash."""
    k = _joined(columns)
    order = np.argsort(k, kind="stable")
    new = np.ones(len(k), bool)
    new[1:] = k[order][1:] != k[order][:-1]
    apart = np.zeros(len(k), bool)
    for c in columns:
        apart[1:] |= c[order][1:] != c[order][:-1]
    if (apart & ~new).any():  # phrases of one hash
        order = np.lexsort(columns)
        new = np.ones(len(k), bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(k))) if counts is None else np.add.reduceat(counts[order], first)
    return order, first, n, k[order][first]


def _bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes: the index of each, repeated where a count takes more than one byte, and the bytes."""
    times = (n - 1) // 255 + 1
    index = np.repeat(np.arange(len(n)), times)
    last = np.zeros(len(index), bool)
    last[np.cumsum(times) - 1] = True
    return index, np.where(last, n[index] - 255 * (times[index] - 1), 255).astype(np.uint8)


def _slot(k: np.ndarray, bits: int, i: int) -> np.ndarray:
    """The i-th slot of phrases, by their hashes."""
    return ((k >> np.uint64((64 - bits, 32 - bits // 2, 0)[i])) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _counted(table: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether phrases seem to be among those that are counted."""
    out = np.ones(len(k), bool)
    for i, flag in enumerate(COUNTED):
        at = np.flatnonzero(out)
        out[at] = table[_slot(k[at], len(table).bit_length() - 1, i)] & flag > 0
    return out


class Scan:
    """The phrases that a task has found and not yet sent off."""

    def __init__(self, parts: int, table: np.ndarray | None, open_: Sequence[int], everything: bool):
        self.parts, self.table, self.open, self.everything = parts, table, open_, everything
        self.clear()

    def clear(self) -> None:
        self.found: dict[int, list[list[np.ndarray]]] = {m: [] for m in range(1, LONGEST + 1)}
        self.held = 0
        self.strings: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # of words: hash, text bytes, languages

    def says(self, k: np.ndarray) -> np.ndarray:
        return self.table[_slot(k, len(self.table).bit_length() - 1, 0)]

    def add(self, texts: list[bytes], langs: list[str]) -> Iterator[tuple]:
        w, piece, text, starts, ends, raw = words(texts, langs)
        if not len(w):
            return
        if self.everything or 1 in self.open:
            one = np.arange(len(w)) if self.everything else np.flatnonzero(_counted(self.table, w))
            yield from self._words(w[one], text[one], starts[one], ends[one], raw, langs)
        if self.table is None:
            return
        below = self.says(w)
        k = w
        for m in range(2, LONGEST + 1):
            n = len(w) - m + 1
            if n <= 0:
                break
            k = _mix(k[:n] * np.uint64(0x9E3779B97F4A7C15) + w[m - 1 :])
            both, any_ = below[:n] & below[1 : n + 1], below[:n] | below[1 : n + 1]
            below = self.says(k)
            if m in self.open:
                whole = piece[:n] == piece[m - 1 :]
                wanted = whole & (both & REACHED > 0) & (any_ & FRESH > 0)
                rest = np.flatnonzero(whole & ~wanted)
                wanted[rest] = _counted(self.table, k[rest])
                at = np.flatnonzero(wanted)
                if len(at):
                    self.found[m].append([w[at + j] for j in range(m)])
                    self.held += len(at)
        if self.held >= TOGETHER:
            yield from self.sent()

    def _words(self, w: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes, langs: list[str]) -> Iterator[tuple]:
        """Words go out for each batch, with their letters."""
        if not len(w):
            return
        order, first, n, k = _summed([w], None)
        if np.any(np.diff((ends - starts)[order])[np.diff(w[order]) == 0]):
            raise ValueError("two words have one hash")
        lang = np.array([langs[i] for i in text[order[first]]], object)
        some = order[first]
        letters = [raw[s:e] for s, e in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
        part = (k % np.uint64(self.parts)).astype(np.int64)
        by = np.lexsort((part, lang.astype(str)))
        cut = np.flatnonzero(np.append(True, (part[by][1:] != part[by][:-1]) | (lang[by][1:] != lang[by][:-1])))
        for own in np.split(by, cut[1:]):
            payload = zlib.compress(b" ".join(letters[i] for i in own), 1)
            yield 1, int(part[own[0]]), lang[own[0]], len(own), k[own].tobytes() + n[own].astype(np.int64).tobytes() + payload

    def sent(self) -> Iterator[tuple]:
        for m, lists in self.found.items():
            if lists:
                columns = [np.concatenate(x) for x in zip(*lists, strict=True)]
                order, first, n, k = _summed(columns, None)
                index, counts = _bytes(n)
                columns = [c[order[first]][index] for c in columns]
                part = (k[index] % np.uint64(self.parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                cut = np.flatnonzero(np.append(True, part[by][1:] != part[by][:-1]))
                for own in np.split(by, cut[1:]):
                    yield m, int(part[own[0]]), None, len(own), b"".join(c[own].tobytes() for c in columns) + counts[own].tobytes()
        self.clear()


def _scan(parts: int, table: Broadcast | None, open_: Sequence[int], everything: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = Scan(parts, None if table is None else table.value, open_, everything)

    def packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for r in rows:
            held.append(r)
            size += len(r[4])
            if size > 4 << 20:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["m", "part", "lang", "n", "payload"])

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 4 << 20):
                size += len(texts[to])
                to += 1
            yield from packed(scan.add(texts[at:to], langs[at:to]))
            at = to
    yield from packed(scan.sent())


def _facts(least: int, table: Broadcast | None, everything: bool, pdf: pd.DataFrame) -> pd.DataFrame:
    """Counts of a part's phrases in this shard: those that may reach the threshold, or are being counted. Of words that
    are all counted also their sums by language, as m = 0."""
    out = []
    for m, rows in pdf.groupby("m"):
        columns: list[list] = [[] for _ in range(m)]
        counts, letters, langs = [], [], []
        for n, lang, payload in zip(rows["n"], rows["lang"], rows["payload"], strict=True):
            for j in range(m):
                columns[j].append(np.frombuffer(payload, np.uint64, n, 8 * n * j))
            counts.append(np.frombuffer(payload, np.int64 if m == 1 else np.uint8, n, 8 * n * m).astype(np.int64))
            if m == 1:
                letters += zlib.decompress(payload[16 * n :]).split(b" ")
                langs += [lang] * n
        keys, n = [np.concatenate(c) for c in columns], np.concatenate(counts)
        order, first, total, k = _summed(keys, n)
        wanted = np.flatnonzero((total >= least) | _counted(table.value, k) if table else total >= least)
        at = order[first[wanted]]
        frame = {"m": m} | {w: (keys[j][at].view(np.int64) if j < m else np.zeros(len(at), np.int64)) for j, w in enumerate(_KEY)} | {"k": k[wanted].view(np.int64)}
        if m == 1:
            same = np.flatnonzero(np.diff(keys[0][order]) == 0)
            if any(letters[a] != letters[b] or langs[a] != langs[b] for a, b in zip(order[same].tolist(), order[same + 1].tolist(), strict=True)):
                raise ValueError("two words have one hash")
            frame |= {"lang": [langs[i] for i in at], "word": [letters[i].decode() for i in at]}
            if everything:
                sums = pd.DataFrame({"lang": langs, "c": n}).groupby("lang", as_index=False)["c"].sum()
                out.append(sums.assign(m=0, k=0, word=None, **dict.fromkeys(_KEY, 0)))
        else:
            frame |= {"lang": None, "word": None}
        out.append(pd.DataFrame(frame | {"c": total[wanted]}))
    return pd.concat(out)[["m", *_KEY, "k", "lang", "word", "c"]]


def _facts_of(*args) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def facts(pdf: pd.DataFrame) -> pd.DataFrame:
        return _facts(*args, pdf)

    return facts


def _counts(facts: DataFrame, least: int, shards: int, *more: Column) -> DataFrame:
    """Of each phrase that is noted: its count so far ``a``, the step since which it is counted and that at which it reached
    ``least``. A shard's count is the same whenever it is scanned."""
    by = lambda f, x: [f(F.when(F.col("shard") == s, x)) for s in range(shards)]
    each = by(F.min, F.col("step")), by(F.max, F.col("c")), by(F.min, F.when(F.col("c") >= -(-least // shards), F.col("step")))
    named = [x.alias(f"{n}{i}") for n, xs in zip("scp", each, strict=True) for i, x in enumerate(xs)]
    rows = facts.where("m > 0").groupBy("m", *_KEY, "k").agg(*named, *more)
    col = lambda n, i: F.col(f"{n}{i}")
    until = lambda i: reduce(add, [F.when(col("s", j) <= col("s", i), col("c", j)).otherwise(0) for j in range(shards)])
    first = lambda x: F.array_min(F.array(*x))
    a = reduce(add, [F.coalesce(col("c", j), F.lit(0)) for j in range(shards)])
    reached = first([F.when(until(i) >= least, col("s", i)) for i in range(shards)])
    out = rows.select("m", *_KEY, "k", a.alias("a"), first([col("p", i) for i in range(shards)]).alias("since"), reached.alias("reached"), *[c for c in ("lang", "word") if c in rows.columns])
    return out.where("since is not null")


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """A chunk of the table, and the lengths that have fresh and counted phrases in it, as bits."""
    chunk = np.zeros(1 << FEWEST, np.uint8)
    says = pdf["says"].to_numpy(np.uint8)
    np.bitwise_or.at(chunk, pdf["slot"].to_numpy(np.int64) & (1 << FEWEST) - 1, says)
    m = 1 << pdf["m"].to_numpy(np.int64)
    bits = [int(np.bitwise_or.reduce(m[says & flag > 0], initial=0)) for flag in (FRESH, COUNTED[0])]
    return pd.DataFrame({"chunk": [int(pdf["slot"].iloc[0]) >> FEWEST], "fresh": bits[:1], "counted": bits[1:], "payload": [zlib.compress(chunk.tobytes(), 1)]})


def _told(counts: DataFrame, step: int, shards: int, bits: int) -> tuple[np.ndarray, list[int]]:
    """The table of slots for ``step``, which comes to the driver in chunks, and the lengths that have open phrases."""
    fresh = (F.col("m") < LONGEST) & (F.col("reached") >= step - shards)
    reached = F.when((F.col("m") < LONGEST) & F.col("reached").isNotNull(), REACHED).otherwise(0) + F.when(fresh, FRESH).otherwise(0)
    counted = F.col("since") > step - shards
    slot = lambda i: F.shiftrightunsigned("k", (64 - bits, 32 - bits // 2, 0)[i]).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    each = [F.struct(slot(0).alias("slot"), (reached + F.when(counted, COUNTED[0]).otherwise(0)).cast("int").alias("says"))]
    each += [F.struct(slot(i).alias("slot"), F.when(counted, COUNTED[i]).otherwise(0).cast("int").alias("says")) for i in (1, 2)]
    slots = counts.select("m", F.explode(F.array(*each)).alias("x")).select("m", "x.*").where("says > 0")
    table, fresh_, counted_ = np.zeros(1 << bits, np.uint8), 0, 0
    for r in slots.groupBy(F.shiftright("slot", FEWEST)).applyInPandas(_packed, "chunk int, fresh int, counted int, payload binary").toLocalIterator():
        table[r["chunk"] << FEWEST : (r["chunk"] + 1) << FEWEST] = np.frombuffer(zlib.decompress(r["payload"]), np.uint8)
        fresh_, counted_ = fresh_ | r["fresh"], counted_ | r["counted"]
    return table, [m for m in range(1, LONGEST + 1) if (fresh_ << 1 | counted_) >> m & 1]


def count(docs: DataFrame, least: int = LEAST, shards: int = SHARDS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): all phrases of 1 to LONGEST words that occur ``least`` times or more, as hashes of their words,
    with their counts ``a``; and the number of all words by language."""
    spark: SparkSession = docs.sparkSession
    lean(spark)
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    dealt = keep(own.withColumn("shard", (F.monotonically_increasing_id() % shards).cast("int")), "shards", by="shard")
    size = dealt.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(PARTS, -(-size // PART_BYTES))
    bits = min(BITS, max(FEWEST, (size // SLOT_BYTES).bit_length()))
    base, facts, step = place(spark, "facts"), None, 0
    while True:
        told, open_ = None, []
        if facts is not None:
            table, open_ = _told(_counts(facts, least, shards), step, shards, bits)
            told = spark.sparkContext.broadcast(table)
        everything = step < shards
        if not open_ and not everything:
            break
        found = dealt.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(partial(_scan, parts, told, open_, everything), "m int, part int, lang string, n long, payload binary")
        new = found.groupBy("part").applyInPandas(_facts_of(-(-least // shards), told, everything), _FACTS)
        new.write.parquet(f"{base}/step={step}")
        facts = spark.read.schema(_FACTS + ", step int").parquet(base).withColumn("shard", F.col("step") % shards)
        if told is not None:
            told.unpersist()
        step += 1
    totals = facts.where("m = 0").groupBy("lang").agg(F.sum("c").alias("n"))
    counts = _counts(facts, least, shards, F.max("lang").alias("lang"), F.max("word").alias("word"))
    return counts.where(F.col("a") >= least), totals


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 80, shards: int = SHARDS, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language the ``top`` phrases of 2 to LONGEST words that occur
    ``least`` times or more, by their lowest score over all cuts.

    A phrase inside a longer one that occurs at least ``share`` percent as often is left out. A null language is ``und``;
    null, empty and blank texts have no words. Rows are counted as often as they are repeated, texts of any length whole.
    An empty table gives no rows. Other columns are not looked at. Words are told apart by 64 bits of their hashes; two
    words of one hash in one shard raise an error.
    """
    counts, totals = count(docs, least, shards, text, lang)
    phrases = keep(counts.select(F.slice(F.array(*_KEY), F.lit(1), F.col("m")).alias("p"), "m", "a", "lang", "word"), "phrases")
    known, single = phrases.select("p", "a"), phrases.where("m = 1")
    long = phrases.where("m > 1").select("p", "m", "a")
    cuts = long.select("p", "m", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("cut")), "right": F.slice("p", F.col("cut") + 1, F.col("m") - F.col("cut"))})
    cuts = cuts.join(known.select(F.col("p").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("p").alias("right"), F.col("a").alias("r")), "right")
    score = _div(F.lit(2_000_000).cast("decimal(18,0)") * F.col("a").cast("decimal(19,0)"), (F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")))
    lowest = cuts.groupBy("p", "m", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "cut", "l", "r")).alias("low"))
    inside = long.where("m > 2").select("m", "a", "p", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("size"))
    inside = inside.select("a", "p", "size", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)).alias("first"))
    around = inside.groupBy(F.slice("p", F.col("first"), F.col("size")).alias("p")).agg(F.max("a").alias("around"))
    open_ = lowest.join(around, "p", "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around").cast("decimal(19,0)") < F.lit(share) * F.col("a").cast("decimal(19,0)")))
    spelled = open_.select("p", F.posexplode("p").alias("at", "w")).join(single.select(F.col("p")[0].alias("w"), "lang", "word"), "w")
    spelled = spelled.groupBy("p").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = open_.join(spelled, "p").select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
