from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from flowledger.llm import queries, toxicity
from tests.llm import cases
from tests.llm.test_minhash import kept
from tests.llm.test_spans import brute as spans

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_contract(spark):
    """Each stage's decisions take effect, and the columns of documents stay; blanks, nulls and repeated rows included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = cases.odd(spark).select(docs.columns)
    now = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        rows = out.collect()
        assert 0.5 * docs.count() < len(rows) <= now.count()
        now = spark.createDataFrame(rows, docs.schema)
    assert now.where("text is null").count() == 0
    assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= now.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs if r["text"] and any(map(str.isalpha, r["text"]))]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if crc32(str(r["doc_id"]).encode()) % 3 != 1}
    known = [(t, labels[i]) for i, t in rows if i in labels]
    scorer = toxicity.Scorer(*[x.astype(np.float32) if isinstance(x, np.ndarray) else x for x in toxicity.train([t for t, _ in known], np.array([y for _, y in known]))])
    rows = [r for r, s in zip(rows, scorer.score([t for _, t in rows]), strict=True) if s < toxicity.THRESHOLD]
    stay = set(kept(rows))  # by comparing the five-word shingles of all pairs
    rows = spans([(i, t) for i, t in rows if i in stay])
    base = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        n = len(base.encode(t, add_special_tokens=False).ids) + 1
        for k in range(0, n, 2048):
            want[i, k // 2048, min(2048, n - k)] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in got) == want
    full = defaultdict(int)
    for r in got:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 2048 and len(full) <= -(-sum(full.values()) // 2048) + 2


def test_language_stage_decides(spark):
    """A text of three languages in equal parts goes, and with no language to learn only texts without a letter do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) between 1500 and 3000").orderBy("doc_id").collect()}
    mixed = " ".join(texts[x][:1500] for x in sorted(texts)[:3])
    added = spark.createDataFrame([(10**6, mixed, None, "x", len(mixed)), (10**6 + 1, "123 456", None, "x", 7)], docs.schema)
    out = corpus_pipeline.language_id(spark, docs.unionByName(added), SF)
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}
    none = docs.unionByName(added).withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, none, SF).select("doc_id").collect()} == kept | {10**6}


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries()) and 4 <= len(corpus_pipeline.STAGES) <= 5
