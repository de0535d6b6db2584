import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from flowledger.llm import bpe
from tests.llm import cases

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_whole_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(cases.odd(spark).select("doc_id", "text"))
    base = bpe.codec(PATH, PATTERN).base
    for r, g in zip(docs.collect(), bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect(), strict=True):
        assert list(g["ids"]) == base.encode_ordinary(r["text"] or "") and bytes(g["decoded"]) == (r["text"] or "").encode()
    want = sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest(), len(base.encode_ordinary(r["text"] or ""))) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["decoded_sha256"], r["n_tokens"]) for r in bpe.digests(docs, PATH, PATTERN).collect()) == want
    assert bpe.digests(cases.empty(spark), PATH, PATTERN).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aabbe's'  \n\t\r\x1c\x1d\x85 　19!#é漢\U0001f600")), max_size=120))
def test_any_cut(text):
    """With tiny leaves and windows every text is joined from many parts."""
    c = bpe.codec(PATH, PATTERN)
    leaf, window, bpe.LEAF, bpe.WINDOW = bpe.LEAF, bpe.WINDOW, 3, 1
    try:
        assert c.encode(text) == c.base.encode_ordinary(text)
    finally:
        bpe.LEAF, bpe.WINDOW = leaf, window
    assert c.decode(c.encode(text)) == text.encode()
