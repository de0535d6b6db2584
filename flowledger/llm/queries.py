"""Queries opN_<name> and pipeline over the given tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowledger.llm import ann, bpe, chat, collocations, html_extract, langid, lexical, packing, sharding, simhash, spans, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle(_table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat.digests(chat.windows(_table(spark, sf_dir, "conversations").select(*more.columns).unionAll(more)))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_spans, op2_ann, op3_langid, op4_toxicity, op5_simhash, op6_topk, op7_sharding, op8_bpe, op9_html, op10_packing, op11_chat, op12_lexical, op13_collocations)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6, "op11_chat": OP11, "op12_lexical": OP12, "op13_collocations": OP13}


OP6 = """
WITH v AS (
    SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.k, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.k <> c.k AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11 = r"""
WITH RECURSIVE given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) - 1 AS pos, role, text,
        len(regexp_extract_all(text, '[\p{L}\p{M}]{1,5}|\p{N}{1,3}|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]')) + 4 AS n,
        length(text) + len(regexp_extract_all(text, '[\[<]\\*(/?(INST|TURN)\]|:\]|/?s>|</?SYS>>)'))
            + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 16 + length(role) + len(regexp_extract_all(role, '[\[<]\\*(/?(INST|TURN)\]|:\]|/?s>|</?SYS>>)')) END AS chars
    FROM given
), turns AS (
    SELECT *, sum(n) OVER w - n AS before, sum(chars) OVER w - chars AS chars_before, count(*) OVER (PARTITION BY conv_id) AS total
    FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
), system AS (
    SELECT t.*, CASE WHEN z.role = 'system' THEN 1 ELSE 0 END AS first, CASE WHEN z.role = 'system' THEN z.n ELSE 0 END AS fixed, CASE WHEN z.role = 'system' THEN z.chars ELSE 0 END AS fixed_chars
    FROM turns t JOIN turns z ON z.conv_id = t.conv_id AND z.pos = 0
), past AS (
    SELECT s.conv_id, s.pos, min(b.before) AS from_tokens, min(b.chars_before) AS from_chars
    FROM system s JOIN system b ON b.conv_id = s.conv_id AND (b.pos = s.pos OR b.pos < s.pos AND b.pos >= s.first AND b.pos >= s.pos - 4 AND s.before - b.before <= least(512, 2048 - s.fixed - s.n))
    GROUP BY ALL
), starts AS (
    SELECT s.*, p.from_tokens - CASE WHEN s.pos > 0 THEN s.fixed ELSE 0 END AS base, p.from_chars - CASE WHEN s.pos > 0 THEN s.fixed_chars ELSE 0 END AS base_chars
    FROM system s JOIN past p ON p.conv_id = s.conv_id AND p.pos = s.pos
), spans AS (
    SELECT s.conv_id, s.pos, s.base_chars, coalesce(min(e.pos), any_value(s.total)) AS next
    FROM starts s LEFT JOIN turns e ON e.conv_id = s.conv_id AND e.pos > s.pos AND (e.pos % 1024 = 0 OR e.before + e.n - s.base > 2048)
    GROUP BY ALL
), chosen AS (
    SELECT conv_id, pos, base_chars, next FROM spans WHERE pos = 0
    UNION ALL SELECT s.conv_id, s.pos, s.base_chars, s.next FROM chosen c JOIN spans s ON s.conv_id = c.conv_id AND s.pos = c.next
), ends AS (
    SELECT conv_id, pos + 1 AS next, chars_before + chars AS upto FROM turns
), formatted AS (
    SELECT conv_id, sum(upto - base_chars)::BIGINT AS formatted_chars FROM chosen JOIN ends USING (conv_id, next) GROUP BY conv_id
), said AS (
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said JOIN formatted USING (conv_id)
"""

OP12 = r"""
WITH words AS (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents
), lengths AS (
    SELECT d, doc_id, len(ts) AS n, ts FROM words WHERE len(ts) > 0
), total AS (
    SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths
), items AS (
    SELECT DISTINCT q, item_id, unnest(ts) AS t FROM (
        SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark)
), tf AS (
    SELECT d, doc_id, n, t, count(*) AS tf FROM (SELECT d, doc_id, n, unnest(ts) AS t FROM lengths) WHERE t IN (SELECT t FROM items) GROUP BY ALL
), weights AS (
    SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t
), scores AS (
    SELECT q, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
    FROM items JOIN tf USING (t) JOIN weights USING (t), total
    GROUP BY ALL
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13 = r"""
WITH pieces AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
), totals AS (
    SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang
), sizes AS (
    SELECT unnest([1, 2, 3, 4]) AS m
), grams AS (
    SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i : i + m - 1], ' '))) AS phrase FROM pieces, sizes WHERE len(ws) >= m
), f AS (
    SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 30
), cuts AS (
    SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1
), scored AS (
    SELECT c.lang, c.phrase, c.m, c.a, c.k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score
    FROM cuts c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 : c.m], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT lang, a, ws, m, unnest(range(2, m)) AS size FROM f WHERE m > 2
), around AS (
    SELECT lang, phrase, max(a) AS a FROM (
        SELECT lang, a, unnest(list_transform(range(1, m - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase FROM inside)
    GROUP BY lang, phrase
), open AS (
    SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE around.a IS NULL OR 100::HUGEINT * around.a < 80::HUGEINT * lowest.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
