"""The queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, licences, mixing, pieces, pii, simhash, top_k, toxicity, url_filter

PIECE_MODEL = "piece_bpe_32k.model"
#: Of the URL query: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Of the chat query: a conversation of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(_read(spark, sf_dir, "pages"), rules)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, k, role, CONTROL_TEXT) for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    chats = _read(spark, sf_dir, "conversations").unionByName(added, allowMissingColumns=True)
    return chat_format.digests(chat_format.format_chats(chat_format.canonical(chats)))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as JSON records of three layouts, and two that are none, brought back to canonical turns."""
    chats = chat_format.canonical(_read(spark, sf_dir, "conversations"))
    named = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt")))
    as_pairs = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    as_parts = F.transform("turns", lambda t: F.struct(F.coalesce(F.try_element_at(named, t["role"]), t["role"]).alias("from"), t["text"].alias("value")))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    record = F.when(kind == 0, F.to_json(F.struct(as_pairs.alias("messages")))).when(kind == 1, F.to_json(F.struct(as_parts.alias("conversations"), F.lit("x").alias("more")))).otherwise(F.to_json(F.struct(as_pairs.alias("conversation"))))
    odd = spark.createDataFrame([(-1, '{"messages": [null]}'), (-2, '{"messages": ')], "conv_id long, record string")
    found = chat_format.canonical_json(chats.select("conv_id", record.alias("record")).unionByName(odd), "conv_id", "record")
    read = chat_format.digests(chat_format.format_chats(found)).select("conv_id", "n_turns", "turns_sha256")
    return read.join(found.select(F.col("conv_id").alias("of"), (F.col("layout") == "malformed").alias("malformed")), F.col("conv_id") == F.col("of")).drop("of")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_read(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda p: F.concat_ws(":", p["licence"], p["start"].cast("string"), p["end"].cast("string")))
    return found.select("doc_id", "n_sentences", F.array_join("licences", ",").alias("licences"), F.array_join(spans, ",").alias("spans"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(public_tokenizers.path(PIECE_MODEL))
    coded = pieces.encode(_read(spark, sf_dir, "documents"), vocabulary, and_decode=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(_read(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    counts = [F.size(F.filter(F.transform("spans", lambda p: p["kind"]), F.lit(kind).eqNullSafe)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    base = F.filter("spans", lambda p: p["kind"].isin(*pii.KINDS))
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_url_filter, op3_chat_format, chat_layouts, op4_mixing, op5_licences, op6_pieces, op7_top_k, op8_pii, op9_simhash, op10_toxicity)}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op2_url_filter": r"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
        parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
        rules(rhost, rpath, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                                ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        best AS (SELECT page_id, host, path, arg_max(rhost || rpath, 1000 * length(rhost || rpath) + length(rhost)) AS rule,
                        arg_max(verdict, 1000 * length(rhost || rpath) + length(rhost)) AS verdict
                 FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best""",
    "op3_chat_format": r"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
                      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        sized AS (SELECT *, length(x) + len(regexp_extract_all(x, '[<\[]\\*(/?s>|/?(INST|SYS|ROLE|TURN)\])'))
                            + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 11
                                        ELSE 26 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?(INST|SYS|ROLE|TURN)\])')) END AS chars FROM rows)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn, role, x)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(x) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(x, '' ORDER BY turn, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "chat_layouts": r"""
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, coalesce(role, ''), coalesce(text, ''))) AS turns_sha256, false AS malformed
        FROM conversations GROUP BY conv_id UNION ALL VALUES (-1, 0::BIGINT, sha256(''), false), (-2, 0::BIGINT, sha256(''), true)""",
    "op4_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS ticket,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        named AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ix FROM sized GROUP BY source),
        weighed AS (SELECT *, (CASE ix % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS w, 2 * source_size AS top FROM named),
        sums AS (SELECT *, coalesce(sum(top) OVER b, 0)::BIGINT AS full_words, (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS left_w,
                        1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget
                 FROM weighed WINDOW b AS (ORDER BY top / w, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (SELECT *, (budget - full_words) / left_w AS level FROM sums),
        chosen AS (SELECT arg_min(level, full_words) AS level FROM levels WHERE level <= top / w),
        targets AS (SELECT source, ix, source_size, budget, least(top::DOUBLE, w * (SELECT level FROM chosen)) AS target FROM levels),
        queued AS (SELECT s.doc_id, s.size, s.ticket, t.*, sum(s.size) OVER (PARTITION BY t.ix ORDER BY s.ticket, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS reached
                   FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        served AS (SELECT q.*, e.epoch, CASE WHEN target > 0 THEN (reached + e.epoch * source_size) / target ELSE 0 END AS finish
                   FROM queued q, (VALUES (0), (1)) e(epoch)),
        merged AS (SELECT *, sum(size) OVER (ORDER BY finish, ix, epoch, ticket, size ROWS UNBOUNDED PRECEDING)::BIGINT AS so_far FROM served)
        SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
               (any_value(size) * count(*) FILTER (so_far <= budget))::BIGINT AS taken
        FROM merged GROUP BY doc_id""",
    "op7_top_k": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS terms FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.terms, c.terms)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
}
