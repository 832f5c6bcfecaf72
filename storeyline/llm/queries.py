"""The queries ``opN_*``: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeyline.llm import decontam, langid, neardup, packing, pii, suffixdedup, tokens, toolcalls, topk, toxicity
from storeyline.llm.common import bounded_batches, crc_mod, table, written

VOCABULARY = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = tokens.token_counts(docs, F.col("text"), [F.col("doc_id")], tokens.tokenizer_path(VOCABULARY), budgets=[2048])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.profiles(docs.where(crc_mod("doc_id", 4) != 2), F.col("text"), F.col("lang"), F.col("doc_id"))
    found = langid.predict(docs, F.col("text"), [F.col("doc_id")], learned)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), tokens.tokenizer_path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(topk.quantised(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding")))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.linked(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.trained(toxicity.sample(docs, labels, crc_mod("doc_id", 5) != 0))
    found = toxicity.scored(docs, F.col("text"), [F.col("doc_id")], model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), F.col("text"), [F.col("doc_id")])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    digest = F.sha2(joined(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), digest, joined(F.col("spans")).alias("spans"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), F.col("text"), [F.col("doc_id")], table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


QUERIES = [op1_token_counts, op2_language_id, op3_packing, op4_topk, op5_tool_calls, op6_toxicity, op7_pii, op8_suffix_dedup, op9_decontamination, op10_near_duplicates]

#: op5's covers plain conversations, which is what the tables hold; calls in JSON are covered by tests.
ORACLE_SQL: dict[str, str] = {
    "op10_near_duplicates": r"""
        with recursive w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
            from documents
        ), s as (
            select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as sh
            from w
        ), n as (select doc_id, count(*) as n from s group by all),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
        l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
        e as (select x, y from l union all select y, x from l),
        r(doc_id, c) as (select doc_id, doc_id from documents union select e.y, r.c from r join e on r.doc_id = e.x)
        select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(c) as component_id, r.doc_id = min(c) as kept
        from r left join n on r.doc_id = n.doc_id group by r.doc_id""",
    "op5_tool_calls": """
        with e as (
            select conv_id, turn, cast(0 as bigint) as seq, role, text,
                case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
                case role when 'user' then cast(turn as varchar) when 'assistant' then cast(turn - 1 as varchar) end as call_id
            from conversations
        ), ids as (
            select conv_id, call_id, min(turn) filter (kind = 'call') as first_turn,
                count(*) filter (kind = 'call') as n_calls, count(*) filter (kind = 'result') as n_results
            from e where call_id is not null and conv_id is not null and turn is not null group by all
        ), j as (
            select e.*, i.first_turn, coalesce(i.n_calls, 0) as n_calls, coalesce(i.n_results, 0) as n_results
            from e left join ids i on e.conv_id = i.conv_id and e.call_id = i.call_id
        )
        select conv_id, turn, seq, kind, call_id,
            case kind when 'call' then n_results > 0 when 'result' then n_calls > 0 else false end as linked,
            n_calls, n_results,
            case when kind = 'call' and text is null then 'text is no string' else '' end as problems,
            not (kind = 'call' and text is null) as valid,
            case kind when 'result' then greatest(turn, first_turn) else turn end as order_turn,
            cast(kind = 'result' as integer) as order_rank,
            case kind
                when 'call' then '{"arguments":{"text":' || to_json(text) || '},"id":' || to_json(call_id) || ',"name":"reply"}'
                when 'result' then '{"content":' || to_json(text) || ',"tool_call_id":' || to_json(call_id) || '}'
                else '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' end as json
        from j""",
    "op4_topk": """
        with parts as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), flat as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from parts),
        scored as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(sum(q.x * c.x) as bigint) as score
            from flat q join flat c on q.i = c.i and q.vec_id <> c.vec_id
            where q.vec_id % 50 = 0 group by all
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5""",
}


def queries() -> dict:
    return {f.__name__: (lambda spark, sf_dir, f=f: f(bounded_batches(spark), sf_dir)) for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
