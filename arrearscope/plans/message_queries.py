"""Registered message-text queries (G1-G5) and I/O round trips."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import messages as M
from ..schema import ACCOUNT, CHUNK
from ..session import shared_dir
from ..sources import io as IO
from ..sources.ingest import request_ingest, score_response
from ..sources.portfolio import portfolio, training_portfolio
from ..sources.tables import table
from . import oracle as O
from .catalog import register
from .retrieval_queries import RET_CTES, chunks
from .scoring import score_service

# Requested tones are derived per account from its key (some missing, some not allowed) so every
# branch of the tone rule is exercised on the whole table.
TONE_REQUESTS = ["professional", "empathetic", "concise", None, "urgent"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score_service(portfolio(spark, sf_dir))
    arr = F.array(*[F.lit(t).cast("string") for t in TONE_REQUESTS])
    return s.withColumn("requested_tone", F.element_at(arr, (F.col("c_custkey") % len(TONE_REQUESTS) + 1).cast("int")))


def sq(s: str) -> str:
    return s.replace("'", "''")


TONE_SQL = "[" + ", ".join("NULL" if t is None else f"'{t}'" for t in TONE_REQUESTS) + "]"
MSG_CTES = [
    ("req", f"SELECT *, {TONE_SQL}[c_custkey % {len(TONE_REQUESTS)} + 1] AS requested_tone FROM scored_service"),
    ("req2", """
SELECT *, CASE WHEN coalesce(requested_tone, 'professional') IN ('professional', 'empathetic', 'concise')
  THEN coalesce(requested_tone, 'professional') END AS tone FROM req"""),
    ("fb", f"""
SELECT *, printf('{sq(M.FALLBACK)}', customer_name, format('{{:,.2f}}', {O.rs('outstanding_amount', 2)}),
  CAST(dpd AS VARCHAR)) AS fallback FROM req2"""),
    ("resp", """
SELECT f.*, c.text AS llm_text,
  CASE WHEN c.text IS NULL THEN CASE WHEN f.c_custkey % 3 = 0 THEN '429 RESOURCE_EXHAUSTED: quota exceeded'
       ELSE 'DEADLINE_EXCEEDED' END END AS llm_error
FROM fb f LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id) c
  ON f.c_custkey = c.conv_id"""),
    ("outcome", """
SELECT *, CASE WHEN llm_text IS NOT NULL AND trim(llm_text) <> '' THEN 'ok'
   WHEN contains(coalesce(llm_error, ''), '429') OR contains(coalesce(llm_error, ''), 'RESOURCE_EXHAUSTED') THEN 'fallback'
   ELSE 'failed' END AS status FROM resp"""),
    ("outcome2", """
SELECT *, CASE status WHEN 'ok' THEN 'llm' WHEN 'fallback' THEN 'template' END AS message_source,
  CASE status WHEN 'ok' THEN trim(llm_text) WHEN 'fallback' THEN fallback END AS message FROM outcome"""),
]


def msql(body: str) -> str:
    return O.with_ctes(body, O.PORTFOLIO_CTES, O.SERVICE_CTES, MSG_CTES)


def _with_tone(spark, sf_dir):
    r = requests(spark, sf_dir)
    tone, ok = M.tone_validation(F.col("requested_tone"))
    return r.withColumns({"tone": tone, "tone_valid": ok})


@register("tone_validation", msql("""
SELECT customer_id, requested_tone, tone, tone IS NOT NULL AS tone_valid FROM req2"""))
def q_tone(spark, sf_dir):  # G3
    return _with_tone(spark, sf_dir).select("customer_id", "requested_tone", "tone", "tone_valid")


@register("message_prompt", msql(f"""
SELECT customer_id, tone, printf('{sq(M.PROMPT)}', customer_name, customer_id,
  format('{{:,.2f}}', {O.rs('outstanding_amount', 2)}), format('{{:,.2f}}', {O.rs('emi_amount', 2)}), due_date,
  CAST(dpd AS VARCHAR), action, preferred_channel, tone) AS prompt
FROM req2 WHERE tone IS NOT NULL"""))
def q_prompt(spark, sf_dir):  # G1 (requests with an invalid tone are rejected, as the API would)
    t = _with_tone(spark, sf_dir).where(F.col("tone_valid"))
    return t.select("customer_id", "tone", M.message_prompt(F.col("next_best_action.action"), F.col("tone")).alias("prompt"))


@register("message_fallback", msql("SELECT customer_id, fallback AS message FROM fb"))
def q_fallback(spark, sf_dir):  # G2
    return requests(spark, sf_dir).select("customer_id", M.message_fallback().alias("message"))


def _outcomes(spark, sf_dir):
    r = requests(spark, sf_dir)
    conv = (table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
            .groupBy(F.col("conv_id").alias("c_custkey")).agg(F.max_by("text", "turn").alias("llm_text")))
    j = r.join(conv, "c_custkey", "left").withColumn(
        "llm_error", F.when(F.col("llm_text").isNull(),
                            F.when(F.col("c_custkey") % 3 == 0, F.lit("429 RESOURCE_EXHAUSTED: quota exceeded"))
                            .otherwise(F.lit("DEADLINE_EXCEEDED"))))
    status, source, msg = M.message_outcome(F.col("llm_text"), F.col("llm_error"))
    return j.withColumns({"status": status, "message_source": source, "message": msg})


@register("message_outcome", msql("SELECT customer_id, status, message_source, message FROM outcome2"))
def q_outcome(spark, sf_dir):  # G4
    return _outcomes(spark, sf_dir).select("customer_id", "status", "message_source", "message")


@register("message_record", msql("""
SELECT customer_id, customer_name, action, preferred_channel AS recommended_channel, reason, message_source, message
FROM outcome2 WHERE status <> 'failed'"""))
def q_record(spark, sf_dir):  # G5: delivered messages only, with the true source (Q6)
    rec = M.message_record(_outcomes(spark, sf_dir).where(F.col("status") != "failed"))
    return rec.select("customer_id", "customer_name", "action.action", "action.recommended_channel", "action.reason",
                      "message_source", "message")


@register("score_response", O.service_sql("""
SELECT customer_id, to_json({'customer_id': customer_id, 'payment_probability_30d': payment_probability_30d,
  'ptp_probability': ptp_probability, 'recovery_probability': recovery_probability,
  'collection_priority_score': collection_priority_score, 'priority_band': priority_band,
  'next_best_action': {'action': action, 'recommended_channel': preferred_channel, 'reason': reason}}) AS response
FROM scored_service"""))
def q_score_response(spark, sf_dir):  # S9
    s = score_service(portfolio(spark, sf_dir))
    return s.select("customer_id", score_response(s).alias("response"))


ACCOUNT_COLS = [f.name for f in ACCOUNT.fields]


@register("request_ingest", O.portfolio_sql(f"""
SELECT customer_id AS source_id, c_custkey % 97 <> 0 AS parsed_ok,
  CASE WHEN c_custkey % 97 <> 0 THEN customer_id END AS customer_id,
  CASE WHEN c_custkey % 97 <> 0 THEN dpd END AS dpd,
  CASE WHEN c_custkey % 97 <> 0 THEN outstanding_amount END AS outstanding_amount,
  CASE WHEN c_custkey % 97 <> 0 THEN preferred_channel END AS preferred_channel,
  CAST(CASE WHEN c_custkey % 97 <> 0 THEN 0 ELSE 18 END AS BIGINT) AS n_reasons
FROM portfolio"""))
def q_request_ingest(spark, sf_dir):  # S8: payloads are the accounts as JSON; every 97th is cut short
    p = portfolio(spark, sf_dir)
    js = F.to_json(F.struct(*ACCOUNT_COLS))
    pay = p.select(F.col("customer_id").alias("source_id"), "c_custkey", *ACCOUNT_COLS) \
        .select("source_id", F.coalesce(F.when(F.col("c_custkey") % 97 == 0,
                                               F.substring(js, 1, 40)), js).alias("payload"))
    ok, bad = request_ingest(pay)
    both = ok.withColumn("reasons", F.array().cast("array<string>")).unionByName(bad)
    return both.select("source_id", "parsed_ok", "customer_id", "dpd", "outstanding_amount", "preferred_channel",
                       F.size("reasons").cast("bigint").alias("n_reasons"))


@register("chunk_json_roundtrip", O.with_ctes("SELECT title, text FROM chunks", RET_CTES))
def q_chunk_json(spark, sf_dir):  # S4 write + S3 read
    path = shared_dir(spark, "chunks-json")
    IO.write_chunks_json(chunks(spark, sf_dir).select("title", "text"), path)
    return IO.read_chunks_json(spark, path, schema=CHUNK)


@register("chunk_json_array", O.with_ctes("SELECT title, text FROM chunks", RET_CTES))
def q_chunk_json_array(spark, sf_dir):  # S3: the array form, one array per document
    path = shared_dir(spark, "chunks-json-arrays")
    IO.write_chunk_arrays_json(chunks(spark, sf_dir).select("title", "text"), path)
    return IO.read_chunks_json(spark, path, schema=CHUNK)


@register("policy_doc_scan", "SELECT 'item_' || item_id AS title, text || chr(10) AS text FROM benchmark WHERE text IS NOT NULL")
def q_policy_doc_scan(spark, sf_dir):  # S2: a folder of .md files, written and scanned
    path = shared_dir(spark, "policy-docs")
    b = table(spark, sf_dir, "benchmark").where(F.col("text").isNotNull())
    IO.write_policy_docs(b.select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("title"), "text"), path)
    return IO.policy_doc_scan(spark, path)


@register("training_csv_export", O.training_sql(
    "SELECT " + ", ".join(ACCOUNT_COLS + ["will_pay", "ptp_kept", "recovery_success"]) + " FROM portfolio"))
def q_training_csv(spark, sf_dir):  # S5
    from pyspark.sql import types as T
    cols = ACCOUNT_COLS + ["will_pay", "ptp_kept", "recovery_success"]
    path = shared_dir(spark, "training-csv")
    IO.write_csv(training_portfolio(spark, sf_dir).select(*cols), path)
    schema = T.StructType(ACCOUNT.fields + [T.StructField(c, T.IntegerType()) for c in cols[len(ACCOUNT_COLS):]])
    return IO.read_csv(spark, path, schema)


@register("embedding_table_io", """
SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims,
  CAST(floor(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 1000000.0e0 + 0.5e0 + 1e-7) / 1000000.0e0 AS DOUBLE) AS checksum
FROM embeddings""")
def q_embedding_io(spark, sf_dir):  # S6
    from ..functions.numeric import lit_d, round_stable
    path = shared_dir(spark, "embeddings")
    IO.write_embeddings(table(spark, sf_dir, "embeddings"), path)
    e = IO.read_embeddings(spark, path)
    return e.select("vec_id", "label", F.size("embedding").alias("dims"),
                    round_stable(F.aggregate("embedding", lit_d(0.0), lambda a, x: a + x.cast("double")), 6)
                    .alias("checksum"))

