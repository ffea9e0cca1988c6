"""Registered retrieval queries: documents -> chunks; conversation user turns -> questions;
embedding label centroids -> dense queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as RT
from ..session import written
from ..sources.tables import table
from . import oracle as O
from .catalog import register

K = 4
WS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return RT.chunk_documents(d, sep="\n", title=F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    q = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
                 F.col("text").alias("question"))
    return RT.question_guard(q)


def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


RET_CTES = [
    ("chunks", f"""
SELECT doc_id, pos, title, text, CAST(doc_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) AS chunk_id FROM (
  SELECT doc_id, title, pos - 1 AS pos, trim(piece, {WS_SQL}) AS text FROM (
    SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS title, unnest(parts) AS piece,
      generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents)))
WHERE text <> ''"""),
    ("questions", f"""
SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, text AS question
FROM conversations WHERE role = 'user' AND trim(text, {WS_SQL}) <> ''"""),
    ("ctf", f"SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest({tokens_sql('text')}) AS token FROM chunks) GROUP BY chunk_id, token"),
    ("ndocs", "SELECT CAST(count(*) AS DOUBLE) AS n FROM chunks"),
    ("idf", "SELECT token, ln((max(ndocs.n) + 1.0e0) / (count(*) + 1.0e0)) AS idf FROM ctf, ndocs GROUP BY token"),
    ("cw", "SELECT chunk_id, ctf.token, tf * idf AS w FROM ctf JOIN idf ON ctf.token = idf.token"),
    ("post", """
SELECT token, cw.chunk_id, w / nrm AS w FROM cw JOIN (SELECT chunk_id, sqrt(sum(w * w)) AS nrm FROM cw GROUP BY chunk_id) n
  ON cw.chunk_id = n.chunk_id WHERE nrm > 0"""),
    ("qtf", f"SELECT question_id, token, count(*) AS tf FROM (SELECT question_id, unnest({tokens_sql('question')}) AS token FROM questions) GROUP BY question_id, token"),
    ("qw", "SELECT question_id, qtf.token, tf * idf AS w FROM qtf JOIN idf ON qtf.token = idf.token"),
    ("qv", """
SELECT qw.question_id, token, w / nrm AS wq FROM qw JOIN (SELECT question_id, sqrt(sum(w * w)) AS nrm FROM qw GROUP BY question_id) n
  ON qw.question_id = n.question_id WHERE nrm > 0"""),
    ("lex_scores", f"""
SELECT question_id, chunk_id, {O.rs('sum(w * wq)', 4)} AS score FROM post JOIN qv ON post.token = qv.token
GROUP BY question_id, chunk_id HAVING sum(w * wq) > 0"""),
    ("lex_hits", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM lex_scores)
WHERE rank <= 4"""),
    ("hits_text", "SELECT h.question_id, h.chunk_id, h.rank, h.score, c.title, c.text FROM lex_hits h JOIN chunks c ON h.chunk_id = c.chunk_id"),
    ("ctx", """
SELECT question_id, string_agg('[' || title || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg(title, '|' ORDER BY rank) AS titles, count(*) AS n_sources
FROM hits_text GROUP BY question_id"""),
    ("cent_raw", """
SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (
  SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i"""),
    ("cent", """
SELECT label AS query_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS qvec
FROM (SELECT label, list(m ORDER BY i) AS v FROM cent_raw GROUP BY label)"""),
    ("dense_scores", f"""
SELECT c.query_id, e.vec_id, {O.rs('list_dot_product(c.qvec, CAST(e.embedding AS DOUBLE[]))', 4)} AS score
FROM embeddings e CROSS JOIN cent c"""),
    ("dense_hits", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense_scores)
WHERE rank <= 4"""),
]


def rsql(body: str) -> str:
    return O.with_ctes(body, RET_CTES)


@register("chunk_documents", rsql("SELECT chunk_id, doc_id, pos, title, text FROM chunks"))
def q_chunk_documents(spark, sf_dir):  # R1
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", "pos", "title", "text")


@register("question_guard", rsql("SELECT question_id, question FROM questions"))
def q_question_guard(spark, sf_dir):  # P9
    return questions(spark, sf_dir)


@register("normalize_vectors", """
SELECT vec_id, i - 1 AS dim, CAST(floor(x / sqrt(s) * 1000000000.0e0 + 0.5e0 + 1e-7) / 1000000000.0e0 AS DOUBLE) AS value
FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i,
             list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))) AS s FROM embeddings)""")
def q_normalize(spark, sf_dir):  # R3
    from ..functions.numeric import round_stable
    e = table(spark, sf_dir, "embeddings").select("vec_id", RT.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("dim", "x")).select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), round_stable(F.col("x"), 9).alias("value"))


def _dense(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, RT.mean_vectors(e, "label")


@register("similarity_cross", rsql("SELECT query_id, vec_id, score FROM dense_scores"))
def q_similarity_cross(spark, sf_dir):  # J3: every label-centroid query x every vector
    e, q = _dense(spark, sf_dir)
    return RT.similarity_join(e.select("vec_id", "embedding"), q)


@register("vector_topk", rsql("SELECT query_id, vec_id, rank, score FROM dense_hits"))
def q_vector_topk(spark, sf_dir):  # R4 (+ W2)
    e, q = _dense(spark, sf_dir)
    return RT.vector_topk(e.select("vec_id", "embedding"), q, K).select(
        "query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "score")


@register("hit_to_chunk", rsql("""
SELECT h.query_id, h.vec_id, h.rank, e.label FROM dense_hits h JOIN embeddings e ON h.vec_id = e.vec_id"""))
def q_hit_to_chunk(spark, sf_dir):  # J2: hits back to their corpus rows
    e, q = _dense(spark, sf_dir)
    h = RT.vector_topk(e.select("vec_id", "embedding"), q, K)
    return h.join(e.select("vec_id", "label"), "vec_id", "inner").select(
        "query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "label")


_HITS: dict[tuple[str, str], DataFrame] = {}


def _lexical_hits(spark, sf_dir) -> DataFrame:
    """The k hits of every question, written once per application and scale: R5, W2 and R7-R10 read the same table."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name not in _HITS:
        for old in [n for n in _HITS if n[0] != name[0]]:
            del _HITS[old]
        _HITS[name] = written(RT.lexical_topk(questions(spark, sf_dir), chunks(spark, sf_dir), K), "lexical-hits")
    return _HITS[name]


@register("topk_per_question", rsql("SELECT question_id, chunk_id, rank, score FROM lex_hits"))
def q_topk_per_question(spark, sf_dir):  # W2 over lexical scores
    h = _lexical_hits(spark, sf_dir)
    return h.select("question_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score")


@register("lexical_topk", rsql("SELECT question_id, chunk_id, rank, score, title, text FROM hits_text"))
def q_lexical_topk(spark, sf_dir):  # R5 + J2
    h = RT.hits_to_chunks(_lexical_hits(spark, sf_dir), chunks(spark, sf_dir))
    return h.select("question_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"), "score", "title", "text")


def _answers(spark, sf_dir):
    return RT.answers(RT.hits_to_chunks(_lexical_hits(spark, sf_dir), chunks(spark, sf_dir)), questions(spark, sf_dir))


@register("context_assembly", rsql(
    "SELECT q.question_id, coalesce(ctx.context, '') AS context FROM questions q LEFT JOIN ctx USING (question_id)"))
def q_context(spark, sf_dir):  # R7
    return _answers(spark, sf_dir).select("question_id", "context")


@register("grounded_prompt", rsql(f"""
SELECT q.question_id, printf('{RT.PROMPT_HEAD}', q.question, coalesce(ctx.context, '')) AS prompt
FROM questions q LEFT JOIN ctx USING (question_id)"""))
def q_prompt(spark, sf_dir):  # R8
    return _answers(spark, sf_dir).select("question_id", "prompt")


@register("answer_record", rsql(f"""
SELECT q.question_id, '{RT.FALLBACK_ANSWER}' AS answer, CAST(NULL AS VARCHAR) AS llm,
  CAST(coalesce(ctx.n_sources, 0) AS BIGINT) AS n_sources
FROM questions q LEFT JOIN ctx USING (question_id)"""))
def q_answer(spark, sf_dir):  # R9: no model ran -> fixed fallback answer, null llm
    return _answers(spark, sf_dir).select("question_id", "answer", "llm", F.size("sources").cast("bigint").alias("n_sources"))


@register("answer_with_model", rsql(f"""
SELECT q.question_id, coalesce(m.answer, '{RT.FALLBACK_ANSWER}') AS answer, m.llm, coalesce(ctx.titles, '') AS titles
FROM questions q LEFT JOIN ctx USING (question_id) LEFT JOIN (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) AS question_id, trim(text, {WS_SQL}) AS answer, 'assistant' AS llm
  FROM conversations WHERE role = 'assistant' AND trim(text, {WS_SQL}) <> '') m USING (question_id)"""))
def q_answer_with_model(spark, sf_dir):  # R9 with an answer: the assistant's turn after the question, with the sources found
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    given = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("question_id"),
                     F.col("text").alias("answer"), F.lit("assistant").alias("llm"))
    a = RT.answers(RT.hits_to_chunks(_lexical_hits(spark, sf_dir), chunks(spark, sf_dir)), questions(spark, sf_dir), given)
    return a.select("question_id", "answer", "llm", F.array_join("source_titles", "|").alias("titles"))


@register("source_titles", rsql(
    "SELECT q.question_id, coalesce(ctx.titles, '') AS titles FROM questions q LEFT JOIN ctx USING (question_id)"))
def q_source_titles(spark, sf_dir):  # R10
    return _answers(spark, sf_dir).select("question_id", F.array_join("source_titles", "|").alias("titles"))
