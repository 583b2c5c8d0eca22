"""Search queries over the chunk view: filters, pools, scores, ranking and counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusops.operators import catalog as cat
from corpusops.operators import hybrid, lexical, postings, vector
from corpusops.operators.embeddings import hash_embedding
from corpusops.operators.hybrid import Filters
from corpusops.plans.embeddings import hash_sql
from corpusops.plans.registry import query
from corpusops.plans.sqltext import CHUNKS, words_sql
from corpusops.session import scratch_dir
from corpusops.tables import chunk_vectors, chunk_view, table

TEXT = "the that"
DIM = 64


@query("q_filter", f"""
WITH {CHUNKS} SELECT chunk_id, context, product FROM chunks
WHERE domain = 'docs' AND context = 'en' AND product = 'src3'""")
def q_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = Filters(context="en", product="src3", version="")
    return chunk_view(spark, sf).filter(f.predicate("docs")).select("chunk_id", "context", "product")


@query("q_weights", """
SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, domain, round(CASE domain WHEN 'docs' THEN 0.75 * v + 0.25 * t ELSE 0.65 * v + 0.35 * t END, 9) AS score
FROM (SELECT event_id AS chunk_id, CASE WHEN event_type = 'view' THEN 'lsp' ELSE 'docs' END AS domain,
             value / 1000 AS v, CAST(json_extract(props, '$.k') AS INT) / 100.0 AS t FROM events)""")
def q_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of many domains at once: the weights are a table with one row per domain."""
    rows = [(d, *hybrid.weights(d, {})) for d in hybrid.WEIGHTS]
    w = spark.createDataFrame(rows, "domain string, wv double, wt double")
    ev = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("chunk_id"),
        F.when(F.col("event_type") == "view", "lsp").otherwise("docs").alias("domain"),
        (F.col("value") / 1000).alias("v"),
        (F.get_json_object("props", "$.k").cast("int") / 100).alias("t"),
    )
    return ev.join(F.broadcast(w), "domain").select(
        "chunk_id", "domain", F.round(F.col("wv") * F.col("v") + F.col("wt") * F.col("t"), 9).alias("score")
    )


def probe_vector(spark: SparkSession, sf: str) -> list[float]:
    """The vector of vec_id 0 stands for the embedded query: one row."""
    row = table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


_VEC = """greatest(0, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))"""


@query("q_vector_topk", f"""
SELECT CAST(e.vec_id AS VARCHAR) AS chunk_id, round({_VEC}, 6) AS vector_score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY {_VEC} DESC, chunk_id LIMIT 80""")
def q_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = vector.vector_topk(chunk_vectors(spark, sf), probe_vector(spark, sf), hybrid.DEFAULT_POOL)
    return top.withColumn("vector_score", F.round("vector_score", 6))


@query("q_terms", f"""
WITH w AS (SELECT item_id, unnest({words_sql('text')}) AS term FROM benchmark)
SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, CAST(0 AS INT) AS clause, 'word' AS kind, term FROM w""")
def q_terms(spark: SparkSession, sf: str) -> DataFrame:
    """No item of the given texts holds a quote, a leading minus or the word 'or'."""
    return lexical.query_terms(_asked(spark, sf))


def rank_sql(terms: list[str], docs: str) -> str:
    """Cover density of fixed words over ``docs`` (chunk_id, text)."""
    n = len(terms)
    listed = ", ".join(f"'{t}'" for t in terms)
    last = ", ".join(
        f"max(CASE WHEN tok = '{t}' THEN pos END) OVER w AS l{i}, max(CASE WHEN tok = '{t}' THEN idx END) OVER w AS x{i}"
        for i, t in enumerate(terms)
    )
    low = f"least({', '.join(f'l{i}' for i in range(n))})" if n > 1 else "l0"
    xlow = f"least({', '.join(f'x{i}' for i in range(n))})" if n > 1 else "x0"
    have = " AND ".join(f"l{i} IS NOT NULL" for i in range(n))
    return f"""
tok AS (SELECT chunk_id, unnest({words_sql('text')}) AS tok, generate_subscripts({words_sql('text')}, 1) AS pos FROM {docs}),
hit AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS idx FROM tok WHERE tok IN ({listed})),
lst AS (SELECT *, {last} FROM hit WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)),
cov AS (SELECT chunk_id, pos, idx, {low} AS st, {xlow} AS xst FROM lst WHERE {have}),
prv AS (SELECT *, lag(st) OVER (PARTITION BY chunk_id ORDER BY pos) AS before FROM cov),
rnk AS (SELECT chunk_id, sum(0.1 / (1 + (pos - st) - (idx - xst))) AS text_score FROM prv
        WHERE before IS NULL OR st <> before GROUP BY chunk_id)"""


_RANK = f"""WITH {CHUNKS}, mine AS (SELECT * FROM chunks), {rank_sql(['the', 'that'], 'mine')},
txt AS (SELECT mine.chunk_id, CAST(coalesce(text_score, 0) AS DOUBLE) AS text_score FROM mine LEFT JOIN rnk USING (chunk_id))"""


@query("q_text_rank", f"""{_RANK}
SELECT chunk_id, round(text_score, 6) AS text_score FROM txt""")
def q_text_rank(spark: SparkSession, sf: str) -> DataFrame:
    mine = chunk_view(spark, sf).filter(Filters().predicate("docs"))
    return mine.select("chunk_id", F.round(lexical.text_score(F.col("text"), F.lit(TEXT)), 6).alias("text_score"))


@query("q_text_topk", f"""{_RANK}
SELECT chunk_id, round(text_score, 6) AS text_score FROM txt ORDER BY txt.text_score DESC, chunk_id LIMIT 80""")
def q_text_topk(spark: SparkSession, sf: str) -> DataFrame:
    mine = chunk_view(spark, sf).filter(Filters().predicate("docs"))
    top = lexical.text_topk(mine, TEXT, hybrid.DEFAULT_POOL)
    return top.withColumn("text_score", F.round("text_score", 6))


_POOLS = f"""{_RANK},
vp AS (SELECT m.chunk_id, {_VEC} AS vector_score, 0.0 AS text_score
       FROM mine m JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = m.chunk_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
       ORDER BY vector_score DESC, m.chunk_id LIMIT 80),
tp AS (SELECT chunk_id, 0.0 AS vector_score, text_score FROM txt ORDER BY txt.text_score DESC, chunk_id LIMIT 80),
cand AS (SELECT * FROM vp UNION ALL SELECT * FROM tp),
mrg AS (SELECT chunk_id, max(vector_score) AS vector_score, max(text_score) AS text_score FROM cand GROUP BY chunk_id)"""


# the same over the chunks that a filter on the context leaves
_ENGLISH = _POOLS.replace("mine AS (SELECT * FROM chunks)", "mine AS (SELECT * FROM chunks WHERE context = 'en')")


def _pools(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    mine = chunk_view(spark, sf).filter(Filters().predicate("docs"))
    mine_vectors = chunk_vectors(spark, sf).join(mine.select("chunk_id"), "chunk_id", "left_semi")
    return (
        vector.vector_topk(mine_vectors, probe_vector(spark, sf), hybrid.DEFAULT_POOL),
        lexical.text_topk(mine, TEXT, hybrid.DEFAULT_POOL),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.round(c, 6) for c in ("score", "vector_score", "text_score") if c in df.columns}
    )


@query("q_candidates", f"""{_POOLS}
SELECT chunk_id, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score FROM cand""")
def q_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.candidates(*_pools(spark, sf)))


@query("q_merge_max", f"""{_POOLS}
SELECT chunk_id, round(vector_score, 6) AS vector_score, round(text_score, 6) AS text_score FROM mrg""")
def q_merge_max(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(hybrid.merge_max(hybrid.candidates(*_pools(spark, sf)), "chunk_id"))


@query("q_hybrid", f"""{_ENGLISH},
top AS (SELECT *, 0.75 * vector_score + 0.25 * text_score AS score FROM mrg
        ORDER BY score DESC, vector_score DESC, text_score DESC, chunk_id LIMIT 8)
SELECT chunk_id, context, product, sha1(text) AS text_sha1, round(score, 6) AS score,
       round(vector_score, 6) AS vector_score, round(top.text_score, 6) AS text_score
FROM top JOIN mine USING (chunk_id)""")
def q_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    found = hybrid.hybrid_search(
        chunk_view(spark, sf), TEXT, probe_vector(spark, sf), filters=Filters(context="en"),
        vectors=chunk_vectors(spark, sf),
    )
    return _rounded(found).select(
        "chunk_id", "context", "product", F.sha1("text").alias("text_sha1"), "score", "vector_score",
        "text_score",
    )


@query("q_text_only", f"""{_RANK}
SELECT chunk_id, round(text_score, 6) AS score, CAST(0 AS DOUBLE) AS vector_score, round(text_score, 6) AS text_score
FROM txt ORDER BY txt.text_score DESC, chunk_id LIMIT 20""")
def q_text_only(spark: SparkSession, sf: str) -> DataFrame:
    found = hybrid.hybrid_search(chunk_view(spark, sf), TEXT, None, filters=Filters(), top_k=20)
    return _rounded(found).select("chunk_id", "score", "vector_score", "text_score")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def _index(spark: SparkSession, sf: str) -> postings.WordIndex:
    return postings.write_index(chunk_view(spark, sf), f"{scratch_dir(spark)}/words-{uuid.uuid4().hex}")


@query("q_word_index", f"""
WITH {CHUNKS}, w AS (SELECT chunk_id, unnest({words_sql('text')}) AS word FROM chunks)
SELECT word, count(DISTINCT chunk_id) AS chunks, count(*) AS places FROM w GROUP BY word""")
def q_word_index(spark: SparkSession, sf: str) -> DataFrame:
    """The stored word index of all chunks, as its words with their chunks and places."""
    return postings.index_words(_index(spark, sf))


def batch(spark: SparkSession, sf: str, top_k: int,
          weight: tuple[float, float] | None = None, index: postings.WordIndex | None = None) -> DataFrame:
    """All ``benchmark`` texts as queries, embedded with the default embedding."""
    asked = _asked(spark, sf).withColumn("embedding", hash_embedding(F.col("text"), DIM))
    return hybrid.hybrid_search_batch(
        chunk_view(spark, sf), asked, DIM, top_k=top_k, vectors=chunk_vectors(spark, sf),
        weight=weight, index=index,
    )


def batch_sql(top_k: int, wv: float = 0.75, wt: float = 0.25) -> str:
    """The whole of the batch search, ending in ``res`` (query_id, rank, chunk_id, scores)."""
    return f"""WITH {CHUNKS},
dtok AS (SELECT chunk_id, unnest({words_sql('text')}) AS tok, generate_subscripts({words_sql('text')}, 1) AS pos FROM chunks),
qt AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, unnest({words_sql('text')}) AS tok FROM benchmark),
qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
dset AS (SELECT DISTINCT chunk_id, tok FROM dtok),
full_ AS (SELECT query_id, chunk_id FROM qt JOIN dset USING (tok) JOIN qn USING (query_id)
          GROUP BY query_id, chunk_id, n HAVING count(*) = n),
occ AS (SELECT f.query_id, f.chunk_id, d.tok, d.pos,
               row_number() OVER (PARTITION BY f.query_id, f.chunk_id ORDER BY d.pos) AS idx
        FROM full_ f JOIN qt USING (query_id) JOIN dtok d ON d.chunk_id = f.chunk_id AND d.tok = qt.tok),
lst AS (SELECT a.query_id, a.chunk_id, a.pos, a.idx, b.tok, max(b.pos) AS lp, max(b.idx) AS lx
        FROM occ a JOIN occ b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos
        GROUP BY ALL),
cov AS (SELECT query_id, chunk_id, pos, idx, min(lp) AS st, min(lx) AS xst FROM lst JOIN qn USING (query_id)
        GROUP BY query_id, chunk_id, pos, idx, n HAVING count(*) = n),
prv AS (SELECT *, lag(st) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS before FROM cov),
txs AS (SELECT query_id, chunk_id, CAST(sum(0.1 / (1 + (pos - st) - (idx - xst))) AS DOUBLE) AS text_score FROM prv
        WHERE before IS NULL OR st <> before GROUP BY query_id, chunk_id),
alltx AS (SELECT qn.query_id, c.chunk_id, coalesce(text_score, 0) AS text_score
          FROM qn CROSS JOIN chunks c LEFT JOIN txs ON txs.query_id = qn.query_id AND txs.chunk_id = c.chunk_id),
tp AS (SELECT query_id, chunk_id, 0.0 AS vector_score, text_score FROM alltx
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY text_score DESC, chunk_id) <= 80),
qv AS (SELECT CAST(item_id AS VARCHAR) AS query_id, {hash_sql('text', DIM)} AS embedding FROM benchmark),
vp AS (SELECT q.query_id, c.chunk_id, {_VEC} AS vector_score, 0.0 AS text_score
       FROM chunks c JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = c.chunk_id CROSS JOIN qv q
       QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY vector_score DESC, c.chunk_id) <= 80),
mrg AS (SELECT query_id, chunk_id, max(vector_score) AS vector_score, max(text_score) AS text_score
        FROM (SELECT * FROM vp UNION ALL SELECT * FROM tp) GROUP BY query_id, chunk_id),
sc AS (SELECT *, {wv} * vector_score + {wt} * text_score AS score FROM mrg),
res AS (SELECT query_id, chunk_id, score, vector_score, text_score, CAST(row_number() OVER
          (PARTITION BY query_id ORDER BY score DESC, vector_score DESC, text_score DESC, chunk_id) AS INT) AS rank
        FROM sc QUALIFY rank <= {top_k})"""


@query("q_batch", f"""{batch_sql(10)}
SELECT query_id, rank, chunk_id, round(score, 6) AS score, round(vector_score, 6) AS vector_score,
       round(text_score, 6) AS text_score FROM res""")
def q_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(batch(spark, sf, 10)).select(
        "query_id", "rank", "chunk_id", "score", "vector_score", "text_score"
    )


@query("q_batch_indexed", f"""{batch_sql(10)}
SELECT query_id, rank, chunk_id, round(score, 6) AS score, round(vector_score, 6) AS vector_score,
       round(text_score, 6) AS text_score FROM res""")
def q_batch_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """``q_batch`` with the text scores from a stored word index, which this query writes first."""
    return _rounded(batch(spark, sf, 10, index=_index(spark, sf))).select(
        "query_id", "rank", "chunk_id", "score", "vector_score", "text_score"
    )


@query("q_get_chunk", f"""WITH {CHUNKS} SELECT chunk_id, context, product, sha1(text) AS text_sha1 FROM chunks WHERE chunk_id = '17'""")
def q_get_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return cat.get_chunk(chunk_view(spark, sf), "17").select(
        "chunk_id", "context", "product", F.sha1("text").alias("text_sha1")
    )


@query("q_catalog", f"""WITH {CHUNKS}
SELECT domain, context, product, CAST(NULL AS VARCHAR) AS version, CAST(NULL AS VARCHAR) AS module,
       CAST(NULL AS VARCHAR) AS routine_name, count(*) AS total
FROM chunks GROUP BY domain, context, product""")
def q_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return cat.catalog(chunk_view(spark, sf), "docs")


@query("q_stats", f"""WITH {CHUNKS}
SELECT coalesce(domain, '(all)') AS domain, count(*) AS total FROM chunks GROUP BY ROLLUP (domain)""")
def q_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cat.domain_stats(chunk_view(spark, sf))
