"""SQL of the same results, for the checks: common table expressions and macros as text."""

from __future__ import annotations

from recallforge.functions import text as tx

SP = tx.SPACES
PUNCTUATION = tx.PUNCTUATION.replace("'", "''")


def terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{tx.TERM}')"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{tx.WORD}')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def key_of(x: str) -> str:
    return f"lower({trimmed(x)})"


def normalised(x: str) -> str:
    bare = f"regexp_replace(translate(lower({x}), '{PUNCTUATION}', ''), '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    # neighbouring articles share their boundary: twice is enough for any number
    bare = f"regexp_replace({bare}, '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g')"
    return f"array_to_string({words(bare)}, ' ')"


def contains(answer: str, references: str) -> str:
    return f"coalesce(len(list_filter({references}, lambda r: {normalised('r')} <> '' AND contains(' ' || {normalised(answer)} || ' ', ' ' || {normalised('r')} || ' '))) > 0, false)"


PAGES = f"""
pages AS (
  SELECT page_id, title, text, words, record_id FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY words DESC, record_id) AS place FROM (
      SELECT {key_of('page_id')} AS page_id, record_id, coalesce(title, '') AS title, text, len({words('text')}) AS words
      FROM page_records WHERE page_id IS NOT NULL AND text IS NOT NULL) WHERE words > 0) WHERE place = 1)"""

QUESTIONS = f"""
asked AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY built_at DESC NULLS LAST, question DESC NULLS LAST, page_id DESC NULLS LAST,
      answer_start DESC NULLS LAST, answer_end DESC NULLS LAST, short_answers DESC NULLS LAST, answer_type DESC NULLS LAST) AS place
    FROM (SELECT question_id, question, {key_of('page_id')} AS page_id, answer_start, answer_end, short_answers, answer_type, built_at FROM questions)) WHERE place = 1)"""


def chunks(size: int = 150, overlap: int = 30, source: str = "pages") -> str:
    stride = size - overlap
    return f"""
pieces AS (SELECT page_id, unnest(regexp_extract_all(text, '{tx.WORD}|[{SP}]+')) AS piece, generate_subscripts(regexp_extract_all(text, '{tx.WORD}|[{SP}]+'), 1) AS i FROM {source}),
ends AS (SELECT page_id, i, piece, sum(length(piece)) OVER (PARTITION BY page_id ORDER BY i) AS e FROM pieces),
placed AS (SELECT page_id, e - length(piece) AS s, e, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS w, count(*) OVER (PARTITION BY page_id) AS n
  FROM ends WHERE regexp_matches(piece, '^{tx.WORD}')),
windows AS (SELECT page_id, s, e, unnest(generate_series(CAST(greatest(ceil((w - {size} + 1) / {stride}.0), 0) AS BIGINT),
  CAST(least(floor(w / {stride}.0), ceil(greatest(n - {size}, 0) / {stride}.0)) AS BIGINT))) AS position FROM placed),
spans AS (SELECT page_id, position, min(s) AS s, max(e) AS e FROM windows GROUP BY ALL),
chunks AS (SELECT page_id || '#' || position AS chunk_id, page_id, position, title || chr(10) || substring(text, CAST(s AS INT) + 1, CAST(e - s AS INT)) AS text, s AS "start", e AS "end"
  FROM spans JOIN {source} USING (page_id))"""


POSTINGS = f"""
tok AS (SELECT chunk_id, page_id, {terms('text')} AS terms FROM chunks),
totals AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM tok),
tfs AS (SELECT chunk_id, page_id, length, term, count(*) AS tf FROM (SELECT chunk_id, page_id, len(terms) AS length, unnest(terms) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
postings AS (SELECT term, chunk_id, page_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (1 - 0.4 + 0.4 * length / mean)) AS weight
  FROM tfs JOIN dfs USING (term), totals)"""

SCORES = f"""
qterms AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({terms('question')}) AS term FROM asked) GROUP BY ALL),
scores AS (SELECT question_id, chunk_id, page_id, round(sum(qtf * weight), 9) AS score FROM postings JOIN qterms USING (term) GROUP BY ALL)"""


def ranked(depth: int = 100) -> str:
    return f"""
ranking AS (SELECT * FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, page_id, score FROM scores WHERE score > 0) WHERE rank <= {depth})"""


QRELS = """
qrels AS (SELECT DISTINCT question_id, chunk_id AS doc_id, 1 AS grade FROM asked JOIN chunks USING (page_id) WHERE chunks."start" < answer_end AND answer_start < chunks."end")"""

BM25 = ",".join((PAGES, QUESTIONS, chunks(), POSTINGS, SCORES))


def metrics(cutoffs: list[int], ranking: str = "ranking", doc: str = "chunk_id") -> str:
    parts = []
    for k in cutoffs:
        parts += [
            f"SELECT question_id, 'precision@{k}' AS metric, coalesce(h{k}, 0) / {k} AS value FROM joined",
            f"SELECT question_id, 'recall@{k}', coalesce(h{k}, 0) / relevant FROM joined",
            f"SELECT question_id, 'ndcg@{k}', coalesce(d{k}, 0) / i{k} FROM joined",
            f"SELECT question_id, 'rr@{k}', CASE WHEN f <= {k} THEN 1.0 / f ELSE 0 END FROM joined",
        ]
    ideal = ", ".join(f"sum(CASE WHEN place <= {k} THEN grade / log2(place + 1) END) AS i{k}" for k in cutoffs)
    found = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN grade / log2(rank + 1) END) AS d{k}" for k in cutoffs)
    return f"""
ideal AS (SELECT question_id, count(*) AS relevant, {ideal} FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY grade DESC, doc_id) AS place FROM qrels WHERE grade > 0) GROUP BY 1),
hits AS (SELECT r.question_id, {found}, min(rank) AS f FROM {ranking} r JOIN qrels q ON r.question_id = q.question_id AND r.{doc} = q.doc_id WHERE grade > 0 AND rank <= {max(cutoffs)} GROUP BY 1),
joined AS (SELECT * FROM ideal LEFT JOIN hits USING (question_id)),
metrics AS ({' UNION ALL '.join(parts)})"""


#: Every hundredth vector asks for others of its label, against all.
DENSE = """
dense AS (SELECT 'q' || lpad(CAST(q.vec_id AS VARCHAR), 12, '0') AS question_id, 'v' || v.vec_id AS chunk_id, 'p' || (v.vec_id % 50) AS page_id,
  round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score, q.label AS ql, v.label AS vl
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
scores AS (SELECT question_id, chunk_id, page_id, score FROM dense),
ranking AS (SELECT * FROM (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, page_id, score FROM scores) WHERE rank <= 100),
qrels AS (SELECT question_id, chunk_id AS doc_id, 1 AS grade FROM dense WHERE ql = vl)"""

LATEST = """
latest AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY setup ORDER BY run_at DESC, run_id DESC) AS place FROM (SELECT DISTINCT * EXCLUDE (recall_at_10_by_type) FROM retrieval_rows)) WHERE place = 1),
tabled AS (SELECT *, row_number() OVER (ORDER BY passage_ndcg_at_10 DESC NULLS LAST, setup) AS place FROM latest)"""

LONG_RUNS = """
long AS (SELECT DISTINCT setup, CAST(run_at AS DATE) AS day, passage_ndcg_at_10 AS v, run_id FROM retrieval_rows WHERE passage_ndcg_at_10 IS NOT NULL),
daily AS (SELECT setup, CAST(day AS VARCHAR) AS question_id, avg(v) AS value FROM long GROUP BY ALL)"""
