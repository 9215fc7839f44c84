"""SQL that gives the same rows as the queries, where SQL can over whole tables.

The others need NFKC, a tokenizer, a fitted chain or title keys, which SQL lacks;
they are held against brute force in the tests.
"""

from __future__ import annotations

_TERMS = r"regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')"
_RECORDS = f"""w AS (SELECT 'passage' AS kind, k AS record_key, unnest({_TERMS}) AS term FROM (SELECT DISTINCT CAST(pid AS VARCHAR) AS k, text AS t FROM passages WHERE pid IS NOT NULL AND text IS NOT NULL)
  UNION ALL SELECT 'question', k, unnest({_TERMS}) FROM (SELECT DISTINCT qid AS k, question AS t FROM questions WHERE qid IS NOT NULL AND question IS NOT NULL)),
c AS (SELECT kind, record_key, term, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c WHERE kind = 'passage' GROUP BY 1)"""
_ITEMS = """i AS (SELECT qid, pid, max(CASE WHEN isfinite(dense) THEN dense ELSE '-infinity'::DOUBLE END) AS dense, max(CASE WHEN isfinite(bm25) THEN bm25 ELSE '-infinity'::DOUBLE END) AS bm25,
  max(CASE WHEN isfinite(hybrid) THEN hybrid ELSE '-infinity'::DOUBLE END) AS hybrid FROM retrieved WHERE qid IS NOT NULL AND pid IS NOT NULL GROUP BY 1, 2)"""
_RANK = lambda s: f"rank() OVER (PARTITION BY qid ORDER BY {s} DESC) + (count(*) OVER (PARTITION BY qid, {s}) - 1) / 2"

_TIMES = """p AS (SELECT DISTINCT * FROM predictions_a), l AS (SELECT run_id, 't_retrieval' AS stage, t_retrieval AS x FROM p UNION ALL SELECT run_id, 't_reader', t_reader FROM p UNION ALL SELECT run_id, 't_features', t_features FROM p)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH {_RECORDS} SELECT kind, record_key, term FROM c JOIN d USING (term) WHERE df BETWEEN 2 AND 8 AND (kind = 'question' OR tf >= 3)",
    "p3_scores": f"""WITH {_RECORDS}, f AS (SELECT term, sum(tf) AS cf FROM c GROUP BY 1), l AS (SELECT kind, record_key, sum(tf) AS length FROM c GROUP BY 1, 2), t AS (SELECT CAST(sum(tf) AS DOUBLE) AS total FROM c),
      r AS (SELECT c.*, df, cf / total AS g, (tf + 100.0::DOUBLE * (cf / total)) / (length + 100.0::DOUBLE) AS p FROM c JOIN d USING (term) JOIN f USING (term) JOIN l USING (kind, record_key), t WHERE df >= 2)
      SELECT kind, record_key, term, tf, df, round(p * ln(p / g), 9) AS score FROM r""",
    "p5_run_quantiles": f"WITH {_TIMES} SELECT run_id, stage, q, count(*) AS n, round(CASE q WHEN 0.5 THEN quantile_cont(x, 0.5) WHEN 0.9 THEN quantile_cont(x, 0.9) WHEN 0.95 THEN quantile_cont(x, 0.95) ELSE quantile_cont(x, 0.99) END, 9) AS exact FROM l, (SELECT unnest([0.5::DOUBLE, 0.9, 0.95, 0.99]) AS q) WHERE isfinite(x) AND x >= 0 GROUP BY 1, 2, 3",
    "p5_combined": f"WITH {_TIMES} SELECT stage, q, count(*) AS n, true AS within FROM l, (SELECT unnest([0.5::DOUBLE, 0.9, 0.95, 0.99]) AS q) WHERE isfinite(x) AND x >= 0 AND run_id IS NOT NULL GROUP BY 1, 2",
    "p5_found": """WITH p AS (SELECT DISTINCT * FROM predictions_a), l AS (SELECT run_id, 't_retrieval' AS stage, t_retrieval AS x FROM p UNION ALL SELECT run_id, 't_reader', t_reader FROM p UNION ALL SELECT run_id, 't_features', t_features FROM p)
      SELECT run_id, stage FROM l WHERE isfinite(x) AND x >= 0 GROUP BY 1, 2 HAVING quantile_cont(x, 0.95) >= 4 * quantile_cont(x, 0.5)""",
    "p6_found": f"""WITH {_ITEMS} SELECT qid, pid FROM i WHERE NOT EXISTS (SELECT 1 FROM i o WHERE o.qid = i.qid AND o.pid <> i.pid
      AND CAST(i.dense > o.dense AS INT) + CAST(i.bm25 > o.bm25 AS INT) + CAST(i.hybrid > o.hybrid AS INT) < 2)""",
    "p6_ranking": f"""WITH {_ITEMS}, r AS (SELECT qid, pid, count(*) OVER (PARTITION BY qid) AS n, {_RANK('dense')} AS rank_dense, {_RANK('bm25')} AS rank_bm25, {_RANK('hybrid')} AS rank_hybrid FROM i),
      m AS (SELECT *, list_sort([rank_dense, rank_bm25, rank_hybrid])[2] AS median_rank, (rank_dense + rank_bm25 + rank_hybrid) / 3 AS mean_rank FROM r)
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY median_rank, mean_rank, pid) AS place FROM m""",
}
