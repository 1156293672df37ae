"""The SQL each query must agree with, put together from named table expressions."""

from __future__ import annotations

import re

from folioscope.operators.context import ANSWER_INSTRUCTIONS
from folioscope.operators.summary import SUMMARY_INSTRUCTIONS
from registry.views import CONFIG, MARK, MAX_TOKENS

# Fixed values, written out here so that the SQL does not follow the library's lists.
CONTENT = "bookmark callout code equation paragraph quote toggle".split()
LIST_ITEMS = "bulleted_list_item numbered_list_item to_do".split()
HEADINGS = "heading_1 heading_2 heading_3".split()
BREAKS = "divider table_of_contents".split()
IGNORED = "breadcrumb child_database child_page column column_list embed file image link_preview link_to_page mention pdf synced_block table table_row template unsupported video".split()


def _in(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _tf(source: str, keys: str, text: str) -> str:
    return f"""
    SELECT {keys}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 256 AS bucket, count(*) AS tf
    FROM (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS tok FROM {source}) GROUP BY ALL"""


def _lead(text: str) -> str:
    return f"array_to_string(list_transform(list_slice(regexp_extract_all({text}, '[^.!?]+[.!?]?'), 1, 8), lambda s: trim(s, ' ')), ' ')"


TITLE = r"array_to_string(list_slice(regexp_extract_all(text, '\S+'), 1, 2), ' ')"
OVER = f"o.size + f.tokens > {MAX_TOKENS}"
ALL_OUT = f"(o.op = 'B' OR ({OVER} AND (o.op = 'C' OR o.size > f.tokens OR f.tokens = 0)))"
MOST_OUT = f"({OVER} AND len(f.open) > 2)"
NO_TEXTS = "CAST([] AS VARCHAR[])"

CTES = {
    "edits": "SELECT user_id AS page_id, event_id AS edit_id, ts AS last_edited, event_type AS title, value FROM events",
    "blocks": r"""
    SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'heading_1' WHEN pos = 1 THEN 'heading_2' WHEN pos % 7 = 2 OR pos % 14 = 3 THEN 'bulleted_list_item'
      WHEN pos % 14 = 10 THEN 'numbered_list_item' WHEN pos % 11 = 5 THEN 'divider' WHEN pos % 3 <> 0 THEN string_split(
        'bookmark breadcrumb bulleted_list_item callout child_database child_page code column column_list divider embed equation file heading_1 heading_2 heading_3 image link_preview link_to_page mention numbered_list_item paragraph pdf quote synced_block table table_of_contents table_row template to_do toggle unsupported video new_type', ' ')[pos % 34 + 1]
      ELSE 'paragraph' END AS btype,
           txt, len(regexp_extract_all(txt, '\S+')) AS n_tok
    FROM (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS txt
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    "classed": f"""
    SELECT *, CASE WHEN btype IN {_in(CONTENT)} THEN 'content' WHEN btype IN {_in(LIST_ITEMS)} THEN 'list' WHEN btype IN {_in(HEADINGS)} THEN 'heading'
                   WHEN btype IN {_in(BREAKS)} THEN 'break' WHEN btype IN {_in(IGNORED)} THEN 'ignored' ELSE 'other' END AS class,
           CASE WHEN btype IN {_in(LIST_ITEMS)} THEN btype WHEN btype IN {_in(HEADINGS)} THEN 'heading' END AS kind
    FROM blocks""",
    "lagged": "SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM classed",
    "started": "SELECT *, CASE WHEN kind IS NULL OR kind IS DISTINCT FROM prev THEN pos END AS start FROM lagged",
    "marked": "SELECT *, max(start) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM started",
    "units": """
    SELECT doc_id, unit, min(class) AS class, min(kind) AS kind, max(CASE WHEN start IS NOT NULL THEN prev END) AS prev,
           string_agg(txt, chr(10) ORDER BY pos) AS txt, CAST(sum(n_tok) AS BIGINT) AS n_tok
    FROM marked GROUP BY doc_id, unit""",
    "ops": """
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM (
      SELECT doc_id, unit * 2 AS ord, 'F' AS op, '' AS txt, 0 AS size FROM units WHERE prev IS NULL
      UNION ALL
      SELECT doc_id, unit * 2 + 1, CASE WHEN kind IS NOT NULL THEN 'F' WHEN class = 'content' THEN 'C' ELSE 'B' END,
             CASE WHEN class = 'break' THEN '' ELSE txt END, CASE WHEN class = 'break' THEN 0 ELSE n_tok END
      FROM units WHERE kind IS NOT NULL OR class IN ('content', 'break'))""",
    "fold": f"""
    SELECT doc_id, CAST(0 AS BIGINT) AS i, {NO_TEXTS} AS open, CAST(0 AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS out
    FROM (SELECT DISTINCT doc_id FROM ops)
    UNION ALL
    SELECT f.doc_id, o.i,
      CASE WHEN o.op = 'B' THEN {NO_TEXTS} WHEN {ALL_OUT} THEN [o.txt] WHEN {MOST_OUT} THEN [f.open[-1], o.txt] ELSE list_append(f.open, o.txt) END,
      CASE WHEN {ALL_OUT} THEN 0 WHEN {MOST_OUT} THEN f.last ELSE f.tokens END + o.size, o.size,
      CASE WHEN {ALL_OUT} THEN (CASE WHEN len(f.open) > 0 THEN array_to_string(f.open, chr(10)) END)
           WHEN {MOST_OUT} THEN array_to_string(f.open[:-2], chr(10)) END
    FROM fold f JOIN ops o ON o.doc_id = f.doc_id AND o.i = f.i + 1""",
    "chunks": """
    SELECT concat(doc_id, '_', chunk_id) AS id, doc_id, chunk_id, text FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) AS chunk_id, text FROM (
        SELECT doc_id, i, 0 AS part, out AS text FROM fold WHERE out IS NOT NULL
        UNION ALL
        SELECT f.doc_id, f.i, 1, array_to_string(f.open, chr(10)) FROM fold f
        JOIN (SELECT doc_id, max(i) AS i FROM ops GROUP BY doc_id) e ON e.doc_id = f.doc_id AND e.i = f.i WHERE len(f.open) > 0))""",
    "rebuilt": "SELECT doc_id, string_agg(text, chr(10) ORDER BY chunk_id) AS text FROM chunks GROUP BY doc_id",
    "titles": f"SELECT doc_id, {TITLE} AS title, source, lang FROM documents",
    "summaries": f"SELECT doc_id, {TITLE} AS title, {_lead('text')} AS document FROM documents",
    "reply": "SELECT item_id AS qid, string_split(replace(text, '. ', ';'), ';') AS l FROM benchmark",
    "query": "SELECT qid, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS qpos, unnest(l) AS query FROM reply",
    "query_tf": _tf("query", "qid, qpos", "query"),
    "question_tf": _tf("benchmark", "item_id", "text"),
    "document_tf": _tf("documents", "doc_id", "text"),
    "summary_tf": _tf("summaries", "doc_id", "document"),
    "query_norm": "SELECT q.qid, q.qpos, coalesce(sum(tf * tf), 0) AS n FROM query q LEFT JOIN query_tf t USING (qid, qpos) GROUP BY ALL",
    "question_norm": "SELECT q.item_id, coalesce(sum(tf * tf), 0) AS n FROM benchmark q LEFT JOIN question_tf t USING (item_id) GROUP BY ALL",
    "document_norm": "SELECT d.doc_id, coalesce(sum(tf * tf), 0) AS n FROM documents d LEFT JOIN document_tf t USING (doc_id) GROUP BY ALL",
    "summary_norm": "SELECT d.doc_id, d.title, coalesce(sum(tf * tf), 0) AS n FROM summaries d LEFT JOIN summary_tf t USING (doc_id) GROUP BY ALL",
    "summary_dot": "SELECT qid, qpos, doc_id, sum(q.tf * d.tf) AS dot FROM query_tf q JOIN summary_tf d USING (bucket) GROUP BY ALL",
    "hits": f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, qpos ORDER BY distance, doc_id) AS rank FROM (
        SELECT q.qid, q.qpos, d.doc_id, d.title, CAST(q.n + d.n - 2 * coalesce(t.dot, 0) AS DOUBLE) AS distance
        FROM query_norm q CROSS JOIN summary_norm d LEFT JOIN summary_dot t ON t.qid = q.qid AND t.qpos = q.qpos AND t.doc_id = d.doc_id))
    WHERE rank <= {CONFIG.summary_results}""",
    "fused": """
    SELECT qid, doc_id, arg_min(title, qpos * 1000 + rank) AS title, min(qpos * 1000 + rank) AS seen,
           list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST(1 AS DOUBLE) / rank ORDER BY qpos)), lambda a, b: a + b) AS score
    FROM hits GROUP BY qid, doc_id""",
    "kept": f"""
    SELECT qid, pos, doc_id, title, score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS pos,
             max(score) OVER (PARTITION BY qid) AS top, min(score) OVER (PARTITION BY qid) AS bottom FROM fused)
    WHERE score >= top - CAST({CONFIG.threshold} AS DOUBLE) * (top - bottom)""",
    "wanted_chunks": "SELECT * FROM chunks WHERE doc_id IN (SELECT doc_id FROM kept)",
    "chunk_tf": _tf("wanted_chunks", "id, doc_id", "text"),
    "chunk_norm": "SELECT c.id, c.doc_id, coalesce(sum(tf * tf), 0) AS n FROM wanted_chunks c LEFT JOIN chunk_tf t USING (id) GROUP BY ALL",
    "chunk_dot": """
    SELECT k.qid, d.id, sum(q.tf * d.tf) AS dot FROM kept k JOIN chunk_tf d ON d.doc_id = k.doc_id
    JOIN question_tf q ON q.item_id = k.qid AND q.bucket = d.bucket GROUP BY ALL""",
    "near": f"""
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY distance, id) AS rank FROM (
        SELECT k.qid, k.pos, k.doc_id, c.id, CAST(q.n + c.n - 2 * coalesce(t.dot, 0) AS DOUBLE) AS distance
        FROM kept k JOIN chunk_norm c ON c.doc_id = k.doc_id JOIN question_norm q ON q.item_id = k.qid
        LEFT JOIN chunk_dot t ON t.qid = k.qid AND t.id = c.id))
    WHERE rank <= {CONFIG.chunk_results}""",
    "walked": r"""
    SELECT n.*, c.chunk_id, c.text,
           CAST(sum(len(regexp_extract_all(c.text, '\S+'))) OVER (PARTITION BY n.qid ORDER BY n.distance, n.pos, n.rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens
    FROM near n JOIN chunks c ON c.id = n.id""",
    "snips": f"SELECT * FROM walked WHERE cum_tokens <= {CONFIG.budget}",
    "doc_texts": """
    SELECT s.qid, k.pos AS number, s.doc_id, k.title, s.text FROM (
      SELECT qid, doc_id, string_agg(text, ' ' ORDER BY chunk_id) AS text FROM snips GROUP BY qid, doc_id) s
    JOIN kept k ON k.qid = s.qid AND k.doc_id = s.doc_id""",
    "contexts": """
    SELECT k.qid, coalesce(c.context, '') AS context FROM (SELECT DISTINCT qid FROM kept) k LEFT JOIN (
      SELECT qid, string_agg('======' || chr(10) || ' document ' || number || chr(10) || ' title ' || title || chr(10) || ' ' || text || chr(10), chr(10) ORDER BY number) AS context
      FROM doc_texts GROUP BY qid) c USING (qid)""",
    "calls": """
    SELECT conv_id AS qid, turn, CASE WHEN role = 'assistant' THEN 'm1' ELSE 'm0' END AS model,
           CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS completion_tokens,
           CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END AS prompt_tokens, CAST(length(text) AS BIGINT) * 1000 AS response_us
    FROM conversations""",
    "stripped": r"""
    SELECT conv_id, turn, role, role IN ('assistant', 'function') AS ok, regexp_replace(' ' || chr(10) || text || chr(9) || ' ', '^\s+|\s+$', '', 'g') AS content
    FROM conversations""",
}


def _needs(sql: str, found: dict[str, None]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"(FROM|JOIN)\s+{name}\b", sql):
            found[name] = None
            _needs(body, found)


def _with(sql: str) -> str:
    found: dict[str, None] = {}
    _needs(sql, found)
    parts = [f"{name} AS {'' if name == 'fold' else 'MATERIALIZED '}({CTES[name]})" for name in CTES if name in found]
    return f"WITH RECURSIVE {', '.join(parts)}\n{sql}" if parts else sql


def _newest(source: str, keys: str, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY last_edited DESC, edit_id DESC) AS n FROM {source}) WHERE n = 1"


def _usage(keys: str) -> str:
    return f"""SELECT {keys}, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
      CAST(sum(completion_tokens) + sum(prompt_tokens) AS BIGINT) AS total_tokens, CAST(sum(response_us) AS BIGINT) AS response_us
      FROM calls GROUP BY {keys}"""


RUNNING = "OVER (PARTITION BY model ORDER BY qid, turn ROWS UNBOUNDED PRECEDING)"
DATE = "lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')"
N_DOCS = "(SELECT count(*) FROM documents)"
RELATED = f"""SELECT d.doc_id, a.title || ';' || b.title AS related FROM documents d
  JOIN titles a ON a.doc_id = (d.doc_id + 1) % {N_DOCS} JOIN titles b ON b.doc_id = (d.doc_id + 2) % {N_DOCS}"""
ALL_PAIRS = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(i.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), lambda a, b: a + b)"
VECTOR_KNN = f"""SELECT qid, rank, doc_id, distance, CAST(1 AS DOUBLE) / rank AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, doc_id) AS rank FROM (
    SELECT q.vec_id AS qid, i.vec_id AS doc_id, {ALL_PAIRS} AS distance FROM embeddings q CROSS JOIN embeddings i))
  WHERE rank <= {CONFIG.summary_results}"""
PROMPT = f"""SELECT qid, CAST(0 AS BIGINT) AS seq, 'system' AS role, context AS content FROM contexts
  UNION ALL SELECT qid, 1, 'system', {_text(ANSWER_INSTRUCTIONS)} FROM contexts
  UNION ALL SELECT qid, 2, 'user', b.text FROM contexts c JOIN benchmark b ON b.item_id = c.qid"""

BODIES = {
    "changed_pages": _newest(f"(SELECT * FROM edits WHERE last_edited > TIMESTAMP '{MARK}')", "page_id", "page_id, edit_id, last_edited, title"),
    "read_mark": "SELECT title AS loader, max(last_edited) AS ts FROM edits GROUP BY title UNION ALL SELECT 'never_run', TIMESTAMP '1970-01-01 00:00:00'",
    "advance_mark": f"""SELECT coalesce(b.loader, a.loader) AS loader, coalesce(b.ts, a.ts) AS ts FROM
      (SELECT title AS loader, max(last_edited) AS ts FROM edits WHERE last_edited <= TIMESTAMP '{MARK}' GROUP BY title) a
      FULL JOIN (SELECT title AS loader, max(last_edited) AS ts FROM edits WHERE value > 50 GROUP BY title) b ON a.loader = b.loader""",
    "upsert_pages": _newest("edits", "page_id", "page_id, edit_id, title"),
    "ingest_by_loader": _newest(f"""(SELECT e.page_id, e.edit_id, e.last_edited, e.title AS loader FROM edits e LEFT JOIN
      (SELECT title, max(last_edited) AS ts FROM edits WHERE last_edited <= TIMESTAMP '{MARK}' GROUP BY title) m ON m.title = e.title
      WHERE e.last_edited > coalesce(m.ts, TIMESTAMP '1970-01-01 00:00:00'))""", "loader, page_id", "loader, page_id, edit_id"),
    "fetch_pages": "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "page_blocks": "SELECT doc_id, pos, txt FROM blocks WHERE doc_id IN (SELECT doc_id FROM labels)",
    "page_blocks_first": "SELECT doc_id, pos, txt FROM blocks WHERE pos < 3",
    "mark_text": """SELECT title AS loader, strftime(max(last_edited) - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS mark FROM edits GROUP BY title
      UNION ALL SELECT 'never_run', '1970-01-01T00:00:00.000000+00:00'""",
    "index_upsert": _newest("edits", "page_id", "page_id, edit_id, title"),
    "ingest_chunks": rf"""SELECT c.id, c.doc_id, c.chunk_id, CASE WHEN c.doc_id % 2 = 1 THEN t.source || ' ' || t.lang ELSE t.title END AS title,
      CASE WHEN c.doc_id % 2 = 0 THEN t.source || ' ' || t.lang END AS source, '2024-02-' || lpad(CAST(c.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS last_edited_time,
      c.text AS document, len(regexp_extract_all(lower(c.text), '[\p{{L}}\p{{N}}]+')) AS n_words FROM chunks c JOIN titles t ON t.doc_id = c.doc_id""",
    "ingest_summaries": rf"""SELECT doc_id, title, source, document, len(regexp_extract_all(lower(document), '[\p{{L}}\p{{N}}]+')) AS n_words FROM (
      SELECT t.doc_id, CASE WHEN t.doc_id % 2 = 1 THEN t.source || ' ' || t.lang ELSE t.title END AS title, CASE WHEN t.doc_id % 2 = 0 THEN t.source || ' ' || t.lang END AS source,
        {_lead("coalesce(r.text, '')")} AS document FROM titles t LEFT JOIN rebuilt r ON r.doc_id = t.doc_id)""",
    "ingest_sources": """SELECT loader, n_chunks, n_summaries, 1709251200 + 60 * newest AS mark_s, true AS fed_once FROM
      (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS loader, count(*) AS n_summaries, max(doc_id) AS newest FROM documents GROUP BY 1)
      JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS loader, count(*) AS n_chunks FROM chunks GROUP BY 1) USING (loader)""",
    "embedding_hook": "SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, ' ', '')) AS n_blanks FROM documents",
    "summary_usage": rf"""SELECT CAST(c AS BIGINT) AS completion_tokens, CAST(c + p AS BIGINT) AS prompt_tokens, CAST(2 * c + p AS BIGINT) AS total_tokens FROM
      (SELECT sum(len(regexp_extract_all(text, '\S+'))) AS c, count(*) * len(regexp_extract_all({_text(SUMMARY_INSTRUCTIONS)}, '\S+')) AS p FROM rebuilt)""",
    "stream_indexes": f"""SELECT 'chunk' AS kind, c.id, t.title, c.text AS document FROM chunks c JOIN titles t ON t.doc_id = c.doc_id
      UNION ALL SELECT 'summary', CAST(t.doc_id AS VARCHAR), t.title, {_lead("coalesce(r.text, '')")} FROM titles t LEFT JOIN rebuilt r ON r.doc_id = t.doc_id""",
    "stream_ingest": _newest("edits", "page_id", "page_id, edit_id, title"),
    "props": f"""SELECT doc_id, 'title' AS key, title AS value FROM titles UNION ALL SELECT doc_id, 'source', source || ' ' || lang FROM documents
      UNION ALL SELECT doc_id, 'edited', '2024-02-' || {DATE} FROM documents UNION ALL SELECT doc_id, 'date', '2024-01-' || {DATE} FROM documents WHERE doc_id % 5 <> 0""",
    "relation_titles": RELATED,
    "project_metadata": f"""SELECT d.doc_id, t.title, '2024-02-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS last_edited_time,
      d.source || ' ' || d.lang AS meta_title, r.related AS meta_related,
      CASE WHEN d.doc_id % 5 <> 0 THEN '2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS meta_date
      FROM documents d JOIN titles t ON t.doc_id = d.doc_id JOIN ({RELATED}) r ON r.doc_id = d.doc_id""",
    "merged_metadata": """SELECT d.doc_id, 'title' AS key, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'quality ' || l.quality END AS value
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
      UNION ALL SELECT doc_id, 'last_edited_time', lang FROM documents UNION ALL SELECT doc_id, 'toxic', 'yes' FROM labels WHERE toxic = 1
      AND doc_id IN (SELECT doc_id FROM documents)""",
    "block_classes": "SELECT btype, class, count(*) AS n, CAST(sum(n_tok) AS BIGINT) AS n_tok FROM classed GROUP BY btype, class",
    "content_text": r"""SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN '<caption> fig ' || pos || ' <\caption> ' ELSE '' END || txt ||
      CASE WHEN pos % 5 = 0 THEN '<equation> x = ' || pos || ' <\equation> ' ELSE '' END AS txt FROM blocks""",
    "raw_blocks": r"""SELECT doc_id, pos, btype, made AS txt, len(regexp_extract_all(made, '\S+')) AS n_tok FROM (
      SELECT doc_id, pos, btype, CASE WHEN class = 'content' THEN CASE WHEN pos % 4 = 0 THEN '<caption> fig ' || pos || ' <\caption> ' ELSE '' END || txt || '|' ||
        CASE WHEN pos % 5 = 0 THEN '<equation> x <\equation> ' ELSE '' END WHEN kind IS NOT NULL THEN txt || '|' ELSE '' END AS made FROM classed)""",
    "token_counts": r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_tok FROM documents",
    "token_hook": r"SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n_tok FROM documents",
    "block_runs": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run, kind, txt AS text, n_tok FROM units WHERE kind IS NOT NULL""",
    "chunks": "SELECT id, doc_id, chunk_id, text FROM chunks",
    "exploded_chunks": "SELECT id, doc_id, chunk_id, text AS document FROM chunks",
    "full_text": "SELECT doc_id, text FROM rebuilt",
    "summary_prompt": f"""SELECT doc_id, CAST(0 AS BIGINT) AS seq, 'system' AS role, {_text(SUMMARY_INSTRUCTIONS)} AS content FROM rebuilt
      UNION ALL SELECT doc_id, 1, 'user', text FROM rebuilt""",
    "chunk_index": """SELECT c.id, CAST(c.doc_id AS VARCHAR) AS doc_id, c.chunk_id, t.source AS title, t.lang AS last_edited_time,
      CAST(c.chunk_id AS VARCHAR) AS meta_chunk_id, c.text AS document FROM chunks c JOIN titles t ON t.doc_id = c.doc_id""",
    "summary_index": f"SELECT r.doc_id AS id, t.title, t.source, {_lead('r.text')} AS document FROM rebuilt r JOIN titles t ON t.doc_id = r.doc_id",
    "lead_summary": "SELECT doc_id AS id, title, document FROM summaries",
    "text_vectors": "SELECT doc_id, bucket, tf FROM document_tf",
    "text_knn": """SELECT item_id, rank, doc_id, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM (
        SELECT q.item_id, d.doc_id, CAST(q.n + d.n - 2 * coalesce(t.dot, 0) AS DOUBLE) AS distance FROM question_norm q CROSS JOIN document_norm d
        LEFT JOIN (SELECT item_id, doc_id, sum(q.tf * d.tf) AS dot FROM question_tf q JOIN document_tf d USING (bucket) GROUP BY ALL) t
        ON t.item_id = q.item_id AND t.doc_id = d.doc_id)) WHERE rank <= 5""",
    "text_knn_full": """SELECT item_id, rank, doc_id, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM (
        SELECT q.item_id, d.doc_id, CAST(q.n + d.n - 2 * coalesce(t.dot, 0) AS DOUBLE) AS distance FROM question_norm q CROSS JOIN document_norm d
        LEFT JOIN (SELECT item_id, doc_id, sum(q.tf * d.tf) AS dot FROM question_tf q JOIN document_tf d USING (bucket) GROUP BY ALL) t
        ON t.item_id = q.item_id AND t.doc_id = d.doc_id)) WHERE rank <= 20""",
    "vector_knn": VECTOR_KNN,
    "vector_knn_cells": VECTOR_KNN,
    "fused_scores": "SELECT qid, doc_id, title, score FROM fused",
    "shortlist": "SELECT qid, pos, doc_id, title, score FROM kept",
    "shortlist_report": "SELECT qid, pos, printf('%.2f', score) AS shown, score, title FROM kept",
    "shortlist_text": """SELECT qid, 'Considering the following ' || count(*) || ' relevant documents.' || chr(10) ||
      string_agg(printf('%.2f', score) || ' ' || chr(9) || ' ' || title || chr(10), '' ORDER BY pos) AS report FROM kept GROUP BY qid""",
    "knn_within": "SELECT qid, doc_id, rank, id, distance FROM near",
    "snippets": "SELECT qid, id, doc_id, chunk_id, distance, cum_tokens FROM snips",
    "doc_snippets": "SELECT qid, number, doc_id, text FROM doc_texts",
    "context": "SELECT qid, context FROM contexts",
    "prompt": PROMPT,
    "answers": r"""SELECT c.qid, 'assistant' AS role, regexp_replace(b.text, '^\s+|\s+$', '', 'g') AS content, len(regexp_extract_all(b.text, '\S+')) AS completion_tokens
      FROM contexts c JOIN benchmark b ON b.item_id = c.qid""",
    "transcript": r"""SELECT item_id AS qid, CAST(0 AS BIGINT) AS seq, 'system' AS role,
      'Expanding your queries: ' || chr(10) || ' ' || replace(text, '. ', ';') || chr(10) AS content, length(text) AS completion_tokens FROM benchmark
      UNION ALL SELECT qid, 1, 'system', 'Considering the following ' || count(*) || ' relevant documents.' || chr(10) ||
        string_agg(printf('%.2f', score) || ' ' || chr(9) || ' ' || title || chr(10), '' ORDER BY pos), NULL FROM kept GROUP BY qid
      UNION ALL SELECT c.qid, 2, 'assistant', regexp_replace(b.text, '^\s+|\s+$', '', 'g'), len(regexp_extract_all(b.text, '\S+'))
        FROM contexts c JOIN benchmark b ON b.item_id = c.qid""",
    "split_queries": """SELECT conv_id, turn, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS qpos, unnest(l) AS query
      FROM (SELECT conv_id, turn, string_split(text, '.') AS l FROM conversations WHERE role = 'user')""",
    "query_report": "SELECT item_id AS qid, replace(text, '. ', ';') AS queries FROM benchmark",
    "requests": """SELECT conv_id, turn, CAST(0 AS BIGINT) AS seq, 'system' AS role, 'go on' AS content FROM conversations
      UNION ALL SELECT conv_id, turn, 1, role, text FROM conversations""",
    "replies": "SELECT conv_id, turn, ok, content, role || ': ' || content AS rendered FROM stripped",
    "completions": r"""SELECT conv_id, 'assistant' AS reply_role, reply AS reply_content, len(regexp_extract_all(reply, '\S+')) AS completion_tokens, CAST(words AS BIGINT) AS prompt_tokens FROM
      (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (role = 'user'), '') AS reply, sum(len(regexp_extract_all(text, '\S+'))) AS words FROM conversations GROUP BY conv_id)""",
    "usage": _usage("qid, model"),
    "usage_by_model": _usage("model"),
    "running_usage": f"""SELECT qid, turn, model, CAST(sum(completion_tokens) {RUNNING} AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens) {RUNNING} AS BIGINT) AS prompt_tokens,
      CAST(sum(completion_tokens + prompt_tokens) {RUNNING} AS BIGINT) AS total_tokens, CAST(sum(response_us) {RUNNING} AS BIGINT) AS response_us FROM calls""",
}

ORACLE = {name: _with(body) for name, body in BODIES.items()}
ORACLE["chunks_full"] = _with("SELECT doc_id, chunk_id, text FROM chunks").replace(f"> {MAX_TOKENS}", "> 1024")


def _full(name: str) -> str:
    """The SQL of ``name`` at the defaults: chunks of 1,024 tokens, 50 a document, a budget of 12,288."""
    sql = ORACLE[name].replace(f"> {MAX_TOKENS}", "> 1024").replace(f"cum_tokens <= {CONFIG.budget}", "cum_tokens <= 12288")
    return re.sub(rf"rank <= {CONFIG.chunk_results}\b", "rank <= 50", sql)


for _name in ("knn_within", "snippets", "context", "prompt", "answers", "transcript"):
    ORACLE[f"{_name}_full"] = _full(_name)
ORACLE["context"] = ORACLE["context_full"]  # without the small chunks, results and budget of the others

ORACLE["usage_stream"] = ORACLE["usage_by_model"]
ORACLE["changed_pages_log"] = ORACLE["changed_pages"]
