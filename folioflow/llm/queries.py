"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from folioflow.llm.bpe import op3_bpe
from folioflow.llm.chat import OP4_SQL, op4_chat_format
from folioflow.llm.decontaminate import op1_decontaminate
from folioflow.llm.fingerprints import op5_fingerprints
from folioflow.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from folioflow.llm.licenses import op8_license_scan
from folioflow.llm.line_dedup import op10_line_dedup
from folioflow.llm.merkle import OP12_SQL, op12_merkle
from folioflow.llm.near_dedup import op7_near_dedup
from folioflow.llm.quality import op6_quality
from folioflow.llm.token_counts import op9_token_counts
from folioflow.llm.token_files import op2_token_files
from folioflow.llm.url_filter import OP13_SQL, op13_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_token_files, op3_bpe, op4_chat_format, op5_fingerprints, op6_quality, op7_near_dedup, op8_license_scan, op9_token_counts, op10_line_dedup, op11_hard_negatives, op12_merkle, op13_url_filter)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
component AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN component c ON c.doc_id = d.doc_id
"""

ORACLES = {"op4_chat_format": OP4_SQL, "op7_near_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_merkle": OP12_SQL, "op13_url_filter": OP13_SQL}
