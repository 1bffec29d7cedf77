"""Registered queries of this package and their SQL."""

from lodestone.llm import filter_audit
from lodestone.llm.bpe import op1_bpe
from lodestone.llm.filter_audit import op11_filter_audit
from lodestone.llm.fingerprint import op5_fingerprint
from lodestone.llm.language import op6_language
from lodestone.llm.licenses import op9_licenses
from lodestone.llm.line_dedup import op2_line_dedup
from lodestone.llm.near_dup import op10_near_dup
from lodestone.llm.neighbours import op3_neighbours
from lodestone.llm.packing import op4_packing
from lodestone.llm.period_runs import op12_period_runs
from lodestone.llm.pii import op7_pii
from lodestone.llm.substring_dedup import op13_substring_dedup
from lodestone.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_neighbours": op3_neighbours,
    "op4_packing": op4_packing,
    "op5_fingerprint": op5_fingerprint,
    "op6_language": op6_language,
    "op7_pii": op7_pii,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_near_dup": op10_near_dup,
    "op11_filter_audit": op11_filter_audit,
    "op12_period_runs": op12_period_runs,
    "op13_substring_dedup": op13_substring_dedup,
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op11_filter_audit": filter_audit.ORACLE,
    "op10_near_dup": f"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
 items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON e.a = reach.b)
 SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s""",
}
