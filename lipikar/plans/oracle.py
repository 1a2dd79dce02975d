"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.script import CONSONANTS, DEFAULT_CORRECTIONS, PREBASE, VIRAMA, VOWEL_SIGNS
from ..operators.candidates import TAIL


def _glyphs(source: str, *by: str, text: str = "text", where: str = "true") -> str:
    cols = "".join(f"{b}, " for b in by)
    return f"(SELECT {cols}pos, unicode(ch) AS cid, ch FROM (SELECT {cols}unnest(range(len({text}))) AS pos, unnest(string_split({text}, '')) AS ch FROM {source} WHERE {where} AND {text} <> ''))"


def _alphabet(letters: str, name: str) -> str:
    return f"(SELECT DISTINCT unnest(string_split('{letters}', '')) AS {name})"


def _cleanup(text: str) -> str:
    c = f"[{CONSONANTS}]"
    text = f"regexp_replace({text}, 'র্(?:র্)+', 'র্', 'g')"
    text = rf"regexp_replace({text}, '(^|[^ঀ-৿])([{PREBASE}])({c})', '\1\3\2', 'g')"
    text = rf"regexp_replace({text}, '({c})({c})র্([{VOWEL_SIGNS}])', '\1র্\2\3', 'g')"
    for wrong, right in DEFAULT_CORRECTIONS.items():
        text = f"replace({text}, '{wrong}', '{right}')"
    return text


def _bengali(text: str) -> str:
    from .catalogue import BENGALI, LATIN

    return f"translate(lower({text}), '{LATIN}', '{BENGALI}')"


def _run(rest: str, *tokens: str) -> str:
    """A word's letters as tokens, by their code points' remainder."""
    cases = " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(tokens))
    return f"array_to_string(list_transform(string_split(w, ''), lambda c: CASE unicode(c) {rest} {cases} END), '')"


_WORDS = "(SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> ''"
_RANGES = "(SELECT p_partkey, p_partkey % 60000 + s AS code, CAST(2437 + s AS INTEGER) AS unit FROM (SELECT p_partkey, unnest(range(0, p_size + 1)) AS s FROM part))"
_DOCS = _glyphs("documents", "doc_id", "lang", "source")
_BENCH = _glyphs("benchmark", "item_id")

SQL = {
    "glyph_frequency": f"SELECT doc_id, cid, count(*) AS uses FROM {_DOCS} GROUP BY ALL",
    "unresolved_glyphs": f"WITH g AS {_DOCS} SELECT DISTINCT cid FROM g WHERE lang <> 'en' AND cid NOT IN (SELECT cid FROM g WHERE lang = 'en')",
    "decode_with_markers": f"WITH m AS (SELECT DISTINCT cid, ch FROM {_BENCH}) SELECT doc_id, string_agg(coalesce(m.ch, '⟦CID:' || g.cid || '⟧'), '' ORDER BY pos) AS text FROM {_DOCS} g LEFT JOIN m ON g.cid = m.cid GROUP BY doc_id",
    "mapping_precedence": f"""
        WITH s AS (
          SELECT DISTINCT cid, 'learned:' || ch AS text, 3 AS p, 'learned' AS source FROM {_BENCH}
          UNION ALL SELECT DISTINCT cid, 'legacy:' || ch, 2, 'legacy' FROM {_glyphs("conversations", "conv_id")}
          UNION ALL SELECT DISTINCT cid, 'ttf:' || ch, 1, 'ttf' FROM {_glyphs("pages", "page_id", text="html")}
        ) SELECT cid, arg_max(text, p) AS text, arg_max(source, p) AS source FROM s GROUP BY cid""",
    "report_map": """
        WITH r AS (
          SELECT l_partkey AS cid, l_suppkey % 7 AS font_ord, l_linenumber % 3 AS step, CAST(max(l_orderkey) AS VARCHAR) AS text FROM lineitem GROUP BY ALL
        ), w AS (SELECT cid, arg_max(text, font_ord * 10 + step) AS written FROM r WHERE step < 2 GROUP BY cid),
        f AS (SELECT cid, arg_min(text, font_ord) AS filled FROM r WHERE step = 2 GROUP BY cid)
        SELECT coalesce(w.cid, f.cid) AS cid, coalesce(written, filled) AS text, CASE WHEN written IS NOT NULL THEN 'written' ELSE 'filled' END AS source FROM w FULL JOIN f ON w.cid = f.cid""",
    "flat_mapping": "SELECT user_id, arg_max(event_type, event_id) AS text FROM events GROUP BY user_id",
    "unambiguous_dimension": "SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1",
    "learned_upsert": "SELECT CAST(user_id AS VARCHAR) AS fkey, event_type AS gid, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2",
    "fingerprint_fill": """
        WITH p AS (SELECT p_partkey, p_brand || '/' || p_size AS fp, p_type FROM part),
        k AS (SELECT * FROM p WHERE p_type LIKE 'S%' OR p_type LIKE 'E%'),
        i AS (SELECT fp, arg_max(p_type, p_partkey) AS text FROM k GROUP BY fp HAVING count(DISTINCT p_type) = 1)
        SELECT p_partkey, text FROM p JOIN i ON p.fp = i.fp WHERE p_partkey NOT IN (SELECT p_partkey FROM k)""",
    "provenance_split": f"""
        WITH g AS (SELECT DISTINCT lang, cid FROM {_DOCS}), n AS (SELECT cid FROM g WHERE lang = 'en'), e AS (SELECT DISTINCT cid FROM {_glyphs("pages", "page_id", text="html")})
        SELECT lang,
          coalesce(string_agg(CAST(cid AS VARCHAR), ',' ORDER BY cid) FILTER (WHERE cid NOT IN (FROM n)), '') AS unresolved,
          coalesce(string_agg(CAST(cid AS VARCHAR), ',' ORDER BY cid) FILTER (WHERE cid NOT IN (FROM n) AND cid IN (FROM e)), '') AS fallback,
          coalesce(string_agg(CAST(cid AS VARCHAR), ',' ORDER BY cid) FILTER (WHERE cid NOT IN (FROM n) AND cid NOT IN (FROM e)), '') AS unknown
        FROM g GROUP BY lang""",
    "top_mappings": f"SELECT cid, count(*) AS uses FROM {_DOCS} GROUP BY cid ORDER BY cid LIMIT 10",
    "entry_statistics": "SELECT count(*) AS entries, count(*) FILTER (WHERE len(w) = 1) AS single, count(*) FILTER (WHERE len(w) > 1) AS ligatures FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''",
    "context_window": "SELECT event_id, array_to_string(list(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING), ',') AS context FROM events",
    "unresolved_context": f"""
        WITH m AS (SELECT DISTINCT cid FROM {_BENCH}), g AS (
          SELECT g.doc_id, g.pos, g.cid, g.ch, m.cid IS NOT NULL AS known FROM {_DOCS} g LEFT JOIN m ON g.cid = m.cid
        ), w AS (
          SELECT *, list(cid) OVER n AS cs, list(CASE WHEN known THEN ch ELSE '⟦' || cid || '⟧' END) OVER n AS ts FROM g
          WINDOW n AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)
        )
        SELECT doc_id, cid, CAST(row_number() OVER (PARTITION BY doc_id, cid ORDER BY pos) AS INTEGER) AS occurrence,
          array_to_string(cs, ' ') AS cids, array_to_string(ts, ' ') AS context, array_to_string(list_transform(cs, lambda c: printf('%04X', c)), '') AS raw_hex
        FROM w WHERE NOT known""",
    "first_occurrence": f"SELECT cid, min(doc_id) AS first_op FROM {_DOCS} GROUP BY cid",
    "run_segmentation": "SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM events",
    "pen_positions": "SELECT o_custkey, o_orderkey, CAST(sum(len(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - len(o_orderpriority) AS BIGINT) AS x FROM orders",
    "page_rank": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS INTEGER) AS page_no FROM pages WHERE page_id % 7 <> 0",
    "review_targets": f"SELECT DISTINCT cid FROM {_DOCS} WHERE cid >= 120 AND cid NOT IN (SELECT cid FROM {_BENCH})",
    "reference_chain": """
        WITH RECURSIVE r AS (
          SELECT event_id AS root, event_id AS node, 0 AS d FROM events
          UNION ALL SELECT r.root, e.event_id // 2, r.d + 1 FROM r JOIN events e ON r.node = e.event_id AND e.event_id > 0 WHERE r.d < 8
        ) SELECT root, node, d FROM r""",
    "font_chain": "SELECT c_custkey AS custkey, 'F' || c_custkey AS base_font, 'Identity-H' AS encoding, CAST(n_regionkey + 100 AS BIGINT) AS font_file2 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "join_chain": "SELECT l_orderkey, l_linenumber, o_custkey, c_nationkey, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "candidate_cross": f"""
        SELECT 'ক্ষ' AS text UNION SELECT 'জ্ঞ' UNION SELECT 'ক্ষ্ম্য'
        UNION SELECT a || '{VIRAMA}' || b FROM {_alphabet(CONSONANTS[:32], "a")}, {_alphabet(CONSONANTS[:32], "b")}
        UNION SELECT a || '{VIRAMA}' || b || '{VIRAMA}' || c FROM {_alphabet(CONSONANTS[:32], "a")}, {_alphabet(TAIL, "b")}, {_alphabet(TAIL, "c")}""",
    "cleanup_rules": f"SELECT doc_id, {_cleanup(_bengali('text'))} AS text FROM documents",
    "corrections_fold": "SELECT doc_id, replace(replace(replace(replace(text, 'the', 'teh'), 'teh ', 'the  '), 'and', '&'), '&s', 'ands') AS text FROM documents",
    "reorder_runs": f"SELECT w, regexp_replace({_run('% 2', 'ি', 'ক')}, '(ি+)ক', 'ক\\1', 'g') AS text FROM {_WORDS}",
    "vowel_halves": f"SELECT w, regexp_replace('ক' || {_run('% 4', 'ক', 'ে', 'া', 'ঁ')}, 'ক(ঁ*)ো', 'কো\\1', 'g') AS text FROM {_WORDS}",
    "reph_moves": f"SELECT w, replace(replace(regexp_replace({_run('% 3', 'r', 'k', 'k')}, 'k(r+)', '\\1k', 'g'), 'r', 'র্'), 'k', 'ক') AS text FROM {_WORDS}",
    "lines_split": "SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
    "lines_joined": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "page_delimited_text": """
        SELECT conv_id, text, CAST((len(text) - len(replace(text, '<<<page:', ''))) // 8 AS BIGINT) AS n_pages FROM (
          SELECT conv_id, string_agg('<<<page:' || (turn + 1) || '>>>' || chr(10) || coalesce(text, '') || chr(10) || '<<<END>>>', chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id
        )""",
    "font_key": "SELECT doc_id, lang || ':' || sha256(text) AS fkey FROM documents",
    "hex_dump": """
        WITH h AS (SELECT item_id, hex(CAST(encode(text) AS BLOB)) AS h FROM benchmark), l AS (SELECT item_id, unnest(range(0, len(h), 32)) AS s, h FROM h),
        b AS (SELECT item_id, s, substring(h, s + 1, 32) AS x FROM l)
        SELECT item_id, printf('%08X', s // 2) AS offset, rtrim(regexp_replace(x, '(..)', '\\1 ', 'g')) AS hex,
          array_to_string(list_transform(range(0, len(x), 2), lambda k: CASE WHEN CAST('0x' || substring(x, k + 1, 2) AS INTEGER) BETWEEN 32 AND 126 THEN chr(CAST('0x' || substring(x, k + 1, 2) AS INTEGER)) ELSE '.' END), '') AS ascii
        FROM b""",
    "identity_codes": f"SELECT item_id, CAST(pos AS INTEGER) AS pos, cid FROM {_BENCH}",
    "cmap_expand": f"SELECT p_partkey, code, unit FROM {_RANGES}",
    "cmap_strict": f"SELECT p_partkey, code, unit, CAST(1 AS INTEGER) AS codespaces FROM {_RANGES}",
    "strict_objects": """
        SELECT item_id, CAST(1 AS BIGINT) AS obj_num, 'dict' AS kind, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BIGINT) AS bytes FROM benchmark
        UNION ALL SELECT item_id, o, 'stream', text, octet_length(encode(text)) FROM benchmark, (SELECT unnest([4::BIGINT, 7::BIGINT]) AS o)""",
    "xref_entries": """
        WITH m AS (SELECT s_nationkey AS nation, max(s_suppkey) AS top FROM supplier GROUP BY 1), e AS (SELECT nation, unnest(range(0, top + 1)) AS obj_num FROM m)
        SELECT e.nation, e.obj_num, s.s_suppkey IS NOT NULL AND e.obj_num > 0 AS in_use FROM e LEFT JOIN supplier s ON s.s_nationkey = e.nation AND s.s_suppkey = e.obj_num""",
    "syntax_tokens": """
        SELECT n_nationkey AS nation, unnest([['name', 'Key'], ['number', CAST(n_nationkey AS VARCHAR)], ['name', 'Name'], ['literal', n_name]])[1] AS type,
          unnest([['name', 'Key'], ['number', CAST(n_nationkey AS VARCHAR)], ['name', 'Name'], ['literal', n_name]])[2] AS value FROM nation""",
    "syntax_values": "SELECT c_custkey, c_custkey AS key, c_nationkey AS nation FROM customer",
    "font_glyph_texts": f"""
        WITH u AS (SELECT DISTINCT lang, cid, ch FROM {_DOCS} WHERE cid < 65535)
        SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY cid) AS INTEGER) AS gid, ch AS text, true AS distinct_outlines FROM u""",
    "mapping_files": """
        WITH f AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN '/' ELSE '' END || CASE WHEN n_nationkey % 3 = 0 THEN 'ABCDEF+' ELSE '' END || 'Sec' || n_regionkey AS base_font, n_regionkey AS r FROM nation)
        SELECT base_font, CAST(n_nationkey AS BIGINT) AS cid, n_name AS text FROM f JOIN nation ON n_regionkey = r""",
    "learned_database": "SELECT 'font' || (s_nationkey % 4) AS fkey, CAST(s_suppkey AS BIGINT) AS gid, s_name AS text FROM supplier WHERE s_suppkey % 3 <> 0",
    "code_point_names": f"SELECT DISTINCT ch AS text, printf('U+%04X', cid) AS unicode FROM {_DOCS}",
    "html_escaped": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS html FROM pages",
    "pdf_roundtrip_text": "SELECT doc_id, text FROM documents",
}
