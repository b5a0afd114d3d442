"""SQL for the queries over stored tables."""

from __future__ import annotations

from oracle.logs import ALL
from oracle.models import quoted, with_blocks

# Inflection rules of the Porter2 stemmer and its rule for a final e.
STEM_RULES = [
    (r"sses$", "ss"),
    (r"^(..+)ie[ds]$", r"\1i"),
    (r"^(.)ie[ds]$", r"\1ie"),
    (r"^(.*[aeiouy].*[^us])s$", r"\1"),
    (r"^(.*[aeiouy][^aeiouy].*)eed$", r"\1ee"),
    (r"^(.*[aeiouy].*[^e]|.*[aiouy])ed$", r"\1~"),
    (r"^(.*[aeiouy].*)ing$", r"\1~"),
    (r"(at|bl|iz)~$", r"\1e"),
    (r"(b)b~$|(d)d~$|(f)f~$|(g)g~$|(m)m~$|(n)n~$|(p)p~$|(r)r~$|(t)t~$", r"\1\2\3\4\5\6\7\8\9"),
    (r"^([^aeiouy]*[aeiouy][^aeiouywx])~$", r"\1e"),
    (r"~$", ""),
    (r"^(.+[^aeiouy])y$", r"\1i"),
    (
        r"^([^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy].*|[^aeiouy]*[aeiouy]+[^aeiouy][^aeiouy]+"
        r"|[^aeiouy]*[aeiouy]+[wx]|[^aeiouy]*[aeiouy]{2,}[^aeiouy]|[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+)e$",
        r"\1",
    ),
]


def stem(word: str) -> str:
    out = word
    for pattern, to in STEM_RULES:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)})"
    return f"CASE WHEN regexp_full_match({word}, '[a-z]{{3,}}') THEN {out} ELSE {word} END"


SEARCH = f"""
WITH texts AS (
    SELECT 'c' || conv_id || 't' || turn AS _id, 'conv' || conv_id AS "sessionId",
           regexp_extract_all(lower(CASE (conv_id + turn) % 8
               WHEN 2 THEN 'lead' || chr(10) || text || chr(10) || text
               WHEN 3 THEN text || chr(10) || text
               WHEN 4 THEN 'head' || chr(10) || text || chr(10) || text
               WHEN 5 THEN '' WHEN 6 THEN '' WHEN 7 THEN CAST(turn AS VARCHAR) ELSE text END), '[\\p{{L}}\\p{{N}}_]+') AS w
    FROM conversations WHERE conv_id % 5 = 3
), vocabulary AS (
    SELECT w, {stem('w')} AS s FROM (SELECT DISTINCT unnest(w) AS w FROM texts)
), found AS (
    SELECT _id, list(s) AS s FROM (SELECT DISTINCT _id, unnest(w) AS w FROM texts) JOIN vocabulary USING (w) GROUP BY _id
), message AS (
    SELECT _id, "sessionId", s, ' ' || array_to_string(w, ' ') || ' ' AS spaced FROM texts JOIN found USING (_id)
)
SELECT _id, "sessionId", 'lead heads -und' AS search FROM message WHERE list_has_any(s, ['lead', 'head']) AND NOT list_has_any(s, ['und'])
UNION ALL SELECT _id, "sessionId", '"que la"' FROM message WHERE contains(spaced, ' que la ')
UNION ALL SELECT _id, "sessionId", '"des la" the -et' FROM message WHERE contains(spaced, ' des la ') AND NOT list_has_any(s, ['et'])
UNION ALL SELECT _id, "sessionId", 'tables thes des -le -lead' FROM message
    WHERE list_has_any(s, ['tabl', 'thes', 'des']) AND NOT list_has_any(s, ['le', 'lead'])
"""

LANDING = """
WITH RECURSIVE table_step AS (
  SELECT range AS b, 0 AS step, range AS c FROM range(256)
  UNION ALL
  SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_step WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS crc FROM table_step WHERE step = 8
), doc AS (
  SELECT 'c' || conv_id || 't' || turn AS _id, *, (conv_id + turn) % 8 AS shape, CAST(to_json(text) AS VARCHAR) AS t, CAST(to_json(role) AS VARCHAR) AS r
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(_id, '')]),
      lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM doc, crc_table
)
SELECT _id, role AS type, 'conv' || conv_id AS "sessionId", 'p' || conv_id % 5 AS "projectId",
    CASE WHEN turn % 7 = 6 THEN 'not a time' ELSE '2024-03-01T10:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00Z' END AS timestamp,
    'a' AS stream, CAST(h % 2 AS BIGINT) AS batch,
    sha256('{"type":' || r || ',"message":' || CASE shape
        WHEN 0 THEN t
        WHEN 1 THEN '{"role":' || r || ',"content":' || t || '}'
        WHEN 2 THEN '{"role":' || r || ',"content":["lead",{"type":"text","text":' || t || '},{"type":"thinking"},{"type":"text","text":' || t || '}]}'
        WHEN 3 THEN '{"role":' || r || ',"content":[{"type":"text","text":' || t || '},{"type":"tool_use","id":"t' || turn
            || '","name":"Read","input":{"path":"/a.py","line":' || turn || '}},{"type":"text","text":' || t
            || '},{"type":"tool_use","id":"t' || turn || '","name":"TodoRead","input":{}}]}'
        WHEN 4 THEN '{"role":"user","content":[{"type":"tool_result","tool_use_id":"t' || turn || '","content":["head",{"type":"text","text":' || t
            || '},{"type":"image"}]},{"type":"text","text":' || t || '}]}'
        WHEN 5 THEN '{"role":' || r || ',"content":[{"type":"thinking"}]}'
        WHEN 6 THEN 'null'
        ELSE '{"role":' || r || ',"content":' || turn || '}' END || '}') AS entry
FROM hashed
"""

#: Conversations as flattened rows in place of the events.
FLATTENED = {**ALL, "bronze": "SELECT * FROM flat_compact"}


def over_flattened(select: str) -> str:
    return with_blocks(select, FLATTENED)


COLUMNS = "_id, type, session_id, date, message_content"
MERGED = f"SELECT {COLUMNS} FROM again UNION ALL SELECT {COLUMNS} FROM bronze WHERE type IS DISTINCT FROM 'tool_use'"

STORED_ORACLE: dict[str, str] = {
    "search_index": SEARCH,
    "table_versions": over_flattened(
        f"""SELECT 1::BIGINT AS version, {COLUMNS} FROM bronze
            UNION ALL SELECT 2, * FROM ({MERGED})
            UNION ALL SELECT 3, * FROM ({MERGED}) WHERE type IS DISTINCT FROM 'tool_result'
            UNION ALL SELECT 4, * FROM ({MERGED}) WHERE type IS DISTINCT FROM 'tool_result'"""
    ),
    "landing_inserts": LANDING,
    "delta_tool_efficiency": over_flattened("SELECT * FROM efficiency"),
}
