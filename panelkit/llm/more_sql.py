"""SQL (DuckDB) of the queries over vectors, phrases and conversations."""

from __future__ import annotations


def crc_table() -> list[int]:
    """What each byte adds to a CRC-32."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def crc32(text: str, table: str = "t") -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; `table` is a list column with crc_table()."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {octets}), lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.r AS q, c.vec_id, c.r AS c, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
)
SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k) GROUP BY ALL
), sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY 1),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE a >= 100),
inside AS (
  SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM frequent, (SELECT unnest(range(2, 5)) AS j) WHERE j < k) GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, j, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM frequent) c JOIN sizes USING (lang)
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ') JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
  LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase WHERE coalesce(100 * most < 100 * c.a, true)
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest QUALIFY rank <= 2000
"""


def _after(state: int, cost: str, edit: str) -> str:
    """The value (nine digits of cost, then the audit) of an edit that goes on from a state of the row after."""
    return f"lpad((left(v[{state}], 9)::INTEGER + {cost})::VARCHAR, 9, '0') || '{edit}' || substr(v[{state}], 10)"


def _base(state: int, leads: dict[str, int]) -> str:
    """The best value in a state with no insertion before the row."""
    kept = "".join(f" WHEN role = '{r}' THEN {_after(s, 'late', 'K')}" for r, s in leads.items())
    new = next(r for r in leads if r != "s")
    return f"least({_after(state, '3', 'D')}, CASE{kept} END, CASE WHEN role NOT IN ('x', '{new}') THEN {_after(leads[new], '2 + late', 'R')} END)"


_BASES = ", ".join(f"{_base(s, leads)} AS b{s}" for s, leads in ((1, {"s": 2, "u": 3}), (2, {"u": 3}), (3, {"a": 4}), (4, {"u": 3})))
_INSERT = "lpad((left({0}, 9)::INTEGER + 2)::VARCHAR, 9, '0') || 'I' || substr({0}, 10)"
_C = "IS NOT DISTINCT FROM"
OP13_SQL = rf"""
WITH RECURSIVE t AS (SELECT {crc_table()}::UBIGINT[] AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (SELECT *, {crc32("k")} % 20 AS d FROM keyed, t),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged
), faults AS (
  SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS step
  FROM placed
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE step NOT IN ('su', 'ua', 'au')) AS illegal,
         string_agg(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = '' THEN s ELSE upper(s) END, '' ORDER BY pos) AS signs
  FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS s FROM faults) GROUP BY 1
), solved AS (
  SELECT DISTINCT signs, 0 AS depth, ['000000000', '000000004II', '000000002I', '000000000'] AS v FROM found
  UNION ALL
  SELECT signs, depth + 1, [least(b1, {_INSERT.format("least(b3, " + _INSERT.format("b4") + ")")}), least(b2, {_INSERT.format("least(b3, " + _INSERT.format("b4") + ")")}), least(b3, {_INSERT.format("b4")}), least(b4, {_INSERT.format("b3")})]
  FROM (SELECT *, {_BASES} FROM (SELECT *, lower(signs[len(signs) - depth]) AS role, (signs[len(signs) - depth] BETWEEN 'A' AND 'Z')::INTEGER AS late FROM solved WHERE depth < len(signs)))
), planned AS (
  SELECT found.*, left(v[1], 9)::BIGINT AS cost, substr(v[1], 10) AS audit FROM found JOIN solved ON found.signs = solved.signs AND depth = len(found.signs)
), edits AS (
  SELECT conv_id, i, audit[i] AS e, len(replace(audit[:i], 'I', '')) AS pos, len(replace(audit[:i], 'D', '')) - 1 - len(replace(audit, 'D', '')) % 2 AS place
  FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM planned)
), texts AS (
  SELECT e.conv_id, string_agg(CASE WHEN e = 'K' THEN p.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE p.text END, chr(10) ORDER BY i) AS repaired
  FROM edits e LEFT JOIN placed p ON p.conv_id {_C} e.conv_id AND p.pos = e.pos WHERE e <> 'D' GROUP BY 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN planned p ON p.conv_id {_C} c.conv_id LEFT JOIN texts x ON x.conv_id {_C} c.conv_id
"""
