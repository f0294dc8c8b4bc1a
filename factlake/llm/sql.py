"""DuckDB SQL for the rows of the queries that SQL can express on small tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_SPACED = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATE = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM iw),
  dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
  hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
  words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY 1),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
  g AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
  f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY 1),
  gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(s, s + 49)) AS p FROM g JOIN f USING (h) WHERE first < doc_id) GROUP BY 1),
  kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS line, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) a LEFT JOIN (SELECT doc_id, unnest(ps) AS p, 1 AS r FROM gone) b USING (doc_id, p) WHERE r IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_CRC = "(SELECT 4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"
_BEST = "list_sort(list_filter([{}], lambda x: x IS NOT NULL))[1]"


def _step(cost: str, state: str, letter: str, role: str = "NULL") -> str:
    line = f"CASE WHEN {role} IS NULL THEN {state}.o ELSE list_append({state}.o, {role}) END"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {line}}} END"


def _insert(state: str, role: str) -> str:
    return _step("5", state, "I", f"'{role}:'")


def _row(state: str, before: tuple[str, ...], initial: str, role: str) -> str:
    """Best way over a row into ``state`` (q0 to q3): delete from there, keep and rerole from the states before."""
    ways = [_step("2", state, "D")]
    for q in before:
        ways.append(f"CASE WHEN fault NOT IN (1, 2) AND role[1] = '{initial}' THEN {_step('5 * (fault = 3)::INT', q, 'K', 'line')} END")
        if role:
            ways.append(f"CASE WHEN fault NOT IN (1, 2) THEN {_step('1 + 5 * (fault = 3)::INT', q, 'R', f"'{role}:' || text")} END")
    return _BEST.format(", ".join(ways))


#: the states before a row with insertions made: q0, q1 take none; q2 from q0, q1, q3; q3 from q2
_FILLED = f"""SELECT *, {_BEST.format("p2, " + ", ".join(_insert(q, "user") for q in ("q0", "q1", "q3")))} AS q2 FROM
  (SELECT *, {_BEST.format("p3, " + _insert("p2", "assistant") + ", " + _insert(_insert("q0", "user").join("()"), "assistant") + ", " + _insert(_insert("q1", "user").join("()"), "assistant"))} AS q3 FROM (SELECT *, p0 AS q0, p1 AS q1 FROM walk))"""

CONVERSATIONS = rf"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  hashed AS (SELECT *, {_CRC} % 20 AS kind FROM named),
  kept AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hashed, generate_series(1, CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM kept),
  flagged AS (SELECT *, role || ':' || text AS line, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN regexp_matches(text, '[^.!? 	-][ 	-]*$') THEN 3 ELSE 0 END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM placed),
  measured AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY 1),
  walk AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}} AS p0, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR[]) AS p1, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR[]) AS p2, NULL::STRUCT(c INT, a VARCHAR, o VARCHAR[]) AS p3 FROM measured
    UNION ALL SELECT f.conv_id, f.i, {_row("q0", (), "", "")}, {_row("q1", ("q0",), "s", "")}, {_row("q2", ("q0", "q1", "q3"), "u", "user")}, {_row("q3", ("q2",), "a", "assistant")} FROM ({_FILLED}) w JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
  ended AS (SELECT w.conv_id, {_BEST.format("q0, q3")} AS best FROM ({_FILLED}) w JOIN measured m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.i)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN measured m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""
