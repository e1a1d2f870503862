"""DuckDB SQL of the queries that audit filters, look for benchmark passages and repair
conversations, written from their contracts: plain windows and joins over all rows, string
equality of passages, and a recursive query that repairs one row a step."""

from __future__ import annotations

from panelscope.llm.common import LOWER, UPPER

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), failures AS (
  SELECT doc_id, part,
    (len(words) < 200)::INT AS a,
    (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT AS c,
    regexp_matches(t, '[#$%&*|]')::INT AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS e
  FROM texts
), known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
         sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
  FROM failures LEFT JOIN known USING (doc_id) GROUP BY ALL
), letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v JOIN letters w ON w.l <> v.l JOIN letters x ON x.l NOT IN (v.l, w.l)
  JOIN letters y ON y.l NOT IN (v.l, w.l, x.l) JOIN letters z ON z.l NOT IN (v.l, w.l, x.l, y.l)
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(list_concat([0], bits[1:step - 1]))::BIGINT AS earlier
  FROM orders, range(1, 6) AS s(step)
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH items AS (
  SELECT item_id::VARCHAR AS item, {_WORDS} AS words FROM benchmark
), cut AS (
  SELECT item, words, least(10, len(words)) AS size FROM items WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(words[pos:pos + size - 1], ' ') AS passage FROM cut, unnest(range(1, len(words) - size + 2)) AS s(pos)
), docs AS (
  SELECT row_number() OVER () AS nth, doc_id, {_WORDS} AS words FROM documents
), places AS (
  SELECT nth, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS passage
  FROM docs, (SELECT DISTINCT size FROM windows), unnest(range(1, len(words) - size + 2)) AS s(pos) WHERE len(words) >= size
), met AS (
  SELECT nth, pos, size, item FROM places JOIN windows USING (size, passage)
), hits AS (
  SELECT nth, count(DISTINCT word) AS n_hit FROM met, unnest(range(pos, pos + size)) AS s(word) GROUP BY nth
), found AS (
  SELECT nth, list_sort(list_distinct(list(item) FILTER (item IS NOT NULL))) AS ids FROM met GROUP BY nth
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hits USING (nth) LEFT JOIN found USING (nth)
"""

_KEEP = {  # state -> cost of what follows when the row's role is kept
    "0": "CASE i WHEN 's' THEN cs WHEN 'u' THEN cu END",
    "s": "CASE i WHEN 'u' THEN cu END",
    "u": "CASE i WHEN 'a' THEN ca END",
    "a": "CASE i WHEN 'u' THEN cu END",
}
_NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
_FAR = 1_000_000_000


def _options() -> str:
    out = []
    for s, keep in _KEEP.items():
        out.append(f"4 + c{s} AS d{s}")
        out.append(f"CASE WHEN fault IN (0, 3) THEN coalesce({keep}, {_FAR}) + fault ELSE {_FAR} END AS k{s}")
        out.append(f"CASE WHEN fault IN (0, 3) THEN c{_NEXT[s]} + 3 + fault ELSE {_FAR} END AS r{s}")
    return ", ".join(out)


def _costs() -> str:
    plain = {s: f"least(d{s}, k{s}, r{s})" for s in _KEEP}
    u = f"least({plain['u']}, 3 + {plain['a']})"
    a = f"least({plain['a']}, 3 + {plain['u']})"
    return f"least({plain['0']}, 3 + {u}) AS g0, least({plain['s']}, 3 + {u}) AS gs, {u} AS gu, {a} AS ga"


def _edits() -> str:
    return ", ".join(
        f"CASE g{s} WHEN d{s} THEN 'D' WHEN 3 + g{_NEXT[s]} THEN 'I' WHEN k{s} THEN 'K' ELSE 'R' END AS e{s}" for s in _KEEP
    )


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), drawn AS (
  SELECT keyed.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(key) + 1), lambda p: ord(substr(key, p, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS draw FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) WHERE draw <> 0
), placed AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS i,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark
  FROM damaged
), judged AS (
  SELECT *, CASE WHEN mark = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 2 WHEN mark NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed
), counts AS (
  SELECT conv_id, max(place) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY place) || i AS pair FROM judged) GROUP BY conv_id
), falling AS (
  SELECT conv_id, n + 1 AS place, 0::BIGINT AS g0, 6::BIGINT AS gs, 3::BIGINT AS gu, 0::BIGINT AS ga, 'Z' AS e0, 'I' AS es, 'I' AS eu, 'Z' AS ea FROM counts
  UNION ALL
  SELECT conv_id, place, g0, gs, gu, ga, {_edits()} FROM (
    SELECT *, {_costs()} FROM (
      SELECT conv_id, place, {_options()} FROM (
        SELECT j.conv_id, j.place, j.i, j.fault, f.g0 AS c0, f.gs AS cs, f.gu AS cu, f.ga AS ca
        FROM falling f JOIN judged j ON j.conv_id IS NOT DISTINCT FROM f.conv_id AND j.place = f.place - 1)))
), rising AS (
  SELECT conv_id, 1::BIGINT AS place, '0' AS state, '' AS audit, NULL::VARCHAR AS repaired FROM counts
  UNION ALL
  SELECT conv_id, CASE WHEN edit = 'I' THEN place ELSE place + 1 END, CASE WHEN edit = 'D' THEN state ELSE new_state END, audit || edit,
    CASE WHEN edit = 'D' THEN repaired ELSE coalesce(repaired || chr(10), '') ||
      CASE WHEN edit = 'K' THEN role ELSE CASE new_state WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END END
  FROM (
    SELECT *, CASE WHEN edit = 'K' THEN i WHEN state = 'u' THEN 'a' ELSE 'u' END AS new_state FROM (
      SELECT r.*, j.i, j.role, j.text, CASE r.state WHEN '0' THEN e0 WHEN 's' THEN es WHEN 'u' THEN eu ELSE ea END AS edit
      FROM rising r JOIN falling f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.place = r.place
      LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.place = r.place) WHERE edit <> 'Z')
), done AS (
  SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(coalesce(repaired, ''), length(audit)) AS repaired FROM rising GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(f.g0, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN falling f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.place = 1
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
