"""SQL twins of the queries that SQL can express; the others are held against brute force in tests/llm."""

from __future__ import annotations

from tidewheel.llm.chat import CLOSE, CONTEXT, OPEN, PART
from tidewheel.llm.rules import BIN_BITS, LEAST_ROWS, LEAST_SPREAD, RATES, REACH, SCALE

WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def gram(w: str, size: int) -> str:
    return f"[array_to_string({w}[i:i + {size - 1}], ' ') for i in range(1, len({w}) - {size - 2})]"


CHAT = f"""WITH m AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos FROM conversations),
  who AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role NOT IN ({', '.join(map(repr, CONTEXT))})),
  x AS (SELECT m.conv_id, perspective, pos // {PART} AS part, pos, role = perspective AS mine,
    concat('{OPEN}', CASE WHEN role = perspective THEN 'assistant' WHEN role IN ({', '.join(map(repr, CONTEXT))}) THEN role ELSE concat('user name=', translate(replace(role, '<|', '< |'), concat(chr(13), chr(10)), '  ')) END, chr(10)) AS head,
    concat(replace(text, '<|', '< |'), '{CLOSE}') AS body FROM m JOIN who ON m.conv_id IS NOT DISTINCT FROM who.conv_id),
  y AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos) - 1 AS fin FROM x)
SELECT conv_id, perspective, part, count(*) AS n_messages, CAST(count(*) FILTER (mine) AS BIGINT) AS n_target,
  string_agg(concat(head, body, chr(10)), '' ORDER BY pos) AS rendered,
  coalesce(string_agg(concat(fin - length(body), '-', fin), ',' ORDER BY pos) FILTER (mine), '') AS mask,
  CAST(coalesce(sum(length(body)) FILTER (mine), 0) AS BIGINT) AS target_chars FROM y GROUP BY conv_id, perspective, part"""

_VALUES = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{n}' AS rate, CASE WHEN {d} > 0 THEN {a} * {SCALE} // {d} END AS value FROM c" for n, a, d, _ in RATES)
_SPREAD = "CASE v.rate " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST_SPREAD.items()) + " END"
_LOW = ", ".join(f"'{n}'" for n, _, _, both in RATES if both)


def _quartiles(name: str, by: str) -> str:
    part = f"PARTITION BY {by}rate"
    low = f"((b - greatest(b // {1 << BIN_BITS} - 1, 0) * {1 << BIN_BITS}) << greatest(b // {1 << BIN_BITS} - 1, 0))"
    return f"""{name} AS (SELECT {by}rate, min(CASE WHEN upto * 4 >= total THEN {low} END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN {low} END) AS q3, max(total) AS total
    FROM (SELECT *, sum(n) OVER ({part}) AS total, sum(n) OVER ({part} ORDER BY b) AS upto FROM (SELECT {by}rate, b, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL)"""


RULES = rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
  wins AS (SELECT doc_id, unnest({gram('w', 5)}) AS g, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5),
  again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM wins) WHERE k > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 5) r(j) GROUP BY doc_id),
  c AS (SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
  v AS ({_VALUES}),
  sketch AS (SELECT lang, source, rate, o * {1 << BIN_BITS} + (value >> o) AS b, count(*) AS n FROM (SELECT *, greatest(length(bin(value)) - {BIN_BITS + 1}, 0) AS o FROM v WHERE value IS NOT NULL) GROUP BY ALL),
  {_quartiles('g', 'lang, source, ')}, {_quartiles('l', 'lang, ')}, {_quartiles('a', '')},
  q AS (SELECT g.lang, g.source, g.rate, CASE WHEN g.total >= {LEAST_ROWS} THEN g.q1 WHEN l.total >= {LEAST_ROWS} THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN g.total >= {LEAST_ROWS} THEN g.q3 WHEN l.total >= {LEAST_ROWS} THEN l.q3 ELSE a.q3 END AS q3
    FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.rate = g.rate JOIN a ON a.rate = g.rate),
  bad AS (SELECT DISTINCT v.doc_id FROM v JOIN q ON q.lang IS NOT DISTINCT FROM v.lang AND q.source IS NOT DISTINCT FROM v.source AND q.rate = v.rate
    WHERE value > q3 + greatest(q3 - q1, {_SPREAD}) * {REACH} OR (v.rate IN ({_LOW}) AND value < q1 - greatest(q3 - q1, {_SPREAD}) * {REACH})),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept,
  {', '.join(f'CASE WHEN {d} > 0 THEN {a} * {SCALE} // {d} END AS {n}' for n, a, d, _ in RATES)} FROM f"""

NEAR = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '{WORD}') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN {gram('w', 3)} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM t),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
  both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
  reach AS (SELECT x AS doc_id, x AS other FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, t.doc_id) AS component_id, coalesce(c.c, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) c USING (doc_id)"""

LEAKS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark),
  dg AS (SELECT DISTINCT doc_id, unnest({gram('w', 5)}) AS g FROM d WHERE len(w) >= 5), bg AS (SELECT DISTINCT item_id, unnest({gram('w', 5)}) AS g FROM b WHERE len(w) >= 5),
  z AS (SELECT item_id, count(*) AS n_shingles FROM bg GROUP BY item_id), j AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN bg USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment FROM j JOIN z USING (item_id) WHERE n_shared * 100 >= n_shingles * 80"""

_NIBBLE = " + ".join(f"(strpos('0123456789abcdef', substr(h, CAST(5 * (i // 4) + {k + 1} AS BIGINT), 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
WARC = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
  o AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((({_NIBBLE}) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1) for i in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM o"""

WINDOWS = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
  s AS (SELECT doc_id, unnest({gram('w', 20)}) AS g, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20),
  late AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
  gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, range(0, 20) r(j)),
  words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM t),
  k AS (SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(x, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS kept FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

SQL: dict[str, str] = {
    "op1_chat_perspectives": CHAT,
    "op3_quality_rules": RULES,
    "op5_minhash_neardup": NEAR,
    "op6_benchmark_leaks": LEAKS,
    "op7_warc_round_trip": WARC,
    "op10_fingerprint_dedup": WINDOWS,
}
