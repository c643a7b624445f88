"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from .mixing import MOST, SEED, SHARE, WEIGHTS
from .pii import DISCLOSED, KINDS, PLAIN, TERM, UNLIKELY
from .quality_rules import REPEAT_WINDOW, RULES, STOP_WORDS, SYMBOLS

_WORD = r"[^\x20\x09-\x0D]+"


def _op2() -> str:
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    return rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents
), placed AS (
  SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '~')) AS mark,
         length(CAST(size AS VARCHAR)) AS digits, substr(CAST(size AS VARCHAR) || '0', 1, 2) AS lead
  FROM sized
), sources AS (
  SELECT source, src, CAST(sum(size) AS BIGINT) AS source_size FROM placed GROUP BY source, src
), weighed AS (
  SELECT *, {weights}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} AS INTEGER) + 1] AS weight
  FROM sources
), levels AS (
  SELECT *, CAST(source_size AS DOUBLE) / weight AS ratio,
    (CAST(sum(source_size) OVER () * {SHARE} AS DOUBLE) / 100.0
      - {MOST} * CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT src, source_size,
    least(coalesce((SELECT arg_min(level, ratio) FROM levels WHERE level * weight < {MOST} * source_size) * weight,
                   CAST({MOST} * source_size AS DOUBLE)), CAST({MOST} * source_size AS DOUBLE)) AS target
  FROM levels
), ranked AS (
  SELECT p.*, a.source_size, a.target,
    row_number() OVER (PARTITION BY p.src ORDER BY digits, lead, substr(mark, 1, 2), mark, size) AS rank,
    CAST(('0x' || substr(md5('{SEED}|' || p.src), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM placed p JOIN aims a USING (src)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CASE WHEN size > 0 THEN CAST(size * least({MOST},
    floor(u + target / source_size * rank) - floor(u + target / source_size * (rank - 1))) AS BIGINT) ELSE 0 END AS taken
FROM ranked"""


def _op8() -> str:
    stop = ", ".join(f"'{w}'" for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize())))
    w = REPEAT_WINDOW
    broken = [
        x
        for r in RULES
        for x in (
            [f"100 * {r.count} < {r.least} * {r.per}"] if r.least is not None else []
        ) + ([f"100 * {r.count} > {r.most} * {r.per}"] if r.most is not None else [])
    ]
    return rf"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT rid, k, array_to_string(words[k:k + {w - 1}], ' ') AS win
  FROM split, unnest(range(1, len(words) - {w - 2})) AS t(k) WHERE len(words) >= {w}
), again AS (
  SELECT rid, k, lead(k) OVER (PARTITION BY rid ORDER BY k) AS nxt
  FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT rid, CAST(sum(least({w}, coalesce(nxt - k, {w}))) AS BIGINT) AS n FROM again GROUP BY rid
), counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words,
    CAST(len(list_filter(words, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM split LEFT JOIN repeats USING (rid)
), based AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT *, NOT (base_failed OR {" OR ".join(broken)}) AS kept FROM based"""


def _op9() -> str:
    def places(said: str, parts: str) -> str:
        """Where the k-th match starts: what lies before it, matches and the text between them."""
        return (
            f"CAST(list_sum(list_transform({parts}[1:k], lambda x: length(x))) "
            f"+ coalesce(list_sum(list_transform({said}[1:k - 1], lambda x: length(x))), 0) AS BIGINT)"
        )

    byte = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = "regexp_replace(s, '[^0-9]', '', 'g')"
    valid = {
        "email": "true",
        "ip": rf"regexp_full_match(s, '{byte}\.{byte}\.{byte}\.{byte}')",
        "card": f"""length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length({digits})),
            lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER)
              ELSE (CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) * 2) % 10
                 + (CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) * 2) // 10 END)) % 10 = 0""",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }
    entity = {"email": "lower(s)", "ip": "s", "card": digits, "phone": digits}
    based = " UNION ALL ".join(
        f"""SELECT rid, '{kind}' AS kind, {n} AS place, st, st + length(s) AS en, '{kind}:' || {entity[kind]} AS c FROM (
          SELECT rid, said[k] AS s, {places("said", "parts")} AS st FROM (
            SELECT rid, regexp_extract_all(t, '{PLAIN[kind]}') AS said, string_split_regex(t, '{PLAIN[kind]}') AS parts FROM docs),
          unnest(range(1, len(said) + 1)) AS u(k)) WHERE {valid[kind]}"""
        for n, kind in enumerate(KINDS)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)
    zero = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)
    def cell(seen: str, a: str, b: str) -> str:
        return f"CASE WHEN {seen} > 0 THEN ({seen}) * ln(({seen})::DOUBLE * n / (({a})::DOUBLE * ({b}))) ELSE 0 END"

    g2 = " + ".join((
        cell("n_ct", "n_c", "n_t"), cell("n_c - n_ct", "n_c", "n - n_t"),
        cell("n_t - n_ct", "n - n_c", "n_t"), cell("n - n_c - n_t + n_ct", "n - n_c", "n - n_t"),
    ))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
based AS MATERIALIZED ({based}),
worded AS (
  SELECT rid, lower(said[k]) AS term, length(said[k]) AS size, CAST(sum(length(parts[k]) + coalesce(length(said[k - 1]), 0))
    OVER (PARTITION BY rid ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS st
  FROM (SELECT rid, regexp_extract_all(t, '{TERM}') AS said, string_split_regex(t, '{TERM}') AS parts
    FROM docs WHERE rid IN (SELECT rid FROM based)), unnest(range(1, len(said) + 1)) AS u(k)
), free AS MATERIALIZED (
  SELECT rid, term, st, st + size AS en FROM worded w
  WHERE NOT EXISTS (SELECT 1 FROM based b WHERE b.rid = w.rid AND b.st < w.st + size AND w.st < b.en)
), held AS (SELECT DISTINCT rid, c FROM based),
pairs AS (
  SELECT c, term, count(*) AS n_ct FROM held JOIN (SELECT DISTINCT rid, term FROM free) USING (rid) GROUP BY c, term
), n_c AS (SELECT c, count(*) AS n_c FROM held GROUP BY c),
n_t AS (
  SELECT term, count(DISTINCT rid) AS n_t FROM (SELECT rid, lower(unnest(regexp_extract_all(t, '{TERM}'))) AS term FROM docs) GROUP BY term
), flagged AS (
  SELECT c, term FROM pairs JOIN n_c USING (c) JOIN n_t USING (term), (SELECT count(*) AS n FROM docs)
  WHERE log2(n) - log2(n_c) > 0 AND log2(n_ct) + log2(n) - log2(n_c) - log2(n_t) >= {DISCLOSED} * (log2(n) - log2(n_c))
    AND 2 * ({g2}) >= {UNLIKELY}
), spans AS (
  SELECT rid, kind, place, st, en FROM based
  UNION ALL SELECT DISTINCT rid, 'term', {len(KINDS)}, st, en FROM held JOIN free USING (rid) JOIN flagged USING (c, term)
), written AS (
  SELECT rid, {counts}, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY place, st, en) AS spans,
    string_agg(kind || ':' || st || ':' || en, ',' ORDER BY place, st, en) FILTER (WHERE kind <> 'term') AS base
  FROM spans GROUP BY rid
)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN written USING (rid)"""


_OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

_OP3 = """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS payload, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), ranked AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS best,
    row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place FROM sized
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN best END AS refers_to
FROM ranked"""

_OP6 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE '=' || role END AS name,
    CASE WHEN regexp_matches(text, '(?s)\\.')
           THEN replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')
         WHEN contains(text, '###') OR contains(text, '</turn>') THEN replace(replace(text, '##', '#\#'), '</turn>', '<\/turn>')
         ELSE text END AS body
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
    CAST(sum(length('### ' || name || ': ' || body || '</turn>') + 1) AS BIGINT) AS formatted_chars
  FROM shown GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, formatted_chars
FROM joined"""

ORACLES = {"op2_mix_sources": _op2(), "op3_warc": _OP3, "op6_chat_format": _OP6, "op8_quality_rules": _op8(), "op9_pii": _op9(), "op10_exact_dedup": _OP10}
