"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
  s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
  gone AS (SELECT DISTINCT doc_id, j FROM again, unnest(range(i, i + 20)) AS t(j)),
  words AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY 1),
  removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

_OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"coalesce({_LOWER}, '')")} AS w FROM documents),
  s AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) AS t(i) UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
  reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  least AS (SELECT a, min(b) AS m FROM reach GROUP BY 1),
  degree AS (SELECT a, count(*) AS k FROM links GROUP BY 1)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON doc_id = least.a LEFT JOIN degree ON doc_id = degree.a"""


def _verdict() -> str:
    tests = []
    for r in RULES:
        value = r.numerator if r.denominator is None else f"CAST({r.numerator} AS DOUBLE) / nullif({r.denominator}, 0)"
        tests += [f"coalesce({value} {sign} {bound}, false)" for sign, bound in (("<", r.low), (">", r.high)) if bound is not None]
    return "NOT (" + " OR ".join(tests) + ")"


_OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
  s AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM d, unnest(range(1, len(w) - 1)) AS t(i)),
  r AS (SELECT doc_id, count(DISTINCT j) AS n FROM s, unnest([i, i + 1, i + 2]) AS t(j) WHERE c > 1 GROUP BY 1),
  m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclamations,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(list_filter(w, lambda x: lower(x) IN ({', '.join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept FROM f"""

#: The others draw by this engine's hashes (5), search or infer (6, 7, 8, 10), follow a vocabulary's merges (3), or sum logarithms whose last bits depend on the order (2); tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op1_substring_dedup": _OP1, "op4_jaccard_join": _OP4, "op9_quality_rules": _OP9}
