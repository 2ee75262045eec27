"""The queries of the text operators as DuckDB SQL, each by its definition and not by the operator's method."""

from __future__ import annotations

from tessella.llm import minhash, rules, substrings, suffixes

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + {substrings.WINDOW - 1}], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - {substrings.WINDOW - 2})) AS p FROM d)),
seen AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS earliest FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {substrings.WINDOW})) AS p FROM seen WHERE earliest < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id"""

SUFFIXES = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, hash(substr(x, 2 * p + 1, {2 * suffixes.DEPTH})) AS k FROM (SELECT *, unnest(range(length(x) // 2 - {suffixes.DEPTH - 1})) AS p FROM d)),
seen AS (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM win),
marked AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {suffixes.DEPTH} AS apart FROM seen WHERE n > 1),
runs AS (SELECT doc_id, p, sum(coalesce(apart, true)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
cut AS (SELECT doc_id, run, min(p) AS a, max(p) + {suffixes.DEPTH} AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS a, a AS b FROM cut
  UNION ALL SELECT doc_id, 1000000000, max(b), 1000000000 FROM cut GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY run) AS x FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(d.x) // 2)::BIGINT AS n_bytes, coalesce(c.n, 0)::BIGINT AS n_removed, coalesce(c.spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM cut GROUP BY doc_id) c ON d.doc_id = c.doc_id"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + {minhash.SHINGLE - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - {minhash.SHINGLE - 2}))) AS p FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * c >= {minhash.PERCENT} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id)::BIGINT AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN size s ON d.doc_id = s.doc_id LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) r ON d.doc_id = r.doc_id"""


def quality_rules() -> str:
    tested = [(r, c) for r in rules.RULES for c in r.cutoffs]

    def beyond(r, c) -> str:
        return f"({r.value.replace(' / ', '::DOUBLE / ')} {'>' if r.sign > 0 else '<'} {c})"

    risk = rules.RISK / len(rules.RULES)
    tests = "\nUNION ALL ".join(
        f"SELECT lang, {i} AS test, '{r.name}' AS rule, count(*) FILTER (quality = 0 AND {beyond(r, c)}) AS bad, count(*) FILTER (quality = 1 AND {beyond(r, c)}) AS good, count(*) FILTER (quality = 1) AS total FROM judged GROUP BY lang"
        for i, (r, c) in enumerate(tested)
    )
    applied = " OR ".join(f"(c.test = {i} AND {beyond(r, c)})" for i, (r, c) in enumerate(tested))
    tail = (
        "list_sum(list_transform(range(0, good + 1), lambda k: exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1)"
        f" + k * ln({risk}) + (total - k) * ln(1 - {risk}))))"
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {WORDS} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM d)),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(ls) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS (SELECT d.doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, len(ls) AS n_lines,
  coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN repeated r ON d.doc_id = r.doc_id LEFT JOIN dup u ON d.doc_id = u.doc_id),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed FROM s),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
judged AS (SELECT b.*, quality FROM b JOIN known ON b.doc_id = known.doc_id WHERE NOT base_failed),
tests AS ({tests}),
certified AS (SELECT * FROM tests WHERE bad > good AND good <= {risk} * total
  AND ln({tail}) <= ln({rules.DELTA} / ({len(tested)} * (SELECT count(DISTINCT lang) FROM judged)))),
chosen AS (SELECT lang, rule, arg_max(test, (bad - good) * 1000 + test) AS test FROM certified GROUP BY lang, rule)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.lang = b.lang AND ({applied})) AS kept
FROM b"""
