"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from basketry.llm import licenses
from basketry.llm.divergence import SMOOTHING, UNIT
from basketry.llm.licence_texts import DIGESTS, NOTICES, TEXTS
from basketry.llm.quality import MARKS, STOP_WORDS, THRESHOLDS
from basketry.llm.queries import LIST_ENTRIES
from basketry.llm.secret_scan import BASE_RULES, RULES


def _url_filter() -> str:
    rows = ", ".join(f"('{k}', '{v}', TIMESTAMP '{d} 00:00:00', '{a}')" for k, v, d, a in LIST_ENTRIES)
    host = "regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\\\\.?(:[0-9]*)?$', '')"
    return f"""
WITH hosts AS (SELECT DISTINCT host FROM (SELECT {host} AS host FROM pages) WHERE host <> ''),
fixed(kind, key, listed, action) AS (VALUES {rows}),
named AS (SELECT 'host' AS kind, host AS key FROM hosts UNION SELECT 'domain', array_to_string(string_split(host, '.')[-2:], '.') FROM hosts),
numbered AS (SELECT kind, key, CAST('0x' || substr(md5(kind || ':' || key), 1, 6) AS BIGINT) AS n FROM named),
entries AS (SELECT * FROM fixed
  UNION ALL SELECT kind, key, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(n % 60 AS INTEGER)), 'add' FROM numbered WHERE n % 4 = 0
  UNION ALL SELECT kind, key, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(n % 60 + 1 + n % 25 AS INTEGER)), 'remove' FROM numbered WHERE n % 12 = 0),
e AS (SELECT kind, key, listed, bool_and(action = 'add') AS on_list FROM entries GROUP BY ALL),
f AS (SELECT *, lag(on_list) OVER (PARTITION BY kind, key ORDER BY listed) AS was FROM e),
g AS (SELECT kind, key, listed, on_list, lead(listed) OVER (PARTITION BY kind, key ORDER BY listed) AS until FROM f WHERE was IS NULL OR was <> on_list),
spans AS (SELECT kind, key, listed AS valid_from, until AS valid_to FROM g WHERE on_list),
c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id % 91 AS INTEGER)) AS fetched_at,
    regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1) AS segment
  FROM pages),
k AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS key FROM c WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'path', host || '/' || segment FROM c WHERE host <> ''
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(labels[i:], '.')
    FROM (SELECT page_id, fetched_at, string_split(host, '.') AS labels, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM c WHERE host <> '')),
hits AS (
  SELECT page_id, count(*) AS hits, min(kind || ':' || key) AS first_hit FROM k JOIN spans USING (kind, key)
  WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id)
SELECT page_id, url, fetched_at, host, CAST(coalesce(hits, 0) AS BIGINT) AS n_hits, first_hit, hits IS NOT NULL AS blocked FROM c LEFT JOIN hits USING (page_id)
"""


#: White space and words of the contracts, as RE2 writes them.
_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _secret_scan() -> str:
    """Matches lie between the parts of a split by the same pattern, so their places are sums of lengths."""
    words = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    pattern = {r.kind: r.pattern.replace("(?ai:(password|passwd|secret|token|api_?key))", f"({words})") for r in RULES}
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(f"({k}, {quoted(r.kind)})" for k, r in enumerate(RULES))
    each = " UNION ALL ".join(
        f"SELECT rid, {k} AS k, string_split_regex(t, {quoted(pattern[r.kind])}) AS parts, regexp_extract_all(t, {quoted(pattern[r.kind])}) AS hits, regexp_extract_all(t, {quoted(pattern[r.kind])}, {r.group}) AS told, {r.least} AS least FROM d"
        for k, r in enumerate(RULES)
    )
    base = len(BASE_RULES)
    text_of = "kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + n AS VARCHAR)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
rules(k, kind) AS (VALUES {rules}),
m AS ({each}),
h AS (SELECT rid, k, hits, told, least, parts, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
f AS (SELECT rid, k, coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n FROM h WHERE length(told[i]) >= least),
g AS (SELECT rid, CAST(count(*) FILTER (k = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (k = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (k = 2) AS BIGINT) AS n_hex,
  string_agg({text_of}, ',' ORDER BY s, k) FILTER (k < {base}) AS base, string_agg({text_of}, ',' ORDER BY s, k) AS spans FROM f JOIN rules USING (k) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


def _license_scan() -> str:
    known, lines = licenses.digest_table(TEXTS, licenses.HINTS) | DIGESTS, licenses.digest_table(NOTICES, licenses.HINTS[:1])
    values = lambda t: ", ".join(f"('{d}', '{n}')" for d, n in sorted(t.items()))
    line = licenses.COPYRIGHT_LINE.replace("'", "''")

    def canonical(x: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({x}), '{line}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')".replace("\\\\", "\\")
        for a, b in licenses.SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim({out}, ' ')"

    return f"""
WITH known(digest, license_id) AS (VALUES {values(known)}), notices(digest, notice) AS (VALUES {values(lines)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, notice FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) JOIN notices ON sha256({canonical("line")}) = digest),
n AS (SELECT rid, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices, count(*) AS n_notice_lines FROM l GROUP BY rid)
SELECT doc_id, regexp_replace(license_id, ' \\(.*\\)$', '') AS license_id, nullif(regexp_extract(license_id, ' \\((.*)\\)$', 1), '') AS license_form, coalesce(notices, '') AS notices, coalesce(n_notice_lines, 0) AS n_notice_lines FROM d LEFT JOIN known ON sha256({canonical("t")}) = digest LEFT JOIN n USING (rid)
"""


def _quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    value = {
        "n_words": "n_words", "mean_word_chars": "word_chars / w", "symbols_per_word": "n_symbols / w", "stop_words": "CASE WHEN stop_words >= 2 OR 2 * latin_words >= n_words THEN stop_words END",
        "dup_line_share": "CAST(n_dup_lines AS DOUBLE) / nullif(n_lines, 0)", "repeat_word_share": "n_repeat_words / w", "upper_word_share": "upper_words / w",
    }
    tests = [f"coalesce({value[t.measure]} {op} CAST({limit} AS DOUBLE), true)" for t in THRESHOLDS for op, limit in ((">=", t.least), ("<=", t.most)) if limit is not None]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS words FROM d),
u AS (SELECT rid, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
c AS (SELECT rid, count(*) AS n_words, CAST(sum(length(x)) AS BIGINT) AS word_chars, count(*) FILTER (lower(x) IN ({stop})) AS stop_words, count(*) FILTER (regexp_matches(x, '[A-Za-zÀ-ɏ]')) AS latin_words, count(*) FILTER (regexp_matches(x, '^[^\\p{{Ll}}]*\\p{{Lu}}{{2}}[^\\p{{Ll}}]*$')) AS upper_words FROM u GROUP BY rid),
v AS (SELECT rid, i, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
p AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM v WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM p CROSS JOIN range(3) AS s(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(t) - length(translate(t, '{MARKS}', '')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(stop_words, 0) AS stop_words, coalesce(latin_words, 0) AS latin_words, coalesce(upper_words, 0) AS upper_words, n_lines, CAST(nullif(n_words, 0) AS DOUBLE) AS w
  FROM d LEFT JOIN c USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, stop_words, upper_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(tests)} AS kept FROM m
"""


def _centroids(k: int = 16, rounds: int = 3) -> str:
    square = lambda a, b: f"list_sum(list_transform(range(1, 65), lambda i: CAST(({a}[i] - {b}[i]) AS HUGEINT) * ({a}[i] - {b}[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(n, (d, n)) AS n, min(d) AS d FROM (SELECT v.rid, c{r}.n, {square('v.x', f'c{r}.x')} AS d FROM v, c{r}) GROUP BY rid)")
        if r < rounds:
            steps.append(f"""u{r} AS (SELECT n, list(floor_mean ORDER BY i) AS x FROM (
  SELECT n, i, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean FROM (SELECT n, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v JOIN a{r} USING (rid)) GROUP BY n, i) GROUP BY n),
c{r + 1} AS MATERIALIZED (SELECT n, coalesce(u{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN u{r} USING (n))""")
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT rid, vec_id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS HUGEINT)) AS x FROM e
  WHERE len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS n, x FROM v WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) LIMIT {k}),
{", ".join(steps)}
SELECT vec_id, CAST(n AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.x, lambda y: CAST(y AS VARCHAR)), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (rid) JOIN c{rounds} USING (n)
"""


def _divergence() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total: f"1 + ({UNIT}::HUGEINT * ({n} + {SMOOTHING})) // ({total} + {SMOOTHING}::HUGEINT * terms)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(terms, 0) AS terms, coalesce(lang_total, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "total")} AS p, {p("lang_n", "lang_total")} AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f x ON x.lang = a.lang AND x.source = a.source LEFT JOIN f y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term WHERE x.term IS NULL OR y.term IS NOT NULL GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    assert MARKS == "#*$%&|<>"
    return {
        "op1_secret_scan": _secret_scan(), "op3_url_filter": _url_filter(), "op7_license_scan": _license_scan(), "op8_quality_rules": _quality_rules(),
        "op12_centroids": _centroids(), "op13_divergence": _divergence(),
    }
