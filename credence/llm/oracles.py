"""SQL for DuckDB of the corpus queries that SQL can express."""

from __future__ import annotations

from . import line_dedup, mixing, near_dedup, quality_rules, secret_scan, url_filter

_SPACE = r"[ \t\n\x0b\f\r]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(text: str, characters: str) -> str:
    """How many of some characters are in text."""
    escaped = "".join("\\" + c if c.isascii() else c for c in characters)
    return f"length(regexp_replace({text}, '[^{escaped}]', '', 'g'))"


def quality() -> str:
    r = quality_rules
    phrases = " OR ".join(f"contains(lower(x), {_quote(p)})" for p in r.PHRASES)
    n = lambda x: f"len(list_filter(regexp_split_to_array({x}, '{_SPACE}+'), lambda w: w <> ''))"
    k, after = n("x"), n(f"regexp_replace(x, {_quote(r.SENTENCES)}, '')")
    punctuation = f"(k >= {r.MIN_PLAIN_WORDS} AND {after} >= {r.MIN_PLAIN_WORDS}) OR {_count('x', r.NOISE)} * 2 > k"
    navigation = f"{_count('x', r.SEPARATORS)} >= 2 AND {_count('x', r.SEPARATORS)} * 3 >= k"
    shout = f"k >= {r.MIN_SHOUT_WORDS} AND length(regexp_replace(x, '[^\\p{{Lu}}]', '', 'g')) * 2 > length(regexp_replace(x, '[^\\p{{L}}]', '', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
j AS (SELECT doc_id, x, i, {k} AS k FROM l),
f AS (SELECT doc_id, x, k, k > 0 AND (({punctuation}) OR ({navigation}) OR ({phrases}) OR ({shout})) AS bad FROM j),
s AS (SELECT doc_id, sum(CASE WHEN bad THEN length(regexp_replace(x, '{_SPACE}', '', 'g')) ELSE 0 END) AS lost, sum(CASE WHEN k > 0 THEN 1 ELSE 0 END) - count(DISTINCT CASE WHEN k > 0 THEN x END) AS dup FROM f GROUP BY doc_id),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
n AS (SELECT doc_id, count(DISTINCT q) AS r FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE c > 1) GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars, CAST({_count("t", r.SYMBOLS)} AS BIGINT) AS n_symbols, CAST(s.dup AS BIGINT) AS n_dup_lines, CAST(coalesce(n.r, 0) AS BIGINT) AS n_repeat_words, CAST(s.lost AS BIGINT) AS lost_chars FROM d JOIN s ON d.doc_id = s.doc_id LEFT JOIN n ON d.doc_id = n.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND lost_chars * 100 <= word_chars * {r.MAX_LOST_PERCENT} AS kept, lost_chars
FROM (SELECT *, n_words < {r.MIN_WORDS} OR 100 * n_repeat_words > {r.MAX_REPEAT_PERCENT} * n_words AS failed FROM b)"""


def lines() -> str:
    r = line_dedup
    return f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
h AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
c AS (SELECT source, x, count(DISTINCT doc_id) AS pages FROM l WHERE regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]') GROUP BY source, x),
b AS (SELECT c.source, c.x FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE total >= {r.MIN_PAGES} AND pages >= {r.MIN_COUNT} AND pages > {r.MAX_RATIO} * total),
k AS (SELECT l.doc_id, l.x, l.i, b.x IS NOT NULL AS bad FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.x = b.x),
o AS (SELECT doc_id, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT bad), '') AS t, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS n FROM k GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_dropped, CAST(length(t) AS BIGINT) AS n_chars_left, md5(t) AS text_md5 FROM o"""


def urls() -> str:
    given = url_filter.rules()
    host = [r for r in given if r.by_host]
    fits = lambda r, x: f"regexp_matches({x}, {_quote(r.regex)}, 's')"
    by_host = " ".join(f"WHEN host <> '' AND {fits(r, 'host || path')} THEN {_quote(r.name)}" for r in sorted(host, key=lambda r: -len(r.name)))
    verdict = " ".join(f"WHEN rule = {_quote(r.name)} THEN '{r.verdict}'" for r in host)
    by_pattern = " ".join(f"WHEN {fits(r, 'low')} THEN {_quote(r.name)}" for r in sorted((r for r in given if not r.by_host), key=lambda r: r.verdict != "allow"))
    lower = f"translate(%s, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
p AS (SELECT page_id, {lower % "u"} AS low, {lower % "regexp_extract(u, '://([^/?#]*)', 1)"} AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {by_host} END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {by_pattern} END END AS pattern FROM r)
SELECT page_id, host, path, rule, CASE {verdict} WHEN pattern IS NULL OR pattern[:2] = '@@' THEN 'allow' ELSE 'block' END AS verdict FROM v"""


def _position(u: str) -> str:
    """The schedules' inverse integrals at u, by the source's turn."""
    by_turn = []
    for k, s in enumerate(mixing.SCHEDULES):
        area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(s, s[1:])]
        done, parts = 0.0, []
        for (t, r), (t2, r2), part in zip(s, s[1:], area):
            slope, rest = (r2 - r) / (t2 - t), f"({u} * {sum(area)!r}e0 - {done!r}e0)"
            x = f"{rest} / {r!r}e0" if slope == 0 else f"(sqrt(greatest(0e0, {r * r!r}e0 + {2 * slope!r}e0 * {rest})) - {r!r}e0) / {slope!r}e0"
            done += part
            parts.append(f"WHEN {u} * {sum(area)!r}e0 <= {done!r}e0 THEN {t!r}e0 + {x}")
        by_turn.append(f"WHEN {k} THEN least(CASE {' '.join(parts)} ELSE 1e0 END, 1e0)")
    return f"CASE turn {' '.join(by_turn)} END"


def mixed() -> str:
    m = mixing
    weight = " ".join(f"WHEN {i} THEN {w!r}e0" for i, w in enumerate(m.WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, count(*) AS rows FROM d GROUP BY source),
q AS (SELECT source, source_size, rows, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.WEIGHTS)} AS turn FROM s),
w AS (SELECT *, CASE turn {weight} END AS w FROM q),
-- The level at which a source is full; below it, it takes its weight times the level.
t AS (SELECT a.source_size * {m.MAX_EPOCHS} / a.w AS brim, sum(least(b.w * (a.source_size * {m.MAX_EPOCHS} / a.w), b.source_size * {m.MAX_EPOCHS})) AS filled FROM w a, w b GROUP BY a.source, a.source_size, a.w),
z AS (SELECT CAST({m.SHARE} * (SELECT sum(source_size) FROM w) AS DOUBLE) AS total, coalesce((SELECT max(brim) FROM t WHERE filled <= {m.SHARE} * (SELECT sum(source_size) FROM w)), 0) AS full_at),
v AS (SELECT (total - coalesce((SELECT sum(source_size) * {m.MAX_EPOCHS} FROM w WHERE source_size * {m.MAX_EPOCHS} / w <= full_at), 0)) / (SELECT sum(w) FROM w WHERE source_size * {m.MAX_EPOCHS} / w > full_at) AS level FROM z),
a AS (SELECT source, source_size, turn, CAST(ceil(rows / {m.ROWS_PER_BUCKET}.0) AS BIGINT) AS buckets, CAST(least(w * level, source_size * {m.MAX_EPOCHS}) AS DOUBLE) AS target FROM w, v),
o AS (SELECT d.doc_id, size, turn, CAST(a.source_size AS BIGINT) AS source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY CAST('0x' || substr(h, 1, 12) AS BIGINT) % buckets, h, size ROWS UNBOUNDED PRECEDING) - size AS before FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source),
e AS (SELECT *, unnest(range({m.MAX_EPOCHS})) AS epoch FROM o),
p AS (SELECT *, before + epoch * source_size AS begins, CAST(greatest(0, least(size, floor(target + 0.5) - before - epoch * source_size)) AS BIGINT) AS part FROM e),
c AS (SELECT *, CASE WHEN part > 0 THEN {_position("((begins + part / 2e0) / target)")} END AS position FROM p)
SELECT doc_id, size, source_size, target, CAST(sum(part) AS BIGINT) AS taken, CAST(sum(CASE WHEN part > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_copies, round(min(position), 6) AS position, round(max(position), 6) AS last_position FROM c GROUP BY doc_id, size, source_size, target, before"""


def near() -> str:
    """Every pair that shares a shingle is compared, and components are what can be reached."""
    r, k = near_dedup, near_dedup.WIDTH
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    following = ", ".join(f"lead(x, {j}) OVER o" for j in range(1, k))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({lower}, '{_SPACE}+'), lambda w: w <> '') AS w FROM documents),
v AS (SELECT doc_id, len(w) AS k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT doc_id, k, i, concat_ws(' ', x, {following}) AS g FROM v WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, g FROM s WHERE i <= greatest(k - {k - 1}, 1)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= {r.THRESHOLD} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id) c ON d.doc_id = c.doc_id"""


def _tail(z: str) -> str:
    """P(Z > z), by the approximation that the battery uses."""
    t = f"(1 / (1 + 0.2316419e0 * abs({z})))"
    poly = f"{t} * (0.319381530e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))"
    tail = f"exp(-({z}) * ({z}) / 2) * 0.3989422804014327e0 * {poly}"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END"


def secrets() -> str:
    """All spans: patterns, then the battery on one row for each character of each token."""
    r = secret_scan
    patterns = [(r.ASSIGN, 2, r.MIN_ASSIGN), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16), (r.TOKEN, 0, 0)]
    of_kind = "UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, {least} AS least, regexp_extract_all(t, {_quote(x)}, 0) AS m, regexp_extract_all(t, {_quote(x)}, {group}) AS v, string_split_regex(t, {_quote(x)}) AS gaps FROM d WHERE regexp_matches(t, {_quote(x)}) " for k, (x, group, least) in enumerate(patterns)
    )
    by = lambda values: " ".join(["CASE e", *(f"WHEN {e} THEN {v}" for e, v in enumerate(values)), "END"])
    two = lambda got, q: f"pow({got} - n * {q}, 2) / (n * {q} * (1 - {q}))"
    lengths = " + ".join(f"CAST(n >= {v} AS INTEGER)" for v in r.LENGTHS)
    kinds = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(r.KINDS))
    spelled = f"CASE k {kinds} END || ':' || a || ':' || b"
    bins = f"{r.BINS}e0"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({of_kind}),
u AS (SELECT doc_id, k, least, i, m[i] AS token, v[i] AS v, length(gaps[i]) + length(m[i]) AS width FROM (SELECT *, generate_subscripts(m, 1) AS i FROM m)),
f AS (SELECT doc_id, k, token, length(v) >= least AS long_enough, sum(width) OVER (PARTITION BY doc_id, k ORDER BY i) AS b FROM u),
s AS (SELECT doc_id, k, token, CAST(b - length(token) AS BIGINT) AS a, CAST(b AS BIGINT) AS b, row_number() OVER () AS id FROM f WHERE long_enough),
x AS (SELECT id, regexp_replace(token, '=+$', '') AS bare FROM s WHERE k = 3),
y AS (SELECT id, bare, CASE WHEN regexp_matches(bare, '^(?:[0-9a-f]+|[0-9A-F]+)$') THEN 0 WHEN regexp_matches(bare, '^[A-Z2-7]+$') THEN 1 WHEN regexp_matches(bare, '^(?:[a-z0-9]+|[A-Z0-9]+)$') THEN 2 ELSE 3 END AS e FROM x),
z AS (SELECT id, e, CASE e WHEN 1 THEN bare WHEN 3 THEN translate(bare, '-_', '+/') ELSE lower(bare) END AS w, {by(_quote(v) for v in r.ALPHABETS)} AS alphabet, {by(f"{len(v)}e0" for v in r.ALPHABETS)} AS size FROM y),
c AS (SELECT id, e, w, size, CAST(length(w) AS DOUBLE) AS n, i, w[i] AS c, strpos(alphabet, w[i]) - (size + 1) / 2 AS off FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM z)),
q AS (SELECT id, sum(k * k) AS squares FROM (SELECT id, c, CAST(count(*) AS DOUBLE) AS k FROM c GROUP BY id, c) GROUP BY id),
o AS (SELECT *, lead(off) OVER (PARTITION BY id ORDER BY i) AS next FROM c),
t AS (SELECT id, e, n, size, sum(CAST((off > 0) <> (next > 0) AS INTEGER)) AS changes, sum(off * next) AS serial, CAST(sum(CAST(regexp_matches(c, '[0-9]') AS INTEGER)) AS DOUBLE) AS digits, CAST(sum(CAST(regexp_matches(c, {by(["'[0-9]'", "'[A-Z]'", "'[a-z]'", "'[A-Z]'"])}) AS INTEGER)) AS DOUBLE) AS first_class FROM o GROUP BY id, e, n, size),
v AS (SELECT id, e, n, squares * size / n - n AS symbols, size - 1 AS df, 2 / (9 * (size - 1)) AS cube, (changes - (n - 1) / 2) / (sqrt(n - 1) / 2) AS runs, serial / ((size * size - 1) / 12 * sqrt(n - 1)) AS serial, {by(["10 / 16e0", "26 / 32e0", "26 / 36e0", "26 / 64e0"])} AS share, first_class, digits FROM t JOIN q USING (id)),
w AS (SELECT id, e, n, (pow(symbols / df, 1 / 3e0) - (1 - cube)) / sqrt(cube) AS uniform, sqrt(CASE e WHEN 3 THEN greatest({two("first_class", "share")}, {two("digits", "(10 / 64e0)")}) ELSE {two("first_class", "share")} END) AS classes, abs(runs) AS runs, abs(serial) AS serial FROM v),
p AS (SELECT id, e * 16 + {lengths} AS class, 1 - pow(1 - least(greatest(least({_tail("uniform")}, 2 * ({_tail("classes")}), 2 * ({_tail("runs")}), 2 * ({_tail("serial")})), 0), 1), 4) AS p FROM w),
h AS (SELECT class, least(CAST(floor(p * {bins}) AS INTEGER), {r.BINS - 1}) AS bin, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT class, cut, sum(n) FILTER (bin >= cut) AS above, 2 * sum(n) FILTER (bin >= {r.BINS // 2}) AS random FROM h, (SELECT unnest(range({int(r.LEAST_P * r.BINS)}, {r.BINS // 2 + 1})) AS cut) GROUP BY class, cut),
k AS (SELECT class, min(cut) / {bins} AS limit_p FROM j WHERE above > 0 AND random > 0 AND 1 - random * (1 - cut / {bins}) / above <= {r.MAX_FDR!r}e0 GROUP BY class),
g AS (SELECT doc_id, k, a, b FROM s WHERE k < 3 UNION ALL SELECT doc_id, k, a, b FROM s JOIN p USING (id) JOIN k AS limits ON p.class = limits.class AND p.p >= limit_p WHERE NOT EXISTS (SELECT 1 FROM s AS base WHERE base.doc_id = s.doc_id AND base.k < 3 AND base.a <= s.a AND base.b >= s.b))
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256(coalesce(string_agg({spelled}, ',' ORDER BY a, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg({spelled}, ',' ORDER BY a, k), '') AS spans, count(*) FILTER (k = 3) AS n_random
FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality(), "op2_line_dedup": lines(), "op5_url_filter": urls(), "op7_near_dedup": near(), "op8_mixing": mixed(), "op9_secret_scan": secrets()}
