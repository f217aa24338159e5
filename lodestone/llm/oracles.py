"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from lodestone.llm import mixing, quality_rules

_WS = r"[ \t\n\x0b\x0c\r]"
_FOLD = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(x: str) -> str:
    return rf"regexp_extract_all(coalesce({x}, ''), '[^ \t\n\x0b\x0c\r]+')"


OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS MATERIALIZED (SELECT *, {_FOLD.format(x=rf"regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g')")} AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id"""

OP2 = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

OP5 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text')} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS MATERIALIZED (SELECT h, min(doc_id) AS first FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN f USING (h) WHERE first < doc_id),
a AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
w AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT w.doc_id, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL), '') AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _rules() -> str:
    per = lambda x, y: f"({x} / greatest({y}, 1)::DOUBLE)"
    named = {
        "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "shouts_per_word": per("n_shouts", "n_words"),
        "stop_word_ratio": per("n_stop", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"), "bullet_line_ratio": per("n_bullets", "n_lines"),
    }
    return " AND ".join(f"{named[r.measure]} {r.op} {r.bound}" for r in quality_rules.RULES)


_STOP = "[" + ", ".join("'" + w + "'" for w in quality_rules.STOP_WORDS) + "]"
OP7 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_words('text')} AS w FROM documents),
ln AS MATERIALIZED (SELECT r, t, w, doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS l FROM d),
g AS MATERIALIZED (SELECT r, i, w[i : i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
c AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
m AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g JOIN c USING (r, g)) GROUP BY r),
x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_WS}+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
len(list_filter(w, lambda y: list_contains({_STOP}, {_FOLD.format(x='y')}))) AS n_stop, length(t) - length(replace(t, '!', '')) AS n_shouts, len(l) AS n_lines, len(list_filter(l, lambda y: ltrim(y, ' ')[1] IN ('-', '*', '|'))) AS n_bullets FROM ln LEFT JOIN m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {_rules()} AS kept FROM x"""

_WEIGHT = "([" + ", ".join(map(str, mixing.WEIGHTS)) + f"])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}]"
OP9 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len({_words('text')})::BIGINT AS size, (('0x' || md5('9|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, ''))))[1:13])::BIGINT + 0.5::DOUBLE) / {2**52}.0::DOUBLE AS unit FROM documents),
n AS (SELECT source, source_size, {_WEIGHT} AS weight, 2.0::DOUBLE * source_size AS cap FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
o AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM n WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, (cap / weight, source IS NULL, source)) AS final FROM o WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(final * weight, cap)) AS target FROM o, v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DOUBLE AS ratio FROM t),
p AS MATERIALIZED (SELECT *, floor(ratio)::BIGINT AS copies, target - floor(ratio) * source_size AS need FROM r),
s AS MATERIALIZED (SELECT *, length(bin(greatest(size, 1))) AS digits FROM d),
y AS (SELECT s.source, digits, need, sum(size) AS words FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source WHERE size > 0 AND need > 0 GROUP BY s.source, digits, need),
yc AS (SELECT *, (need - coalesce(sum(words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(digits * words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c FROM y),
c0 AS MATERIALIZED (SELECT source, arg_max(c, digits) AS c FROM yc WHERE c * digits <= 1 GROUP BY source),
q0 AS MATERIALIZED (SELECT s.*, p.* EXCLUDE (source), c, least(1.0::DOUBLE, coalesce(c, 0) * digits) AS p FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN c0 ON s.source IS NOT DISTINCT FROM c0.source),
q AS MATERIALIZED (SELECT *, CASE WHEN p > 0 AND p < 1 THEN (unit / (1 - unit)) / (p / (1 - p)) END AS q FROM q0),
k AS MATERIALIZED (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN greatest(least(floor(q / (1 + q) * {mixing.STEPS}.0::DOUBLE)::BIGINT, {mixing.STEPS - 1}), 1) ELSE {mixing.STEPS - 1} END AS rank FROM q),
h AS (SELECT source, need, rank, sum(size) AS n FROM k GROUP BY source, need, rank),
e AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM h),
f AS MATERIALIZED (SELECT source, min(rank) AS cut, arg_min(need - (run - n), rank) AS gap FROM e WHERE run > need GROUP BY source),
z AS MATERIALIZED (SELECT k.*, coalesce(cut, CASE WHEN k.c > 0 THEN {mixing.STEPS} ELSE 0 END) AS cut, gap FROM k LEFT JOIN f ON k.source IS NOT DISTINCT FROM f.source),
cl AS (SELECT source, arg_min(unit, (abs(size - gap), unit)) AS closer FROM z WHERE gap > 0 AND rank >= cut AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, (copies + (rank < cut OR coalesce(unit = closer, false))::BIGINT) * size AS taken FROM z LEFT JOIN cl ON z.source IS NOT DISTINCT FROM cl.source"""

_LETTERS = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {x})"
OP11 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_words('text')} AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l USING (doc_id)),
m AS MATERIALIZED (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM {_LETTERS.format(x='a')}, {_LETTERS.format(x='b')}, {_LETTERS.format(x='c')}, {_LETTERS.format(x='d')}, {_LETTERS.format(x='e')} WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS MATERIALIZED (SELECT part, filter_order, step, filter_order[step] AS letter,
sum(n) FILTER (length(translate(fails, filter_order[:step], '')) = length(fails)) AS kept,
sum(n) FILTER (contains(fails, filter_order[step]) AND length(translate(fails, filter_order[:step - 1], '')) = length(fails)) AS removed,
sum(n) FILTER (contains(fails, filter_order[step]) AND length(translate(fails, filter_order[:step - 1], '')) < length(fails)) AS redundant,
sum(n) FILTER (fails = filter_order[step]) AS unique_fails,
sum(good) FILTER (contains(fails, filter_order[step]) AND length(translate(fails, filter_order[:step - 1], '')) = length(fails)) AS good_lost,
sum(toxic) FILTER (contains(fails, filter_order[step]) AND length(translate(fails, filter_order[:step - 1], '')) = length(fails)) AS toxic_lost
FROM m, s GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley FROM r"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || x[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT]), '') AS payload_digest,
CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NULL OR page_id < first THEN first END AS refers_to FROM m"""

_FLOOR = "((s - ((s % n) + n) % n) // n)"


def _codes() -> str:
    """Six rounds, each a pair of CTEs: the nearest entry of every part, then the entries' means."""
    near = "SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT r, x.part, entry, list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d FROM x JOIN {c} c ON x.part = c.part) GROUP BY r, part"
    rounds = []
    for k in range(6):
        rounds.append(f"a{k} AS MATERIALIZED ({near.format(c=f'c{k}')})")
        rounds.append(
            f"m{k} AS (SELECT part, entry, list({_FLOOR} ORDER BY i) AS v FROM (SELECT a.part, a.entry, i, sum(x.v[i])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN x USING (r, part), LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS i) GROUP BY a.part, a.entry, i) GROUP BY part, entry), "
            f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"
        )
    return f"""
WITH u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
x AS MATERIALIZED (SELECT r, p AS part, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM u, LATERAL (SELECT unnest(range(8)) AS p)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM x WHERE r <= 16),
{', '.join(rounds)},
f AS MATERIALIZED ({near.format(c='c6')}),
g AS MATERIALIZED (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r),
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM u JOIN g USING (r), b"""


OP13 = _codes()

ORACLES = {"op1_line_dedup": OP1, "op2_exact_search": OP2, "op5_substring_dedup": OP5, "op7_quality_rules": OP7, "op9_mixing": OP9, "op11_filter_audit": OP11, "op12_warc": OP12, "op13_vector_codes": OP13}
