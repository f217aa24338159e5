"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from lodestone.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {lit(T.TOKEN)})"


def has(x: str, pattern: str) -> str:
    """Pattern with word boundaries at letters of any script, as RE2 lacks them."""
    return f"regexp_matches({x}, {lit(bounded(pattern))})"


def bounded(pattern: str) -> str:
    edge_left, edge_right = r"(?:^|[^\pL\pN\pM_])", r"(?:$|[^\pL\pN\pM_])"
    out, first = "", True
    for part in pattern.split(r"\b"):
        if out or not first:
            out += edge_left if out.endswith("|") or not out else edge_right
        out, first = out + part, False
    return out


def norm(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x1c-\x1f\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def sents(x: str) -> str:
    cut = rf"string_split_regex(regexp_replace({x}, '([.!?])[\s\x0b\p{{Z}}]+|\n{{2,}}', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {norm('s')}), lambda s: s <> '')"


def content(x: str) -> str:
    stop = "[" + ", ".join(lit(w) for w in T.STOPWORDS) + "]"
    return f"list_filter(list_distinct({toks(x)}), lambda t: NOT list_contains({stop}, t) AND length(t) <= 40 AND NOT (length(t) = 1 AND NOT regexp_matches(t, '^[0-9cr]$')))"


def mult(*pairs: tuple[str, float]) -> str:
    return " * ".join(["1.0::DOUBLE", *[f"(CASE WHEN {c} THEN {v}::DOUBLE ELSE 1.0::DOUBLE END)" for c, v in pairs]])


def plus(*pairs: tuple[str, float]) -> str:
    return " + ".join(f"(CASE WHEN {c} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END)" for c, v in pairs)


def case(pairs: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {lit(label)}" for label, c in pairs) + f" ELSE {lit(otherwise)} END"


def f1(a: str, b: str) -> str:
    """Token F1 of two token lists."""
    count = "len(list_filter({x}, lambda y: y = z))"
    n = f"list_sum(list_transform(list_distinct(list_intersect({a}, {b})), lambda z: least({count.format(x=a)}, {count.format(x=b)})))"
    return f"round(coalesce(2.0::DOUBLE * ({n} / len({a})::DOUBLE) * ({n} / len({b})::DOUBLE) / nullif({n} / len({a})::DOUBLE + {n} / len({b})::DOUBLE, 0), 0), 4)"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join([f"contains({x}, {lit(w)})" for w in words] or ["false"]) + ")"


def starts(x: str, words) -> str:
    return "(" + " OR ".join([f"starts_with({x}, {lit(w)})" for w in words] or ["false"]) + ")"


DOCS = r"docs AS MATERIALIZED (SELECT doc_id::VARCHAR AS doc_id, regexp_extract(text, '^[^.!?\n]*') AS title, text, lang, source FROM documents)"
QUES = f"ques AS MATERIALIZED (SELECT item_id::VARCHAR AS q_id, array_to_string(({toks('text')})[1:12], ' ') AS title, text FROM benchmark)"
TERMS = f"terms AS MATERIALIZED (SELECT q_id, term, count(*) AS qtf FROM (SELECT q_id, unnest({toks('text')}) AS term FROM ques) GROUP BY q_id, term)"
SECTIONS = r"""sections AS MATERIALIZED (SELECT doc_id, title, pos, 's' || pos AS section_id, text FROM (SELECT doc_id, title, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM docs) WHERE trim(text) <> '')"""
GOLD = f"""want AS (SELECT q_id, array_to_string(t[1:8], ' ') AS run FROM (SELECT q_id, {toks('text')} AS t FROM ques) WHERE len(t) >= 8),
dtok AS MATERIALIZED (SELECT doc_id, {toks('text')} AS t FROM docs),
runs AS (SELECT doc_id, array_to_string(t[i : i + 7], ' ') AS run FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM dtok WHERE len(t) >= 8)),
gold AS MATERIALIZED (SELECT q_id, min(doc_id) AS gold FROM runs JOIN want USING (run) GROUP BY q_id)"""


def index(name: str, units: str, text: str, keys: str = "doc_id", terms: str = "terms") -> str:
    """CTEs {name}_m: one row a (query, unit, shared term)."""
    return f"""{name}_tok AS MATERIALIZED (SELECT {keys}, {toks(text)} AS t FROM {units}),
{name}_st AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM {name}_tok),
{name}_tf AS MATERIALIZED (SELECT {keys}, len, term, count(*) AS tf FROM (SELECT {keys}, len(t) AS len, unnest(t) AS term FROM {name}_tok) WHERE term IN (SELECT term FROM {terms}) GROUP BY {keys}, len, term),
{name}_df AS MATERIALIZED (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_m AS MATERIALIZED (SELECT * FROM {name}_tf JOIN {name}_df USING (term) JOIN {terms} USING (term), {name}_st)"""


def term_score(k1: str = "1.5", b: str = "0.75") -> str:
    return f"qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / avg_len))"


def scores(name: str, out: str, keys: str = "doc_id", k1: str = "1.5", b: str = "0.75") -> str:
    return f"{out} AS MATERIALIZED (SELECT q_id, {keys}, round(sum({term_score(k1, b)}), 9) AS score FROM {name}_m GROUP BY q_id, {keys})"


def ordered_scores(name: str, out: str, keys: str = "doc_id") -> str:
    """`scores` with terms added up in their order, so that documents with equal terms have equal sums."""
    return f"{out} AS MATERIALIZED (SELECT q_id, {keys}, round(list_sum(list(part ORDER BY term)), 9) AS score FROM (SELECT q_id, {keys}, term, {term_score()} AS part FROM {name}_m) GROUP BY q_id, {keys})"


def half_up(x: str) -> str:
    """Six digits of a score of nine, as Spark rounds: the decimal number decides, not the binary one beside it."""
    return f"round({x}::DECIMAL(38, 9), 6)::DOUBLE"


def ranks(source: str, out: str, k: int | None = None, keys: str = "q_id", order: str = "score DESC, doc_id") -> str:
    cut = f" QUALIFY rank <= {k}" if k else ""
    return f"{out} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rank FROM {source}{cut})"


DOC_TEXT = "title || chr(10) || chr(10) || text"
BASE = ",\n".join([DOCS, QUES, TERMS])
BM25 = ",\n".join([BASE, index("b", "docs", DOC_TEXT), scores("b", "bs"), ranks("bs", "br")])


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select
