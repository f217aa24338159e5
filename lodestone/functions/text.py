"""Text functions as Spark columns: tokens, sentences, signals, routes.

All but `token_numbers` and `token_sizes` are built-in expressions and need no Python worker.  Regular
expressions that must treat Unicode white space alike carry `(?U)`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that define the results.
TOKEN = r"[a-z0-9_+#]+(?:[.+#-][a-z0-9_+#]+)*"
PIECE = 1 << 20  # bytes of texts that are cut into tokens at once
STOPWORDS = "a about after all an and any are as at be by can could do does for from get has have how i if in into is it my of on or the this to what when where with you".split()
CVE = r"\bcve-\d{4}-\d{4,7}\b"
SPECIAL = r"\b(?:cve-\d{4}-\d{4,7}|[a-z]{1,8}\d{2,}[a-z0-9-]*|\d+(?:\.\d+){1,}|[a-z0-9]+(?:[-_][a-z0-9]+)+)\b"
ANSWER = r"\b(resolving the problem|resolution|solution|answer)\b"
WORKAROUND = r"\b(workaround|fix|corrective action|local fix)\b"
CAUSE = r"\b(cause|caused by|root cause)\b"
ACTION = r"\b(install|upgrade|configure|set|enable|disable|use|apply)\b"
WINDOW_ACTION = r"\b(install|upgrade|configure|restart|set|enable|disable|apply|run|use)\b"
SPAN_ACTION = r"\b(use|set|enable|disable|install|apply|code|configure)\b"
RESOLVE = r"\b(to resolve|resolve this|resolving the problem)\b"
STEPS = r"\b(steps?|procedure|instructions?|complete the following)\b"
MUST = r"\b(required|must|should|recommended|supported)\b"
PATH_LIKE = r"([a-z]:\\|/[^ ]+/|\\[^ ]+\\)"
DUMP = r"\b(trace|stack|dump|exception|thread|timestamp|heapdump|javacore)\b"
PROBLEM_DUMP = r"\b(trace|stack|dump|exception|javacore|heapdump|0section|1xhexc)\b"
TRACE = r"\b(trace|stack|dump|exception|heapdump|javacore)\b"
STATED = r"\b(problem summary|symptom|question|environment|error description)\b"
DIAGNOSIS = r"\b(diagnosing the problem|collecting data|steps to reproduce)\b"
NOISE_HEADING = r"\b(problem\(abstract\)|symptom|environment|diagnosing the problem|collecting data|steps to reproduce)\b"
QUESTION_HEADING = r"\b(question|technote \(faq\))\b"
CVSS = r"\bcveid\b|\bcvss base score\b|\bcvss vector\b"
CVSS_SHORT = r"\bcveid\b|\bcvss base score\b"
DESCRIPTION = r"\b(description:|description)\b"
LIMITATION = r"\b(restriction|limitation|known current limitation)\b"
ENHANCEMENT = r"\b(rfe|enhancement)\b"
HEADING = (
    r"\b(problem\(abstract\)|problem summary|symptom|error description|question|environment|summary|affected products and versions|"
    r"remediation/fixes|cause|answer|resolving the problem|resolution|solution|workaround|fix|corrective action|local fix|"
    r"diagnosing the problem|collecting data|steps to reproduce)\b"
)
POST_FIX = r"\b(after applying|after apply|after installing|after install|crash|gpf|verifyerror|noclassdeffounderror|exception|error)\b"
AFFECTED = r"\b(affected products? and versions?|affected versions?|what\s+versions?|which\s+versions?|what\s+products?|which\s+products?|what\s+releases?|which\s+releases?)\b"
REMEDIATION = r"\b(remediation|fixes|first fix|workarounds?|mitigations?|patch|patches|apply|upgrade|update|download)\b"
COMPOSE_SIGNAL = r"\b(answer|apply|configure|corrective action|disable|download|enable|fix|install|local fix|must|resolution|resolving the problem|set|should|solution|use|workaround)\b"
SECURITY_WORDS = ("cve-", "cveid", "cvss", "security bulletin")
ROUTE_WORDS = (
    ("limitation_or_restriction", ("limitation", "restriction", "not supported")),
    ("error_or_log", ("exception", "trace", "dump", "javacore", "error ")),
    ("install_upgrade_config", ("install", "upgrade", "configure", "migration")),
)
LINK_WORDS = (".pdf", "attached", "/support/docview", "http://", "https://")
LOOKUP_STARTS = ("how ", "how do", "how can", "what is", "where ")
SUBTYPE_WORDS = (
    ("support_or_download", ("support's guide", "support guide", "attached", "attachment", ".pdf", "download", "where can i download"), ()),
    ("procedure_or_change", ("how to", "steps", "procedure", "hide", "delete", "create", "modify", "change", "migrate", "convert", "enable", "disable", "retrieve", "open module"), ()),
    ("configuration_or_property", ("configuration", "configure", "property", "parameter", "xml", "libpath", "output_type", "setting", "timeout"), ()),
    ("capability_or_support", ("supported", "compliant"), ("can ", "is ", "does ", "do ", "would ", "want ")),
    ("failure_or_behavior", ("unable", "can't", "cannot", "not able", "fail", "failed", "problem", "refused", "unavailable"), ("why ",)),
    ("definition_or_lookup", (), ("what exactly", "what is")),
)


def has(text: Column, pattern: str) -> Column:
    """Whether lower-case text has the pattern; word boundaries know all letters."""
    return text.rlike(f"(?U){pattern}")


def product(*factors: Column) -> Column:
    return reduce(lambda a, b: a * b, factors, F.lit(1.0))


def factor(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(float(value))).otherwise(F.lit(1.0))


def bonus(condition: Column, value: float) -> Column:
    return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    """Lower-case lexical tokens, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def token_numbers(words: list[str]):
    """A function of an Arrow array of lower-case texts: the place in `words` of each of their `tokens`, -1 if it has none, and how many a text has.

    For tasks that need no more of whole texts than numbers.  Only ASCII belongs to
    a token, so that tokens are runs of bytes: bytes of the kind 1, and one of the
    kind 2 between two of these.  Pieces of texts are small enough for a core's cache.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    known, kind = pa.array(words, pa.string()), np.zeros(256, np.uint8)
    kind[list(b"abcdefghijklmnopqrstuvwxyz0123456789_+#")], kind[list(b".-")] = 1, 2

    def cut(data, ends):
        """Tokens of the texts of which `ends` tells the borders in `data`, and how many each has."""
        kinds = kind[data]
        own = kinds == 1
        joins = np.flatnonzero(kinds == 2)
        text = np.searchsorted(ends, joins, "right")
        joins = joins[(joins > ends[text - 1]) & (joins < ends[text] - 1)]
        own[joins[own[joins - 1] & own[joins + 1]]] = True
        first, last, some = own.copy(), own.copy(), ends[:-1] < ends[1:]
        first[1:] &= ~own[:-1]
        last[:-1] &= ~own[1:]
        for edge, at in ((first, ends[:-1][some]), (last, ends[1:][some] - 1)):
            edge[at] = own[at]
        first, last = np.flatnonzero(first), np.flatnonzero(last)
        offsets = np.r_[0, np.cumsum(last - first + 1)].astype(np.int32)
        found = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[own]))
        return found, np.diff(np.searchsorted(first, ends))

    def numbers(texts):
        texts = texts.fill_null("").cast(pa.large_string())
        _, borders, data = texts.buffers()
        ends, data = np.frombuffer(borders, np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(data or b"", np.uint8)
        parts, sizes, at = [], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
            part, size = cut(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            parts.append(part)
            sizes.append(size)
            at = to
        found = pc.index_in(pa.chunked_array(parts, pa.string()), value_set=known).fill_null(-1)
        return found.to_numpy().astype(np.int32), np.concatenate(sizes)

    return numbers


def token_sizes():
    """A function of an Arrow array of lower-case texts: how many `tokens`, and how many distinct ones, each has."""
    import re

    import numpy as np

    pattern = TOKEN

    def sizes(texts):
        find, out = re.compile(pattern).findall, np.zeros((2, len(texts)), np.int64)
        for i, text in enumerate(texts):
            found = find(text.as_py() or "")
            out[:, i] = len(found), len(set(found))
        return out

    return sizes


def run_starts(ordered: Column) -> Column:
    """1-based places of a sorted list at which a value is first, and one beyond the end."""
    n = F.size(ordered)
    return F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i == 1) | (i > n) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))


def runs(ordered: Column, starts: Column) -> Column:
    """[(term, tf)] of a sorted list with its `run_starts`: the distinct values and how often each is there."""
    return F.transform(F.slice(starts, F.lit(1), F.size(starts) - 1), lambda i, k: F.struct(F.get(ordered, i - 1).alias("term"), (F.get(starts, k + 1) - i).cast("bigint").alias("tf")))


def normalized(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Pieces after [.!?] or between blank lines, normalised, none empty."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+|\n{2,}")
    return F.filter(F.transform(parts, normalized), lambda s: s != "")


def noisy(token: Column) -> Column:
    single = (F.length(token) == 1) & ~token.rlike("^[0-9cr]$")
    return (F.length(token) > 40) | single


def content_terms(text: Column) -> Column:
    """Distinct tokens without stop words and noise, first occurrence order."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: ~t.isin(STOPWORDS) & ~noisy(t))


def question_key(text: Column) -> Column:
    """Normalised question text, for exact leakage joins."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def ratio_of(text: Column, removed: str) -> Column:
    """Share of the characters that are left when the pattern is removed."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, removed, "")) / n).otherwise(F.lit(0.0))


def symbol_ratio(text: Column) -> Column:
    return ratio_of(text, r"(?U)[\p{L}\p{N}\s]")


def non_ascii_ratio(text: Column) -> Column:
    return ratio_of(text, r"[\x00-\x7F]")


class Signals:
    """What the scores below read of a text; `found` tests one of PATTERNS, CONTAINED or NULL_WORD.

    Of a window, `span` is the window itself and `text` the window behind its heading.
    """

    def __init__(self, text: Column, span: Column | None = None) -> None:
        low = F.lower(text)
        span = text if span is None else span
        self.found = lambda key: on(low, key)
        self.chars, self.symbols, self.foreign = F.length(text), symbol_ratio(text), non_ascii_ratio(text)
        self.tokens, self.sentences, self.cves = F.size(tokens(span)), F.size(sentences(span)), cves(text)


class Kept(Signals):
    """The same from the columns of `unit_signals` and sums of them."""

    def __init__(self, bits: Column, chars: Column, symbols: Column, foreign: Column, tokens_: Column, sentences_: Column, cves_: Column) -> None:
        self.found = lambda key: bits.bitwiseAND(F.lit(1 << KEYS.index(key))) != 0
        share = lambda n: F.when(chars > 0, n / chars).otherwise(F.lit(0.0))
        self.chars, self.symbols, self.foreign = chars, share(symbols), share(foreign)
        self.tokens, self.sentences, self.cves = tokens_, sentences_, cves_


BACKGROUND = (r"\bsummary\b", r"\baffected products and versions\b", r"\bremediation/fixes\b")
#: Everything that `found` may be asked; parts of a text that hold a blank are in CONTAINED.
PATTERNS = (ANSWER, WORKAROUND, CAUSE, ACTION, WINDOW_ACTION, SPAN_ACTION, RESOLVE, STEPS, MUST, PATH_LIKE, DUMP, PROBLEM_DUMP, STATED, DIAGNOSIS, CVSS, CVSS_SHORT, DESCRIPTION, LIMITATION, ENHANCEMENT, CVE, *BACKGROUND)
CONTAINED, NULL_WORD = ("problem(abstract)", "cve", "security bulletin", "docview", "support/docview", "security bulletin:"), "null word"
KEYS = (*PATTERNS, *CONTAINED, NULL_WORD)
#: The phrases of several words in PATTERNS and CONTAINED, which alone can lie across the end of a sentence.
PHRASES = sorted({p for k in (*PATTERNS, *CONTAINED) if k != PATH_LIKE for p in re.findall(r"[a-z/]+(?: [a-z/]+)+", k.replace(r"\b", "|"))})


def on(low: Column, key: str) -> Column:
    if key == NULL_WORD:
        return F.concat(F.lit(" "), low, F.lit(" ")).contains(" null ")
    return low.contains(key) if key in CONTAINED else has(low, key)


def bits_of(low: Column, keys=KEYS) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(on(low, k), F.lit(1 << KEYS.index(k)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in keys])


def phrase_bits(text: Column) -> Column:
    """Bits of keys with phrases, tested only where the text has one of the phrases at all."""
    low = F.lower(text)
    keys = [k for k in (*PATTERNS, *CONTAINED) if any(p in k for p in PHRASES)]
    return F.when(low.rlike("|".join(re.escape(p) for p in PHRASES)), bits_of(low, keys)).otherwise(F.lit(0).cast("bigint"))


def unit_signals(text: Column, prefix: str = "") -> list[Column]:
    """Columns bits, chars, symbols, foreign and cves of a heading or sentence; sums, unions and `bitwiseOR` join them."""
    count = lambda removed: F.length(F.regexp_replace(text, removed, ""))
    parts = {"bits": bits_of(F.lower(text)), "chars": F.length(text), "symbols": count(r"(?U)[\p{L}\p{N}\s]"), "foreign": count(r"[\x00-\x7F]"), "cves": cves(text)}
    return [c.alias(prefix + n) for n, c in parts.items()]


def noise_penalty(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    return product(factor(x.chars > 260, 0.72), factor(x.chars > 500, 0.55), factor(x.found(PATH_LIKE), 0.7), factor(x.found(DUMP), 0.75), factor(x.symbols > 0.18, 0.8))


def answer_bonus(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    return F.when(x.found(ANSWER), 25.0).when(x.found(WORKAROUND), 12.0).when(x.found(CAUSE), 10.0).otherwise(0.0)


def answer_multiplier(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    return product(factor(x.found(ANSWER), 2.5), factor(x.found(WORKAROUND), 1.6), factor(x.found(CAUSE), 1.3), factor(x.found(ACTION), 1.1))


def problem_penalty(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    stated = x.found("problem(abstract)") | x.found(STATED)
    return product(factor(stated, 0.12), factor(x.found(DIAGNOSIS), 0.5), factor(x.found(PROBLEM_DUMP), 0.25), factor(x.found(NULL_WORD), 0.6))


def action_bonus(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    return bonus(x.found(RESOLVE), 12) + bonus(x.found(STEPS), 8) + bonus(x.found(WINDOW_ACTION), 5) + bonus(x.found(MUST), 3)


def compact_multiplier(span: Column, scoring: Column, own: Signals | None = None) -> Column:
    x = own or Signals(scoring, span)
    few = (x.sentences > 1) & (x.sentences <= 3)
    return factor(few & (x.tokens <= 90), 1.08) * factor((answer_bonus(scoring, own) > 0) & few, 1.08)


def length_penalty(text: Column, hard: int, soft: int, own: Signals | None = None) -> Column:
    n = own.tokens if own else F.size(tokens(text))
    return F.when(n > hard, 0.65).when(n > soft, 0.8).otherwise(1.0)


def span_bonus(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    return bonus(x.found(CVSS), 45) + bonus(x.found(DESCRIPTION) & x.found("cve"), 20) + bonus(x.found(LIMITATION), 22) + bonus(x.found(ENHANCEMENT), 16) + bonus(x.found(SPAN_ACTION), 6)


def cves(text: Column) -> Column:
    """Distinct lower-case CVE ids, in order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?U)({CVE})"), F.lit(1)))


def cve_bonus(text: Column, wanted: Column, own: Signals | None = None) -> Column:
    """`wanted`: the CVE ids of the question."""
    ids = own.cves if own else cves(text)
    shared = F.size(F.array_intersect(ids, wanted))
    first = F.coalesce(F.array_contains(wanted, F.get(ids, F.lit(0))), F.lit(False))
    return F.when(F.size(wanted) == 0, 0.0).when(F.size(ids) == 0, -18.0).when(shared == 0, -45.0).otherwise(28.0 * shared + bonus(first, 18))


def cve_multiplier(text: Column, wanted: Column, own: Signals | None = None) -> Column:
    ids = own.cves if own else cves(text)
    extra = F.size(F.array_except(ids, wanted))
    first = F.coalesce(F.array_contains(wanted, F.get(ids, F.lit(0))), F.lit(False))
    spread = F.when(extra > 0, F.greatest(F.lit(0.55), 1.0 - 0.15 * extra)).otherwise(1.0)
    hit = F.lit(1.35) * spread * factor(~first, 0.68)
    return F.when(F.size(wanted) == 0, 1.0).when(F.size(ids) == 0, 0.65).when(F.size(F.array_intersect(ids, wanted)) == 0, 0.35).otherwise(hit)


def background_penalty(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    return product(*[factor(x.found(p), v) for p, v in zip(BACKGROUND, (0.6, 0.55, 0.8))])


def reference_penalty(text: Column, own: Signals | None = None) -> Column:
    x = own or Signals(text)
    foreign = (x.foreign > 0.08) & (x.found("security bulletin") | x.found("docview") | x.found(CVE))
    pointer = x.found("support/docview") & x.found("security bulletin:") & ~x.found(CVSS_SHORT)
    return factor(foreign, 0.42) * factor(pointer, 0.75)


def special_tokens(text: Column) -> Column:
    """CVE ids, letter-digit codes, versions and hyphenated identifiers, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?U)({SPECIAL})"), F.lit(1))))


def quoted_terms(text: Column) -> Column:
    """Tokens inside back ticks, double and single quotes."""
    inside = [F.regexp_extract_all(text, F.lit(f"{q}([^{q}]+){q}"), F.lit(1)) for q in ("`", '"', "'")]
    return F.array_distinct(F.flatten(F.transform(F.flatten(F.array(*inside)), tokens)))


def repeated(text: Column, weight: float) -> Column:
    """`text` as often as the rounded weight, newline between; blank stays empty."""
    n = max(int(weight + 0.5), 0)
    return F.when(F.trim(text) == "", F.lit("")).otherwise(F.array_join(F.array_repeat(text, n), "\n"))


def windows(items: Column, most: int) -> Column:
    """All runs of 1 .. most neighbours, shorter ones first, joined by a blank."""
    n = F.size(items)
    sized = F.sequence(F.lit(1), F.least(F.lit(most), n))
    runs = F.transform(sized, lambda w: F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.array_join(F.slice(items, i, w), " ")))
    return F.when(n > 0, F.flatten(runs)).otherwise(F.array().cast("array<string>"))


def sections(text: Column) -> Column:
    """Array of (heading, body): the text cut at headings, blank bodies dropped."""
    mark, body = "\x01", "\x02"
    parts = F.split(F.regexp_replace(text, f"(?iU){HEADING}", f"{mark}$1{body}"), mark)
    named = F.transform(parts, lambda p: F.when(p.contains(body), F.struct(normalized(F.substring_index(p, body, 1)).alias("heading"), F.trim(F.regexp_replace(F.substring_index(p, body, -1), r"^\s+|\s+$", "")).alias("body"))).otherwise(F.struct(F.lit("").alias("heading"), F.regexp_replace(p, r"^\s+|\s+$", "").alias("body"))))
    return F.filter(named, lambda s: s["body"] != "")


def plain_terms(text: Column) -> Column:
    """Distinct tokens of two letters or more that aren't stop words."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: ~t.isin(*STOPWORDS) & (F.length(t) > 1))


def any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts], F.lit(False))


def starts_any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in parts], F.lit(False))


def cases(pairs, otherwise: str) -> Column:
    """CASE over (label, condition) pairs, in order."""
    out = F.when(pairs[0][1], pairs[0][0])
    for label, condition in pairs[1:]:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def full_question(title: Column, text: Column) -> Column:
    """Title and text, a blank line between; blank ones left out."""
    parts = [F.regexp_replace(x, r"(?U)^\s+|\s+$", "") for x in (title, text)]
    return F.concat_ws("\n\n", *[F.when(p != "", p) for p in parts])


def route(title: Column, question: Column) -> Column:
    """Nine question routes by ordered keyword rules over title and text; look-ups by how the title starts."""
    q, t = F.lower(full_question(title, question)), F.lower(title)
    security = any_of(q, SECURITY_WORDS)
    return cases(
        [
            ("security_bulletin_post_fix_behavior", security & has(q, POST_FIX)),
            ("security_bulletin_affected_product", security & has(q, AFFECTED)),
            ("security_bulletin_remediation", security & has(q, REMEDIATION)),
            ("security_bulletin_vulnerability_detail", security),
            *[(label, any_of(q, words)) for label, words in ROUTE_WORDS],
            ("how_to_or_lookup", starts_any(t, LOOKUP_STARTS)),
        ],
        "other",
    )


def subtype(title: Column, question: Column) -> Column:
    """Seven kinds of questions on the route `other`."""
    both, start = F.lower(F.concat(title, F.lit("\n"), question)), F.lower(F.trim(title))
    return cases([(label, any_of(both, words) | starts_any(start, starts)) for label, words, starts in SUBTYPE_WORDS], "general_other")


def question_type(title: Column, question: Column, answer: Column) -> Column:
    """Seven coarse types; reads the gold answer, so for analysis only."""
    all_ = F.lower(F.concat(title, F.lit("\n"), question, F.lit("\n"), answer))
    (limit, error, install), start = ROUTE_WORDS, starts_any(F.lower(title), LOOKUP_STARTS)
    ordered = [("security_bulletin", SECURITY_WORDS), limit, ("attachment_or_link", LINK_WORDS), error, install]
    return cases([(label, any_of(all_, words)) for label, words in ordered] + [("how_to_or_lookup", start)], "other")


def answer_signal(text: Column) -> Column:
    low = F.lower(text)
    return F.round(bonus(has(low, ANSWER), 2.0) + bonus(has(low, WORKAROUND), 1.2) + bonus(has(low, WINDOW_ACTION), 0.8) + bonus(has(low, MUST), 0.4), 4)


def problem_noise(text: Column) -> Column:
    low = F.lower(text)
    return F.round(bonus(has(low, NOISE_HEADING), 1.0) + bonus(has(low, QUESTION_HEADING), 0.7) + bonus(has(low, TRACE), 0.5) + bonus(F.size(tokens(text)) > 120, 0.8), 4)


def preview(text: Column, limit: int = 220) -> Column:
    flat = normalized(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("...")))


def number_id(value: Column, digits: int = 2) -> Column:
    return F.regexp_replace(F.format_number(value, digits), r"\.", "_")
