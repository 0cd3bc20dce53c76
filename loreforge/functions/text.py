"""Text analysis as column expressions: query terms, stems, index tokens, previews and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TERM, MAX_TERMS = 3, 24
STEM_FROM, STEM_LENGTH = 6, 5

# Words that are never search terms.
STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "have", "has", "are",
    "was", "were", "not", "but", "you", "your", "can", "will", "would", "should",
    "make", "made", "please", "just", "how", "what", "why", "when", "where",
    "jest", "nie", "tak", "sie", "się", "czy", "jak", "dla", "aby",
    "oraz", "ale", "tego", "tym", "przy", "moze", "może", "bylo", "było",
)

# Letters whose accents the index ignores (not the stroke of ł).
ACCENTED = "ąćęńóśźżéèêëàâáäîïíôöùûüúçñ"
PLAIN = "acenoszzeeeeaaaaiiioouuuucn"

# Category rules, the first that matches wins, and severity rules.
CATEGORY_RULES = (
    ("financial", r"pricing|price|revenue|setup fee|subscription|payout|invoice|billing|payment|refund"),
    ("i18n", r"\bi18n\b|\bl10n\b|translation|locale|hreflang|multi-?lang"),
    ("seo", r"\bseo\b|\bgeo\b|serp|keyword|crawl|sitemap|structured data|llms\.txt"),
    ("security", r"secret|leak|credential|api-?token|api-?key|vulnerab|owasp|sanitiz|\bxss\b|\bcsrf\b|\bauth\b"),
    ("deployment", r"deploy|ci-?cd|pipeline|rollback|staging|release|env-gap|server-convention|\binfra\b"),
    ("performance", r"performance|speed|slow|cache|latency|core-web-vital|\bttfb\b|bundle"),
    ("testing", r"\be2e\b|playwright|unit-?test|integration test|regression test"),
    ("marketing", r"marketing|campaign|\bads?\b|prospect|funnel|newsletter|outreach|tracking|pixel|analytics"),
    ("sales", r"\blead\b|pitch|\bicp\b|sales|proposal"),
    ("design", r"\bui\b|\bux\b|layout|component|design|typography|accessibilit|frontend"),
    ("architecture", r"architect|structure|data-?model|schema|monorepo|constraint|invariant|drift"),
    ("bug-fix", r"\bbug\b|broken|\bfix\b|regression|hotfix|invalid|missing|stale"),
    ("gotcha", r"gotcha|pitfall|non-?obvious|counterintuitive|surprising"),
    ("business", r"strategy|roadmap|business|portfolio|positioning|competitor|\bplan\b"),
)
SEVERITY_RULES = (
    ("critical", r"\bcritical\b|revenue-critical|\bnever\b|must not|breaks production|data loss"),
    ("important", r"\bimportant\b|gotcha|constraint|\bdo not\b|caveat|watch out"),
)


def fold(text: Column) -> Column:
    """Lower case without accents; ł keeps its stroke."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def index_tokens(text: Column) -> Column:
    """The tokens under which a text is indexed: folded runs of letters and digits. Null: none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _raw_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _picked(raw: Column, least: int, stop: bool) -> Column:
    stops = F.array(*[F.lit(w) for w in STOPWORDS])
    keep = lambda t: (F.length(t) >= least) & ~F.array_contains(stops, t) if stop else F.length(t) >= least
    return F.slice(F.array_distinct(F.filter(raw, keep)), 1, MAX_TERMS)


def strict_terms(text: Column) -> Column:
    """Search terms: lower case, no stop words, three letters or more, first 24 distinct ones."""
    return _picked(_raw_terms(text), MIN_TERM, True)


def query_terms(text: Column) -> Column:
    """``strict_terms``; where there are none, shorter terms and stop words step by step."""
    raw = _raw_terms(text)
    full, two = _picked(raw, MIN_TERM, True), _picked(raw, 2, False)
    return F.when(F.size(full) > 0, full).when(F.size(two) > 0, two).otherwise(_picked(raw, 1, False))


def stem(term: Column) -> Column:
    """The first five letters of a term of six or more."""
    return F.when(F.length(term) >= STEM_FROM, F.substring(term, 1, STEM_LENGTH)).otherwise(term)


def stems(terms: Column) -> Column:
    return F.transform(terms, stem)


def quoted(text: Column) -> Column:
    """Every word of a query in quotation marks, so that none is read as syntax."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    return F.array_join(F.transform(raw, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " ")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n+"), strip), lambda p: p != "")


def first_line(text: Column, most: int = 110) -> Column:
    """The first line that is not blank, cut to ``most`` characters and an ellipsis."""
    line = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda s: s != ""), F.lit(0))
    line = F.coalesce(line, F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def clip(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, at a blank in the last two fifths where there is one, with an ellipsis."""
    head = F.substring(text, 1, limit)
    back = F.instr(F.reverse(head), " ")
    space = F.when(back > 0, limit - back).otherwise(-1)
    kept = F.when(space > limit * 0.6, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(kept, r"[ ,.;:]+$", ""), F.lit(" …")))


def project_name(path: Column) -> Column:
    """The last part of a path without a work-tree suffix."""
    last = F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)
    return F.regexp_replace(last, r"-(session|hotfix|worktree)-.*$", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _first_rule(text: Column, rules: tuple) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def category(kind: Column, name: Column, description: Column, body: Column, is_client: Column) -> Column:
    """Category of an imported note: by its kind, its client flag, its title, else its text."""
    topic = F.concat_ws(" ", name, description)
    by_text = F.coalesce(_first_rule(topic, CATEGORY_RULES), _first_rule(body, CATEGORY_RULES), F.lit("business"))
    return F.when(kind.isin("feedback", "user"), "workflow").when(kind == "reference", "tooling").when(is_client, "client").otherwise(by_text)


def severity(name: Column, body: Column) -> Column:
    return F.coalesce(_first_rule(F.concat_ws(" ", name, body), SEVERITY_RULES), F.lit("info"))


def import_tags(name: Column, kind: Column, project: Column) -> Column:
    """Tags of an imported note: its kind, project and up to six words of its name, lower case, at most ten."""
    words = F.slice(F.filter(F.split(F.coalesce(name, F.lit("")), r"[-_\s]"), lambda t: F.length(t) > 2), 1, 6)
    every = F.concat(F.array(F.lit("imported-md"), kind, project), words)
    return F.slice(F.array_distinct(F.filter(F.transform(every, F.lower), lambda t: t.isNotNull() & (t != ""))), 1, 10)


def covered(stems_: Column, content: Column) -> Column:
    """How many stems the lower-cased text contains."""
    low = F.lower(F.coalesce(content, F.lit("")))
    return F.size(F.filter(stems_, lambda s: F.contains(low, s)))


def coverage_floor(n: Column, ratio: float) -> Column:
    return F.least(F.lit(3), F.greatest(F.lit(2), F.ceil(n * F.lit(ratio)))).cast("int")
