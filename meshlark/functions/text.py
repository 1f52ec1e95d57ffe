"""Text measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in order of priority and the strings that point to them.
CATEGORIES = {
    "CodeGeneration": ["code", "program", "function", "debug", "algorithm", "implement", "refactor", "compile", "class", "method", "syntax", "programming"],
    "DataAnalysis": ["analyze", "analysis", "statistics", "chart", "visualize", "visualization", "data", "graph", "plot", "metric", "trend", "correlation", "regression"],
    "WebSearch": ["search", "lookup", "browse", "web", "internet", "url", "website", "online", "google"],
    "FileOperation": ["file", "directory", "document", "folder", "path", "filesystem", "disk", "storage", "csv", "json", "xml", "pdf"],
    "Reasoning": ["reason", "plan", "decide", "evaluate", "compare", "assess", "judge", "logic", "think", "consider"],
    "TextGeneration": ["summarize", "translate", "compose", "draft", "edit", "paraphrase", "rewrite", "generate text"],
}
GENERAL = "General"


def word_count(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def keyword_overlap(text: Column, query: Column) -> Column:
    """Share of the query's terms (cut at single blanks) that the text contains, case aside; 0 for a blank query."""
    terms = F.filter(F.split(F.lower(query), " "), lambda t: t != "")
    # The array of one holds the text in lower case, which is then made once for all terms.
    found = F.element_at(F.transform(F.array(F.lower(text)), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t)))), 1)
    return F.coalesce(F.try_divide(found, F.size(terms)), F.lit(0.0)).cast("double")


def classify(text: Column) -> Column:
    """The first category one of whose strings occurs in the text, case aside."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    out: Column | None = None
    for name, words in CATEGORIES.items():
        hit = lower.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(GENERAL)


def matched_keywords(text: Column, category: Column) -> Column:
    """All strings of the text's category that occur in it."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    lists = F.create_map(*(x for name, words in CATEGORIES.items() for x in (F.lit(name), F.array(*map(F.lit, words)))))
    return F.filter(F.coalesce(F.try_element_at(lists, category), F.array().cast("array<string>")), lambda w: F.contains(lower, w))


def complexity(text: Column) -> Column:
    """Half for length (500 characters at most count), half for full stops (10 at most count)."""
    t = F.coalesce(text, F.lit(""))
    stops = F.length(t) - F.length(F.replace(t, F.lit("."), F.lit("")))
    return F.least(F.length(t) / 500, F.lit(1.0)) * 0.5 + F.least(stops / 10, F.lit(1.0)) * 0.5


def contains_literal(text: Column, part: str) -> Column:
    """Case-sensitive, wildcards have no meaning."""
    return F.contains(text, F.lit(part))


def compare_text(left: Column, op: str, right: str) -> Column:
    """A stored value against a literal: as numbers if both are, else ``==`` and ``!=`` as text; otherwise null."""
    number = lambda c: F.expr(f"try_cast({c} as decimal(38,10))") if isinstance(c, str) else c.try_cast("decimal(38,10)")
    a, b = number(left), number(F.lit(right))
    ops = {"==": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}
    as_text = {"==": left == F.lit(right), "!=": left != F.lit(right)}.get(op, F.lit(None).cast("boolean"))
    return F.when(a.isNotNull() & b.isNotNull(), ops[op]).otherwise(as_text)


def backoff_schedule(attempts: int, initial: float = 1.0, factor: float = 2.0, cap: float = 60.0) -> Column:
    """Waits before each retry: initial * factor ** i, at most ``cap``."""
    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), lambda i: F.least(F.lit(initial) * F.pow(F.lit(factor), i), F.lit(cap)))
