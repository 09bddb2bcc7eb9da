"""Text helpers: common folders, time stamps, shortening, simple markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import compared_path


def common_folder(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row (folder): the longest folder that all paths lie in, '' for none. The first and the last path by order decide."""
    parts = F.split(compared_path(path), "/")
    ends = paths.where(F.col(path).isNotNull()).select(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("_p")).agg(F.min("_p").alias("a"), F.max("_p").alias("b"))
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.when(F.element_at("a", i) == F.element_at("b", i), True).otherwise(False))
    n = F.when(F.least(F.size("a"), F.size("b")) <= 0, 0).otherwise(F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.least(F.size("a"), F.size("b")))).cast("int")
    return ends.select(F.coalesce(F.array_join(F.slice("a", F.lit(1), n), "/"), F.lit("")).alias("folder"))


def iso(c: Column) -> Column:
    """A time as ISO 8601 text with six digits of a second; null stays null."""
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def shorten_end(c: Column, width: int) -> Column:
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.left(c, F.lit(max(0, width - 1))), F.lit("…")))


def shorten_middle(c: Column, width: int) -> Column:
    """First and last characters around an ellipsis, the first one more where they don't come out even."""
    rest = max(0, width - 1)
    return F.when(F.length(c) <= width, c).otherwise(F.concat(F.left(c, F.lit(rest - rest // 2)), F.lit("…"), F.right(c, F.lit(rest // 2))))


def pad(c: Column, width: int) -> Column:
    """Text of exactly `width` characters: shortened at the end, filled up with blanks."""
    return F.rpad(shorten_end(F.coalesce(c, F.lit("")), width), width, " ")


#: Simple markup and what it becomes, in the order it is replaced.
MARKUP = [
    (r"&", "&amp;"), (r"<", "&lt;"), (r">", "&gt;"), (r"(?m)^### (.+)$", "<h3>$1</h3>"), (r"(?m)^## (.+)$", "<h2>$1</h2>"), (r"(?m)^# (.+)$", "<h1>$1</h1>"),
    (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"\*([^*\n]+)\*", "<em>$1</em>"), (r"`([^`\n]+)`", "<code>$1</code>"), (r"(?m)^[-*] (.+)$", "<li>$1</li>"), (r"\[([^\]\n]+)\]\((https?://[^)\s]+)\)", "<a href=\"$2\">$1</a>"), (r"\n", "<br/>"),
]


def markup_to_html(c: Column) -> Column:
    """Headings, emphasis, code, list entries and links as HTML; everything else is escaped."""
    for pattern, by in MARKUP:
        c = F.regexp_replace(c, pattern, by)
    return c


#: What a model is told for each intent; {context} and {question} are filled in.
PROMPTS = {
    "general": "Answer from the context only.\n\n{context}\n\nQuestion: {question}",
    "blast_radius": "Say what a change affects, nearest first, from the context only.\n\n{context}\n\nQuestion: {question}",
    "governance": "Say which rules of the layers are broken and how to mend it, from the context only.\n\n{context}\n\nQuestion: {question}",
    "expertise": "Say whom to ask and why, from the context only.\n\n{context}\n\nQuestion: {question}",
    "complexity": "Say what is complex and how to simplify it, from the context only.\n\n{context}\n\nQuestion: {question}",
}


def prompt(intent: str, context: str, question: str) -> str:
    return PROMPTS.get(intent, PROMPTS["general"]).replace("{context}", context).replace("{question}", question)


def names_in(text: Column) -> Column:
    """Names of code that a text mentions: in backquotes, or with an inner capital, underscore or dot; each once, in order."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"`([^`\s]+)`"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\b([A-Za-z]+(?:[a-z0-9][A-Z]|_|\.[A-Za-z])[A-Za-z0-9_.]*[A-Za-z0-9_])"), F.lit(1)))
    return F.array_distinct(found)
