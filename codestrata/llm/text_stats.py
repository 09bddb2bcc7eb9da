"""Statistics of the words, symbols and lines of a text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_TIGHT = re.compile(r"[,;](?=\S)")
_DIGIT = re.compile(r"\d")
_INNER = re.compile(r"\w[_/.]\w")
_END = tuple(".!?:;…\"'»”)")
#: Most common words of the fixed table (checked).
MOST_COMMON = 10_000
BUCKETS = 256
#: Signs by which a text read in a wrong encoding shows.
_MISREAD = "ÃÂâ€¬"

#: Columns of `statistics`, in order: nothing that grows with the text, as sizes say little of the form and differ most between
#: collections. Shares of lines are shares of their characters without blanks.
FEATURES = (
    "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "space_ratio", "letter_ratio", "control_ratio", "misread_ratio",
    "common_words", "near_common_words", "single_letters", "repeated_words", "commas_per_word", "identifier_share", "mean_token_length", "line_length_spread", "distinct_lines", "top_line_share",
    "ended_lines", "worded_lines", "half_worded_lines", "bare_lines", "short_lines", "marked_lines", "numbered_lines", "delimited_lines", "gapped_lines", "symbol_lines", "digit_lines", "tagged_lines", "regular_lines", "same_start_lines", "capital_lines",
)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every character of the basic plane: 0 symbol, 1 lower letter, 2 upper, 3 digit, 4 blank, 5 control or replacement, 6 sign of a wrong encoding."""
    out = np.zeros(65536, np.int64)
    for i in range(65536):
        c = chr(i)
        kind = unicodedata.category(c)
        out[i] = 6 if c in _MISREAD else 4 if c.isspace() else 5 if kind in ("Cc", "Cs", "Co", "Cn") or i == 0xFFFD else 3 if c.isdigit() else 2 if kind in ("Lu", "Lt") else 1 if kind[0] == "L" else 0
    return out


def statistics(text: str, common_words: frozenset[str]) -> list[float] | None:
    """FEATURES of a whole text, or None for one that is null or blank."""
    if text is None or not text.strip():
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    symbols, lower, upper, digits, space, control, misread = np.bincount(_classes()[np.minimum(codes, 65535)], minlength=7)[:7].tolist()
    n = len(codes)
    seen: Counter[str] = Counter()
    lengths: list[int] = []
    shares = dict.fromkeys(FEATURES[FEATURES.index("ended_lines") :], 0)
    total = n_words = letters = n_common = near = singles = repeats = commas = 0
    before_cells, before_start = -1, ""
    for line in text.splitlines():
        s = line.strip()
        if not s:
            continue
        seen[s] += 1
        lengths.append(len(s))
        words = WORD.findall(s.lower())
        flags = [x in common_words for x in words]
        common, w = sum(flags), len(words)
        long = len("".join(words))
        n_words += w
        letters += long
        n_common += common
        weight = len(s) - s.count(" ")
        total += weight
        if common:
            last = -9
            for i, f in enumerate(flags):
                last = i if f else last
                near += i - last <= 3
        if w > 1 and long < 3 * w:
            singles += list(map(len, words)).count(1)
        repeats += sum(map(str.__eq__, words, words[1:])) if len(set(words)) < w else 0
        commas += s.count(", ")
        cells = s.count("|") + s.count("\t") + s.count("&") + len(_TIGHT.findall(s))
        start = s[0]
        n_digits = len(_DIGIT.findall(s))
        marks = weight - long - n_digits
        for name, holds in (
            ("ended_lines", s.endswith(_END)), ("worded_lines", w >= 5 and common >= 0.2 * w), ("half_worded_lines", w >= 3 and common >= 1 and common >= 0.12 * w), ("bare_lines", not common), ("short_lines", w <= 7),
            ("marked_lines", not start.isalnum()), ("numbered_lines", start.isdigit()), ("delimited_lines", cells >= 2), ("gapped_lines", "  " in s and bool(_GAP.search(s)) or "\t" in s), ("symbol_lines", marks > 0.15 * len(s)), ("digit_lines", n_digits > 0.25 * weight),
            ("tagged_lines", start == "<" or "</" in s), ("regular_lines", cells > 0 and cells == before_cells), ("same_start_lines", start == before_start and not start.isalpha()), ("capital_lines", start.isupper() and w <= 7),
        ):
            if holds:
                shares[name] += weight
        before_cells, before_start = cells, start
    n_tokens = len(text.split())
    n_lines = len(lengths)
    line_chars = sum(lengths)
    spread = (max(0.0, sum(x * x for x in lengths) / n_lines - (line_chars / n_lines) ** 2)) ** 0.5 / max(1.0, line_chars / n_lines)
    repeated = sum(v * len(k) for k, v in seen.items() if v >= 3)
    words = max(1, n_words)
    values = [
        letters / words, symbols / n, digits / n, upper / n, space / n, (lower + upper) / n, control / n, misread / n,
        n_common / words, near / words, singles / words, repeats / words, commas / words, len(_INNER.findall(text)) / n_tokens, total / n_tokens, spread, len(seen) / n_lines, repeated / max(1, line_chars) if n_lines > 1 else 0.0,
        *[v / total for v in shares.values()],
    ]
    return [float(x) for x in values]


def basic_statistics(df: DataFrame, text: str, common_words: DataFrame, keep: list[str]) -> DataFrame:
    """The plain statistics of every text with built-in expressions only: no Python, no shuffle.

    Words are runs of letters of any script, lower-cased; the common words are a fixed table (its size is checked) kept in
    one literal of BUCKETS lists by hash, so that a word is compared with a few others, however many there are. Null texts
    give no row, blank ones statistics of 0.
    """
    bucket = lambda c: F.pmod(F.hash(c), F.lit(BUCKETS))
    listed = [(r[0], r[1]) for r in common_words.where(F.col("word").isNotNull()).select(F.lower("word").alias("w")).distinct().select("w", bucket(F.col("w"))).limit(MOST_COMMON + 1).collect()]
    if len(listed) > MOST_COMMON:
        raise ValueError(f"more than {MOST_COMMON} common words")
    t = F.col(text)
    words: Column = F.regexp_extract_all(F.lower(t), F.lit("(\\p{L}+)"), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    table = F.array(*[F.array(*[F.lit(w) for w, b in sorted(listed) if b == k]).cast("array<string>") for k in range(BUCKETS)])
    packed = df.where(t.isNotNull()).select(*keep, t.alias("_t"), words.alias("_w"), lines.alias("_l"))
    n_chars, n_words, n_lines = F.length("_t").cast("bigint"), F.size("_w").cast("bigint"), F.size("_l").cast("bigint")
    letters = F.length(F.array_join("_w", ""))
    symbols = F.length(F.regexp_replace("_t", r"[\p{L}\p{N}\s]", ""))
    ends = F.size(F.filter("_l", lambda x: F.trim(x).rlike(r"[.!?:;]$")))
    common = F.size(F.filter("_w", lambda x: F.array_contains(F.get(table, bucket(x)), x)))
    return packed.select(
        *keep,
        n_chars.alias("n_chars_real"),
        n_words.alias("n_words"),
        n_lines.alias("n_lines"),
        share(letters, n_words).alias("mean_word_length"),
        share(symbols, n_chars).alias("symbol_ratio"),
        share(ends, n_lines).alias("punctuated_lines"),
        share(common, n_words).alias("common_word_share"),
    )
