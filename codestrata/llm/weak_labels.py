"""Weak labels of texts: a hand-written reading of each line, from which only clear cases are taken.

The labels train the classifier and are never part of what it sees: its statistics know nothing of these rules.
"""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\W\d_]+")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\w{3} +\d+ \d\d:\d\d:\d\d|(?:DEBUG|INFO|WARN|ERROR|TRACE|FATAL)\b)")
_TRACE = re.compile(r"^\s*(?:at \S+\(.*\)|File \".*\", line \d+|Traceback \(|\.\.\. \d+ more|Caused by:)")
_HEX = re.compile(r"^\s*(?:[0-9a-fA-F]{6,}:?\s+)?(?:[0-9a-fA-F]{2,4}\s+){6,}")
_DAMAGED = re.compile("[\ufffd\x00-\x08\x0b\x0c\x0e-\x1f\x80-\x9f]|Ã.|Â.|â‚¬|â€|ï¿½")
_CODE = re.compile(r"[{}\[\]();=<>^~$%#@\\!*+|`]")
_PAGE = re.compile(
    r"skip to content|back to top|cookies?\b|all rights reserved|©|sign ?in|log ?in|sign up|subscribe|toggle menu|copy link|tweet|\blikes?\b|loading\.\.\.|previous \| next|home \||read more|privacy policy|terms of (?:use|service)|newsletter|menu\b",
    re.I,
)
_BULLET = re.compile(r"^\s*(?:[-*•·–—+o▪‣]|\[[ xX]\]|\(?\d{1,4}[.):]|\(?[A-Za-z][.)]|v?\d+(?:\.\d+)+\s*$|#+ )(?:\s|$)")
_LEADERS = re.compile(r"(?:\.{4,}|(?:\. ){4,}|_{4,})\s*\d*\s*$")
_RULE = re.compile(r"^[\s|+:=_-]{4,}$")
_CELLS = re.compile(r"</?t[dhr]\b|</?table\b", re.I)
_GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
_END = tuple(".!?:;…\"'»”)")
_NOISE = re.compile(r"[^\w\s.,!?'\"-]")

LINE_KINDS = ("prose", "list", "table", "junk", "other")
FORMS = LINE_KINDS[:4]


def line_kind(line: str, words: list[str], common: int) -> int:
    """Index into LINE_KINDS of a line that isn't blank."""
    s = line.strip()
    n, w = len(s), len(words)
    damaged = sum(len(m) for m in _DAMAGED.findall(s))
    if damaged > 0.06 * n:
        return 3
    tokens = s.split()
    if len(tokens) >= 8 and sum(len(t) == 1 for t in tokens) > 0.7 * len(tokens) and "|" not in s:
        return 3
    if _LOG.match(s) or _TRACE.match(s) or _HEX.match(s + " "):
        return 3
    share = common / w if w else 0.0
    if n > 12 and len(_NOISE.findall(s)) > 0.3 * len(s.replace(" ", "")) and w and share < 0.1 and not _RULE.match(s) and not _CELLS.search(s) and s.count("|") < 0.6 * len(_NOISE.findall(s)) and not _BULLET.match(s) and "](" not in s and not s.endswith("\\\\"):
        return 3
    if max(map(len, tokens)) >= 40 and not _RULE.match(s) and not _LEADERS.search(s) and share < 0.15 and "," not in s and ";" not in s and "\t" not in s and "|" not in s and not _CELLS.search(s) and "](" not in s:
        return 3
    if w <= 7 and n < 60 and _PAGE.search(s) and (share < 0.2 or not s.endswith((".", "?", "!", ",")) or s.endswith("...")):
        return 3
    if _CELLS.search(s):
        return 2
    if _RULE.match(s):
        return 2 if "|" in s or "+" in s else 3 if n >= 20 else 4
    cells = max(s.count("|"), s.count("\t"), s.count(";") if "; " not in s else 0, len(re.findall(r",(?=\S)", s)), s.count(" & ") if s.endswith("\\\\") else 0)
    gaps = len(_GAPS.findall(s))
    pair = cells == 1 and " " not in s and (s.count(",") == 1 or s.count(";") == 1) and not s.endswith((",", ";"))
    if share < 0.2 and (cells >= 2 or pair or s.endswith("\\\\") and cells or s.count("\t")) and len(_CODE.findall(s)) - s.count("|") - s.count(";") - 2 * s.endswith("\\\\") < 0.15 * n:
        return 2
    chunks = s.split(", ")
    if len(chunks) >= 6 and w <= 2.6 * len(chunks) and common <= 0.35 * w:
        return 1
    if share < 0.2 and gaps >= 1 and not _BULLET.match(s) and not _LEADERS.search(s):
        return 2
    if _LEADERS.search(s) and share < 0.3:
        return 1
    symbols = len(_CODE.findall(s))
    if symbols > 0.14 * n and share < 0.2 and not _BULLET.match(s) and "](" not in s and n > 12:
        return 3
    if w >= 12 and common == 0 and len(set(words)) < 0.5 * w and "," not in s:
        return 3
    if share >= 0.2 and w >= 5 or share >= 0.12 and w >= 9 or (w >= 3 and common >= 1 and s.endswith(_END) and not _BULLET.match(s)):
        return 0
    if _BULLET.match(s) or s.count(", ") >= 5 and share < 0.12 or (w <= 8 and share < 0.34) or "](" in s:
        return 1
    return 4


def weak_label(text: str, common_words: frozenset[str], least_margin: float = 0.35) -> tuple[int, float] | None:
    """(index into FORMS, weight) of a text whose lines are clearly of one form; None for the others, which aren't trained on."""
    chars = dict.fromkeys(LINE_KINDS, 0)
    seen: Counter[str] = Counter()
    vocabulary: Counter[str] = Counter()
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not lines:
        return None
    for s in lines:
        words = WORD.findall(s.lower())
        kind = line_kind(s, words, sum(x in common_words for x in words))
        chars[LINE_KINDS[kind]] += sum(map(len, s.split()))
        seen[s] += 1
        vocabulary.update(words)
    total = sum(chars.values())
    share = {k: v / total for k, v in chars.items()}
    junk = share["junk"]
    # A few lines or words over and over are repetition, whatever they look like one by one.
    repeated = sum(v * len(k) for k, v in seen.items() if v >= 3) / sum(map(len, lines))
    if repeated > 0.5 and len(seen) < 0.35 * len(lines) and len(lines) >= 4:
        junk = max(junk, repeated)
    n_words = vocabulary.total()
    if 30 <= n_words < 400 and len(vocabulary) < 0.12 * n_words and share["table"] < 0.5:
        junk = max(junk, 0.8)
    rest = 1 - max(0.0, min(1.0, junk - share["junk"]))
    scores = [share["prose"] * rest, (share["list"] + 0.5 * share["other"]) * rest, share["table"] * rest, junk]
    order = sorted(scores)
    label = scores.index(order[-1]) if scores[0] <= 0.5 else 0
    margin = order[-1] - order[-2]
    return (label, 0.3 + margin) if margin >= least_margin else None
