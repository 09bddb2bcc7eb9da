"""What a typed name and an e-mail address say about who wrote it."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

_TITLE = re.compile(r"\b(?:dr|prof|mr|mrs|ms|miss|sir|ing|dipl|msc|bsc|phd|mba|md|jr|sr|ii|iii|esq|herr|frau)\b\.?", re.I)
_ASIDE = re.compile(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}")
_MOJIBAKE = re.compile("[ÃÂÄÅ][\u0080-¿Œ-Ÿ–-™]|Ã")
_ORG = frozenset("systems system sys ltd inc gmbh llc corp group team tm dept department sec security release rel tooling tools infra infrastructure plat platform quality qa ops docs".split())
#: How roles of teams are written.
_ROLES = {"sec": "security", "security": "security", "rel": "release", "release": "release", "releases": "release", "tooling": "tooling", "tools": "tooling", "tool": "tooling", "infra": "infrastructure", "infrastructure": "infrastructure", "plat": "platform", "platform": "platform", "quality": "quality", "qa": "quality", "ops": "operations", "operations": "operations", "docs": "documentation", "documentation": "documentation", "support": "support", "data": "data", "build": "build", "design": "design", "mobile": "mobile", "web": "web"}
#: Words of automatic accounts, in the local part or the host of a mail; endings of names of single machines.
_AUTOMATIC = frozenset("bot bots robot ci cron runner daemon automation".split())
_MACHINES = frozenset("invalid local localdomain localhost lan home internal".split())
_NOBODY = frozenset("unknown root user admin nobody none null author anonymous me test dev developer git github ubuntu na".split())


def fold(s: str) -> str:
    """Lower case without accents; mended where UTF-8 was read as Latin-1."""
    if _MOJIBAKE.search(s):
        for wrong in ("cp1252", "latin-1"):
            try:
                s = s.encode(wrong).decode("utf-8")
                break
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    s = s.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("ı", "i").replace("đ", "d")
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Mn", "Cf"))
    return s.lower()


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swapped neighbours as one, in a band of `most` around the diagonal; most + 1 where it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    older, old = None, {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            d = min(old.get(j, far) + 1, now.get(j - 1, far) + 1, old.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if older is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, older.get(j - 2, far) + 1)
            now[j] = min(d, far)
        if min(now.values()) > most:
            return far
        older, old = old, now
    return min(old.get(len(b), far), far)


def _thin(s: str) -> str:
    return s.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def near(a: str, b: str) -> bool:
    """Misspelt, not another word: one edit, umlauts written with an e apart."""
    return distance(a, b, 1) <= 1 or distance(_thin(a), _thin(b), 1) <= 1


def shortens(a: str, x: str) -> bool:
    """a may be a short form of x by its letters: Steffi and Stephanie, Tim and Timothy."""
    stem = re.sub(r"(?:ie|y|i|a|o|s)$", "", a)
    return len(stem) >= 2 and len(a) < len(x) and x.startswith(stem[:3])


@dataclass
class Mail:
    """What a mail says: `key` the mailbox, `pair` two name parts, `token` one word; team mailboxes, `role` one that may be a team's or a machine's."""

    key: str = ""
    pair: tuple[str, str] | None = None
    token: str = ""
    team: str = ""
    role: str = ""
    bot: bool = False


def read_mail(email: str) -> Mail:
    e = email.strip().lower()
    if "@" not in e:
        return Mail()
    local, _, domain = e.rpartition("@")
    if re.match(r"^\d+\+", local):
        local = local.split("+", 1)[1]
    if "[bot]" in local:
        return Mail(key=e, bot=True)
    local = local.split("+")[0]
    mail = Mail(key=f"{local}@{domain}")
    labels = domain.split(".")
    parts = [fold(x) for x in re.split(r"[._-]+", re.sub(r"\d+$", "", local)) if x]
    if _AUTOMATIC & {*parts, *labels}:
        mail.bot = True
        return mail
    roles = [x for x in parts if x in _ROLES]
    if roles and "noreply" not in domain:
        rest = [x for x in parts if x not in _ROLES and x != "team"]
        team = f"{rest[0] if rest else fold(labels[0])}:{_ROLES[roles[0]]}"
        if rest or "team" in parts:
            mail.team = team
        else:
            mail.role = team
        return mail
    if parts and (len(labels) == 1 or labels[-1] in _MACHINES):
        owner = fold(labels[0].split("-")[0])
        mail.pair = (parts[0], owner) if len(parts[0]) >= 2 and len(owner) >= 2 else None
    elif len(parts) == 2 and all(len(x) >= 2 for x in parts):
        mail.pair = (parts[0], parts[1])
    elif len(parts) == 2:
        mail.token = "".join(sorted(parts, key=len))  # initial and family name
    elif len(parts) == 1:
        mail.token = parts[0]
    return mail


@dataclass
class Reading:
    """kind: full (a, b are a full name's parts; with support 2 the mail spells both alike, with 1 `sure` is the part it spells alike), hint, team or bot."""

    kind: str
    a: str = ""
    b: str = ""
    support: int = 0
    sure: str = ""
    given: str = ""
    initial: str = ""
    family: str = ""
    team: str = ""


def _words(name: str) -> tuple[list[str], list[str]]:
    """Long words and initials of a typed name, in its order."""
    s = _TITLE.sub(" ", _ASIDE.sub(" ", name.replace(" ", " ")))
    parts = [x for x in re.split(r"[\s,;.]+", s) if x]
    words, initials = [], []
    for p in parts:
        w = re.sub(r"[^a-z'’-]", "", fold(p)).strip("'-’")
        if len(w) == 1 or (len(parts) == 1 and len(p) <= 3 and p.isupper()):
            initials += list(w)
        elif w:
            words.append(w)
    return words, initials


def confirmed(a: str, b: str, mail: Mail, formal: dict[str, tuple[str, ...]]) -> tuple[str, str, int]:
    """A full name's parts, short forms written out where the mail holds the same name (support 2), its initial and family (1), or neither (0).

    A mail only confirms: a name that it spells otherwise is left as typed, for the segment join to link.
    """
    forms = lambda w: (w, *formal.get(w, ()))
    if mail.pair:
        for x, y in (mail.pair, mail.pair[::-1]):
            if (x in forms(a) or shortens(a, x)) and y == b or (y in forms(b) or shortens(b, y)) and x == a:
                return x, y, 2
    t = mail.token
    if t:
        for given, family in ((a, b), (b, a)):
            for g in forms(given):
                if t == g + family or t == family + g:
                    return g, family, 2
                if t.endswith(family) and len(t) - len(family) > 1 and shortens(g, t[: -len(family)]):
                    return t[: -len(family)], family, 2
        for given, family in ((a, b), (b, a)):
            for g in forms(given):
                if t == g[0] + family:
                    return g, family, 1
    return a, b, 0


def within(short: str, full: str) -> bool:
    """The letters of short come in this order in full: Tony and Anthony."""
    rest = iter(full)
    return all(c in rest for c in short)


def unlisted_form(name: str, email: str, formal: dict[str, tuple[str, ...]]) -> tuple[str, str, str] | None:
    """(short, full, family) where a mail holds the name's one part as it is and, for the other, a longer name, no misspelling, that no table relates to it."""
    words, _ = _words(name)
    mail = read_mail(email)
    if len(words) < 2 or mail.team or mail.bot or confirmed(words[0], words[-1], mail, formal)[2]:
        return None
    for short, family in ((words[0], words[-1]), (words[-1], words[0])):
        full = ""
        if mail.pair and family in mail.pair:
            full = mail.pair[0] if mail.pair[1] == family else mail.pair[1]
        elif mail.token.endswith(family):
            full = mail.token[: -len(family)]
        if len(full) > len(short) >= 2 and full not in formal.get(short, ()) and not near(short, full):
            return short, full, family
    return None


@lru_cache(maxsize=100_000)
def _organisational(w: str) -> bool:
    return w in _ORG or len(w) >= 6 and any(len(o) >= 6 and near(w, o) for o in _ORG)


def read_identity(name: str, email: str, formal: dict[str, tuple[str, ...]]) -> Reading:
    mail = read_mail(email)
    words, initials = _words(name)
    role = next((_ROLES[w] for w in words if w in _ROLES), "")
    if mail.bot or "[bot]" in name.lower():
        return Reading("bot", team="bot:" + (re.sub(r"\W", "", fold(_ASIDE.sub("", name))) or mail.key.split("@")[0]))
    organised = [w for w in words if _organisational(w)]
    if (mail.team and organised) or (role and len(organised) >= 1 and len(words) >= 2 and (not mail.pair)):
        org = next((w for w in words if not _organisational(w) and w not in _ROLES), "")
        return Reading("team", team=mail.team or mail.role or f"{org}:{role}", support=2 * bool(mail.team or mail.role))
    if not words and mail.team:
        return Reading("team", team=mail.team, support=2)
    if len(words) >= 2 and not ("." in name and " " not in name.strip() and not name.strip()):
        # The first and the last long word; "Family, Given" has the same two.
        a, b, support = confirmed(words[0], words[-1], mail, formal)
        return Reading("full", a, b, support, b if support == 1 else "")
    hint = Reading("hint", team=mail.role if not words else "")
    word = words[0] if words and words[0] not in _NOBODY else ""
    if word and initials:
        hint.initial, hint.family, hint.given = initials[0], word, word  # "E. Family" or "Given F."
    elif word:
        hint.given = word
    elif initials:
        hint.initial = initials[0]
    if mail.pair:
        # The mail carries the full name; what is hinted at must not contradict it.
        x, y = mail.pair
        hint.a, hint.b, hint.support = x, y, 2
        return Reading("full", x, y, 2)
    t = mail.token
    if t and word:
        for g in (word, *formal.get(word, ())):
            if t.startswith(g) and len(t) - len(g) >= 3:
                return Reading("full", g, t[len(g) :], 2)
            if t.endswith(g) and len(t) - len(g) >= 3:
                return Reading("full", t[: -len(g)], g, 2)
            # "Given F." with the initial and family name in the mail
            if t[0] == g[0] and (not initials or t[1] == initials[0]) and not t[1:] == word and not near(t[1:], word) and not near(t, word) and len(t) >= 4:
                return Reading("full", g, t[1:], 1, t[1:])
    return hint
