"""Variant spellings of names typed by people, linked by a pigeonhole segment join.

Every identity is read by itself first: its name's parts as typed are a key, its mail says whether it spells them alike.
All links between keys that are spelt differently come from one join: a name within k edits of another leaves one of
k + 1 segments of it as it is, at a place shifted by k at most. The segments of all keys (and of the names that mails
hold) make an inverted index, position-shifted substrings are looked up in it, hits are verified by a banded edit
distance of both parts. A segment that many names share is looked up together with a segment of what remains of the
name. Mails only confirm: they say which of two spellings is the person's, and which of several similar names is meant.
Names that are only hinted at are looked up by their mail, then by initial and family name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.names import _thin, distance, fold, near, read_identity, read_mail, unlisted_form, within
from codestrata.session import cut, spread

_READ = (
    "name string, email string, n bigint, identity string, kind string, key string, p string, q string, support int, sure string, mail string, mail_key string, "
    "mail_p string, mail_q string, token string, role string, given string, initial string, family string"
)
#: A segment in the index of more names than this is looked up together with a second one.
HEAVY = 32
#: Most given names of the table (checked).
MOST_FORMS = 20_000


def edits_of(length: int) -> int:
    """Edits (a swap of neighbours is two) within which a name of so many letters is looked for."""
    return 2 if length < 14 else 3


def _ends(length: int, k: int) -> list[int]:
    return [length * i // (k + 1) for i in range(k + 2)]


def segments(s: str, k: int) -> list[tuple[int, str]]:
    """k + 1 even segments of s with their starts."""
    ends = _ends(len(s), k)
    return [(ends[i], s[ends[i] : ends[i + 1]]) for i in range(k + 1)]


def probes(s: str, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, end) of the substrings of s that are looked up among names of `length`, not longer than s.

    The i-th segment is shifted by the difference of edits before it, of which some alignment has at most i, and at most
    k - i after it: of all shifted places only these have to be looked at.
    """
    ends, more = _ends(length, k), len(s) - length
    for i in range(k + 1):
        at, size = ends[i], ends[i + 1] - ends[i]
        for start in range(max(0, at - i, at + more - (k - i)), min(len(s) - size, at + i, at + more + (k - i)) + 1):
            yield i, start, start + size


def spellings(p: str, q: str) -> set[str]:
    """What a key is indexed as: its parts in order, and so with umlauts written with an e read as without."""
    return {f"{p} {q}", " ".join(sorted((_thin(p), _thin(q))))}


def same_name(p: str, q: str, x: str, y: str) -> tuple[int, list[str]] | None:
    """Edits between two names and the parts of the first that they change; None for different names.

    Each part may have one misspelling, both only where they are long; parts of one or two letters must be the same.
    """
    best = None
    for a, b in ((x, y), (y, x)):
        changed = [(u, v) for u, v in ((p, a), (q, b)) if u != v]
        if all(min(len(u), len(v)) >= (3 if len(changed) == 1 else 5) and near(u, v) for u, v in changed):
            edits = sum(max(1, distance(u, v, 2)) for u, v in changed)
            if best is None or edits < best[0]:
                best = (edits, [u for u, _ in changed])
    return best


def _reader(formal: dict[str, tuple[str, ...]]):
    def key_of(a: str, b: str) -> tuple[str, str]:
        # Which of the two is the given name isn't known: short forms are written out where there is one full form only.
        full = sorted(formal[w][0] if len(formal.get(w, ())) == 1 else w for w in (a, b))
        return full[0], full[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, email, n in zip(pdf["name"], pdf["email"], pdf["n"]):
                r, mail = read_identity(name, email, formal), read_mail(email)
                p = q = key = mail_key = x = y = None
                if r.kind == "full":
                    p, q = key_of(r.a, r.b)
                    key = f"{p} {q}"
                elif r.kind == "team":
                    p, _, q = r.team.partition(":")
                    key = f"team:{r.team}"
                elif r.kind == "bot":
                    key = f"bot:{r.team}"
                if mail.pair:
                    x, y = key_of(*mail.pair)
                    mail_key = f"{x} {y}"
                rows.append((name, email, n, f"{name} <{email}>", r.kind, key, p, q, r.support, r.sure or None, mail.key or None, mail_key, x, y, mail.token or None, r.team if r.kind == "hint" and r.team else None, r.given or None, r.initial or None, r.family or None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _READ.split(", ")])

    return run


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, key, p, q in zip(pdf["kind"], pdf["key"], pdf["p"], pdf["q"]):
            for s in spellings(p, q):
                rows += [(f"{kind}|{len(s)}|{i}|{text}", key, s, at) for i, (at, text) in enumerate(segments(s, edits_of(len(s))))]
        yield pd.DataFrame(rows, columns=["segment", "to", "to_s", "at"])


def _lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for kind, key, p, q in zip(pdf["kind"], pdf["key"], pdf["p"], pdf["q"]):
            # A misspelt first letter may change the order of the parts.
            for s in {t for a, b in ((p, q), (q, p)) for t in (f"{a} {b}", f"{_thin(a)} {_thin(b)}")}:
                for length in range(max(3, len(s) - 3), len(s) + 1):
                    k = edits_of(length)
                    if len(s) - length <= k:
                        rows += [(f"{kind}|{length}|{i}|{s[lo:hi]}", key, s, lo) for i, lo, hi in probes(s, length, k)]
        yield pd.DataFrame(rows, columns=["segment", "key", "s", "at"])


def _rest(segment: str, s: str, at: int) -> tuple[str, int, int]:
    """What remains of s without the segment at its place, how long the indexed name's remainder is, and the edits."""
    _, length, _, text = segment.split("|", 3)
    return s[:at] + s[at + len(text) :], int(length) - len(text), edits_of(int(length))


def _index_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for segment, to, s, at in zip(pdf["segment"], pdf["to"], pdf["to_s"], pdf["at"]):
            rest, _, k = _rest(segment, s, at)
            rows += [(f"{segment}|{j}|{text}", to, s) for j, (_, text) in enumerate(segments(rest, k))]
        yield pd.DataFrame(rows, columns=["segment", "to", "to_s"])


def _lookup_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for segment, key, s, at in zip(pdf["segment"], pdf["key"], pdf["s"], pdf["at"]):
            rest, length, k = _rest(segment, s, at)
            rows += [(f"{segment}|{j}|{rest[lo:hi]}", key, s) for j, lo, hi in probes(rest, length, k)]
        yield pd.DataFrame(rows, columns=["segment", "key", "s"])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, t, s[0], s[1]) for k, t, p, q, x, y in zip(pdf["key"], pdf["to"], pdf["p"], pdf["q"], pdf["to_p"], pdf["to_q"]) if (s := same_name(p, q, x, y))]
        yield pd.DataFrame(rows, columns=["key", "to", "edits", "changed"])


def similar_names(keys: DataFrame) -> DataFrame:
    """keys(kind, key, p, q) -> (key, to, edits, changed), both ways, of all different keys of a kind that are the same name misspelt.

    No pair of names is formed but of those that share a segment; a segment in the index of more than HEAVY names is
    split by the segments of the names' rests, by the same argument, so that a common given name joins nobody. Hits are
    verified by the edit distance of the whole names in a band of the most edits, then part by part.
    """
    names = cut(spread(keys.select("kind", "key", "p", "q")))
    index = cut(names.mapInPandas(_index, "segment string, to string, to_s string, at int"))
    heavy = cut(index.groupBy("segment").agg(F.count("*").alias("_n")).where(F.col("_n") > HEAVY).select("segment"))
    wanted = cut(names.mapInPandas(_lookups, "segment string, key string, s string, at int"))
    banded = (F.col("key") != F.col("to")) & (F.levenshtein("s", "to_s", 3) >= 0)
    light = wanted.join(index.join(heavy, "segment", "left_anti").drop("at"), "segment").where(banded).select("key", "to")
    index2 = index.join(heavy, "segment", "left_semi").mapInPandas(_index_rest, "segment string, to string, to_s string")
    wanted2 = wanted.join(heavy, "segment", "left_semi").mapInPandas(_lookup_rest, "segment string, key string, s string")
    split = wanted2.join(index2, "segment").where(banded).select("key", "to")
    hits = cut(light.unionByName(split).distinct())
    parts = keys.select(F.col("key").alias("to"), F.col("p").alias("to_p"), F.col("q").alias("to_q"))
    one_way = hits.join(keys.select("key", "p", "q"), "key").join(parts, "to")
    # Names are looked up among shorter ones: the same pairs the other way round.
    back = one_way.select(F.col("to").alias("key"), F.col("key").alias("to"), F.col("to_p").alias("p"), F.col("to_q").alias("q"), F.col("p").alias("to_p"), F.col("q").alias("to_q"))
    return one_way.unionByName(back).dropDuplicates(["key", "to"]).mapInPandas(_verify, "key string, to string, edits int, changed array<string>")


def link_variants(commits: DataFrame, given_names: DataFrame, name_col: str = "author_name", email_col: str = "author_email") -> DataFrame:
    """(identity, name, email, person) of every distinct identity; those of one person or team share `person`.

    Null names and mails are read as empty, the wholly empty identity is none; repeated rows count once; other columns
    are left out. A hint that fits several persons is a person of its own. given_names (given, short_form) is a small
    fixed table whose size is checked; short forms that it lacks are learnt, any number of them.
    """
    listed = given_names.select(F.lower("given"), F.lower("short_form")).where(F.col("given").isNotNull() & F.col("short_form").isNotNull()).distinct().limit(MOST_FORMS + 1).collect()
    if len(listed) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} short forms")
    formal: dict[str, tuple[str, ...]] = {}
    for given, short in sorted({(fold(r[0]), fold(r[1])) for r in listed}):
        formal[short] = (*formal.get(short, ()), given)
    spark = commits.sparkSession
    table = spark.createDataFrame([(s, g) for s, full in formal.items() for g in full], "short string, formal string")
    typed = commits.groupBy(F.coalesce(name_col, F.lit("")).alias("name"), F.coalesce(email_col, F.lit("")).alias("email")).agg(F.count("*").alias("n"))
    read = cut(spread(typed.where((F.col("name") != "") | (F.col("email") != ""))).mapInPandas(_reader(formal), _READ))
    full = read.where(F.col("kind").isin("full", "team"))
    learned = cut(_learned_forms(read, formal))
    forms = table.withColumn("known", F.lit(True)).unionByName(learned.withColumn("known", F.lit(False)))
    spelt_by_mails = full.where(F.col("mail_key").isNotNull()).select(F.lit("full").alias("kind"), F.col("mail_key").alias("key"), F.col("mail_p").alias("p"), F.col("mail_q").alias("q"), F.lit(2).alias("support"), F.lit(None).cast("string").alias("sure"), F.lit(0).cast("bigint").alias("n"))
    own = full.select("kind", "key", "p", "q", "support", "sure", "n")
    keys = cut(own.unionByName(spelt_by_mails).groupBy("kind", "key", "p", "q").agg(F.max("support").alias("support"), F.max("sure").alias("sure"), F.sum("n").alias("n")))
    links = cut(similar_names(keys).unionByName(_short_links(keys, full, forms)))
    persons = cut(_persons(full, keys, links))
    people = persons.where(F.col("kind") == "full").drop("kind")
    bots = read.where(F.col("kind") == "bot").select("identity", "name", "email", F.col("key").alias("person"))
    hints = read.where(F.col("kind") == "hint")
    return persons.select("identity", "name", "email", "person").unionByName(bots).unionByName(_resolve_hints(hints, people, forms.select("short", "formal").distinct()))


def _learned_forms(read: DataFrame, formal: dict[str, tuple[str, ...]]) -> DataFrame:
    """(short, formal): short forms that the table lacks, as names and mails use them.

    A short form is typed by people of several families whose mails hold the full one (or has its letters in order), and
    is never found in a mail itself; a word that some mail confirms as a name of its own is another name, even with one
    mailbox.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*x, within(x[0], x[1])) for n, e in zip(pdf["name"], pdf["email"]) if (x := unlisted_form(n, e, formal))]
            yield pd.DataFrame(rows, columns=["short", "formal", "family", "inside"])

    own = read.where((F.col("kind") == "full") & (F.col("support") == 2))
    names = own.select(F.col("p").alias("short")).union(own.select("q")).distinct()
    found = read.select("name", "email").mapInPandas(run, "short string, formal string, family string, inside boolean").groupBy("short", "formal").agg(F.count_distinct("family").alias("_n"), F.max("inside").alias("_inside"))
    return found.where((F.col("_n") >= 2) | F.col("_inside")).join(names, "short", "left_anti").select("short", "formal")


def _short_links(keys: DataFrame, full: DataFrame, forms: DataFrame) -> DataFrame:
    """Links (key, to, edits 0, changed) from a name with a short form to the same name with the full one."""
    sorted_key = lambda a, b: F.concat_ws(" ", F.least(a, b), F.greatest(a, b))
    people = keys.where(F.col("kind") == "full")
    sides = F.explode(F.array(F.struct(F.col("p").alias("part"), F.col("q").alias("other")), F.struct(F.col("q").alias("part"), F.col("p").alias("other"))))
    each = people.select("key", sides.alias("s")).select("key", F.col("s.part").alias("part"), F.col("s.other").alias("other"))
    there = people.select(F.col("key").alias("to"))
    by_form = each.join(forms, F.col("part") == F.col("short")).select("key", "part", "known", sorted_key(F.col("formal"), F.col("other")).alias("to")).join(there, "to").where(F.col("key") != F.col("to"))
    # A short form of several full ones stands for one only where a single one of them is somebody's name.
    alone = by_form.groupBy("key").agg(F.min("to").alias("to"), F.max("to").alias("_last"), F.min("part").alias("part")).where(F.col("to") == F.col("_last")).select("key", "to", "part")
    # Short forms that no table lists: one mailbox, one part the same, the other a short form by its letters.
    stem = F.regexp_replace("part", r"(?:ie|y|i|a|o|s)$", "")
    boxes = full.where((F.col("kind") == "full") & F.col("mail").isNotNull()).select("mail", "key", "p", "q").distinct()
    in_box = boxes.select("mail", "key", sides.alias("s")).select("mail", "key", F.col("s.other").alias("same"), F.col("s.part").alias("part"))
    # The first two letters are the same, so a shared mailbox joins only names that begin alike.
    a = in_box.where(F.length("part") <= 6).withColumn("_start", F.left(stem, F.lit(2)))
    b = in_box.select("mail", "same", F.left("part", F.lit(2)).alias("_start"), F.col("key").alias("to"), F.col("part").alias("to_part"))
    by_box = a.join(b, ["mail", "same", "_start"]).where((F.col("key") != F.col("to")) & (F.length("part") + 2 <= F.length("to_part")) & (F.length(stem) >= 2) & F.col("to_part").startswith(F.left(stem, F.lit(3))))
    found = alone.unionByName(by_box.select("key", "to", "part"))
    return found.groupBy("key", "to").agg(F.min("part").alias("part")).select("key", "to", F.lit(0).alias("edits"), F.array("part").alias("changed"))


def _persons(full: DataFrame, keys: DataFrame, links: DataFrame) -> DataFrame:
    """(identity, name, email, kind, mail, person): the name that an identity's own mail confirms or its key, followed to the best spelling."""
    of = keys.select("key", "support", "sure", "n")
    to = keys.select(F.col("key").alias("to"), F.col("support").alias("to_support"), F.col("n").alias("to_n"), F.col("p").alias("to_p"), F.col("q").alias("to_q"))
    rated = cut(links.join(of, "key").join(to, "to"))
    # The own mail says which of the similar names is meant.
    first = lambda c: F.left(c, F.lit(1))
    token = F.col("token").isin(F.concat("to_p", "to_q"), F.concat("to_q", "to_p"), F.concat(first("to_p"), "to_q"), F.concat(first("to_q"), "to_p"))
    meant = full.where(F.col("support") < 2).select("identity", "key", "mail_key", "token").join(rated, "key").where(F.coalesce(F.col("mail_key") == F.col("to"), F.lit(False)) | F.coalesce(token, F.lit(False)))
    meant = meant.groupBy("identity").agg(F.min(F.struct("edits", (-F.col("to_support")).alias("s"), (-F.col("to_n")).alias("c"), "to")).alias("b")).select("identity", F.col("b.to").alias("_meant"))
    # Otherwise a spelling that no mail confirms stands for the best similar one; a part that its mail spells alike isn't misspelt.
    misspelt = (F.col("support") < 2) & ~F.coalesce(F.array_contains("changed", F.col("sure")), F.lit(False))
    more = (F.col("to_support") > F.col("support")) | ((F.col("to_support") == F.col("support")) & ((F.col("to_n") > F.col("n")) | ((F.col("to_n") == F.col("n")) & (F.col("to") < F.col("key")))))
    better = rated.where((F.col("edits") == 0) | (misspelt & more))
    chosen = cut(better.groupBy("key").agg(F.min(F.struct("edits", (-F.col("to_support")).alias("s"), (-F.col("to_n")).alias("c"), "to")).alias("b")).select("key", F.col("b.to").alias("to")))
    ends = _follow(chosen)
    named = full.join(meant, "identity", "left").withColumn("_at", F.coalesce("_meant", "key"))
    return named.join(ends.select(F.col("key").alias("_at"), "person"), "_at", "left").select("identity", "name", "email", "kind", "mail", F.coalesce("person", "_at").alias("person"))


def _follow(chosen: DataFrame) -> DataFrame:
    """chosen(key, to), one row a key -> (key, person): the end of the chain from each key, or the least key of the ring it leads into.

    Pointer doubling: as many rounds as the longest chain has binary digits.
    """
    n = chosen.count()
    jump = chosen.select("key", F.col("to").alias("at"), F.col("to").alias("least"))
    for _ in range(max(1, math.ceil(math.log2(n + 1)) + 1)):
        step = jump.select(F.col("key").alias("at"), F.col("at").alias("_at"), F.col("least").alias("_least"))
        jump = cut(jump.join(step, "at", "left").select("key", F.coalesce("_at", "at").alias("at"), F.least("least", "_least").alias("least"), F.col("_at").isNotNull().alias("_moved")))
        if not jump.where("_moved").take(1):
            break
        jump = jump.drop("_moved")
    # After so many steps only rings still lead on; from one of their keys the least met is the ring's.
    ring = jump.select(F.col("key").alias("at"), F.col("least").alias("_ring"))
    return jump.join(ring, "at", "left").select("key", F.coalesce("_ring", "at").alias("person"))


def _resolve_hints(hints: DataFrame, persons: DataFrame, forms: DataFrame) -> DataFrame:
    """Hints by mailbox, then by the mail's initial and family name or whole name; else by the mail alone."""
    parts = F.split("person", " ")
    people = persons.select("person").distinct().select("person", parts[0].alias("p"), parts[1].alias("q"))
    first = lambda c: F.left(c, F.lit(1))
    logins = F.array_distinct(F.array(F.concat(first("p"), "q"), F.concat(first("q"), "p"), F.concat("p", "q"), F.concat("q", "p")))
    spelt = cut(people.select("person", "p", "q", F.explode(logins).alias("spelt")).distinct())
    # The persons of a mailbox.
    boxes = persons.join(hints.select("mail").where(F.col("mail").isNotNull()).distinct(), "mail", "left_semi").select("mail", "person").distinct().select("mail", "person", parts[0].alias("p"), parts[1].alias("q"))

    def fits(candidates: DataFrame) -> DataFrame:
        """Candidates (identity, given, initial, person, p, q, rank) that the typed word and initial don't contradict."""
        word, letter = F.coalesce("given", F.lit("")), F.coalesce("initial", F.lit(""))
        flag = lambda part: forms.select(F.col("short").alias("given"), F.col("formal").alias(part), F.lit(True).alias(f"_{part}"))
        c = candidates.join(flag("p"), ["given", "p"], "left").join(flag("q"), ["given", "q"], "left")
        near_part = lambda part: (F.levenshtein(word, F.col(part)) <= 2) & (F.length(word) >= 5)
        known: Column = (word == "") | word.isin(F.col("p"), F.col("q"), F.concat(first("p"), "q"), F.concat(first("q"), "p"), F.concat("p", "q"), F.concat("q", "p")) | F.coalesce("_p", F.lit(False)) | F.coalesce("_q", F.lit(False)) | near_part("p") | near_part("q")
        return c.where(known & ((letter == "") | (first("p") == letter) | (first("q") == letter))).select("identity", "person", "rank")

    asked = hints.select("identity", "mail", "token", "given", "initial", "family")
    row = lambda d, rank: d.select("identity", "given", "initial", "person", "p", "q", F.lit(rank).alias("rank"))
    by_box = row(asked.join(boxes, "mail"), 1)
    by_token = row(asked.join(spelt, F.col("token") == F.col("spelt")), 2)
    # A word without mail that is a login: initial and family name, or the whole name.
    by_word = row(asked.where(F.col("mail").isNull() & F.col("given").isNotNull() & F.col("initial").isNull()).join(spelt, F.col("given") == F.col("spelt")), 3)
    by_both = row(asked.where(F.col("initial").isNotNull() & F.col("family").isNotNull()).join(spelt, F.concat("initial", "family") == F.col("spelt")), 4)
    candidates = fits(by_box.unionByName(by_token)).unionByName(by_word.unionByName(by_both).select("identity", "person", "rank"))
    unique = candidates.groupBy("identity", "rank").agg(F.min("person").alias("person"), F.max("person").alias("_last")).where(F.col("person") == F.col("_last"))
    best = unique.groupBy("identity").agg(F.min(F.struct("rank", "person")).alias("b")).select("identity", F.col("b.person").alias("_found"))
    # A nameless role mailbox is a team's, unless persons write from it: then it is a machine's and says nothing.
    used = persons.select("mail").where(F.col("mail").isNotNull()).distinct().withColumn("_used", F.lit(True))
    # Unplaced hints in shared mailboxes (no token) aren't one person.
    alone = F.when(F.col("role").isNotNull() & F.col("_used").isNull(), F.concat(F.lit("team:"), "role")).when(F.length("token") >= 4, F.concat(F.lit("token:"), "token")).otherwise(F.concat(F.lit("identity:"), "identity"))
    return hints.join(best, "identity", "left").join(used, "mail", "left").select("identity", "name", "email", F.coalesce("_found", alone).alias("person"))


def identity_pairs(linked: DataFrame) -> DataFrame:
    """(identity_a, identity_b), a before b, of all identities of one person: the pairs that the problem asks for.

    As many as the square of a person's spellings; `link_variants` is the result with one row an identity.
    """
    a = linked.select("person", F.col("identity").alias("identity_a"))
    b = linked.select("person", F.col("identity").alias("identity_b"))
    return a.join(b, "person").where(F.col("identity_a") < F.col("identity_b")).select("identity_a", "identity_b").distinct()
