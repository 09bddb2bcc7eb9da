"""Git history: commit classes, contributors, expertise scores, file risk, expert tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import risk
from codestrata.functions.paths import compared_path, dirname

#: Words that class a commit message.
KEYWORDS = {
    "refactor": ["refactor", "restructure", "cleanup", "reorganize", "simplify", "extract", "rename", "move", "split", "merge", "consolidate"],
    "bug_fix": ["fix", "bug", "patch", "hotfix", "issue", "resolve", "repair", "correct", "handle", "error", "crash", "failure"],
    "architectural": ["architect", "design", "structure", "module", "interface", "api", "layer", "service", "component", "framework", "pattern", "abstraction"],
    "test": ["test", "spec", "unittest", "pytest", "coverage", "mock", "stub"],
    "documentation": ["doc", "readme", "comment", "docstring", "documentation", "explain"],
    "feature": ["add", "implement", "create", "new", "feature", "support"],
}
TEST_FILES = ["test_", "_test.", "spec_", "_spec.", "tests/", "__tests__/"]
#: Weights of the seven factors.
FACTORS = {"commit_frequency": 0.15, "lines_changed": 0.10, "refactor_depth": 0.25, "architectural_changes": 0.20, "bug_fixes": 0.15, "recency": 0.10, "code_review": 0.05}
HALF_LIFE_DAYS = 180


def _has(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def classify_commits(commits: DataFrame) -> DataFrame:
    """Commits with class_type and flags by substrings of the lower-cased message; is_test_change by the changed files."""
    text = F.lower(F.coalesce("message", F.lit("")))
    kind = F.when(_has(text, KEYWORDS["architectural"]), "architectural")
    for k in ("refactor", "bug_fix", "test", "documentation", "feature"):
        kind = kind.when(_has(text, KEYWORDS[k]), k)
    tests = F.exists(F.coalesce("files_changed", F.array().cast("array<string>")), lambda f: _has(F.lower(f), TEST_FILES))
    return commits.select(
        "*", kind.otherwise("unknown").alias("class_type"), _has(text, KEYWORDS["refactor"]).alias("says_refactor"), _has(text, KEYWORDS["bug_fix"]).alias("says_bug_fix"),
        _has(text, KEYWORDS["architectural"]).alias("says_architectural"), F.coalesce(tests, F.lit(False)).alias("is_test_change"),
    )


def distinct_commits(commits: DataFrame, columns: list[str]) -> DataFrame:
    """One row per hash: the one ingested last."""
    packed = F.struct("ingested_at", *[F.col(c) for c in columns if c not in ("ingested_at", "commit_hash")])
    return commits.where(F.col("commit_hash").isNotNull()).groupBy("commit_hash").agg(F.max(packed).alias("r")).select("commit_hash", *[F.col(f"r.{c}").alias(c) for c in columns if c not in ("commit_hash", "ingested_at")])


def commit_files(commits: DataFrame) -> DataFrame:
    """One row per commit and (compared) file it changed; commits without author are left out."""
    columns = ["author_email", "author_name", "ts", "lines_added", "lines_deleted", "is_refactor", "is_bug_fix", "is_architectural", "is_test", "reviewers", "files_changed"]
    files = F.explode(F.array_distinct(F.transform("files_changed", lambda f: compared_path(f))))
    c = distinct_commits(commits, columns).where(F.col("author_email").isNotNull())
    return c.select("commit_hash", F.col("author_email").alias("email"), F.col("author_name").alias("name"), "ts", (F.coalesce("lines_added", F.lit(0)) + F.coalesce("lines_deleted", F.lit(0))).alias("lines"),
                    *[F.coalesce(x, F.lit(False)).alias(x) for x in ("is_refactor", "is_bug_fix", "is_architectural", "is_test")], F.greatest(F.size("reviewers"), F.lit(0)).alias("reviews"), files.alias("file")).where(F.col("file").isNotNull())


def whole_days(a: Column, b: Column) -> Column:
    return F.floor((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86_400_000_000))


def checked_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Weights of the factors, those not named as by default; ValueError for unknown or negative ones and a sum other than 1."""
    w = {**FACTORS, **(weights or {})}
    if w.keys() != FACTORS.keys() or min(w.values()) < 0 or abs(sum(w.values()) - 1) > 1e-6:
        raise ValueError(f"weights of {sorted(FACTORS)} must not be negative and add up to 1")
    return w


def expertise_factors(changes: DataFrame, as_of: DataFrame | None = None, weights: dict[str, float] | None = None, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(file, email, commits, the seven factors, total, confidence): one pass over the changes, file totals from the pairs.

    `weights` changes the weight of factors by name, half_life the days after which a commit counts half. as_of has one row and column (default: the latest change). The table is aggregated to (file, email) map-side first; file
    totals are joined back, so a file with a third of all changes is never one task's.
    """
    flag = lambda c: F.sum(F.col(c).cast("int"))
    pairs = changes.groupBy("file", "email").agg(
        F.count("*").alias("n"), F.sum("lines").alias("l"), flag("is_refactor").alias("r"), F.sum(F.when(F.col("is_refactor"), F.col("lines")).otherwise(0)).alias("rl"),
        flag("is_architectural").alias("a"), flag("is_bug_fix").alias("b"), F.max("ts").alias("newest"), F.sum("reviews").alias("v"),
        F.max((~(F.col("is_refactor") | F.col("is_architectural") | F.col("is_bug_fix"))).cast("int")).alias("plain"),
    )
    totals = pairs.groupBy("file").agg(*[F.sum(x).alias(x.upper() + "_") for x in ("n", "l", "r", "rl", "a", "b")])
    at = as_of if as_of is not None else changes.agg(F.max("ts").alias("as_of"))
    p = pairs.join(totals, "file").join(F.broadcast(at))  # at: one row
    days = whole_days(F.col("as_of"), F.col("newest"))
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    one = F.lit(1.0)
    f = {
        "commit_frequency": F.least(one, 2 * ratio("n", "N_")),
        "lines_changed": F.least(one, 1.5 * F.sqrt(ratio("l", "L_"))),
        "refactor_depth": F.when(F.col("r") == 0, 0.0).otherwise(F.least(one, 0.4 * ratio("r", "R_") + 0.6 * ratio("rl", "RL_"))),
        "architectural_changes": F.least(one, 1.5 * ratio("a", "A_")),
        "bug_fixes": F.least(one, ratio("b", "B_")),
        "recency": F.greatest(F.lit(0.0), F.least(one, F.exp(-F.log(F.lit(2.0)) / half_life * days))),
        "code_review": F.when(F.col("v") > 0, F.least(one, F.col("v") / 10)).otherwise(0.5 * ratio("n", "N_")),
    }
    scored = p.select("file", "email", "n", "r", "a", "b", "plain", "newest", days.alias("days"), *[v.alias(k) for k, v in f.items()])
    total = F.lit(0.0)
    for k, w in checked_weights(weights).items():
        total = total + F.col(k) * w
    kinds = (F.col("r") > 0).cast("int") + (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int") + F.col("plain")
    confidence = F.least(one, F.greatest(F.lit(0.0), 0.5 * F.least(one, F.col("n") / 9) + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("days") / 365) + 0.2 * kinds / 4))
    return scored.select("file", "email", F.col("n").alias("commits"), "newest", *[F.round(k, 6).alias(k) for k in FACTORS], F.round(F.least(one, total), 6).alias("total"), F.round(confidence, 6).alias("confidence"))


def rank_experts(scores: DataFrame, k: int | None = None) -> DataFrame:
    """With `rank` on each file: total descending, then email. With k only the first k, cut before the shuffle."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.col("total").desc(), "email")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def recommend(scores: DataFrame) -> DataFrame:
    """(file, expert, total, secondary, bus_factor, reason): the first expert, the next three, experts of 0.6 and more."""
    top = rank_experts(scores, 4)
    bus = scores.groupBy("file").agg(F.count_if(F.col("total") >= 0.6).alias("bus_factor"))
    reason = (
        F.when(F.col("architectural_changes") > 0.5, "shaped the architecture").when(F.col("refactor_depth") > 0.5, "refactored it deeply").when(F.col("bug_fixes") > 0.5, "fixed many bugs")
        .when(F.col("recency") > 0.7, "worked on it recently").when(F.col("total") > 0.6, "primary expert").otherwise("knows it best")
    )
    second = top.where(F.col("rank") > 1).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "email"))), lambda x: x["email"]), ",").alias("secondary"))
    first = top.where(F.col("rank") == 1).select("file", F.col("email").alias("expert"), "total", reason.alias("reason"))
    return first.join(second, "file", "left").join(bus, "file").select("file", "expert", "total", F.coalesce("secondary", F.lit("")).alias("secondary"), "bus_factor", "reason")


def contributors(commits: DataFrame) -> DataFrame:
    """Per email: commits, first and last, and the name seen first."""
    c = distinct_commits(commits, ["author_email", "author_name", "ts"]).where(F.col("author_email").isNotNull())
    return c.groupBy(F.col("author_email").alias("email")).agg(F.count("*").alias("commits"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.min_by("author_name", F.struct("ts", "commit_hash")).alias("name"))


def developer_stats(changes: DataFrame) -> DataFrame:
    """Per email: commits, distinct files, lines, flagged commits, first and last."""
    flags = ("is_refactor", "is_bug_fix", "is_architectural", "is_test")
    per = changes.groupBy("email", "commit_hash").agg(F.max("lines").alias("lines"), F.max("ts").alias("ts"), *[F.max(F.col(x).cast("int")).alias(x) for x in flags])
    a = per.groupBy("email").agg(F.count("*").alias("commits"), F.sum("lines").cast("bigint").alias("lines"), F.min("ts").alias("first"), F.max("ts").alias("last"), *[F.sum(x).cast("bigint").alias(x.replace("is_", "n_")) for x in flags])
    return a.join(changes.groupBy("email").agg(F.count_distinct("file").alias("files")), "email")


def file_risk(changes: DataFrame, recent_days: int = 90) -> DataFrame:
    """Per file: changes, authors, days since the last, share of recent changes, change risk and bus risk."""
    at = changes.agg(F.max("ts").alias("as_of"))  # one row
    c = changes.join(F.broadcast(at))
    age = whole_days(F.col("as_of"), F.col("ts"))
    g = c.groupBy("file").agg(F.count("*").alias("changes"), F.count_distinct("email").alias("authors"), F.min(age).alias("days"), (F.count_if(age <= recent_days) / F.count("*")).alias("recent"))
    most = g.agg(F.max("changes").alias("_most"))  # one row
    return g.join(F.broadcast(most)).select("file", "changes", "authors", "days", F.round("recent", 6).alias("recent"), F.round(risk.commit_share_risk(F.col("changes"), F.col("_most"), F.col("recent")), 6).alias("change_risk"), risk.bus_risk(F.col("authors")).alias("bus_risk"))


def latest_scores(expertise: DataFrame) -> DataFrame:
    """One row per (compared file, email): the last activity's, then the highest score; null scores are left out."""
    e = expertise.where(F.col("total_score").isNotNull() & F.col("email").isNotNull() & F.col("file").isNotNull())
    r = e.groupBy(compared_path("file").alias("file"), "email").agg(F.max(F.struct("last_activity", "total_score", "commit_count")).alias("r"))
    return r.select("file", "email", F.col("r.total_score").alias("total"), F.col("r.commit_count").alias("commits"))


def file_summary(risks: DataFrame) -> DataFrame:
    """`file_risk` rows as the service shows them: shares and risks to two places."""
    return risks.select("file", "changes", "authors", "days", *[F.round(c, 2).alias(c) for c in ("recent", "change_risk", "bus_risk")])


def commits_of_type(classified: DataFrame, kind: str, limit: int = 100) -> DataFrame:
    """The `limit` newest commits of a class; the limit counts matches."""
    return classified.where(F.col("class_type") == kind).orderBy(F.col("ts").desc_nulls_last(), "commit_hash").limit(limit)


#: Factors that give a reason, and from what score.
REASONS = {
    "refactor_depth": (0.5, "deeply refactored it"), "architectural_changes": (0.5, "shaped its architecture"), "bug_fixes": (0.4, "fixed many of its bugs"),
    "commit_frequency": (0.5, "commits to it often"), "recency": (0.7, "worked on it recently"), "lines_changed": (0.5, "changed much of it"),
}


def reasoning(scores: DataFrame) -> DataFrame:
    """Expertise rows with `reasoning`: of the two highest factors above 0.3 those over their own threshold, else what is known."""
    order = list(FACTORS)
    pairs = F.array(*[F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(order)])
    top = F.slice(F.array_sort(F.filter(pairs, lambda x: -x["s"] > 0.3)), 1, 2)
    told = lambda x: F.coalesce(*[F.when((x["k"] == k) & (-x["s"] > least), text) for k, (least, text) in REASONS.items()])
    reasons = F.array_compact(F.transform("_top", told))
    text = F.when(F.size("_top") == 0, F.when(F.col("confidence") < 0.3, "too little data").otherwise("little involved")).when(F.size(reasons) > 0, F.array_join(reasons, " and ")).otherwise("contributed to it")
    return scores.withColumn("_top", top).withColumn("reasoning", text).drop("_top")


def contributor_view(scores: DataFrame, as_of: DataFrame) -> DataFrame:
    """(email, commits, refactorings, status) over all files: by each developer's rows, highest total first; as_of is one row.

    Refactorings are commits times refactor depth; online up to 7 days after the last commit, away up to 30, else on leave.
    """
    g = scores.groupBy("email").agg(F.sum("commits").alias("commits"), F.sum(F.round(F.col("commits") * F.col("refactor_depth"))).cast("bigint").alias("refactorings"), F.max("newest").alias("newest"), F.max("total").alias("total"))
    days = whole_days(F.col("as_of"), F.col("newest"))
    return g.join(F.broadcast(as_of)).select("email", "commits", "refactorings", "total", F.when(days <= 7, "online").when(days <= 30, "away").otherwise("pto").alias("status"))


def file_bus_factor(scores: DataFrame, least: float = 0.6) -> DataFrame:
    return scores.groupBy("file").agg(F.count_if(F.col("total") >= least).alias("bus_factor"), F.count("*").alias("experts"), F.max("total").alias("top"))


def knowledge_gaps(scores: DataFrame, below: float = 0.3) -> DataFrame:
    return scores.groupBy("file").agg(F.max("total").alias("top")).where(F.col("top") < below)


def module_experts(scores: DataFrame, limit: int = 10) -> DataFrame:
    """Per directory: mean score and commits of every developer, the first `limit`."""
    m = scores.groupBy(dirname("file").alias("module"), "email").agg(F.round(F.avg("total"), 6).alias("score"), F.sum("commits").cast("bigint").alias("commits"), F.count("*").alias("files"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.col("score").desc(), "email"))).where(F.col("rank") <= limit)


def _within(scores: DataFrame, modules: DataFrame) -> DataFrame:
    """Scores of the files whose path starts with or contains each of the stated modules(module)."""
    return scores.join(F.broadcast(modules.select("module").distinct()), F.contains("file", F.col("module")))  # starting with it is containing it


def experts_within(scores: DataFrame, modules: DataFrame, limit: int = 10) -> DataFrame:
    """Per stated module, a part of a path: mean score and commits of the first `limit` developers, confidence 0.8."""
    m = _within(scores, modules).groupBy("module", "email").agg(F.round(F.avg("total"), 6).alias("score"), F.sum("commits").cast("bigint").alias("commits"))
    return m.withColumn("confidence", F.lit(0.8)).withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.col("score").desc(), "email"))).where(F.col("rank") <= limit)


def bus_factor_within(scores: DataFrame, modules: DataFrame, above: float = 0.6) -> DataFrame:
    """Per stated module, a part of a path: distinct developers with a score above 0.6."""
    return _within(scores, modules).groupBy("module").agg(F.count_distinct(F.when(F.col("total") > above, F.col("email"))).alias("bus_factor"))


def heatmap(scores: DataFrame) -> DataFrame:
    """Per directory: files, developers, bus factor (distinct developers above 0.6), top score, gap and risk flags, health and its band."""
    g = scores.groupBy(dirname("file").alias("module")).agg(
        F.count_distinct("file").alias("files"), F.count_distinct("email").alias("developers"), F.count_distinct(F.when(F.col("total") > 0.6, F.col("email"))).alias("bus_factor"), F.max("total").alias("top"), F.round(F.avg("total"), 6).alias("mean")
    )
    gap = F.col("top") < 0.3
    health = F.when(gap, 20).otherwise(F.least(F.lit(100), 30 * F.col("bus_factor") + 10 * F.col("developers"))).cast("bigint")
    band = F.when(health >= 60, "healthy").when(health >= 30, "watch").otherwise("at risk")
    return g.select("*", gap.alias("gap"), (F.col("bus_factor") <= 2).alias("at_risk"), health.alias("health"), band.alias("band"))


def heatmap_experts(scores: DataFrame, limit: int = 5) -> DataFrame:
    """The `limit` highest score rows of every directory."""
    w = Window.partitionBy("module").orderBy(F.col("total").desc(), "file", "email")
    return scores.select(dirname("file").alias("module"), "file", "email", "total").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def bus_factor_alerts(heat: DataFrame, limit: int = 8) -> DataFrame:
    """The directories that the dashboard warns of: lowest bus factor, then lowest health."""
    return heat.orderBy("bus_factor", "health", "module").limit(limit).select("module", "bus_factor", "health", "band")


def store_stats(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_distinct("file").alias("files"), F.count_distinct("email").alias("developers"), F.count("*").alias("scores"), F.round(F.count("*") / F.count_distinct("file"), 6).alias("experts_per_file"))


def line_experts(ranges: DataFrame, blame: DataFrame, scores: DataFrame) -> DataFrame:
    """ranges(id, file, first, last) of lines -> (id, email, lines, total): who wrote them, with the score on the file where known.

    blame(file, line, email) joins on the file and the line's own range of ranges only: both are first cut to spans of 256
    lines, so a long file is no product of its lines and its ranges.
    """
    span = 256
    r = ranges.where(F.col("last") >= F.col("first")).withColumn("_span", F.explode(F.sequence(F.floor(F.col("first") / span), F.floor(F.col("last") / span))))
    b = blame.select("file", "line", "email", F.floor(F.col("line") / span).alias("_span"))
    hit = b.join(r, ["file", "_span"]).where((F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last")))
    n = hit.groupBy("id", "file", "email").agg(F.count_distinct("line").alias("lines"))
    return n.join(scores.select("file", "email", "total"), ["file", "email"], "left").select("id", "email", "lines", "total")
