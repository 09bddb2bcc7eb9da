"""Queries over commits and expertise."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import history as H
from codestrata.plans.tables import table


def _changes(spark, sf_dir):
    return H.commit_files(table(spark, sf_dir, "commits"))


def _scores(spark, sf_dir):
    return H.latest_scores(table(spark, sf_dir, "expertise"))


def classify_commits(spark, sf_dir):
    c = H.distinct_commits(table(spark, sf_dir, "commits"), ["message", "files_changed"])
    return H.classify_commits(c).select("commit_hash", "class_type", "says_refactor", "says_bug_fix", "says_architectural", "is_test_change")


def commits_by_type(spark, sf_dir):
    return classify_commits(spark, sf_dir).groupBy("class_type").agg(F.count("*").alias("n"))


def contributors(spark, sf_dir):
    return H.contributors(table(spark, sf_dir, "commits")).select("email", "commits", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


def developer_stats(spark, sf_dir):
    d = H.developer_stats(_changes(spark, sf_dir))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")
    return d.select("*", us("first"), us("last")).drop("first", "last")


def expert_scores(spark, sf_dir):
    return H.expertise_factors(_changes(spark, sf_dir)).drop("newest")


def expert_top1(spark, sf_dir):
    return H.rank_experts(H.expertise_factors(_changes(spark, sf_dir)).select("file", "email", "commits", "total"), 1).drop("rank")


def expert_recommendation(spark, sf_dir):
    return H.recommend(H.expertise_factors(_changes(spark, sf_dir)))


def file_risk(spark, sf_dir):
    return H.file_risk(_changes(spark, sf_dir))


def file_bus_factor(spark, sf_dir):
    return H.file_bus_factor(_scores(spark, sf_dir))


def knowledge_gaps(spark, sf_dir):
    return H.knowledge_gaps(_scores(spark, sf_dir))


def module_experts(spark, sf_dir):
    return H.module_experts(_scores(spark, sf_dir))


def expertise_heatmap(spark, sf_dir):
    return H.heatmap(_scores(spark, sf_dir))


def expertise_store_stats(spark, sf_dir):
    return H.store_stats(_scores(spark, sf_dir))


def file_summary(spark, sf_dir):
    return H.file_summary(H.file_risk(_changes(spark, sf_dir)))


def commits_of_type(spark, sf_dir):
    c = H.classify_commits(H.distinct_commits(table(spark, sf_dir, "commits"), ["message", "files_changed", "ts"]))
    return H.commits_of_type(c, "bug_fix").select("commit_hash", "class_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


def expert_reasoning(spark, sf_dir):
    return H.reasoning(H.expertise_factors(_changes(spark, sf_dir))).select("file", "email", "total", "confidence", "reasoning")


def expert_weights(spark, sf_dir):
    """Scores with other weights: what was reviewed counts as much as what was fixed."""
    return H.expertise_factors(_changes(spark, sf_dir), weights={"bug_fixes": 0.10, "code_review": 0.10}).select("file", "email", "total")


def contributor_view(spark, sf_dir):
    changes = _changes(spark, sf_dir)
    return H.contributor_view(H.expertise_factors(changes), changes.agg(F.max("ts").alias("as_of")))


def stored_experts(spark, sf_dir):
    return H.rank_experts(_scores(spark, sf_dir), 5)


def _modules(spark, sf_dir):
    """The stated modules: the parts of a path that come first in each language's folder names."""
    return spark.createDataFrame([("core/",), ("tests/",), ("lib/module",), ("src",), ("nowhere",)], "module string")


def experts_within(spark, sf_dir):
    return H.experts_within(_scores(spark, sf_dir), _modules(spark, sf_dir))


def bus_factor_within(spark, sf_dir):
    return H.bus_factor_within(_scores(spark, sf_dir), _modules(spark, sf_dir))


def heatmap_experts(spark, sf_dir):
    return H.heatmap_experts(_scores(spark, sf_dir))


def bus_factor_alerts(spark, sf_dir):
    return H.bus_factor_alerts(H.heatmap(_scores(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (classify_commits, commits_by_type, commits_of_type, contributors, developer_stats, expert_scores, expert_top1, expert_recommendation, expert_reasoning, expert_weights, contributor_view, file_risk, file_summary, file_bus_factor, knowledge_gaps, module_experts, stored_experts, experts_within, bus_factor_within, expertise_heatmap, heatmap_experts, bus_factor_alerts, expertise_store_stats)}


def _any(words: list[str], text: str = "m") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_DISTINCT = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_hash ORDER BY ingested_at DESC NULLS LAST) AS rn FROM commits WHERE commit_hash IS NOT NULL) WHERE rn = 1)"
_CLASSES = f"""{_DISTINCT}, k AS (SELECT commit_hash, CASE WHEN {_any(H.KEYWORDS["architectural"])} THEN 'architectural' {" ".join(f"WHEN {_any(H.KEYWORDS[x])} THEN '{x}'" for x in ("refactor", "bug_fix", "test", "documentation", "feature"))} ELSE 'unknown' END AS class_type,
  {_any(H.KEYWORDS["refactor"])} AS says_refactor, {_any(H.KEYWORDS["bug_fix"])} AS says_bug_fix, {_any(H.KEYWORDS["architectural"])} AS says_architectural,
  coalesce(len(list_filter(files_changed, lambda f: {_any(H.TEST_FILES, "lower(f)")})) > 0, false) AS is_test_change
  FROM (SELECT *, lower(coalesce(message, '')) AS m FROM c))"""
_CHANGES = _DISTINCT + r""", ch AS (SELECT DISTINCT commit_hash, author_email AS email, ts, coalesce(lines_added, 0) + coalesce(lines_deleted, 0) AS lines,
  coalesce(is_refactor, false) AS r, coalesce(is_bug_fix, false) AS b, coalesce(is_architectural, false) AS a, coalesce(is_test, false) AS te, coalesce(len(reviewers), 0) AS v,
  regexp_replace(replace(f, '\', '/'), '^(\./)+', '') AS file
  FROM (SELECT *, unnest(files_changed) AS f FROM c) WHERE author_email IS NOT NULL AND f IS NOT NULL)"""
_SCORED = _CHANGES + """, p AS (SELECT file, email, count(*) AS n, sum(lines) AS l, sum(r::INT) AS r, sum(CASE WHEN r THEN lines ELSE 0 END) AS rl, sum(a::INT) AS a, sum(b::INT) AS b, max(ts) AS newest, sum(v) AS v,
    max((NOT (r OR a OR b))::INT) AS plain FROM ch GROUP BY file, email),
t AS (SELECT *, sum(n) OVER w AS n_, sum(l) OVER w AS l_, sum(r) OVER w AS r_, sum(rl) OVER w AS rl_, sum(a) OVER w AS a_, sum(b) OVER w AS b_,
    floor((epoch_us((SELECT max(ts) FROM ch)) - epoch_us(newest)) / 86400000000) AS days FROM p WINDOW w AS (PARTITION BY file)),
f AS (SELECT file, email, n, r, a, b, plain, days, newest, least(1.0, 2 * n / n_) AS commit_frequency, CASE WHEN l_ > 0 THEN least(1.0, 1.5 * sqrt(l / l_)) ELSE 0 END AS lines_changed,
    CASE WHEN r = 0 THEN 0 ELSE least(1.0, 0.4::DOUBLE * r / r_ + CASE WHEN rl_ > 0 THEN 0.6::DOUBLE * rl / rl_ ELSE 0 END) END AS refactor_depth,
    CASE WHEN a_ > 0 THEN least(1.0, 1.5 * (a / a_)) ELSE 0 END AS architectural_changes, CASE WHEN b_ > 0 THEN least(1.0, b / b_) ELSE 0 END AS bug_fixes,
    greatest(0.0, least(1.0, exp(-ln(2.0) / 180 * days))) AS recency, CASE WHEN v > 0 THEN least(1.0, v / 10) ELSE 0.5 * (n / n_) END AS code_review FROM t),
s AS (SELECT file, email, n AS commits, round(commit_frequency::DOUBLE, 6) AS commit_frequency, round(lines_changed::DOUBLE, 6) AS lines_changed, round(refactor_depth::DOUBLE, 6) AS refactor_depth, round(architectural_changes::DOUBLE, 6) AS architectural_changes,
    round(bug_fixes::DOUBLE, 6) AS bug_fixes, round(recency::DOUBLE, 6) AS recency, round(code_review::DOUBLE, 6) AS code_review,
    round(least(1.0::DOUBLE, commit_frequency::DOUBLE * 0.15::DOUBLE + lines_changed::DOUBLE * 0.10::DOUBLE + refactor_depth::DOUBLE * 0.25::DOUBLE + architectural_changes::DOUBLE * 0.20::DOUBLE + bug_fixes::DOUBLE * 0.15::DOUBLE + recency::DOUBLE * 0.10::DOUBLE + code_review::DOUBLE * 0.05::DOUBLE), 6) AS total,
    round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 * least(1.0, n / 9) + 0.3::DOUBLE * greatest(0.0, 1 - days / 365) + 0.2::DOUBLE * ((r > 0)::INT + (a > 0)::INT + (b > 0)::INT + plain) / 4)), 6) AS confidence, newest FROM f)"""
_LATEST = r"""e AS (SELECT file, email, total_score AS total, commit_count AS commits FROM (
  SELECT regexp_replace(replace(file, '\', '/'), '^(\./)+', '') AS file, email, total_score, commit_count,
    row_number() OVER (PARTITION BY regexp_replace(replace(file, '\', '/'), '^(\./)+', ''), email ORDER BY last_activity DESC NULLS LAST, total_score DESC, commit_count DESC) AS rn
  FROM expertise WHERE total_score IS NOT NULL AND email IS NOT NULL AND file IS NOT NULL) WHERE rn = 1)"""
_STATED = "mo AS (SELECT unnest(['core/', 'tests/', 'lib/module', 'src', 'nowhere']) AS module)"
_MODULE = "regexp_replace(file, '/?[^/]*$', '')"

SQL = {
    "classify_commits": f"WITH {_CLASSES} SELECT * FROM k",
    "commits_by_type": f"WITH {_CLASSES} SELECT class_type, count(*) AS n FROM k GROUP BY class_type",
    "contributors": f"WITH {_DISTINCT} SELECT author_email AS email, count(*) AS commits, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM c WHERE author_email IS NOT NULL GROUP BY author_email",
    "developer_stats": f"""WITH {_CHANGES}, per AS (SELECT email, commit_hash, max(lines) AS lines, max(ts) AS ts, max(r::INT) AS r, max(b::INT) AS b, max(a::INT) AS a, max(te::INT) AS te FROM ch GROUP BY ALL)
SELECT email, count(*) AS commits, sum(lines)::BIGINT AS lines, sum(r)::BIGINT AS n_refactor, sum(b)::BIGINT AS n_bug_fix, sum(a)::BIGINT AS n_architectural, sum(te)::BIGINT AS n_test, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, any_value(files) AS files
FROM per JOIN (SELECT email, count(DISTINCT file) AS files FROM ch GROUP BY email) USING (email) GROUP BY email""",
    "expert_scores": f"WITH {_SCORED} SELECT * EXCLUDE (newest) FROM s",
    "expert_top1": f"WITH {_SCORED} SELECT file, email, commits, total FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY total DESC, email) AS rn FROM s) WHERE rn = 1",
    "expert_recommendation": f"""WITH {_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY total DESC, email) AS rn FROM s)
SELECT file, max(CASE WHEN rn = 1 THEN email END) AS expert, max(CASE WHEN rn = 1 THEN total END) AS total, coalesce(string_agg(CASE WHEN rn BETWEEN 2 AND 4 THEN email END, ',' ORDER BY rn), '') AS secondary,
  count(*) FILTER (total >= 0.6) AS bus_factor,
  max(CASE WHEN rn = 1 THEN CASE WHEN architectural_changes > 0.5 THEN 'shaped the architecture' WHEN refactor_depth > 0.5 THEN 'refactored it deeply' WHEN bug_fixes > 0.5 THEN 'fixed many bugs'
    WHEN recency > 0.7 THEN 'worked on it recently' WHEN total > 0.6 THEN 'primary expert' ELSE 'knows it best' END END) AS reason
FROM k GROUP BY file""",
    "file_risk": f"""WITH {_CHANGES}, x AS (SELECT *, floor((epoch_us((SELECT max(ts) FROM ch)) - epoch_us(ts)) / 86400000000)::BIGINT AS age FROM ch),
g AS (SELECT file, count(*) AS changes, count(DISTINCT email) AS authors, min(age) AS days, count(*) FILTER (age <= 90) / count(*) AS recent FROM x GROUP BY file)
SELECT file, changes, authors, days, round(recent, 6) AS recent, round(least(0.6::DOUBLE * least(changes / greatest((SELECT max(changes) FROM g), 1), 1.0) + 0.4::DOUBLE * recent, 1.0), 6) AS change_risk,
  CASE WHEN authors <= 1 THEN 1.0 WHEN authors = 2 THEN 0.7 WHEN authors = 3 THEN 0.4 WHEN authors = 4 THEN 0.2 ELSE 0.1 END::DOUBLE AS bus_risk FROM g""",
    "file_bus_factor": f"WITH {_LATEST} SELECT file, count(*) FILTER (total >= 0.6) AS bus_factor, count(*) AS experts, max(total) AS top FROM e GROUP BY file",
    "knowledge_gaps": f"WITH {_LATEST} SELECT file, max(total) AS top FROM e GROUP BY file HAVING max(total) < 0.3",
    "module_experts": f"""WITH {_LATEST}, m AS (SELECT {_MODULE} AS module, email, round(avg(total), 6) AS score, sum(commits)::BIGINT AS commits, count(*) AS files FROM e GROUP BY ALL)
SELECT module, email, score, commits, files, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, email) AS rank FROM m) WHERE rank <= 10""",
    "expertise_heatmap": f"""WITH {_LATEST}, g AS (SELECT {_MODULE} AS module, count(DISTINCT file) AS files, count(DISTINCT email) AS developers, count(DISTINCT CASE WHEN total > 0.6 THEN email END) AS bus_factor, max(total) AS top, round(avg(total), 6) AS mean FROM e GROUP BY ALL)
SELECT *, top < 0.3 AS gap, bus_factor <= 2 AS at_risk, CASE WHEN top < 0.3 THEN 20 ELSE least(100, 30 * bus_factor + 10 * developers) END::BIGINT AS health, CASE WHEN top < 0.3 THEN 'at risk' WHEN 30 * bus_factor + 10 * developers >= 60 THEN 'healthy' WHEN 30 * bus_factor + 10 * developers >= 30 THEN 'watch' ELSE 'at risk' END AS band FROM g""",
    "expertise_store_stats": f"WITH {_LATEST} SELECT count(DISTINCT file) AS files, count(DISTINCT email) AS developers, count(*) AS scores, round(count(*) / count(DISTINCT file), 6) AS experts_per_file FROM e",
    "file_summary": f"WITH {_CHANGES}, x AS (SELECT *, floor((epoch_us((SELECT max(ts) FROM ch)) - epoch_us(ts)) / 86400000000)::BIGINT AS age FROM ch), g AS (SELECT file, count(*) AS changes, count(DISTINCT email) AS authors, min(age) AS days, count(*) FILTER (age <= 90) / count(*) AS recent FROM x GROUP BY file) SELECT file, changes, authors, days, round(round(recent, 6), 2) AS recent, round(round(least(0.6::DOUBLE * least(changes / greatest((SELECT max(changes) FROM g), 1), 1.0) + 0.4::DOUBLE * recent, 1.0), 6), 2) AS change_risk, CASE WHEN authors <= 1 THEN 1.0 WHEN authors = 2 THEN 0.7 WHEN authors = 3 THEN 0.4 WHEN authors = 4 THEN 0.2 ELSE 0.1 END::DOUBLE AS bus_risk FROM g",
    "commits_of_type": f"WITH {_CLASSES} SELECT k.commit_hash, k.class_type, epoch_us(c.ts) AS ts_us FROM k JOIN c USING (commit_hash) WHERE k.class_type = 'bug_fix' ORDER BY c.ts DESC NULLS LAST, k.commit_hash LIMIT 100",
    "expert_reasoning": f"""WITH {_SCORED}, q AS (SELECT *, list_slice(list_sort(list_filter([{", ".join(f"{{'s': -{k}, 'i': {i}, 'k': '{k}'}}" for i, k in enumerate(H.FACTORS))}], lambda x: -x.s > 0.3)), 1, 2) AS top FROM s),
w AS (SELECT *, list_filter(list_transform(top, lambda x: CASE {" ".join(f"WHEN x.k = '{k}' AND -x.s > {least} THEN '{text}'" for k, (least, text) in H.REASONS.items())} END), lambda t: t IS NOT NULL) AS why FROM q)
SELECT file, email, total, confidence, CASE WHEN len(top) = 0 THEN CASE WHEN confidence < 0.3 THEN 'too little data' ELSE 'little involved' END WHEN len(why) > 0 THEN array_to_string(why, ' and ') ELSE 'contributed to it' END AS reasoning FROM w""",
    "expert_weights": f"WITH {_SCORED} SELECT file, email, round(least(1.0::DOUBLE, commit_frequency::DOUBLE * 0.15::DOUBLE + lines_changed::DOUBLE * 0.10::DOUBLE + refactor_depth::DOUBLE * 0.25::DOUBLE + architectural_changes::DOUBLE * 0.20::DOUBLE + bug_fixes::DOUBLE * 0.10::DOUBLE + recency::DOUBLE * 0.10::DOUBLE + code_review::DOUBLE * 0.10::DOUBLE), 6) AS total FROM f",
    "contributor_view": f"""WITH {_SCORED}, g AS (SELECT email, sum(commits)::BIGINT AS commits, sum(round(commits * refactor_depth))::BIGINT AS refactorings, max(newest) AS newest, max(total) AS total FROM s GROUP BY email), d AS (SELECT *, floor((epoch_us((SELECT max(ts) FROM ch)) - epoch_us(newest)) / 86400000000) AS days FROM g)
SELECT email, commits, refactorings, total, CASE WHEN days <= 7 THEN 'online' WHEN days <= 30 THEN 'away' ELSE 'pto' END AS status FROM d""",
    "stored_experts": f"WITH {_LATEST} SELECT file, email, total, commits, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY total DESC, email) AS rank FROM e) WHERE rank <= 5",
    "experts_within": f"""WITH {_LATEST}, {_STATED}, m AS (SELECT module, email, round(avg(total), 6) AS score, sum(commits)::BIGINT AS commits FROM e JOIN mo ON contains(file, module) GROUP BY ALL)
SELECT *, 0.8::DOUBLE AS confidence, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY score DESC, email) AS rank_ FROM m) t(module, email, score, commits, rank) WHERE rank <= 10""".replace("SELECT *, 0.8", "SELECT module, email, score, commits, 0.8"),
    "bus_factor_within": f"WITH {_LATEST}, {_STATED} SELECT module, count(DISTINCT CASE WHEN total > 0.6 THEN email END) AS bus_factor FROM e JOIN mo ON contains(file, module) GROUP BY module",
    "heatmap_experts": f"WITH {_LATEST} SELECT module, file, email, total, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY total DESC, file, email) AS place FROM (SELECT {_MODULE} AS module, file, email, total FROM e)) WHERE place <= 5",
}
SQL["bus_factor_alerts"] = f"SELECT module, bus_factor, health, band FROM ({SQL['expertise_heatmap']}) ORDER BY bus_factor, health, module LIMIT 8"
