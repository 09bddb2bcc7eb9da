"""Queries over imports: layers, rules, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.functions.paths import compared_path
from codestrata.operators import governance as V
from codestrata.plans.tables import table
from codestrata.session import cut


def _checked(spark, sf_dir):
    return V.validate_imports(V.import_layers(table(spark, sf_dir, "imports")))


def layers_classify(spark, sf_dir):
    return V.import_layers(table(spark, sf_dir, "imports"))


def rules_validate(spark, sf_dir):
    return _checked(spark, sf_dir).groupBy("from_layer", "to_layer", "verdict").agg(F.count("*").alias("n"))


def import_violations(spark, sf_dir):
    return _checked(spark, sf_dir).where(F.col("verdict") != "ALLOW").select("from_path", "to_module", "line", "verdict")


def violations_by_layer(spark, sf_dir):
    return V.violations_by_layer(_checked(spark, sf_dir))


def strict_validate(spark, sf_dir):
    """Every unclassified end is a warning."""
    strict = V.validate_imports(V.import_layers(table(spark, sf_dir, "imports")), strict=True)
    return strict.groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("from_path").alias("files"))


def relative_imports(spark, sf_dir):
    i = table(spark, sf_dir, "imports").where(F.col("is_relative"))
    path = compared_path("from_path")
    return i.select(path.alias("from_path"), "to_module", "relative_level", V.resolve_relative(path, F.col("to_module"), F.coalesce("relative_level", F.lit(0))).alias("resolved")).distinct()


def violation_fixes(spark, sf_dir):
    c = _checked(spark, sf_dir).where(F.col("verdict") != "ALLOW")
    return c.select("from_path", "to_module", "line", V.fix_text(F.col("verdict"), F.col("from_layer"), F.col("to_layer")).alias("fix"))


def _files(spark, sf_dir):
    """All source files of one language that are known, whether they import anything or not."""
    g = table(spark, sf_dir, "repo_graph").select(compared_path("file").alias("path"))
    i = table(spark, sf_dir, "imports").select(compared_path("from_path").alias("path"))
    return g.union(i).where(F.col("path").endswith(".py")).distinct()


def validation_summary(spark, sf_dir):
    """Files and imports that a validation reads, without tests and hidden or generated folders."""
    files = cut(V.checked_files(_files(spark, sf_dir)))
    return V.validation_summary(_checked(spark, sf_dir).join(files.select(F.col("path").alias("from_path")), "from_path", "left_semi"), files)


def layer_shares(spark, sf_dir):
    return V.layer_shares(_files(spark, sf_dir))


def drift_metrics(spark, sf_dir):
    return V.drift_metrics(cut(_checked(spark, sf_dir)))


def _known_before(spark, sf_dir):
    """Files that were scanned in the first half of the time of all scans: the tree as it then was."""
    g = table(spark, sf_dir, "repo_graph").where(F.col("scanned_at").isNotNull())
    us = F.unix_micros(F.col("scanned_at").cast("timestamp"))
    half = g.agg(((F.min(us) + F.max(us)) / 2).alias("_half"))  # one row
    return g.groupBy(compared_path("file").alias("path")).agg(F.min(us).alias("_first")).join(F.broadcast(half)).where(F.col("_first") <= F.col("_half")).select("path")


def _now_and_then(spark, sf_dir):
    checked, files = cut(_checked(spark, sf_dir)), cut(_files(spark, sf_dir))
    then = cut(_known_before(spark, sf_dir))
    before = checked.join(then.select(F.col("path").alias("from_path")), "from_path", "left_semi")
    return V.drift_metrics(checked), V.layer_shares(files), V.drift_metrics(before), V.layer_shares(files.join(then, "path", "left_semi"))


def drift_report(spark, sf_dir):
    """The present against the tree as it was halfway through all scans."""
    return V.drift_report(*_now_and_then(spark, sf_dir))


def drift_without_baseline(spark, sf_dir):
    current, shares, _, _ = _now_and_then(spark, sf_dir)
    return V.drift_report(current, shares, None, None)


def drift_series(spark, sf_dir):
    return V.drift_series(*_now_and_then(spark, sf_dir))


def rule_summary(spark, sf_dir):
    return V.rule_summary(spark)


QUERIES = {f.__name__: f for f in (layers_classify, rules_validate, strict_validate, relative_imports, import_violations, violations_by_layer, violation_fixes, validation_summary, layer_shares, drift_metrics, drift_report, drift_without_baseline, drift_series, rule_summary)}


def _layer(path: str) -> str:
    return "CASE " + " ".join("WHEN regexp_matches(" + path + ", '" + "|".join(f"(?:{V.simple_glob(g)})" for g in globs) + f"') THEN '{n}'" for n, (globs, _) in V.LAYERS.items()) + " END"


_L = rf"""i AS (SELECT DISTINCT regexp_replace(replace(from_path, '\', '/'), '^(\./)+', '') AS from_path, to_module, line FROM imports WHERE to_module IS NOT NULL),
l AS (SELECT *, {_layer("from_path")} AS from_layer, {_layer("(replace(to_module, '.', '/') || '/')")} AS to_layer FROM i),
k AS (SELECT *, CASE WHEN from_layer IS NULL OR to_layer IS NULL THEN 'ALLOW' WHEN from_layer = to_layer THEN 'ALLOW' {" ".join(f"WHEN from_layer = '{a}' AND to_layer = '{b}' THEN '{x}'" for a, b, x in V.RULES)}
  WHEN from_layer = 'api' AND to_layer NOT IN ('service') THEN 'WARNING' WHEN from_layer = 'service' AND to_layer NOT IN ('data') THEN 'WARNING' ELSE 'ALLOW' END AS verdict FROM l)"""


def _metrics(name: str, source: str) -> str:
    return f"""{name} AS (SELECT n.*, d.*, round(least((violations + 0.5 * warnings) / greatest(imports, 1), 1.0), 3) AS coupling, round(1 - least((violations + 0.5 * warnings) / greatest(imports, 1), 1.0), 3) AS cohesion
  FROM (SELECT count(*) AS imports, count(*) FILTER (verdict = 'BLOCK') AS violations, count(*) FILTER (verdict = 'WARNING') AS warnings FROM {source}) n,
  (SELECT count(DISTINCT x) AS depth FROM (SELECT unnest([from_layer, to_layer]) AS x FROM {source} WHERE verdict <> 'ALLOW')) d)"""


def _shares(name: str, source: str) -> str:
    return f"""{name} AS (SELECT l.layer, round((SELECT count(*) FROM {source} f WHERE {_layer("f.path")} = l.layer) / greatest((SELECT count(*) FROM {source}), 1), 3) AS share FROM (SELECT unnest([{", ".join(f"'{x}'" for x in V.LAYERS)}]) AS layer) l)"""


_PATH = r"regexp_replace(replace({0}, '\', '/'), '^(\./)+', '')"
_FILES = f"fl AS (SELECT DISTINCT path FROM (SELECT {_PATH.format('file')} AS path FROM repo_graph UNION ALL SELECT {_PATH.format('from_path')} FROM imports) WHERE ends_with(path, '.py'))"
_THEN = f"""us AS (SELECT {_PATH.format("file")} AS path, epoch_us(scanned_at) AS u FROM repo_graph WHERE scanned_at IS NOT NULL), kb AS (SELECT path FROM us GROUP BY path HAVING min(u) <= (SELECT (min(u) + max(u)) / 2 FROM us)),
k0 AS (SELECT * FROM k WHERE from_path IN (SELECT path FROM kb)), fl0 AS (SELECT * FROM fl WHERE path IN (SELECT path FROM kb))"""
_DRIFT = f"{_L}, {_FILES}, {_THEN}, {_metrics('c', 'k')}, {_metrics('b', 'k0')}, {_shares('sc', 'fl')}, {_shares('sb', 'fl0')}"
_FIX = " ".join(f"WHEN verdict = '{v}' THEN replace(replace('{t}', '{{from}}', coalesce(from_layer, 'this')), '{{to}}', coalesce(to_layer, 'that'))" for v, t in V.FIXES.items())
_EXCLUDED = "|".join(f"(?:{V.simple_glob(g)})" for g in V.EXCLUDED)
SQL = {
    "layers_classify": f"WITH {_L} SELECT * FROM l",
    "rules_validate": f"WITH {_L} SELECT from_layer, to_layer, verdict, count(*) AS n FROM k GROUP BY ALL",
    "import_violations": f"WITH {_L} SELECT from_path, to_module, line, verdict FROM k WHERE verdict <> 'ALLOW'",
    "violations_by_layer": f"WITH {_L} SELECT from_layer, to_layer, verdict, count(*) AS n, count(DISTINCT from_path) AS files FROM k WHERE verdict <> 'ALLOW' GROUP BY ALL",
    "strict_validate": f"WITH {_L}, v AS (SELECT from_path, CASE WHEN from_layer IS NULL OR to_layer IS NULL THEN 'WARNING' ELSE verdict END AS verdict FROM k) SELECT verdict, count(*) AS n, count(DISTINCT from_path) AS files FROM v GROUP BY verdict",
    "relative_imports": f"""WITH r AS (SELECT {_PATH.format("from_path")} AS from_path, to_module, relative_level, coalesce(relative_level, 0) AS lv FROM imports WHERE is_relative), p AS (SELECT *, string_split(from_path, '/') AS parts FROM r)
SELECT DISTINCT from_path, to_module, relative_level, CASE WHEN lv > 0 AND len(parts) > lv THEN array_to_string(parts[1:len(parts) - lv], '/') || CASE WHEN coalesce(to_module, '') = '' THEN '' ELSE '/' || replace(to_module, '.', '/') END ELSE to_module END AS resolved FROM p""",
    "violation_fixes": f"WITH {_L} SELECT from_path, to_module, line, CASE {_FIX} END AS fix FROM k WHERE verdict <> 'ALLOW'",
    "validation_summary": f"""WITH {_L}, {_FILES}, cf AS (SELECT path FROM fl WHERE len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.') AND length(x) > 1)) = 0 AND NOT regexp_matches(path, '{_EXCLUDED}')), q AS (SELECT * FROM k WHERE from_path IN (SELECT path FROM cf))
SELECT (SELECT count(*) FROM cf) AS files, count(*) AS imports, count(*) FILTER (verdict = 'BLOCK') AS violations, count(*) FILTER (verdict = 'WARNING') AS warnings, count(DISTINCT CASE WHEN verdict <> 'ALLOW' THEN from_path END) AS files_with_violations, count(*) FILTER (verdict = 'BLOCK') = 0 AS passed FROM q""",
    "layer_shares": f"WITH {_FILES}, {_shares('sc', 'fl')} SELECT * FROM sc",
    "drift_metrics": f"WITH {_L}, {_metrics('m', 'k')} SELECT * FROM m",
    "drift_report": f"""WITH {_DRIFT}, bl AS (SELECT coalesce(sum(abs(coalesce(sc.share, 0) - coalesce(sb.share, 0))), 0)::DOUBLE AS bal FROM sc FULL OUTER JOIN sb USING (layer)),
x AS (SELECT c.coupling - b.coupling AS dc, b.cohesion - c.cohesion AS dh, c.violations - b.violations AS dv, bal, c.depth - b.depth AS dd, c.violations AS v FROM c, b, bl),
y AS (SELECT *, list_filter([CASE WHEN dc > 0.1 THEN 'coupling has grown' END, CASE WHEN dv > 0 THEN 'new violations' END, CASE WHEN bal > 0.2 THEN 'layers have shifted' END, CASE WHEN v > 5 THEN 'too many violations' END], lambda a: a IS NOT NULL) AS adv FROM x)
SELECT round(dc, 3) AS coupling_increase, round(dh, 3) AS cohesion_decrease, dv AS violation_increase, round(bal, 3) AS balance_drift, dd AS depth_increase,
  round(least(0.25::DOUBLE * greatest(dc, 0.0) + 0.20::DOUBLE * greatest(dh, 0.0) + 0.30::DOUBLE * least(greatest(dv / 10, 0.0), 1.0) + 0.15::DOUBLE * bal + 0.10::DOUBLE * least(greatest(dd / 3, 0.0), 1.0), 1.0), 6) AS drift_score,
  CASE WHEN len(adv) = 0 THEN 'stable' ELSE array_to_string(adv, '; ') END AS advice FROM y""",
    "drift_without_baseline": "SELECT 0.0::DOUBLE AS coupling_increase, 0.0::DOUBLE AS cohesion_decrease, 0::BIGINT AS violation_increase, 0.0::DOUBLE AS balance_drift, 0::BIGINT AS depth_increase, 0.0::DOUBLE AS drift_score, 'no baseline to compare with' AS advice",
    "drift_series": f"""WITH {_DRIFT}, n AS (SELECT 'coupling' AS series, coupling AS v FROM c UNION ALL SELECT 'cohesion', cohesion FROM c UNION ALL SELECT layer, share FROM sc), o AS (SELECT 'coupling' AS series, coupling AS v FROM b UNION ALL SELECT 'cohesion', cohesion FROM b UNION ALL SELECT layer, share FROM sb)
SELECT n.series, n.v::DOUBLE AS current, o.v::DOUBLE AS baseline, CASE WHEN n.v >= 0.5 THEN 'high' WHEN n.v >= 0.2 THEN 'medium' ELSE 'low' END AS band FROM n JOIN o USING (series)""",
    "rule_summary": "SELECT * FROM (VALUES " + ", ".join(f"('layer', '{n}', '{', '.join(g)} -> {', '.join(a) or 'nothing'}')" for n, (g, a) in V.LAYERS.items()) + ", " + ", ".join(f"('rule', '{a} -> {b}', '{x}')" for a, b, x in V.RULES) + ") t(kind, name, detail)",
}
