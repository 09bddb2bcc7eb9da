"""Layers, boundary rules, violations and drift."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import compared_path

#: Layers in the order they are tried, with their globs and what they may depend on.
LAYERS = {
    "api": (["**/api/**", "**/routes/**", "**/endpoints/**", "**/controllers/**"], ["service"]),
    "service": (["**/services/**", "**/core/**", "**/domain/**", "**/usecases/**"], ["data"]),
    "data": (["**/data/**", "**/models/**", "**/storage/**", "**/repositories/**", "**/db/**"], []),
}
#: Fixed values: (from, to, action), the first that matches counts.
RULES = [("api", "data", "BLOCK"), ("data", "service", "BLOCK"), ("data", "api", "BLOCK")]


def layer_of(path: Column, layers: dict = LAYERS) -> Column:
    """The first layer one of whose globs the path matches, else null."""
    out = None
    for name, (globs, _) in layers.items():
        hit = path.rlike("|".join(f"(?:{simple_glob(g)})" for g in globs))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def simple_glob(glob: str) -> str:
    """Globs of '*', '?' and plain text as a regular expression that any engine reads."""
    text = "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in ".^$+{}[]|()\\" else c) for c in glob.replace("\\", "/"))
    while ".*.*" in text:
        text = text.replace(".*.*", ".*")
    return "^" + text + "$"


def import_layers(imports: DataFrame, dotted: bool = True, layers: dict = LAYERS) -> DataFrame:
    """Distinct (from_path, to_module, line) with the layers of both ends; dotted modules are read as paths if asked."""
    i = imports.where(F.col("to_module").isNotNull()).select(compared_path("from_path").alias("from_path"), "to_module", "line").distinct()
    target = F.concat(F.translate("to_module", ".", "/"), F.lit("/")) if dotted else F.col("to_module")
    return i.select("*", layer_of(F.col("from_path"), layers).alias("from_layer"), layer_of(target, layers).alias("to_layer"))


def validate_imports(layered: DataFrame, rules: list = RULES, layers: dict = LAYERS, strict: bool = False) -> DataFrame:
    """With `verdict` (ALLOW, WARNING, BLOCK): unclassified ends are allowed (strict: a warning), then same layer, then the first rule, then the allowed list."""
    a, b = F.col("from_layer"), F.col("to_layer")
    verdict = F.when(a.isNull() | b.isNull(), "WARNING" if strict else "ALLOW").when(a == b, "ALLOW")
    for x, y, action in rules:
        verdict = verdict.when((a == x) & (b == y), action)
    for name, (_, allowed) in layers.items():
        if allowed:
            verdict = verdict.when((a == name) & ~b.isin(*allowed), "WARNING")
    return layered.withColumn("verdict", verdict.otherwise("ALLOW"))


def violations_by_layer(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("verdict") != "ALLOW").groupBy("from_layer", "to_layer", "verdict").agg(F.count("*").alias("n"), F.count_distinct("from_path").alias("files"))


def resolve_relative(from_path: Column, module: Column, level: Column) -> Column:
    """The module of a relative import as a path: as many folders up as it has dots; other modules stay as they are."""
    parts = F.split(from_path, "/")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0))), "/")
    below = F.when(F.coalesce(module, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.translate(module, ".", "/")))
    return F.when((level > 0) & (F.size(parts) > level), F.concat(base, below)).otherwise(module)


#: Files that a validation leaves out.
EXCLUDED = ["**/test_*", "**/tests/**", "**/__pycache__/**", "**/node_modules/**", "**/.venv/**", "**/venv/**", "**/migrations/**"]


def checked_files(paths: DataFrame, path: str = "path", excluded: list[str] = EXCLUDED) -> DataFrame:
    """Distinct files that a validation reads: none in hidden folders, none that an excluding glob matches."""
    p = F.col(path)
    hidden = F.exists(F.split(p, "/"), lambda x: x.startswith(".") & (F.length(x) > 1))
    return paths.where(p.isNotNull() & ~hidden & ~p.rlike("|".join(f"(?:{simple_glob(g)})" for g in excluded))).distinct()


def validation_summary(checked: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files and imports read, violations, warnings, files with either, and whether none is blocked."""
    n = checked.agg(F.count("*").alias("imports"), F.count_if(F.col("verdict") == "BLOCK").alias("violations"), F.count_if(F.col("verdict") == "WARNING").alias("warnings"), F.count_distinct(F.when(F.col("verdict") != "ALLOW", F.col("from_path"))).alias("files_with_violations"))
    return n.join(files.agg(F.count("*").alias("files"))).select("files", "imports", "violations", "warnings", "files_with_violations", (F.col("violations") == 0).alias("passed"))  # one row each


def rule_summary(spark, rules: list = RULES, layers: dict = LAYERS) -> DataFrame:
    """(kind, name, detail): layers in the order they are tried, with globs and what they may depend on, and rules."""
    rows = [("layer", n, f"{', '.join(g)} -> {', '.join(a) or 'nothing'}") for n, (g, a) in layers.items()] + [("rule", f"{a} -> {b}", action) for a, b, action in rules]
    return spark.createDataFrame(rows, "kind string, name string, detail string")


#: Advice on a violation by how it was met.
FIXES = {"BLOCK": "move the call behind the layer between {from} and {to}", "WARNING": "{from} should not depend on {to}: invert the dependency"}


def fix_text(verdict: Column, from_layer: Column, to_layer: Column) -> Column:
    out = F.lit(None).cast("string")
    for v, text in FIXES.items():
        filled = F.replace(F.replace(F.lit(text), F.lit("{from}"), F.coalesce(from_layer, F.lit("this"))), F.lit("{to}"), F.coalesce(to_layer, F.lit("that")))
        out = F.when(verdict == v, filled).otherwise(out)
    return out


def layer_shares(files: DataFrame, path: str = "path", layers: dict = LAYERS) -> DataFrame:
    """(layer, share): files of each layer among all files, whether they import anything or not; layers without files too."""
    all_ = files.select(layer_of(F.col(path), layers).alias("layer")).groupBy("layer").agg(F.count("*").alias("_n"))
    total = all_.agg(F.sum("_n").alias("_all"))  # one row
    names = files.sparkSession.createDataFrame([(n,) for n in layers], "layer string")
    return names.join(all_, "layer", "left").join(total).select("layer", F.round(F.coalesce("_n", F.lit(0)) / F.greatest(F.coalesce("_all", F.lit(1)), F.lit(1)), 3).alias("share"))


def drift_metrics(checked: DataFrame) -> DataFrame:
    """One row: imports, violations, warnings, coupling, cohesion and the number of layers in violations."""
    n = checked.agg(F.count("*").alias("imports"), F.count_if(F.col("verdict") == "BLOCK").alias("violations"), F.count_if(F.col("verdict") == "WARNING").alias("warnings"))
    ends = checked.where(F.col("verdict") != "ALLOW").select(F.explode(F.array("from_layer", "to_layer")).alias("x")).agg(F.count_distinct("x").alias("depth"))
    coupling = F.least((F.col("violations") + 0.5 * F.col("warnings")) / F.greatest(F.col("imports"), F.lit(1)), F.lit(1.0))
    return n.join(ends).select("*", F.round(coupling, 3).alias("coupling"), F.round(1 - coupling, 3).alias("cohesion"))  # one row each


def save_baseline(metrics: DataFrame, shares: DataFrame, path: str) -> None:
    """Metrics and layer shares as one JSON row, to be compared with later."""
    packed = metrics.join(shares.agg(F.map_from_entries(F.collect_list(F.struct("layer", "share"))).alias("shares")))  # a row and a few layers
    packed.coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark, path: str) -> tuple[DataFrame, DataFrame] | None:
    """What save_baseline wrote, or None where nothing is."""
    schema = "imports bigint, violations bigint, warnings bigint, depth bigint, coupling double, cohesion double, shares map<string,double>"
    try:
        row = spark.read.schema(schema).json(path)
    except AnalysisException:
        return None
    return row.drop("shares"), row.select(F.explode("shares").alias("layer", "share"))


def drift_report(current: DataFrame, shares: DataFrame, baseline: DataFrame | None, baseline_shares: DataFrame | None) -> DataFrame:
    """Changes against a baseline and the weighted drift score; only increases count. Without a baseline the score is 0 and says so.

    Layers are those of either side: the balance drift adds up the differences over a full outer join.
    """
    if baseline is None:
        zero = [F.lit(0.0).alias(c) for c in ("coupling_increase", "cohesion_decrease")]
        return current.select(*zero, F.lit(0).cast("bigint").alias("violation_increase"), F.lit(0.0).alias("balance_drift"), F.lit(0).cast("bigint").alias("depth_increase"), F.lit(0.0).alias("drift_score"), F.lit("no baseline to compare with").alias("advice"))
    b = baseline.select(*[F.col(c).alias("b_" + c) for c in baseline.columns])
    balance_drift = shares.join(baseline_shares.withColumnRenamed("share", "_b"), "layer", "full_outer").agg(F.coalesce(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))), F.lit(0.0)).alias("_balance"))
    d = current.join(b).join(balance_drift)  # one row each
    diff = lambda c: F.col(c) - F.col("b_" + c)
    balance = F.col("_balance")
    up = lambda c: F.greatest(c, F.lit(0.0))
    score = 0.25 * up(diff("coupling")) + 0.20 * up(-diff("cohesion")) + 0.30 * F.least(up(diff("violations") / 10), F.lit(1.0)) + 0.15 * balance + 0.10 * F.least(up(diff("depth") / 3), F.lit(1.0))
    advice = F.array_compact(F.array(F.when(diff("coupling") > 0.1, "coupling has grown"), F.when(diff("violations") > 0, "new violations"), F.when(balance > 0.2, "layers have shifted"), F.when(F.col("violations") > 5, "too many violations")))
    return d.select(
        F.round(diff("coupling"), 3).alias("coupling_increase"), F.round(-diff("cohesion"), 3).alias("cohesion_decrease"), diff("violations").alias("violation_increase"), F.round(balance, 3).alias("balance_drift"), diff("depth").alias("depth_increase"),
        F.round(F.least(score, F.lit(1.0)), 6).alias("drift_score"), F.when(F.size(advice) == 0, F.lit("stable")).otherwise(F.array_join(advice, "; ")).alias("advice"),
    )


def drift_series(current: DataFrame, shares: DataFrame, baseline: DataFrame | None, baseline_shares: DataFrame | None) -> DataFrame:
    """(series, current, baseline, band): coupling, cohesion and each layer's share; without a baseline it is the present. Bands at 0.5 and 0.2."""
    long = lambda m, s: m.select(F.explode(F.create_map(F.lit("coupling"), F.col("coupling"), F.lit("cohesion"), F.col("cohesion"))).alias("series", "value")).unionByName(s.select(F.col("layer").alias("series"), F.col("share").alias("value")))
    now = long(current, shares).withColumnRenamed("value", "current")
    then = (long(baseline, baseline_shares) if baseline is not None else long(current, shares)).withColumnRenamed("value", "baseline")
    both = now.join(then, "series", "full_outer").select("series", F.coalesce("current", F.lit(0.0)).alias("current"), F.coalesce("baseline", "current").alias("baseline"))
    return both.withColumn("band", F.when(F.col("current") >= 0.5, "high").when(F.col("current") >= 0.2, "medium").otherwise("low"))
