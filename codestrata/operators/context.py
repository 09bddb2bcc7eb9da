"""Context for questions: entities, files, ownership, complexity, violations and hotspots as short texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions import risk
from codestrata.operators.graph import reach, simple_edges

#: How much of each list a context shows, and how long the whole may get.
RELATED, AFFECTED, IN_FILE, ENTITIES, LENGTH = 10, 8, 8, 3, 1500


def _first(rows: DataFrame, key: str, value: str, n: int, name: str) -> DataFrame:
    """(key, name, n_name): the first n values of every key by order, and how many there are. Only n a key are ever collected."""
    w = Window.partitionBy(key).orderBy(value)
    total = rows.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
    kept = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))
    return kept.join(total, key)


def entity_context(entities: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of every wanted entity: what it is, its complexity, callers and callees, class, what a change reaches, its file.

    wanted(node) is a stated set; lists are cut to what a context shows and say how many there are.
    """
    me = entities.select(F.col("uid").alias("node"), "name", "entity_type", F.col("file_path").alias("file"), "signature", "docstring", "parent_class", "bases", "complexity").join(wanted.select("node").distinct(), "node", "left_semi")
    simple = simple_edges(edges)
    ask = wanted.select("node").distinct()
    callers = simple.where(F.col("type") == "CALLS").join(ask.withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("target").alias("node"), F.col("source").alias("other"))
    callees = simple.where(F.col("type") == "CALLS").join(ask.withColumnRenamed("node", "source"), "source", "left_semi").select(F.col("source").alias("node"), F.col("target").alias("other"))
    up = reach(edges, ask).select(F.col("seed").alias("node"), F.col("node").alias("other"))
    rows = me
    for d, n, name in ((callers, RELATED, "callers"), (callees, RELATED, "callees"), (up, AFFECTED, "affected")):
        rows = rows.join(_first(d, "node", "other", n, name), "node", "left")
    # One more of a file than is shown, for the entity itself: no entity meets all others of its file.
    inside = entities.select(F.col("file_path").alias("file"), F.col("uid").alias("other")).join(me.select("file").distinct(), "file", "left_semi")
    rows = rows.join(_first(inside, "file", "other", IN_FILE + 1, "beside"), "file", "left")
    others = F.slice(F.filter("beside", lambda o: o != F.col("node")), 1, IN_FILE)
    rows = rows.withColumn("beside", others).withColumn("n_beside", F.nullif(F.col("n_beside") - 1, F.lit(0)))
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(label + ": "), value))
    listed = lambda label, name: F.when(F.col(f"n_{name}").isNotNull(), F.concat(F.lit(label + " ("), F.col(f"n_{name}").cast("string"), F.lit("): "), F.array_join(name, ", ")))
    cyc, cog, loc = (F.coalesce(F.col(f"complexity.{c}"), F.lit(0)).cast("string") for c in ("cyclomatic", "cognitive", "lines_of_code"))
    band = risk.complexity_band(F.coalesce(F.col("complexity.cyclomatic"), F.lit(0)))
    n = F.coalesce("n_affected", F.lit(0))
    text = F.concat_ws(
        "\n",
        F.concat_ws(" ", "entity_type", "name"),
        line("file", F.col("file")), line("signature", F.col("signature")), line("description", F.split_part(F.col("docstring"), F.lit("\n"), F.lit(1))),
        F.concat(F.lit("complexity: "), cyc, F.lit(" cyclomatic ("), band, F.lit("), "), cog, F.lit(" cognitive, "), loc, F.lit(" lines")),
        listed("called by", "callers"), listed("calls", "callees"), line("class", F.col("parent_class")), line("extends", F.array_join(F.filter(F.coalesce("bases", F.array().cast("array<string>")), lambda b: b.isNotNull()), ", ")),
        F.concat(F.lit("a change reaches "), n.cast("string"), F.lit(" ("), risk.closure_band(n), F.lit(")")), listed("for instance", "affected"), listed("beside it in the file", "beside"),
    )
    return rows.select("node", text.alias("text"))


def query_context(contexts: DataFrame, matches: DataFrame, entities: int = ENTITIES, length: int = LENGTH) -> DataFrame:
    """matches(query_id, node, rank), contexts(node, text) -> (query_id, text): the texts of the first three, cut to 1,500 characters."""
    first = matches.where(F.col("rank") <= entities).join(contexts, "node")
    packed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node", "text"))).alias("_t"))
    return packed.select("query_id", F.left(F.array_join(F.transform("_t", lambda t: t["text"]), "\n\n"), F.lit(length)).alias("text"))


def file_context(entities: DataFrame) -> DataFrame:
    """Per file: its classes, functions and methods, mean and highest cyclomatic complexity and the function that has it (the first loaded of equals)."""
    is_class, is_function = F.col("entity_type") == "class", F.col("entity_type") == "function"
    cyc = F.coalesce(F.col("complexity.cyclomatic"), F.lit(0))
    g = entities.where(F.col("file_path").isNotNull()).groupBy(F.col("file_path").alias("file")).agg(
        F.count_if(is_class).alias("classes"), F.count_if(is_function & ~F.coalesce("is_method", F.lit(False))).alias("functions"), F.count_if(is_function & F.coalesce("is_method", F.lit(False))).alias("methods"),
        F.round(F.avg(F.when(is_function, cyc)), 6).alias("mean_cyclomatic"), F.max(F.when(is_function, cyc)).alias("max_cyclomatic"), F.max(F.when(is_function, F.struct(cyc.alias("c"), (-F.col("ordinal")).alias("o"), "name"))).alias("_m"),
    )
    return g.select("file", "classes", "functions", "methods", "mean_cyclomatic", "max_cyclomatic", F.col("_m.name").alias("most_complex"))


def ownership_context(scores: DataFrame, files: DataFrame, limit: int = 3) -> DataFrame:
    """(file, text): up to three developers of each file with score and commits, and how many could stand in."""
    w = Window.partitionBy("file").orderBy(F.col("total").desc(), "email")
    first = scores.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit)
    told = F.concat("email", F.lit(" "), F.format_number("total", 2), F.lit(" ("), F.coalesce("commits", F.lit(0)).cast("string"), F.lit(" commits)"))
    listed = first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", told.alias("t")))), lambda x: x["t"]), ", ").alias("_t"))
    bus = scores.groupBy("file").agg(F.count_if(F.col("total") >= 0.6).alias("_bus"))
    return files.select("file").distinct().join(listed, "file", "left").join(bus, "file", "left").select("file", F.when(F.col("_t").isNull(), "nobody known").otherwise(F.concat(F.col("_t"), F.lit("; bus factor "), F.coalesce("_bus", F.lit(0)).cast("string"))).alias("text"))


def complexity_hints(cyclomatic: Column, cognitive: Column, lines: Column) -> Column:
    """Advice above 10 cyclomatic, 15 cognitive, 50 lines."""
    return F.array_join(F.array_compact(F.array(F.when(cyclomatic > 10, "break it into smaller pieces"), F.when(cognitive > 15, "simplify nested logic"), F.when(lines > 50, "extract helpers"))), "; ")


def complexity_context(entities: DataFrame) -> DataFrame:
    """(node, name, cyclomatic, cognitive, lines, band, hints) of every entity whose complexity is known."""
    c = lambda x: F.coalesce(F.col(f"complexity.{x}"), F.lit(0))
    known = entities.where(F.col("complexity").isNotNull())
    return known.select(F.col("uid").alias("node"), "name", c("cyclomatic").alias("cyclomatic"), c("cognitive").alias("cognitive"), c("lines_of_code").alias("lines"), risk.complexity_band(c("cyclomatic")).alias("band"), complexity_hints(c("cyclomatic"), c("cognitive"), c("lines_of_code")).alias("hints"))


def hotspots(entities: DataFrame, limit: int = 5) -> DataFrame:
    """The `limit` most complex functions, the first loaded of equals, with how many there are, their mean and how many are above 5."""
    scored = entities.where((F.col("entity_type") == "function") & (F.col("complexity.cyclomatic") > 0)).select("uid", "name", F.col("file_path").alias("file"), F.col("complexity.cyclomatic").alias("cyclomatic"), "ordinal")
    all_ = scored.agg(F.count("*").alias("functions"), F.round(F.avg("cyclomatic"), 6).alias("mean"), F.count_if(F.col("cyclomatic") > 5).alias("above_5"))  # one row
    top = scored.orderBy(F.col("cyclomatic").desc(), "ordinal").limit(limit)
    return top.join(F.broadcast(all_)).select(F.col("uid").alias("node"), "name", "file", "cyclomatic", risk.complexity_band(F.col("cyclomatic")).alias("band"), "functions", "mean", "above_5")


def governance_context(checked: DataFrame, violations: int = 8, warnings: int = 5) -> DataFrame:
    """(severity, place, text): the first 8 violations and 5 warnings by path, line and module."""
    bad = checked.where(F.col("verdict") != "ALLOW")
    w = Window.partitionBy("verdict").orderBy("from_path", "line", "to_module")
    most = F.when(F.col("verdict") == "BLOCK", violations).otherwise(warnings)
    text = F.concat_ws(" ", F.concat_ws(":", "from_path", F.col("line").cast("string")), F.lit("imports"), "to_module", F.concat(F.lit("("), F.coalesce("from_layer", F.lit("none")), F.lit(" -> "), F.coalesce("to_layer", F.lit("none")), F.lit(")")))
    return bad.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(F.col("verdict").alias("severity"), "place", text.alias("text"))


#: Which parts of the context each intent asks for, beside the entities themselves.
ROUTES = {
    "blast_radius": ("entities", "impact"), "governance": ("governance",), "expertise": ("entities", "ownership"), "complexity": ("entities", "complexity", "hotspots"), "general": ("entities",),
}


def route(intent: Column) -> Column:
    """The parts of the context for an intent; unknown ones are general."""
    out = F.array(*[F.lit(x) for x in ROUTES["general"]])
    for k, parts in ROUTES.items():
        out = F.when(intent == k, F.array(*[F.lit(x) for x in parts])).otherwise(out)
    return out
