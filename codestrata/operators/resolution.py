"""Calls resolved to entities by an ordered cascade, and typed relations between entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.paths import compared_path
from codestrata.session import cut

#: Type names that are no dependency.
BUILTIN_TYPES = ["int", "str", "float", "bool", "none", "any", "list", "dict", "set", "tuple", "optional", "union", "callable"]


def _imports(imports: DataFrame) -> DataFrame:
    return imports.where(F.col("to_module").isNotNull() & (F.col("to_module") != "")).select(compared_path("from_path").alias("file"), F.col("to_module").alias("module"), F.filter(F.coalesce("imported_names", F.array().cast("array<string>")), lambda n: n.isNotNull() & (n != "")).alias("names"), F.nullif("alias", F.lit("")).alias("alias"), F.coalesce("is_star", F.lit(False)).alias("is_star"))


def module_aliases(imports: DataFrame) -> DataFrame:
    """(file, alias, module): an alias stands for its module; a plain import without one has its first part stand for itself."""
    i = _imports(imports)
    aliased = i.where(F.col("alias").isNotNull()).select("file", "alias", "module")
    first = F.substring_index("module", ".", 1)
    plain = i.where(F.col("alias").isNull() & (F.size("names") == 0) & ~F.col("is_star")).select("file", first.alias("alias"), first.alias("module"))
    return aliased.unionByName(plain).where(F.col("alias") != "").groupBy("file", "alias").agg(F.max("module").alias("module"))


def imported_names(imports: DataFrame) -> DataFrame:
    """(file, name, target) of names imported from modules: the name stands for module.name."""
    names = _imports(imports).where(F.col("alias").isNull()).select("file", "module", F.explode("names").alias("name")).where(F.col("name") != "*")
    return names.groupBy("file", "name").agg(F.max(F.concat_ws(".", "module", "name")).alias("target"))


def star_imports(imports: DataFrame) -> DataFrame:
    """(file, module) of modules from which a file imports all names."""
    i = _imports(imports)
    return i.where(F.col("is_star") | F.array_contains("names", "*")).select("file", "module").distinct()


def resolve_cascade(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, call, target, confidence, how) of every distinct call of a function; unresolved ones with a null target.

    Tiers, first hit counts: through self a method of the own class (1.0), else of the first of its bases that has it (0.9);
    through super the method of the first base (0.95); a known class (1.0); a dotted call whose head is an imported module:
    an entity of that name whose file or id holds the module (0.9), else external (0.7); other dotted calls by what follows
    the first dot (0.6); a direct call of an imported name (0.9, external 0.7), of the same file (1.0), anywhere (0.8). A
    class is the last one loaded of its name, other look-ups take the first. Every look-up has one row per key before it
    is joined, so no tier multiplies rows.
    """
    e = entities.where(F.col("name").isNotNull() & (F.col("name") != ""))
    first = lambda d, *keys: d.groupBy(*keys).agg(F.min(F.struct("ordinal", "uid")).alias("r"))
    by_name = first(e, "name").select("name", F.col("r.uid").alias("target"))
    by_file = first(e, "file_path", "name").select(F.col("file_path").alias("_file"), F.col("name").alias("_call"), F.col("r.uid").alias("t_file"))
    classes = e.where(F.col("entity_type") == "class").groupBy("name").agg(F.max(F.struct("ordinal", "uid", "bases")).alias("r"))
    known = classes.select(F.col("name").alias("_cls"), F.col("r.uid").alias("t_class"))
    own = classes.select(F.col("name").alias("_cn"), F.col("r.bases").alias("_bases"))
    methods = first(e.where(F.col("parent_class").isNotNull()), "parent_class", "name").select(F.col("parent_class").alias("_owner"), F.col("name").alias("_m"), F.col("r.ordinal").alias("_at"), F.col("r.uid").alias("t_method"))
    modules = module_aliases(imports).select(F.col("file").alias("_if"), F.col("alias").alias("_ia"), F.col("module").alias("t_module"))
    names = imported_names(imports).select(F.col("file").alias("_nf"), F.col("name").alias("_nn"), F.col("target").alias("t_import"))
    calls = e.where(F.col("entity_type") == "function").select("uid", "file_path", "parent_class", F.explode("calls").alias("call")).where(F.col("call").isNotNull() & (F.col("call") != "")).distinct()
    text = F.substring_index("call", "(", 1)
    is_self, is_super = F.col("call").startswith("self."), F.col("call").startswith("super(")
    after_super = F.when(F.contains("call", F.lit("().")), F.substring_index(F.split_part("call", F.lit("()."), F.lit(2)), "(", 1)).otherwise(F.lit("__init__"))
    c = calls.select("*", is_self.alias("is_self"), is_super.alias("is_super"), F.when(is_self, F.substring_index(F.substr("call", F.lit(6)), "(", 1)).when(is_super, after_super).otherwise(text).alias("name_"))
    c = c.select("*", F.substring_index("name_", ".", 1).alias("head"), F.contains("name_", F.lit(".")).alias("dotted")).withColumn("rest", F.when(F.col("dotted"), F.substr("name_", F.length("head") + 2)))
    c = c.join(own, F.col("parent_class") == F.col("_cn"), "left").drop("_cn")
    self_id = F.concat(F.col("file_path"), F.lit(":"), F.col("parent_class"), F.lit("."), F.col("name_"))
    ids = e.select(F.col("uid").alias("t_self"))
    c = cut(c.withColumn("_id", F.when(F.col("is_self"), self_id)).join(ids, F.col("_id") == F.col("t_self"), "left"))
    asked = c.where((F.col("is_self") & F.col("t_self").isNull()) | F.col("is_super")).select("uid", "call", "name_", "is_super", F.posexplode("_bases").alias("_pos", "_b")).where(F.col("_b").isNotNull() & (~F.col("is_super") | (F.col("_pos") == 0)))
    inherited = asked.join(methods, (F.col("_b") == F.col("_owner")) & (F.col("name_") == F.col("_m"))).groupBy("uid", "call").agg(F.min(F.struct("_pos", "_at", "t_method")).alias("_r")).select("uid", "call", F.col("_r.t_method").alias("t_base"))
    c = c.drop("_bases", "_id").join(inherited, ["uid", "call"], "left").join(known, F.col("name_") == F.col("_cls"), "left").drop("_cls")
    c = c.join(modules, F.col("dotted") & (F.col("file_path") == F.col("_if")) & (F.col("head") == F.col("_ia")), "left").drop("_if", "_ia")
    # Of the entities that a module's call may mean, one for each distinct (module, rest).
    wanted = c.where(F.col("t_module").isNotNull()).select("t_module", "rest").distinct()
    within = wanted.join(e.select(F.col("name").alias("rest"), "uid", "file_path", "ordinal"), "rest").where(F.contains(F.coalesce("file_path", F.lit("")), F.col("t_module")) | F.contains("uid", F.col("t_module")))
    aliased = within.groupBy("t_module", "rest").agg(F.min(F.struct("ordinal", "uid")).alias("_r")).select("t_module", "rest", F.col("_r.uid").alias("t_alias"))
    c = c.join(aliased, ["t_module", "rest"], "left")
    c = c.join(by_name.select(F.col("name").alias("rest"), F.col("target").alias("t_rest")), "rest", "left").join(by_name.select(F.col("name").alias("name_"), F.col("target").alias("t_name")), "name_", "left")
    c = c.join(by_file, (F.col("file_path") == F.col("_file")) & (F.col("name_") == F.col("_call")), "left").join(names, (F.col("file_path") == F.col("_nf")) & (F.col("name_") == F.col("_nn")), "left")
    dotted = F.col("dotted")
    hit = lambda target, confidence, how: F.struct(target.alias("target"), F.lit(confidence).alias("confidence"), F.lit(how).alias("how"))
    r = (
        F.when(F.col("is_self"), F.when(F.col("t_self").isNotNull(), hit(F.col("t_self"), 1.0, "self")).when(F.col("t_base").isNotNull(), hit(F.col("t_base"), 0.9, "inherited")))
        .when(F.col("is_super"), F.when(F.col("t_base").isNotNull(), hit(F.col("t_base"), 0.95, "super")))
        .when(F.col("t_class").isNotNull(), hit(F.col("t_class"), 1.0, "instantiation"))
        .when(dotted & F.col("t_alias").isNotNull(), hit(F.col("t_alias"), 0.9, "import_alias"))
        .when(dotted & F.col("t_module").isNotNull(), hit(F.concat_ws(".", "t_module", "rest"), 0.7, "external"))
        .when(dotted, F.when(F.col("t_rest").isNotNull(), hit(F.col("t_rest"), 0.6, "object_method")))
        .when(F.col("t_import").isNotNull(), F.when(F.col("t_name").isNotNull(), hit(F.col("t_name"), 0.9, "import")).otherwise(hit(F.col("t_import"), 0.7, "external")))
        .when(F.col("t_file").isNotNull(), hit(F.col("t_file"), 1.0, "direct"))
        .when(F.col("t_name").isNotNull(), hit(F.col("t_name"), 0.8, "global"))
    )
    return c.select(F.col("uid").alias("source"), "call", r.alias("r")).select("source", "call", "r.target", F.coalesce("r.confidence", F.lit(0.5)).alias("confidence"), F.coalesce("r.how", F.lit("unresolved")).alias("how"))


def call_relations(resolved: DataFrame) -> DataFrame:
    """(source, target, type, weight) of resolved calls: CALLS, or INSTANTIATES of classes; unresolved calls keep their text with weight 0.5."""
    kind = F.when(F.col("how") == "instantiation", "INSTANTIATES").otherwise("CALLS")
    return resolved.groupBy("source", F.coalesce("target", "call").alias("target"), kind.alias("type")).agg(F.max("confidence").alias("weight"), F.count("*").alias("calls"))


def type_names(annotation: Column) -> Column:
    parts = F.split(F.regexp_replace(annotation, r"[\[\],|]", " "), r"\s+")
    return F.filter(F.array_distinct(parts), lambda p: (p != "") & ~p.startswith("...") & ~F.lower(p).isin(*BUILTIN_TYPES))


def relations(entities: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, target, type) without repeats: CONTAINS, IMPORTS, IMPORTS_FROM, DECORATES, RETURNS_TYPE, USES_TYPE, INHERITS, IMPLEMENTS, OVERRIDES, READS_GLOBAL and WRITES_GLOBAL."""
    functions, classes = entities.where(F.col("entity_type") == "function"), entities.where(F.col("entity_type") == "class")
    row = lambda d, s, t, kind: d.select(s.alias("source"), t.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))
    each = lambda d, column: d.select("uid", F.explode(column).alias("x")).where(F.col("x").isNotNull() & (F.col("x") != ""))
    uid, x = F.col("uid"), F.col("x")
    i = imports.where(F.col("to_module").isNotNull()).select(compared_path("from_path").alias("uid"), "to_module", "imported_names")
    base = F.substring_index(x, "[", 1)
    protocol = base.isin("ABC", "Protocol") | base.endswith("Protocol")
    methods = classes.select("uid", "name", F.col("bases"), F.explode("methods").alias("m")).where(~F.col("m").startswith("_") | F.col("m").startswith("__"))
    above = classes.groupBy("name").agg(F.max(F.struct("ordinal", "uid", "methods")).alias("r")).select(F.col("name").alias("_b"), F.col("r.uid").alias("_bu"), F.explode("r.methods").alias("_bm"))
    overrides = methods.select("uid", "m", F.explode("bases").alias("_base")).join(above, (F.col("_base") == F.col("_b")) & (F.col("m") == F.col("_bm")))
    parts = [
        row(entities.where(F.col("file_path").isNotNull() & ((F.col("entity_type") == "class") | F.col("parent_class").isNull())), F.col("file_path"), uid, "CONTAINS"),
        row(i, uid, F.col("to_module"), "IMPORTS"),
        row(i.select("uid", F.explode(F.transform("imported_names", lambda n: F.concat_ws(".", "to_module", n))).alias("x")), uid, x, "IMPORTS_FROM"),
        row(each(entities, "decorators"), x, uid, "DECORATES"),
        row(each(functions, type_names(F.col("return_type"))), uid, x, "RETURNS_TYPE"),
        row(each(functions, F.flatten(F.transform(F.filter("parameters", lambda p: p["type_hint"].isNotNull()), lambda p: type_names(p["type_hint"])))), uid, x, "USES_TYPE"),
        row(each(classes, "bases"), uid, x, F.when(protocol, "IMPLEMENTS").otherwise("INHERITS")),
        row(overrides, F.concat("uid", F.lit("."), "m"), F.concat("_bu", F.lit("."), "m"), "OVERRIDES"),
        row(each(functions, "reads_globals"), uid, x, "READS_GLOBAL"),
        row(each(functions, "writes_globals"), uid, x, "WRITES_GLOBAL"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def decorations(entities: DataFrame) -> DataFrame:
    """(decorator, target, line) of every decorator of an entity: it stands on the line before the entity's first."""
    d = entities.select("uid", F.try_element_at("line_range", F.lit(1)).alias("_first"), F.explode("decorators").alias("decorator")).where(F.col("decorator").isNotNull() & (F.col("decorator") != ""))
    return d.select("decorator", F.col("uid").alias("target"), (F.col("_first") - 1).alias("line")).distinct()


def lookup(entities: DataFrame, text: str) -> DataFrame:
    """(uid, tier) of what a typed identifier may mean, best tier only: id, name, text after the last ':', suffix; more than one row is ambiguous."""
    wanted = compared_path(F.lit(text))
    tail = F.element_at(F.split("uid", ":"), -1)
    low = F.lower(wanted)
    tier = (
        F.when(F.col("uid") == wanted, 1).when(F.col("name") == wanted, 2).when(tail == wanted, 3).when(F.lower("uid") == low, 4).when(F.lower("name") == low, 5)
        .when(F.lower("uid").endswith(F.concat(F.lit(":"), low)) | F.lower("uid").endswith(F.concat(F.lit("."), low)) | F.lower("uid").endswith(F.concat(F.lit("/"), low)), 6)
    )
    hits = entities.select("uid", tier.alias("tier")).where(F.col("tier").isNotNull())
    return hits.join(hits.agg(F.min("tier").alias("tier")), "tier").select("uid", "tier")


def suggest(entities: DataFrame, text: str, limit: int = 5) -> DataFrame:
    """(uid, name): up to five entities whose id or name holds the text, shortest id first: what to offer where nothing is meant exactly."""
    low = F.lower(compared_path(F.lit(text)))
    hits = entities.where((F.contains(F.lower("uid"), low) | F.contains(F.lower(F.coalesce("name", F.lit(""))), low)) & (low != "")).select("uid", "name").distinct()
    return hits.orderBy(F.length("uid"), "uid").limit(limit)


def find_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(text) -> (text, node): the node of that key, else the least that ends with .text or :text.

    Suffixes of the keys, from each dot and colon on, are looked up by equality, so no pair of text and key is formed that
    doesn't match.
    """
    ask = wanted.select("text").where(F.col("text").isNotNull() & (F.col("text") != "")).distinct()
    exact = nodes.select(F.col("node").alias("text"), "node")
    # Every place after a separator starts a suffix.
    ends = nodes.select("node", F.explode(F.filter(F.sequence(F.lit(2), F.greatest(F.length("node"), F.lit(2))), lambda i: F.substr("node", i - 1, F.lit(1)).isin(".", ":"))).alias("_i")).select(F.substr("node", F.col("_i")).alias("text"), "node")
    hits = ask.join(exact, "text").withColumn("_t", F.lit(1)).unionByName(ask.join(ends, "text").withColumn("_t", F.lit(2)))
    return hits.groupBy("text").agg(F.min(F.struct("_t", "node")).alias("_r")).select("text", F.col("_r.node").alias("node"))


def find_metrics(metrics: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(file), metrics(path, ordinal, ...) -> (file, path, tier) of the row meant: the same path (1), one the end of the other (2), the same name (3); the first loaded of equals.

    Ends of paths are looked up by equality, and each end or name leads to one row only, so a name that a third of all files
    have is no pair of them.
    """
    first = lambda d, key: d.groupBy(key).agg(F.min(F.struct("ordinal", "path")).alias("_r"))
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/"))
    ask = cut(wanted.select(compared_path("file").alias("file")).where(F.col("file") != "").distinct())
    have = cut(metrics.select(compared_path("path").alias("path"), "ordinal").where(F.col("path") != ""))
    hit = lambda d, tier: d.select("file", F.struct(tier.alias("tier"), F.col("_r.ordinal").alias("ordinal"), F.col("_r.path").alias("path")).alias("_h"))
    same = hit(ask.join(first(have.withColumn("file", F.col("path")), "file"), "file"), F.lit(1))
    longer = hit(ask.join(first(have.select(F.explode(F.slice(ends(F.col("path")), F.lit(2), F.lit(1_000_000))).alias("file"), "path", "ordinal"), "file"), "file"), F.lit(2))
    mine = ask.select("file", F.explode(F.slice(ends(F.col("file")), F.lit(2), F.lit(1_000_000))).alias("_end"))
    shorter = hit(mine.join(first(have.withColumn("_end", F.col("path")), "_end"), "_end"), F.lit(2))
    named = hit(ask.withColumn("_name", F.element_at(F.split("file", "/"), -1)).join(first(have.withColumn("_name", F.element_at(F.split("path", "/"), -1)), "_name"), "_name"), F.lit(3))
    best = same.unionByName(longer).unionByName(shorter).unionByName(named).groupBy("file").agg(F.min("_h").alias("_h"))
    return best.select("file", "_h.path", "_h.tier")


def merge_nodes(stored: DataFrame, raw: DataFrame, key: str = "uid") -> DataFrame:
    """stored with what raw knows beside it: an attribute of the store counts, else that of the raw entity."""
    both = [c for c in stored.columns if c in raw.columns and c != key]
    joined = stored.join(raw.select(key, *[F.col(c).alias(f"_raw_{c}") for c in both], *[c for c in raw.columns if c not in stored.columns]), key, "left")
    merged = [F.coalesce(c, f"_raw_{c}").alias(c) if c in both else F.col(c) for c in stored.columns]
    return joined.select(*merged, *[c for c in raw.columns if c not in stored.columns])
