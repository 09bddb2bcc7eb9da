"""Queries over resolved calls, typed relations and parsed sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import resolution as X
from codestrata.operators.parsing import parse_files
from codestrata.operators.records import current_records
from codestrata.plans.parse_expected import COLUMNS, ROWS
from codestrata.plans.tables import CURRENT_SQL, table
from codestrata.session import cut

_COLUMNS = ["line_range", "ordinal", "entity_type", "name", "calls", "bases", "methods", "parent_class", "decorators", "return_type", "parameters", "reads_globals", "writes_globals"]

#: A small package in three languages for the parsers.
SOURCES = [
    ("pkg/store.py", '"""Keeps rows."""\nimport os\nimport numpy as np\nfrom .base import Base as B\nfrom ..util import *\n\n__all__ = ["Store", "load"]\nLIMIT = 3\ncount: int = 0\n\n# one comment\n\nclass Store(Base, metaclass=ABCMeta):\n    """A store."""\n\n    kind = "rows"\n\n    def __init__(self, path: str, *rest, size=LIMIT, **more):\n        super().__init__()\n        self.path = path\n        self.rows = []\n\n    @property\n    def full(self) -> bool:\n        return len(self.rows) >= LIMIT and os.path.exists(self.path)\n\n    @staticmethod\n    def make(n: int = 3):\n        return [Store(str(i)) for i in range(n) if i]\n\n    class Inner:\n        pass\n\n\nasync def load(path):\n    """Read all rows."""\n    global count\n    count = 1\n    async for row in read(path):\n        if row:\n            await tick()\n            yield Store(row)\n        else:\n            break\n\n\ndef walk(n):\n    with open(n) as f:\n        try:\n            while n > 0:\n                n = walk(n - 1) if n > 1 or f else 0\n        except OSError:\n            assert n\n    return lambda x: x\n'),
    ("pkg/Reader.java", "package pkg;\nimport java.util.List;\nimport static java.lang.Math.*;\n\n/* a\n   b */\n@Deprecated\npublic class Reader extends Base implements Closer, Other {\n  private static final int MAX = 3;\n  String name, other;\n  // one row\n  public static int read(final String path, int... at) throws IOException, Odd {\n    if (path == null || at.length > 1) { return this.none(); }\n    for (int i = 0; i < 3; i++) { if (i > 1) { continue; } else { other.go(i); } }\n    return 0;\n  }\n  abstract void later(int n);\n  @Override\n  protected String text() { return \"a{b\"; }\n  enum Kind { A, B }\n}\n\ninterface Closer { void close(); }\n"),
    ("pkg/walk.cpp", '#include "walk.h"\n#include <vector>\nnamespace geo {\nstruct Walk : public Base {\n  int step(int n) const { while (n > 0) { n = next(n); } return n; }\n  double size;\n};\nclass Path {\n  int hidden;\npublic:\n  static int count();\n};\nint Path::count() { return a.b() && c->d() ? 1 : 2; }\n}\n'),
    ("pkg/broken.py", "def f(:\n"),
]


def _entities(spark, sf_dir):
    return cut(current_records(table(spark, sf_dir, "repo_graph"), _COLUMNS))


def resolve_cascade(spark, sf_dir):
    return X.resolve_cascade(_entities(spark, sf_dir), table(spark, sf_dir, "imports"))


def call_relations(spark, sf_dir):
    return X.call_relations(resolve_cascade(spark, sf_dir))


def star_imports(spark, sf_dir):
    return X.star_imports(table(spark, sf_dir, "imports"))


def relation_edges(spark, sf_dir):
    return X.relations(_entities(spark, sf_dir), table(spark, sf_dir, "imports"))


def relation_counts(spark, sf_dir):
    return relation_edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def decorations(spark, sf_dir):
    return X.decorations(_entities(spark, sf_dir))


def entity_lookup(spark, sf_dir):
    return X.lookup(_entities(spark, sf_dir), "__INIT__").select("uid", "tier")


def entity_suggestions(spark, sf_dir):
    return X.suggest(_entities(spark, sf_dir), "scorer")


def find_nodes(spark, sf_dir):
    """Every distinct call, cut at its bracket, as a typed node."""
    e = _entities(spark, sf_dir)
    calls = e.select(F.explode("calls").alias("c")).select(F.substring_index("c", "(", 1).alias("text"))
    return X.find_nodes(e.select(F.col("uid").alias("node")), calls)


def find_metrics(spark, sf_dir):
    """Files of commits among those of entities."""
    metrics = _entities(spark, sf_dir).where(F.col("file_path").isNotNull()).groupBy(F.col("file_path").alias("path")).agg(F.min("ordinal").alias("ordinal"))
    return X.find_metrics(metrics, table(spark, sf_dir, "commits").select(F.explode("files_changed").alias("file")))


def parse_sources(spark, sf_dir):
    """The fixture's entities, imports and modules; what doesn't apply to a kind is empty."""
    p = parse_files(spark.createDataFrame(SOURCES, "path string, content string"))
    listed = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parameters = F.array_join(F.transform("parameters", lambda x: F.concat_ws(":", F.concat(F.when(x["is_args"], "*").when(x["is_kwargs"], "**").otherwise(""), x["name"]), x["type_hint"], F.concat(F.lit("="), x["default_value"]))), ",")
    flags = F.concat_ws(",", *[F.when(F.col(f"is_{x}"), x) for x in ("async", "generator", "method", "static", "classmethod", "property", "abstract", "dataclass", "protocol", "interface", "constant", "relative", "star")], F.when(F.col("has_await"), "await"))
    return p.select("kind", "file", *[plain(c) for c in ("unique_id", "name", "line", "end_line", "signature", "return_type", "docstring", "visibility", "parent_class", "metaclass", "cyclomatic", "cognitive", "lines_of_code", "module", "alias", "relative_level", "import_type", "total_lines", "code_lines", "comment_lines", "blank_lines", "parse_success")],
                    *[listed(c) for c in ("decorators", "throws", "calls", "reads_globals", "writes_globals", "bases", "methods", "class_variables", "instance_variables", "nested_classes", "imported_names", "local_definitions")], F.coalesce(parameters, F.lit("")).alias("parameters"), flags.alias("flags"))


QUERIES = {f.__name__: f for f in (resolve_cascade, call_relations, star_imports, relation_edges, relation_counts, decorations, entity_lookup, entity_suggestions, find_nodes, find_metrics, parse_sources)}

_TYPES = "list_filter(list_distinct(regexp_split_to_array(regexp_replace({0}, '[\\[\\],|]', ' ', 'g'), '\\s+')), lambda p: p <> '' AND NOT starts_with(p, '...') AND lower(p) NOT IN (" + ", ".join(f"'{t}'" for t in X.BUILTIN_TYPES) + "))"
_REL = rf"""{CURRENT_SQL},
imp AS (SELECT regexp_replace(replace(from_path, '\', '/'), '^(\./)+', '') AS f, to_module AS m, imported_names FROM imports WHERE to_module IS NOT NULL),
b AS (SELECT uid, unnest(bases) AS x FROM cur WHERE entity_type = 'class'),
above AS (SELECT b, bu, unnest(ms) AS bm FROM (SELECT name AS b, arg_max(uid, ordinal) AS bu, arg_max(methods, ordinal) AS ms FROM cur WHERE entity_type = 'class' GROUP BY name)),
mine AS (SELECT uid, m, unnest(bases) AS base FROM (SELECT uid, bases, unnest(methods) AS m FROM cur WHERE entity_type = 'class') WHERE NOT starts_with(m, '_') OR starts_with(m, '__')),
rel AS (
  SELECT fpath AS source, uid AS target, 'CONTAINS' AS type FROM cur WHERE fpath IS NOT NULL AND (entity_type = 'class' OR (entity_type IN ('class', 'function') AND parent_class IS NULL))
  UNION SELECT f, m, 'IMPORTS' FROM imp
  UNION SELECT f, concat_ws('.', m, n), 'IMPORTS_FROM' FROM (SELECT f, m, unnest(imported_names) AS n FROM imp)
  UNION SELECT x, uid, 'DECORATES' FROM (SELECT uid, unnest(decorators) AS x FROM cur) WHERE x IS NOT NULL AND x <> ''
  UNION SELECT uid, unnest({_TYPES.format('return_type')}), 'RETURNS_TYPE' FROM cur WHERE entity_type = 'function' AND return_type IS NOT NULL
  UNION SELECT uid, unnest({_TYPES.format('h')}), 'USES_TYPE' FROM (SELECT uid, unnest(list_transform(parameters, lambda p: p.type_hint)) AS h FROM cur WHERE entity_type = 'function') WHERE h IS NOT NULL
  UNION SELECT uid, x, CASE WHEN split_part(x, '[', 1) IN ('ABC', 'Protocol') OR ends_with(split_part(x, '[', 1), 'Protocol') THEN 'IMPLEMENTS' ELSE 'INHERITS' END FROM b WHERE x IS NOT NULL AND x <> ''
  UNION SELECT uid || '.' || m, bu || '.' || m, 'OVERRIDES' FROM mine JOIN above ON mine.base = above.b AND mine.m = above.bm
  UNION SELECT uid, x, 'READS_GLOBAL' FROM (SELECT uid, unnest(reads_globals) AS x FROM cur WHERE entity_type = 'function') WHERE x IS NOT NULL AND x <> ''
  UNION SELECT uid, x, 'WRITES_GLOBAL' FROM (SELECT uid, unnest(writes_globals) AS x FROM cur WHERE entity_type = 'function') WHERE x IS NOT NULL AND x <> '')"""

_RESOLVED = rf"""{CURRENT_SQL}, e AS (SELECT * FROM cur WHERE name IS NOT NULL AND name <> ''),
im AS (SELECT regexp_replace(replace(from_path, '\', '/'), '^(\./)+', '') AS f, to_module AS m, list_filter(coalesce(imported_names, []), lambda x: x IS NOT NULL AND x <> '') AS ns, nullif(alias, '') AS alias, coalesce(is_star, false) AS star FROM imports WHERE to_module IS NOT NULL AND to_module <> ''),
mo AS (SELECT f, a, max(m) AS m FROM (SELECT f, coalesce(alias, split_part(m, '.', 1)) AS a, CASE WHEN alias IS NOT NULL THEN m ELSE split_part(m, '.', 1) END AS m FROM im WHERE alias IS NOT NULL OR (len(ns) = 0 AND NOT star)) WHERE a <> '' GROUP BY f, a),
nm AS (SELECT f, n, max(m || '.' || n) AS t FROM (SELECT f, m, unnest(ns) AS n FROM im WHERE alias IS NULL) WHERE n <> '*' GROUP BY f, n),
bn AS (SELECT name, arg_min(uid, ordinal) AS t FROM e GROUP BY name), bf AS (SELECT fpath, name, arg_min(uid, ordinal) AS t FROM e GROUP BY ALL),
cl AS (SELECT name, arg_max(uid, ordinal) AS t, arg_max(coalesce(bases, []), ordinal) AS bases FROM e WHERE entity_type = 'class' GROUP BY name),
me AS (SELECT parent_class, name, min(ordinal) AS at, arg_min(uid, ordinal) AS t FROM e WHERE parent_class IS NOT NULL GROUP BY ALL),
c0 AS (SELECT DISTINCT uid, fpath, parent_class, call FROM (SELECT uid, fpath, parent_class, unnest(calls) AS call FROM e WHERE entity_type = 'function') WHERE call IS NOT NULL AND call <> ''),
c1 AS (SELECT *, starts_with(call, 'self.') AS s, starts_with(call, 'super(') AS u, CASE WHEN starts_with(call, 'self.') THEN split_part(substr(call, 6), '(', 1) WHEN starts_with(call, 'super(') THEN CASE WHEN contains(call, '().') THEN split_part(split_part(call, '().', 2), '(', 1) ELSE '__init__' END
  ELSE split_part(call, '(', 1) END AS n FROM c0),
c2 AS (SELECT c1.*, split_part(n, '.', 1) AS head, contains(n, '.') AS d, CASE WHEN contains(n, '.') THEN substr(n, length(split_part(n, '.', 1)) + 2) END AS rest, cl.bases AS bs FROM c1 LEFT JOIN cl ON c1.parent_class = cl.name),
c3 AS (SELECT c2.*, x.uid AS t_self, mo.m AS t_module FROM c2 LEFT JOIN e x ON c2.s AND x.uid = c2.fpath || ':' || c2.parent_class || '.' || c2.n LEFT JOIN mo ON c2.d AND mo.f = c2.fpath AND mo.a = c2.head),
ba AS (SELECT uid, call, n, u, unnest(bs) AS b, unnest(range(len(bs))) AS pos FROM c3 WHERE (s AND t_self IS NULL) OR u),
ih AS (SELECT uid, call, arg_min(me.t, (pos, me.at)) AS t FROM ba JOIN me ON ba.b = me.parent_class AND ba.n = me.name WHERE NOT u OR pos = 0 GROUP BY ALL),
al AS (SELECT w.t_module, w.rest, arg_min(e.uid, e.ordinal) AS t FROM (SELECT DISTINCT t_module, rest FROM c3 WHERE t_module IS NOT NULL) w JOIN e ON e.name = w.rest WHERE contains(coalesce(e.fpath, ''), w.t_module) OR contains(e.uid, w.t_module) GROUP BY ALL),
j AS (SELECT c3.*, ih.t AS t_base, cl.t AS t_class, b1.t AS t_name, b2.t AS t_rest, bf.t AS t_file, nm.t AS t_import, al.t AS t_alias FROM c3 LEFT JOIN ih ON ih.uid = c3.uid AND ih.call = c3.call LEFT JOIN cl ON cl.name = c3.n LEFT JOIN bn b1 ON b1.name = c3.n LEFT JOIN bn b2 ON b2.name = c3.rest
  LEFT JOIN bf ON bf.fpath = c3.fpath AND bf.name = c3.n LEFT JOIN nm ON nm.f = c3.fpath AND nm.n = c3.n LEFT JOIN al ON al.t_module = c3.t_module AND al.rest = c3.rest),
h AS (SELECT *, CASE WHEN s THEN CASE WHEN t_self IS NOT NULL THEN 'self' WHEN t_base IS NOT NULL THEN 'inherited' ELSE 'unresolved' END WHEN u THEN CASE WHEN t_base IS NOT NULL THEN 'super' ELSE 'unresolved' END WHEN t_class IS NOT NULL THEN 'instantiation'
  WHEN d AND t_alias IS NOT NULL THEN 'import_alias' WHEN d AND t_module IS NOT NULL THEN 'external' WHEN d AND t_rest IS NOT NULL THEN 'object_method' WHEN d THEN 'unresolved'
  WHEN t_import IS NOT NULL AND t_name IS NOT NULL THEN 'import' WHEN t_import IS NOT NULL THEN 'external' WHEN t_file IS NOT NULL THEN 'direct' WHEN t_name IS NOT NULL THEN 'global' ELSE 'unresolved' END AS how FROM j),
resolved AS (SELECT uid AS source, call, how, CASE how WHEN 'self' THEN t_self WHEN 'inherited' THEN t_base WHEN 'super' THEN t_base WHEN 'instantiation' THEN t_class WHEN 'import_alias' THEN t_alias WHEN 'external' THEN CASE WHEN d THEN t_module || '.' || rest ELSE t_import END
    WHEN 'object_method' THEN t_rest WHEN 'import' THEN t_name WHEN 'direct' THEN t_file WHEN 'global' THEN t_name END AS target,
  CASE how WHEN 'self' THEN 1.0 WHEN 'inherited' THEN 0.9 WHEN 'super' THEN 0.95 WHEN 'instantiation' THEN 1.0 WHEN 'import_alias' THEN 0.9 WHEN 'external' THEN 0.7 WHEN 'object_method' THEN 0.6 WHEN 'import' THEN 0.9 WHEN 'direct' THEN 1.0 WHEN 'global' THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM h)"""

SQL = {
    "resolve_cascade": f"WITH {_RESOLVED} SELECT source, call, target, confidence, how FROM resolved",
    "call_relations": f"WITH {_RESOLVED} SELECT source, coalesce(target, call) AS target, CASE WHEN how = 'instantiation' THEN 'INSTANTIATES' ELSE 'CALLS' END AS type, max(confidence) AS weight, count(*) AS calls FROM resolved GROUP BY ALL",
    "star_imports": rf"SELECT DISTINCT regexp_replace(replace(from_path, '\', '/'), '^(\./)+', '') AS file, to_module AS module FROM imports WHERE to_module <> '' AND (coalesce(is_star, false) OR list_contains(imported_names, '*'))",
    "relation_edges": f"WITH {_REL} SELECT * FROM rel",
    "relation_counts": f"WITH {_REL} SELECT type, count(*) AS n FROM rel GROUP BY type",
    "entity_lookup": rf"""WITH {CURRENT_SQL}, t AS (SELECT uid, CASE WHEN uid = '__INIT__' THEN 1 WHEN name = '__INIT__' THEN 2 WHEN split_part(uid, ':', -1) = '__INIT__' THEN 3 WHEN lower(uid) = '__init__' THEN 4 WHEN lower(name) = '__init__' THEN 5
  WHEN ends_with(lower(uid), ':__init__') OR ends_with(lower(uid), '.__init__') OR ends_with(lower(uid), '/__init__') THEN 6 END AS tier FROM cur)
SELECT uid, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
    "entity_suggestions": f"WITH {CURRENT_SQL} SELECT uid, name FROM (SELECT DISTINCT uid, name FROM cur WHERE contains(lower(uid), 'scorer') OR contains(lower(coalesce(name, '')), 'scorer')) ORDER BY length(uid), uid LIMIT 5",
    "find_nodes": f"""WITH {CURRENT_SQL}, w AS (SELECT DISTINCT split_part(c, '(', 1) AS text FROM (SELECT unnest(calls) AS c FROM cur) WHERE c IS NOT NULL), n AS (SELECT uid AS node, unnest(range(1, length(uid))) AS i FROM cur), s AS (SELECT node, substr(node, i + 1) AS text FROM n WHERE substr(node, i, 1) IN ('.', ':')),
h AS (SELECT w.text, cur.uid AS node, 1 AS t FROM w JOIN cur ON cur.uid = w.text UNION ALL SELECT w.text, s.node, 2 FROM w JOIN s USING (text)) SELECT text, arg_min(node, (t, node)) AS node FROM h WHERE text <> '' GROUP BY text""",
    "find_metrics": rf"""WITH {CURRENT_SQL}, m AS (SELECT fpath AS path, min(ordinal) AS ordinal FROM cur WHERE fpath IS NOT NULL GROUP BY fpath), w AS (SELECT DISTINCT regexp_replace(replace(f, '\', '/'), '^(\./)+', '') AS file FROM (SELECT unnest(files_changed) AS f FROM commits) WHERE f IS NOT NULL),
h AS (SELECT file, path, ordinal, CASE WHEN file = path THEN 1 WHEN ends_with(file, '/' || path) OR ends_with(path, '/' || file) THEN 2 ELSE 3 END AS tier FROM w JOIN m ON split_part(file, '/', -1) = split_part(path, '/', -1) WHERE file <> '')
SELECT file, arg_min(path, (tier, ordinal, path)) AS path, min(tier)::INT AS tier FROM h GROUP BY file""",
    "decorations": f"WITH {CURRENT_SQL} SELECT DISTINCT d AS decorator, uid AS target, l - 1 AS line FROM (SELECT uid, line_range[1] AS l, unnest(decorators) AS d FROM cur) WHERE d IS NOT NULL AND d <> ''",
    "parse_sources": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + r.get(c, "").replace("'", "''") + "'" for c in COLUMNS) + ")" for r in ROWS) + ") t(" + ", ".join(f'"{c}"' for c in COLUMNS) + ")",
}
