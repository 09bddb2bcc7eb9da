"""Queries over the context that questions are answered with."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.operators import context as C
from codestrata.operators import graph as G
from codestrata.operators import retrieval as T
from codestrata.operators.records import current_records
from codestrata.plans.governance_queries import _L, _checked
from codestrata.plans.graph_queries import _EDGES
from codestrata.plans.history_queries import _LATEST, _scores
from codestrata.plans.impact_queries import _SEEDS, _UP, _seeds
from codestrata.plans.retrieval_queries import _INTENT, _OVERLAP, _questions
from codestrata.plans.tables import CURRENT_SQL, table
from codestrata.session import cut

_COLUMNS = ["ordinal", "entity_type", "name", "calls", "bases", "complexity", "signature", "docstring", "parent_class", "is_method"]


def _entities(spark, sf_dir):
    return cut(current_records(table(spark, sf_dir, "repo_graph"), _COLUMNS))


def ctx_entities(spark, sf_dir):
    """The entities with most callers."""
    entities = _entities(spark, sf_dir)
    edges = cut(G.dependency_edges(entities))
    return C.entity_context(entities, edges, _seeds(edges))


def ctx_questions(spark, sf_dir):
    """For every question the entities that share most of its words."""
    entities = _entities(spark, sf_dir)
    edges = cut(G.dependency_edges(entities))
    corpus = entities.select(F.col("uid").alias("doc_id"), F.concat_ws(" ", "name", "signature", "docstring").alias("text"))
    matches = cut(T.overlap_ranking(_questions(spark, sf_dir), corpus, C.ENTITIES).select("query_id", F.col("doc_id").alias("node"), "rank"))
    return C.query_context(C.entity_context(entities, edges, matches.select("node").distinct()), matches)


def ctx_files(spark, sf_dir):
    return C.file_context(_entities(spark, sf_dir))


def ctx_ownership(spark, sf_dir):
    files = _entities(spark, sf_dir).where(F.col("file_path").isNotNull()).select(F.col("file_path").alias("file"))
    return C.ownership_context(_scores(spark, sf_dir), files)


def ctx_complexity(spark, sf_dir):
    return C.complexity_context(_entities(spark, sf_dir))


def ctx_hotspots(spark, sf_dir):
    return C.hotspots(_entities(spark, sf_dir))


def ctx_governance(spark, sf_dir):
    return C.governance_context(_checked(spark, sf_dir))


def ctx_routes(spark, sf_dir):
    return table(spark, sf_dir, "questions").select("id", F.array_join(C.route(T.detect_intent(F.col("query"))), ",").alias("parts"))


QUERIES = {f.__name__: f for f in (ctx_entities, ctx_questions, ctx_files, ctx_ownership, ctx_complexity, ctx_hotspots, ctx_governance, ctx_routes)}

_BAND = "CASE WHEN {0} > 10 THEN 'HIGH' WHEN {0} > 5 THEN '{1}' ELSE 'LOW' END"


def _listed(name: str, source: str, n: int) -> str:
    return f"{name} AS (SELECT node, count(*) AS n, array_to_string(list_slice(list_sort(list(other)), 1, {n}), ', ') AS t FROM ({source}) GROUP BY node)"


def _context(wanted: str) -> str:
    """`wanted` is a relation of nodes with `up` (seed, node) for them."""
    part = lambda label, rel: f"'{label} (' || {rel}.n || '): ' || {rel}.t"
    line = lambda label, value: f"CASE WHEN {value} <> '' THEN '{label}: ' || {value} END"
    return f"""{_listed("cr", f"SELECT DISTINCT target AS node, source AS other FROM se WHERE type = 'CALLS' AND target IN (SELECT node FROM {wanted})", 10)},
{_listed("ce", f"SELECT DISTINCT source AS node, target AS other FROM se WHERE type = 'CALLS' AND source IN (SELECT node FROM {wanted})", 10)}, {_listed("af", "SELECT seed AS node, node AS other FROM up WHERE node <> seed", 8)},
{_listed("bs", f"SELECT m.uid AS node, o.uid AS other FROM cur m JOIN cur o ON o.fpath = m.fpath AND o.uid <> m.uid WHERE m.uid IN (SELECT node FROM {wanted})", 8)},
ctx AS (SELECT c.uid AS node, concat_ws(chr(10), concat_ws(' ', entity_type, name), {line("file", "fpath")}, {line("signature", "signature")}, {line("description", "split_part(docstring, chr(10), 1)")},
  'complexity: ' || coalesce(complexity.cyclomatic, 0) || ' cyclomatic (' || {_BAND.format("coalesce(complexity.cyclomatic, 0)", "MODERATE")} || '), ' || coalesce(complexity.cognitive, 0) || ' cognitive, ' || coalesce(complexity.lines_of_code, 0) || ' lines',
  {part("called by", "cr")}, {part("calls", "ce")}, {line("class", "parent_class")}, {line("extends", "array_to_string(list_filter(coalesce(bases, []), lambda b: b IS NOT NULL), ', ')")},
  'a change reaches ' || coalesce(af.n, 0) || ' (' || {_BAND.format("coalesce(af.n, 0)", "MODERATE")} || ')', {part("for instance", "af")}, {part("beside it in the file", "bs")}) AS text
  FROM cur c LEFT JOIN cr ON cr.node = c.uid LEFT JOIN ce ON ce.node = c.uid LEFT JOIN af ON af.node = c.uid LEFT JOIN bs ON bs.node = c.uid WHERE c.uid IN (SELECT node FROM {wanted}))"""


SQL = {
    "ctx_entities": f"WITH RECURSIVE {_EDGES}, {_SEEDS}, {_UP}, {_context('seeds')} SELECT node, text FROM ctx",
    "ctx_questions": f"""WITH RECURSIVE {_EDGES}, corpus AS (SELECT uid AS doc_id, name, concat_ws(' ', name, signature, docstring) AS text FROM cur), {_OVERLAP}, m AS (SELECT query_id, doc_id AS node, rank FROM ov WHERE rank <= 3), seeds AS (SELECT DISTINCT node FROM m),
st AS (SELECT DISTINCT source, target FROM edges WHERE source <> target), {_UP}, {_context('seeds')} SELECT query_id, left(string_agg(ctx.text, chr(10) || chr(10) ORDER BY m.rank), 1500) AS text FROM m JOIN ctx USING (node) GROUP BY query_id""",
    "ctx_files": f"""WITH {CURRENT_SQL}, e AS (SELECT *, coalesce(complexity.cyclomatic, 0) AS c, coalesce(is_method, false) AS m, entity_type = 'function' AS f FROM cur WHERE fpath IS NOT NULL)
SELECT fpath AS file, count(*) FILTER (entity_type = 'class') AS classes, count(*) FILTER (f AND NOT m) AS functions, count(*) FILTER (f AND m) AS methods, round(avg(c) FILTER (f), 6) AS mean_cyclomatic, max(c) FILTER (f) AS max_cyclomatic, arg_max(name, (c, -ordinal)) FILTER (f) AS most_complex FROM e GROUP BY fpath""",
    "ctx_ownership": f"""WITH {CURRENT_SQL}, {_LATEST}, k AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY total DESC, email) AS k FROM e), t AS (SELECT file, string_agg(email || ' ' || printf('%.2f', total) || ' (' || coalesce(commits, 0) || ' commits)', ', ' ORDER BY k) FILTER (k <= 3) AS t, count(*) FILTER (total >= 0.6) AS bus FROM k GROUP BY file)
SELECT c.file, CASE WHEN t.t IS NULL THEN 'nobody known' ELSE t.t || '; bus factor ' || t.bus END AS text FROM (SELECT DISTINCT fpath AS file FROM cur WHERE fpath IS NOT NULL) c LEFT JOIN t USING (file)""",
    "ctx_complexity": f"""WITH {CURRENT_SQL}, e AS (SELECT uid AS node, name, coalesce(complexity.cyclomatic, 0) AS cyclomatic, coalesce(complexity.cognitive, 0) AS cognitive, coalesce(complexity.lines_of_code, 0) AS lines FROM cur WHERE complexity IS NOT NULL)
SELECT *, {_BAND.format("cyclomatic", "MODERATE")} AS band, array_to_string(list_filter([CASE WHEN cyclomatic > 10 THEN 'break it into smaller pieces' END, CASE WHEN cognitive > 15 THEN 'simplify nested logic' END, CASE WHEN lines > 50 THEN 'extract helpers' END], lambda x: x IS NOT NULL), '; ') AS hints FROM e""",
    "ctx_hotspots": f"""WITH {CURRENT_SQL}, e AS (SELECT uid AS node, name, fpath AS file, complexity.cyclomatic AS cyclomatic, ordinal FROM cur WHERE entity_type = 'function' AND complexity.cyclomatic > 0)
SELECT node, name, file, cyclomatic, {_BAND.format("cyclomatic", "MODERATE")} AS band, (SELECT count(*) FROM e) AS functions, (SELECT round(avg(cyclomatic), 6) FROM e) AS mean, (SELECT count(*) FROM e WHERE cyclomatic > 5) AS above_5 FROM e ORDER BY cyclomatic DESC, ordinal LIMIT 5""",
    "ctx_governance": f"""WITH {_L}, b AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY from_path, line, to_module) AS place FROM k WHERE verdict <> 'ALLOW')
SELECT verdict AS severity, place::INT AS place, concat_ws(' ', concat_ws(':', from_path, line::VARCHAR), 'imports', to_module, '(' || coalesce(from_layer, 'none') || ' -> ' || coalesce(to_layer, 'none') || ')') AS text FROM b WHERE place <= CASE WHEN verdict = 'BLOCK' THEN 8 ELSE 5 END""",
    "ctx_routes": f"WITH {_INTENT} SELECT id, CASE intent " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in C.ROUTES.items()) + f" ELSE '{','.join(C.ROUTES['general'])}' END AS parts FROM it",
}
