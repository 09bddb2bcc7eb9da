"""One method per question that the service answers; each returns a DataFrame over cached tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.functions import risk
from codestrata.functions.paths import compared_path
from codestrata.operators import context, governance, graph, history, impact, resolution, retrieval, rollup
from codestrata.operators.records import current_records
from codestrata.plans.tables import table
from codestrata.session import cut


class CodeIntelligence:
    """A repository's (or a data folder's) entities, commits, expertise and imports, and the questions asked of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def entities(self) -> DataFrame:
        columns = ["ordinal", "entity_type", "name", "calls", "bases", "complexity", "line_range", "signature", "docstring", "parent_class"]
        return cut(current_records(table(self.spark, self.sf_dir, "repo_graph"), columns))

    @cached_property
    def edges(self) -> DataFrame:
        return cut(graph.dependency_edges(self.entities))

    @cached_property
    def changes(self) -> DataFrame:
        return cut(history.commit_files(table(self.spark, self.sf_dir, "commits")))

    @cached_property
    def experts(self) -> DataFrame:
        return cut(history.expertise_factors(self.changes))

    @cached_property
    def scores(self) -> DataFrame:
        return cut(history.latest_scores(table(self.spark, self.sf_dir, "expertise")))

    @cached_property
    def checked_imports(self) -> DataFrame:
        return cut(governance.validate_imports(governance.import_layers(table(self.spark, self.sf_dir, "imports"))))

    def find(self, text: str) -> str:
        """The one entity that a typed identifier means; LookupError for none, ValueError with up to five for several."""
        hits = [r[0] for r in resolution.lookup(self.entities, text).select("uid").orderBy("uid").limit(6).collect()]
        if not hits:
            raise LookupError(text)
        if len(hits) > 1:
            raise ValueError(f"{text} may be any of {hits[:5]}")
        return hits[0]

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.graph_nodes(self.entities, self.edges), graph.simple_edges(self.edges)

    def condensed_graph(self) -> dict[str, DataFrame]:
        e = cut(rollup.rollup_entities(self.entities, self.edges))
        files = rollup.rollup_files(e)
        return {"entities": e, "files": files, "directories": rollup.rollup_directories(files), "file_edges": rollup.rollup_edges(e, self.edges, "file"), "directory_edges": rollup.rollup_edges(e, self.edges, "directory")}

    def _seed(self, text: str) -> DataFrame:
        return self.spark.createDataFrame([(self.find(text),)], "node string")

    def blast_radius(self, text: str) -> DataFrame:
        return graph.reach(self.edges, self._seed(text)).select("node", "hops")

    @cached_property
    def centrality(self) -> DataFrame:
        return cut(graph.betweenness(self.edges))

    @cached_property
    def risks(self) -> DataFrame:
        return cut(history.file_risk(self.changes))

    def explain_blast_radius(self, text: str) -> DataFrame:
        functions = self.entities.where(F.col("entity_type") == "function").count()
        rows = impact.impact(self.edges, self.entities, self._seed(text), self.centrality, self.risks)
        return impact.blast_share(rows, F.lit(functions)).withColumn("bar", risk.bar(F.col("risk")))

    def impact_views(self, text: str) -> dict[str, DataFrame]:
        """What the interfaces show of an impact: the subgraph, direct neighbours, the tree and its files."""
        nodes, pairs = impact.induced_subgraph(self.edges, self._seed(text))
        return {"nodes": nodes, "edges": pairs, "neighbours": impact.neighbours(self.edges, self._seed(text)), **{f"tree_{k}": v for k, v in impact.impact_tree(self.edges, self.entities, self._seed(text)).items()}}

    def graph_view(self) -> dict[str, DataFrame]:
        nodes = cut(impact.node_view(graph.graph_nodes(self.entities, self.edges), self.edges, self.entities))
        return {"nodes": nodes, "edges": impact.edge_view(self.edges, nodes)}

    def dependency_chain(self, text: str, callers: int = 5) -> DataFrame:
        """(grandparent, caller, target) over at most `callers` callers."""
        e = self.edges.where(F.col("type") == "CALLS").select("source", "target").distinct()
        near = e.join(self._seed(text).withColumnRenamed("node", "target"), "target").orderBy("source").limit(callers)
        return near.select(F.col("source").alias("caller"), "target").join(e.select(F.col("source").alias("grandparent"), F.col("target").alias("caller")), "caller", "left")

    def neighbourhood(self, text: str, intent: str = "blast_radius") -> DataFrame:
        """What surrounds an entity, as far as an intent's expansion goes."""
        hops, cap = graph.EXPANSION.get(intent, graph.EXPANSION_ELSE)
        return graph.bounded_neighbourhood(self.edges, self._seed(text), hops, cap=cap)

    def git_risk(self, file: str) -> DataFrame:
        return history.file_risk(self.changes).where(F.col("file") == compared_path(F.lit(file)))

    def expert(self, file: str) -> DataFrame:
        return history.recommend(self.experts.where(F.col("file") == compared_path(F.lit(file))))

    def expertise_ranking(self, file: str, limit: int = 10) -> DataFrame:
        """The first `limit` developers of a file: stored scores if there are any, else scores from its history."""
        wanted = F.col("file") == compared_path(F.lit(file))
        stored = self.scores.where(wanted)
        if stored.take(1):
            return history.rank_experts(stored, limit)
        return history.rank_experts(history.reasoning(self.experts.where(wanted)), limit)

    def refresh(self) -> dict[str, int]:
        """Read everything anew; the size of what is known."""
        for name in ("entities", "edges", "changes", "experts", "scores", "checked_imports", "centrality", "risks"):
            self.__dict__.pop(name, None)
        return history.store_stats(self.scores).first().asDict()

    def heatmap(self, root: str = "") -> DataFrame:
        """Directories of the files whose path begins with `root`."""
        return history.heatmap(self.scores.where(F.col("file").startswith(root)))

    def bus_factor(self, root: str = "") -> DataFrame:
        return history.file_bus_factor(self.scores.where(F.col("file").startswith(root))).withColumn("at_risk", F.col("bus_factor") <= 2)

    def gaps(self) -> DataFrame:
        return history.knowledge_gaps(self.scores)

    def developer(self, email: str) -> DataFrame:
        return self.scores.where(F.col("email") == email).orderBy(F.col("total").desc(), "file")

    @cached_property
    def files(self) -> DataFrame:
        return cut(self.entities.where(F.col("file_path").isNotNull()).select(F.col("file_path").alias("path")).distinct())

    def governance_validate(self) -> DataFrame:
        return governance.validation_summary(self.checked_imports, governance.checked_files(self.files))

    def violations(self) -> DataFrame:
        """Violations and warnings with what to do about them."""
        bad = self.checked_imports.where(F.col("verdict") != "ALLOW")
        return bad.withColumn("fix", governance.fix_text(F.col("verdict"), F.col("from_layer"), F.col("to_layer")))

    def save_baseline(self, path: str) -> None:
        governance.save_baseline(governance.drift_metrics(self.checked_imports), governance.layer_shares(self.files), path)

    def drift(self, baseline: str | None = None) -> DataFrame:
        """Drift against the baseline saved under a path; without one the score is 0."""
        then, shares = (governance.load_baseline(self.spark, baseline) if baseline else None) or (None, None)
        return governance.drift_report(governance.drift_metrics(self.checked_imports), governance.layer_shares(self.files), then, shares)

    def rules(self) -> DataFrame:
        return governance.rule_summary(self.spark)

    def layers(self) -> DataFrame:
        rows = [(i, n, globs, allowed) for i, (n, (globs, allowed)) in enumerate(governance.LAYERS.items())]
        return self.spark.createDataFrame(rows, "priority int, layer string, patterns array<string>, allowed_dependencies array<string>")

    def info(self) -> DataFrame:
        return self.spark.createDataFrame([("expertise", k, v) for k, v in history.FACTORS.items()] + [("risk", k, v) for k, v in zip(("complexity", "centrality", "test", "dependency", "change", "bus"), risk.RISK_WEIGHTS)], "kind string, factor string, weight double")

    def index(self) -> DataFrame:
        """(doc_id, name, file, type, vector_id, text): what retrieval searches; entities without an id have none, the start line is 0 where unknown."""
        line = F.coalesce(F.try_element_at("line_range", F.lit(1)), F.lit(0))
        return self.entities.select(F.col("uid").alias("doc_id"), "name", F.col("file_path").alias("file"), F.col("entity_type").alias("type"), F.concat_ws(":", "file_path", "name", line.cast("string")).alias("vector_id"), retrieval.embed_text(self.entities).alias("text"))

    def context(self, question: str, intent: str) -> str:
        """What the intent asks for beside the evidence, as text."""
        parts, out = context.ROUTES.get(intent, context.ROUTES["general"]), []
        show = lambda d, c="text": "\n".join(str(r[c]) for r in d.limit(20).collect())
        if "governance" in parts:
            out.append(show(context.governance_context(self.checked_imports)))
        if "hotspots" in parts:
            out.append(show(context.hotspots(self.entities).select(F.concat_ws(" ", "name", F.col("cyclomatic").cast("string"), "file").alias("text"))))
        return "\n\n".join(x for x in out if x)

    def ask(self, question: str, llm: Callable[[str], str] | None = None, budget: int = 1700, embed: Callable[[list[str]], list] | None = None, least: float = 0.0) -> dict:
        """Evidence for a question, packed into `budget` tokens, and the answer of an injected model over it.

        Vectors are those of an injected model, else hashed ones. Without evidence the reason is retrieval_miss, or
        ranking_miss where something was found but nothing kept; an answer that its evidence doesn't support is refused.
        """
        q = self.spark.createDataFrame([("q", question)], "query_id string, text string")
        corpus = cut(self.index())
        vector = (lambda d: retrieval.embed(d, "text", embed)) if embed else (lambda d: d.withColumn("embedding", retrieval.hashed_vector(F.col("text"))))
        ranked, trace = retrieval.hybrid(q, corpus, vector(corpus).select("doc_id", "embedding"), vector(q).select("query_id", "embedding"), least)
        intent = self.spark.range(1).select(retrieval.detect_intent(F.lit(question))).first()[0]
        documents = corpus.select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
        rows = ranked.join(documents, "id").orderBy("rank").limit(8).collect()
        sure = rows[0]["score"] if rows else 0.0
        k = self.spark.range(1).select(retrieval.dynamic_k(F.lit(intent), F.lit(float(sure)))).first()[0]
        best = self.spark.createDataFrame([("q", r["rank"], r["id"], r["document"]) for r in rows[:k]], "query_id string, rank int, id string, document string")
        kept = {r["id"] for r in retrieval.pack_context(best, budget).collect()}
        evidence = [{"id": r["id"], "rank": r["rank"], "score": round(r["score"], 6), "snippet": r["document"]} for r in rows[:k] if r["id"] in kept]
        counts = trace.first().asDict()
        reason = None if evidence else "ranking_miss" if counts["fused"] else "retrieval_miss"
        prompt = "\n\n".join([*(e["snippet"] for e in evidence), self.context(question, intent), question])
        answer = llm(prompt) if llm and evidence else None
        grounded = None
        if answer:
            pair = self.spark.createDataFrame([("q", answer, " ".join(e["snippet"] for e in evidence))], "id string, answer string, evidence string")
            grounded = retrieval.grounding(pair).first()
            if grounded and grounded["sentences"] and grounded["unsupported"] == grounded["sentences"]:
                answer, reason = None, "refused"
        return {"intent": intent, "evidence": evidence, "answer": answer, "grounded": bool(grounded["grounded"]) if grounded else None, "reason": reason, "trace": counts}
