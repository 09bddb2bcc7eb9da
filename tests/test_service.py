import pytest
from codestrata import jobs
from codestrata.api import CodeIntelligence


@pytest.fixture(scope="module")
def service(spark, sf_dir):
    return CodeIntelligence(spark, sf_dir)


def test_questions_about_an_entity(service):
    node = service.edges.groupBy("target").count().orderBy("count", ascending=False).first()["target"]
    row = service.explain_blast_radius(node).first()
    assert row["blast_radius"] >= 1 and 0 <= row["risk"] <= 1 and row["share"] > 0 and len(row["bar"]) == 10
    views = service.impact_views(node)
    assert views["nodes"].count() == row["blast_radius"] + 1 and views["tree_paths"].where("depth = 0").count() == 1
    with pytest.raises(LookupError):
        service.find("no such entity")


def test_people_layers_and_drift(service, tmp_path):
    file = service.scores.first()["file"]
    assert service.expertise_ranking(file, 2).count() <= 2 and service.heatmap("nowhere").count() == 0 and service.refresh()["scores"] > 0
    assert service.governance_validate().first()["imports"] > 0 and service.rules().count() == 6 and "fix" in service.violations().columns
    path = str(tmp_path / "b")
    assert service.drift(path).first()["advice"] == "no baseline to compare with"
    service.save_baseline(path)
    assert service.drift(path).first()["drift_score"] == 0


def test_asking(service):
    name = service.entities.where("docstring IS NOT NULL AND name IS NOT NULL").orderBy("ordinal").first()["name"]
    got = service.ask(f"what does {name} do", llm=lambda prompt: prompt.splitlines()[0])
    assert got["evidence"] and got["trace"]["kept"] >= len(got["evidence"]) and got["reason"] is None and got["answer"] and got["grounded"] is not None
    refused = service.ask(f"what does {name} do", llm=lambda prompt: "zebras graze quietly")
    assert refused["reason"] == "refused" and refused["answer"] is None
    assert service.ask("?!", llm=lambda p: p)["reason"] in ("ranking_miss", "retrieval_miss")


def test_index_job_and_reports(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\ndef f():\n    return os.getcwd()\n")
    told = []
    counts = jobs.index_job(spark, "folder", str(tmp_path / "src"), str(tmp_path / "out"), lambda *x: told.append(x))
    assert counts == {"function": 1, "import": 1, "module": 1} and told == list(jobs.STEPS)
    assert spark.read.parquet(str(tmp_path / "out/entities")).first()["ordinal"] == 0
    with pytest.raises(ValueError):
        jobs.sources_of(spark, "cloud", "x")
    rows = spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "k string, v double")
    assert jobs.text_report("T", rows).splitlines()[-2:] == ["a|b  0.5", "     1"] and "a\\|b" in jobs.markdown_report("T", rows)
    jobs.write_run(rows, str(tmp_path / "run"))
    assert (tmp_path / "run.json").exists() and (tmp_path / "run.md").read_text().startswith("# run")
