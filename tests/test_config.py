import pytest
from pyspark.sql import functions as F

from trawler.functions.models import RetryingEmbedder, TransientError
from trawler.operators import sessions
from trawler.sources import config as cf

MAP_STYLE = """
store_path: .index/store
chunk_size: 50
collections:
  notes:
    path: notes
    include_by_default: false
    context: {/: all notes}
  api:
    path: docs/api
    pattern: "**/*.md"
"""
LIST_STYLE = """
collections:
  - {name: b, path: /b}
  - {name: a, path: /a, ignore: [tmp/*]}
"""


def test_both_styles(tmp_path):
    pytest.importorskip("yaml")
    config = cf.absolute(cf.parse_config(MAP_STYLE), "/work/root")
    assert [c.name for c in config.collections] == ["api", "notes"]
    assert config.collections[1].path == "/work/root/notes" and config.store_path == "/work/root/.index/store"
    assert config.settings().chunk_tokens == 50 and config.settings().chunk_overlap == 0.15
    assert [c.name for c in cf.parse_config(LIST_STYLE).collections] == ["b", "a"]
    path = str(tmp_path / "x" / "config.yaml")
    cf.save_config(path, config)
    again = cf.load_config(path)
    assert again.collections[0].path == config.collections[0].path
    assert again.collections[0].include_by_default is None and again.collections[1].include_by_default is False
    assert again.collections[1].context == {"/": "all notes"}


def test_store_round_trip(spark, tmp_path):
    config = cf.FileConfig(str(tmp_path / "s"), global_context="g", collections=[cf.Collection("c", str(tmp_path / "docs"))])
    store = cf.open_store(spark, config)
    back = cf.config_of(store, str(tmp_path))
    assert back.collections[0].path == "docs" and back.global_context == "g"


def test_retries():
    class Flaky:
        name = "flaky"

        def __init__(self, failures):
            self.failures = failures

        def embed_batch(self, texts):
            if self.failures:
                self.failures -= 1
                raise TransientError("busy", retry_after=7 if self.failures else 0)
            return [[1.0]] * len(texts)

    waits = []
    assert RetryingEmbedder(Flaky(2), sleep=waits.append).embed_batch(["a"]) == [[1.0]]
    assert waits[0] == 7 and 1.5 <= waits[1] <= 2.5
    with pytest.raises(TransientError):
        RetryingEmbedder(Flaky(9), retries=1, sleep=waits.append).embed_batch(["a"])


def test_runs(spark):
    schema = "id string, session_id string, agent_id string, status string, error_code string, error_message string, started_at int, finished_at int, created_at int, updated_at int"
    runs = spark.createDataFrame([("r1", "s1", "codex", "running", "", "", 1, None, 1, 1)], schema)
    asked = spark.createDataFrame([("r2", "s1", "", 2), ("r3", "s2", "", 2)], "id string, session_id string, agent_id string, started_at int")
    both = sessions.start_runs(runs, asked)
    assert {r.id: (r.status, r.agent_id) for r in both.collect()} == {"r1": ("running", "codex"), "r3": ("running", "codex")}
    ended = spark.createDataFrame([("r1", "failed", "x", "broke", 9)], "id string, status string, error_code string, error_message string, finished_at int")
    rows = {r.id: r for r in sessions.finish_runs(both, ended).collect()}
    assert (rows["r1"].status, rows["r1"].error_message, rows["r1"].updated_at) == ("failed", "broke", 9)
    assert rows["r3"].status == "running" and rows["r3"].finished_at is None
    log = spark.createDataFrame([("r", 1, "RUN_STARTED"), ("r", 3, "RUN_ERROR"), ("q", 2, "RUN_STARTED"), ("q", 4, "TEXT")], "run string, at int, type string")
    status = {r.run: r.status for r in sessions.run_status(log, "run", F.col("at")).collect()}
    assert status == {"r": "failed", "q": "running"}


def test_projects(tmp_path):
    from trawler.sources.projects import Project, list_projects, load_project, resolve_root, save_project

    root = str(tmp_path / "projects")
    assert list_projects(root) == [] and resolve_root(root) == "." and resolve_root(root, "/x") == "/x"
    good = Project("My Docs", "my-docs", "en", " local ", {"local": {"type": "local", "path": "/w"}})
    save_project(root, good)
    assert list_projects(root) == ["my-docs"] and load_project(root, "my-docs").project_name == "My Docs"
    assert resolve_root(root, "", "My Docs") == "/w"
    for change in (
        {"language": " "}, {"active_source": "other"}, {"active_source": "remote"}, {"code_repos": [{"slug": "a"}]},
        {"sources": {"local": {"type": "local", "path": "/w", "url": "u"}}}, {"sources": {"local": {"type": "remote", "path": "/w"}}},
    ):
        with pytest.raises(ValueError):
            Project(**{**good.__dict__, **change}).check()
    remote = Project("R", "r", "en", "remote", {"remote": {"type": "remote", "url": "http://x"}})
    save_project(root, remote)
    with pytest.raises(ValueError):
        resolve_root(root, "", "r")
