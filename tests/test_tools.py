"""The tools by their names, one after another on one store."""

import subprocess

from engramite.operators.audit import Keys
from engramite.tools import TOOLS, Engine


def test_a_session(spark, tmp_path):
    time = iter(range(1_700_000_000, 1_800_000_000, 60))
    e = Engine(spark, lambda: next(time), Keys(spark))
    first = e.call("add_memory", content="the database port of the server is 5432", agent_id="Agent-A")
    second = e.call("add_memory", content="I prefer dark mode in the editor", agent_id="Agent-A", shared=False)
    assert (first["id"], first["outcome"], second["outcome"]) == (1, "stored", "stored") and len(TOOLS) == 19
    assert e.call("add_memory", content="the database port of the server is 5432")["outcome"] == "exists"
    assert "error" in e.call("add_memory", content=" ") and "error" in e.call("nothing") and "error" in e.call("search_memories", query="x", limit=0) and "error" in e.call("get_memory")
    found = e.call("search_memories", query="database port", agent_id="agent-a")
    assert found["results"][0]["id"] == 1 and e.call("verify_attestation", attestation_id=found["attestation_id"]) == {"valid": True}
    assert e.call("get_memory", id=1)["memory"]["access_count"] == 3 and "error" in e.call("get_memory", id=2, agent_id="agent-b")
    changed = e.call("update_memory", id=1, content="the database port of the server is 6543", agent_id="agent-a")
    history = e.call("get_memory_history", query="1")["histories"][1]
    assert [v["id"] for v in history] == [1, changed["new_id"]] and history[1]["diff"] == "the database port of the server is [-5432-][+6543+]"
    assert e.call("add_entity", name="server.py", type="file") == e.call("add_entity", name="server.py", type="file") == {"success": True, "id": 1}
    assert e.call("link_entity_memory", entity_name="server.py", memory_id=changed["new_id"])["success"] and "error" in e.call("link_entity_memory", entity_name="none", memory_id=1)
    assert [m["id"] for m in e.call("get_file_history", file_path="server.py")["memories"]] == [changed["new_id"]] and "error" in e.call("search_by_entity", entity_name="none")
    made = e.call("get_optimized_context", query="the database port of the server", agent_id="agent-a")
    assert made["intent"] == "database_management" and changed["new_id"] in made["memories"] and e.call("verify_attestation", attestation_id=made["attestation_id"])["valid"]
    assert e.call("export_audit_log")["count"] == 2 and not e.call("verify_attestation", attestation_id="x")["valid"]
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init")
    (repo / "server.py").write_text("x")
    run("add", ".")
    run("commit", "-m", "feat: first")
    assert e.call("ingest_git_commits", repo_path=str(repo)) == {"success": True, "added": 1, "skipped": 0} and e.call("watch_git_repo", repo_path=str(repo))["skipped"] == 1
    assert e.call("get_file_history", file_path="server.py")["count"] == 2
    assert e.extract_facts("Remember: the tests run on linux.") == {"facts": 1, "stored": 1}
    e.call("add_memory", content="I prefer dark mode in the editor now", agent_id="agent-c", shared=False)
    assert e.call("consolidate_memories")["success"] and e.call("get_agent_stats")["agents"]
    assert e.call("delete_memory", id=changed["new_id"], agent_id="agent-a")["success"] and "error" in e.call("delete_memory", id=changed["new_id"])
    assert e.call("get_recent_memories", limit=2)["count"] == 2 and e.call("get_important_memories", limit=1)["count"] == 1
