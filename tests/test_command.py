"""The command line, language servers, hooks and notes."""

import json
import os
import subprocess

import pytest

from lodeweave.__main__ import main
from lodeweave.plans.engine import Engine
from lodeweave.sources import servers, setup


def test_capabilities():
    present = servers.presence(["internal/root.go", "pkg/main.ts", "tool.py", "x.pyw", "README"])
    assert present == {"go": True, "python": True, "typescript": True, "ruby": False}
    found = servers.capabilities({"go": True, "python": True, "typescript": False, "ruby": True}, lambda name: f"/bin/{name}" if name in ("gopls", "pylsp") else None)
    assert found["go"] == {"present": True, "server": "gopls", "available": True, "reason": ""}
    assert found["python"]["server"] == "pylsp" and found["python"]["available"]
    assert found["typescript"]["reason"] == "language_not_present" and found["ruby"]["reason"] == "server_not_found" and found["ruby"]["server"] == "solargraph"


def test_status_of_a_file():
    assert servers.status("a/b.JS", lambda name: None) == {"language": "typescript", "server": "typescript-language-server", "available": False, "reason": "server_not_found"}
    assert servers.status("a/b.txt")["reason"] == "unsupported_language"
    assert servers.status("a.go", lambda name: name)["available"]


def test_asked():
    seen = []

    def run(folder, command):
        seen.append((folder, command))
        return "x.go:1:2\n"

    assert servers.asked("/repo", "gopls", "references", "cli/root.go", 9, 0, run) == ["x.go:1:2"]
    assert seen == [("/repo", ["gopls", "references", "/repo/cli/root.go:9:1"])]
    with pytest.raises(servers.ServerError, match="does not support"):
        servers.asked("/repo", "pylsp", "references", "a.py", 9, 1, run)
    for server, line in (("", 1), ("gopls", 0)):
        with pytest.raises(servers.ServerError):
            servers.asked("/repo", server, "definition", "a.go", line, 1, run)

    def fails(folder, command):
        raise OSError("boom")

    with pytest.raises(servers.ServerError, match="definition query failed: boom"):
        servers.asked("/repo", "gopls", "definition", "a.go", 9, 1, fails)


def test_agents():
    assert setup.agents_of("") == [] and setup.agents_of("Cursor, codex cursor") == ["cursor", "codex"] and setup.agents_of("all") == list(setup.AGENTS)
    with pytest.raises(ValueError):
        setup.agents_of("nobody")


def test_notes(tmp_path):
    (tmp_path / "AGENTS.md").write_text("Own words.\n")
    first = setup.write_notes(str(tmp_path), ["codex", "claude", "cursor"])
    assert len(first) == 5 and all((tmp_path / n).exists() for n in first)
    text = (tmp_path / "AGENTS.md").read_text()
    assert text.startswith("Own words.\n") and text.count(setup.BEGIN) == 1
    assert setup.write_notes(str(tmp_path), ["codex", "claude", "cursor"]) == [] and all(setup.present_notes(str(tmp_path)).values())


def test_hook(tmp_path):
    with pytest.raises(ValueError):
        setup.install_hook(str(tmp_path))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    path = setup.install_hook(str(tmp_path))
    text = open(path).read()
    assert text.startswith("#!/bin/sh\n") and text.count(setup.HOOK_BEGIN) == 1 and os.access(path, os.X_OK)
    with open(path, "w") as f:
        f.write("#!/bin/bash\necho mine\n" + text.removeprefix("#!/bin/sh\n") + "echo after\n")
    setup.install_hook(str(tmp_path))
    again = open(path).read()
    assert again.startswith("#!/bin/bash\necho mine\n") and again.count(setup.HOOK_BEGIN) == 1 and again.endswith("echo after\n")


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("commands")
    (root / "a.go").write_text("package a\n\nfunc Start() { Mid() }\nfunc Mid() { End() }\nfunc End() {}\n")
    assert main(["init", "--llm", "codex", "--format", "jsonl"], spark, str(root)) == 0
    return root


def test_commands(spark, tree, capsys):
    def said(*words, code=0):
        capsys.readouterr()
        assert main(list(words), spark, str(tree)) == code
        out = capsys.readouterr()
        return json.loads(out.out) if "--json" in words else out.out + out.err

    assert (tree / "AGENTS.md").exists() and (tree / ".lodeweave/context/symbols.jsonl").exists()
    assert "scanned=1 parsed=0 reused=1" in said("update")
    assert [m["name"] for m in said("symbol", "Strat", "--fuzzy", "--json")["matches"]] == ["Start"]
    assert "not found" in said("symbol", "nobody", code=1)
    assert [r["name"] for r in said("callers", "Mid", "--json")["results"]] == ["Start"] and "Mid" in said("callees", "Start")
    assert len(said("trace", "Start", "--depth", "2", "--json")["results"]) == 2 and said("path", "Start", "End", "--json")["length"] == 2
    assert said("definition", "a.go:4", "--json")["symbol"]["name"] == "Mid"
    lsp = said("callers", "Mid", "--lsp", "--json")
    assert lsp["lsp"]["language"] == "go" and lsp["results"][0]["source"] == "parser"
    assert [r["name"] for r in said("references", "Mid", "--json")["results"]] == ["Start"]
    assert "annotated" in said("enrich", "a.go:Mid", "goes", "on")
    health = said("doctor", "--json")
    assert health["healthy"] and health["servers"]["go"]["present"] and health["integrations"]["codex"] and not health["integrations"]["cursor"]
    (tree / "b.go").write_text("package a\n\nfunc More() { Mid() }\n")
    assert said("status", "--json")["changed"] == ["b.go"]
    assert "- b.go: changed" in said("update", "--explain")
    assert said("generate", "--json")["scanned"] == 2 and "error" in said("generate", "--format", "xml", code=1)
    assert said("version").startswith("lodeweave ") and "error" in said("install-hook", code=1)
    assert Engine(spark, str(tree)).table("symbols").count() == 4
