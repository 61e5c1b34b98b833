"""Files that tie a tree to its graph: a Git hook, and notes for coding agents."""

from __future__ import annotations

import os
import shlex
import subprocess

from lodeweave.sources.sinks import publish

AGENTS = ("codex", "claude", "cursor")
BEGIN, END = "<!-- lodeweave: begin -->", "<!-- lodeweave: end -->"
HOOK_BEGIN, HOOK_END = "# lodeweave: begin", "# lodeweave: end"
_SKILL = ".lodeweave/skills/lodeweave.md"
_CURSOR = ".cursor/rules/lodeweave.mdc"
_NOTES = {"codex": "AGENTS.md", "claude": "CLAUDE.md"}

_GUIDE = """This tree has a code graph under `.lodeweave/context`. Before reading many files, ask it:

- `python -m lodeweave symbol NAME --fuzzy` finds symbols,
- `callers`, `callees`, `trace`, `path`, `definition` and `references` follow calls,
- `python -m lodeweave update` after changes; `status` tells what that would do,
- `python -m lodeweave enrich FILE:NAME TEXT` notes what a symbol does.
"""


def agents_of(text: str) -> list[str]:
    """Return the agents that a list names, separated by commas or blanks; ``all`` means all. Unknown ones are an error."""
    out: list[str] = []
    for name in text.lower().replace(",", " ").split():
        if name != "all" and name not in AGENTS:
            raise ValueError(f"unknown agent: {name} (known: {', '.join(AGENTS)}, all)")
        out += [a for a in (AGENTS if name == "all" else (name,)) if a not in out]
    return out


def with_block(text: str, block: str, begin: str, end: str) -> str:
    """Return a text in which a marked block is replaced, or added at the end."""
    a, b = text.find(begin), text.find(end)
    whole = f"{begin}\n{block.rstrip()}\n{end}"
    if 0 <= a <= b:
        return text[:a] + whole + text[b + len(end) :].rstrip("\n") + "\n"
    return (text.rstrip("\n") + "\n\n" if text.strip() else "") + whole + "\n"


def _read(path: str) -> str:
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_notes(root: str, agents: list[str]) -> list[str]:
    """Write the guide, and what each agent reads of its own; return the files that changed. What others wrote in them stays."""
    texts = {_SKILL: "# Asking the code graph\n\n" + _GUIDE}
    for name in ("CONTEXT.md", *[_NOTES[a] for a in agents if a in _NOTES]):
        texts[name] = with_block(_read(os.path.join(root, name)), _GUIDE if name == "CONTEXT.md" else f"See `CONTEXT.md` and `{_SKILL}` for the code graph of this tree.", BEGIN, END)
    if "cursor" in agents:
        texts[_CURSOR] = "---\ndescription: The code graph of this tree\nalwaysApply: true\n---\n\n" + _GUIDE
    return sorted(name for name, text in texts.items() if publish(os.path.join(root, name), text.encode()))


def present_notes(root: str) -> dict[str, bool]:
    """Tell which of these files there are."""
    has = lambda name: BEGIN in _read(os.path.join(root, name))
    return {"skills": os.path.exists(os.path.join(root, _SKILL)), "context": has("CONTEXT.md"), **{a: has(n) for a, n in _NOTES.items()}, "cursor": os.path.exists(os.path.join(root, _CURSOR))}


def hook_text(before: str, root: str) -> str:
    """Return a pre-commit hook that brings the graph up to date, in the format that it has; other parts of the hook stay."""
    here = shlex.quote(root)
    block = f"""root={here}
format=text
if [ -f "$root/.lodeweave/context/manifest.json" ]; then format=jsonl; fi
(cd "$root" && python -m lodeweave update --format "$format") || exit 1"""
    head = before if before.startswith("#!") else "#!/bin/sh\n" + before
    return with_block(head, block, HOOK_BEGIN, HOOK_END)


def install_hook(folder: str) -> str:
    """Put the hook into the Git repository that a folder belongs to; return its path."""
    paths = []
    for what in ("--show-toplevel", "--git-dir"):
        said = subprocess.run(["git", "-C", folder, "rev-parse", what], capture_output=True, text=True, check=False)
        if said.returncode:
            raise ValueError("not inside a Git repository")
        paths.append(said.stdout.strip())
    path = os.path.join(os.path.join(folder, paths[1]), "hooks", "pre-commit")
    publish(path, hook_text(_read(path), paths[0]).encode())
    os.chmod(path, 0o755)
    return path
