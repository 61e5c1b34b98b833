"""Language servers: which are there, and what they say about a place."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Callable, Iterable

from lodeweave.functions.paths import SERVED

#: Servers of each language, in the order in which they're tried; scripts share TypeScript's.
SERVERS = {"go": ("gopls",), "python": ("pyright-langserver", "pylsp"), "typescript": ("typescript-language-server",), "ruby": ("solargraph",)}
#: Servers whose program answers a question about a place on its command line.
ASKED = ("gopls",)

Run = Callable[[str, list[str]], str]


class ServerError(RuntimeError):
    """A server can't be asked, or didn't answer."""


def language_of(path: str) -> str | None:
    """Return the language for which a server may be asked about a path; JavaScript counts as TypeScript."""
    found = SERVED.get(os.path.splitext(path)[1].lower())
    return "typescript" if found == "javascript" else found


def presence(paths: Iterable[str]) -> dict[str, bool]:
    """Tell for each language with servers whether a path has it."""
    found = {language_of(p) for p in paths}
    return {language: language in found for language in SERVERS}


def capabilities(present: dict[str, bool], which: Callable[[str], str | None] = shutil.which) -> dict[str, dict]:
    """Return for each language the first of its servers that is installed, or why there is none."""
    out = {}
    for language, servers in SERVERS.items():
        here = bool(present.get(language))
        installed = next((s for s in servers if which(s)), None) if here else None
        reason = "" if installed else "server_not_found" if here else "language_not_present"
        out[language] = {"present": here, "server": installed or servers[0], "available": installed is not None, "reason": reason}
    return out


def status(path: str, which: Callable[[str], str | None] = shutil.which) -> dict:
    """Return language, server, and whether it's available, for a symbol's file."""
    language = language_of(path)
    if language is None:
        return {"language": "", "server": "", "available": False, "reason": "unsupported_language"}
    one = capabilities({language: True}, which)[language]
    return {"language": language, "server": one["server"], "available": one["available"], "reason": one["reason"]}


def called(folder: str, command: list[str]) -> str:
    """Run a program in a folder and return what it prints."""
    done = subprocess.run(command, cwd=folder, capture_output=True, text=True, timeout=60, check=False)
    if done.returncode:
        raise ServerError(done.stderr.strip() or f"exit code {done.returncode}")
    return done.stdout


def asked(root: str, server: str, action: str, file: str, line: int, column: int = 1, run: Run = called) -> list[str]:
    """Ask a server for the definition of, or references to, what stands at a place; return its lines."""
    if not server.strip():
        raise ServerError("a server's name is needed")
    if line < 1:
        raise ServerError("a line is needed, from 1 on")
    if server not in ASKED:
        raise ServerError(f"server {server!r} does not support {action} queries")
    place = f"{file if os.path.isabs(file) else os.path.join(root, file)}:{line}:{max(column, 1)}"
    try:
        return run(root, [server, action, place]).splitlines()
    except ServerError as error:
        raise ServerError(f"{action} query failed: {error}") from error
    except (OSError, subprocess.SubprocessError) as error:
        raise ServerError(f"{action} query failed: {error}") from error
