"""Extractors: from a file's bytes to symbols, imports and calls.

An extractor is a function ``(path, content) -> Extract`` for one language;
``register`` adds or replaces one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Call:
    """A call site."""

    name: str
    qualifier: str = ""
    receiver: str = ""
    arity: int = 0
    line: int = 0
    raw: str = ""


@dataclass
class Symbol:
    """A definition with the calls inside it."""

    name: str
    kind: str
    signature: str
    line: int
    doc: str = ""
    calls: list[Call] = field(default_factory=list)


@dataclass
class Extract:
    """What a file holds; ``issue`` tells what couldn't be read."""

    symbols: list[Symbol] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    issue: str = ""


Extractor = Callable[[str, bytes], Extract]
_KNOWN: dict[str, Extractor] = {}


def register(language: str, extractor: Extractor) -> None:
    """Make an extractor the one for a language."""
    _KNOWN[language] = extractor


def extract(language: str, path: str, content: bytes) -> Extract:
    """Extract a file; a language without an extractor gives an issue."""
    if not _KNOWN:
        from lodeweave.sources.extract import pythonic, scanned

        register("python", pythonic.extract)
        for name, function in scanned.EXTRACTORS.items():
            register(name, function)
    if language not in _KNOWN:
        return Extract(issue=f"no extractor for {language}")
    return _KNOWN[language](path, content)


def split_name(text: str) -> tuple[str, str]:
    """Split a dotted name at its last dot: ``(qualifier, name)``."""
    head, _, tail = text.strip().rpartition(".")
    return head, tail


def last_segment(path: str) -> str:
    """Return what an import is called if it gets no name."""
    return path.strip("\"'").rstrip("/").rpartition("/")[2]


def split_as(text: str) -> tuple[str, str]:
    """Split ``a as b``; without ``as`` both are the same."""
    name, found, alias = text.strip().partition(" as ")
    return name.strip(), alias.strip() if found else name.strip()
