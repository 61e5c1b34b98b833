"""Ignore rules: parsed on the driver, applied as one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that are left out unless a rule takes them back.
DEFAULTS = (".git/", ".lodeweave/", ".context/", "node_modules/", "vendor/", "dist/", "build/", "target/", "__pycache__/")
_SPECIAL = set(".+()|[]{}^$\\")


def normalized(path: str) -> str:
    """Return a path with slashes and without leading ``./``."""
    path = path.strip().replace("\\", "/")
    while path.startswith("./"):
        path = path[2:]
    return path


def glob_regex(pattern: str) -> str:
    """Return a regular expression for two stars (anything), one star, and a question mark (within a component)."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append(".*")
            i += 1
        elif pattern[i] == "*":
            out.append("[^/]*")
        elif pattern[i] == "?":
            out.append("[^/]")
        else:
            out.append("\\" * (pattern[i] in _SPECIAL) + pattern[i])
        i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """A rule: its pattern; whether it takes back, is for directories, and is bound to the root."""

    pattern: str
    negated: bool = False
    folder: bool = False
    anchored: bool = False

    def regex(self) -> str:
        """Return what a path (of a directory rule: a directory's name) must match as a whole."""
        core = glob_regex(self.pattern)
        if self.folder:
            return f"^(?:.*/)?{core}\\z" if "/" not in self.pattern else "\\z.^"
        if self.anchored:
            return f"^{core}\\z"
        if "/" in self.pattern:
            return f"^(?:.*/)?{core}\\z"
        return f"^(?:.*/)?{core.replace('.*', '[^/]*')}(?:/.*)?\\z"


def parse(lines: list[str] | tuple[str, ...], defaults: bool = True) -> tuple[Rule, ...]:
    """Return the rules of lines, after the default ones; blank lines and comments have none."""
    rules = []
    for line in (*(DEFAULTS if defaults else ()), *lines):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        anchored = line.startswith("/")
        line = line[anchored:]
        folder = line.endswith("/")
        pattern = normalized(line[: len(line) - folder])
        if pattern:
            rules.append(Rule(pattern, negated, folder, anchored))
    return tuple(rules)


def read(path: str) -> list[str]:
    """Return the rules that a file on the driver holds; none if it isn't there."""
    try:
        with open(path, encoding="utf-8") as f:
            return [x for x in (line.strip() for line in f) if x and not x.startswith("#")]
    except FileNotFoundError:
        return []


def _matches(rule: Rule, path: Column, is_folder: Column) -> Column:
    if not rule.folder:
        return path.rlike(rule.regex())
    inside = (path == rule.pattern) | path.startswith(rule.pattern + "/")
    return inside | (is_folder & path.rlike(rule.regex())) if "/" not in rule.pattern else inside


def ignored(rules: tuple[Rule, ...], path: Column, is_folder: Column) -> Column:
    """Tell whether the last rule that matches a path leaves it out."""
    said = F.lit(False)
    for rule in rules:
        said = F.when(_matches(rule, path, is_folder), not rule.negated).otherwise(said)
    return said


def kept(rules: tuple[Rule, ...], path: Column) -> Column:
    """Tell whether a walk finds a file: neither it nor a directory above it is left out."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    heads = F.sequence(F.lit(1), depth)
    return ~F.exists(heads, lambda i: ignored(rules, F.array_join(F.slice(parts, F.lit(1), i), "/"), i < depth))


def leaves_out(rules: tuple[Rule, ...], path: str, is_folder: bool) -> bool:
    """The same for one path on the driver, where a walk skips whole directories."""
    import re

    said = False
    for rule in rules:
        if rule.folder:
            hit = path == rule.pattern or path.startswith(rule.pattern + "/") or (is_folder and "/" not in rule.pattern and re.search(rule.regex().replace("\\z", "\\Z"), path) is not None)
        else:
            hit = re.search(rule.regex().replace("\\z", "\\Z"), path) is not None
        if hit:
            said = not rule.negated
    return said
