"""Paths and languages, as expressions. Paths are relative and have slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions, in lower case, and the languages that read them.
EXTENSIONS = {
    ".go": "go", ".py": "python", ".pyw": "python", ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby",
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
}
#: Extensions for which a language server may be asked.
SERVED = {".go": "go", ".py": "python", ".rb": "ruby", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript"}
SUSPICIOUS = ("node_modules/", "vendor/", "dist/")
ALIASES = {"py": "python", "rb": "ruby", "ts": "typescript", "js": "javascript"}
_SCRIPT = (".js", ".jsx", ".mjs", ".cjs")


def extension(path: Column) -> Column:
    """Return the extension with its dot, or an empty string."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def directory(path: Column) -> Column:
    """Return the directory; a dot at the top."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def base(path: Column) -> Column:
    """Return the last component."""
    return F.substring_index(path, "/", -1)


def without_extension(path: Column) -> Column:
    """Return the path without its extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def module_of(path: Column) -> Column:
    """Return the first directory, or ``root``."""
    return F.when(F.instr(path, "/") == 0, F.lit("root")).otherwise(F.split_part(path, F.lit("/"), F.lit(1)))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), key)


def language_of(path: Column) -> Column:
    """Return the language of a path by its extension, or null.

    Whether a script is JavaScript or TypeScript is told by the extension as
    written, so one in capitals counts as TypeScript.
    """
    ext = extension(path)
    found = _lookup(F.lower(ext), EXTENSIONS)
    script = found.isin("typescript", "javascript")
    return F.when(script, F.when(ext.isin(*_SCRIPT), F.lit("javascript")).otherwise(F.lit("typescript"))).otherwise(found)


def served_language(path: Column) -> Column:
    """Return the language for which a server may be asked about a path, or null."""
    return _lookup(F.lower(extension(path)), SERVED)


def suspicious(path: Column) -> Column:
    """Tell whether a path lies in a folder of code that others wrote or that was generated."""
    return path.rlike("^(" + "|".join(SUSPICIOUS) + ")")


def language_set(names: list[str] | None) -> list[str] | None:
    """Return the languages that names and short names mean; none means all. Unknown ones are an error."""
    wanted = sorted({ALIASES.get(n, n) for n in (x.strip().lower() for x in names or []) if n})
    known = set(EXTENSIONS.values())
    if unknown := [n for n in wanted if n not in known]:
        raise ValueError(f"unknown language: {', '.join(unknown)}")
    return wanted or None


def cleaned(path: Column) -> Column:
    """Return a path without empty and dot components, and with double dots taken back; a dot if nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)
