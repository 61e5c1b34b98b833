"""Which files does an import mean?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import paths


def default_alias(path: Column) -> Column:
    """Return the name under which an import is known if it gets none: its last component."""
    return F.trim(F.substring_index(F.trim(F.btrim(path, F.lit("\"'"))), "/", -1))


def alias_targets(files: DataFrame) -> DataFrame:
    """Return ``(file, alias, import_path, target_name)`` for ``files(path, imports, import_aliases)``.

    Aliases that the source gives come before the default of the same name; what
    follows a hash in a target is the symbol that the alias means.
    """
    given = files.select(F.col("path").alias("file"), F.explode("import_aliases").alias("alias", "target")).select("file", F.trim("alias").alias("alias"), F.trim("target").alias("target"), F.lit(0).alias("order"))
    plain = files.select(F.col("path").alias("file"), F.posexplode("imports").alias("pos", "target")).select("file", default_alias(F.col("target")).alias("alias"), "target", (F.col("pos") + 1).alias("order")).where("alias <> ''")
    chosen = given.unionByName(plain).groupBy("file", "alias").agg(F.min_by("target", F.struct("order", "target")).alias("target"))
    parts = F.split(F.col("target"), "#", 2)
    return chosen.select("file", "alias", F.trim(F.get(parts, F.lit(0))).alias("import_path"), F.trim(F.get(parts, F.lit(1))).alias("target_name"))


def _file_keys(files: DataFrame) -> DataFrame:
    """Return ``(key, relative, target_file)``: what an import may call a file by; relative ones can't use its base name."""
    path = F.col("path")
    stem, folder = paths.without_extension(path), paths.directory(path)
    stem_base = paths.without_extension(paths.base(path))
    keys = F.array(F.struct(stem.alias("key"), F.lit(True).alias("relative")), F.struct(folder.alias("key"), F.lit(True).alias("relative")), F.struct(stem_base.alias("key"), F.lit(False).alias("relative")))
    return files.select(F.col("path").alias("target_file"), F.explode(keys).alias("k")).select("target_file", "k.key", "k.relative")


def match_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Return ``(file, import_path, target_file)`` for ``imports(file, import_path)`` and ``files(path)``.

    A relative import (with a dot at its head) is put after the importing file's
    directory and must be a file without its extension, or a directory. Others
    must be such a name, or a file's base name, or end with one after a slash.
    The end is found by an equality: each import is spread to its endings at
    slashes, each file to its names, so no pair is compared that doesn't match.
    """
    path = F.trim(F.btrim(F.trim("import_path"), F.lit("\"'")))
    asked = imports.select("file", "import_path").distinct().withColumn("p", path).where("p <> ''")
    near = asked.where(F.col("p").startswith(".")).select("file", "import_path", paths.cleaned(F.concat_ws("/", paths.directory(F.col("file")), F.col("p"))).alias("key"), F.lit(True).alias("near"))
    far = asked.where(~F.col("p").startswith(".")).withColumn("p", F.regexp_replace(F.regexp_replace("p", r"\\", "/"), "^/", ""))
    pieces = F.split(F.col("p"), "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, i, F.size(pieces)), "/"))
    spread = far.select("file", "import_path", F.explode(F.array_distinct(endings)).alias("key"), F.lit(False).alias("near"))
    names = _file_keys(files)
    found = near.unionByName(spread).join(names, "key").where("not near or relative")
    return found.select("file", "import_path", "target_file").distinct()


def aliases(files: DataFrame) -> DataFrame:
    """Return the alias table of :mod:`lodeweave.operators.resolve`; aliases that match no file are left out."""
    targets = alias_targets(files)
    matched = match_imports(targets.select("file", "import_path"), files.select("path"))
    return targets.join(matched, ["file", "import_path"]).select("file", "alias", "target_file", "target_name")
