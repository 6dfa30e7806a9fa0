"""Column functions over repository paths and module names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_key(repo: Column, revision: Column) -> Column:
    return F.concat(F.replace(repo, F.lit("/"), F.lit("__")), F.lit("-"), revision)


def normalize_path(root: str, path: Column) -> Column:
    """Relative to root, with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(top)), F.substr(plain, F.lit(len(top) + 1))).otherwise(plain)


def has_extension(path: Column, extension: str) -> Column:
    return F.endswith(path, F.lit(extension))


def module_name(path: Column) -> Column:
    """Dotted name: last suffix and a final __init__ dropped."""
    dotted = F.replace(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("/"), F.lit("."))
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def resolve_relative(current: Column, imported: Column, level: Column) -> Column:
    """The module's package, level - 1 steps up, then the imported name; level 0 is absolute."""
    parts = F.split(current, r"\.")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0)))
    name = F.coalesce(imported, F.lit(""))
    joined = F.array_join(F.filter(F.concat(kept, F.array(name)), lambda x: x != ""), ".")
    return F.when(level == 0, name).otherwise(joined)


def import_candidates(kind: Column, base: Column, name: Column) -> Column:
    """Modules that an import may mean."""
    full = F.concat_ws(".", base, name)
    return F.when(kind == "import", F.array(base)).when((name == "*") | name.isNull(), F.array(base)).when(base == "", F.array(name)).otherwise(F.array(full, base))
