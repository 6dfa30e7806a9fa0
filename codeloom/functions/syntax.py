"""Symbols and imports of Python source."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_TEXT = T.StringType()
_IMPORT = T.StructType([T.StructField(n, T.IntegerType() if n == "level" else _TEXT) for n in ("kind", "module", "level", "name", "alias")])
SCHEMA = T.StructType().add("symbols", T.ArrayType(_TEXT)).add("aliases", T.MapType(_TEXT, _TEXT)).add("imports", T.ArrayType(_IMPORT)).add("parse_error", _TEXT)


def metadata(source: str | None) -> dict:
    """Names bound by definitions and plain assignments at any depth, imports in source order, and alias -> full name. Source that
    does not parse, for whatever reason, has none of them and says why; null source has none."""
    symbols, aliases, imports, error = set(), {}, [], None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            tree = ast.parse(source) if source is not None else None
    except SyntaxError as e:
        tree, error = None, e.msg
    except (RecursionError, MemoryError, ValueError) as e:  # nested beyond the parser, or null bytes
        tree, error = None, type(e).__name__
    for node in ast.walk(tree) if tree else ():
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                symbols.add(node.name)
            case ast.Assign(targets=targets):
                symbols.update(t.id for t in targets if isinstance(t, ast.Name))
            case ast.AnnAssign(target=ast.Name(id=name)):
                symbols.add(name)
            case ast.Import(names=names):
                for n in names:
                    imports.append((node.lineno, node.col_offset, dict(kind="import", module=n.name, level=0, name=None, alias=n.asname or n.name.split(".")[0])))
            case ast.ImportFrom(names=names):
                for n in names:
                    imports.append((node.lineno, node.col_offset, dict(kind="from", module=node.module, level=node.level, name=n.name, alias=n.asname or n.name)))
    in_order = [x for *_, x in sorted(imports, key=lambda x: x[:2])]
    for x in in_order:  # later imports of a name win
        full = ".".join(filter(None, (x["module"], x["name"])))
        aliases[x["alias"]] = full
    return {"symbols": sorted(symbols), "aliases": aliases, "imports": in_order, "parse_error": error}


@pandas_udf(SCHEMA)
def ast_metadata(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metadata(s) for s in source], columns=["symbols", "aliases", "imports", "parse_error"])
