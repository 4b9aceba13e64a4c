"""Deeply nested records as related flat tables, by structural variant."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graniva.plans.stage import materialize, materialize_all

_LEAF = "array<struct<name:string,value:string>>"


def _scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType))


def _state(col: Column, kind: T.DataType, depth: int | None = None, most_scalars: int | None = None) -> Column:
    """State that the bottom-up tree automaton gives to a value; null for a null.

    The states of the elements of an array enter its state, and so the state of the object around it, ``depth`` levels up, or at
    every level without a ``depth``; beyond it an object counts as such alone.
    """
    if isinstance(kind, T.StructType):
        wide = most_scalars is not None and sum(_scalar(f.dataType) for f in kind.fields) > most_scalars
        parts = [(f.name, _state(col[f.name], f.dataType, depth, most_scalars)) for f in kind.fields if not (wide and _scalar(f.dataType))]
        named = [F.concat(F.lit(n), s) for n, s in parts]
        return F.when(col.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *named) if named else F.lit(""), F.lit("}")))
    if isinstance(kind, T.ArrayType):
        below = None if depth is None else depth - 1

        def one(x: Column) -> Column:
            cut = isinstance(kind.elementType, T.StructType) and depth is not None and depth < 1
            return F.coalesce(F.when(x.isNotNull(), "{}") if cut else _state(x, kind.elementType, below, most_scalars), F.lit("0"))

        states = F.array_sort(F.array_distinct(F.transform(col, one)))
        return F.concat(F.lit("["), F.array_join(states, "|"), F.lit("]"))
    return F.when(col.isNotNull(), "'")


def _below(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))


def _scalars(col: Column, kind: T.DataType, name: Column) -> Column:
    """Leaves (name, value) of a scalar, or of arrays of scalars at any depth."""
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.coalesce(F.transform(col, lambda x, i: _scalars(x, kind.elementType, F.concat(name, F.lit("["), i.cast("string"), F.lit("]")))), F.array().cast(f"array<{_LEAF}>")))
    one = F.array(F.struct(name.alias("name"), col.cast("string").alias("value")))
    return F.when(col.isNotNull(), one).otherwise(F.array().cast(_LEAF))


def _innermost(kind: T.DataType) -> T.DataType:
    return _innermost(kind.elementType) if isinstance(kind, T.ArrayType) else kind


#: What every subtype table has: the place of the object, the object around it, its position in its array and its variant.
_COMMON = ["path", "parent", "pos", "variant"]
_TEXT_NODE = "array<struct<path:string,parent:string,pos:int,variant:string,flags:array<struct<name:string,value:boolean>>,texts:array<struct<name:string,value:string>>>>"


def _read(text: str | None):
    """The dictionary written out in ``text`` as JSON or as a Python literal, else None."""
    if text is None or "{" not in text:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        try:
            value = ast.literal_eval(text.strip())
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None
    return value if isinstance(value, dict) else None


def _text_nodes(name: str, whole: bool):
    def walk(value, path, parent, pos, out):
        flags, texts, children = [], [], []
        for i, (k, v) in enumerate(value.items()):
            spots = [(str(k), v)]
            while any(isinstance(v, (list, tuple)) for _, v in spots):
                spots = [y for k, v in spots for y in ([(f"{k}[{i}]", x) for i, x in enumerate(v)] if isinstance(v, (list, tuple)) else [(k, v)])]
            for k, v in spots:
                if isinstance(v, dict):
                    children.append((k, v, i))
                elif isinstance(v, bool):
                    flags.append({"name": k, "value": v})
                elif v is not None:
                    texts.append({"name": k, "value": str(v)})
        node = {"path": path, "parent": parent, "pos": pos, "flags": flags, "texts": texts}
        out.append(node)
        states = []
        for k, v, i in children:
            state = walk(v, f"{path}.{k}", path, i, out)
            states.append(k + (state if whole else "{}"))
        names = sorted([x["name"] + "?" for x in flags] + [x["name"] + "'" for x in texts] + states)
        node["variant"] = "{" + ",".join(names) + "}"
        return node["variant"]

    @F.pandas_udf(_TEXT_NODE)
    def nodes(texts: pd.Series) -> pd.Series:
        seen: dict = {}
        for t in texts.unique():
            value = _read(t)
            seen[t] = []
            try:
                if value is not None:
                    walk(value, name, "", 0, seen[t])
            except RecursionError:
                seen[t] = []
        return texts.map(lambda t: seen[t])

    return nodes


def subtype_tables(df: DataFrame, key: str, column: str, text_dicts: tuple[str, ...] = (), *, depth: int | None = 1, most_scalars: int | None = None, routed: bool = True) -> dict[str, DataFrame]:
    """One typed table for each kind of object inside ``column``: (key, path, parent, pos, variant, fields), by kind.

    A kind is a place of the schema without positions (``Menus.sections``; the root is ``root``). ``path`` names the object
    from the root (``Menus[0].sections[1]``, the root itself is empty), ``parent`` is the path of the object around it,
    ``pos`` its position in its array. ``variant`` is the state that a bottom-up tree automaton gives to the object: the
    fields present, with the states of the elements in its arrays up to ``depth`` levels; None takes all levels, also
    inside dictionaries in text form. With ``most_scalars``, scalars of objects with more of them are optional and don't tell variants
    apart. ``fields`` has the scalars and arrays of scalars of the object in their own types. Fields of the root in ``text_dicts`` hold dictionaries as
    text; readable ones become objects of a kind of their own, with ``flags`` (true and false) and ``texts``; others give nothing.

    Variants are routed: the staged table of a kind has the rows of one variant together (``shape``), those of a frequent one in
    several files, so that reading one variant skips the others by the files' statistics; :func:`write_variants` gives each a
    folder of its own. Repeated rows count once. A null ``column`` has no objects; null elements of arrays keep their position; an
    empty table gives empty tables; extra columns are ignored, and fields may have any name.
    """
    rows = materialize(df.select(F.col(key).alias(key), F.col(column).alias("obj")).distinct(), "records")
    tables: dict[str, DataFrame] = {}

    def visit(objects: DataFrame, kind: T.StructType, label: str) -> None:
        own = [f for f in kind.fields if _scalar(_innermost(f.dataType)) and not (label == "root" and f.name in text_dicts)]
        fields = F.struct(*[F.col("obj")[f.name].alias(f.name) for f in own]) if own else F.struct(F.lit(None).cast("string").alias("none"))
        tables[label] = objects.select(key, "path", "parent", "pos", _state(F.col("obj"), kind, depth, most_scalars).alias("variant"), fields.alias("fields"))
        for f in kind.fields:
            if _scalar(_innermost(f.dataType)):
                continue
            below = objects.select(key, F.col("path").alias("parent"), _below(F.col("path"), f.name).alias("path"), F.lit(0).alias("pos"), F.col("obj")[f.name].alias("obj"))
            inner = f.dataType
            while isinstance(inner, T.ArrayType):
                below = below.select(key, "parent", "path", F.posexplode("obj").alias("pos", "obj"))
                below = below.withColumn("path", F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
                inner = inner.elementType
            visit(below.filter("obj IS NOT NULL"), inner, f.name if label == "root" else f"{label}.{f.name}")

    root = rows.filter("obj IS NOT NULL").select(key, F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), "obj")
    visit(root, df.schema[column].dataType, "root")
    for name in text_dicts:
        nodes = rows.select(key, F.explode(_text_nodes(name, depth is None)(F.col("obj")[name])).alias("n"))
        tables[name] = nodes.select(key, *[F.col(f"n.{c}").alias(c) for c in _COMMON], F.struct("n.flags", "n.texts").alias("fields"))
    return materialize_all({k: _routed(t) for k, t in tables.items()}, "subtype") if routed else tables


def _routed(table: DataFrame) -> DataFrame:
    shaped = table.withColumn("shape", F.xxhash64("variant"))
    return shaped.hint("rebalance", "shape").sortWithinPartitions("shape")


def write_variants(tables: dict[str, DataFrame], folder: str) -> None:
    """Each variant of each kind as a typed Parquet table in a folder of its own (``kind/shape=…``)."""
    for kind, t in tables.items():
        t.withColumn("shape", F.lower(F.hex(F.xxhash64("variant")))).write.partitionBy("shape").parquet(f"{folder}/{kind}")


def leaf_rows(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, path, leaf): the non-null scalars in the fields of all subtype tables with their full paths."""
    out = None
    for t in tables.values():
        kind = t.schema["fields"].dataType
        text = {f.name for f in kind.fields} == {"flags", "texts"} and isinstance(kind["flags"].dataType, T.ArrayType) and isinstance(kind["flags"].dataType.elementType, T.StructType)
        if text:
            leaves = F.concat(*[F.transform(f"fields.{c}", lambda x: F.struct(x["name"].alias("name"), x["value"].cast("string").alias("value"))) for c in ("flags", "texts")])
        else:
            leaves = F.concat(F.array().cast(_LEAF), *[_scalars(F.col("fields")[f.name], f.dataType, F.lit(f.name)) for f in kind.fields])
        rows = t.select(key, "path", F.explode(leaves).alias("x"))
        rows = rows.select(key, F.when(F.col("path") == "", F.col("x.name")).otherwise(F.concat("path", F.lit("."), "x.name")).alias("path"), F.col("x.value").alias("leaf"))
        out = rows if out is None else out.unionByName(rows)
    return out


def supertype(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, kind, path, parent, pos, variant) of all objects: what the subtype tables have in common."""
    out = None
    for kind, t in tables.items():
        rows = t.select(key, F.lit(kind).alias("kind"), *_COMMON)
        out = rows if out is None else out.unionByName(rows)
    return out


def variants(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, variant, n): the structural variants with their number of objects."""
    key = next(iter(tables.values())).columns[0]
    return supertype(tables, key).groupBy("kind", "variant").agg(F.count("*").alias("n"))


def subtype(tables: dict[str, DataFrame], kind: str, variant: str | None = None) -> DataFrame:
    """The typed rows of one kind, or of one of its variants alone, with a column for each field beside the common ones."""
    t = tables[kind]
    if variant is not None:
        t = t.filter((F.col("shape") == F.xxhash64(F.lit(variant))) & (F.col("variant") == variant))
    return t.select(*[c for c in t.columns if c not in ("fields", "shape")], "fields.*")
