"""Deeply nested records as related flat tables.

``merged_schema`` infers one schema from JSON texts that differ in their fields. ``flatten_nested`` walks a
schema and makes one child table of each array level: the record's key, the 0-based ordinals of all levels down to the
child (together its surrogate key; all but the last are its parent's) and the scalar fields. ``child_keys`` gives only
those keys, for all tables at once.

Defined cases: a null or empty array has no children; a null element is a child whose fields are null; a null row of an
array of arrays has no cells; fields missing in the schema are absent; a field that clashes with a key column gets the
table's name in front. Rows with a null key keep their children under the null key.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from leafmill.session import drop_redelivered

ORDINALS = ("i", "j", "k", "l", "m", "n")


@dataclass(frozen=True)
class Level:
    """One child table: the path of its array, how many arrays are nested directly, the element's type."""

    name: str
    path: tuple[str, ...]
    parent: str | None
    depth: int
    nested: int
    element: T.DataType


def merged_schema(texts: DataFrame, column: str) -> T.StructType:
    """The merged schema of all JSON objects in ``column``: one distributed pass, fields of all rows united."""
    ddl = texts.filter(F.col(column).isNotNull()).agg(F.expr(f"schema_of_variant_agg(try_parse_json(`{column}`))")).head()[0]
    ddl = (ddl or "VOID").replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING")
    kind = T.DataType.fromDDL(ddl) if ddl != "VOID" else T.NullType()
    return kind if isinstance(kind, T.StructType) else T.StructType([])


def parse_records(texts: DataFrame, column: str, schema: T.StructType | None = None, into: str = "record") -> DataFrame:
    """JSON texts as nested columns; a text that can't be parsed gives a null record."""
    return texts.withColumn(into, F.from_json(column, schema or merged_schema(texts, column)))


def levels(schema: T.StructType, keep: Iterable[str] = (), skip: Iterable[str] = ()) -> list[Level]:
    """All array levels below ``schema``, parents first. Arrays named in ``keep`` stay values of their table."""
    keep, skip, out = set(keep), set(skip), []

    def walk(struct: T.StructType, name: str, path: tuple[str, ...], parent: str | None, depth: int) -> None:
        for f in struct.fields:
            here, full = (*path, f.name), f"{name}.{f.name}" if name else f.name
            if full in skip or full in keep:
                continue
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, full, here, parent, depth)
            elif isinstance(f.dataType, T.ArrayType):
                kind, nested = f.dataType.elementType, 1
                while isinstance(kind, T.ArrayType):
                    kind, nested = kind.elementType, nested + 1
                out.append(Level(full, here, parent, depth + nested, nested, kind))
                if isinstance(kind, T.StructType):
                    walk(kind, full, (), full, depth + nested)

    walk(schema, "", (), None, 0)
    return out


def _inside(value: Column, path: tuple[str, ...]) -> Column:
    for p in path:
        value = value.getField(p)
    return value


def exploded(df: DataFrame, key: str, chain: list[Level], *keep: Column) -> DataFrame:
    """(key, *keep, ordinals, _v): the elements of the last level of ``chain``, each level exploded from its parent's."""
    carried, depth, first = [F.col(f"`{key}`"), *keep], 0, True
    for lv in chain:
        value = F.col(".".join(f"`{p}`" for p in lv.path)) if first else _inside(F.col("_v"), lv.path)
        for n in range(lv.nested):
            df = df.select(*carried, F.posexplode(value if n == 0 else F.col("_v")).alias(ORDINALS[depth], "_v"))
            depth += 1
            carried = [F.col(f"`{c}`") for c in df.columns if c != "_v"]
        first = False
    return df


def flatten_nested(df: DataFrame, key: str, keep: Iterable[str] = (), skip: Iterable[str] = ()) -> dict[str, DataFrame]:
    """Every array level of ``df`` as a flat table, by its dotted path; "" is the table of the records themselves.

    No shuffle: each table is a chain of generators over the record, of which only its own columns are read.
    """
    found = levels(df.schema, keep, skip)
    tops = {x.path[0] for x in found if x.parent is None}
    out = {"": df.select(key, *[f"`{c}`" for c in df.columns if c not in tops and c != key])}
    for x in found:
        t, depth = exploded(df, key, _chain(found, x)), x.depth
        carried = [f"`{key}`", *ORDINALS[:depth]]
        taken = {key.lower(), *ORDINALS[:depth]}
        if isinstance(x.element, T.StructType):
            nested_here = {c.path[0] for c in found if c.parent == x.name}
            fields = [f.name for f in x.element.fields if f.name not in nested_here]
            values = [F.col("_v").getField(f).alias(f if f.lower() not in taken else f"{x.name.replace('.', '_')}_{f}") for f in fields]
        else:
            values = [F.col("_v").alias("value" if "value" not in taken else f"{x.name.replace('.', '_')}_value")]
        out[x.name] = t.select(*carried, *values)
    return out


def _chain(found: list[Level], x: Level) -> list[Level]:
    """A level with its parents, the topmost first."""
    by, chain = {y.name: y for y in found}, [x]
    while chain[0].parent:
        chain = [by[chain[0].parent], *chain]
    return chain


def child_keys(
    df: DataFrame, key: str, names: dict[str, str], single: dict[str, str] | None = None, refs: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """(key, child, i, j, k) of every child row of the array levels found in the schema, by recursive explosion: each level
    explodes its parent's rows and carries the record's key and all ordinals down to its own. Unused places are -1.

    ``names`` gives the levels' child names (path -> name); levels without one are no tables of their own. ``single`` names
    arrays that are one value of their parent, a child only where they aren't null. ``refs`` gives, by the path of an array
    of references, the path of the numbers they point at and a child name: reference j of row i is a child with k = its
    number if that number exists in the record; null references and those without a target have no row. Nothing is
    shuffled; of each level only what tells its rows apart is read.
    """
    single, refs = single or {}, refs or {}
    found = levels(df.schema)
    parts = []

    def part(rows: DataFrame, child: str, places: list[str]) -> None:
        at = [*[F.col(p) for p in places], *[F.lit(-1)] * 3][:3]
        parts.append(rows.select(key, F.lit(child).alias("child"), *[a.cast("int").alias(n) for a, n in zip(at, "ijk")]))

    for x in found:
        if x.name in names:
            part(exploded(df, key, _chain(found, x)), names[x.name], list(ORDINALS[: x.depth]))
        elif x.name in single:
            rows = exploded(df, key, _chain(found, x)[:-1])
            part(rows.filter(_inside(F.col("_v"), x.path).isNotNull()), single[x.name], list(ORDINALS[: x.depth - 1]))
        elif x.name in refs:
            to, child = refs[x.name]
            numbers = F.col(".".join(f"`{p}`" for p in to.split(".")))
            rows = exploded(df, key, _chain(found, x), numbers.alias("_numbers"))
            # A reference equal to its target's place, the usual case, takes one lookup; only others search.
            hit = F.coalesce(F.get("_numbers", F.col("_v")) == F.col("_v"), F.lit(False)) | F.coalesce(F.array_contains("_numbers", F.col("_v")), F.lit(False))
            part(rows.filter(F.col("_v").isNotNull() & hit), child, [*ORDINALS[: x.depth], "_v"])
    empty = df.sparkSession.createDataFrame([], T.StructType([df.schema[key], *T.DataType.fromDDL("child string, i int, j int, k int").fields]))
    return reduce(DataFrame.unionByName, parts) if parts else empty


def record_child_keys(records: DataFrame) -> DataFrame:
    """The child rows of each distinct extraction record: block, bbox, table, cell, chunk and link. Redelivered rows (same
    record_id) count once; two narrow columns tell which they are."""
    return child_keys(
        drop_redelivered(records, "record_id", "loaded_at"),
        "record_id",
        {"blocks": "block", "tables": "table", "tables.cells": "cell", "chunks": "chunk"},
        {"blocks.bbox": "bbox"},
        {"chunks.block_ids": ("blocks.order", "link")},
    )
