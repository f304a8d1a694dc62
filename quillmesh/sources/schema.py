"""Schema versions of stored tables: forward-only migrations, each published before the next one, and checks of a table's types."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Tables = dict[str, DataFrame]


class SchemaError(Exception):
    pass


@dataclass(frozen=True)
class Migration:
    version: int
    up: Callable[[Tables], Tables]


def migrate(tables: Tables, current: int, migrations: list[Migration], publish: Callable[[Tables, int], Tables] | None = None) -> tuple[Tables, int]:
    """The tables after all migrations above the current version, in the order of their versions, and the version reached.

    `publish(tables, version)` writes the tables with their version in one commit and returns them as stored; it is called after each migration, so
    that a run that breaks off is resumed at the last whole version. A version above all known ones is refused.
    """
    versions = [m.version for m in migrations]
    if len(set(versions)) < len(versions):
        raise SchemaError("two migrations have one version")
    latest = max(versions, default=0)
    if current > latest:
        raise SchemaError(f"the tables have schema version {current}, this library knows versions up to {latest}")
    for step in sorted((m for m in migrations if m.version > current), key=lambda m: m.version):
        tables, current = step.up(dict(tables)), step.version
        if publish:
            tables = publish(tables, current)
    return tables, current


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns in their order. Nullable columns that it lacks are null; narrower integers and floats are widened; another type, or a lack of a required column, is refused."""
    wider = {("byte", "short"), ("byte", "integer"), ("byte", "long"), ("short", "integer"), ("short", "long"), ("integer", "long"), ("float", "double")}
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for field in schema:
        if field.name not in have:
            if not field.nullable:
                raise SchemaError(f"no column {field.name}")
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        kind = have[field.name]
        if kind != field.dataType and (kind.typeName(), field.dataType.typeName()) not in wider | {("void", field.dataType.typeName())}:
            raise SchemaError(f"column {field.name} is {kind.simpleString()}, expected {field.dataType.simpleString()}")
        out.append(F.col(field.name).cast(field.dataType).alias(field.name))
    return df.select(*out)
