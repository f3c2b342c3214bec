"""JSON texts as typed columns, whose names and types are found in the data."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

_KIND = re.compile(r"\bOBJECT<")


def schema_of(rows: DataFrame, column: str) -> StructType:
    """The fields of all objects in a column of JSON texts and the types that hold all their
    values, from one pass: tasks merge the types they see, and only the result reaches the driver.
    Texts that are no JSON have no say, nor do values that are no objects."""
    value = F.try_parse_json(column)
    kind = rows.filter(F.schema_of_variant(value).startswith("OBJECT")).agg(F.schema_of_variant_agg(value)).first()[0]
    found = DataType.fromDDL(_KIND.sub("STRUCT<", kind)) if kind else StructType()
    return found if isinstance(found, StructType) else StructType()


def _leaves(schema: StructType, path: str, name: str) -> list[tuple[str, str, str]]:
    found = []
    for field in schema:
        here = f"{path}['{field.name}']", f"{name}_{field.name}" if name else field.name
        if isinstance(field.dataType, StructType):
            found += _leaves(field.dataType, *here)
        elif field.dataType.typeName() != "void":
            found.append((*here, field.dataType.simpleString()))
    return found


def shredded(rows: DataFrame, column: str, schema: StructType | None = None, prefix: str = "") -> DataFrame:
    """Adds a typed column for each field in the JSON texts of `column`, nested ones as outer_inner;
    fields of several types stay variants. With the `schema` given, the rows are read once only.

    - A null, a text that is no JSON, a missing field or a value that doesn't fit gives null.
    - A field that is null everywhere gets no column. `prefix` keeps names from clashing.
    """
    schema = schema_of(rows, column) if schema is None else schema
    parsed = rows.withColumn("_variant", F.try_parse_json(column))
    fields = [F.try_variant_get("_variant", path, kind).alias(prefix + name) for path, name, kind in _leaves(schema, "$", "")]
    return parsed.select(*rows.columns, *fields)
