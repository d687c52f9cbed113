"""Strict JSON by expressions: whether a text is one JSON object and nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: A field that closes a text, with a value that the text can't know.
_END = "_end_of_text"


def closed(text: Column, schema: StructType, mode: str = "PERMISSIVE") -> tuple[Column, Column]:
    """(items, closing): a text as the first item of an array whose second is a closing
    object with a hash of the text. The parser stops at the end of a first value, so that
    what follows it is not seen; here it breaks the array, or the closing object is not
    found in its place. items are of the schema's type and the closing field."""
    closing = F.xxhash64(text, F.lit("end")).cast("string")
    wrapped = F.concat(F.lit("["), text, F.lit(f',{{"{_END}":"'), closing, F.lit('"}]'))
    kind = ArrayType(StructType([*schema.fields, StructField(_END, StringType())]))
    return F.from_json(wrapped, kind, {"mode": mode, "allowSingleQuotes": "false"}), closing


def whole(items: Column, closing: Column) -> Column:
    """Whether closed() found one object and then its end."""
    return F.coalesce((F.size(items) == 2) & F.get(items, F.lit(0)).isNotNull() & (F.get(items, F.lit(1))[_END] == closing), F.lit(False))


def is_object(text: Column) -> Column:
    """Whether a text is one JSON object: no text before or after it, nothing left open.
    NaN and Infinity are numbers; of a repeated key the last counts."""
    return whole(*closed(text, StructType([])))
