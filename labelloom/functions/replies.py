"""Reading model replies: strict category JSON, content blocks, usage and cost."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("input", T.MapType(T.StringType(), T.StringType())),
])
USAGE = T.StructType([
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cache_read_input_tokens", T.LongType()),
    T.StructField("cache_creation_input_tokens", T.LongType()),
])
BATCH_REPLY = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("content", T.ArrayType(BLOCK)),
    T.StructField("usage", USAGE),
])

# Dollars per million tokens, and the batch discount.
PRICE_PER_MTOK = {"input": 3.0, "output": 15.0, "cache_read": 0.30}
BATCH_DISCOUNT = 0.5


def _category(content: str | None) -> str | None:
    try:
        value = json.loads(content)
    except (TypeError, ValueError, RecursionError):
        return None
    name = value.get("category") if isinstance(value, dict) else None
    return name if isinstance(name, str) and _encodable(name) else None


def _encodable(text: str) -> bool:
    """Whether a string is text: JSON may spell half of a surrogate pair, which no column can hold."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


@F.pandas_udf(T.StringType())
def reply_category(content: pd.Series) -> pd.Series:
    """The string under "category" of a reply that is exactly one JSON object, else null.

    Spark's own JSON functions accept trailing text and turn numbers into
    strings, so the strict parse is an Arrow UDF. Whether the name is a known
    class is a join with the label dimension.
    """
    return content.map(_category, na_action="ignore").astype(object)


@F.pandas_udf(T.BooleanType())
def is_strict_json(content: pd.Series) -> pd.Series:
    """Whether the text is exactly one JSON object."""
    def check(text):
        try:
            return isinstance(json.loads(text), dict)
        except (TypeError, ValueError, RecursionError):
            return False
    return content.map(check)


def first_text(content: Column) -> Column:
    """Trimmed text of the first text block; empty when there is none."""
    from labelloom.functions.text import strip_spaces

    block = F.try_element_at(F.filter(content, lambda b: b["type"] == "text"), F.lit(1))
    return F.coalesce(strip_spaces(block["text"]), F.lit(""))


def first_tool_input(content: Column) -> Column:
    """Input of the first tool block as JSON text; ``{}`` when there is none."""
    block = F.try_element_at(F.filter(content, lambda b: b["type"] == "tool_use"), F.lit(1))
    return F.coalesce(F.to_json(block["input"]), F.lit("{}"))


def request_cost(input_tokens: Column, output_tokens: Column, cache_read: Column, *,
                 batch: Column | bool, price: dict[str, Column | float] | None = None) -> Column:
    """Dollars for one request. Prices may be columns of a joined price table."""
    price = price or PRICE_PER_MTOK
    as_col = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in price.items()}
    full = (
        F.coalesce(input_tokens, F.lit(0)) / F.lit(1e6) * as_col["input"]
        + F.coalesce(output_tokens, F.lit(0)) / F.lit(1e6) * as_col["output"]
        + F.coalesce(cache_read, F.lit(0)) / F.lit(1e6) * as_col["cache_read"]
    )
    discounted = batch if isinstance(batch, Column) else F.lit(batch)
    return F.when(discounted, full * F.lit(BATCH_DISCOUNT)).otherwise(full)
