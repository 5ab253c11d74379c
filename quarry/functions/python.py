"""Functions with no JVM form: Python literals, pretty JSON and token trimming, as Arrow-batched UDFs."""

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def literal_to_json(text: pd.Series) -> pd.Series:
    """a Python literal as JSON; null if it isn't one."""

    def one(x):
        try:
            return None if x is None else json.dumps(ast.literal_eval(x))
        except (ValueError, SyntaxError, TypeError):
            return None

    return text.map(one)


@F.pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON with an indent of four and ASCII escapes; null if it isn't JSON."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), indent=4)
        except ValueError:
            return None

    return text.map(one)


def trim_tokens(text: Column, encode, decode, most: int) -> Column:
    """the text of the first tokens; encode and decode are functions of one text and of its tokens."""

    @F.pandas_udf(StringType())
    def trim(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else x if len(ids := encode(x)) <= most else decode(ids[:most]))

    return trim(text)
