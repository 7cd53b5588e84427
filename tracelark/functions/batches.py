"""Plain Python functions over rows, run in Arrow batches."""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def batched(fn: Callable, schema: str, columns: list[str] | None = None):
    """A column function that applies ``fn`` to each row of a batch; with ``columns`` it returns tuples, a struct's fields."""

    def fields(*args: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(*x) for x in zip(*args)], columns=columns)

    def values(*args: pd.Series) -> pd.Series:
        return pd.Series([fn(*x) for x in zip(*args)], dtype=object)

    return F.pandas_udf(fields if columns else values, schema)
