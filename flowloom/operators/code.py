"""User code over rows and over groups, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.rows import Flows
from flowloom.shared import kept


def python_rows(df: DataFrame, function: Callable[[dict], dict | None], schema: str) -> Flows:
    """function takes each row as a dict and returns the output row (None: no row); a row it fails on goes to reject with errorMessage "Type: text".

    Values are Python's own, nulls None. The code runs once for each row: what it
    made is kept in the shared checkpoint folder, and both flows read it from there.
    """
    source = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema)
    made = df.sparkSession.createDataFrame([], schema).schema
    outcome = df.sparkSession.createDataFrame([], f"made {made.simpleString()}, source struct<{source}>, errorMessage string").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(outcome)
        for x in batches:
            out = []
            for row in x.to_pylist():
                try:
                    result = function(dict(row))
                    if result is not None:
                        out.append({"made": {f.name: result.get(f.name) for f in made}, "source": None, "errorMessage": None})
                except Exception as e:  # the user's code may raise anything
                    out.append({"made": None, "source": row, "errorMessage": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=to)

    both = kept(df.mapInArrow(work, outcome))
    return {"main": both.where(F.col("errorMessage").isNull()).select("made.*"), "reject": both.where(F.col("errorMessage").isNotNull()).select("source.*", "errorMessage")}


def python_groups(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """pandas code over each group of keys; a group must fit a task's memory."""
    return df.groupBy(*keys).applyInPandas(function, schema)
