"""User functions from a file to sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def sequence_accessor(files: DataFrame, read: Callable[[str], Iterator[dict]], schema: str, column: str = "path") -> DataFrame:
    """Rows that ``read(path)`` yields for every listed file; files are spread over the tasks and read one by one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf[column]:
                rows = list(read(path))
                if rows:
                    yield pd.DataFrame(rows)

    return files.select(column).mapInPandas(each, schema)
