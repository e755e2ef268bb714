"""Arrow functions whose types are only parsed once a session is there."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least partitions of keys from which much wider rows are made: Spark sizes its own by the keys alone.
PARTS = 400


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys over at least PARTS partitions, or as many as the session's shuffles have."""
    return df.repartition(max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def arrow_function(kind: str):
    """Like pandas_udf, but made when it is first applied to columns."""

    def made(f):
        @wraps(f)
        def apply(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return apply

    return made


def grouped_rows(batches, lists: int = 1, most: int = 50_000):
    """The rows of Arrow batches: values of the plain columns, then for each of the last `lists` columns its items as tuples of fields.

    About `most` items of a list are Python objects at a time; the rest stays in Arrow.
    """
    for b in batches:
        plain, nested = b.columns[: b.num_columns - lists], b.columns[b.num_columns - lists :]
        sizes = [c.value_lengths().to_pylist() for c in nested]
        start = total = 0
        for end in range(1, b.num_rows + 1):
            total += sum(s[end - 1] for s in sizes)
            if total < most and end < b.num_rows:
                continue
            items = [list(zip(*(f.to_pylist() for f in c.slice(start, end - start).flatten().flatten()), strict=True)) for c in nested]
            at = [0] * lists
            for k, values in enumerate(zip(*(c.slice(start, end - start).to_pylist() for c in plain), strict=True), start):
                own = []
                for m in range(lists):
                    own.append(items[m][at[m] : at[m] + sizes[m][k]])
                    at[m] += sizes[m][k]
                yield *values, *own
            start, total = end, 0
