"""SHA-256 of the ordered strings of each group, as one stream.

A digest of a whole group is sequential by its definition.  Rows are dealt by
group and sorted; the task that meets a group feeds one row after another to
the hash and keeps only its state, so memory doesn't grow with the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import arrow_schema


def ordered_digest(rows: DataFrame, group: str, order: list[str], value: str, between: str = "") -> DataFrame:
    """(``group``, sha256, chars) of the strings ``value`` in ``order``, ``between`` put between two of them.
    ``group`` is a long, NULL being a group; ``chars`` are the code points of the values."""
    schema = T.StructType([T.StructField(group, T.LongType()), T.StructField("sha256", T.StringType()),
                           T.StructField("chars", T.LongType())])
    names, gap = arrow_schema(schema), between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, chars, out = None, None, 0, []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or key != now:
                    if state is not None:
                        out.append({group: now, "sha256": state.hexdigest(), "chars": chars})
                    now, state, chars = key, hashlib.sha256(), 0
                else:
                    state.update(gap)
                state.update(text.encode())
                chars += len(text)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema=names)
                out = []
        if state is not None:
            out.append({group: now, "sha256": state.hexdigest(), "chars": chars})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=names)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(group).cast("bigint").alias(group), F.col(value).alias("value"),
                        F.struct(*order).alias("order")).repartition(n, group).sortWithinPartitions(group, "order")
    return dealt.select(group, "value").mapInArrow(run, schema)
