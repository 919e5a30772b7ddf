"""Session options that a stream reads when it starts, set for that start only."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def options(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set options, named with ``__`` for each dot, and restore what was set before."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def state_on_disk(spark: SparkSession):
    """Queries started inside keep keyed state in RocksDB instead of on the heap."""
    return options(spark, spark__sql__streaming__stateStore__providerClass=STATE_STORE)


def only_with_data(spark: SparkSession):
    """Queries started inside run no micro-batches without data.

    With a time limit on state, empty batches would follow each other without end, and a stream that
    is to end when its input does never would; state past its time goes with the next batch with data.
    """
    return options(spark, spark__sql__streaming__noDataMicroBatches__enabled="false")
