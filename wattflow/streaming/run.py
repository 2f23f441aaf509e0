"""Running a stream to its present end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.shared import Scratch


def drain(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """All rows that a stream gives for the data that is there, written to the shared folder by batch and read back.

    In append mode batches are kept beside each other, in complete mode the last one counts.
    """
    scratch = Scratch(spark, label)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.path}/out/{f'batch={number}' if mode == 'append' else 'batch=0'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{scratch.path}/out").select(*stream.columns)


def drain_in_turns(spark: SparkSession, rows: DataFrame, turn_col: str, turns: int, made: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """All rows that made, a stream of a stream, gives if rows arrive turn after turn (turn_col from 0).

    Each turn's rows are written and the query is run to their end and stopped, so that every turn goes on from the
    state that the one before left in the shared folder.
    """
    scratch = Scratch(spark, label)
    plain = rows.drop(turn_col)
    for turn in range(turns):
        rows.where(rows[turn_col] == turn).select(*plain.columns).write.mode("overwrite").parquet(f"{scratch.path}/in/turn={turn}")
        stream = made(spark.readStream.schema(plain.schema).parquet(f"{scratch.path}/in/*"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{scratch.path}/out/batch={number}")

        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{scratch.path}/state").foreachBatch(keep).trigger(availableNow=True).start()
        query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{scratch.path}/out").select(*stream.columns)
