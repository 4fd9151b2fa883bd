"""The append-only record log as a stream: resume and the latest success."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from verdictlake.operators.verdicts import latest_nonerror

RECORD = "sample_id string, lineno long, decision string, elapsed double, model string"


def read_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path)


def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The state after a batch: for each sample the newest record, where an
    error never stands for a success."""
    rows = batch if state is None else state.select(batch.columns).unionByName(batch)
    return latest_nonerror(rows).select(batch.columns)


def run(log: DataFrame, state_path: str, checkpoint: str):
    """Keep the state of a log in versions of a table, v=<batch>; a batch that
    is run again writes the same version, so a restart neither loses nor
    doubles records.  The version before the last stays, for that and for
    readers; older ones are deleted."""
    spark = log.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(RECORD).parquet(f"{state_path}/v={number - 1}") if number else None
        fold(state, batch).write.mode("overwrite").parquet(f"{state_path}/v={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/v={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def todo(samples: DataFrame, state: DataFrame) -> DataFrame:
    """Samples without a success yet, for a run that goes on where it ended."""
    done = state.where(F.col("decision") != "ERROR").select("sample_id")
    return samples.join(done, "sample_id", "left_anti")
