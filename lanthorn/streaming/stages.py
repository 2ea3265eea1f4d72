"""Both stages of checking on a stream: every batch's first answers are written at once,
then only what is ambiguous is looked at again.

    first = check.checked(stream)
    first.writeStream.foreachBatch(stages.TwoStages(folder, "prompts", ["id"])).option("checkpointLocation", c).start()
    stages.answers(spark, folder, "prompts", ["id"])
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.confirm import DeepContext
from ..operators.risk import Policy
from .check import deep_checked

ANSWER = ("decision", "headline", "summary", "wire", "deeper")


def _folder(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written_whole(spark: SparkSession, path: str) -> bool:
    """Whether a write of this folder was committed."""
    folder, fs = _folder(spark, path + "/_SUCCESS")
    return fs.exists(folder)


class TwoStages:
    """A ``foreachBatch`` function. A batch has a folder of its own for each stage, named by
    the stream (``app``) and the batch id. A batch that comes again, as after a restart,
    leaves what was committed as it is, and writes the rest over what wasn't: nothing stands
    twice. A stream with a new checkpoint needs an ``app`` of its own, since its batches are
    numbered from zero again.

    The batch is kept while both stages read it, in memory and on disk, and is computed again
    where an executor is lost. Batches without ambiguous rows make no second stage."""

    def __init__(self, folder: str, app: str, keys: list[str], text: str = "text", policy: Policy = Policy(), confirmer: DeepContext | None = None):
        self.folder, self.app, self.keys = folder.rstrip("/"), app, keys
        self.text, self.policy, self.confirmer = text, policy, confirmer

    def place(self, stage: int, batch_id: int) -> str:
        return f"{self.folder}/app={self.app}/stage={stage}/batch={batch_id}"

    def put(self, rows: DataFrame, stage: int, batch_id: int) -> None:
        path = self.place(stage, batch_id)
        if not written_whole(rows.sparkSession, path):
            rows.select(*self.keys, *ANSWER).write.mode("overwrite").parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if written_whole(spark, self.place(2, batch_id)):
            return
        first = batch.persist()
        try:
            self.put(first, 1, batch_id)
            # The second stage is written last and marks the batch as done, so it stands for
            # batches without ambiguous rows too, as an empty table.
            self.put(deep_checked(first.where("deeper"), self.text, self.policy, self.confirmer), 2, batch_id)
        finally:
            first.unpersist()


def answers(spark: SparkSession, folder: str, app: str, keys: list[str]) -> DataFrame:
    """The answer of each prompt, ``keys`` and ``ANSWER`` and ``stage``: that of the second
    stage where it has one. Batches whose write wasn't committed are left out."""
    folder, tables = folder.rstrip("/"), []
    for stage in (1, 2):
        root, fs = _folder(spark, f"{folder}/app={app}/stage={stage}")
        done = sorted(p for p in (str(s.getPath().toString()) for s in (fs.listStatus(root) if fs.exists(root) else [])) if written_whole(spark, p))
        if done:
            tables.append(spark.read.option("basePath", str(root.toString())).parquet(*done).withColumn("stage", F.lit(stage)))
    if not tables:
        raise FileNotFoundError(f"no batch of {app} in {folder}")
    rows = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    best = rows.groupBy("batch", *keys).agg(F.max_by(F.struct(*ANSWER, "stage"), "stage").alias("best"))
    return best.select(*keys, "best.*")
