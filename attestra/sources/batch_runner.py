"""A batch run over named texts that can be taken up again.

Texts are worked on in waves; a wave's results are committed together, so that a run that breaks off keeps what its waves have done. The next run skips what has a result, tries failures again, and does the rest; forced, it does everything anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.sources.folders import written
from attestra.sources.versions import Versions

_RESULTS = "slug string, status string, result string, error string, run int"


class BatchRunner:
    """root: a folder that driver and executors share. work gives a text's result; what it raises is that text's failure and no other's. before_wave: called with a wave's number; what it raises ends the run there."""

    def __init__(self, spark: SparkSession, root: str, work: Callable[[str], str], waves: int = 8, before_wave: Callable[[int], None] | None = None):
        self.spark, self.versions, self.work, self.waves, self._before_wave = spark, Versions(spark, root), work, waves, before_wave

    def _rows(self) -> DataFrame:
        folders = self.versions.parts().get("results", [])
        return self.versions.read(folders, _RESULTS) if folders else self.spark.createDataFrame([], _RESULTS)

    def results(self) -> DataFrame:
        """slug, status (ok or failed), result and error of all that was ever worked on, as the last run left it."""
        last = self._rows().groupBy("slug").agg(F.max_by(F.struct("status", "result", "error"), "run").alias("r"))
        return last.select("slug", "r.*")

    def run(self, inputs: DataFrame, force: bool = False) -> DataFrame:
        """Work on inputs (slug and text; of a slug that is there several times the least text). The run's manifest: slug, status (ok, skipped or failed) and error."""
        number, work = len(self.versions.parts().get("runs", [])), self.work
        self.versions.change(lambda parts: parts | {"runs": [*parts.get("runs", []), str(number)]})
        one = inputs.where("slug IS NOT NULL").groupBy(F.col("slug").cast("string").alias("slug")).agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
        done = self.results().where("status = 'ok'").select("slug").withColumn("done", F.lit(not force))
        listed = written(one.join(done, "slug", "left").select("slug", "text", F.coalesce("done", F.lit(False)).alias("done"), F.pmod(F.xxhash64("slug"), F.lit(self.waves)).cast("int").alias("wave")))

        def attempt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for slug, text in zip(batch["slug"], batch["text"], strict=True):
                    try:
                        rows.append((slug, "ok", work(text), None, number))
                    except Exception as error:  # noqa: BLE001
                        rows.append((slug, "failed", None, f"{type(error).__name__}: {error}", number))
                yield pd.DataFrame(rows, columns=["slug", "status", "result", "error", "run"])

        todo = listed.where("NOT done")
        for wave in range(self.waves):
            if self._before_wave:
                self._before_wave(wave)
            (folders,) = self.versions.write(todo.where(F.col("wave") == wave).select("slug", "text").mapInPandas(attempt, _RESULTS)).values()
            self.versions.change(lambda parts, new=folders: parts | {"results": [*parts.get("results", []), *new]})
        made = self._rows().where(F.col("run") == number).select("slug", "status", "error")
        return made.unionByName(listed.where("done").select("slug", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error")))
