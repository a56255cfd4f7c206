"""Expiry of files as a stream: each file is a key with a timer, and what has run out is deleted.

A file's timer is set for its time of change and its kind's lifetime; a later listing of the file sets it anew. When the
timer runs out, the file's path leaves the stream once and its state goes. Deleting is idempotent: a batch that runs again
finds nothing left to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.scalars import OUTPUT_TTL, UPLOAD_TTL

LIFETIMES = {"upload": UPLOAD_TTL, "output": OUTPUT_TTL}


class Lifetime(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = max(int(x) for pdf in rows for x in pdf["expires_ms"])
        if self.expiry.exists():
            at = max(at, self.expiry.get()[0])
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
        if at < timerValues.getCurrentProcessingTimeInMs():
            self.expiry.clear()
            yield pd.DataFrame({"path": [key[0]]})
        else:
            self.expiry.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.expiry.clear()
        yield pd.DataFrame({"path": [key[0]]})

    def close(self) -> None:
        pass


def expiring(files: DataFrame) -> DataFrame:
    """path of files (path, kind, modified) as they run out; of kinds without a lifetime none does."""
    seconds = F.create_map(*[F.lit(x) for kv in LIFETIMES.items() for x in kv])
    ends = (F.col("modified").cast("double") * 1000).cast("bigint") + F.try_element_at(seconds, F.col("kind")) * 1000
    rows = files.select("path", ends.alias("expires_ms")).where("path is not null and expires_ms is not null")
    return rows.groupBy("path").transformWithStateInPandas(Lifetime(), outputStructType="path string", outputMode="append", timeMode="processingTime")


def delete(paths: DataFrame, dry_run: bool = False) -> DataFrame:
    """path, deleted: deletes each file where the rows are, through the store that its path names; false if it isn't there."""
    from lectern.sources.shared import opened

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        for pdf in batches:
            gone = []
            for path in pdf["path"]:
                fs, at = opened(path)
                there = fs.get_file_info(at).type == pafs.FileType.File
                if there and not dry_run:
                    fs.delete_file(at)
                gone.append(there)
            yield pd.DataFrame({"path": pdf["path"], "deleted": gone})

    return paths.select("path").distinct().mapInPandas(run, "path string, deleted boolean")


def sweep(spark: SparkSession, files: DataFrame, state: str, log: str, dry_run: bool = False):
    """Starts a sweep over a stream of listed files; what is deleted (or would be) is written to log, a folder a batch."""
    done = lambda batch, n: delete(batch, dry_run).write.mode("overwrite").parquet(f"{log}/batch={n}")
    return expiring(files).writeStream.option("checkpointLocation", state).foreachBatch(done).trigger(processingTime="1 second").start()
