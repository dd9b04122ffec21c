"""Checkpoints of long jobs: small documents with the state of a run, and tables of the keys that are done."""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sinks.writers import write_atomic


class CheckpointStore:
    """Named documents in a folder of the driver, written beside their place and moved there.

    A reader sees the old document or the new one, never half of one. `lock` keeps two drivers from writing one name; a
    lock older than `stale` seconds counts as left behind.
    """

    def __init__(self, folder: str, stale: float = 3600.0):
        self.folder, self.stale = folder, stale
        os.makedirs(folder, exist_ok=True)

    def _path(self, name: str, end: str = ".json") -> str:
        if not name or os.sep in name or name.startswith("."):
            raise ValueError(f"no name for a checkpoint: {name!r}")
        return os.path.join(self.folder, name + end)

    @contextmanager
    def lock(self, name: str, wait: float = 10.0):
        path, end = self._path(name, ".lock"), time.monotonic() + wait
        while True:
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                try:
                    if time.time() - os.path.getmtime(path) > self.stale:
                        os.unlink(path)
                        continue
                except FileNotFoundError:
                    continue
                if time.monotonic() > end:
                    raise TimeoutError(f"{name} is locked") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            os.path.exists(path) and os.unlink(path)

    def save(self, name: str, state: dict) -> None:
        with self.lock(name):
            write_atomic({"saved_at": time.time(), "state": state}, self._path(name))

    def load(self, name: str) -> dict | None:
        """The state last saved; None if there is none or the file is damaged."""
        try:
            with open(self._path(name), encoding="utf-8") as f:
                return json.load(f)["state"]
        except (FileNotFoundError, ValueError, KeyError, TypeError):
            return None

    def names(self) -> list[str]:
        return sorted(f[:-5] for f in os.listdir(self.folder) if f.endswith(".json"))

    def info(self, name: str) -> dict | None:
        """{name, bytes, saved_at, keys} of a checkpoint that can be read."""
        state = self.load(name)
        if state is None:
            return None
        with open(self._path(name), encoding="utf-8") as f:
            return {"name": name, "bytes": os.path.getsize(self._path(name)), "saved_at": json.load(f)["saved_at"], "keys": sorted(state)}

    def delete(self, name: str) -> bool:
        try:
            os.unlink(self._path(name))
        except FileNotFoundError:
            return False
        return True


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def mark_done(done: DataFrame, path: str) -> None:
    """Add the keys of finished work to the table at path, committed as a whole."""
    done.write.mode("append").parquet(path)


def remaining(work: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Work whose keys are not at path yet; all of it before the first mark. Null keys are never done."""
    spark = work.sparkSession
    if not _there(spark, path):
        return work
    return work.join(spark.read.schema(work.select(*keys).schema).parquet(path).distinct(), keys, "left_anti")
