"""Runs as a library: what clients ask of a server, over tables in a folder that all processes share.

Every request is an event that is appended as Parquet; nothing else is kept. A run's state is what its events make of it, so any number of processes may ask
and tell at once, and asking about many runs is one query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions import maps, strings
from .operators import ledger, raster
from .sources import features, files, tiles

EVENTS = "run_id string, seq bigint, kind string, path string, bytes bigint, detail map<string,string>, at timestamp"


class Refused(ValueError):
    """A request that the run's status, or its own words, don't allow; the reason is its message."""


class Runs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/events")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.folder}/events")

    def status(self) -> DataFrame:
        """(run_id, status, upload_count, upload_bytes) of all runs."""
        e = self.events()
        last = ledger.run_state(e, ["run_id"], ["seq", "at"]).groupBy("run_id").agg(F.max_by("status", F.struct("seq", "at")).alias("status"))
        return last.join(e.where("kind = 'upload'").groupBy("run_id").agg(F.count("*").alias("upload_count"), F.sum("bytes").alias("upload_bytes")), "run_id", "left").na.fill(0, ["upload_count", "upload_bytes"])

    def _tell(self, run_id: str, kind: str, path: str | None = None, size: int | None = None, detail: dict[str, str] | None = None) -> None:
        n = self.events().where(F.col("run_id") == run_id).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        row = self.spark.createDataFrame([(run_id, n + 1, kind, path, size, detail)], EVENTS.rpartition(",")[0])
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/events")

    def _allowed(self, run_id: str, action: str) -> str | None:
        """The run's status after the action."""
        asked = self.spark.createDataFrame([(run_id, action)], "run_id string, action string")
        r = ledger.guarded(asked, self.status()).first()
        if not r.ok:
            raise Refused(r.reason)
        return r.status

    def create(self, agent: str, detail: dict[str, str] | None = None) -> str:
        """A new run's id: its time of creation and six digits."""
        if agent not in maps.AGENTS:
            raise Refused("invalid_agent")
        run_id = self.spark.range(1).select(strings.run_id(F.current_timestamp(), F.lit(uuid.uuid4().hex))).first()[0]
        self._tell(run_id, "create", detail={"agent": agent, **(detail or {})})
        return run_id

    def upload(self, run_id: str, path: str, size: int) -> None:
        self._allowed(run_id, "upload")
        if path.startswith("/") or ".." in path.split("/"):
            raise Refused("unsafe_path")
        self._tell(run_id, "upload", path, size)

    def finalize(self, run_id: str) -> Row:
        """The bundle's kind and primary file; a bundle that is none ends the run in an error."""
        self._allowed(run_id, "finalize")
        r = files.validate_bundles(self.events().where((F.col("run_id") == run_id) & (F.col("kind") == "upload")).select("run_id", "path")).first()
        if r is None or r.error:
            self._tell(run_id, "fail", detail={"error": r.error if r else "no_files"})
            raise Refused(r.error if r else "no_files")
        self._tell(run_id, "finalize", r.primary)
        return r

    def start(self, run_id: str) -> None:
        self._tell(run_id, "start")

    def finish(self, run_id: str, final_text: str = "") -> None:
        self._tell(run_id, "finish", detail={"final_text": final_text})

    def terminate(self, run_id: str) -> str:
        """The run's status; a run that has ended stays as it is."""
        status = self._allowed(run_id, "terminate")
        if status == "terminated":
            self._tell(run_id, "terminate")
        return status

    def clear(self, run_id: str) -> list[str]:
        """The generated folders of a run that is done, deleted."""
        self._allowed(run_id, "clear")
        return files.delete_generated(self.spark, f"{self.folder}/outputs", run_id)

    def get(self, run_id: str) -> Row:
        self._allowed(run_id, "get")
        return self.status().where(F.col("run_id") == run_id).first()

    def dark_regions(self, pixels: DataFrame, **how) -> DataFrame:
        return raster.dark_regions(pixels, **how)

    def embed(self, slides: DataFrame, extractor: tiles.Extractor, **how) -> DataFrame:
        """Features of slides, kept under the hash of how they were made, and read from there the next time."""
        params = {"extractor": extractor.identifier, "slides": str(slides.select(F.expr("sha2(concat_ws(',', array_sort(collect_list(path))), 256)")).first()[0]), **{k: str(v) for k, v in how.items()}}
        return tiles.cached(self.spark, f"{self.folder}/embeddings", params, lambda: features.extract(slides, extractor, **how))

    def health(self) -> bool:
        return self.spark.range(1).count() == 1
