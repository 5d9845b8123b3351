"""The feature store: chunks of features, a ledger of their keys and the open failures, for batch and stream alike.

path/commit=<name>/feature_file=<prefix>_007/   chunks of one commit
path/_store                                     commit log with two kinds of rows: keys, failures

A commit's chunks, keys and failures count from the moment its marker exists. Its number and its chunk numbers
follow the commit before; if another writer was first, the rows that it has stored are left out and the rest is written on top of
it. Keys are read from the ledger, never from the chunks. Every few commits the ledger is compacted into one table bucketed by key,
which later anti-joins read without shuffling it.

Chunks that were in the folder before the first commit are part of the store; their keys are taken into the ledger by it.
"""

import hashlib
import math
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schema
from kindred.operators.catalogue import incremental_todo
from kindred.operators.extraction import counting, feature_columns
from kindred.operators.skew import SENT_ROWS, sent_if_small
from kindred.runtime import stored
from kindred.sinks.commits import CommitLog, State, fresh_name
from kindred.sinks.features import write_feature_files
from kindred.sources import features as sources

IMAGE_COLUMNS = schema.IMAGE_LIST.fieldNames()
KEYS = "image_uuid string"
FAILURES = ", ".join(f"{c} string" for c in IMAGE_COLUMNS) + ", reason string"
# Commits after a snapshot before the next one, and the share of its rows they must have brought; many small ones are
# compacted in any case.
COMMITS, SHARE, MOST_COMMITS = 16, 0.1, 128
# Keys of one bucket of the compacted ledger.
BUCKET_KEYS = 5_000_000


@dataclass(frozen=True)
class Outcome:
    """Results of a scoring job, and its numbers: success, failed, seconds."""

    scored: DataFrame
    counts: dict


class FeatureStore:
    def __init__(self, spark: SparkSession, path: str, compact_after: int = COMMITS):
        self.spark, self.path, self.compact_after = spark, path, compact_after
        self.log = CommitLog(spark, f"{path}/_store")

    # Reading

    def _rows(self, kind: str, columns: str, state: State, after: int = 0) -> DataFrame:
        folders = self.log.folders(kind, state, after)
        return self.spark.read.schema(columns).parquet(*folders) if folders else self.spark.createDataFrame([], columns)

    def _compacted(self, state: State) -> DataFrame | None:
        """The snapshot's keys as a bucketed table, declared over its files where this session does not know it."""
        if state.snapshot is None:
            return None
        folder = self.log.folder("keys", state.snapshot)
        table = "kindred_keys_" + hashlib.md5(folder.encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (image_uuid STRING) USING parquet CLUSTERED BY (image_uuid)"
            f" SORTED BY (image_uuid) INTO {state.snapshot.info['buckets']} BUCKETS LOCATION '{folder}'"
        )
        return self.spark.table(table)

    def keys(self, state: State | None = None) -> DataFrame:
        """image_uuid of every stored feature, once each."""
        state = state or self.log.state()
        if state.number == 0:
            return sources.keys_of_chunks(self.spark, self.path)
        return self._rows("keys", KEYS, state)

    def missing(self, images: DataFrame, state: State | None = None, rows: int | None = None) -> DataFrame:
        """Images that have no stored feature. rows: their number, if known.

        The keys of a small batch go to the ledger's tasks. A large one meets the compacted ledger bucket by bucket, and then the
        few keys committed since.
        """
        state = state or self.log.state()
        if state.number == 0:
            return incremental_todo(images, self.keys(state))
        if rows is not None and rows <= SENT_ROWS:
            wanted = sent_if_small(images.select("image_uuid"), rows)
            return incremental_todo(images, self.keys(state).join(wanted, "image_uuid", "left_semi"))
        compacted, left = self._compacted(state), images
        if compacted is not None:
            left = incremental_todo(left, compacted)
        later = state.snapshot.number if state.snapshot else 0
        return incremental_todo(left, self._rows("keys", KEYS, state, later)) if state.later else left

    def open_failures(self, state: State | None = None) -> DataFrame:
        """Images whose last try failed and that have no feature since: image_uuid, image_url, image_original_name, reason."""
        state = state or self.log.state()
        failed = self._rows("failures", FAILURES, state).dropDuplicates(["image_uuid"])
        return self.missing(failed, state)

    def has(self, run: str, batch: int, state: State | None = None) -> bool:
        """Whether a stream's batch is committed."""
        return (state or self.log.state()).runs().get(run, -1) >= batch

    def history(self) -> DataFrame:
        """What each commit did, also of runs that go on: number, run, batch, success, failed, seconds, per_second."""
        columns = ["run", "batch", "success", "failed", "seconds"]
        rows = [(c.number, *(c.info.get(x) for x in columns)) for c in self.log.all() if "success" in c.info]
        shape = "number bigint, run string, batch bigint, success bigint, failed bigint, seconds double"
        rate = F.round(F.col("success") / F.nullif(F.col("seconds"), F.lit(0.0)), 1)
        return self.spark.createDataFrame(rows, shape).withColumn("per_second", rate)

    # Writing

    def adopt(self) -> bool:
        """Take the keys of chunks that no commit has written into the ledger; false if there are none."""
        state = self.log.state()
        known = self._rows("keys", KEYS, state)
        fresh = stored(sources.keys_of_chunks(self.spark, self.path).join(known, "image_uuid", "left_anti"), "keys")
        if fresh.isEmpty():
            return False
        name, rows = fresh_name(), fresh.count()
        self._write_lists(name, fresh, None)
        last = max(sources.chunk_index(self.spark, self.path), state.newest.info["last_chunk"] if state.newest else 0)
        return self.log.commit(state.number + 1, name, last_chunk=last, rows=rows) or self.adopt()

    def _write_lists(self, name: str, keys: DataFrame, failures: DataFrame | None) -> None:
        keys.write.mode("overwrite").parquet(self.log.folder("keys", name))
        failures = self.spark.createDataFrame([], FAILURES) if failures is None else failures
        failures.write.mode("overwrite").parquet(self.log.folder("failures", name))

    def commit(self, scored: DataFrame, images: DataFrame, run: str | None = None, batch: int | None = None) -> Outcome:
        """Append the results of a scoring job as one commit; returns them, stored, and how many succeeded and failed.

        images: the scored images' rows, from which those that failed are remembered. run and batch: of a stream, which may
        repeat a batch; one that is committed is not appended again.
        """
        state = self.log.state()
        if state.number == 0 and self.adopt():
            state = self.log.state()
        # Scoring is the costly step: its results are written once. A lost executor does not make the model run again.
        counted, seen = counting(scored)
        began = time.monotonic()
        scored = stored(counted, "scored", ("status",))
        told = {**seen.get, "seconds": round(time.monotonic() - began, 3)}
        failed = scored.filter(F.col("status") == "failed").select("image_uuid", "reason").dropDuplicates(["image_uuid"])
        again = stored(images.select(*IMAGE_COLUMNS).dropDuplicates(["image_uuid"]).join(failed, "image_uuid"), "failed")
        ok = scored.filter(F.col("status") == "ok")
        begun = state.number
        while run is None or not self.has(run, batch, state):
            # Rows that another writer has committed since this one began are not appended twice.
            fresh = ok if state.number == begun else stored(self.missing(ok, state), "ok")
            last, name = state.newest.info["last_chunk"] if state.newest else 0, fresh_name()
            rows = told["success"] if fresh is ok else fresh.count()
            chunks = write_feature_files(fresh, f"{self.path}/commit={name}", start=last, shape=feature_columns, count=rows)
            self._write_lists(name, fresh.select("image_uuid").distinct(), again)
            about = {**told, "run": run, "batch": batch} if run is not None else told
            if self.log.commit(state.number + 1, name, last_chunk=last + chunks, rows=rows, **about):
                self._compact_if_due()
                break
            state = self.log.state()
        return Outcome(scored, told)

    def _compact_if_due(self) -> None:
        state = self.log.state()
        brought = sum(c.info["rows"] for c in state.later)
        held = state.snapshot.info["rows"] if state.snapshot else 0
        if len(state.later) >= MOST_COMMITS or (len(state.later) >= self.compact_after and brought >= SHARE * held):
            self.compact(state)

    def compact(self, state: State | None = None) -> None:
        """Merge the ledger and the open failures of all commits so far into one snapshot."""
        state = state or self.log.state()
        if not state.later:
            return
        name = fresh_name()
        rows = sum(c.info["rows"] for c in (state.snapshot, *state.later) if c)
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET_KEYS))
        folder = self.log.folder("keys", name)
        table = "kindred_keys_" + hashlib.md5(folder.encode()).hexdigest()
        dealt = self.keys(state).repartition(buckets, "image_uuid")
        dealt.write.bucketBy(buckets, "image_uuid").sortBy("image_uuid").option("path", folder).saveAsTable(table)
        self.open_failures(state).select(*IMAGE_COLUMNS, "reason").write.parquet(self.log.folder("failures", name))
        names = [(c.name,) for c in state.later]
        listed = self.spark.createDataFrame(names, "name string")
        if state.snapshot:
            listed = listed.unionByName(self.spark.read.parquet(self.log.folder("names", state.snapshot)))
        listed.coalesce(1).write.parquet(self.log.folder("names", name))
        self.log.snapshot(state, name, last_chunk=state.newest.info["last_chunk"], rows=rows, buckets=buckets)
