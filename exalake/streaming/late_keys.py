"""Answer keys and exams as a stream of files: a key waits for its exam, and is applied again to each new version of either."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: A file: what it is for, whether it is an exam or a key, its version, and its numbers with values (an exam's are null).
FILES = "exam string, kind string, version int, entries array<struct<no:string,value:string>>, at timestamp"
APPLIED = "exam string, exam_version int, key_version int, no string, value string, status string"
#: State is kept in RocksDB, which timers and several values a key need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = "version int, entries array<struct<no:string,value:string>>"


class KeysMeetExams(StatefulProcessor):
    """One exam: the newest version of the exam and of its key.  A version that is not newer than the one held changes nothing."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = {kind: handle.getValueState(kind, _HELD) for kind in ("exam", "key")}

    def _of(self, kind: str) -> tuple[int, list] | None:
        if not self.held[kind].exists():
            return None
        version, entries = self.held[kind].get()
        return version, [(e["no"], e["value"]) for e in entries]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        changed = False
        # files of one batch come in no order; of one version the first by time counts
        for r in sorted(rows, key=lambda r: (r.version, r.at)):
            now = self._of(r.kind)
            if now is None or r.version > now[0]:
                self.held[r.kind].update((r.version, [(e["no"], e["value"]) for e in r.entries or []]))
                changed = True
                if r.kind == "key" and self._of("exam") is None:
                    self.handle.registerTimer(int(r.received.timestamp() * 1000) + self.wait_ms)
        exam, answers = self._of("exam"), self._of("key")
        if changed and exam and answers:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            value = {}
            for no, v in answers[1]:
                value.setdefault(no, v)
            asked = [no for no, _ in exam[1]]
            for no in dict.fromkeys(asked):
                yield Row(exam=key[0], exam_version=exam[0], key_version=answers[0], no=no, value=value.get(no), status="answered" if no in value else "missing")
            for no in value.keys() - set(asked):
                yield Row(exam=key[0], exam_version=exam[0], key_version=answers[0], no=no, value=value[no], status="unused")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        answers = self._of("key")
        if answers and self._of("exam") is None:
            yield Row(exam=key[0], exam_version=None, key_version=answers[0], no=None, value=None, status="no_exam")

    def close(self) -> None:
        pass


def read_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of FILES below folder, as they arrive, with the time at which each was written (received)."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_batch).parquet(folder).select("*", F.col("_metadata.file_modification_time").alias("received"))


def applied(files: DataFrame, wait_ms: int = 7_200_000, late: str = "10 minutes") -> DataFrame:
    """APPLIED rows: each time an exam or its key gets a newer version and both are there, every number of both with its value.

    status is answered, missing (the key lacks the number), unused (the exam lacks it), or no_exam: one row for a key that was
    received `wait_ms` ago without an exam.  It goes on waiting.  By its own time (`at`) nothing is too late: that only orders
    files of one version.  The clock is the time of receipt; a file that was received more than `late` before others that
    have been read is left out.  Repeated files, older versions and rows of another kind or without an exam change nothing.
    Of a number that a key has twice the first value counts.  State is two values an exam, dealt by exam.
    """
    files.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = files.where(F.col("exam").isNotNull() & F.col("kind").isin("exam", "key") & F.col("version").isNotNull() & F.col("at").isNotNull())
    return known.withWatermark("received", late).groupBy("exam").transformWithState(KeysMeetExams(wait_ms), APPLIED, "Append", "EventTime")


def write_applied(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Applied rows to Parquet, once each; runs until what is there now is read."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
