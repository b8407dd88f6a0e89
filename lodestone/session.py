"""Session helpers: a tuned local session and the folder that checkpoints go to."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from collections.abc import Iterator
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir().rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of ``df`` (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder (smaller than a checkpoint)."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def lent(spark: SparkSession, value: Any) -> Iterator[Broadcast]:
    """A broadcast for the jobs that run meanwhile; then driver and executors drop it at once, not when garbage is collected."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stored``, with aggregates of the rows taken while they are written; 0 where there are none."""
    watch = Observation()
    table = stored(df.observe(watch, *[m.alias(k) for k, m in metrics.items()]), name)
    return table, {k: v or 0 for k, v in watch.get.items()}


#: What is summed over the finished tasks, and the status store's name for it.
TASK_SUMS = {
    "run_ms": "executorRunTime", "cpu_ns": "executorCpuTime", "gc_ms": "jvmGcTime", "input_bytes": "inputBytes", "shuffle_read_bytes": "shuffleReadBytes",
    "shuffle_write_bytes": "shuffleWriteBytes", "spilled_bytes": "diskBytesSpilled", "tasks": "numCompleteTasks",
}


def task_sums(spark: SparkSession, after: int = -1, only_last: bool = False) -> tuple[int, dict[str, int]]:
    """The number of the last stage, and sums over the stages after ``after`` (without ``only_last``); no sums where the session has no status store."""
    try:
        core = spark.sparkContext._jsc.sc()
        core.listenerBus().waitUntilEmpty()
        gateway = spark.sparkContext._gateway
        stages = core.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        n, last, sums = stages.size(), after, dict.fromkeys(TASK_SUMS, 0)
        newest_first = n > 1 and stages.apply(0).stageId() > stages.apply(n - 1).stageId()
        for i in range(n) if newest_first else range(n - 1, -1, -1):
            stage = stages.apply(i)
            if stage.stageId() <= after:
                break
            last = max(last, stage.stageId())
            if only_last:
                break
            for name, field in TASK_SUMS.items():
                sums[name] += int(getattr(stage, field)())
        return last, sums
    except Exception:  # noqa: BLE001  a report without these figures is still one
        return after, {}


class Phases:
    """Wall clock and task sums between marks."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seconds, self.tasks = spark, {}, {}
        self.at, self.stage = time.perf_counter(), task_sums(spark, only_last=True)[0]

    def mark(self, name: str) -> None:
        """Ends the phase ``name``; a phase marked again goes on."""
        now = time.perf_counter()
        self.stage, sums = task_sums(self.spark, self.stage)
        self.seconds[name] = self.seconds.get(name, 0.0) + now - self.at
        before = self.tasks.get(name, {})
        self.tasks[name] = {k: before.get(k, 0) + v for k, v in sums.items()}
        self.at = now
