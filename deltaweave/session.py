"""Session helpers: Python workers' path, and checkpoints in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import this package wherever the driver started.

    On a cluster the package is installed or shipped with the job, and this changes nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def use_checkpoints(spark: SparkSession) -> None:
    """Take the folder of ``spark.checkpoint.dir``. Where it is unset, a local run takes a
    temporary folder of this machine, and a cluster's run fails: executors do not share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)


def empty_frame(spark: SparkSession, schema) -> DataFrame:
    """No rows, in a form that the optimiser sees through: what is joined with it costs nothing."""
    return spark.createDataFrame([], schema).where(F.lit(False))


def known_empty(frame: DataFrame) -> bool:
    """Whether the optimiser proves the frame empty; runs nothing."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    return plan.nodeName() == "LocalRelation" and plan.data().isEmpty()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once, and safe from lost executors."""
    return measured_cut(frame)[0]


def measured_cut(frame: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the bytes of the rows, measured in the same job."""
    out, size, _ = observed_cut(frame)
    return out, size


#: Measured bytes of frames that have been cut, as long as they are in use.
_SIZES: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def known_size(frame: DataFrame) -> int | None:
    """The bytes of a frame that ``cut`` gave, if it is one."""
    return _SIZES.get(frame)


def observed_cut(frame: DataFrame, **aggregates: Column) -> tuple[DataFrame, int, dict]:
    """``measured_cut`` with further aggregates of the rows, all in one job."""
    spark = frame.sparkSession
    if known_empty(frame):
        out = empty_frame(spark, frame.schema)
        _SIZES[out] = 0
        return out, 0, dict.fromkeys(aggregates)
    use_checkpoints(spark)
    seen, out = with_size(frame, **aggregates)
    out = out.checkpoint(eager=True)
    _SIZES[out], found = size_of(seen), observed(seen)
    return out, _SIZES[out], {name: found.get(name) for name in aggregates}


def with_size(frame: DataFrame, **aggregates: Column) -> tuple[Observation, DataFrame]:
    """The frame, observed so that its bytes are known when a job has run over it."""
    seen = Observation(uuid.uuid4().hex)
    # strings and binaries by their bytes; arrays, maps and structs by their text's
    wide = [F.octet_length(f"`{f.name}`") if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(F.struct(f"`{f.name}`"))) for f in frame.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map", "struct")]
    total = F.coalesce(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0)).cast("long")), F.lit(0)).alias("bytes")
    return seen, frame.observe(seen, F.count(F.lit(1)).alias("rows"), total, *(a.alias(name) for name, a in aggregates.items()))


def observed(seen: Observation) -> dict:
    """What was observed; nothing where the planner found during the run that no row can come, and
    left the observation out with the rest of the plan."""
    return seen.get if seen._jo.getRow().length() else {}


def size_of(seen: Observation) -> int:
    """Measured bytes of wide fields, and eight bytes for each of eight fields a row."""
    found = observed(seen)
    return found.get("bytes", 0) + 64 * found.get("rows", 0)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
