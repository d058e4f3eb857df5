"""Shared folders: checkpoints and scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is handed to every executor only if it has at most this many bytes; beyond, a shuffle join is used.
BROADCAST_BYTES = 64 << 20
#: Bytes of a row beside its texts and arrays.
ROW_BYTES = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset and all run on this machine, as in tests."""
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return there or sc._jsc.sc().getCheckpointDir().get()
    if not there and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    there = there or tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(there)
    return there


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that scratch or a job of ours made."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows are so few that they may be sent to all executors: counted, at the bytes that their own values take.

    Rows and bytes are looked at up to the limit only. df has been cut, or is cheap to work out twice.
    """
    if df.limit(limit // ROW_BYTES + 1).count() > limit // ROW_BYTES:
        return False
    wide = [F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    wide += [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return not wide or (df.agg(F.sum(sum((F.coalesce(w, F.lit(0)) + 8 for w in wide), F.lit(ROW_BYTES)))).first()[0] or 0) <= limit


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyfold_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{top.name}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(out)
    sc._tallyfold_shipped = True
