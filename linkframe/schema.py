"""The link schema, the built-in vocabulary and small session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))

#: One row per link. ``target_is_iri`` is carried but is not part of a link's identity; ``attrs`` is sorted by
#: (name, value) and never null, since arrays (unlike maps) can be compared, grouped and joined on.
LINK_SCHEMA = T.StructType(
    [
        T.StructField("link_id", T.LongType()),
        T.StructField("origin", T.StringType()),
        T.StructField("rel", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("target_is_iri", T.BooleanType()),
        T.StructField("attrs", ATTRS),
    ]
)

#: Namespace of the built-in terms. They stand in links and take part in content hashes, so whoever reads or continues data
#: written under another namespace names that one in LINKFRAME_NAMESPACE (on a cluster for the executors as well).
NS = os.environ.get("LINKFRAME_NAMESPACE") or "http://linkframe.example/terms/"
TYPE = NS + "type"
LABEL = NS + "label"
NULL = NS + "NULL"
ITEM = NS + "item"
FINGERPRINT = NS + "fingerprint"
REFINES = NS + "refines"
PROPERTIES = NS + "properties"
VALUE = NS + "value"
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS_NS = "http://www.w3.org/2000/01/rdf-schema#"
RDF_TYPE = RDF_NS + "type"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package known to the Python workers, where neither the working folder nor PYTHONPATH does: as a zip that
    Spark's own file server hands to the executors."""
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    known = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [Path.cwd()]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in known or not root.is_dir():
        return
    _shipped.add(app)
    file = Path(tempfile.mkdtemp()) / "linkframe.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted((root / "linkframe").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(file))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables of a folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Folders that this process wrote, until ``clear_shared``.
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder for a table that cuts a lineage, in the cluster's ``spark.checkpoint.dir``. Where that is unset, a folder of
    this machine serves a local master (tests), and is deleted when the process ends; a cluster is refused, as its
    executors could not see such a folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="linkframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/linkframe-{uuid.uuid4().hex}"
    _written.setdefault(sc.applicationId, []).append(path)
    return path


def clear_shared(spark: SparkSession) -> int:
    """Delete the folders written so far by this session: when no result that reads them is wanted any more. Gives their
    number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def splittable(df: DataFrame, key: str) -> DataFrame:
    """``df``, an aggregated side of a join on ``key`` (a string or bigint), so that adaptive skew handling can work on the
    other side. A side that comes from an aggregation by the key is joined where it lies, without a shuffle of its own, and
    then Spark cannot split the partition of a hot key on the other side; a key that is written anew is shuffled again,
    which costs little as this side has a row per key."""
    c = F.col(key)
    return df.withColumn(key, F.concat(c, F.lit("")) if dict(df.dtypes)[key] == "string" else F.bitwise_not(F.bitwise_not(c)))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the plan behind it is not run again, and a lost
    executor loses nothing of it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
