"""Sessions, tables kept in the cluster's shared folder, and small file-system helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
PLAN_LENGTH, PLAN_TEXT = "spark.sql.maxPlanStringLength", "50000b"


def local_session(cpus: int = 8, app: str = "volspark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Where that setting is absent, a temporary folder is made on a local master; on a cluster each machine would have its own, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="volspark-")
        atexit.register(__import__("shutil").rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


_RELEASED: set[str] = set()


def release(spark: SparkSession, own: str | None = None) -> None:
    """Delete the application's tables in the shared folder; DataFrames that still read them end."""
    own = own or f"{shared_dir(spark)}/volspark-{spark.sparkContext.applicationId}"
    try:
        Files(spark, own).delete(own)
    except Exception:  # noqa: BLE001 - at the end of a program the session may be gone; the folder's owner then clears it
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, below one directory for each application, which goes when the program ends."""
    own = f"{shared_dir(spark)}/volspark-{spark.sparkContext.applicationId}"
    if own not in _RELEASED:
        _RELEASED.add(own)
        atexit.register(release, spark, own)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage of `df`: write it as a table in the shared folder and read that table.

    Survives the loss of executors and gives every later reader the same rows, whatever is recomputed.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    writer = df.write.option("compression", "zstd")
    # a plan with a large literal has a text of its size, of which the driver would keep one for each change of the plan
    length = spark.conf.get(PLAN_LENGTH)
    spark.conf.set(PLAN_LENGTH, PLAN_TEXT)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(PLAN_LENGTH, length)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


class Files:
    """Hadoop file-system calls, so that any store the cluster mounts will do."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway, self._conf = spark.sparkContext._jvm, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(self._conf)

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def is_file(self, path: str) -> bool:
        p = self._path(path)
        return self.fs.exists(p) and self.fs.getFileStatus(p).isFile()

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def size(self, path: str) -> int:
        return self.fs.getFileStatus(self._path(path)).getLen()

    def read_text(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        stream = self.fs.create(self._path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Create a file with all of its text at once; False, and nothing changed, if there is one.

        The text goes to a file of a name of its own, which is then linked (local) or renamed without overwriting, as Spark commits its
        streams' logs; of several writers one succeeds.
        """
        above, _, name = path.rpartition("/")
        new = f"{above}/.{name}.{uuid.uuid4().hex}"
        self.write_text(new, text)
        try:
            if self.fs.getScheme() == "file":
                try:
                    os.link(self._path(new).toUri().getPath(), self._path(path).toUri().getPath())
                except FileExistsError:
                    return False
                return True
            none = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            how = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            how[0] = none
            try:
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(new).toUri(), self._conf).rename(self._path(new), self._path(path), how)
            except Py4JJavaError as e:
                if "FileAlreadyExists" in e.java_exception.getClass().getName():
                    return False
                raise
            return True
        finally:
            self.delete(new)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
