"""The audit table: batches of rows, and a log of commits that gives them their ids.

A batch's rows are written to a folder of its own. They count once its commit is in the
log: commit k + 1 goes on from the ids of commit k and is put there by a step that
fails if another writer was first, who then is gone on from. Folders without a commit
(a writer that died) are never read. A stream's batch that comes again is known from
the log and left out.
"""

from __future__ import annotations

import json
import os
import uuid
from itertools import accumulate
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = "id bigint, timestamp string, document_hash string, file_path string, document_type string, risk_score int, verdict string, extracted_fields string, pipeline_version string"
COMMIT_SCHEMA = "folder string, parts array<struct<part:int,first:bigint>>"
#: Attempts to commit behind other writers.
MOST_TRIES = 1000


class Log:
    """Commits of a table: numbered files, read by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.spark, self.folder = spark._jvm, spark, f"{path.rstrip('/')}/commits"
        self.place = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        self.store = self.place.getFileSystem(spark._jsc.hadoopConfiguration())
        self.folder = str(self.store.makeQualified(self.place))

    def last(self) -> tuple[int, dict]:
        """The last commit's number and content; 0 and an empty one before the first."""
        if not self.store.exists(self.place):
            return 0, {"next": 1, "streams": {}}
        number = max((int(name[:-5]) for f in self.store.listStatus(self.place) if (name := f.getPath().getName())[:-5].isdigit()), default=0)
        return (number, json.loads(self.read(f"{number:020d}.json"))) if number else (0, {"next": 1, "streams": {}})

    def read(self, name: str) -> str:
        stream = self.store.open(self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, number: int, content: dict) -> bool:
        """Adds a commit, whole; False if that number is taken."""
        name, draft = f"{number:020d}.json", f".draft-{uuid.uuid4().hex}"
        path = lambda n: self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
        stream = self.store.create(path(draft), False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        try:
            return self.linked(draft, name) if self.folder.startswith("file:") else self.renamed(path(draft), path(name))
        finally:
            self.store.delete(path(draft), False)

    def linked(self, draft: str, name: str) -> bool:
        """On a mounted folder a rename would replace another's file, a hard link doesn't."""
        here = unquote(urlparse(self.folder).path)
        try:
            os.link(f"{here}/{draft}", f"{here}/{name}")
        except FileExistsError:
            return False
        return True

    def renamed(self, draft, name) -> bool:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, name, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True


def append_audit(rows: DataFrame, path: str, batch: int | None = None, query: str = "") -> bool:
    """Appends rows, columns of AUDIT_SCHEMA without id, to the audit table; repeated documents are logged again.

    batch: a stream's number of these rows, of the query named. Numbers of a query
    rise, so one that isn't above its last commit has been logged, and False is
    returned. Without a number rows are always added. Ids go on from the last commit,
    without a gap and without a sort: rows of each task are counted. Rows are written
    once. Any number of writers may append at once.
    """
    spark, log = rows.sparkSession, Log(rows.sparkSession, path)
    again = lambda told: batch is not None and batch <= told["streams"].get(query, -1)
    if again(log.last()[1]):
        return False
    folder = uuid.uuid4().hex
    place = f"{path.rstrip('/')}/rows/folder={folder}"
    own = rows.to(spark.createDataFrame([], AUDIT_SCHEMA.removeprefix("id bigint, ")).schema)
    own.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(place)
    counts = sorted((r["part"], r["n"]) for r in spark.read.schema("part int").parquet(place).groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each task
    for _ in range(MOST_TRIES):
        number, told = log.last()
        if again(told):
            return False
        begins = list(accumulate((n for _, n in counts), initial=told["next"]))
        parts = [{"part": p, "first": b} for (p, _), b in zip(counts, begins, strict=False)]
        streams = told["streams"] | ({query: batch} if batch is not None else {})
        if log.put(number + 1, {"folder": folder, "parts": parts, "next": begins[-1], "streams": streams}):
            return True
    raise RuntimeError(f"no commit in {MOST_TRIES} tries")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows with their ids, in no order."""
    path = path.rstrip("/")
    commits = spark.read.schema(COMMIT_SCHEMA).json(f"{path}/commits").select("folder", F.inline("parts"))
    columns = [c.split()[0] for c in AUDIT_SCHEMA.split(", ")]
    kept = AUDIT_SCHEMA.removeprefix("id bigint, ")
    rows = spark.read.schema(f"{kept}, part int, at bigint, folder string").parquet(f"{path}/rows")
    return rows.join(commits, ["folder", "part"]).withColumn("id", F.col("first") + F.col("at")).select(*columns)
