"""A9, A10 on files: datapoints in a versioned table, merged by touched bucket.

The table's slices are (kind, tenant, hash bucket of the key). All rows of a key are in one slice, so a batch reads and
rewrites only the slices in which its own keys fall; the others keep their folders. A batch that comes again finds its
rows and writes the same slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import intermediates, written
from tallyspark.sources.landing import EVENT_KEY, MEASURE_KEY, dp_event_first_wins, dp_measure_newest_wins
from tallyspark.sources.versions import VersionedTable

#: Hash buckets of a tenant's keys; grows the number of files, shrinks what a batch rewrites.
BUCKETS = 8
LAYOUT = ["kind", "tenant_id", "bucket"]


def datapoint_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, LAYOUT)


def _bucket(buckets: int) -> Column:
    event, measure = (F.xxhash64(*[F.col(c) for c in key]) for key in (EVENT_KEY, MEASURE_KEY))
    return F.pmod(F.when(F.col("kind") == "event", event).otherwise(measure), F.lit(buckets)).cast("int")


def upsert_datapoints(incoming: DataFrame, path: str, buckets: int = BUCKETS) -> int:
    """Merge a batch: new event keys are added, measurements replaced by strictly newer ones. Returns the version.

    ``buckets`` must stay the same for a table. Rows of other kinds are an error."""
    with intermediates():
        return _merge(written(incoming, "datapoints"), path, buckets)


def _merge(incoming: DataFrame, path: str, buckets: int) -> int:
    table = datapoint_table(incoming.sparkSession, path)
    inc = incoming.withColumn("bucket", _bucket(buckets))
    touched = {(r.kind, r.tenant_id, str(r.bucket)) for r in inc.select(*LAYOUT).distinct().collect()}
    if other := {k for k, _, _ in touched} - {"event", "measurement"}:
        raise ValueError(f"datapoints of unknown kind: {', '.join(map(str, other))}")
    covers = touched.__contains__
    found = table.read(covers) if table.manifest()["number"] else incoming.sparkSession.createDataFrame([], inc.schema)
    found = found.select(*incoming.columns)
    kind = lambda d, k: d.where(F.col("kind") == k)
    ways = {"event": dp_event_first_wins, "measurement": dp_measure_newest_wins}
    parts = [way(kind(found, k), kind(incoming, k)) for k, way in ways.items() if any(t[0] == k for t in touched)]
    merged = reduce(DataFrame.unionByName, parts, found.where("false"))
    return table.replace(merged.withColumn("bucket", _bucket(buckets)), covers)


def read_datapoints(spark: SparkSession, path: str) -> DataFrame:
    return datapoint_table(spark, path).read().drop("bucket")
