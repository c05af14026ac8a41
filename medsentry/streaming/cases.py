"""New publications of cases as a stream that keeps a current table.

The table is cut into buckets by a hash of the case record's id. A micro-batch rewrites only the buckets
that it touches, in a new version of them; a small file says which version of each bucket is the
current one, and is replaced last. So a batch that ends early changes nothing, and its replay is a new try.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import EngineError
from ..sources.schema import DATASETS
from ..storage import delete, exists, names, read_text, write_text

#: Enough for a bucket of a corpus to be some hundred megabytes at most.
BUCKETS = 64


def publications(spark: SparkSession, path: str) -> DataFrame:
    """Case files as they arrive, with the declared schema."""
    return spark.readStream.schema(DATASETS["case"]).parquet(path)


def _state(table: str, buckets: int) -> dict:
    """buckets, the version of each, and the versions that the last batch replaced."""
    at = f"{table}/current.json"
    return json.loads(read_text(at)) if exists(at) else {"buckets": buckets, "versions": {}, "replaced": {}}


def _rows(spark: SparkSession, table: str, versions: dict[str, str]) -> DataFrame:
    paths = [f"{table}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(DATASETS["case"]).parquet(*paths) if paths else spark.createDataFrame([], DATASETS["case"])


def read_current(spark: SparkSession, table: str) -> DataFrame:
    """The table as the last whole batch left it; empty before the first."""
    return _rows(spark, table, _state(table, BUCKETS)["versions"])


def _merge(batch: DataFrame, table: str, buckets: int) -> None:
    state, columns = _state(table, buckets), DATASETS["case"].names
    if state["buckets"] != buckets:
        raise EngineError(f"{table} has {state['buckets']} buckets, not {buckets}")
    bucket = F.pmod(F.xxhash64("primaryid"), F.lit(buckets)).cast("int")
    touched = {str(r.b) for r in batch.select(bucket.alias("b")).distinct().collect()}  # ``buckets`` rows at most
    if not touched:
        return
    old = _rows(batch.sparkSession, table, {b: v for b, v in state["versions"].items() if b in touched})
    both = old.withColumn("_new", F.lit(0)).unionByName(batch.select(*columns).withColumn("_new", F.lit(1)))
    newest = F.max(F.struct("quarter", "_new", F.struct(*columns).alias("row"))).alias("best")
    # One shuffle: rows that are grouped by bucket and id already lie together by bucket.
    kept = both.withColumn("bucket", bucket).repartition(len(touched), "bucket").groupBy("bucket", "primaryid").agg(newest)
    version = uuid.uuid4().hex
    kept.select("best.row.*", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{table}/v={version}")
    versions = state["versions"] | dict.fromkeys(touched, version)
    replaced = {b: v for b, v in state["versions"].items() if b in touched}
    write_text(f"{table}/current.json", json.dumps({"buckets": buckets, "versions": versions, "replaced": replaced}))
    # Readers may still be at what this batch replaced; what earlier ones did goes, and so does what ended batches left.
    for b, v in state["replaced"].items():
        delete(f"{table}/v={v}/bucket={b}")
    named = {*versions.values(), *replaced.values()}
    for name in names(table):
        if name.startswith("v=") and name[2:] not in named:
            delete(f"{table}/{name}")


def keep_current(stream: DataFrame, table: str, checkpoint: str, once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Upsert each micro-batch into ``table``: one row a primaryid, of its newest publication.

    Cases: of rows of one id and quarter the later batch's wins, within a batch the greatest row; rows without
    an id are one; a batch that is replayed changes nothing; one without rows leaves the table alone.
    """
    writer = stream.writeStream.foreachBatch(lambda batch, _: _merge(batch, table, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
