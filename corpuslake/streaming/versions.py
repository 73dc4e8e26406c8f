"""An index of chunks that grows by versions: appended, deleted from, compacted, and read as it was at any version.

A version is a folder of new rows and of marks of what is deleted. A table of commits says which
folders make up the index; its row is written last, so a job that fails midway changes nothing, and one that is
committed already is not repeated. When FAN_IN folders of a level are there, a compaction writes them as one of
the next level, so that folders stay few and a row is rewritten once a level. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.operators import bm25

FAN_IN = 8
COMMIT = "at int, version int, folder string, level int, low int, high int, replaces array<string>, tables array<string>"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commits so far (COMMIT): ``at`` counts them, ``version`` is null for a compaction, ``low`` to ``high`` are the versions in the folder, ``replaces`` the folders that it takes the place of."""
    try:
        return spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException:
        return spark.createDataFrame([], COMMIT)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version int): the versions that are whole; none where there is no index yet."""
    return commits(spark, path).where("version is not null").select("version")


def live(spark: SparkSession, path: str, version: int | None = None) -> list:
    """Commits whose folders make up the index, oldest rows first; as of ``version``, if given, whatever was compacted since."""
    known = sorted(commits(spark, path).collect(), key=lambda c: c["at"])  # a row for each version and compaction
    if version is not None:
        known = [c for c in known if c["high"] <= version]
    gone = {folder for c in known for folder in c["replaces"]}
    return sorted((c for c in known if c["folder"] not in gone), key=lambda c: c["low"])


def commit(spark: SparkSession, path: str, version: int | None, folder: str, level: int, low: int, high: int, replaces: Sequence[str], tables: Sequence[str]) -> None:
    at = (commits(spark, path).agg(F.max("at")).first()[0] or 0) + 1
    spark.createDataFrame([(at, version, folder, level, low, high, list(replaces), list(tables))], COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def one_per_key(rows: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row of each key: the greatest by ``order``, if given, then by its own content, so that reruns agree."""
    rest = [c for c in rows.columns if c != key]
    rule = F.to_json(F.struct(*rest)) if order is None else F.struct(order.alias("o"), F.to_json(F.struct(*rest)).alias("j"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), rule).alias("r")).select(key, "r.*").select(*rows.columns)


def index_batch(new_chunks: DataFrame, path: str, version: int | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, deleted: DataFrame | None = None, fan_in: int = FAN_IN) -> None:
    """Adds chunks (chunk_id, collection, text, ...), their postings, and nodes and edges where given, as a version; takes out the chunks ``deleted`` (chunk_id).

    Of several rows of a chunk_id the one that comes last by its content is taken. A chunk that is
    deleted and added at once is there. Nothing that was there is read or written again but by
    compactions, of ``fan_in`` folders each; a version that is committed already is left as it is.
    """
    spark = new_chunks.sparkSession
    known = versions(spark, path)
    if version is None:
        version = (known.agg(F.max("version")).first()[0] or 0) + 1
    elif not known.where(F.col("version") == version).isEmpty():
        return
    folder = f"{path}/parts/{version}-{uuid.uuid4().hex}"
    fresh = one_per_key(new_chunks, "chunk_id")
    marked = fresh.withColumn("version", F.lit(version))
    marked.write.partitionBy("collection").parquet(f"{folder}/chunks")
    tables = ["chunks"]
    made = {"postings": bm25.postings(fresh, "chunk_id"), "nodes": nodes, "edges": edges, "deleted": deleted.select("chunk_id").distinct() if deleted is not None else None}
    for name, rows in made.items():
        if rows is not None:
            rows.withColumn("version", F.lit(version)).write.parquet(f"{folder}/{name}")
            tables.append(name)
    commit(spark, path, version, folder, 0, version, version, [], tables)
    compact(spark, path, fan_in)


def read_parts(spark: SparkSession, parts: Sequence, name: str) -> DataFrame | None:
    """All rows of a table in the given folders, with ``version``; None where none has it."""
    out = None
    for part in parts:
        if name in part["tables"]:
            rows = spark.read.parquet(f"{part['folder']}/{name}")
            if name == "chunks":  # read from folder names, which may look like numbers
                rows = rows.withColumn("collection", F.col("collection").cast("string"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def superseded(spark: SparkSession, parts: Sequence) -> DataFrame | None:
    """(key_id, newest, gone): of the chunks in all folders but the oldest, the newest version, and the version that deleted it last."""
    chunks, deleted = read_parts(spark, parts[1:], "chunks"), read_parts(spark, parts, "deleted")
    out = None
    for rows, newest in ((chunks, True), (deleted, False)):
        if rows is not None:
            here = rows.select("chunk_id", F.when(F.lit(newest), F.col("version")).alias("newest"), F.when(F.lit(not newest), F.col("version")).alias("gone"))
            out = here if out is None else out.unionByName(here)
    return None if out is None else out.groupBy(F.col("chunk_id").alias("key_id")).agg(F.max("newest").alias("newest"), F.max("gone").alias("gone"))


def current(spark: SparkSession, parts: Sequence, name: str) -> DataFrame:
    """The rows of ``chunks`` or ``postings`` that no later version replaces or deletes, with ``version``.

    Only keys that came after the oldest folder, which holds most rows, are brought together.
    """
    rows, later = read_parts(spark, parts, name), superseded(spark, parts)
    if later is None:
        return rows
    key = "chunk_id" if name == "chunks" else "doc_id"
    joined = rows.join(later, F.col(key) == F.col("key_id"), "left")
    kept = joined.where((F.col("newest").isNull() | (F.col("version") >= F.col("newest"))) & (F.col("gone").isNull() | (F.col("version") >= F.col("gone"))))
    return kept.select(*rows.columns)


def read_index(spark: SparkSession, path: str, name: str = "chunks", version: int | None = None) -> DataFrame:
    """The chunks of the index, or their postings (``postings``); ``nodes`` and ``edges`` are those of all versions, to be merged by the graph.

    As of ``version``, if given.
    """
    parts = live(spark, path, version)
    if not parts:
        raise ValueError(f"no index at {path}" + ("" if version is None else f" of version {version}"))
    if name in ("nodes", "edges"):
        rows = read_parts(spark, parts, name)
        return spark.createDataFrame([], "document_id string") if rows is None else rows.drop("version")
    return current(spark, parts, name).drop("version")


def compact(spark: SparkSession, path: str, fan_in: int = FAN_IN) -> int:
    """Writes each ``fan_in`` folders of one level as one of the next, until no level has so many; returns how many were written.

    What later versions among them replace or delete is left out; marks of deletions stay while older
    folders may hold the chunk. Folders that were replaced stay for reading as of their version; see :func:`vacuum`.
    """
    made = 0
    while True:
        parts = live(spark, path)
        levels = [p["level"] for p in parts]
        runs = [i for i in range(len(parts) - fan_in + 1) if len(set(levels[i : i + fan_in])) == 1]
        if not runs:
            return made
        at = runs[0]
        merge = parts[at : at + fan_in]
        folder = f"{path}/parts/{merge[0]['low']}-to-{merge[-1]['high']}-{uuid.uuid4().hex}"
        tables = []
        for name in ("chunks", "postings", "nodes", "edges", "deleted"):
            if name == "deleted" and at == 0:
                continue  # nothing older is left to be deleted
            rows = current(spark, merge, name) if name in ("chunks", "postings") else read_parts(spark, merge, name)
            if rows is None:
                continue
            if name == "deleted":
                rows = rows.groupBy("chunk_id").agg(F.max("version").alias("version"))
            writer = rows.write.partitionBy("collection") if name == "chunks" else rows.write
            writer.parquet(f"{folder}/{name}")
            tables.append(name)
        commit(spark, path, None, folder, merge[0]["level"] + 1, merge[0]["low"], merge[-1]["high"], [p["folder"] for p in merge], tables)
        made += 1


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes the folders that the present index does not use; earlier versions cannot be read after that. Returns them."""
    used = {p["folder"] for p in live(spark, path)}
    gone = sorted({folder for c in commits(spark, path).collect() for folder in c["replaces"]} - used)
    for folder in gone:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return gone


def index_stream(chunks: DataFrame, path: str, checkpoint: str, fan_in: int = FAN_IN):
    """A streaming query that indexes each batch of new chunks as the version of the batch's number; start, await and stop it as any other."""
    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: index_batch(batch, path, number, fan_in=fan_in)).trigger(availableNow=True).start()
