"""Files out and in: CSV, JSON lines, dumps with counts, graphs, and a snapshot's revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallspark.session import new_folder


def write_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows in total order over the files, each with its heading; quotes are doubled as readers expect."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of such files; a quoted field may go over several lines, so each file is read by one task."""
    return spark.read.schema(schema).option("multiLine", True).option("header", True).option("escape", '"').csv(path)


def csv_round_trip(rows: DataFrame, order: list[str]) -> DataFrame:
    path = new_folder(rows.sparkSession, "csv")
    write_csv(rows, path, order)
    return read_csv(rows.sparkSession, path, rows.schema)


def append_json(rows: DataFrame, path: str) -> None:
    """One object a line, after those that are there."""
    rows.write.mode("append").json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as CSV in a folder of its own; ``name, n`` of what was written."""
    counts = None
    for name, rows in tables.items():
        rows.write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
        one = read_csv(rows.sparkSession, f"{path}/{name}", rows.schema).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def write_graph(entities: DataFrame, mentions: DataFrame, path: str, events: DataFrame | None = None) -> str:
    """Nodes and edges as JSON lines.

    Given events (``event_id, thought_id``) there are two more sets: ``occurs_in`` from thoughts to their events,
    ``involves`` from events to the entities of their thought, each edge once and none with an end missing.
    """
    entity, thought, event = (F.concat(F.lit(p), F.col(k).cast("string")) for p, k in (("e", "entity_id"), ("t", "thought_id"), ("v", "event_id")))
    entities.withColumn("entity_id", F.col("id")).select(entity.alias("id"), "label", F.lit("entity").alias("kind")).write.json(f"{path}/nodes")
    mentions.select(thought.alias("source"), entity.alias("target"), "salience").write.json(f"{path}/edges")
    if events is not None:
        own = events.select("event_id", "thought_id").where("event_id is not null and thought_id is not null").distinct()
        own.select(thought.alias("source"), event.alias("target")).write.json(f"{path}/occurs_in")
        involved = own.join(mentions.select("thought_id", "entity_id").where("entity_id is not null"), "thought_id")
        involved.select(event.alias("source"), entity.alias("target")).distinct().write.json(f"{path}/involves")
    return path


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("id string, label string, kind string").json(f"{path}/nodes"), spark.read.schema("source string, target string, salience double").json(f"{path}/edges")


def read_event_edges(spark: SparkSession, path: str) -> DataFrame:
    """``source, target, kind`` of both sets of event edges."""
    one = lambda kind: spark.read.schema("source string, target string").json(f"{path}/{kind}").withColumn("kind", F.lit(kind))
    return one("occurs_in").unionByName(one("involves"))


def write_manifest(counts: DataFrame, path: str, version: int, at: str, tenant: str) -> DataFrame:
    """The dump's manifest, one JSON object beside its tables, read back: version, time, tenant and rows of each file."""
    files = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("name", F.lit(".csv")), "n")))).alias("files")
    counts.agg(files).select(F.lit(version).alias("export_version"), F.lit(at).alias("exported_at"), F.lit(tenant).alias("tenant"), "files").coalesce(1).write.json(f"{path}/manifest")
    return counts.sparkSession.read.schema("export_version int, exported_at string, tenant string, files map<string, long>").json(f"{path}/manifest")


def snapshot(thoughts: DataFrame, entities: DataFrame, most: int = 800) -> DataFrame:
    """How many rows a snapshot holds, and a revision that changes when one of them does.

    The oldest thoughts come first, entities fill what is left of ``most``. Vectors stay inside: only their
    owners' keys and times (``id, created_at, updated_at``) leave.
    """
    stamp = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("stamp")
    first = lambda df, kind: df.orderBy("created_at", "id").limit(most).select(F.lit(kind).alias("kind"), "id", "created_at", stamp)
    both = first(thoughts, "Thought").unionByName(first(entities, "Entity"))
    kept = both.orderBy(F.col("kind") == "Entity", "created_at", "id").limit(most)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("kind", F.col("id").cast("string").alias("id"), "stamp"))), lambda r: F.concat_ws(":", r["kind"], r["id"], r["stamp"]))
    return kept.agg(F.count("*").alias("n"), F.sha2(F.array_join(keys, "\n"), 256).alias("revision"))
