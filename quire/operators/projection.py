"""Parsed objects to the normalised tables (PR1-PR8, PR10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.locators import locator_json
from quire.functions.text import folded, normalized, segment_id, tokenize

def project_objects(objects: DataFrame) -> DataFrame:
    """One row an object; what a kind doesn't have is null."""
    only = lambda kind, c: F.when(F.col("kind") == kind, F.col(c)).alias(c)
    return objects.select(
        "id", "kind", F.when(F.col("kind") != "snippet", F.col("subtype")).alias("subtype"), "path", "title", "visibility", "record_status", only("source", "workflow_stage"), only("note", "maturity"),
        only("ai_artifact", "review_status"), F.col("created").alias("created_at"), F.when(F.col("kind") != "ai_artifact", F.col("updated")).alias("updated_at"), "checksum",
    )


def project_tags(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, object_tags)."""
    pairs = objects.select(F.col("id").alias("object_id"), F.explode("tags").alias("tag")).distinct()
    return pairs.select("tag").distinct(), pairs


def project_type_transitions(objects: DataFrame) -> DataFrame:
    rows = objects.where("kind = 'note'").select(F.col("id").alias("object_id"), F.posexplode("type_history").alias("ordinal", "t"))
    return rows.select("object_id", "ordinal", F.col("t.from").alias("from_type"), F.col("t.to").alias("to_type"), F.col("t.changed_at").alias("changed_at"), F.col("t.actor.type").alias("actor_type"), F.col("t.actor.id").alias("actor_id"))


def _role(kind):
    return F.when(kind == "ai_artifact", "ai").otherwise(kind)


def project_sections(bodies: DataFrame) -> DataFrame:
    """Sections of notes in order; one ``__body__`` section for every other object."""
    notes = bodies.where("kind = 'note'").select("object_id", F.posexplode("sections").alias("ordinal", "s")).select("object_id", F.col("s.section_id").alias("section_id"), F.col("s.role").alias("role"), F.col("s.heading").alias("heading"), "ordinal")
    others = bodies.where("kind <> 'note'").select("object_id", F.lit("__body__").alias("section_id"), _role(F.col("kind")).alias("role"), F.lit("").alias("heading"), F.lit(0).alias("ordinal"))
    return notes.unionByName(others)


def _blocks(bodies: DataFrame) -> DataFrame:
    notes = bodies.where("kind = 'note'").select("object_id", F.explode("sections").alias("s")).select("object_id", F.col("s.section_id").alias("section_id"), F.col("s.role").alias("role"), F.posexplode("s.blocks").alias("ordinal", "b"))
    notes = notes.select("object_id", "section_id", "role", "ordinal", F.col("b.text").alias("text"), F.col("b.artifact_id").alias("artifact_id"), F.col("b.citations").alias("citations"))
    none = F.lit(None).cast(notes.schema["citations"].dataType)
    others = bodies.where("kind <> 'note'").select("object_id", F.lit("__body__").alias("section_id"), _role(F.col("kind")).alias("role"), F.lit(0).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("kind") == "ai_artifact", F.col("object_id")).alias("artifact_id"), none.alias("citations"))
    return notes.unionByName(others).withColumn("segment_id", segment_id(F.col("object_id"), F.col("section_id"), F.col("ordinal")))


def project_segments(bodies: DataFrame) -> DataFrame:
    """One row a block, or a body of another kind even if empty."""
    return _blocks(bodies).select("segment_id", "object_id", "section_id", "role", "ordinal", "text", "artifact_id")


def project_citations(bodies: DataFrame) -> DataFrame:
    rows = _blocks(bodies).select("segment_id", F.posexplode("citations").alias("ordinal", "c"))
    return rows.select("segment_id", "ordinal", F.col("c.source_id").alias("source_id"), locator_json(F.col("c.locator")).alias("locator"))


def project_relations(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id", F.coalesce("to_section_id", F.lit("")).alias("to_section_id"), "relation_type", locator_json(F.col("locator")).alias("locator"), F.coalesce("reason", F.lit("")).alias("reason"), "created_at", F.col("actor.type").alias("actor_type"), F.col("actor.id").alias("actor_id"))


def project_search_fields(segments: DataFrame, objects: DataFrame, fold_diacritics: bool = True) -> DataFrame:
    """(segment_id, object_id, tokens): tokens of title, text and tags together, repeats kept."""
    own = objects.select(F.col("id").alias("object_id"), "title", F.array_join("tags", " ").alias("tag_text"))
    rows = segments.join(own, "object_id", "left")
    text = normalized(F.concat_ws("\n", "title", "text", "tag_text"))
    return rows.select("segment_id", "object_id", tokenize(folded(text) if fold_diacritics else text, normal=True).alias("tokens"))


def project_scan_state(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, checksum) of the files that parsed."""
    return files.select("path", "checksum").join(findings.where("path is not null").select("path").distinct(), "path", "left_anti")


def index_metadata(spark: SparkSession, snapshot: str, built_at: str, versions: dict[str, str] = schemas.VERSIONS) -> DataFrame:
    rows = [*((f"{k}_version", v) for k, v in sorted(versions.items())), ("snapshot_digest", snapshot), ("built_at", built_at)]
    return spark.createDataFrame(rows, "key string, value string")
