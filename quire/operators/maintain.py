"""Index state, incremental update and integrity (MX1-MX4)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.operators import projection as pr
from quire.operators.catalog import changed_paths, is_healthy, snapshot_digest
from quire.operators.index import build_postings, corpus_stats
from quire.sources.vault import OUT_BY, Roots, compact, newest, overlaid, read_projection, write_changes, write_projection

#: Versions that one projection is made of at most; then it is written whole.
MOST_PARTS = 16


@dataclass(frozen=True)
class Changes:
    """What an update adds to each table, and the keys (list, key) whose older rows it takes out."""

    added: dict[str, DataFrame]
    gone: DataFrame


def rebuild(spark: SparkSession, files: DataFrame, objects: DataFrame, bodies: DataFrame, edges: DataFrame, findings: DataFrame, built_at: str) -> dict[str, DataFrame]:
    """All tables of the projection from parsed rows."""
    tables = tables_of(objects, bodies, edges)
    state = pr.project_scan_state(files, findings)
    return tables | {"scan_state": state, "index_metadata": pr.index_metadata(spark, snapshot_digest(state), built_at)}


def tables_of(objects: DataFrame, bodies: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    tags, object_tags = pr.project_tags(objects)
    segments = pr.project_segments(bodies)
    fields = pr.project_search_fields(segments, objects)
    return {
        "objects": pr.project_objects(objects), "details": objects, "tags": tags, "object_tags": object_tags, "type_transitions": pr.project_type_transitions(objects), "sections": pr.project_sections(bodies),
        "segments": segments, "citations": pr.project_citations(bodies), "relations": pr.project_relations(edges), "search_fields": fields, **build_postings(fields),
    }


def index_status(tables: dict[str, DataFrame] | None, current: DataFrame, healthy: bool = True) -> tuple[str, DataFrame | None]:
    """missing, incompatible, stale or fresh, and the changed paths; another version counts before staleness, and an unhealthy scan is stale."""
    if not tables:
        return "missing", None
    stored = {r["key"]: r["value"] for r in tables["index_metadata"].collect()}
    changed = changed_paths(current, tables["scan_state"])
    if any(stored.get(f"{k}_version") != v for k, v in schemas.VERSIONS.items()):
        return "incompatible", changed
    return ("fresh" if healthy and changed.isEmpty() else "stale"), changed


def require_searchable(state: str, healthy: bool) -> None:
    """Refuses a search on an unhealthy scan, or on an index that isn't fresh."""
    if not healthy:
        raise ValueError("INDEX_SOURCE_INVALID")
    if state != "fresh":
        raise ValueError({"missing": "INDEX_NOT_FOUND", "incompatible": "INDEX_INCOMPATIBLE"}.get(state, "INDEX_SOURCE_CHANGED"))


def _sound(again: Callable[[], DataFrame] | None) -> Callable[[dict[str, DataFrame]], None]:
    """Refuses written tables with rows whose parent is missing, or made of files that changed meanwhile."""

    def sound(written: dict[str, DataFrame]) -> None:
        if not check_foreign_keys(written).isEmpty():
            raise ValueError("INDEX_CORRUPT")
        if again is not None and not changed_paths(again(), written["scan_state"]).isEmpty():
            raise ValueError("INDEX_SOURCE_CHANGED")

    return sound


def publish(
    spark: SparkSession, files: DataFrame, objects: DataFrame, bodies: DataFrame, edges: DataFrame, findings: DataFrame, out: str, built_at: str, again: Callable[[], DataFrame] | None = None, buckets: int = 64
) -> str:
    """Builds and lists a new version of the projection, if what it is made of is sound; gives its name.

    ``findings`` are all of a scan; an error among them refuses (INDEX_SOURCE_INVALID), and so do
    rows whose parent is missing (INDEX_CORRUPT).  ``again`` reads (path, checksum) anew once the
    tables are written: files that changed meanwhile refuse as well (INDEX_SOURCE_CHANGED).  A
    refused version is not listed, so no reader takes it.
    """
    if not is_healthy(findings):
        raise ValueError("INDEX_SOURCE_INVALID")
    tables = rebuild(spark, files, objects, bodies, edges, findings, built_at)
    return write_projection(tables, out, buckets, _sound(again))


def changes_of(tables: dict[str, DataFrame], changed: DataFrame, objects: DataFrame, bodies: DataFrame, edges: DataFrame, current: DataFrame, built_at: str, roots: Roots = Roots(), findings: DataFrame | None = None) -> Changes:
    """What the changed paths add to the tables and take out of them.

    ``objects``, ``bodies`` and ``edges`` are parsed from the files at changed paths that still
    exist.  Objects whose path is gone or whose id comes again are taken out of all their
    tables, and so are edges of changed shards, which are told by the names of their files, so
    that removed and emptied ones count too; then the new rows are added.  As in the reference,
    a shard is named after its from_id and is the only one of it; a scan has findings otherwise.
    With ``findings`` files that have one stay out of the scan state, as in a rebuild.
    Document frequencies change by the difference of the postings taken out and added, and the
    corpus by its sums.
    """
    spark = changed.sparkSession
    paths = changed.select("path")
    out = tables["objects"].join(paths, "path", "left_semi").select("id").unionByName(objects.select("id")).distinct()
    stem = F.regexp_extract("path", rf"^{re.escape(roots.relations.rstrip('/'))}/(?:.*/)?([^/]+?)(?:\.[^./]+)?$", 1)
    shards = paths.select(stem.alias("from_id")).where("from_id <> ''").unionByName(edges.select("from_id")).distinct()
    new = tables_of(objects, bodies, edges)
    gone = tables["segments"].join(out.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select("segment_id")
    state = current.select("path", "checksum") if findings is None else pr.project_scan_state(current, findings)
    moved = changed_paths(state, tables["scan_state"]).select("path")
    minus = tables["postings"].join(gone, "segment_id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
    plus = new["postings"].groupBy("term").agg(F.count("*").alias("df"))
    lost = tables["segment_stats"].join(gone, "segment_id", "left_semi").agg((-F.count("*")).alias("n_segments"), (-F.sum("n_tokens")).alias("total_tokens"))
    totals = [t.select("n_segments", "total_tokens") for t in (tables["corpus_stats"], lost, new["corpus_stats"])]
    added = {name: df for name, df in new.items() if name in OUT_BY} | {
        "term_stats": minus.unionByName(plus).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"),
        "corpus_stats": corpus_stats(reduce(DataFrame.unionByName, totals)),
        "scan_state": state.join(moved, "path", "left_semi"),
        "index_metadata": pr.index_metadata(spark, snapshot_digest(state), built_at),
    }
    lists = {"objects": out, "shards": shards, "segments": gone, "paths": moved}
    return Changes(added, reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("list"), F.col(df.columns[0]).alias("key")) for name, df in lists.items())))


def incremental_update(tables: dict[str, DataFrame], changed: DataFrame, objects: DataFrame, bodies: DataFrame, edges: DataFrame, current: DataFrame, built_at: str, roots: Roots = Roots(), findings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables after the changed paths (``changes_of``), equal row for row to a rebuild."""
    changes = changes_of(tables, changed, objects, bodies, edges, current, built_at, roots, findings)
    done = {name: overlaid(name, [tables[name].drop("bucket"), df], changes.gone.withColumn("n", F.lit(1))) for name, df in changes.added.items()}
    return done | {"tags": done["object_tags"].select("tag").distinct()}


def publish_changes(
    spark: SparkSession, out: str, changed: DataFrame, objects: DataFrame, bodies: DataFrame, edges: DataFrame, files: DataFrame, findings: DataFrame, built_at: str, again: Callable[[], DataFrame] | None = None, roots: Roots = Roots()
) -> str:
    """Lists a version that holds only what the changed paths add to the newest one; refuses as ``publish`` does.

    ``findings`` are all of a scan of the present files.  A version made of more than
    ``MOST_PARTS`` others is written whole.
    """
    if not is_healthy(findings):
        raise ValueError("INDEX_SOURCE_INVALID")
    changes = changes_of(read_projection(spark, out), changed, objects, bodies, edges, files, built_at, roots, findings)
    version = write_changes(changes.added, changes.gone, out, _sound(again))
    return compact(spark, out) if len(newest(spark, out)["parts"]) > MOST_PARTS else version


def check_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key_value) of rows whose parent is missing."""
    keys = (("sections", "object_id", "objects", "id"), ("segments", "object_id", "objects", "id"), ("object_tags", "object_id", "objects", "id"), ("type_transitions", "object_id", "objects", "id"), ("citations", "segment_id", "segments", "segment_id"), ("relations", "from_id", "objects", "id"), ("relations", "to_id", "objects", "id"), ("postings", "segment_id", "segments", "segment_id"))
    out = None
    for child, key, parent, own in keys:
        lost = tables[child].select(F.col(key).alias("k")).distinct().join(tables[parent].select(F.col(own).alias("k")), "k", "left_anti").select(F.lit(f"{child}.{key}").alias("table_name"), F.col("k").alias("key_value"))
        out = lost if out is None else out.unionByName(lost)
    return out
