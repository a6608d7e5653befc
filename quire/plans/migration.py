"""Queries of the migration: every document of the test data is written as a record of version 1, and all are planned together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import migrate
from quire.plans.queries import query

_DATED = "visibility: public\nrecord_status: active\ncreated: 2024-01-01\nupdated: 2024-01-02\ntags: [alpha]\n"


def _record(kind: str, prefix: str, more: str, body: str = "@TEXT@\n", dated: str = _DATED) -> str:
    return f"---\nschema_version: 1\nid: {prefix}_@N@\nkind: {kind}\ntitle: Title @N@\n{dated}{more}---\n{body}"


def _note(kind: str, more: str = "", body: str = "Lead\n\n<!-- section_id: sec_my_interpretation -->\n## Mine\n\n@TEXT@\n", maturity: str = "seed") -> str:
    return _record("note", "note", f"note_type: {kind}\nmaturity: {maturity}\nreview_status: reviewed\n{more}", body)


_WEB = "source_type: web\nworkflow_stage: inbox\ncanonical_url: https://example.org/@N@\ncaptured_at: '2024-01-01T00:00:00Z'\ncontent_hash: sha256:h\n"
_OSS = "source_type: oss\nworkflow_stage: inbox\ncanonical_url: https://Git.Example.org/a/b\nrepo: a/b.git\ncommit: c1\nlicense: MIT\n"
_AI = "artifact_type: summary\ngenerated_by: g\nmodel: m\nprompt_ref: null\n"
_PRIVATE = "visibility: private\nrecord_status: active\ncreated: 2024-01-01\n"
#: Version 1 records: the file's folder, the record, and the findings on it.  @K@ is the id of the group's web source, the first variant; @M@ that of its repository, the second.
VARIANTS = [
    ("sources/web", _record("source", "src", _WEB), ["MIGRATION_OBJECT_CONVERTED"]), ("sources/oss", _record("source", "src", _OSS), ["MIGRATION_OBJECT_CONVERTED"]),
    ("snippets", _record("snippet", "snip", "source_id: src_@M@\nrepo: a/b\ncommit: c1\npath: f.py\nstart_line: 1\nend_line: 2\nlicense: MIT\n"), ["MIGRATION_OBJECT_CONVERTED"]),
    ("ai", _record("ai_artifact", "ai", _AI + "review_status: unreviewed\nreviewed_by: null\nreviewed_at: null\nsource_ids: [src_@K@]\n", dated=_PRIVATE), ["MIGRATION_OBJECT_CONVERTED"]),
    ("notes/literature", _note("literature", "source_ids: [src_@K@]\nai_assisted: false\n"), ["MIGRATION_OBJECT_CONVERTED", "MIGRATION_RELATION_SHARD_CREATED"]), ("notes/ideas", _note("idea"), ["MIGRATION_OBJECT_CONVERTED"]),
    ("sources/oss", _record("source", "src", _OSS.replace("repo: a/b.git\n", "")), ["MIGRATION_IDENTITY_BLOCKED"]), ("sources/web", _record("source", "src", _WEB.replace("sha256:h", "md5:h")), ["SNAPSHOT_INVALID"]), ("sources/web", _record("source", "src", _WEB + "colour: red\n"), ["FIELD_UNKNOWN"]),
    ("sources/web", "no frontmatter", ["MIGRATION_PARSE_FAILED"]), ("sources/web", _record("source", "src", _WEB).replace("schema_version: 1", "schema_version: 2"), ["MIGRATION_VERSION_BLOCKED"]), ("sources/web", _record("source", "src", _WEB).replace("id: src_@N@", "id: 7"), ["MIGRATION_IDENTITY_BLOCKED"]),
    ("sources/web", _record("film", "src", _WEB), ["MIGRATION_KIND_BLOCKED"]), ("snippets", _record("snippet", "snip", "source_id: src_@N@\nrepo: a/b\n"), ["MIGRATION_REFERENCE_BLOCKED"]),
    ("ai", _record("ai_artifact", "ai", _AI + "review_status: accepted\nreviewed_by: null\nreviewed_at: null\n", dated=_PRIVATE), ["MIGRATION_AI_PROVENANCE_BLOCKED", "AI_REVIEW_INVALID"]),
    ("notes/concepts", _note("evergreen"), ["MIGRATION_EVERGREEN_CLASSIFICATION_REQUIRED"]), ("notes/ideas", _note("idea", body="no section\n"), ["MIGRATION_SECTION_BLOCKED"]),
    ("notes/ideas", _note("idea", body="<!-- section_id: sec_my_interpretation -->\n## Mine\n\nx\n\n<!-- section_id: sec_original_facts -->\n\n## Facts\n\n@TEXT@ facts\n"), ["MIGRATION_FACT_LOCATOR_REQUIRED", "NOTE_BLOCK_METADATA_MISSING"]),
    ("notes/ideas", _note("idea", body="<!-- section_id: sec_my_interpretation -->\n## Mine\n\nx\n\n<!-- section_id: sec_ai_inference -->\n## AI\n\n@TEXT@ guess\n"), ["MIGRATION_AI_SECTION_BLOCKED", "NOTE_BLOCK_METADATA_MISSING"]),
    ("notes/ideas", _note("idea", "ai_assisted: true\n"), ["MIGRATION_AI_ASSISTED_BLOCKED", "MIGRATION_OBJECT_CONVERTED"]), ("notes/literature", _note("literature", "source_ids: []\n"), ["MIGRATION_LITERATURE_SOURCE_REQUIRED", "MIGRATION_OBJECT_CONVERTED"]),
    ("notes/ideas", _note("idea", "source_ids: [src_@K@]\n"), ["MIGRATION_INFERENCE_PROHIBITED", "MIGRATION_OBJECT_CONVERTED"]), ("notes/ideas", _note("idea", maturity="mature"), ["NOTE_MATURITY_INVALID"]),
    ("notes/concepts", _note("concept", "related_notes: [note_@N@, note_@N@]\nsupersedes: [note_gone]\nsuperseded_by: note_@N@\n"), ["MIGRATION_OBJECT_CONVERTED", "MIGRATION_RELATION_DEDUPLICATED", "MIGRATION_REFERENCE_BLOCKED", "MIGRATION_RELATION_SHARD_CREATED"]),
]
#: How many of the first ones are sound.
SOUND = 6


def files(spark: SparkSession, d: str, sound: bool = False) -> DataFrame:
    """(path, checksum, content): a version 1 file a document, and the one file of relations; ``sound`` ones, without it, only."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = SOUND if sound else len(VARIANTS)
    variants = F.broadcast(spark.createDataFrame([(v, folder, record) for v, (folder, record, _) in enumerate(VARIANTS[:n])], "v long, folder string, record string"))
    rows = docs.withColumn("v", F.col("doc_id") % n).join(variants, "v")
    pad = lambda c: F.lpad(c.cast("string"), 26, "0")
    text, first = F.col("record"), F.col("doc_id") - F.col("v")
    for mark, value in (("@N@", pad(F.col("doc_id"))), ("@K@", pad(first)), ("@M@", pad(first + 1)), ("@TEXT@", F.col("text"))):
        text = F.replace(text, F.lit(mark), value)
    rows = rows.select(F.concat("folder", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), text.alias("content"))
    if not sound:
        one = "note_" + "4".zfill(26)
        edges = [
            f"{{from_id: {one}, to_id: src_{'0' * 26}, relation_type: cites, created_by: me, locator: {{locator_version: 1, source_type: web, paragraph: 1, snapshot_ref: {{provider: p, identifier: i, captured_at: '2024-01-01T00:00:00Z', content_hash: 'sha256:h'}}}}}}",
            f"{{from_id: {one}, to_id: src_{'0' * 26}, relation_type: summarizes}}", f"{{from_id: {one}, to_id: {one}, relation_type: supports, to_section_id: Bad}}", f"{{from_id: {one}, to_id: {one}, relation_type: likes}}", f"{{from_id: {one}}}",
            f"{{from_id: {one}, to_id: {one}, relation_type: supports, locator: {{source_type: paper}}}}", "word",
        ]
        rows = rows.unionByName(spark.createDataFrame([(migrate.V1_RELATIONS, "schema_version: 1\nrelations:\n" + "".join(f"- {e}\n" for e in edges))], "path string, content string"))
    return rows.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"), F.encode("content", "UTF-8").alias("content"))


_PAIRS = ", ".join(f"({v}, '{code}')" for v, (_, _, codes) in enumerate(VARIANTS) for code in codes)
_KIND = "CASE WHEN code IN ('MIGRATION_OBJECT_CONVERTED', 'MIGRATION_RELATION_SHARD_CREATED', 'MIGRATION_RELATION_DEDUPLICATED', 'MIGRATION_VAULT_CONFIG_CREATED') THEN 'change' WHEN code LIKE '%REQUIRED' OR code LIKE '%PROHIBITED' THEN 'decision' ELSE 'blocker' END"


@query(f"""SELECT {_KIND} AS kind, code, count(*) AS n FROM (SELECT code FROM documents JOIN (VALUES {_PAIRS}) v(v, code) ON doc_id % {len(VARIANTS)} = v
    UNION ALL SELECT unnest(['MIGRATION_RELATION_DEDUPLICATED', 'SECTION_ID_INVALID', 'FIELD_INVALID', 'MIGRATION_RELATIONS_BLOCKED', 'LOCATOR_INVALID', 'MIGRATION_VAULT_CONFIG_CREATED'])) x GROUP BY ALL""")
def migration_findings(spark, d):
    """MG1-MG4: what a plan over all records reports."""
    return migrate.plan(spark, files(spark, d), "2024-02-02T00:00:00Z").report.groupBy("kind", "code").agg(F.count("*").alias("n"))


_SOUND_CTE = f"""m AS (SELECT doc_id AS n, doc_id % {SOUND} AS v, doc_id // {SOUND} AS g, lpad(CAST(doc_id AS VARCHAR), 26, '0') AS num FROM documents), have AS (SELECT n FROM m)"""


@query(f""", {_SOUND_CTE} SELECT code, count(*) AS n, FALSE AS allowed FROM (
        SELECT 'MIGRATION_OBJECT_CONVERTED' AS code FROM m UNION ALL SELECT 'MIGRATION_RELATION_SHARD_CREATED' FROM m WHERE v = 4 UNION ALL SELECT 'MIGRATION_VAULT_CONFIG_CREATED'
        UNION ALL SELECT 'MIGRATION_RESULT_NOTE_HUMAN_SECTION_MISSING' FROM m WHERE FALSE UNION ALL SELECT 'MIGRATION_RESULT_OBJECT_LAYOUT_INVALID') x GROUP BY ALL""")
def migration_prospect(spark, d):
    """MG4: records without decisions or blockers are scanned as they would be; a stray file among the notes is all that's wrong."""
    rows = files(spark, d, sound=True)
    stray = spark.createDataFrame([("notes/ideas/stray.txt", "sha256:x", bytearray(b"x"))], rows.schema)
    plan = migrate.plan(spark, rows.unionByName(stray), "2024-02-02T00:00:00Z")
    return plan.report.groupBy("code").agg(F.count("*").alias("n")).withColumn("allowed", F.lit(plan.allowed))


@query(f""", {_SOUND_CTE} SELECT CASE v WHEN 0 THEN 'sources/web/' WHEN 1 THEN 'sources/oss/' WHEN 2 THEN 'snippets/' WHEN 3 THEN 'ai/' WHEN 4 THEN 'notes/literature/' ELSE 'notes/ideas/' END || n || '.md' AS path,
        CASE v WHEN 0 THEN 'v1-migration' END AS provider, CASE v WHEN 0 THEN concat('https://example.org/', num) END AS identifier, CASE WHEN v IN (1, 2) THEN 'git.example.org/a/b' END AS repository, CASE WHEN v = 2 THEN FALSE END AS approved,
        CASE WHEN v = 3 THEN concat('src_', lpad(CAST(g * {SOUND} AS VARCHAR), 26, '0')) END AS input FROM m""")
def migrated_objects(spark, d):
    """MG1: the proposed files of sound records, parsed as version 2."""
    from quire.sources import vault

    writes = migrate.plan(spark, files(spark, d, sound=True), "2024-02-02T00:00:00Z").writes
    objects = vault.parse_objects(writes.select("path", F.lit("sha256:x").alias("checksum"), F.encode("content", "UTF-8").alias("content")))[0]
    c = F.col
    repository = F.when(c("repository_host").isNotNull(), F.concat("repository_host", F.lit("/"), "repository_path"))
    return objects.select("path", c("snapshot_ref.provider").alias("provider"), c("snapshot_ref.identifier").alias("identifier"), repository.alias("repository"), c("publication_approved").alias("approved"), F.get(c("input_refs"), F.lit(0))["object_id"].alias("input"))


#: Codes that must come up.
EXPECTED = {"migration_findings": {code for _, _, codes in VARIANTS for code in codes} | {"SECTION_ID_INVALID", "FIELD_INVALID", "MIGRATION_RELATIONS_BLOCKED", "LOCATOR_INVALID"}, "migration_prospect": {"MIGRATION_RESULT_OBJECT_LAYOUT_INVALID"}}
