"""Knowledge-base tables derived from the test data by SQL that Spark and DuckDB both run.

Every view uses whole tables and whole texts.  Some ids dangle and some types disagree on
purpose, so that joins and rules have hits and misses.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.projection import project_search_fields
from quire.sources.vault import read_projection, shared_folder, write_projection

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark".split()

VIEWS = {
    "v_sources": """
        SELECT concat('src_', CAST(page_id AS VARCHAR(20))) AS id, 'source' AS kind,
               CASE page_id % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'web' WHEN 2 THEN 'book' ELSE 'oss' END AS subtype, url AS canonical_url, url AS title,
               CASE WHEN page_id % 3 = 0 THEN 'private' ELSE 'public' END AS visibility,
               CASE WHEN page_id % 11 = 0 THEN 'archived' WHEN page_id % 13 = 0 THEN 'superseded' ELSE 'active' END AS record_status,
               CASE page_id % 5 WHEN 0 THEN 'inbox' WHEN 1 THEN 'reading' WHEN 2 THEN 'processed' ELSE 'integrated' END AS workflow_stage,
               CASE WHEN page_id % 8 = 3 THEN 'NOASSERTION' WHEN page_id % 4 = 3 THEN 'MIT' END AS license,
               CASE WHEN page_id % 8 = 1 THEN md5(html) END AS snapshot, md5(html) AS checksum, page_id % 365 AS updated, page_id % 91 AS created
        FROM pages""",
    "v_notes": """
        SELECT concat('note_', CAST(doc_id AS VARCHAR(20))) AS id, 'note' AS kind,
               CASE doc_id % 4 WHEN 0 THEN 'idea' WHEN 1 THEN 'literature' WHEN 2 THEN 'concept' ELSE 'synthesis' END AS subtype,
               concat(source, '/', lang) AS title, lang AS tag1, source AS tag2,
               CASE WHEN doc_id % 3 = 0 THEN 'private' ELSE 'public' END AS visibility,
               CASE WHEN doc_id % 17 = 0 THEN 'archived' WHEN doc_id % 19 = 0 THEN 'superseded' ELSE 'active' END AS record_status,
               CASE doc_id % 5 WHEN 0 THEN 'seed' WHEN 1 THEN 'developing' WHEN 2 THEN 'mature' ELSE 'evergreen' END AS maturity,
               doc_id % 365 AS updated, md5(text) AS checksum
        FROM documents""",
    "v_objects": """
        SELECT id, kind, subtype, title, tag1, tag2, visibility, record_status, CAST(NULL AS VARCHAR(20)) AS workflow_stage, maturity, updated, CAST(NULL AS VARCHAR(20)) AS license, CAST(NULL AS VARCHAR(40)) AS snapshot, checksum FROM v_notes
        UNION ALL
        SELECT id, kind, subtype, title, subtype, workflow_stage, visibility, record_status, workflow_stage, CAST(NULL AS VARCHAR(20)), updated, license, snapshot, checksum FROM v_sources""",
    "v_segments": """
        SELECT concat('note_', CAST(doc_id AS VARCHAR(20))) AS object_id, concat('sec_', CAST(half AS VARCHAR(20))) AS section_id,
               CASE WHEN half = 0 THEN 'human' WHEN doc_id % 6 = 5 THEN 'ai' WHEN doc_id % 7 = 6 THEN 'evolution' ELSE 'fact' END AS role, CAST(half AS INTEGER) AS ordinal,
               CASE WHEN half = 0 THEN substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) ELSE substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1, length(text)) END AS text,
               concat('seg_', CAST(doc_id AS VARCHAR(20)), '_', CAST(half AS VARCHAR(20))) AS segment_id, doc_id AS doc_no, lang
        FROM documents CROSS JOIN (SELECT 0 AS half UNION ALL SELECT 1) h""",
    "v_citations": """
        SELECT segment_id, ordinal, concat('src_', CAST(page_no AS VARCHAR(20))) AS source_id,
               CASE (page_no + CASE WHEN doc_no % 10 = 1 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'web' WHEN 2 THEN 'book' ELSE 'oss' END AS locator_type
        FROM (SELECT s.segment_id, o.ordinal, s.doc_no, s.lang, (s.doc_no * 7 + o.ordinal) % (SELECT max(page_id) + 10 FROM pages) AS page_no
              FROM v_segments s CROSS JOIN (SELECT 0 AS ordinal UNION ALL SELECT 1) o WHERE s.role = 'fact') x
        WHERE lang <> 'es' AND (ordinal = 0 OR lang = 'de')""",
    "v_relations": """
        SELECT DISTINCT concat('note_', CAST(l_orderkey % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR(20))) AS from_id,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('src_', CAST(l_partkey % (SELECT max(page_id) + 10 FROM pages) AS VARCHAR(20)))
                    ELSE concat('note_', CAST(l_partkey % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR(20))) END AS to_id,
               CASE l_linenumber WHEN 1 THEN 'related_to' WHEN 2 THEN 'cites' WHEN 3 THEN 'supports' WHEN 4 THEN 'summarizes' WHEN 5 THEN 'contradicts' WHEN 6 THEN 'synthesizes' ELSE 'supersedes' END AS relation_type
        FROM lineitem""",
    "v_scan_old": "SELECT concat('notes/', CAST(doc_id AS VARCHAR(20)), '.md') AS path, md5(text) AS checksum FROM documents WHERE source <> 'src3'",
    "v_scan_new": "SELECT concat('notes/', CAST(doc_id AS VARCHAR(20)), '.md') AS path, CASE WHEN lang = 'de' THEN md5(concat(text, 'x')) ELSE md5(text) END AS checksum FROM documents WHERE source <> 'src7'",
    "v_workflow_requests": """
        SELECT event_id AS request_id, concat('src_', CAST(user_id % (SELECT max(page_id) + 10 FROM pages) AS VARCHAR(20))) AS source_id,
               CASE event_type WHEN 'view' THEN 'inbox' WHEN 'click' THEN 'reading' WHEN 'signup' THEN 'processed' ELSE 'integrated' END AS target
        FROM events""",
    "v_identifiers": """
        SELECT p_partkey AS request_id, concat('doi:10.1000/ABC.', CAST(p_partkey % 40 AS VARCHAR(20))) AS doi, concat('arXiv:2401.', lpad(CAST(p_partkey % 40 AS VARCHAR(20)), 5, '0'), 'v2') AS arxiv,
               concat('978', lpad(CAST(p_partkey * 7919 AS VARCHAR(20)), 10, '0')) AS isbn, concat('https://github.com/acme/p', CAST(p_partkey % 40 AS VARCHAR(20)), '.git') AS repo,
               concat('HTTPS://Example.org/a/../', CAST(p_partkey % 40 AS VARCHAR(20)), '#x') AS web
        FROM part""",
    "x_sources": """
        SELECT concat('src_', CAST(page_id AS VARCHAR(20))) AS id, page_id AS n, CASE page_id % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'web' WHEN 2 THEN 'book' ELSE 'oss' END AS subtype,
               CASE WHEN page_id % 3 = 0 THEN url END AS canonical_url, CASE WHEN page_id % 7 < 2 THEN '10.1000/x' END AS doi, CASE WHEN page_id % 5 = 0 THEN 'K' END AS zotero_key,
               CASE WHEN page_id % 2 = 1 THEN '2024-01-01T00:00:00Z' END AS captured_at, CASE WHEN page_id % 9 = 0 THEN '9780306406157' END AS isbn, CASE WHEN page_id % 13 < 8 THEN 'h.example.org' END AS repository_host,
               CASE page_id % 19 WHEN 0 THEN 'shared' WHEN 1 THEN 'user' END AS zotero_library_type, CAST(CASE page_id % 23 WHEN 0 THEN -1 WHEN 1 THEN 0 END AS INT) AS zotero_item_version,
               CASE page_id % 11 WHEN 0 THEN '2401.12345' WHEN 1 THEN '2401.12345v2' WHEN 2 THEN 'math.gt/0309136' END AS arxiv_id, CAST(CASE page_id % 17 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS INT) AS arxiv_version,
               CASE page_id % 29 WHEN 0 THEN '2nd' WHEN 2 THEN ' 3rd' END AS edition, CASE page_id % 37 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' END AS attachment_media_type,
               CASE page_id % 41 WHEN 0 THEN 'a/b.pdf' WHEN 1 THEN 'b.pdf' WHEN 2 THEN '' END AS attachment_filename, CAST(CASE page_id % 43 WHEN 0 THEN -1 WHEN 1 THEN 1 END AS INT) AS attachment_version,
               CAST(CASE page_id % 47 WHEN 0 THEN 0 WHEN 1 THEN 9 END AS BIGINT) AS attachment_size, CASE page_id % 53 WHEN 0 THEN 'md5:1' WHEN 1 THEN concat('sha256:', repeat('0a', 32)) END AS attachment_sha256
        FROM pages""",
    "x_snippets": """
        SELECT concat('snip_', CAST(c_custkey AS VARCHAR(20))) AS id, concat('src_', CAST(c_custkey % (SELECT max(page_id) + 10 FROM pages) AS VARCHAR(20))) AS source_id,
               CAST(c_custkey % 7 AS INT) AS start_line, CAST(c_custkey % 5 + 2 AS INT) AS end_line FROM customer""",
    "x_artifacts": """
        SELECT concat('ai_', CAST(o_orderkey AS VARCHAR(20))) AS id, o_orderkey AS n, CASE WHEN o_orderkey % 9 = 0 THEN 'public' ELSE 'private' END AS visibility,
               CASE o_orderkey % 4 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'rejected' ELSE 'promoted' END AS review_status, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'me' END AS reviewed_by,
               CASE WHEN o_orderkey % 7 > 1 THEN '2024-01-01T00:00:00Z' END AS reviewed_at,
               CASE WHEN o_orderkey % 3 = 0 THEN concat('src_', CAST(o_custkey % (SELECT max(page_id) + 10 FROM pages) AS VARCHAR(20))) ELSE concat('note_', CAST(o_custkey % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR(20))) END AS input_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'sec_0' WHEN 1 THEN 'sec_1' WHEN 2 THEN 'sec_9' END AS input_section FROM orders""",
    "x_edges": """
        SELECT CASE WHEN k = 7 THEN concat('snip_', CAST(p % (SELECT max(c_custkey) + 3 FROM customer) AS VARCHAR(20))) WHEN k = 2 THEN concat('note_', CAST(4 * (o % (SELECT CAST(floor(max(doc_id) / 8) AS BIGINT) + 1 FROM documents)) + CASE WHEN s % 4 = 0 THEN 2 ELSE 1 END AS VARCHAR(20)))
                    WHEN k = 3 THEN concat('note_', CAST(4 * (o % (SELECT CAST(floor(max(doc_id) / 8) AS BIGINT) + 1 FROM documents)) + CASE WHEN s % 5 = 0 THEN 0 ELSE 3 END AS VARCHAR(20))) ELSE concat('note_', CAST(o % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR(20))) END AS from_id,
               CASE WHEN k IN (1, 2, 7) THEN concat('src_', CAST(p % (SELECT max(page_id) + 10 FROM pages) AS VARCHAR(20))) ELSE concat('note_', CAST(p % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR(20))) END AS to_id,
               CASE k WHEN 1 THEN 'cites' WHEN 2 THEN 'summarizes' WHEN 3 THEN 'synthesizes' WHEN 4 THEN 'supports' WHEN 5 THEN 'derived_from' WHEN 6 THEN 'related_to' ELSE 'snippet_from' END AS relation_type,
               CASE WHEN k IN (3, 4, 5) AND s % 3 = 0 THEN 'sec_1' WHEN k IN (3, 4, 5) AND s % 3 = 1 THEN 'sec_9' END AS to_section_id,
               CASE WHEN k IN (1, 2, 4) THEN CASE s % 5 WHEN 0 THEN 'paper' WHEN 1 THEN 'book' WHEN 2 THEN 'oss' END END AS locator_type, p % 50 = 0 AS strays
        FROM (SELECT l_orderkey AS o, l_linenumber AS k, l_partkey AS p, l_suppkey AS s FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 5 AND l_returnflag = 'R') x""",
    "x_items": """
        SELECT p_partkey AS n, concat('k', CAST(p_partkey AS VARCHAR(20))) AS item_key, CASE p_partkey % 7 WHEN 0 THEN 'journalArticle' WHEN 1 THEN 'book' WHEN 2 THEN 'preprint' WHEN 3 THEN 'webpage' WHEN 4 THEN 'map' WHEN 5 THEN 'thesis' ELSE 'book' END AS item_type,
               CASE WHEN p_partkey % 7 IN (0, 1, 4, 5) THEN concat('10.1000/i', CAST(p_partkey - CASE WHEN p_partkey % 35 = 5 THEN 5 ELSE 0 END AS VARCHAR(20))) END AS doi,
               CASE WHEN p_partkey % 7 IN (0, 2) THEN concat('2401.', lpad(CAST(p_partkey AS VARCHAR(20)), 5, '0')) END AS arxiv_id, CASE WHEN p_partkey % 7 = 3 THEN concat('https://site.example.org/', CAST(p_partkey AS VARCHAR(20))) END AS url FROM part""",
}
#: Which views each needs, in order of definition.
PRELUDE = ", ".join(f"{name} AS ({sql})" for name, sql in VIEWS.items())


def oracle(sql: str) -> str:
    """A DuckDB query over the views."""
    return f"WITH {PRELUDE} {sql.strip()}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables of a folder."""
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"WITH {PRELUDE} SELECT * FROM {name}")


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): every benchmark text in runs of three words."""
    words = F.split(F.trim("text"), r"\s+")
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", words.alias("w"))
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 3).cast("int"))).alias("k"))
    return rows.select((F.col("item_id") * 100_000 + F.col("k")).alias("query_id"), F.array_join(F.slice("w", F.col("k") * 3 + 1, F.lit(3)), " ").alias("query"))


QUERY_SQL = "SELECT item_id * 100000 + k AS query_id, array_to_string(w[k * 3 + 1:k * 3 + 3], ' ') AS query FROM (SELECT item_id, w, unnest(range(0, CAST(floor((len(w) - 1) / 3) AS BIGINT) + 1)) AS k FROM (SELECT item_id, regexp_split_to_array(trim(text), '\\s+') AS w FROM benchmark))"


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_objects with the structs that audits read."""
    snap = F.when(F.col("snapshot").isNotNull(), F.struct(F.lit("2024-01-01T00:00:00Z").alias("captured_at"), F.col("snapshot").alias("content_hash"), F.col("id").alias("identifier"), F.lit("p").alias("provider")))
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    more = none("isbn", "edition", "repository_host", "repository_path", "commit", "source_id") | {"snapshot_ref": snap, "publication_approved": F.lit(None).cast("boolean"), "tags": F.array("tag1", "tag2"), "path": F.concat(F.lit("objects/"), F.col("id"), F.lit(".md"))}
    return view(spark, sf_dir, "v_objects").withColumns(more)


def located(citations: DataFrame) -> DataFrame:
    """Citations with a locator that agrees with its source in all but, perhaps, its type."""
    snap = F.when(F.col("locator_type") == "web", F.struct(F.lit("2024-01-01T00:00:00Z").alias("captured_at"), F.lit("any").alias("content_hash"), F.col("source_id").alias("identifier"), F.lit("p").alias("provider")))
    return citations.withColumn("locator", F.to_json(F.struct(F.lit(2).alias("locator_version"), snap.alias("snapshot_ref"), F.col("locator_type").alias("source_type"))))


_stored: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that search reads, from a projection that the session's first query over these data writes."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        out = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        write_projection(built_index(spark, sf_dir, f"{out}/fields"), out, 16)
        _stored[key] = out
    return read_projection(spark, _stored[key])


def score_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``index`` with its postings in bounded blocks, which the session's first query over these data writes."""
    from quire.operators.index import score_blocks

    tables, base = index(spark, sf_dir), _stored[spark.sparkContext.applicationId, sf_dir]
    key = (spark.sparkContext.applicationId, f"{sf_dir}#scores")
    if key not in _stored:
        out = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
        write_projection({"score_blocks": score_blocks(spark.read.parquet(f"{base}/fields"))}, out, 16)
        _stored[key] = out
    return tables | read_projection(spark, _stored[key])


def grep_index(spark: SparkSession, sf_dir: str, files: DataFrame) -> dict[str, DataFrame]:
    """The trigram index of the files, which the session's first query over these data writes."""
    from quire.operators.search import grep_index as built

    key = (spark.sparkContext.applicationId, f"{sf_dir}#trigrams")
    if key not in _stored:
        out = f"{shared_folder(spark)}/trigrams-{uuid.uuid4().hex}"
        write_projection(built(files), out, 16)
        _stored[key] = out
    return read_projection(spark, _stored[key])


def built_index(spark: SparkSession, sf_dir: str, at: str | None = None) -> dict[str, DataFrame]:
    """The tables that search reads, from the test tables; tokens are written to ``at``, if given, so that texts are cut once for all."""
    from quire.operators.index import build_postings

    segments = view(spark, sf_dir, "v_segments").drop("doc_no", "lang")
    objects = details(spark, sf_dir)
    fields = project_search_fields(segments, objects)
    if at:
        fields.write.parquet(at)
        fields = spark.read.parquet(at)
    keep = ["id", "kind", "subtype", "title", "visibility", "record_status", "workflow_stage", "maturity", "tags"]
    return {"segments": segments, "objects": objects.select(*keep, F.lit(None).cast("string").alias("review_status")), "details": objects, "citations": located(view(spark, sf_dir, "v_citations")), **build_postings(fields)}
