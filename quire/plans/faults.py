"""Registered queries of the validation rules, capture and identifiers on views in which every rule fires."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import schemas
from quire.functions import identity as idn
from quire.functions import text as tx
from quire.functions.urls import normalize_repository_host
from quire.operators import bulk, catalog, validate
from quire.plans import fixtures as fx
from quire.plans.queries import _bodies, query

def _none():
    return F.lit(None).cast("string")


def _sources(spark, d):
    filled = F.when(F.col("n") % 2 == 0, "c0").otherwise("c1")
    more = {"kind": F.lit("source"), "path": F.concat(F.lit("sources/"), F.col("id"), F.lit(".md")), "repository_path": F.lit("a/b"), "commit": filled, "license": F.lit("MIT"), "managed_fields_hash": _none()}
    return fx.view(spark, d, "x_sources").withColumns(more)


@query(r"""SELECT 'SOURCE_IDENTITY_MISSING' AS code, id AS object_id, NULL AS field FROM x_sources WHERE CASE subtype WHEN 'paper' THEN coalesce(canonical_url, doi, zotero_key) IS NULL
        WHEN 'web' THEN canonical_url IS NULL OR captured_at IS NULL WHEN 'book' THEN coalesce(isbn, doi, zotero_key, canonical_url) IS NULL ELSE canonical_url IS NULL OR repository_host IS NULL END
    UNION ALL SELECT 'FIELD_INVALID', id, field FROM (SELECT *, CASE WHEN zotero_library_type = 'shared' THEN 'zotero_library_type' WHEN zotero_item_version < 0 THEN 'zotero_item_version' WHEN arxiv_version IS NOT NULL AND (arxiv_id IS NULL OR arxiv_version < 1) THEN 'arxiv_version'
            WHEN arxiv_id LIKE '%v2' THEN 'arxiv_id' WHEN edition IS NOT NULL AND (subtype <> 'book' OR edition LIKE ' %') THEN 'edition' WHEN attachment_media_type = 'text/html' THEN 'attachment_media_type' WHEN attachment_filename IN ('', 'a/b.pdf') THEN 'attachment_filename'
            WHEN attachment_version < 0 THEN 'attachment_version' WHEN attachment_size < 1 THEN 'attachment_size' WHEN attachment_sha256 LIKE 'md5%' THEN 'attachment_sha256' END AS field FROM x_sources
        WHERE NOT CASE subtype WHEN 'paper' THEN coalesce(canonical_url, doi, zotero_key) IS NULL WHEN 'web' THEN canonical_url IS NULL OR captured_at IS NULL WHEN 'book' THEN coalesce(isbn, doi, zotero_key, canonical_url) IS NULL ELSE canonical_url IS NULL OR repository_host IS NULL END) x WHERE field IS NOT NULL""")
def source_findings(spark, d):
    """VA2."""
    return validate.check_source_identity(_sources(spark, d)).select("code", "object_id", F.col("details")["field"][0].alias("field"))


@query("""SELECT CASE WHEN subtype = 'idea' AND maturity NOT IN ('seed', 'developing') THEN 'NOTE_MATURITY_INVALID' ELSE 'NOTE_TRANSITION_INVALID' END AS code, id AS object_id FROM (SELECT *, CAST(substring(id, 6, 20) AS BIGINT) AS n FROM v_notes) x
    WHERE subtype = 'idea' AND maturity NOT IN ('seed', 'developing') OR n % 3 > 0 AND subtype <> 'concept' OR n % 3 = 2 OR n % 3 = 1 AND n % 5 = 0""")
def transition_findings(spark, d):
    """VA3: histories of none, one or two steps, some of them backwards."""
    n = F.substring("id", 6, 20).cast("long")
    step = F.when(n % 5 == 0, F.struct(F.struct(F.lit("me").alias("id"), F.lit("human").alias("type")).alias("actor"), F.lit("2024-01-01T00:00:00Z").alias("changed_at"), F.lit("concept").alias("from"), F.lit("idea").alias("to")))
    step = F.coalesce(step, F.struct(F.struct(F.lit("me").alias("id"), F.lit("human").alias("type")).alias("actor"), F.lit("2024-01-01T00:00:00Z").alias("changed_at"), F.lit("idea").alias("from"), F.lit("concept").alias("to")))
    history = F.when(n % 3 == 0, F.array().cast(schemas.HISTORY)).otherwise(F.array_repeat(step, (n % 3).cast("int")))
    return validate.check_notes(fx.details(spark, d).withColumn("type_history", history)).select("code", "object_id")


def _pieces(spark, d):
    c = F.col
    snippets = fx.view(spark, d, "x_snippets").select("id", F.lit("snippet").alias("kind"), _none().alias("subtype"), "source_id", "start_line", "end_line", F.lit("public").alias("visibility"), *(_none().alias(x) for x in ("review_status", "reviewed_by", "reviewed_at", "input_id", "input_section")))
    ai = fx.view(spark, d, "x_artifacts").select("id", F.lit("ai_artifact").alias("kind"), F.lit("summary").alias("subtype"), _none().alias("source_id"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "visibility", "review_status", "reviewed_by", "reviewed_at", "input_id", "input_section")
    rows = snippets.unionByName(ai)
    ref = F.when(c("input_id").isNotNull(), F.array(F.struct(c("input_id").alias("object_id"), c("input_section").alias("section_id"))))
    return rows.withColumns({"input_refs": ref, "path": F.concat(F.lit("x/"), "id", F.lit(".md"))})


@query("""SELECT 'SNIPPET_RANGE_INVALID' AS code, id AS object_id FROM x_snippets WHERE start_line < 1 OR end_line < start_line
    UNION ALL SELECT CASE WHEN visibility = 'public' THEN 'AI_ARTIFACT_INVALID' ELSE 'AI_REVIEW_INVALID' END, id FROM x_artifacts WHERE visibility = 'public' OR (review_status <> 'unreviewed') <> (coalesce(reviewed_by, '') <> '' AND reviewed_at IS NOT NULL)""")
def piece_findings(spark, d):
    """VA4."""
    return validate.check_snippets_and_artifacts(_pieces(spark, d)).select("code", "object_id")


_LOCATORS = """loc AS (SELECT n, v, t, CAST(page AS INT) AS page, chapter, isbn, edition, hash, para, sym, CAST(a AS INT) AS a, CAST(b AS INT) AS b, heads FROM (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 2 END AS v, CASE o_custkey % 5 WHEN 0 THEN 'paper' WHEN 1 THEN 'web' WHEN 2 THEN 'book' WHEN 3 THEN 'oss' ELSE 'film' END AS t,
    CASE o_orderkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN -1 END AS page, CASE WHEN o_orderkey % 3 = 0 THEN 'I' END AS chapter, CASE o_orderkey % 4 WHEN 0 THEN '9780306406157' WHEN 1 THEN '123' END AS isbn, CASE o_orderkey % 5 WHEN 0 THEN '1st' WHEN 1 THEN ' x' END AS edition,
    CASE o_orderkey % 6 WHEN 0 THEN 'md5:1' WHEN 1 THEN NULL ELSE 'sha256:1' END AS hash, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS para, CASE WHEN o_orderkey % 8 = 0 THEN 'f' END AS sym, CASE WHEN o_orderkey % 9 > 1 THEN o_orderkey % 9 - 2 END AS a, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 10 END AS b, o_orderkey % 11 < 4 AS heads FROM orders) y)"""


@query(f""", {_LOCATORS} SELECT code, object_id FROM (SELECT CAST(n AS VARCHAR) AS object_id, CASE WHEN v <> 2 THEN 'LOCATOR_VERSION_UNSUPPORTED' WHEN t = 'film' THEN 'FIELD_INVALID' WHEN t = 'web' AND hash IS NULL THEN 'FIELD_MISSING' WHEN t = 'web' AND hash LIKE 'md5%' THEN 'SNAPSHOT_INVALID'
    WHEN t = 'paper' AND (coalesce(page, 0) = 0 OR page < 1) THEN 'LOCATOR_INVALID' WHEN t = 'web' AND (NOT heads AND para IS NULL OR para < 1) THEN 'LOCATOR_INVALID'
    WHEN t = 'book' AND (chapter IS NULL AND coalesce(page, 0) = 0 OR page IS NOT NULL AND edition IS NULL AND isbn IS NULL OR edition = ' x' OR isbn = '123') THEN 'LOCATOR_INVALID'
    WHEN t = 'oss' AND (sym IS NULL AND (a IS NULL OR b IS NULL) OR a IS NOT NULL AND b IS NOT NULL AND (a < 1 OR b < a)) THEN 'LOCATOR_INVALID' END AS code FROM loc) z WHERE code IS NOT NULL""")
def locator_findings(spark, d):
    """VA5: every other locator is a citation's, the others are edges'."""
    for t in fx.TABLES:
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    rows = spark.sql(f"WITH {_LOCATORS} SELECT * FROM loc")
    c = F.col
    snap = F.when(c("t") == "web", F.struct(F.lit("2024-01-01T00:00:00Z").alias("captured_at"), c("hash").alias("content_hash"), F.lit("i").alias("identifier"), F.lit("p").alias("provider")))
    oss = lambda v: F.when(c("t") == "oss", F.lit(v))
    fields = {
        "chapter": c("chapter"), "commit": oss("c"), "edition": F.when(c("t") == "book", c("edition")), "end_line": c("b"), "figure": _none(), "heading_path": F.when(c("heads"), F.array(F.lit("h"))), "isbn": F.when(c("t") == "book", c("isbn")), "location": _none(), "locator_version": c("v").cast("int"),
        "page": F.when(c("t").isin("paper", "book"), c("page")), "page_label": _none(), "paragraph": c("para").cast("int"), "path": oss("f"), "repository_host": oss("h"), "repository_path": oss("a/b"), "section": _none(), "snapshot_ref": snap, "source_type": c("t"), "start_line": c("a"), "symbol": c("sym"), "table": _none(),
    }
    rows = rows.select("n", F.col("n").cast("string").alias("object_id"), F.struct(*(v.alias(n) for n, v in fields.items())).alias("locator"))
    edges = rows.where("n % 2 = 0").select(F.col("object_id").alias("from_id"), F.lit("relations/x.yaml").alias("path"), "locator")
    block = F.struct(F.lit("fact").alias("kind"), F.lit("t").alias("text"), _none().alias("artifact_id"), F.array(F.struct(F.lit("src_x").alias("source_id"), "locator")).alias("citations"))
    bodies = rows.where("n % 2 = 1").select("object_id", F.lit("note").alias("kind"), F.array(F.struct(F.lit("sec_abc").alias("section_id"), F.lit("fact").alias("role"), F.array(block).alias("blocks"))).alias("sections"))
    return validate.check_locators(bodies, edges).select("code", "object_id")


def _edges(spark, d):
    """Edges of every kind of end, with sections, locators, repeats and files that aren't their owner's."""
    loc = F.from_json(F.to_json(F.struct(F.lit(2).alias("locator_version"), F.col("locator_type").alias("source_type"))), schemas.LOCATOR)
    path = F.concat(F.lit("relations/"), F.when(F.col("strays"), "other").otherwise(F.col("from_id")), F.lit(".yaml"))
    return fx.view(spark, d, "x_edges").withColumns({"locator": F.when(F.col("locator_type").isNotNull(), loc), "path": path})


def _ends(spark, d):
    own = fx.details(spark, d).select("id", "kind", "subtype", "visibility", "snapshot_ref", *(F.lit(None).cast("string").alias(x) for x in ("isbn", "edition", "repository_host", "repository_path", "commit")))
    pieces = _pieces(spark, d).select("id", "kind", "subtype", "visibility")
    return own.unionByName(pieces, allowMissingColumns=True)


_ALL = """o AS (SELECT id, kind, subtype, visibility FROM v_objects UNION ALL SELECT id, 'snippet', NULL, 'public' FROM x_snippets UNION ALL SELECT id, 'ai_artifact', 'summary', visibility FROM x_artifacts),
    j AS (SELECT e.*, f.kind AS fk, f.subtype AS fs, f.visibility AS fv, t.kind AS tk, t.subtype AS ts, t.visibility AS tv FROM x_edges e LEFT JOIN o f ON f.id = from_id LEFT JOIN o t ON t.id = to_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, coalesce(to_section_id, ''), relation_type, coalesce(locator_type, '')) AS nth FROM j WHERE fk IS NOT NULL AND tk IS NOT NULL),
    c AS (SELECT 'RELATION_SOURCE_MISSING' AS code, from_id, NULL AS section_id FROM (SELECT DISTINCT from_id, strays FROM j WHERE fk IS NULL) x UNION ALL SELECT 'RELATION_TARGET_MISSING', from_id, NULL FROM j WHERE fk IS NOT NULL AND tk IS NULL
        UNION ALL SELECT 'RELATION_KIND_INVALID', from_id, to_section_id FROM k WHERE NOT CASE relation_type WHEN 'cites' THEN fk = 'note' AND tk = 'source' WHEN 'summarizes' THEN fk = 'note' AND tk = 'source' WHEN 'synthesizes' THEN fk = 'note' AND tk IN ('source', 'note')
            WHEN 'supports' THEN fk IN ('source', 'note') AND tk = 'note' WHEN 'derived_from' THEN fk IN ('note', 'ai_artifact') AND tk IN ('source', 'note') WHEN 'related_to' THEN fk = 'note' AND tk = 'note' WHEN 'snippet_from' THEN fk = 'snippet' AND tk = 'source' END
        UNION ALL SELECT 'RELATION_DIRECTION_INVALID', from_id, to_section_id FROM k WHERE relation_type = 'summarizes' AND fs IS DISTINCT FROM 'literature' OR relation_type = 'synthesizes' AND fs IS DISTINCT FROM 'synthesis'
        UNION ALL SELECT 'RELATION_TARGET_INVALID', from_id, to_section_id FROM k WHERE relation_type = 'snippet_from' AND ts IS DISTINCT FROM 'oss'
        UNION ALL SELECT 'RELATION_NOT_CANONICAL', from_id, to_section_id FROM k WHERE relation_type = 'related_to' AND from_id >= to_id
        UNION ALL SELECT 'RELATION_SECTION_MISSING', from_id, to_section_id FROM k WHERE to_section_id = 'sec_9'
        UNION ALL SELECT 'RELATION_LOCATOR_MISMATCH', from_id, to_section_id FROM k WHERE tk = 'source' AND (locator_type <> ts)
        UNION ALL SELECT 'RELATION_PRIVATE_DEPENDENCY', from_id, to_section_id FROM k WHERE relation_type <> 'related_to' AND fv = 'public' AND tv = 'private'
        UNION ALL SELECT 'RELATION_DUPLICATE', from_id, to_section_id FROM k WHERE nth > 1)"""


@query(f", {_ALL} SELECT code, from_id AS object_id, coalesce(section_id, '') AS section_id FROM c")
def edge_findings(spark, d):
    """VA13-VA20, every rule on both kinds of ends."""
    sections = fx.view(spark, d, "v_segments").select("object_id", "section_id")
    return validate.check_relations(_edges(spark, d), _ends(spark, d), sections).select("code", "object_id", F.coalesce("section_id", F.lit("")).alias("section_id"))


@query(""", n AS (SELECT from_id, count(*) FILTER (WHERE relation_type = 'summarizes') AS s, count(*) FILTER (WHERE relation_type = 'synthesizes') AS y FROM x_edges GROUP BY from_id)
    SELECT CASE subtype WHEN 'literature' THEN 'LITERATURE_SUMMARY_MISSING' ELSE 'SYNTHESIS_TARGETS_INSUFFICIENT' END AS code, id AS object_id FROM v_notes LEFT JOIN n ON from_id = id
    WHERE subtype = 'literature' AND coalesce(s, 0) = 0 OR subtype = 'synthesis' AND (maturity IN ('mature', 'evergreen') OR visibility = 'public') AND coalesce(y, 0) < 2""")
def number_findings(spark, d):
    """VA21: notes without a summary, or with one synthesis target or none."""
    return validate.check_cardinality(_edges(spark, d), fx.details(spark, d)).select("code", "object_id")


@query(""", f AS (SELECT DISTINCT from_id, strays FROM x_edges), o AS (SELECT id FROM v_objects UNION ALL SELECT id FROM x_snippets)
    SELECT 'RELATION_SHARD_DUPLICATE' AS code, from_id AS object_id FROM (SELECT from_id, row_number() OVER (PARTITION BY from_id ORDER BY CASE WHEN strays THEN 'relations/other.yaml' ELSE concat('relations/', from_id, '.yaml') END) AS nth FROM f) x WHERE nth > 1
    UNION ALL SELECT 'RELATION_SHARD_OWNER_MISMATCH', from_id FROM f WHERE strays AND from_id IN (SELECT id FROM o)
    UNION ALL SELECT 'OBJECT_LAYOUT_INVALID', id FROM v_objects WHERE CASE kind WHEN 'note' THEN subtype IN ('literature', 'synthesis') OR subtype = 'concept' AND updated % 2 = 1 OR updated % 7 = 0 ELSE subtype <> 'web' END""")
def layout_findings(spark, d):
    """VA7, VA8, WI2: notes in the folder of ideas, where only ideas and evolved concepts may be, or in text files; sources among the web pages."""
    step = F.struct(F.struct(F.lit("me").alias("id"), F.lit("human").alias("type")).alias("actor"), F.lit("t").alias("changed_at"), F.lit("idea").alias("from"), F.lit("concept").alias("to"))
    note = F.concat(F.lit("notes/ideas/"), F.col("id"), F.when(F.col("updated") % 7 == 0, ".txt").otherwise(".md"))
    objects = fx.details(spark, d).withColumns({"type_history": F.when((F.col("updated") % 2 == 0) & (F.col("subtype") == "concept"), F.array(step)).otherwise(F.array().cast(schemas.HISTORY)), "path": F.when(F.col("kind") == "note", note).otherwise(F.concat(F.lit("sources/web/"), F.col("id"), F.lit(".md")))})
    edges = _edges(spark, d)
    known = objects.select("id", "kind", "subtype", "path", "type_history").unionByName(_pieces(spark, d).where("kind = 'snippet'").select("id", "kind", "subtype", F.concat(F.lit("snippets/"), "id", F.lit(".md")).alias("path")), allowMissingColumns=True)
    found = validate.check_duplicates(objects, edges).where("code = 'RELATION_SHARD_DUPLICATE'").unionByName(validate.check_layout(known, edges))
    return found.select("code", "object_id")


@query("SELECT 'SNIPPET_SOURCE_INVALID' AS code, x.id AS object_id FROM x_snippets x LEFT JOIN v_sources s ON s.id = x.source_id WHERE s.subtype IS DISTINCT FROM 'oss'")
def snippet_findings(spark, d):
    """VA9."""
    return validate.check_snippet_sources(fx.details(spark, d).select("id", "kind", "subtype", "path", "source_id").unionByName(_pieces(spark, d).select("id", "kind", "subtype", "path", "source_id"))).select("code", "object_id")


@query("""SELECT CASE WHEN i.id IS NULL THEN 'AI_INPUT_MISSING' ELSE 'AI_INPUT_SECTION_MISSING' END AS code, x.id AS object_id FROM x_artifacts x LEFT JOIN v_objects i ON i.id = input_id
        WHERE i.id IS NULL OR input_section IS NOT NULL AND (i.kind <> 'note' OR input_section = 'sec_9')
    UNION ALL SELECT CASE WHEN a.id IS NULL THEN 'AI_ARTIFACT_MISSING' ELSE 'AI_ARTIFACT_UNPROMOTED' END, g.object_id FROM v_segments g LEFT JOIN x_artifacts a ON a.id = concat('ai_', CAST(g.doc_no * 21 AS VARCHAR)) WHERE g.role = 'ai' AND (a.id IS NULL OR a.review_status <> 'promoted')""")
def artifact_findings(spark, d):
    """VA11, VA12: AI blocks name the artifact with 21 times the number of their note."""
    objects = fx.details(spark, d).select("id", "kind", "path").unionByName(_pieces(spark, d).select("id", "kind", "path", "review_status", "input_refs"), allowMissingColumns=True)
    named = F.transform("sections", lambda s: s.withField("blocks", F.transform(s["blocks"], lambda b: b.withField("artifact_id", F.when(b["kind"] == "ai", F.concat(F.lit("ai_"), (F.substring("object_id", 6, 20).cast("long") * 21).cast("string")))))))
    bodies = _bodies(spark, d).withColumn("sections", named)
    return validate.check_artifacts(bodies, objects, fx.view(spark, d, "v_segments").select("object_id", "section_id")).select("code", "object_id")


@query(f", {_ALL} SELECT code, from_id AS object_id, coalesce(section_id, '') AS section_id FROM (SELECT * FROM c WHERE code <> 'RELATION_SOURCE_MISSING' UNION ALL SELECT DISTINCT * FROM c WHERE code = 'RELATION_SOURCE_MISSING') x ORDER BY concat('relations/', from_id, '.yaml'), code, from_id, coalesce(section_id, '') LIMIT 50 OFFSET 50")
def findings_page(spark, d):
    """SO5, SO3: the second page of all findings in order."""
    edges = _edges(spark, d).withColumn("path", F.concat(F.lit("relations/"), F.col("from_id"), F.lit(".yaml")))
    found = validate.check_relations(edges, _ends(spark, d), fx.view(spark, d, "v_segments").select("object_id", "section_id"))
    return catalog.paginate(found, catalog.finding_order(), 2)[0].select("code", "object_id", F.coalesce("section_id", F.lit("")).alias("section_id"))


@query(r"""SELECT event_id AS n, CASE user_id % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'note' WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'snippet' END ELSE NULL END AS kind, user_id % 3 = 0 AS section FROM events""")
def id_kinds(spark, d):
    """TX16: ids of every prefix, with a bad letter, too short; section ids with capitals."""
    tail = F.lpad(F.col("event_id").cast("string"), 26, "0")
    ids = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("src_"), tail)).when(F.col("user_id") % 4 == 1, F.concat(F.lit("note_"), tail)).when(F.col("user_id") % 4 == 2, F.concat(F.lit("snip_"), F.when(F.col("event_id") % 2 == 0, tail).otherwise(F.concat(F.lit("I"), F.substring(tail, 2, 25))))).otherwise(F.concat(F.lit("ai_"), F.substring(tail, 2, 25)))
    section = F.concat(F.when(F.col("user_id") % 3 == 0, "sec_a-").when(F.col("user_id") % 3 == 1, "sec_A").otherwise("sec__"), F.col("event_id"))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("n"), tx.object_kind(ids).alias("kind"), tx.is_section_id(section).alias("section"))


@query(r"""SELECT p_partkey AS n, CASE p_partkey % 5 WHEN 0 THEN concat('2401.', lpad(CAST(p_partkey AS VARCHAR), 5, '0')) WHEN 1 THEN concat('2402.', lpad(CAST(p_partkey AS VARCHAR), 5, '0')) END AS arxiv_id, CASE WHEN p_partkey % 2 = 0 THEN concat('Ada ', p_brand, ';', p_brand) ELSE '' END AS author_names,
    CASE WHEN p_partkey % 3 = 0 THEN 1900 + p_partkey % 100 END AS year, p_partkey % 4 = 0 AS safe FROM part""")
def item_fields(spark, d):
    """TX18, TX19."""
    k, brand = F.col("p_partkey"), F.col("p_brand")
    digits = F.lpad(k.cast("string"), 5, "0")
    person = lambda first, last, whole, kind: F.struct(F.lit(kind).alias("creatorType"), first.cast("string").alias("firstName"), last.cast("string").alias("lastName"), whole.cast("string").alias("name"))
    none = F.lit(None)
    people = F.when(k % 2 == 0, F.array(person(F.lit("Ada"), brand, none, "author"), person(none, none, brand, "author"), person(F.lit("Ed"), brand, none, "editor"))).otherwise(F.array(person(F.lit("Ed"), brand, none, "editor")))
    items = spark.read.parquet(f"{d}/part.parquet").select(
        k.alias("n"), F.when(k % 5 == 0, F.concat(F.lit("note\nArXiv ID: 2401."), digits, F.lit("v3\nmore"))).otherwise("none").alias("extra"), F.when(k % 5 == 1, F.concat(F.lit("https://arxiv.org/abs/2402."), digits)).otherwise(F.lit("https://x.org/")).alias("url"), people.alias("creators"),
        F.when(k % 3 == 0, F.concat(F.lit("May "), (1900 + k % 100).cast("string"), F.lit(", 12345"))).when(k % 3 == 1, "n.d. 12345").alias("date"), F.when(k % 4 == 0, "https://x.org:8080/p").when(k % 4 == 1, "https://u:p@x.org/").when(k % 4 == 2, "ftp://x.org/").otherwise("http://x.org:99999/").alias("link"),
    )
    return idn.extract_metadata(items).select("n", "arxiv_id", F.array_join("author_names", ";").alias("author_names"), "year", idn.safe_external_url(F.col("link")).alias("safe"))


@query(r"""SELECT page_id AS n, CASE page_id % 6 WHEN 0 THEN concat('h', page_id, '.example.org') WHEN 1 THEN concat('xn--bcher-kva.h', page_id, '.example') END AS host, CASE page_id % 6 WHEN 0 THEN concat('https://h', page_id, '.example.org:8443/a/~b/%2Fc?q=%7e') WHEN 1 THEN concat('http://xn--bcher-kva.h', page_id, '.example/') WHEN 2 THEN concat('http://127.0.0.1/', page_id) WHEN 3 THEN 'http://localhost/x/' END AS url,
    CASE WHEN page_id % 6 = 5 THEN concat('team/p', page_id) END AS project, concat('sha256:', sha256(html)) AS checksum FROM pages""")
def hosts_and_urls(spark, d):
    """TX8-TX10, TX20 on hosts of every kind."""
    n = F.col("page_id").cast("string")
    pick = lambda *v: F.when(F.col("page_id") % 6 == 0, v[0]).when(F.col("page_id") % 6 == 1, v[1]).when(F.col("page_id") % 6 == 2, v[2]).when(F.col("page_id") % 6 == 3, v[3]).when(F.col("page_id") % 6 == 4, v[4]).otherwise(v[5])
    host = pick(F.concat(F.lit("H"), n, F.lit(".Example.ORG.")), F.concat(F.lit("Bücher.h"), n, F.lit(".example")), F.lit("127.0.0.1"), F.lit("localhost"), F.concat(F.lit("-a"), n, F.lit(".org")), F.concat(F.lit("a_b"), n, F.lit(".org")))
    url = pick(F.concat(F.lit("HTTPS://H"), n, F.lit(".Example.org.:8443/x/../a/./%7Eb//%2fc?q=%7e#f")), F.concat(F.lit("http://BÜCHER.h"), n, F.lit(".example:80")), F.concat(F.lit("http://127.0.0.1:/"), n), F.lit("http://localhost/x/"), F.concat(F.lit("http://me:pw@x.org/"), n), F.concat(F.lit("https:/x.org/"), n))
    project = pick(F.lit("https://github.com/a"), F.lit("https://github.com/a/b/c"), F.lit("https://gitlab.com/g/-/b"), F.lit("https://elsewhere.org/a/b"), F.lit("https://code.example.org/a/b?x"), F.concat(F.lit("https://code.example.org/team/p"), n, F.lit(".git/")))
    return spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("n"), normalize_repository_host(host).alias("host"), idn.canonicalize_url(url).alias("url"), idn.normalize_repository_url(project, ["code.example.org"])["path"].alias("project"), tx.checksum(F.encode("html", "utf-8")).alias("checksum"))


def _captures(spark, d):
    items = fx.view(spark, d, "x_items")
    kind = F.when(F.col("n") % 5 == 0, "paper").when(F.col("n") % 5 == 1, "book")
    of = lambda k, value, kind: items.select((F.col("n") * 10 + k).alias("request_id"), value.alias("input"), kind.cast("string").alias("type"))
    number = F.col("n").cast("string")
    asked = of(0, F.concat(F.lit("https://doi.org/10.1000/I"), number), F.lit(None)).unionByName(of(1, F.concat(F.lit("10.1000/i"), number), kind)).unionByName(of(2, F.concat(F.lit("2401."), F.lpad(number, 5, "0")), F.lit(None)))
    asked = asked.unionByName(of(3, F.concat(F.lit("https://site.example.org/"), number), F.lit("web"))).unionByName(of(4, F.concat(F.lit("https://github.com/team/p"), number), F.lit(None))).unionByName(of(5, F.lit("no identifier"), F.lit(None)))
    metadata = items.select("item_key", "item_type", F.col("item_key").alias("title"), "doi", "arxiv_id", _none().alias("isbn"), "url")
    child = lambda suffix, where, kind, mode: items.where(where).select(F.col("item_key").alias("parent_key"), F.concat("item_key", F.lit(suffix)).alias("item_key"), F.lit("attachment").alias("item_type"), F.lit("f").alias("filename"), F.lit(kind).alias("content_type"), F.lit(mode).alias("link_mode"))
    children = child("p", "n % 2 = 0", "application/pdf", "linked_file").unionByName(child("q", "n % 6 = 0", "application/pdf", "linked_file")).unionByName(child("h", "n % 4 < 3", "text/html", "imported_url"))
    have = items.where("n % 3 = 0").select(F.concat(F.lit("src_"), "n").alias("id"), F.when(F.col("n") % 6 == 0, "paper").otherwise("book").alias("subtype"), F.concat(F.lit("10.1000/I"), "n").alias("doi"), *(_none().alias(x) for x in ("arxiv_id", "isbn", "canonical_url", "repository_host", "repository_path", "commit")))
    repositories = items.where("n % 2 = 1").select(F.concat(F.lit("https://github.com/team/p"), "n").alias("url"), F.col("item_key").alias("title"), F.lit("c0").alias("commit"), F.lit("main").alias("default_branch"))
    return bulk.bulk_capture(asked, have, metadata, children, "2024-01-02T00:00:00Z", repositories=repositories)


_CAPTURED = """
    w AS (SELECT n, k, CASE k WHEN 0 THEN 'doi' WHEN 1 THEN 'doi' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'web' WHEN 4 THEN 'repo' END AS by_, CASE WHEN k = 1 AND n % 5 = 0 THEN 'paper' WHEN k = 1 AND n % 5 = 1 THEN 'book' END AS asked FROM x_items CROSS JOIN range(0, 6) t(k)),
    h AS (SELECT n AS hn, CASE WHEN n % 6 = 0 THEN 'paper' ELSE 'book' END AS htype FROM x_items WHERE n % 3 = 0),
    i AS (SELECT *, CASE WHEN item_type IN ('journalArticle', 'preprint', 'thesis') THEN 'paper' WHEN item_type = 'book' THEN 'book' WHEN item_type = 'webpage' THEN 'web' END AS sort FROM x_items),
    m AS (SELECT w.n, w.k, count(i.n) AS items, min(i.n) AS item FROM w LEFT JOIN i ON by_ = 'doi' AND i.doi = concat('10.1000/i', w.n) OR by_ = 'arxiv' AND i.arxiv_id = concat('2401.', lpad(CAST(w.n AS VARCHAR), 5, '0')) OR by_ = 'web' AND i.url = concat('https://site.example.org/', w.n) GROUP BY ALL),
    e AS (SELECT w.*, m.items, i.sort, i.doi AS idoi, i.arxiv_id AS iarxiv, h.htype, i.n AS item FROM w JOIN m USING (n, k) LEFT JOIN i ON i.n = m.item AND m.items = 1 LEFT JOIN h ON by_ = 'doi' AND hn = w.n),
    g AS (SELECT *, CASE WHEN k = 5 THEN 'ADD_INPUT_INVALID' WHEN htype IS NOT NULL THEN CASE WHEN asked <> htype THEN 'ADD_IDENTITY_CONFLICT' ELSE 'EXISTING' END WHEN by_ = 'repo' THEN CASE WHEN n % 2 = 0 THEN 'ADD_METADATA_UNAVAILABLE' END
        WHEN by_ = 'doi' AND asked IS NOT NULL THEN CASE WHEN sort IS DISTINCT FROM asked THEN 'ADD_METADATA_UNAVAILABLE' END WHEN by_ = 'doi' THEN CASE WHEN sort IS NULL OR sort = 'web' THEN 'ADD_TYPE_AMBIGUOUS' END
        WHEN by_ = 'arxiv' THEN CASE WHEN sort IS DISTINCT FROM 'paper' THEN 'ADD_METADATA_UNAVAILABLE' END ELSE CASE WHEN sort IS DISTINCT FROM 'web' OR item % 4 = 3 THEN 'ADD_METADATA_UNAVAILABLE' END END AS early FROM e),
    r AS (SELECT g.*, h2.htype AS later, CASE WHEN by_ = 'repo' THEN concat('repo:', n) WHEN by_ = 'web' THEN concat('url:', n) ELSE coalesce('doi:' || idoi, 'arxiv:' || iarxiv) END AS identity FROM g LEFT JOIN h h2 ON early IS NULL AND idoi = concat('10.1000/i', h2.hn)),
    s AS (SELECT *, coalesce(early, CASE WHEN later IS NOT NULL THEN CASE WHEN later <> sort THEN 'ADD_IDENTITY_CONFLICT' ELSE 'EXISTING' END ELSE 'CREATED' END) AS result FROM r),
    z AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY n * 10 + k) AS nth FROM s WHERE result = 'CREATED' UNION ALL SELECT *, 1 FROM s WHERE result <> 'CREATED')"""


@query(f""", {_CAPTURED} SELECT n * 10 + k AS request_id, CASE WHEN nth > 1 THEN 'EXISTING' ELSE result END AS result, CASE WHEN early = 'EXISTING' THEN htype WHEN result IN ('CREATED', 'EXISTING') THEN CASE WHEN by_ = 'repo' THEN 'oss' ELSE sort END END AS source_type,
    CASE WHEN early IS NULL AND sort = 'paper' AND result IN ('CREATED', 'EXISTING') THEN CASE WHEN item % 6 = 0 THEN 'PAPER_ATTACHMENT_AMBIGUOUS' WHEN item % 2 = 1 THEN 'PAPER_ATTACHMENT_UNAVAILABLE' END END AS warning FROM z""")
def captured(spark, d):
    """BK1, JO3, JO4, JO7, TX11, TX12: six requests an item, by every kind of identifier."""
    return _captures(spark, d)[0].select("request_id", "result", "source_type", "warning")


@query(f""", {_CAPTURED} SELECT CASE WHEN by_ = 'repo' THEN 'oss' ELSE sort END AS subtype, CASE WHEN sort IN ('paper', 'book') THEN idoi END AS doi, CASE WHEN sort = 'paper' THEN iarxiv END AS arxiv_id, CASE WHEN by_ = 'repo' THEN concat('https://github.com/team/p', n) WHEN by_ = 'web' THEN concat('https://site.example.org/', n) END AS canonical_url,
    CASE WHEN by_ = 'repo' THEN 'NOASSERTION' END AS license, CASE WHEN sort = 'paper' AND item % 2 = 0 AND item % 6 <> 0 THEN concat('k', item, 'p') END AS attachment_key FROM z WHERE result = 'CREATED' AND nth = 1""")
def captured_sources(spark, d):
    """BK1: the sources that are made."""
    return _captures(spark, d)[1].select("subtype", "doi", "arxiv_id", "canonical_url", "license", "attachment_key")


def _synced(spark, d):
    """Papers of the part table with a baseline or without, against metadata that differ in one way each."""
    n = F.col("p_partkey")
    rows = spark.read.parquet(f"{d}/part.parquet").select(n.alias("n"), F.col("p_name").alias("title"), F.concat(F.lit("10.1000/s"), n).alias("doi"))
    text = lambda v=None: F.lit(v).cast("string")
    base = {"title": F.col("title"), "authors": F.array(F.lit("A")), "year": F.lit(2020), "doi": F.col("doi"), "arxiv_id": text(), "arxiv_version": F.lit(None).cast("int"), "canonical_url": text(), "attachment_key": text("a"), "attachment_version": F.lit(1), "attachment_filename": text("f.pdf"), "attachment_media_type": text("application/pdf"), "attachment_size": F.lit(5).cast("long"), "attachment_sha256": text("sha256:0")}
    stored = rows.select("n", *(v.alias(k) for k, v in base.items()))
    hashed = idn.managed_fields_hash({f: F.col(f) for f in bulk.MANAGED})
    mode = F.col("n") % 10
    stored = stored.withColumn("managed_fields_hash", F.when(mode == 0, None).when(mode == 1, None).when(mode == 2, text("sha256:other")).otherwise(hashed))
    sources = stored.withColumns({"id": F.concat(F.lit("src_"), "n"), "kind": F.lit("source"), "subtype": F.when(F.col("n") % 23 == 0, "book").otherwise("paper"), "zotero_key": F.concat(F.lit("z"), "n"), "zotero_item_version": F.lit(3), "synced_at": F.when(mode != 9, "2024-01-01T00:00:00Z"), "updated": F.lit("2024-01-01")})
    doi = F.when(mode == 4, None).when(mode == 5, F.concat("doi", F.lit("x"))).otherwise(F.col("doi"))
    arxiv = F.when((mode == 4) & (F.col("n") % 20 == 4), "2401.00001")
    metadata = stored.select(F.concat(F.lit("z"), "n").alias("zotero_key"), F.when(mode == 6, 4).otherwise(3).alias("version"), F.when(mode.isin(1, 7), F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), "authors", "year", doi.alias("doi"), arxiv.cast("string").alias("arxiv_id"), text().alias("url")).where("zotero_key not like '%13'")
    attachments = stored.select(F.concat(F.lit("z"), "n").alias("item_key"), F.when(F.col("n") % 7 != 0, "a").alias("child_key"), F.when(F.col("n") % 7 == 0, "PAPER_ATTACHMENT_UNAVAILABLE").alias("code"), F.lit(1).alias("version"), F.lit("f.pdf").alias("filename"), F.lit(5).cast("long").alias("size"), F.when(mode == 8, "sha256:1").otherwise("sha256:0").alias("sha256"))
    return sources, metadata, attachments


@query("""SELECT id, decision, CASE WHEN decision IN ('NO_CHANGE', 'UPDATED') AND n % 7 = 0 THEN 'PAPER_ATTACHMENT_UNAVAILABLE' ELSE '' END AS warnings, CASE WHEN decision = 'UPDATED' AND m = 7 THEN concat(title, '!') ELSE title END AS title, CASE WHEN decision = 'UPDATED' THEN '2024-03-04' ELSE '2024-01-01' END AS updated FROM (
    SELECT *, CASE WHEN n % 23 = 0 THEN 'SOURCE_TYPE_UNSUPPORTED' WHEN m = 2 THEN 'SOURCE_SYNC_LOCAL_MODIFIED' WHEN CAST(n AS VARCHAR) LIKE '%13' THEN 'ZOTERO_ITEM_UNAVAILABLE' WHEN m = 4 AND n % 20 <> 4 THEN 'PAPER_CANONICAL_IDENTITY_MISSING' WHEN m IN (4, 5) THEN 'PAPER_IDENTITY_CONFLICT'
        WHEN m = 8 AND n % 7 <> 0 THEN 'PAPER_ATTACHMENT_CHANGED' WHEN m = 1 THEN 'SOURCE_SYNC_BASELINE_REQUIRED' WHEN m IN (3, 8) THEN 'NO_CHANGE' ELSE 'UPDATED' END AS decision FROM (SELECT p_partkey AS n, p_partkey % 10 AS m, p_name AS title, concat('src_', p_partkey) AS id FROM part) x) y""")
def synced_sources(spark, d):
    """BK3, TX13: every decision, with the fields after it."""
    return bulk.sync_sources(*_synced(spark, d), "2024-03-04T00:00:00Z").select("id", "decision", F.array_join("warnings", ",").alias("warnings"), "title", "updated")


@query("""SELECT id, CASE WHEN n % 23 = 0 THEN 'SOURCE_TYPE_UNSUPPORTED' WHEN m > 1 THEN 'SOURCE_SYNC_ADOPTION_INVALID' WHEN CAST(n AS VARCHAR) LIKE '%13' THEN 'ZOTERO_ITEM_UNAVAILABLE' ELSE 'UPDATED' END AS decision FROM (SELECT p_partkey AS n, p_partkey % 10 AS m, concat('src_', p_partkey) AS id FROM part) x""")
def adopted_sources(spark, d):
    """BK3: adoption is for sources without a baseline."""
    return bulk.sync_sources(*_synced(spark, d), "2024-03-04T00:00:00Z", adopt=True).select("id", "decision")


#: Codes that each query's rows must show, so that no rule is compared on nothing.
EXPECTED = {
    "source_findings": {"SOURCE_IDENTITY_MISSING", "FIELD_INVALID"}, "transition_findings": {"NOTE_MATURITY_INVALID", "NOTE_TRANSITION_INVALID"}, "piece_findings": {"SNIPPET_RANGE_INVALID", "AI_ARTIFACT_INVALID", "AI_REVIEW_INVALID"},
    "locator_findings": {"LOCATOR_VERSION_UNSUPPORTED", "LOCATOR_INVALID", "SNAPSHOT_INVALID", "FIELD_INVALID", "FIELD_MISSING"}, "number_findings": {"LITERATURE_SUMMARY_MISSING", "SYNTHESIS_TARGETS_INSUFFICIENT"},
    "edge_findings": {f"RELATION_{x}" for x in ("SOURCE_MISSING", "TARGET_MISSING", "DIRECTION_INVALID", "TARGET_INVALID", "NOT_CANONICAL", "SECTION_MISSING", "LOCATOR_MISMATCH", "PRIVATE_DEPENDENCY", "DUPLICATE")},
    "layout_findings": {"RELATION_SHARD_DUPLICATE", "RELATION_SHARD_OWNER_MISMATCH", "OBJECT_LAYOUT_INVALID"}, "snippet_findings": {"SNIPPET_SOURCE_INVALID"}, "artifact_findings": {"AI_INPUT_MISSING", "AI_INPUT_SECTION_MISSING", "AI_ARTIFACT_MISSING", "AI_ARTIFACT_UNPROMOTED"},
    "captured": {"CREATED", "EXISTING", "ADD_INPUT_INVALID", "ADD_IDENTITY_CONFLICT", "ADD_METADATA_UNAVAILABLE", "ADD_TYPE_AMBIGUOUS"}, "adopted_sources": {"SOURCE_TYPE_UNSUPPORTED", "SOURCE_SYNC_ADOPTION_INVALID", "UPDATED"},
    "synced_sources": {"SOURCE_TYPE_UNSUPPORTED", "SOURCE_SYNC_LOCAL_MODIFIED", "ZOTERO_ITEM_UNAVAILABLE", "PAPER_CANONICAL_IDENTITY_MISSING", "PAPER_IDENTITY_CONFLICT", "PAPER_ATTACHMENT_CHANGED", "SOURCE_SYNC_BASELINE_REQUIRED", "NO_CHANGE", "UPDATED"},
    "relations_added": {"RELATION_ENDPOINT_MISSING", "RELATION_ALREADY_EXISTS", "RELATION_NOT_CANONICAL", "RELATION_SECTION_MISSING", "ADDED"}, "notes_created": {"NOTE_SOURCE_REQUIRED", "NOTE_SOURCE_INVALID", "CREATED"},
}
