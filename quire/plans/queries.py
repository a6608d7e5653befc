"""Registered queries of the knowledge-base operators, each over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import identity as idn
from quire.functions import text as tx
from quire.operators import bulk, catalog, joins, maintain, migrate, projection, search, validate
from quire.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL over the views that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = fx.oracle(sql)
        return f

    return add


#: DuckDB: tokens of each segment's title, text and tags, as the index has them on this data (casefold is lower and ß to ss; single Latin diacritics fold).
_TOKENS = r"""tokens AS (
    SELECT segment_id, object_id, unnest(regexp_extract_all(translate(nfc_normalize(replace(lower(concat(title, chr(10), text, chr(10), tag1, ' ', tag2)), 'ß', 'ss')), '{a}', '{b}'), '[\p{{L}}\p{{N}}]+')) AS term
    FROM v_segments s JOIN v_objects o ON o.id = s.object_id)"""
_PAIRS = [(chr(c), d[0]) for c in range(0xDF, 0x250) for d in [unicodedata.normalize("NFD", chr(c))] if len(d) == 2 and d[0].isascii() and d[0].isalpha()]
_FROM, _TO = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)
TOKENS = _TOKENS.format(a=_FROM, b=_TO)
STATS = TOKENS + """,
post AS (SELECT term, segment_id, count(*) AS tf FROM tokens GROUP BY ALL),
lens AS (SELECT segment_id, count(*) AS n FROM tokens GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
corpus AS (SELECT count(*) AS n_segments, sum(coalesce(n, 0)) / count(*) AS avg_tokens FROM v_segments LEFT JOIN lens USING (segment_id))"""
HITS = STATS + rf""",
q AS ({fx.QUERY_SQL}),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(translate(nfc_normalize(replace(lower(query), 'ß', 'ss')), '{_FROM}', '{_TO}'), '[\p{{L}}\p{{N}}]+')) AS term FROM q) GROUP BY ALL),
nt AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY ALL),
hits AS (
    SELECT query_id, segment_id, round(sum(-times * CASE WHEN ln((n_segments - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_segments - df + 0.5) / (df + 0.5)) END
           * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_tokens))), 9) AS score, count(*) AS found
    FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (segment_id) CROSS JOIN corpus GROUP BY ALL),
full_hits AS (SELECT h.query_id, h.segment_id, h.score, s.object_id, s.section_id, s.role, s.ordinal, s.text, o.visibility, o.record_status, o.subtype
    FROM hits h JOIN nt USING (query_id) JOIN v_segments s USING (segment_id) JOIN v_objects o ON o.id = s.object_id WHERE found = n_terms)"""
CODES = """,
cit AS (
    SELECT c.segment_id, c.ordinal, CASE WHEN s.id IS NULL THEN 'PUBLIC_CITATION_UNRESOLVED' WHEN s.visibility <> 'public' OR s.record_status <> 'active' THEN 'PUBLIC_CITATION_SOURCE_UNSAFE'
        WHEN s.subtype = 'web' AND s.snapshot IS NULL THEN 'PUBLIC_SNAPSHOT_REQUIRED' WHEN s.subtype = 'oss' AND s.license = 'NOASSERTION' THEN 'PUBLIC_RIGHTS_UNRESOLVED'
        WHEN c.locator_type <> s.subtype OR c.locator_type = 'web' THEN 'PUBLIC_PROVENANCE_INCOHERENT'
        WHEN c.locator_type = 'oss' THEN 'PUBLIC_PROVENANCE_INCOHERENT_' END AS code
    FROM v_citations c LEFT JOIN v_sources s ON s.id = c.source_id),
audit AS (SELECT segment_id, arg_min(code, ordinal) FILTER (WHERE code IS NOT NULL) AS code, count(*) AS n_citations FROM (SELECT segment_id, ordinal, nullif(code, 'PUBLIC_PROVENANCE_INCOHERENT_') AS code FROM cit) GROUP BY ALL)"""
PUBLIC = """CASE WHEN visibility <> 'public' THEN 'PUBLIC_VISIBILITY_REQUIRED' WHEN record_status <> 'active' THEN 'PUBLIC_ACTIVE_REQUIRED' WHEN role = 'ai' THEN 'PUBLIC_AI_EXCLUDED'
    WHEN role = 'fact' AND n_citations IS NULL THEN 'PUBLIC_FACT_CITATION_REQUIRED' ELSE audit.code END"""


@query(f"""{", "}{HITS} SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, object_id, section_id, role, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, object_id, section_id, ordinal) AS rank FROM full_hits WHERE record_status = 'active' AND role IN ('human', 'fact')) WHERE rank <= 20""")
def search_batch(spark, d):
    """SE1-SE3, SO6, FI1, FI2."""
    return search.search(fx.index(spark, d), fx.queries_of(spark, d)).select("query_id", "rank", "segment_id", "object_id", "section_id", "role", "score")


@query(f"""{", "}{HITS} SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, object_id, section_id, ordinal) AS rank FROM full_hits WHERE record_status = 'active' AND role IN ('human', 'fact')) WHERE rank <= 5""")
def search_bounded(spark, d):
    """SE2, SE3, SO6: the best five by bounds of blocks of postings."""
    return search.bounded_search(fx.score_index(spark, d), fx.queries_of(spark, d), limit=5).select("query_id", "rank", "segment_id", "score")


@query(f"""{", "}{HITS} SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, object_id, section_id, ordinal) AS rank FROM full_hits JOIN v_objects o ON o.id = object_id
    WHERE full_hits.record_status = 'active' AND role IN ('human', 'fact') AND o.maturity = 'mature' AND (o.tag1 = 'en' OR o.tag2 = 'en') AND full_hits.visibility = 'public') WHERE rank <= 200""")
def search_filtered(spark, d):
    """FI1, FI3."""
    f = search.SearchFilters(visibility="public", maturity="mature", tags=["en"])
    return search.search(fx.index(spark, d), fx.queries_of(spark, d), f, limit=200).select("query_id", "rank", "segment_id", "score")


@query(f"""{", "}{HITS}{CODES} SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, object_id, section_id, ordinal) AS rank FROM (SELECT full_hits.*, {PUBLIC} AS public_code FROM full_hits LEFT JOIN audit USING (segment_id))
    WHERE public_code IS NULL AND role IN ('human', 'fact')) WHERE rank <= 20""")
def search_public(spark, d):
    """SE4: audit before the limit."""
    return search.search(fx.index(spark, d), fx.queries_of(spark, d), scope="public").select("query_id", "rank", "segment_id", "score")


CONTEXT = f"""{", "}{HITS}{CODES},
cand AS (SELECT query_id, segment_id, object_id, section_id, role, text, score, ordinal, visibility, record_status FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, record_status ORDER BY score, object_id, section_id, ordinal) AS r FROM full_hits WHERE role IN ('human', 'fact')) WHERE r <= 200),
ranked AS (SELECT cand.*, row_number() OVER (PARTITION BY query_id ORDER BY score, object_id, section_id, ordinal) AS rank, {PUBLIC} AS public_code FROM cand LEFT JOIN audit USING (segment_id)),
used AS (SELECT *, sum(CASE WHEN public_code IS NULL THEN length(text) ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM ranked),
taken AS (SELECT *, sum(CASE WHEN public_code IS NULL AND used <= 12000 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) - CASE WHEN public_code IS NULL AND used <= 12000 THEN 1 ELSE 0 END AS before FROM used),
coded AS (SELECT *, CASE WHEN before >= 20 THEN 'LIMIT_EXCEEDED' WHEN public_code IS NOT NULL THEN public_code WHEN used > 12000 THEN 'CHARACTER_BUDGET_EXCEEDED' END AS code FROM taken)"""


@query(f"{CONTEXT} SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, CASE role WHEN 'fact' THEN 'facts' ELSE 'human_notes' END AS grp, CAST(length(text) AS INTEGER) AS n_chars FROM coded WHERE code IS NULL")
def context_items(spark, d):
    """SE5, WI4, ST2."""
    items, _, _ = search.context(fx.index(spark, d), fx.queries_of(spark, d), "public")
    return items.select("query_id", "rank", "segment_id", F.col("group").alias("grp"), F.length("text").alias("n_chars"))


@query(f"{CONTEXT} SELECT query_id, CAST(rank AS INTEGER) AS rank, segment_id, code FROM coded WHERE code IS NOT NULL")
def context_exclusions(spark, d):
    return search.context(fx.index(spark, d), fx.queries_of(spark, d), "public")[1].select("query_id", "rank", "segment_id", "code")


@query(f"{CONTEXT} SELECT query_id, count(*) FILTER (WHERE code IS NULL) AS n_items, CAST(coalesce(sum(length(text)) FILTER (WHERE code IS NULL), 0) AS BIGINT) AS n_chars, count(*) FILTER (WHERE code IS NOT NULL) AS n_excluded, count(*) FILTER (WHERE code IN ('LIMIT_EXCEEDED', 'CHARACTER_BUDGET_EXCEEDED')) > 0 AS truncated FROM coded GROUP BY query_id")
def context_summary(spark, d):
    return search.context(fx.index(spark, d), fx.queries_of(spark, d), "public")[2]


@query(f"{', '}{STATS} SELECT term, df FROM dfs")
def term_statistics(spark, d):
    """TX1, PR8, PR9: the index built from the texts."""
    return fx.built_index(spark, d)["term_stats"]


@query(f"{', '}{STATS} SELECT segment_id, coalesce(n, 0) AS n_tokens FROM v_segments LEFT JOIN lens USING (segment_id)")
def segment_statistics(spark, d):
    return fx.index(spark, d)["segment_stats"]


@query("SELECT segment_id, concat('seg_', sha256(concat('segment-v1', chr(0), object_id, chr(0), section_id, chr(0), CAST(ordinal AS VARCHAR)))) AS stable_id FROM v_segments")
def segment_ids(spark, d):
    """TX3."""
    return fx.view(spark, d, "v_segments").select("segment_id", tx.segment_id(F.col("object_id"), F.col("section_id"), F.col("ordinal")).alias("stable_id"))


@query(rf"""{", "}q AS ({fx.QUERY_SQL}), qn AS (SELECT query_id, replace(lower(query), 'ß', 'ss') AS q FROM q),
    l AS (SELECT doc_id, generate_subscripts(ls, 1) AS line, unnest(ls) AS source FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    h AS (SELECT query_id, doc_id, line, source, strpos(lower(source), q) AS c1, q FROM l JOIN qn ON contains(replace(lower(source), 'ß', 'ss'), q))
    SELECT query_id, count(DISTINCT (doc_id, line)) AS n_lines FROM h GROUP BY query_id""")
def grep_lines(spark, d):
    """SE6: matching lines of each query (the helper's places are tested apart)."""
    files = spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("notes/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.lit("x").alias("object_id"), "text")
    rows = files.select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "source")).withColumn("normal", tx.normalized(F.col("source")))
    wanted = fx.queries_of(spark, d).select("query_id", tx.normalize_query(F.col("query")).alias("q"))
    return search.lines_with(rows, wanted).groupBy("query_id").agg(F.count_distinct("path", "n").alias("n_lines"))


_REST = "<!-- kb:section id=sec_rest role=human -->"


_GREP = rf"""{", "}q AS ({fx.QUERY_SQL}), qn AS (SELECT query_id, replace(lower(query), 'ß', 'ss') AS q FROM q),
    t AS (SELECT doc_id, substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) AS a, substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1, length(text)) AS b FROM documents),
    l AS (SELECT doc_id, marker, generate_subscripts(ls, 1) AS line, unnest(ls) AS source FROM (SELECT doc_id, len(string_split(a, chr(10))) + 1 AS marker, string_split(a || chr(10) || '{_REST}' || chr(10) || b, chr(10)) AS ls FROM t)),
    h AS (SELECT query_id, doc_id, marker, line, source, string_split(replace(lower(source), 'ß', 'ss'), q) AS parts, q FROM l JOIN qn ON contains(replace(lower(source), 'ß', 'ss'), q)),
    p AS (SELECT query_id, doc_id, marker, line, source, unnest(range(1, len(parts))) AS k, parts, q FROM h),
    c AS (SELECT query_id, concat('notes/', doc_id, '.md') AS path, CASE WHEN line > marker THEN 'sec_rest' END AS section_id, line, list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(q) AS before, source FROM p),
    m AS (SELECT *, list_max(list_filter(range(0, length(source) + 1), lambda i: length(replace(lower(substring(source, 1, i)), 'ß', 'ss')) <= before)) + 1 AS col FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, line, col) AS rank FROM m)
    SELECT query_id, path, section_id, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 200"""


def _halved(spark, d):
    """(path, object_id, text): every document with a section marker in its middle."""
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), half), F.lit(f"\n{_REST}\n"), F.substring("text", half + 1, F.length("text")))
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("notes/"), F.col("doc_id"), F.lit(".md")).alias("path"), F.concat(F.lit("note_"), F.col("doc_id")).alias("object_id"), text.alias("text"))


@query(_GREP)
def grep_hits(spark, d):
    """SE6, WI3: places, and the section that begins in the middle of each text."""
    return search.grep(_halved(spark, d), fx.queries_of(spark, d), 200).select("query_id", "path", "section_id", "line", F.col("column").alias("col"), "rank")


@query(_GREP)
def grep_trigrams(spark, d):
    """SE6 from a stored trigram index."""
    return search.grep_indexed(fx.grep_index(spark, d, _halved(spark, d)), fx.queries_of(spark, d), 200).select("query_id", "path", "section_id", "line", F.col("column").alias("col"), "rank")


@query(f"{CODES.replace(',', ', ', 1)} SELECT segment_id, code, n_citations FROM audit")
def citation_audit(spark, d):
    """JO6."""
    return search.audit_citations(fx.view(spark, d, "v_segments"), fx.located(fx.view(spark, d, "v_citations")), fx.details(spark, d))


@query("""SELECT s.segment_id, array_to_string(list_sort([o.tag1, o.tag2]), ',') AS tag_list, coalesce(string_agg(c.source_id, ',' ORDER BY c.ordinal), '') AS source_ids
    FROM v_segments s JOIN v_objects o ON o.id = s.object_id LEFT JOIN v_citations c USING (segment_id) GROUP BY ALL""")
def enriched_segments(spark, d):
    """JO5."""
    tags = fx.details(spark, d).select(F.col("id").alias("object_id"), F.explode("tags").alias("tag"))
    out = search.enrich_hits(fx.view(spark, d, "v_segments").select("segment_id", "object_id"), tags, fx.located(fx.view(spark, d, "v_citations")))
    return out.select("segment_id", F.array_join("tag_list", ",").alias("tag_list"), F.array_join("citation_list.source_id", ",").alias("source_ids"))


@query("SELECT id, subtype, workflow_stage, updated FROM v_sources WHERE record_status = 'active' AND visibility = 'public' ORDER BY updated DESC, id LIMIT 50 OFFSET 50")
def catalog_page(spark, d):
    """FI4, SO1, SO3: the second page."""
    rows = catalog.catalog_sources(fx.details(spark, d), record_status="active", visibility="public")
    return catalog.paginate(rows, [F.desc("updated"), "id"], 2)[0].select("id", "subtype", "workflow_stage", "updated")


@query("SELECT id, maturity, updated FROM v_notes WHERE maturity = 'mature' AND visibility = 'public' AND (tag1 = 'en' OR tag2 = 'en')")
def catalog_notes(spark, d):
    """FI5, FI3."""
    return catalog.catalog_notes(fx.details(spark, d), maturity="mature", visibility="public", tags=["en"]).select("id", "maturity", "updated")


@query("SELECT id, subtype, created FROM v_sources WHERE workflow_stage = 'inbox'")
def source_inbox(spark, d):
    """FI6, SO2."""
    return catalog.list_sources(fx.view(spark, d, "v_sources"), inbox=True).select("id", "subtype", "created")


@query("SELECT id, updated FROM v_notes ORDER BY updated DESC, id LIMIT 5")
def recent_notes(spark, d):
    """SO4."""
    return catalog.recent(fx.details(spark, d), "note").select("id", "updated")


@query("SELECT kind, coalesce(n, 0) AS n FROM (VALUES ('source'), ('note'), ('snippet'), ('ai_artifact')) k(kind) LEFT JOIN (SELECT kind, count(*) AS n FROM v_objects GROUP BY kind) USING (kind)")
def object_counts(spark, d):
    """AG1."""
    return catalog.object_counts(fx.details(spark, d))


def _values(name, values):
    return ", ".join(f"('{name}', '{v}')" for v in values)


RELATION_FINDINGS = """
    e AS (SELECT r.*, f.kind AS fk, f.subtype AS fs, f.visibility AS fv, t.kind AS tk, t.subtype AS ts, t.visibility AS tv FROM v_relations r LEFT JOIN v_objects f ON f.id = r.from_id LEFT JOIN v_objects t ON t.id = r.to_id),
    k AS (SELECT * FROM e WHERE fk IS NOT NULL AND tk IS NOT NULL),
    rf AS (
        SELECT DISTINCT 'RELATION_SOURCE_MISSING' AS code, from_id FROM e WHERE fk IS NULL
        UNION ALL SELECT 'RELATION_TARGET_MISSING', from_id FROM e WHERE fk IS NOT NULL AND tk IS NULL
        UNION ALL SELECT 'RELATION_KIND_INVALID', from_id FROM k WHERE NOT CASE relation_type WHEN 'cites' THEN fk = 'note' AND tk = 'source' WHEN 'summarizes' THEN fk = 'note' AND tk = 'source' WHEN 'synthesizes' THEN fk = 'note'
            WHEN 'supports' THEN tk = 'note' WHEN 'contradicts' THEN tk = 'note' WHEN 'related_to' THEN fk = 'note' AND tk = 'note' WHEN 'supersedes' THEN fk = tk END
        UNION ALL SELECT 'RELATION_DIRECTION_INVALID', from_id FROM k WHERE (relation_type = 'summarizes' AND fs <> 'literature') OR (relation_type = 'synthesizes' AND fs <> 'synthesis')
        UNION ALL SELECT 'RELATION_NOT_CANONICAL', from_id FROM k WHERE relation_type = 'related_to' AND from_id >= to_id
        UNION ALL SELECT 'RELATION_PRIVATE_DEPENDENCY', from_id FROM k WHERE relation_type IN ('cites', 'summarizes', 'synthesizes', 'supports', 'contradicts') AND fv = 'public' AND tv = 'private'),
    c AS (SELECT from_id, relation_type, count(DISTINCT to_id) AS n FROM v_relations GROUP BY ALL),
    cf AS (
        SELECT 'LITERATURE_SUMMARY_MISSING' AS code, id AS from_id FROM v_notes LEFT JOIN c ON from_id = id AND relation_type = 'summarizes' WHERE subtype = 'literature' AND coalesce(n, 0) < 1
        UNION ALL SELECT 'SYNTHESIS_TARGETS_INSUFFICIENT', id FROM v_notes LEFT JOIN c ON from_id = id AND relation_type = 'synthesizes' WHERE subtype = 'synthesis' AND (maturity IN ('mature', 'evergreen') OR visibility = 'public') AND coalesce(n, 0) < 2)"""


def _edges(spark, d):
    none = F.lit(None).cast("string")
    locator = F.lit(None).cast(schemas.LOCATOR)
    return fx.view(spark, d, "v_relations").withColumns({"path": F.concat(F.lit("relations/"), F.col("from_id"), F.lit(".yaml")), "to_section_id": none, "locator": locator})


def _sections(spark, d):
    return fx.view(spark, d, "v_segments").select("object_id", "section_id")


@query(f", {RELATION_FINDINGS} SELECT code, from_id AS object_id, 'relation' AS category FROM rf")
def relation_findings(spark, d):
    """VA13-VA20."""
    return validate.check_relations(_edges(spark, d), fx.details(spark, d), _sections(spark, d)).select("code", "object_id", "category")


@query(f", {RELATION_FINDINGS} SELECT code, from_id AS object_id FROM cf")
def cardinality_findings(spark, d):
    """VA21."""
    return validate.check_cardinality(_edges(spark, d), fx.details(spark, d)).select("code", "object_id")


@query(f", {RELATION_FINDINGS} SELECT code, 'relation' AS category, 'error' AS severity, count(*) AS n FROM (SELECT * FROM rf UNION ALL SELECT * FROM cf) GROUP BY code")
def finding_counts(spark, d):
    """AG6, ST3, TX17."""
    edges, objects = _edges(spark, d), fx.details(spark, d)
    return catalog.finding_counts(catalog.all_findings(validate.check_relations(edges, objects, _sections(spark, d)), validate.check_cardinality(edges, objects)))


@query(f""", {RELATION_FINDINGS}, every(dimension, value) AS (VALUES {", ".join(_values(n, v) for n, v in (("visibility", schemas.VISIBILITIES), ("source_type", schemas.SOURCE_TYPES), ("note_type", schemas.NOTE_TYPES), ("workflow_stage", schemas.STAGES), ("review_status", schemas.REVIEWS), ("severity", schemas.SEVERITIES)))}),
    seen AS (SELECT 'visibility' AS dimension, visibility AS value, count(*) AS n FROM v_objects GROUP BY ALL UNION ALL SELECT 'source_type', subtype, count(*) FROM v_sources GROUP BY ALL UNION ALL SELECT 'note_type', subtype, count(*) FROM v_notes GROUP BY ALL
             UNION ALL SELECT 'workflow_stage', workflow_stage, count(*) FROM v_sources GROUP BY ALL UNION ALL SELECT 'severity', 'error', count(*) FROM cf)
    SELECT dimension, value, coalesce(n, 0) AS n FROM every LEFT JOIN seen USING (dimension, value)""")
def dashboard(spark, d):
    """AG2."""
    objects = fx.details(spark, d).withColumn("review_status", F.lit(None).cast("string"))
    return catalog.dashboard_counts(objects, validate.check_cardinality(_edges(spark, d), objects))


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM v_scan_new a FULL JOIN v_scan_old b ON a.path = b.path WHERE a.checksum IS DISTINCT FROM b.checksum""")
def snapshot_diff(spark, d):
    """ST1."""
    return catalog.changed_paths(fx.view(spark, d, "v_scan_new"), fx.view(spark, d, "v_scan_old"))


@query("SELECT concat('sha256:', sha256(string_agg(concat(path, chr(0), checksum, chr(0)), '' ORDER BY path))) AS snapshot_hash FROM v_scan_new")
def snapshot_hash(spark, d):
    """AG3."""
    state = fx.view(spark, d, "v_scan_new")
    return state.limit(1).select(F.lit(catalog.snapshot_hash(state)).alias("snapshot_hash"))


@query("""SELECT r.request_id, r.source_id, s.workflow_stage AS was, r.target, CASE WHEN s.id IS NULL THEN 'SOURCE_NOT_FOUND'
    WHEN list_position(['inbox', 'reading', 'processed', 'integrated'], r.target) - list_position(['inbox', 'reading', 'processed', 'integrated'], s.workflow_stage) = 0 THEN 'NO_CHANGE'
    WHEN list_position(['inbox', 'reading', 'processed', 'integrated'], r.target) - list_position(['inbox', 'reading', 'processed', 'integrated'], s.workflow_stage) = 1 THEN 'CHANGED' ELSE 'SOURCE_WORKFLOW_INVALID' END AS result
    FROM v_workflow_requests r LEFT JOIN v_sources s ON s.id = r.source_id""")
def workflow_advance(spark, d):
    """BK2."""
    return bulk.advance_workflow(fx.view(spark, d, "v_workflow_requests"), fx.view(spark, d, "v_sources")).select("request_id", "source_id", "was", "target", "result")


@query("""SELECT id, 'incoming' AS direction, from_id, to_id, relation_type FROM v_relations JOIN v_sources ON id = to_id
    UNION ALL SELECT id, 'outgoing', from_id, to_id, relation_type FROM v_relations JOIN v_sources ON id = from_id""")
def source_relations(spark, d):
    """JO2."""
    return joins.list_relations(_edges(spark, d), fx.view(spark, d, "v_sources").select("id")).select("id", "direction", "from_id", "to_id", "relation_type")


@query("""SELECT o.id, md5(coalesce(b.body, '')) AS body_hash, coalesce(b.n, 0) AS n_blocks FROM v_objects o LEFT JOIN (
        SELECT object_id, count(*) AS n, string_agg(concat(ordinal, ' ', section_id, ' ', role, ' ', md5(coalesce(text, '')), ' ', coalesce(cited, '')), '|' ORDER BY ordinal, section_id) AS body
        FROM v_segments LEFT JOIN (SELECT segment_id, string_agg(concat(ordinal, '=', source_id, '=', locator_type), ',' ORDER BY ordinal) AS cited FROM v_citations GROUP BY ALL) USING (segment_id) GROUP BY object_id) b ON b.object_id = o.id""")
def object_details(spark, d):
    """JO1: the contents of every object's body, texts and citations included."""
    segments = fx.view(spark, d, "v_segments")
    tables = {"objects": fx.details(spark, d), "segments": segments, "citations": fx.located(fx.view(spark, d, "v_citations")), "sections": segments.select("object_id", "section_id", "ordinal", F.lit("").alias("heading"))}
    found, _ = joins.get_objects(tables, tables["objects"].select("id"))
    cited = lambda c: F.concat_ws("=", c["ordinal"], c["source_id"], F.get_json_object(c["locator"], "$.source_type"))
    block = lambda b: F.concat_ws(" ", b["place"], b["section_id"], b["role"], F.md5(F.coalesce(b["text"], F.lit(""))), F.coalesce(F.array_join(F.transform(b["citations"], cited), ","), F.lit("")))
    body = F.array_join(F.transform("body", block), "|")
    return found.select("id", F.md5(F.coalesce(body, F.lit(""))).alias("body_hash"), F.greatest(F.coalesce(F.size("body"), F.lit(0)), F.lit(0)).cast("long").alias("n_blocks"))


@query("""SELECT id, 'incoming' AS direction, from_id, to_id, relation_type, n <= 20 AS whole FROM v_relations JOIN (SELECT to_id AS id, count(*) AS n FROM v_relations GROUP BY ALL) ON id = to_id WHERE id IN (SELECT id FROM v_objects)
    UNION ALL SELECT id, 'outgoing', from_id, to_id, relation_type, n <= 20 FROM v_relations JOIN (SELECT from_id AS id, count(*) AS n FROM v_relations GROUP BY ALL) ON id = from_id WHERE id IN (SELECT id FROM v_objects)""")
def object_edges(spark, d):
    """JO1, JO2: the edges of every object, taken from parts of at most 20; an object with no more has a single part."""
    parts = joins.edge_parts(_edges(spark, d).withColumn("locator", F.lit("")), fx.view(spark, d, "v_objects").select("id"), 20)
    whole = parts.groupBy("id", "direction").agg((F.count("*") == 1).alias("whole"))
    return parts.join(whole, ["id", "direction"]).select("id", "direction", F.explode("edges").alias("e"), "whole").select("id", "direction", "e.from_id", "e.to_id", "e.relation_type", "whole")


@query("""SELECT request_id, lower(regexp_extract(doi, 'doi:(.*)', 1)) AS doi, regexp_extract(arxiv, 'arXiv:(.*)v2', 1) AS arxiv, 2 AS arxiv_version,
    CASE WHEN list_sum(list_transform(range(1, 14), lambda i: CAST(isbn[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 THEN isbn END AS isbn FROM v_identifiers""")
def identifiers(spark, d):
    """TX4-TX6."""
    v = fx.view(spark, d, "v_identifiers")
    a = idn.normalize_arxiv(F.col("arxiv"))
    return v.select("request_id", idn.normalize_doi(F.col("doi")).alias("doi"), a["base"].alias("arxiv"), a["version"].alias("arxiv_version"), F.when(F.length("isbn") == 13, idn.normalize_isbn(F.col("isbn"))).alias("isbn"))


@query("""SELECT request_id, concat('https://example.org/', regexp_extract(web, '([0-9]+)#', 1)) AS web, concat('https://github.com/', regexp_extract(repo, '(acme/p[0-9]+)', 1)) AS repo, regexp_extract(repo, '(acme/p[0-9]+)', 1) AS repo_path FROM v_identifiers""")
def urls(spark, d):
    """TX8, TX9."""
    r = idn.normalize_repository_url(F.col("repo"))
    return fx.view(spark, d, "v_identifiers").select("request_id", idn.canonicalize_url(F.col("web")).alias("web"), r["canonical_url"].alias("repo"), r["path"].alias("repo_path"))


@query("""SELECT request_id * 10 + k AS request_id, CASE k WHEN 3 THEN 'oss' WHEN 4 THEN 'web' WHEN 2 THEN CASE WHEN list_sum(list_transform(range(1, 14), lambda i: CAST(isbn[i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0 THEN 'book' END ELSE 'paper' END AS type FROM v_identifiers CROSS JOIN range(0, 5) t(k)""")
def recognized_inputs(spark, d):
    """TX11."""
    rows = fx.view(spark, d, "v_identifiers").select("request_id", F.posexplode(F.array("doi", "arxiv", "isbn", "repo", "web")).alias("k", "input"))
    return rows.select((F.col("request_id") * 10 + F.col("k")).alias("request_id"), idn.recognize_input(F.col("input"), F.lit(None).cast("string"))["type"].alias("type"))


@query("""SELECT request_id, from_id, to_id, relation_type, CASE WHEN fk IS NULL OR tk IS NULL THEN 'RELATION_ENDPOINT_MISSING' WHEN there THEN 'RELATION_ALREADY_EXISTS' WHEN tk <> 'note' OR fk <> 'note' THEN 'RELATION_KIND_INVALID'
    WHEN from_id = to_id THEN 'RELATION_NOT_CANONICAL' WHEN section = 'sec_9' THEN 'RELATION_SECTION_MISSING' WHEN nth > 1 THEN 'RELATION_ALREADY_EXISTS' ELSE 'ADDED' END AS result FROM (
    SELECT a.*, f.kind AS fk, t.kind AS tk, section = '' AND r.from_id IS NOT NULL AS there, row_number() OVER (PARTITION BY a.from_id, a.to_id, section ORDER BY request_id) AS nth FROM (
        SELECT o_orderkey AS request_id, least(x, y) AS from_id, greatest(x, y) AS to_id, 'related_to' AS relation_type, CASE o_orderkey % 7 WHEN 0 THEN 'sec_1' WHEN 1 THEN 'sec_9' ELSE '' END AS section FROM (
            SELECT o_orderkey, concat('note_', CAST(o_custkey % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR)) AS x, concat('note_', CAST(o_orderkey % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR)) AS y FROM orders)) a
    LEFT JOIN v_objects f ON f.id = a.from_id LEFT JOIN v_objects t ON t.id = a.to_id LEFT JOIN v_relations r ON r.from_id = a.from_id AND r.to_id = a.to_id AND r.relation_type = 'related_to')""")
def relations_added(spark, d):
    """BK5: edges to add, some with sections that exist or don't."""
    edges, objects = _edges(spark, d), fx.details(spark, d)
    top = spark.read.parquet(f"{d}/documents.parquet").agg((F.max("doc_id") + 20).alias("m"))
    note = lambda c: F.concat(F.lit("note_"), (F.col(c) % F.col("m")).cast("string"))
    section = F.when(F.col("o_orderkey") % 7 == 0, "sec_1").when(F.col("o_orderkey") % 7 == 1, "sec_9")
    asked = spark.read.parquet(f"{d}/orders.parquet").crossJoin(F.broadcast(top)).select(F.col("o_orderkey").alias("request_id"), note("o_custkey").alias("from_id"), note("o_orderkey").alias("to_id"), F.lit("related_to").alias("relation_type"), section.alias("to_section_id"))
    return bulk.add_relations(edges.drop("locator"), asked, objects, fx.view(spark, d, "v_segments").select("object_id", "section_id"))


@query("""SELECT 'relations.from_id' AS table_name, from_id AS key_value FROM (SELECT DISTINCT from_id FROM v_relations) WHERE from_id NOT IN (SELECT id FROM v_objects)
    UNION ALL SELECT 'relations.to_id', to_id FROM (SELECT DISTINCT to_id FROM v_relations) WHERE to_id NOT IN (SELECT id FROM v_objects)""")
def foreign_keys(spark, d):
    """MX4."""
    t = fx.index(spark, d)
    tables = {"objects": t["details"], "segments": t["segments"], "sections": t["segments"], "object_tags": t["details"].select(F.col("id").alias("object_id")), "type_transitions": t["segments"], "citations": t["citations"], "relations": _edges(spark, d), "postings": t["postings"]}
    return maintain.check_foreign_keys(tables)


@query("SELECT 'citations' AS table_name, count(*) AS n FROM v_citations UNION ALL SELECT 'objects', count(*) FROM v_objects UNION ALL SELECT 'relations', count(*) FROM v_relations UNION ALL SELECT 'segments', count(*) FROM v_segments")
def projection_counts(spark, d):
    """AG4, IO6."""
    from quire.sources.vault import projection_counts as counts

    return counts({n: fx.view(spark, d, f"v_{n}") for n in ("citations", "objects", "relations", "segments")})


#: Requests from the orders: a note, another note and a source each, some of them unknown.
_REQUESTS = """
    asked AS (SELECT o_orderkey AS request_id, concat('note_', CAST(o_custkey % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR)) AS note_id,
        concat('note_', CAST(o_orderkey % (SELECT max(doc_id) + 20 FROM documents) AS VARCHAR)) AS other_id, concat('src_', CAST(o_custkey % (SELECT max(page_id) + 10 FROM pages) AS VARCHAR)) AS source_id FROM orders)"""


def _requests(spark, d):
    tops = [spark.read.parquet(f"{d}/{t}.parquet").agg((F.max(c) + more).alias(name)) for t, c, more, name in (("documents", "doc_id", 20, "m"), ("pages", "page_id", 10, "p"))]
    rows = spark.read.parquet(f"{d}/orders.parquet").crossJoin(F.broadcast(tops[0])).crossJoin(F.broadcast(tops[1]))
    name = lambda prefix, c, top: F.concat(F.lit(prefix), (F.col(c) % F.col(top)).cast("string"))
    return rows.select(F.col("o_orderkey").alias("request_id"), name("note_", "o_custkey", "m").alias("note_id"), name("note_", "o_orderkey", "m").alias("other_id"), name("src_", "o_custkey", "p").alias("source_id"))


@query(f""", {_REQUESTS} SELECT request_id, note_id AS id, CASE WHEN n.id IS NULL THEN 'NOTE_NOT_FOUND' WHEN subtype = 'idea' THEN 'CHANGED' ELSE 'NOTE_TRANSITION_INVALID' END AS result,
    CASE WHEN subtype = 'idea' THEN 'concept' ELSE subtype END AS subtype, maturity, CASE WHEN subtype = 'idea' THEN 1 ELSE 0 END AS n_steps FROM asked LEFT JOIN v_notes n ON n.id = note_id""")
def notes_evolved(spark, d):
    """BK4."""
    notes = fx.details(spark, d).withColumns({"type_history": F.lit(None).cast(schemas.HISTORY), "updated": F.col("updated").cast("string")})
    rows = bulk.evolve_notes(_requests(spark, d).select("request_id", F.col("note_id").alias("id"), F.lit("me").alias("actor_id")), notes, "2024-01-02T00:00:00Z")
    return rows.select("request_id", "id", "result", "subtype", "maturity", F.coalesce(F.size("type_history"), F.lit(0)).alias("n_steps"))


_KINDS_ASKED = """wanted AS (SELECT request_id, CASE WHEN request_id % 5 > 0 THEN source_id END AS source_id, CASE request_id % 5 WHEN 0 THEN CASE WHEN request_id % 10 = 0 THEN 'idea' END WHEN 1 THEN CASE WHEN request_id % 3 = 0 THEN 'concept' ELSE 'literature' END END AS note_type FROM asked)"""


@query(f""", {_REQUESTS}, {_KINDS_ASKED} SELECT request_id, CASE WHEN coalesce(note_type, 'literature') = 'literature' THEN CASE WHEN source_id IS NULL THEN 'NOTE_SOURCE_REQUIRED' WHEN s.id IS NULL THEN 'NOTE_SOURCE_INVALID' ELSE 'CREATED' END
        WHEN source_id IS NOT NULL THEN 'NOTE_SOURCE_INVALID' ELSE 'CREATED' END AS result, CASE WHEN coalesce(note_type, 'literature') = 'literature' AND s.id IS NOT NULL THEN source_id END AS to_id,
        CASE WHEN coalesce(note_type, 'literature') = 'literature' AND s.id IS NOT NULL THEN 'human' END AS actor_type, CASE WHEN coalesce(note_type, 'literature') = 'literature' AND s.id IS NOT NULL THEN 'Untitled literature' WHEN note_type = 'idea' THEN 'Untitled idea' END AS title,
        CASE WHEN coalesce(note_type, 'literature') = 'literature' AND s.id IS NOT NULL OR note_type = 'idea' THEN 'human' END AS role
    FROM wanted LEFT JOIN v_sources s ON s.id = source_id""")
def notes_created(spark, d):
    """BK6: what becomes of each request: the note's title, its section, and its edge with the actor."""
    r = F.col("request_id")
    kind = F.when(r % 5 == 0, F.when(r % 10 == 0, "idea")).when(r % 5 == 1, F.when(r % 3 == 0, "concept").otherwise("literature"))
    asked = _requests(spark, d).select("request_id", F.when(r % 5 > 0, F.col("source_id")).alias("source_id"), F.lit(None).cast("string").alias("title"), kind.alias("note_type"))
    results, notes, bodies, edges = bulk.create_notes(asked, fx.details(spark, d), "2024-01-02T00:00:00Z")
    own = asked.select("request_id", bulk.new_id("note", F.col("request_id").cast("string"), F.coalesce("source_id", F.lit(""))).alias("id"))
    made = notes.select("id", "title").join(bodies.select(F.col("object_id").alias("id"), F.col("sections")[0]["role"].alias("role")), "id").join(edges.select(F.col("from_id").alias("id"), "to_id", F.col("actor.type").alias("actor_type")), "id", "left")
    return results.join(own, "request_id").join(made, "id", "left").select("request_id", "result", "to_id", "actor_type", "title", "role")


_RELATED = _REQUESTS + ", wish AS (SELECT request_id, least(note_id, other_id) AS from_id, greatest(note_id, other_id) AS to_id FROM asked)"


def _unrelate(spark, d):
    asked = _requests(spark, d).select("request_id", F.col("note_id").alias("from_id"), F.col("other_id").alias("to_id"), F.lit("related_to").alias("relation_type"), F.lit(None).cast("string").alias("to_section_id"))
    return bulk.remove_relations(_edges(spark, d).drop("locator"), asked)


@query(f""", {_RELATED} SELECT request_id, CASE WHEN r.from_id IS NULL THEN 'RELATION_NOT_FOUND' ELSE 'REMOVED' END AS result FROM wish w LEFT JOIN v_relations r ON r.from_id = w.from_id AND r.to_id = w.to_id AND relation_type = 'related_to'""")
def relations_removed(spark, d):
    """BK5."""
    return _unrelate(spark, d)[0]


@query(f""", {_RELATED} SELECT from_id, to_id, relation_type FROM v_relations r WHERE relation_type <> 'related_to' OR NOT EXISTS (SELECT 1 FROM wish w WHERE w.from_id = r.from_id AND w.to_id = r.to_id)""")
def relations_left(spark, d):
    """BK5."""
    return _unrelate(spark, d)[1].select("from_id", "to_id", "relation_type")


@query("SELECT DISTINCT id AS object_id, tag FROM (SELECT id, tag1 AS tag FROM v_objects UNION ALL SELECT id, tag2 FROM v_objects)")
def object_tags(spark, d):
    """PR2."""
    return projection.project_tags(fx.details(spark, d))[1]


@query("SELECT checksum AS id, min(path) AS path, count(*) - 1 AS n_later FROM (SELECT checksum, concat('objects/', id, '.md') AS path FROM v_notes UNION ALL SELECT checksum, concat('objects/', id, '.md') FROM v_sources) GROUP BY checksum")
def first_of_each_id(spark, d):
    """WI1, VA7: objects with one checksum as id, the first by path and how many come later."""
    rows = fx.view(spark, d, "v_notes").select("id", "checksum").union(fx.view(spark, d, "v_sources").select("id", "checksum"))
    first, more = validate.dedupe_objects(rows.select(F.col("checksum").alias("id"), F.concat(F.lit("objects/"), F.col("id"), F.lit(".md")).alias("path")))
    later = more.groupBy(F.col("id").alias("later")).agg(F.count("*").alias("n_later"))
    return first.join(later, F.expr("id <=> later"), "left").select("id", "path", F.coalesce("n_later", F.lit(0)).alias("n_later"))


_CHILDREN = """
    kids AS (SELECT l_partkey AS parent, l_orderkey * 10 + l_linenumber AS child, CASE WHEN l_linenumber = 1 THEN 'note' ELSE 'attachment' END AS item_type,
        CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN 'Scan.PDF' WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'a/b.pdf' ELSE 'page.html' END AS filename,
        CASE WHEN l_linenumber IN (1, 2) THEN 'application/pdf' WHEN l_linenumber = 7 THEN CASE WHEN l_returnflag = 'N' THEN 'text/html' ELSE 'application/pdf' END WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'application/xhtml+xml' ELSE 'text/plain' END AS content_type,
        CASE WHEN l_linenumber = 6 THEN 'imported_url' ELSE 'linked_file' END AS link_mode FROM lineitem)"""


def _children(spark, d):
    c, k, flag = F.col, F.col("l_linenumber"), F.col("l_returnflag")
    name = F.when(k == 2, None).when((k == 3) & (flag == "R"), "Scan.PDF").when((k == 7) & (flag == "A"), "a/b.pdf").otherwise("page.html")
    kind = F.when(k.isin(1, 2), "application/pdf").when(k == 7, F.when(flag == "N", "text/html").otherwise("application/pdf")).when(k == 3, None).when((k == 6) & (flag == "A"), "application/xhtml+xml").otherwise("text/plain")
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.select(c("l_partkey").alias("parent_key"), (c("l_orderkey") * 10 + k).alias("item_key"), F.when(k == 1, "note").otherwise("attachment").alias("item_type"), name.alias("filename"), kind.alias("content_type"), F.when(k == 6, "imported_url").otherwise("linked_file").alias("link_mode"))


@query(f""", {_CHILDREN} SELECT p_partkey AS item_key, CASE WHEN n = 1 AND NOT unsafe THEN child END AS child_key, CASE WHEN n IS NULL THEN 'PAPER_ATTACHMENT_UNAVAILABLE' WHEN n > 1 THEN 'PAPER_ATTACHMENT_AMBIGUOUS' WHEN unsafe THEN 'ZOTERO_RESPONSE_INVALID' END AS code
    FROM part LEFT JOIN (SELECT parent, count(*) AS n, min(child) AS child, bool_or(contains(filename, '/')) AS unsafe FROM kids WHERE item_type = 'attachment' AND coalesce(filename, '') <> '' AND (content_type = 'application/pdf' OR lower(filename) LIKE '%.pdf') GROUP BY parent) ON parent = p_partkey""")
def primary_attachments(spark, d):
    """JO7: order lines as the children of parts; linked and untyped PDFs count."""
    return joins.select_primary_attachment(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_key")), _children(spark, d)).select("item_key", "child_key", "code")


@query("SELECT url AS request_id, list_sort(list(concat('src_', CAST(page_id AS VARCHAR)))) AS source_ids FROM pages WHERE url IS NOT NULL GROUP BY url")
def alias_matches(spark, d):
    """JO3, TX12: every address against the aliases of all sources."""
    none = F.lit(None).cast("string")
    alias = idn.source_aliases(F.lit("web"), none, none, none, F.col("canonical_url"), none, none, none)
    rows = fx.view(spark, d, "v_sources").select("id", "canonical_url", alias.alias("aliases"))
    return joins.match_aliases(rows.select(F.col("canonical_url").alias("request_id"), "aliases").distinct(), rows)


MIGRATED = """
    sums AS (SELECT from_id, count(*) AS n, min(to_id) AS only_id FROM v_relations WHERE relation_type = 'summarizes' GROUP BY ALL),
    literature AS (SELECT id, coalesce(n, 0) AS n, only_id FROM v_notes LEFT JOIN sums ON from_id = id WHERE subtype = 'literature'),
    old AS (SELECT id AS from_id, 'summarizes' AS relation_type, only_id AS to_id FROM literature WHERE n = 1
        UNION ALL SELECT least(from_id, to_id), relation_type, greatest(from_id, to_id) FROM v_relations WHERE relation_type = 'related_to' AND from_id IN (SELECT id FROM v_notes)
        UNION ALL SELECT from_id, relation_type, to_id FROM v_relations WHERE relation_type = 'supersedes' AND from_id IN (SELECT id FROM v_notes)
        UNION ALL SELECT from_id, relation_type, to_id FROM v_relations WHERE relation_type NOT IN ('summarizes', 'related_to', 'supersedes')),
    ends AS (SELECT o.*, f.id IS NOT NULL AND t.id IS NOT NULL AS whole FROM (SELECT DISTINCT * FROM old) o LEFT JOIN v_objects f ON f.id = from_id LEFT JOIN v_objects t ON t.id = to_id)"""


def _asked(spark, d):
    """The edges that version 1 records would ask for, gathered from the relations."""
    edges = fx.view(spark, d, "v_relations")
    literature = fx.view(spark, d, "v_notes").where("subtype = 'literature'").select(F.col("id").alias("from_id"))
    sums = edges.where("relation_type = 'summarizes'").join(literature, "from_id", "left_semi")
    one = sums.groupBy("from_id").agg(F.count("*").alias("n"), F.min("to_id").alias("to_id")).where("n = 1").select("from_id", "to_id", F.lit("summarizes").alias("relation_type"))
    notes = fx.view(spark, d, "v_notes").select(F.col("id").alias("from_id"))
    fields = edges.where("relation_type in ('related_to', 'supersedes')").join(notes, "from_id", "left_semi").select("from_id", "to_id", "relation_type")
    rows = one.unionByName(fields).unionByName(edges.where("relation_type not in ('summarizes', 'related_to', 'supersedes')"))
    none = {n: F.lit(None).cast("string") for n in ("section", "locator", "actor_id", "bad")}
    return rows.withColumns(none).withColumn("place", F.struct(F.lit(0).alias("file"), F.lit("").alias("id"), F.lit(0).cast("long").alias("place")))


@query(f", {MIGRATED} SELECT from_id, relation_type, to_id FROM ends WHERE whole")
def migrated_relations(spark, d):
    """MG3: version 1 fields gathered from the relations, and back to edges."""
    return migrate.resolve_relations(_asked(spark, d), fx.view(spark, d, "v_objects"))[0].select("from_id", "relation_type", "to_id")



def _bodies(spark, d):
    """Parsed bodies of the notes: a section a segment, with its citations."""
    none = F.lit(None).cast("string")
    locator = F.from_json(F.to_json(F.struct(F.lit(2).alias("locator_version"), F.col("locator_type").alias("source_type"))), schemas.LOCATOR)
    cite = F.struct("ordinal", F.struct("source_id", locator.alias("locator")).alias("c"))
    cites = fx.view(spark, d, "v_citations").groupBy("segment_id").agg(F.array_sort(F.collect_list(cite)).alias("cites"))
    block = F.struct(F.col("role").alias("kind"), "text", none.alias("artifact_id"), F.transform("cites", lambda x: x["c"]).alias("citations"))
    section = F.struct("ordinal", F.struct("section_id", "role", F.lit("").alias("heading"), F.array(block).alias("blocks")).alias("s"))
    rows = fx.view(spark, d, "v_segments").join(cites, "segment_id", "left").groupBy("object_id").agg(F.array_sort(F.collect_list(section)).alias("s"))
    return rows.select("object_id", F.lit("note").alias("kind"), none.alias("text"), F.transform("s", lambda x: x["s"]).alias("sections"))


_SEGMENT = "concat('seg_', sha256(concat('segment-v1', chr(0), object_id, chr(0), section_id, chr(0), '0')))"


@query("SELECT object_id, section_id, role, ordinal FROM v_segments")
def note_sections(spark, d):
    """PR4, WI5."""
    return projection.project_sections(_bodies(spark, d)).select("object_id", "section_id", "role", "ordinal")


@query(f"SELECT {_SEGMENT} AS segment_id, object_id, section_id, role, md5(text) AS text_hash FROM v_segments")
def note_segments(spark, d):
    """PR5, TX3."""
    return projection.project_segments(_bodies(spark, d)).select("segment_id", "object_id", "section_id", "role", F.md5("text").alias("text_hash"))


@query(f"""SELECT {_SEGMENT} AS segment_id, c.ordinal, source_id, concat('{{"locator_version":2,"source_type":"', locator_type, '"}}') AS locator FROM v_citations c JOIN v_segments s ON s.segment_id = c.segment_id""")
def note_citations(spark, d):
    """PR6, TX15."""
    return projection.project_citations(_bodies(spark, d))


@query("""SELECT CASE WHEN role = 'fact' AND n IS NULL THEN 'FACT_CITATION_MISSING' WHEN role = 'ai' THEN 'NOTE_BLOCK_METADATA_MISSING' ELSE 'CITATION_SOURCE_INVALID' END AS code, object_id, section_id
    FROM v_segments LEFT JOIN (SELECT segment_id, count(*) AS n FROM v_citations GROUP BY ALL) USING (segment_id) WHERE role IN ('fact', 'ai')""")
def body_findings(spark, d):
    """VA6."""
    return validate.check_bodies(_bodies(spark, d)).select("code", "object_id", "section_id")


@query("""SELECT CASE WHEN s.id IS NULL THEN 'FACT_SOURCE_MISSING' ELSE 'FACT_LOCATOR_MISMATCH' END AS code, object_id, section_id FROM v_citations c JOIN v_segments g ON g.segment_id = c.segment_id
    LEFT JOIN v_sources s ON s.id = source_id WHERE s.id IS NULL OR s.subtype <> locator_type OR locator_type = 'web'""")
def fact_findings(spark, d):
    """VA10, TX14: the web locators carry no snapshot, so they disagree."""
    return validate.check_facts(_bodies(spark, d), fx.details(spark, d)).select("code", "object_id", "section_id")


_NOTE_FINDINGS = "SELECT 'NOTE_MATURITY_INVALID' AS code, id AS object_id, concat('notes/', substring(id, 6, 20), '.md') AS path FROM v_notes WHERE subtype = 'idea' AND maturity NOT IN ('seed', 'developing')"


def _note_findings(spark, d):
    notes = fx.details(spark, d).withColumns({"type_history": F.lit(None).cast(schemas.HISTORY), "path": F.concat(F.lit("notes/"), F.substring("id", 6, 20), F.lit(".md"))})
    return validate.check_notes(notes)


@query(_NOTE_FINDINGS)
def note_findings(spark, d):
    """VA3."""
    return _note_findings(spark, d).select("code", "object_id", "path")


@query(f", nf AS ({_NOTE_FINDINGS}) SELECT code, object_id, path FROM nf WHERE path IN (SELECT coalesce(a.path, b.path) FROM v_scan_new a FULL JOIN v_scan_old b ON a.path = b.path WHERE a.checksum IS DISTINCT FROM b.checksum)")
def findings_of_changes(spark, d):
    """FI7, ST1."""
    changed = catalog.changed_paths(fx.view(spark, d, "v_scan_new"), fx.view(spark, d, "v_scan_old"))
    return catalog.filter_findings(_note_findings(spark, d), changed).select("code", "object_id", "path")


@query(f""", nf AS ({_NOTE_FINDINGS}) SELECT (SELECT count(*) FROM v_scan_new) AS files, (SELECT count(*) FROM v_objects) AS objects, (SELECT count(DISTINCT from_id) FROM v_relations) AS shards, (SELECT count(*) FROM nf) AS findings""")
def scan_totals(spark, d):
    """AG5."""
    return catalog.scan_summary(fx.view(spark, d, "v_scan_new"), fx.view(spark, d, "v_objects"), fx.view(spark, d, "v_relations"), _note_findings(spark, d))


@query("SELECT request_id, concat('item', CAST(request_id % 40 AS VARCHAR)) AS item_key FROM v_identifiers")
def metadata_candidates(spark, d):
    """JO4: items found by DOI or arXiv, each under both."""
    ids, none = fx.view(spark, d, "v_identifiers"), F.lit(None).cast("string")
    asked = ids.select("request_id", idn.normalize_doi(F.col("doi")).alias("doi"), idn.normalize_arxiv(F.col("arxiv"))["base"].alias("arxiv"), none.alias("isbn"), none.alias("url"))
    items = ids.select(F.concat(F.lit("item"), (F.col("request_id") % 40).cast("string")).alias("item_key"), "doi", F.col("arxiv").alias("arxiv_id"), none.alias("isbn"), none.alias("url")).distinct()
    return joins.exact_candidates(asked, items)


@query("""SELECT request_id, lower(doi) AS by_doi, concat('arxiv:', regexp_extract(arxiv, 'arXiv:(.*)v2', 1)) AS by_arxiv FROM v_identifiers""")
def identities(spark, d):
    """TX12: papers with and without a DOI."""
    none, c = F.lit(None).cast("string"), F.col
    of = lambda doi: idn.canonical_identity(F.lit("paper"), doi, c("arxiv"), none, none, none, none, none)
    return fx.view(spark, d, "v_identifiers").select("request_id", of(c("doi")).alias("by_doi"), of(none).alias("by_arxiv"))


@query(f""", {_CHILDREN} SELECT p_partkey AS item_key, CASE WHEN n = 1 AND p_size % 2 = 0 THEN child END AS child_key, CASE WHEN coalesce(n, 0) <> 1 OR p_size % 2 = 1 THEN 'ZOTERO_ITEM_UNAVAILABLE' END AS code
    FROM part LEFT JOIN (SELECT parent, count(*) AS n, min(child) AS child FROM kids WHERE item_type = 'attachment' AND link_mode = 'imported_url' AND content_type IN ('text/html', 'application/xhtml+xml') GROUP BY parent) ON parent = p_partkey""")
def web_snapshots(spark, d):
    """JO7: order lines as the stored pages of parts; only web pages have one."""
    items = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("item_key"), F.when(F.col("p_size") % 2 == 0, "webpage").otherwise("book").alias("item_type"))
    return joins.select_web_snapshot(items, _children(spark, d)).select("item_key", "child_key", "code")


def _v1_notes(spark, d):
    second = F.when(F.col("maturity") == "seed", "sec_elsewhere").when(F.col("maturity") == "developing", "sec_my_interpretation").otherwise("sec_original_facts")
    body = F.concat(F.lit("Lead.\n<!-- section_id: sec_my_interpretation -->\n## Mine\n\nOwn "), "tag1", F.lit("\n\n<!-- section_id: "), second, F.lit(" -->\n## More\n"), "tag2", F.lit("  "))
    return fx.view(spark, d, "v_notes").select("id", F.concat(F.lit("notes/"), F.col("id"), F.lit(".md")).alias("path"), F.when(F.col("subtype") == "synthesis", "no section").otherwise(body).alias("body"))


@query("""SELECT id, 0 AS ordinal, 'sec_my_interpretation' AS section_id, 'human' AS role, 'Mine' AS heading, concat('Own ', tag1) AS text FROM v_notes WHERE maturity IN ('mature', 'evergreen') AND subtype <> 'synthesis'
    UNION ALL SELECT id, 1, 'sec_original_facts', 'fact', 'More', tag2 FROM v_notes WHERE maturity IN ('mature', 'evergreen') AND subtype <> 'synthesis'""")
def migrated_sections(spark, d):
    """MG2: sections with their texts; notes with an unknown or repeated section give none."""
    return migrate.migrate_sections(_v1_notes(spark, d))[0].select("id", "ordinal", "section_id", "role", "heading", "text")


@query("SELECT id AS object_id, 'blocker' AS kind, 'MIGRATION_SECTION_BLOCKED' AS code FROM v_notes WHERE maturity IN ('seed', 'developing') OR subtype = 'synthesis'")
def blocked_sections(spark, d):
    """MG2: a note is blocked by an unknown section, a repeated one or none at all."""
    return migrate.migrate_sections(_v1_notes(spark, d))[1].select("object_id", "kind", "code")


@query("""SELECT CAST(crc32_ % 4096 AS INTEGER) AS bucket, sha256(string_agg(concat(path, chr(0), checksum, chr(0)), '' ORDER BY path)) AS digest, count(*) AS n_paths
    FROM (SELECT path, checksum, CAST(concat('0x', substring(md5(path), 1, 3)) AS BIGINT) AS crc32_ FROM v_scan_new) GROUP BY 1""")
def snapshot_parts(spark, d):
    """AG3 spread over buckets of paths."""
    return catalog.snapshot_buckets(fx.view(spark, d, "v_scan_new"))


from quire.plans import documents, faults, migration  # noqa: E402,F401  register their queries
