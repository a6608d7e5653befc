"""Single-object commands as jobs over tables of requests (BK1-BK6).  Time is an argument, never a clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import identity as idn
from quire.functions.locators import locator_json
from quire.operators.joins import alias_hits, exact_candidates, select_primary_attachment, select_web_snapshot
from quire.operators.validate import direction_broken, relation_allowed, target_broken, with_ends

#: Item types of a reference manager that are papers.
PAPER_ITEMS = ("journalArticle", "conferencePaper", "preprint", "thesis", "report", "manuscript")


def new_id(prefix: str, *parts: Column) -> Column:
    """A valid object id derived from its parts: 26 characters that depend on nothing else."""
    hexed = F.upper(F.sha2(F.concat_ws("\u0000", *parts), 256))
    return F.concat(F.lit(prefix + "_"), F.substring(hexed, 1, 26))


def with_aliases(sources: DataFrame) -> DataFrame:
    c = F.col
    return sources.withColumn("aliases", idn.source_aliases(c("subtype"), c("doi"), c("arxiv_id"), c("isbn"), c("canonical_url"), c("repository_host"), c("repository_path"), c("commit")))


def bulk_capture(requests: DataFrame, sources: DataFrame, metadata: DataFrame, children: DataFrame, now: str, hosts: Sequence[str] = (), repositories: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, new sources) of capture requests (request_id, input, type).

    A request names an existing source by its own identifier, or needs exactly one metadata
    item of a fitting type (a repository: a row of ``repositories``: url, title, commit,
    default_branch); the source made from that is looked up again by all its identifiers.
    Several sources, or one of another type, are a conflict.  A web page needs its one
    snapshot; a paper without its one PDF is made with a warning.  Of requests for one new
    identity the first by id creates the private source in the inbox, the others match it.
    """
    spark, c = requests.sparkSession, F.col
    # inline() keeps the optimiser from copying the recognition into every later column
    r = requests.select("request_id", c("type").alias("asked"), F.inline(F.array(idn.recognize_input(c("input"), c("type"), hosts))))
    by = F.when(c("arxiv").isNotNull(), "arxiv").when(c("doi").isNotNull(), "doi").when(c("isbn").isNotNull(), "isbn").when(c("host").isNotNull(), "repo").when(c("url").isNotNull(), "web")
    own = F.when(by == "arxiv", F.concat(F.lit("arxiv:"), "arxiv")).when(by == "doi", F.concat(F.lit("doi:"), "doi")).when(by == "isbn", F.concat(F.lit("isbn:"), "isbn")).when(by == "web", F.concat(F.lit("url:"), "url"))
    r = r.withColumn("by", by).withColumn("aliases", F.array_compact(F.array(own))).persist()  # read three times, recognised once
    known = with_aliases(sources).select("id", "subtype", "aliases")
    first = alias_hits(r, known).select("request_id", *(c(x).alias(f"a_{x}") for x in ("n_sources", "first_id", "n_types", "source_type")))
    wish = r.select("request_id", "doi", "arxiv", "isbn", F.when(c("by") == "web", c("url")).alias("url"))
    items = exact_candidates(wish, metadata).groupBy("request_id").agg(F.count("*").alias("n_items"), F.min("item_key").alias("item_key"))
    pdf = select_primary_attachment(metadata, children).select("item_key", c("code").alias("pdf_code"), c("child_key").alias("pdf_key"))
    web = select_web_snapshot(metadata, children).select("item_key", c("code").alias("web_code"), c("child_key").alias("web_key"))
    isbns = idn.isbn_values(c("isbn"))
    m = metadata.select("item_key", c("item_type").alias("m_type"), c("title").alias("m_title") if "title" in metadata.columns else F.lit(None).cast("string").alias("m_title"), idn.normalize_doi(c("doi")).alias("m_doi"), idn.normalize_arxiv(c("arxiv_id"))["base"].alias("m_arxiv"), F.get(isbns, F.lit(0)).alias("m_isbn"))
    if repositories is None:
        repositories = spark.createDataFrame([], "url string, title string, commit string, default_branch string")
    repo = repositories.select(c("url").alias("r_url"), c("title").alias("r_title"), c("commit").alias("r_commit"), "default_branch")
    rows = r.drop("aliases").join(first, "request_id", "left").join(items, "request_id", "left").join(m, "item_key", "left").join(pdf, "item_key", "left").join(web, "item_key", "left").join(repo, (c("by") == "repo") & (c("url") == c("r_url")), "left")
    one = F.coalesce(c("n_items") == 1, F.lit(False))
    paper, book = one & c("m_type").isin(*PAPER_ITEMS), one & (c("m_type") == "book")
    typed = c("asked").isin("paper", "book")
    detected = (
        F.when(c("by") == "repo", F.when(c("r_commit").isNotNull(), "oss")).when(c("by") == "web", F.when(one & (c("m_type") == "webpage") & c("web_key").isNotNull(), "web"))
        .when(c("by") == "isbn", F.when(book, "book")).when(c("by") == "arxiv", F.when(paper, "paper"))
        .when(typed, F.when((c("asked") == "paper") & paper, "paper").when((c("asked") == "book") & book, "book")).when(paper, "paper").when(book, "book")
    )
    free_doi = (c("by") == "doi") & ~F.coalesce(typed, F.lit(False))
    expected = F.when(free_doi, c("a_source_type")).otherwise(c("type"))
    early = (
        F.when(c("code").isNotNull(), c("code")).when((c("a_n_sources") > 1) | (c("a_source_type") != expected), "ADD_IDENTITY_CONFLICT").when(c("a_n_sources") == 1, "EXISTING")
        .when(c("detected").isNull(), F.when(free_doi, "ADD_TYPE_AMBIGUOUS").otherwise("ADD_METADATA_UNAVAILABLE")).when((c("detected") == "paper") & (c("pdf_code") == "ZOTERO_RESPONSE_INVALID"), "ADD_METADATA_UNAVAILABLE")
    )
    rows = rows.withColumn("detected", detected).withColumn("early", early)
    of = lambda kinds, col: F.when(c("detected").isin(*kinds), col)
    rows = rows.withColumns({"doi": of(("paper", "book"), c("m_doi")), "arxiv": of(("paper",), c("m_arxiv")), "isbn": of(("book",), c("m_isbn"))})
    fields = (c("detected"), c("doi"), c("arxiv"), c("isbn"), c("url"), c("host"), c("path"), c("r_commit"))
    rows = rows.withColumn("identity", idn.canonical_identity(*fields)).withColumn("aliases", F.when(c("early").isNull(), idn.source_aliases(*fields))).persist()
    second = alias_hits(rows.where("early is null"), known).select("request_id", *(c(x).alias(f"b_{x}") for x in ("n_sources", "first_id", "n_types", "source_type")))
    rows = rows.join(second, "request_id", "left")
    result = F.coalesce("early", F.when((c("b_n_sources") > 1) | (c("b_n_types") > 1) | (c("b_source_type") != c("detected")), "ADD_IDENTITY_CONFLICT").when(c("b_n_sources") == 1, "EXISTING").otherwise("CREATED"))
    rows = rows.withColumn("result", result)
    # requests that create nothing are each alone, or they would all be one window partition
    new = c("result") == "CREATED"
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(F.when(new, c("identity")), F.when(~new, c("request_id"))).orderBy("request_id")))
    fresh = F.when(new, new_id("src", c("identity")))
    warning = F.when((c("detected") == "paper") & c("result").isin("CREATED", "EXISTING") & c("early").isNull(), c("pdf_code"))
    final = F.when(new & (c("nth") > 1), "EXISTING").otherwise(c("result"))
    kind = F.when(c("early") == "EXISTING", c("a_source_type")).when(c("result").isin("CREATED", "EXISTING"), c("detected"))
    results = rows.select("request_id", final.alias("result"), F.coalesce(fresh, F.when(c("result") == "EXISTING", F.coalesce("a_first_id", "b_first_id"))).alias("source_id"), kind.alias("source_type"), warning.alias("warning"))
    create = rows.where(new & (c("nth") == 1)).select(
        fresh.alias("id"), F.lit("source").alias("kind"), c("detected").alias("subtype"), F.coalesce("r_title", "m_title").alias("title"), F.lit("private").alias("visibility"), F.lit("active").alias("record_status"), F.lit("inbox").alias("workflow_stage"),
        F.lit(now[:10]).alias("created"), F.lit(now[:10]).alias("updated"), "doi", c("arxiv").alias("arxiv_id"), "isbn", of(("web", "oss"), c("url")).alias("canonical_url"), c("host").alias("repository_host"), c("path").alias("repository_path"),
        c("r_commit").alias("commit"), "default_branch", of(("oss",), F.lit("NOASSERTION")).alias("license"), "item_key", of(("paper",), c("pdf_key")).alias("attachment_key"), of(("web",), c("web_key")).alias("snapshot_key"),
    )
    return results, create.withColumnRenamed("item_key", "zotero_key")


def advance_workflow(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, source_id, was, target, result): the same stage is no change, one step forward is, all else is invalid."""
    place = lambda c: F.array_position(F.array(*(F.lit(s) for s in schemas.STAGES)), c)
    rows = requests.join(sources.select(F.col("id").alias("source_id"), F.col("workflow_stage").alias("was")), "source_id", "left")
    step = place(F.col("target")) - place(F.col("was"))
    result = F.when(F.col("was").isNull(), "SOURCE_NOT_FOUND").when(step == 0, "NO_CHANGE").when(step == 1, "CHANGED").otherwise("SOURCE_WORKFLOW_INVALID")
    return rows.select("request_id", "source_id", "was", "target", result.alias("result"))


#: The fields that a metadata sync manages.
MANAGED = ("title", "authors", "year", "doi", "arxiv_id", "arxiv_version", "canonical_url", "attachment_key", "attachment_version", "attachment_filename", "attachment_media_type", "attachment_size", "attachment_sha256")


def sync_sources(sources: DataFrame, metadata: DataFrame, attachments: DataFrame, now: str, adopt: bool = False, accept_attachment: bool = False) -> DataFrame:
    """(id, decision, warnings, new_hash, updated, and the managed fields as they are afterwards) of every source, by the first rule that applies.

    metadata: zotero_key, version, title, authors, year, doi, arxiv_id, url.  attachments: one
    row an item (item_key, child_key, code, version, filename, size, sha256), as
    ``select_primary_attachment`` gives it.  A source keeps its recorded attachment where the
    item has none or several, which is a warning.  Rows that aren't UPDATED keep their fields.
    """
    c = F.col
    m = metadata.select(*(c(x).alias(f"m_{x}") for x in ("zotero_key", "version", "title", "authors", "year", "doi", "arxiv_id", "url")))
    a = attachments.select(c("item_key").alias("a_item"), c("child_key").alias("a_key"), c("code").alias("a_code"), *(c(x).alias(f"a_{x}") for x in ("version", "filename", "size", "sha256")))
    rows = sources.where("kind = 'source'").join(m, c("zotero_key") == c("m_zotero_key"), "left").join(a, c("zotero_key") == c("a_item"), "left")
    doi, arx = idn.normalize_doi(c("doi")), idn.normalize_arxiv(c("arxiv_id"))["base"]
    there = c("a_key").isNotNull()
    kept = lambda name, new: F.when(there, new).otherwise(c(name))
    rows = rows.withColumns({"own_doi": doi, "own_arxiv": arx, "n_doi": idn.normalize_doi(c("m_doi")), "n_arxiv": idn.normalize_arxiv(c("m_arxiv_id")), "n_sha256": kept("attachment_sha256", c("a_sha256"))})
    remote = {
        "title": c("m_title"), "authors": c("m_authors"), "year": c("m_year"), "doi": c("n_doi"), "arxiv_id": c("n_arxiv.base"), "arxiv_version": c("n_arxiv.version"), "canonical_url": idn.canonicalize_url(c("m_url")),
        "attachment_key": kept("attachment_key", c("a_key")), "attachment_version": kept("attachment_version", c("a_version")), "attachment_filename": kept("attachment_filename", c("a_filename")),
        "attachment_media_type": kept("attachment_media_type", F.lit("application/pdf")), "attachment_size": kept("attachment_size", c("a_size")), "attachment_sha256": c("n_sha256"),
    }
    rows = rows.withColumn("mine", idn.managed_fields_hash({f: c(f) for f in MANAGED})).withColumn("theirs", idn.managed_fields_hash(remote))
    # Another source with either identifier is a collision; two least and greatest owners tell.
    alias = lambda p, x: F.when(x.isNotNull(), F.concat(F.lit(p), x))
    papers = sources.where("kind = 'source' and subtype = 'paper'")
    owners = papers.select("id", F.explode(F.array_compact(F.array(alias("doi:", doi), alias("arxiv:", arx)))).alias("alias")).groupBy("alias").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    wanted = rows.select("id", F.explode(F.array_compact(F.array(alias("doi:", c("n_doi")), alias("arxiv:", c("n_arxiv.base"))))).alias("alias"))
    taken = wanted.join(owners, "alias").where("low <> id or high <> id").select("id").distinct().withColumn("taken", F.lit(True))
    rows = rows.join(taken, "id", "left")
    baseline = c("managed_fields_hash").isNotNull()
    changed = F.coalesce(c("attachment_sha256") != c("n_sha256"), F.lit(False))
    decision = (
        F.when(c("subtype") != "paper", "SOURCE_TYPE_UNSUPPORTED").when(F.lit(adopt) & baseline, "SOURCE_SYNC_ADOPTION_INVALID").when(baseline & (c("managed_fields_hash") != c("mine")), "SOURCE_SYNC_LOCAL_MODIFIED")
        .when(c("m_zotero_key").isNull(), "ZOTERO_ITEM_UNAVAILABLE").when(c("n_doi").isNull() & c("n_arxiv").isNull(), "PAPER_CANONICAL_IDENTITY_MISSING")
        .when((c("own_doi").isNotNull() & ~c("own_doi").eqNullSafe(c("n_doi"))) | (c("own_arxiv").isNotNull() & ~c("own_arxiv").eqNullSafe(c("n_arxiv.base"))) | c("taken"), "PAPER_IDENTITY_CONFLICT")
        .when(changed & F.lit(not accept_attachment), "PAPER_ATTACHMENT_CHANGED").when(~baseline & (c("mine") != c("theirs")) & F.lit(not adopt), "SOURCE_SYNC_BASELINE_REQUIRED")
        .when((c("managed_fields_hash") == c("theirs")) & c("zotero_item_version").eqNullSafe(c("m_version")) & c("synced_at").isNotNull(), "NO_CHANGE").otherwise("UPDATED")
    )
    rows = rows.withColumn("decision", decision)
    done = c("decision").isin("NO_CHANGE", "UPDATED")
    warnings = F.when(done, F.array_compact(F.array(c("a_code"), F.when(changed, F.lit("PAPER_ATTACHMENT_ACCEPTED_LOCATORS_REVIEW"))))).otherwise(F.array().cast("array<string>"))
    new = c("decision") == "UPDATED"
    after = {f: F.when(new, v).otherwise(c(f)) for f, v in remote.items()}
    return rows.select(
        "id", "decision", warnings.alias("warnings"), F.when(new, c("theirs")).otherwise(c("managed_fields_hash")).alias("new_hash"), F.when(new, F.lit(now[:10])).otherwise(c("updated").cast("string")).alias("updated"),
        F.when(new, F.lit(now)).otherwise(c("synced_at")).alias("synced_at"), F.when(new, c("m_version")).otherwise(c("zotero_item_version")).alias("zotero_item_version"), *(v.alias(f) for f, v in after.items()),
    )


def evolve_notes(requests: DataFrame, notes: DataFrame, now: str) -> DataFrame:
    """Ideas become concepts with one more step in their history: (request_id, id, result, subtype, maturity, type_history, updated)."""
    rows = requests.join(notes.where("kind = 'note'").select("id", "subtype", "maturity", "type_history", "updated"), "id", "left")
    ok = F.col("subtype") == "idea"
    step = F.struct(F.struct(F.col("actor_id").alias("id"), F.lit("human").alias("type")).alias("actor"), F.lit(now).alias("changed_at"), F.lit("idea").alias("from"), F.lit("concept").alias("to"))
    history = F.array_append(F.coalesce("type_history", F.array().cast(schemas.HISTORY)), step)
    result = F.when(F.col("subtype").isNull(), "NOTE_NOT_FOUND").when(ok, "CHANGED").otherwise("NOTE_TRANSITION_INVALID")
    pick = lambda new, old: F.when(ok, new).otherwise(F.col(old)).alias(old)
    return rows.select("request_id", "id", result.alias("result"), pick(F.lit("concept"), "subtype"), pick(F.coalesce("maturity", F.lit("seed")), "maturity"), pick(history, "type_history"), pick(F.lit(now[:10]), "updated"))


def _edge_key(df: DataFrame) -> DataFrame:
    section = F.coalesce("to_section_id", F.lit(""))
    located = locator_json(F.col("locator")) if "locator" in df.columns and df.schema["locator"].dataType.typeName() == "struct" else F.coalesce(F.col("locator") if "locator" in df.columns else F.lit(""), F.lit(""))
    return df.withColumn("k", F.struct("from_id", "to_id", section.alias("s"), "relation_type", located.alias("l")))


def canonical_ends(df: DataFrame) -> DataFrame:
    """``related_to`` edges from the smaller to the larger id."""
    swap = (F.col("relation_type") == "related_to") & (F.col("from_id") > F.col("to_id"))
    return df.withColumns({"from_id": F.when(swap, F.col("to_id")).otherwise(F.col("from_id")), "to_id": F.when(swap, F.col("from_id")).otherwise(F.col("to_id"))})


def add_relations(edges: DataFrame, requests: DataFrame, objects: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(request_id, from_id, to_id, relation_type, result) of edges to add: ADDED, an end that is missing, one that exists, or the first rule it breaks.

    Of requests for one edge the first by id adds it.  ``sections`` (object_id, section_id) are those
    of the notes; without them no named section is known.
    """
    c, t = F.col, F.col("relation_type")
    asked = _edge_key(canonical_ends(requests))
    have = _edge_key(edges).select("k").distinct().withColumn("there", F.lit(True))
    rows = with_ends(asked, objects).join(have, "k", "left")
    if sections is None:
        rows = rows.withColumn("known", F.lit(False))
    else:
        rows = rows.join(sections.select(c("object_id").alias("po"), c("section_id").alias("ps"), F.lit(True).alias("known")).distinct(), F.expr("to_id = po and to_section_id = ps"), "left")
    broken = (
        F.when(c("f_id").isNull() | c("t_id").isNull(), "RELATION_ENDPOINT_MISSING").when(c("there"), "RELATION_ALREADY_EXISTS").when(~relation_allowed(), "RELATION_KIND_INVALID").when(direction_broken(), "RELATION_DIRECTION_INVALID")
        .when(target_broken(), "RELATION_TARGET_INVALID").when((t == "related_to") & (c("from_id") == c("to_id")), "RELATION_NOT_CANONICAL").when((F.coalesce("to_section_id", F.lit("")) != "") & ~F.coalesce("known", F.lit(False)), "RELATION_SECTION_MISSING")
        .when(t.isin(*schemas.CONTENT_DEPENDENCIES) & (c("f_visibility") == "public") & (c("t_visibility") == "private"), "RELATION_PRIVATE_DEPENDENCY")
    )
    # Only an edge that was added makes a later request for it one too many; requests for one edge break the same rules.
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("request_id")))
    result = F.coalesce(broken, F.when(c("nth") > 1, "RELATION_ALREADY_EXISTS"), F.lit("ADDED"))
    return rows.select("request_id", "from_id", "to_id", "relation_type", result.alias("result"))


def remove_relations(edges: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, edges that stay)."""
    asked, have = _edge_key(canonical_ends(requests)), _edge_key(edges)
    there = have.select("k").distinct().withColumn("there", F.lit(True))
    results = asked.join(there, "k", "left").select("request_id", F.when(F.col("there"), "REMOVED").otherwise("RELATION_NOT_FOUND").alias("result"))
    return results, have.join(asked.select("k"), "k", "left_anti").drop("k")


def create_notes(requests: DataFrame, sources: DataFrame, now: str, actor_id: str = "user", section: tuple[str, str] = ("sec_mine", "Mine")) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(results, notes, bodies, summarizes edges) of notes asked for by (request_id, source_id, title[, note_type]).

    Literature notes, the default, need a source that exists, and other notes may name none.  A
    note without a title is called untitled; its body is one empty human section, and the actor
    who asked is the edge's.
    """
    c = F.col
    kind = c("note_type") if "note_type" in requests.columns else F.lit("literature")
    rows = requests.withColumn("note_type", F.coalesce(kind, F.lit("literature"))).join(sources.where("kind = 'source'").select(c("id").alias("source_id"), F.lit(True).alias("known")), "source_id", "left")
    literature = c("note_type") == "literature"
    result = (
        F.when(~c("note_type").isin(*schemas.NOTE_TYPES), "FIELD_INVALID").when(literature & c("source_id").isNull(), "NOTE_SOURCE_REQUIRED")
        .when(c("source_id").isNotNull() & (~literature | c("known").isNull()), "NOTE_SOURCE_INVALID").otherwise("CREATED")
    )
    rows = rows.withColumn("result", result)
    ok = rows.where("result = 'CREATED'").withColumn("id", new_id("note", c("request_id").cast("string"), F.coalesce("source_id", F.lit(""))))
    title = F.coalesce("title", F.concat(F.lit("Untitled "), "note_type"))
    today = F.lit(now[:10])
    notes = ok.select(
        "id", F.lit("note").alias("kind"), c("note_type").alias("subtype"), title.alias("title"), F.lit("private").alias("visibility"), F.lit("active").alias("record_status"), F.lit("seed").alias("maturity"),
        today.alias("created"), today.alias("updated"), F.array().cast("array<string>").alias("tags"), F.array().cast(schemas.HISTORY).alias("type_history"),
    )
    empty = F.array(F.struct(F.lit(section[0]).alias("section_id"), F.lit("human").alias("role"), F.lit(section[1]).alias("heading"), F.from_json(F.lit("[]"), _BLOCKS).alias("blocks")))
    bodies = ok.select(c("id").alias("object_id"), F.lit("note").alias("kind"), F.lit(None).cast("string").alias("text"), empty.alias("sections"))
    actor = F.struct(F.lit(actor_id).alias("id"), F.lit("human").alias("type"))
    edges = ok.where("source_id is not null").select(c("id").alias("from_id"), c("source_id").alias("to_id"), F.lit("summarizes").alias("relation_type"), F.lit(now).alias("created_at"), actor.alias("actor"))
    return rows.select("request_id", "result"), notes, bodies, edges


#: Blocks of a section, as bodies have them.
_BLOCKS = schemas.BODY.split("blocks:", 1)[1].removesuffix(">>")
