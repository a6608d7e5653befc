"""Data-quality rules as set-based jobs; each gives rows of findings (VA2-VA22, WI1, WI2)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import identity as idn
from quire.functions.locators import locator_json, locator_mismatches
from quire.functions.text import finding_category
from quire.operators.catalog import all_findings
from quire.sources.vault import Roots, stored


def findings(rows: DataFrame, code: Column | str, path="path", object_id="id", section_id=None, details: Column | None = None) -> DataFrame:
    """Rows with a code as findings of severity error."""
    code = F.lit(code) if isinstance(code, str) else code
    col = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")
    out = rows.select(code.alias("code"), col(path).alias("path"), col(object_id).alias("object_id"), col(section_id).alias("section_id"), (F.lit(None) if details is None else details).cast("map<string,array<string>>").alias("details")).where("code is not null")
    return out.select("code", F.lit("error").alias("severity"), finding_category(F.col("code")).alias("category"), F.col("code").alias("message"), "path", "object_id", "section_id", "details")


def first_code(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule that is broken."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), code) for code, broken in rules))


def dedupe_objects(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row of each id in path order, later rows)."""
    rows = objects.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("path")))
    return rows.where("nth = 1").drop("nth"), rows.where("nth > 1").drop("nth")


def dedupe_shards(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of the first file of each from_id in path order, later files)."""
    files = edges.select("from_id", "path").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("from_id").orderBy("path")))
    return edges.join(files.where("nth = 1").drop("nth"), ["from_id", "path"], "left_semi"), files.where("nth > 1").drop("nth")


def check_duplicates(objects: DataFrame, edges: DataFrame) -> DataFrame:
    _, more = dedupe_objects(objects)
    _, shards = dedupe_shards(edges)
    return findings(more, "OBJECT_ID_DUPLICATE").unionByName(findings(shards, "RELATION_SHARD_DUPLICATE", object_id="from_id"))


def _missing(*names: str) -> Column:
    return F.array_contains(F.array(*(F.coalesce(F.col(n).cast("string"), F.lit("")) == "" for n in names)), True)


def check_source_identity(objects: DataFrame) -> DataFrame:
    """What a source of each type must be known by, then the first field out of its range."""
    c = F.col
    gone = (
        F.when(c("subtype") == "paper", _missing("canonical_url") & _missing("doi") & _missing("zotero_key")).when(c("subtype") == "web", _missing("canonical_url", "captured_at"))
        .when(c("subtype") == "book", _missing("isbn") & _missing("doi") & _missing("zotero_key") & _missing("canonical_url")).when(c("subtype") == "oss", _missing("canonical_url", "repository_host", "repository_path", "commit", "license"))
    )
    given = lambda name, broken: (name, c(name).isNotNull() & broken)
    trimmed = lambda name: (c(name) != "") & (c(name) == F.trim(c(name)))
    digest = lambda name: given(name, ~c(name).rlike(r"^sha256:[0-9a-f]{64}\z"))
    field = first_code(
        given("zotero_library_type", ~c("zotero_library_type").isin("user", "group")), given("zotero_item_version", c("zotero_item_version") < 0),
        given("arxiv_version", c("arxiv_id").isNull()), given("arxiv_version", c("arxiv_version") < 1), given("arxiv_id", ~c("arxiv_id").rlike(r"^(?:[a-z-]+(?:\.[a-z]{2})?/\d{7}|\d{4}\.\d{4,5})\z")),
        given("edition", (c("subtype") != "book") | ~trimmed("edition")), given("attachment_media_type", c("attachment_media_type") != "application/pdf"), given("attachment_filename", (c("attachment_filename") == "") | c("attachment_filename").rlike(r"[/\\]")),
        given("attachment_version", c("attachment_version") < 0), given("attachment_size", c("attachment_size") < 1), digest("managed_fields_hash"), digest("attachment_sha256"),
    )
    code = F.when(gone, "SOURCE_IDENTITY_MISSING").when(field.isNotNull(), "FIELD_INVALID")
    return findings(objects.where("kind = 'source'"), code, details=F.when(field.isNotNull() & ~gone, F.create_map(F.lit("field"), F.array(field))))


def check_notes(objects: DataFrame) -> DataFrame:
    """Ideas are seeds or developing; only concepts have a history, of one step from idea to concept."""
    c, h = F.col, F.col("type_history")
    evolved = F.coalesce(F.size(h), F.lit(0)) > 0
    steps = F.exists(h, lambda t: ~(t["from"].eqNullSafe("idea") & t["to"].eqNullSafe("concept")))
    code = first_code(
        ("NOTE_MATURITY_INVALID", (c("subtype") == "idea") & ~F.coalesce(c("maturity").isin("seed", "developing"), F.lit(False))),
        ("NOTE_TRANSITION_INVALID", evolved & ((c("subtype") != "concept") | (F.size(h) > 1) | steps)),
    )
    return findings(objects.where("kind = 'note'"), code)


def check_snippets_and_artifacts(objects: DataFrame) -> DataFrame:
    """Line ranges of snippets; artifacts are private, and reviewed ones name who reviewed them and when, others don't name both."""
    c = F.col
    ai = c("kind") == "ai_artifact"
    proven = (F.coalesce("reviewed_by", F.lit("")) != "") & c("reviewed_at").isNotNull()
    code = first_code(
        ("SNIPPET_RANGE_INVALID", (c("kind") == "snippet") & ((c("start_line") < 1) | (c("end_line") < c("start_line")))), ("AI_ARTIFACT_INVALID", ai & (c("visibility") != "private")),
        ("AI_REVIEW_INVALID", ai & ((c("review_status") != "unreviewed") != proven)),
    )
    return findings(objects.where("kind in ('snippet', 'ai_artifact')"), code)


def locator_code(l: Column) -> Column:  # noqa: E741
    """First error in a locator's own shape, null if it is sound."""
    kind, snap = l["source_type"], l["snapshot_ref"]
    given = lambda f: (F.coalesce(l[f].cast("string"), F.lit("")) != "") & ~F.coalesce(l[f].cast("string") == "0", F.lit(False)) if f == "page" else F.coalesce(l[f], F.lit("")) != ""
    none = lambda *names: ~reduce(lambda a, b: a | b, (given(n) for n in names))
    low = lambda f: l[f].isNotNull() & (l[f] < 1)
    of = lambda t, broken: ("LOCATOR_INVALID", (kind == t) & broken)
    lines = l["start_line"].isNotNull() & l["end_line"].isNotNull()
    some = lambda parts: reduce(lambda a, b: a | b, parts)
    parts = ("provider", "identifier", "captured_at", "content_hash")
    repository = ("repository_host", "repository_path", "commit", "path")
    return first_code(
        ("LOCATOR_VERSION_UNSUPPORTED", ~l["locator_version"].eqNullSafe(F.lit(schemas.LOCATOR_VERSION))), ("FIELD_INVALID", kind.isNull() | ~kind.isin(*schemas.SOURCE_TYPES)),
        ("FIELD_MISSING", (kind == "web") & (snap.isNull() | some(snap[f].isNull() for f in parts))), ("FIELD_INVALID", (kind == "web") & some(snap[f] == "" for f in parts)), ("SNAPSHOT_INVALID", (kind == "web") & ~snap["content_hash"].startswith("sha256:")),
        ("FIELD_MISSING", (kind == "oss") & some(l[f].isNull() for f in repository)), ("FIELD_INVALID", (kind == "oss") & some(l[f] == "" for f in repository)),
        of("paper", none("page", "page_label", "section", "figure", "table")), of("paper", low("page")), of("web", (F.coalesce(F.size(l["heading_path"]), F.lit(0)) < 1) & l["paragraph"].isNull()), of("web", low("paragraph")),
        of("book", none("chapter", "page", "location")), of("book", l["page"].isNotNull() & none("edition", "isbn")), of("book", l["edition"].isNotNull() & ((l["edition"] == "") | (l["edition"] != F.trim(l["edition"])))),
        of("book", l["isbn"].isNotNull() & idn.normalize_isbn(l["isbn"]).isNull()),
        of("oss", none("symbol") & ~lines), of("oss", lines & ((l["start_line"] < 1) | (l["end_line"] < l["start_line"]))),
    )


def _cited(bodies: DataFrame) -> DataFrame:
    """(object_id, section_id, role, block, citation) of every block, one row a citation (outer)."""
    blocks = bodies.where("kind = 'note'").select("object_id", F.explode("sections").alias("s")).select("object_id", F.col("s.section_id").alias("section_id"), F.col("s.role").alias("role"), F.explode("s.blocks").alias("b"))
    return blocks.select("object_id", "section_id", "role", F.col("b.kind").alias("block_kind"), F.col("b.artifact_id").alias("artifact_id"), F.size("b.citations").alias("n_citations"), F.explode_outer("b.citations").alias("c"))


def check_locators(bodies: DataFrame, edges: DataFrame) -> DataFrame:
    cited = _cited(bodies).where("c is not null")
    a = findings(cited, locator_code(F.col("c.locator")), None, "object_id", "section_id")
    return a.unionByName(findings(edges.where("locator is not null"), locator_code(F.col("locator")), "path", "from_id"))


def check_bodies(bodies: DataFrame) -> DataFrame:
    """Section and block rules of notes."""
    notes = bodies.where("kind = 'note'")
    sections = notes.select("object_id", F.explode("sections").alias("s")).select("object_id", "s.*")
    twice = sections.groupBy("object_id", "section_id").count().where("count > 1")
    human = notes.where(~F.exists("sections", lambda s: s["role"] == "human"))
    block = sections.select("object_id", "section_id", "role", F.explode("blocks").alias("b"))
    code = first_code(
        ("NOTE_BLOCK_ROLE_MISMATCH", F.col("b.kind") != F.col("role")), ("FACT_CITATION_MISSING", (F.col("role") == "fact") & (F.coalesce(F.size("b.citations"), F.lit(0)) < 1)),
        ("NOTE_BLOCK_METADATA_MISSING", (F.col("role") == "ai") & F.col("b.artifact_id").isNull()), ("CITATION_SOURCE_INVALID", F.exists("b.citations", lambda c: ~F.coalesce(c["source_id"].rlike(r"^src_[0-9A-HJKMNP-TV-Z]{26}\z"), F.lit(False)))),
    )
    return all_findings(findings(twice, "SECTION_ID_DUPLICATE", None, "object_id", "section_id"), findings(human, "NOTE_HUMAN_SECTION_MISSING", None, "object_id"), findings(block, code, None, "object_id", "section_id"))


def check_layout(objects: DataFrame, edges: DataFrame, roots: Roots = Roots()) -> DataFrame:
    c = F.col
    sub = lambda names: F.create_map(*(F.lit(x) for p in names.items() for x in p))[c("subtype")]
    folder = (
        F.when(c("kind") == "source", F.concat(F.lit(roots.sources + "/"), sub(schemas.SOURCE_FOLDERS))).when(c("kind") == "note", F.concat(F.lit(roots.notes + "/"), sub(schemas.NOTE_FOLDERS)))
        .when(c("kind") == "snippet", roots.snippets).otherwise(roots.ai_artifacts)
    )
    stayed = (c("kind") == "note") & (c("subtype") == "concept") & (F.size("type_history") > 0) & c("path").startswith(f"{roots.notes}/{schemas.NOTE_FOLDERS['idea']}/")
    ok = c("path").startswith(F.concat(folder, F.lit("/"))) | F.coalesce(stayed, F.lit(False))
    shard = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1) != c("from_id")
    # A shard of an unknown object has RELATION_SOURCE_MISSING alone.
    wrong = edges.select("path", "from_id").distinct().join(objects.select(c("id").alias("from_id")).distinct(), "from_id", "left_semi")
    return findings(objects, F.when(~ok | ~F.lower("path").endswith(".md"), "OBJECT_LAYOUT_INVALID")).unionByName(findings(wrong, F.when(shard, "RELATION_SHARD_OWNER_MISMATCH"), "path", "from_id"))


def check_snippet_sources(objects: DataFrame) -> DataFrame:
    s = objects.where("kind = 'source'").select(F.col("id").alias("sid"), F.col("subtype").alias("stype"))
    rows = objects.where("kind = 'snippet'").join(s, F.col("source_id") == F.col("sid"), "left")
    return findings(rows, F.when(~F.col("stype").eqNullSafe(F.lit("oss")), "SNIPPET_SOURCE_INVALID"))


def check_facts(bodies: DataFrame, objects: DataFrame) -> DataFrame:
    src = objects.where("kind = 'source'").select(F.col("id").alias("sid"), F.struct("subtype", "snapshot_ref", "isbn", "edition", "repository_host", "repository_path", "commit").alias("src"))
    rows = _cited(bodies).where("c is not null").join(src, F.col("c.source_id") == F.col("sid"), "left").withColumn("off", locator_mismatches(F.col("c.locator"), F.col("src")))
    code = F.when(F.col("sid").isNull(), "FACT_SOURCE_MISSING").when(F.size("off") > 0, "FACT_LOCATOR_MISMATCH")
    return findings(rows, code, None, "object_id", "section_id", F.when(F.col("sid").isNotNull(), F.create_map(F.lit("fields"), F.col("off"))))


def check_artifacts(bodies: DataFrame, objects: DataFrame, sections: DataFrame) -> DataFrame:
    ai = objects.where("kind = 'ai_artifact'").select(F.col("id").alias("aid"), F.col("review_status").alias("review"))
    own = bodies.where("kind = 'note'").select("object_id", F.explode("sections").alias("s")).select("object_id", F.col("s.section_id").alias("section_id"), F.explode("s.blocks").alias("b"))
    blocks = own.where("b.kind = 'ai'").select("object_id", "section_id", F.col("b.artifact_id").alias("artifact_id")).join(ai, F.col("artifact_id") == F.col("aid"), "left")
    code = F.when(F.col("aid").isNull(), "AI_ARTIFACT_MISSING").when(F.col("review") != "promoted", "AI_ARTIFACT_UNPROMOTED")
    refs = objects.where("kind = 'ai_artifact'").select("id", "path", F.explode("input_refs").alias("r"))
    known = objects.select(F.col("id").alias("oid"))
    parts = sections.select(F.col("object_id").alias("po"), F.col("section_id").alias("ps")).distinct()
    refs = refs.join(known, F.col("r.object_id") == F.col("oid"), "left").join(parts, F.expr("r.object_id = po and r.section_id = ps"), "left")
    wrong = F.when(F.col("oid").isNull(), "AI_INPUT_MISSING").when(F.col("r.section_id").isNotNull() & F.col("ps").isNull(), "AI_INPUT_SECTION_MISSING")
    return findings(blocks, code, None, "object_id", "section_id").unionByName(findings(refs, wrong, "path", "id", "r.section_id"))


def with_ends(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges with both ends' kind, subtype and visibility; f_kind or t_kind is null where an end is missing."""
    end = lambda p: objects.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "kind", "subtype", "visibility")))
    return edges.join(end("f"), F.col("from_id") == F.col("f_id"), "left").join(end("t"), F.col("to_id") == F.col("t_id"), "left")


def relation_allowed() -> Column:
    """Does the matrix allow this type between these kinds?  Supersedes needs one kind."""
    fits = [(F.col("relation_type") == r) & F.col("f_kind").isin(*a) & F.col("t_kind").isin(*b) for r, a, b in schemas.RELATION_MATRIX]
    out = fits[0]
    for f in fits[1:]:
        out = out | f
    return out & ((F.col("relation_type") != "supersedes") | (F.col("f_kind") == F.col("t_kind")))


def direction_broken() -> Column:
    """Summaries start from literature notes and syntheses from synthesis notes; an end without a subtype is neither."""
    t, own = F.col("relation_type"), F.col("f_subtype")
    return ((t == "summarizes") & ~own.eqNullSafe("literature")) | ((t == "synthesizes") & ~own.eqNullSafe("synthesis"))


def target_broken() -> Column:
    """``snippet_from`` leads to repositories only."""
    return (F.col("relation_type") == "snippet_from") & ~F.col("t_subtype").eqNullSafe("oss")


def check_relations(edges: DataFrame, objects: DataFrame, sections: DataFrame) -> DataFrame:
    """All rules on edges.  An unknown start gives RELATION_SOURCE_MISSING once and nothing else; an unknown target skips the other rules."""
    c = F.col
    ends = with_ends(edges, objects)
    orphans = findings(ends.where("f_id is null").select("path", "from_id").distinct(), "RELATION_SOURCE_MISSING", object_id="from_id")
    rows = ends.where("f_id is not null")
    untargeted = findings(rows.where("t_id is null"), "RELATION_TARGET_MISSING", object_id="from_id")
    known = rows.where("t_id is not null")
    src = objects.where("kind = 'source'").select(c("id").alias("sid"), F.struct("subtype", "snapshot_ref", "isbn", "edition", "repository_host", "repository_path", "commit").alias("src"))
    parts = sections.select(c("object_id").alias("po"), c("section_id").alias("ps")).distinct()
    key = ["from_id", "to_id", F.coalesce("to_section_id", F.lit("")), "relation_type", locator_json(c("locator"))]
    known = known.join(src, c("to_id") == c("sid"), "left").join(parts, F.expr("to_id = po and to_section_id = ps"), "left")
    known = known.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    t = c("relation_type")
    rules = [
        ("RELATION_KIND_INVALID", ~relation_allowed()),
        ("RELATION_DIRECTION_INVALID", direction_broken()),
        ("RELATION_TARGET_INVALID", target_broken()),
        ("RELATION_NOT_CANONICAL", (t == "related_to") & (c("from_id") >= c("to_id"))),
        ("RELATION_SECTION_MISSING", c("to_section_id").isNotNull() & c("ps").isNull()),
        ("RELATION_LOCATOR_MISMATCH", c("locator").isNotNull() & c("src").isNotNull() & (F.size(locator_mismatches(c("locator"), c("src"))) > 0)),
        ("RELATION_PRIVATE_DEPENDENCY", t.isin(*schemas.CONTENT_DEPENDENCIES) & (c("f_visibility") == "public") & (c("t_visibility") == "private")),
        ("RELATION_DUPLICATE", c("nth") > 1),
    ]
    codes = F.explode(F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for code, broken in rules))))
    return all_findings(orphans, untargeted, findings(known.withColumn("code_", codes), c("code_"), object_id="from_id", section_id="to_section_id", details=F.when(c("code_") == "RELATION_LOCATOR_MISMATCH", F.create_map(F.lit("fields"), locator_mismatches(c("locator"), c("src"))))))


def check_cardinality(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Literature notes need a summary edge; mature or public syntheses need two targets."""
    n = edges.where("relation_type in ('summarizes', 'synthesizes')").groupBy("from_id", "relation_type").agg(F.count("*").alias("n"))
    wants = F.when(F.col("subtype") == "literature", "summarizes").otherwise("synthesizes")
    rows = objects.where("kind = 'note' and subtype in ('literature', 'synthesis')").withColumn("wants", wants)
    rows = rows.join(n, (F.col("id") == F.col("from_id")) & (F.col("wants") == F.col("relation_type")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    grown = F.col("maturity").isin("mature", "evergreen") | (F.col("visibility") == "public")
    return findings(rows, F.when((F.col("subtype") == "literature") & (F.col("n") < 1), "LITERATURE_SUMMARY_MISSING").when((F.col("subtype") == "synthesis") & grown & (F.col("n") < 2), "SYNTHESIS_TARGETS_INSUFFICIENT"))


def scan(objects: DataFrame, bodies: DataFrame, edges: DataFrame, sections: DataFrame, parsed: Sequence[DataFrame] = (), roots: Roots = Roots()) -> DataFrame:
    """All findings, with the path of the object they are about; sort with ``order_findings``."""
    first, _ = dedupe_objects(objects)
    kept, _ = dedupe_shards(edges)
    found = all_findings(
        *parsed, check_duplicates(objects, edges), check_source_identity(first), check_notes(first), check_snippets_and_artifacts(first), check_locators(bodies, kept), check_bodies(bodies),
        check_layout(first, kept, roots), check_snippet_sources(first), check_facts(bodies, first), check_artifacts(bodies, first, sections), check_relations(kept, first, sections), check_cardinality(kept, first),
    )
    at = first.select(F.col("id").alias("object_id"), F.col("path").alias("own_path"))
    return found.join(at, "object_id", "left").withColumn("path", F.coalesce("path", "own_path")).select([f.split()[0] for f in ("code", "severity", "category", "message", "path", "object_id", "section_id", "details")])


def pointers(objects: DataFrame, bodies: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, target): what each object's rules look up elsewhere: cited sources, artifacts, a snippet's source, inputs, and the ends of its edges."""
    cited = _cited(bodies)
    parts = (
        cited.select("object_id", "c.source_id"), cited.select("object_id", "artifact_id"), objects.select("id", "source_id"), objects.select("id", F.explode("input_refs").alias("r")).select("id", "r.object_id"),
        edges.select("from_id", "to_id"),
    )
    rows = reduce(DataFrame.unionByName, (p.toDF("id", "target") for p in parts))
    return rows.where("target is not null and id is not null").distinct()


def rescan(
    before: DataFrame, changed: DataFrame, old_objects: DataFrame, old_edges: DataFrame, objects: DataFrame, bodies: DataFrame, edges: DataFrame, sections: DataFrame, parsed: Sequence[DataFrame] = (), roots: Roots = Roots()
) -> DataFrame:
    """What ``scan`` finds in the present rows, from the findings ``before`` and the changed paths (path).

    ``old_objects`` (path, id) and ``old_edges`` (path, from_id) are those of before; ``parsed`` are
    the findings of parsing the changed files.  A rule's finding belongs to the object that it
    names, so the objects to judge anew are those of changed files, before or after, and those
    that point at one of them.  These are scanned with what they point at, whose own findings
    are not taken; findings of all other objects stay.  Unchanged rows are read to find who
    points where, not judged.
    """
    paths = changed.select("path").distinct()
    at = lambda df, key: df.join(paths, "path", "left_semi").select(F.col(key).alias("id"))
    touched = at(old_objects, "id").unionByName(at(objects, "id")).unionByName(at(old_edges, "from_id")).unionByName(at(edges, "from_id")).distinct()
    links = pointers(objects, bodies, edges).persist(StorageLevel.DISK_ONLY)
    anew = touched.unionByName(links.join(touched.withColumnRenamed("id", "target"), "target", "left_semi").select("id")).distinct().persist(StorageLevel.DISK_ONLY)
    near = anew.unionByName(links.join(anew, "id", "left_semi").select(F.col("target").alias("id"))).distinct().persist(StorageLevel.DISK_ONLY)
    own = lambda df, ids, key: df.join(ids.withColumnRenamed("id", key), key, "left_semi").select(df.columns)
    # Written, so that the rules' plans start from them.
    judged = (stored(own(*x)) for x in ((objects, near, "id"), (bodies, anew, "object_id"), (edges, anew, "from_id"), (sections, near, "object_id")))
    found = scan(*judged, (), roots)
    rules = before.where("object_id is not null").join(anew.withColumnRenamed("id", "object_id"), "object_id", "left_anti").unionByName(own(found, anew, "object_id"))
    read = before.where("object_id is null").join(paths, "path", "left_anti").select(rules.columns)
    return all_findings(rules, read, *parsed).select(before.columns)
