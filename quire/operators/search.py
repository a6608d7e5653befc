"""Ranked literal search, public scope, context bundles and grep (SE1-SE6, FI1-FI3, JO5, JO6)."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schemas
from quire.functions import text as tx
from quire.functions.locators import LOCATOR, locator_mismatches
from quire.schemas import MARKER
from quire.sources.vault import pruned, stored

K1, B = 1.2, 0.75
DEFAULT_ROLES = ("source", "human", "fact", "snippet")
#: Terms of all queries up to which they are broadcast to the postings.
BROADCAST_TERMS = 200_000
#: Blocks of postings that are searched first, as a multiple of the limit.
FIRST_BLOCKS = 2
#: Characters of all queries that are looked for in one pass over the lines, about.
BROADCAST_CHARS = 1_000_000


@dataclass(frozen=True)
class SearchFilters:
    """Filters of a search; None doesn't filter.  Values outside the closed sets are an error."""

    kind: str | None = None
    subtype: str | None = None
    visibility: str | None = None
    record_status: str | None = None
    workflow_stage: str | None = None
    maturity: str | None = None
    review_status: str | None = None
    role: str | None = None
    tags: Sequence[str] | None = None

    def __post_init__(self):
        allowed = {
            "kind": schemas.KINDS, "subtype": (*schemas.SOURCE_TYPES, *schemas.NOTE_TYPES, *schemas.ARTIFACT_TYPES), "visibility": schemas.VISIBILITIES, "record_status": schemas.STATUSES,
            "workflow_stage": schemas.STAGES, "maturity": schemas.MATURITIES, "review_status": schemas.REVIEWS, "role": schemas.SEARCH_ROLES,
        }
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "tags":
                if value is not None and (not value or len(set(value)) < len(value) or not all(value)):
                    raise ValueError("SEARCH_FILTER_INVALID: tags")
            elif value is not None and value not in allowed[f.name]:
                raise ValueError(f"SEARCH_FILTER_INVALID: {f.name}")


def filter_all_tags(objects: DataFrame, tags: Sequence[str] | None, column: str = "tags") -> DataFrame:
    """Objects that carry every one of the tags."""
    for tag in tags or ():
        objects = objects.where(F.array_contains(column, tag))
    return objects


def apply_search_filters(df: DataFrame, filters: SearchFilters = SearchFilters(), statuses: Sequence[str] | None = None) -> DataFrame:
    """Rows with object columns and a ``role`` that pass the filters and the default rules.

    ``statuses`` overrides the filters' status; without either only active records; without a role sources, human text, facts and
    snippets, or AI text if kind is ai_artifact; evolution only when asked for.
    """
    for name in ("kind", "subtype", "visibility", "workflow_stage", "maturity", "review_status"):
        value = getattr(filters, name)
        if value is not None:
            df = df.where(F.col(name) == value)
    df = df.where(F.col("record_status").isin(*(statuses or [filters.record_status or "active"])))
    if filters.role is not None:
        df = df.where(F.col("role") == filters.role)
    else:
        df = df.where(F.col("role") == "ai" if filters.kind == "ai_artifact" else F.col("role").isin(*DEFAULT_ROLES))
    return filter_all_tags(df, filters.tags)


def query_terms(queries: DataFrame, fold_diacritics: bool = True) -> DataFrame:
    """(query_id, term, times, n_terms): the words of each query, all required; operators are words too.  A query without a word has no row."""
    text = tx.normalized(F.col("query"))
    words = tx.tokenize(tx.folded(text) if fold_diacritics else text, normal=True)
    rows = queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    return rows.withColumn("n_terms", F.count("*").over(Window.partitionBy("query_id")))


def bm25(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """One term's share of the score, negative; rarer terms count more, never less than 1e-6."""
    idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.0))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    return -(idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / average)))


def matches(index: dict[str, DataFrame], queries: DataFrame, fold_diacritics: bool = True) -> DataFrame:
    """(query_id, segment_id, score): segments that hold every term of a query, better ones lower.

    A query's candidates are the segments with its rarest term; the postings of its other terms
    are looked up for these segments only, by term and segment, so that a frequent term never
    sends its postings to every query that has it.  Of postings in buckets only those of the
    terms are read.  Query terms are broadcast while their number is small.  Scores are rounded to nine digits so that their sum's order is no matter.
    """
    terms, small = _known_terms(index, queries, fold_diacritics)
    postings = pruned(index["postings"], terms.select("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
    rarest = postings.join(small(terms.where("place = 1").select("query_id", "term", "times", "df", "n_terms")), "term")
    others = terms.where("place > 1").select("query_id", "term", "times", "df")
    looked = rarest.where("n_terms > 1").select("query_id", "segment_id", "n_terms").join(small(others), "query_id").join(postings, ["term", "segment_id"])
    hits = rarest.unionByName(looked).join(index["segment_stats"], "segment_id").crossJoin(F.broadcast(index["corpus_stats"]))
    return _scored(hits)


def _known_terms(index: dict[str, DataFrame], queries: DataFrame, fold_diacritics: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The terms of the queries whose terms all occur, with df and their place by rarity; and what marks tables of them as small, if they are."""
    terms = query_terms(queries, fold_diacritics).persist(StorageLevel.DISK_ONLY)  # read at every step of a search
    few = terms.count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda df: df
    known = small(terms.select("term").distinct()).join(index["term_stats"], "term")
    by_rarity = Window.partitionBy("query_id").orderBy("df", "term")
    return terms.join(known, "term").withColumns({"place": F.row_number().over(by_rarity), "present": F.count("*").over(Window.partitionBy("query_id"))}).where("present = n_terms"), small


def _scored(hits: DataFrame) -> DataFrame:
    """(query_id, segment_id, score) of the segments that have a hit for each term."""
    share = F.col("times") * bm25(F.col("tf"), F.col("df"), F.col("n_segments"), F.col("n_tokens"), F.col("avg_tokens"))
    scored = hits.groupBy("query_id", "segment_id", "n_terms").agg(F.count("*").alias("found"), F.round(F.sum(share), 9).alias("score"))
    return scored.where("found = n_terms").select("query_id", "segment_id", "score")


def bounded_matches(index: dict[str, DataFrame], queries: DataFrame, accept: Callable[[DataFrame], DataFrame], limit: int, fold_diacritics: bool = True) -> tuple[DataFrame, DataFrame]:
    """The accepted matches among which each query's best ``limit`` are, and the blocks (query_id, block, bound, n) they come from.

    ``index`` needs ``score_blocks``.  A query's blocks are those in which all its terms occur, and
    the best score possible in one follows from its terms' highest tf and least length.  The blocks
    with the best bounds are searched first; if they give ``limit`` matches that ``accept`` keeps,
    blocks whose bound is worse than the last of these are left out, ties never.  Other queries
    search all their blocks, so results are those of ``matches``.
    """
    terms, small = _known_terms(index, queries, fold_diacritics)
    stats = F.broadcast(index["corpus_stats"])
    blocks = pruned(index["score_blocks"], terms.select("term"))
    best = F.col("times") * bm25(F.col("most"), F.col("df"), F.col("n_segments"), F.col("shortest"), F.col("avg_tokens"))
    asked = terms.select("query_id", "term", "times", "df", "n_terms")
    possible = blocks.drop("hits").join(small(asked), "term").crossJoin(stats).groupBy("query_id", "block", "n_terms").agg(F.count("*").alias("found"), F.sum(best).alias("bound"), F.sum("n").alias("n"))
    possible = possible.where("found = n_terms").drop("found", "n_terms").persist(StorageLevel.DISK_ONLY)

    def found(chosen: DataFrame) -> DataFrame:
        wanted = chosen.select("query_id", "block").join(small(asked), "query_id")
        hits = blocks.select("term", "block", "hits").join(wanted, ["term", "block"]).select("query_id", "times", "df", "n_terms", F.inline("hits")).crossJoin(stats)
        return accept(_scored(hits))

    by_bound, by_score = (Window.partitionBy("query_id").orderBy(*c) for c in (("bound", "block"), ("score",)))
    first = possible.withColumn("nth", F.row_number().over(by_bound)).where(F.col("nth") <= FIRST_BLOCKS * limit)
    last = found(first).withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= limit).where(F.col("nth") == limit).select("query_id", F.col("score").alias("last"))
    # scores are rounded to nine digits, bounds are not
    chosen = possible.join(last, "query_id", "left").where(F.col("last").isNull() | (F.col("bound") <= F.col("last") + 1e-8)).drop("last")
    return found(chosen), chosen


def bounded_search(index: dict[str, DataFrame], queries: DataFrame, filters: SearchFilters = SearchFilters(), scope: str = "local", limit: int = 20, fold_diacritics: bool = True) -> DataFrame:
    """The rows of ``search``, from an index that also holds ``score_blocks``: postings that can't be among a query's best are not scored."""
    _check_search(filters, scope, limit)

    def accept(hits: DataFrame) -> DataFrame:
        rows = apply_search_filters(described(hits, index), filters)
        return public_safe(rows, index) if scope == "public" else rows

    return shown(with_text(ranked(bounded_matches(index, queries, accept, limit, fold_diacritics)[0], limit), index))


def _order() -> list[Column]:
    return [F.col("score"), F.col("object_id"), F.when(F.col("section_id") == "__body__", "").otherwise(F.col("section_id")), F.col("ordinal"), F.col("segment_id")]


def ranked(hits: DataFrame, limit: int) -> DataFrame:
    """Adds rank from 1 by score, object, public section id and ordinal, and keeps ``limit`` a query."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*_order()))).where(F.col("rank") <= limit)


def _check_search(filters: SearchFilters, scope: str, limit: int) -> None:
    if not 1 <= limit <= 200:
        raise ValueError("SEARCH_QUERY_INVALID")
    if scope == "public" and (filters.role == "ai" or filters.kind == "ai_artifact"):
        raise ValueError("SEARCH_QUERY_INVALID: AI in public scope")


def search(index: dict[str, DataFrame], queries: DataFrame, filters: SearchFilters = SearchFilters(), scope: str = "local", limit: int = 20, fold_diacritics: bool = True) -> DataFrame:
    """Ranked hits of a table of queries (query_id, query).

    ``index`` holds the projection's tables.  In ``public`` scope hits are audited before the
    limit, and asking for AI text is an error.
    """
    _check_search(filters, scope, limit)
    found = apply_search_filters(matched(index, queries, fold_diacritics), filters)
    if scope == "public":
        found = public_safe(found, index)
    return shown(with_text(ranked(found, limit), index))


def with_text(hits: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Adds the texts of the hits that were kept."""
    return hits.join(index["segments"].select("segment_id", "text"), "segment_id")


def invalid_queries(queries: DataFrame) -> DataFrame:
    """(query_id, code) of the queries without a word, which have no row among the hits."""
    return queries.join(query_terms(queries).select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("SEARCH_QUERY_INVALID").alias("code"))


def matched(index: dict[str, DataFrame], queries: DataFrame, fold_diacritics: bool = True) -> DataFrame:
    """Matches with the columns of their segment, but for its text, and object."""
    return described(matches(index, queries, fold_diacritics), index)


def described(hits: DataFrame, index: dict[str, DataFrame]) -> DataFrame:
    """Hits with the columns of their segment, but for its text, and object."""
    return hits.join(index["segments"].drop("text", "bucket"), "segment_id").join(index["objects"].withColumnRenamed("id", "object_id"), "object_id")


def shown(hits: DataFrame) -> DataFrame:
    """Hits as they are given out: the body of an object is no section."""
    return hits.withColumn("section_id", F.when(F.col("section_id") != "__body__", F.col("section_id")))


def enrich_hits(hits: DataFrame, object_tags: DataFrame, citations: DataFrame) -> DataFrame:
    """Adds sorted tags and the citations in order to each hit."""
    tags = object_tags.groupBy("object_id").agg(F.array_sort(F.collect_list("tag")).alias("tag_list"))
    own = citations.join(hits.select("segment_id").distinct(), "segment_id", "left_semi").groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_id", "locator"))).alias("citation_list"))
    none = F.array()
    out = hits.join(tags, "object_id", "left").join(own, "segment_id", "left")
    return out.withColumn("tag_list", F.coalesce("tag_list", none.cast("array<string>"))).withColumn("citation_list", F.coalesce("citation_list", none.cast(out.schema["citation_list"].dataType)))


def audit_citations(segments: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(segment_id, code, n_citations): the first unsafe citation's code of each segment, null if all are safe."""
    s = sources.where("kind = 'source'").select(F.col("id").alias("source_id"), F.struct(*(F.col(c) for c in ("subtype", "visibility", "record_status", "license", "snapshot_ref", "isbn", "edition", "repository_host", "repository_path", "commit"))).alias("src"))
    rows = segments.select("segment_id").join(citations, "segment_id").join(s, "source_id", "left")
    src, loc = F.col("src"), F.from_json("locator", LOCATOR)
    code = (
        F.when(src.isNull(), "PUBLIC_CITATION_UNRESOLVED")
        .when((src["visibility"] != "public") | (src["record_status"] != "active"), "PUBLIC_CITATION_SOURCE_UNSAFE")
        .when((src["subtype"] == "web") & src["snapshot_ref"].isNull(), "PUBLIC_SNAPSHOT_REQUIRED")
        .when((src["subtype"] == "oss") & (src["license"] == "NOASSERTION"), "PUBLIC_RIGHTS_UNRESOLVED")
        .when(loc["source_type"].isNull() | (F.size(locator_mismatches(loc, src)) > 0), "PUBLIC_PROVENANCE_INCOHERENT")
    )
    return rows.withColumn("code", code).groupBy("segment_id").agg(F.min_by("code", F.when(F.col("code").isNotNull(), F.col("ordinal"))).alias("code"), F.count("*").alias("n_citations"))


def public_exclusion(hits: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Adds ``public_code``: the first reason against a hit in public scope, null if there is none.

    ``tables`` needs ``details`` (the wide objects) and ``citations``.  The hits are read twice, so
    they are written once; a search isn't run again for its segments' citations.
    """
    hits = stored(hits)
    details = tables["details"]
    own = details.select(F.col("id").alias("object_id"), F.struct("id", "kind", "subtype", "visibility", "record_status", "license", "snapshot_ref", "publication_approved", "source_id", "repository_host", "repository_path", "commit").alias("obj"))
    parent = details.where("kind = 'source'").select(F.col("id").alias("parent_id"), F.struct("visibility", "record_status", "subtype", "license", "repository_host", "repository_path", "commit").alias("src"))
    audit = audit_citations(hits.select("segment_id").distinct(), tables["citations"], details).select("segment_id", F.col("code").alias("citation_code"), "n_citations")
    rows = hits.join(own, "object_id", "left").join(audit, "segment_id", "left").join(parent, F.col("obj.source_id") == F.col("parent_id"), "left")
    o, s = F.col("obj"), F.col("src")
    snippet = o["kind"] == "snippet"
    source = o["kind"] == "source"
    apart = lambda f: ~o[f].eqNullSafe(s[f])
    code = (
        F.when(o.isNull(), "PUBLIC_OBJECT_UNRESOLVED").when(o["visibility"] != "public", "PUBLIC_VISIBILITY_REQUIRED").when(o["record_status"] != "active", "PUBLIC_ACTIVE_REQUIRED")
        .when(F.col("role") == "ai", "PUBLIC_AI_EXCLUDED").when((F.col("role") == "fact") & F.col("n_citations").isNull(), "PUBLIC_FACT_CITATION_REQUIRED")
        .when(source & (o["subtype"] == "web") & o["snapshot_ref"].isNull(), "PUBLIC_SNAPSHOT_REQUIRED").when(source & (o["subtype"] == "oss") & (o["license"] == "NOASSERTION"), "PUBLIC_RIGHTS_UNRESOLVED")
        .when(F.col("citation_code").isNotNull(), F.col("citation_code"))
        .when(snippet & ~F.coalesce(o["publication_approved"], F.lit(False)), "PUBLIC_SNIPPET_NOT_APPROVED").when(snippet & (o["license"] == "NOASSERTION"), "PUBLIC_RIGHTS_UNRESOLVED")
        .when(snippet & (s.isNull() | (s["visibility"] != "public") | (s["record_status"] != "active") | (s["subtype"] != "oss")), "PUBLIC_SNIPPET_SOURCE_UNSAFE")
        .when(snippet & (s["license"] == "NOASSERTION"), "PUBLIC_RIGHTS_UNRESOLVED").when(snippet & (apart("repository_host") | apart("repository_path") | apart("commit")), "PUBLIC_PROVENANCE_INCOHERENT")
    )
    return rows.withColumn("public_code", code).select(*hits.columns, "public_code")


def public_safe(hits: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The hits without a reason against them; those of private or inactive objects and AI text leave before the audit."""
    unsafe = (F.col("visibility") != "public") | (F.col("record_status") != "active") | (F.col("role") == "ai")
    hits = hits.where(~F.coalesce(unsafe, F.lit(False)))
    return public_exclusion(hits, tables).where("public_code is null").drop("public_code")


GROUP = {"source": "sources", "fact": "facts", "human": "human_notes", "snippet": "snippets"}


def budgeted(candidates: DataFrame, limit: int, max_chars: int) -> DataFrame:
    """Adds ``code`` and ``group`` to ranked candidates (query_id, rank, role, text, public_code).

    In rank order: after ``limit`` included ones all others are LIMIT_EXCEEDED; an unsafe one keeps
    its public code; the budget closes at the first eligible text that doesn't fit and never
    opens again; other roles are CONTEXT_ROLE_EXCLUDED.  Windows see one query's candidates.
    """
    by = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    eligible = F.col("public_code").isNull()
    rows = candidates.withColumn("used", F.sum(F.when(eligible, F.length("text")).otherwise(0)).over(by))
    fits = eligible & (F.col("used") <= max_chars)
    known = F.col("role").isin(*GROUP)
    rows = rows.withColumn("taken", F.sum(F.when(fits & known, 1).otherwise(0)).over(by))
    before = F.col("taken") - F.when(fits & known, 1).otherwise(0)
    code = F.when(before >= limit, "LIMIT_EXCEEDED").when(~eligible, F.col("public_code")).when(F.col("used") > max_chars, "CHARACTER_BUDGET_EXCEEDED").when(~known, "CONTEXT_ROLE_EXCLUDED")
    groups = F.create_map(*(F.lit(x) for pair in GROUP.items() for x in pair))
    return rows.withColumn("code", code).withColumn("group", F.when(F.col("code").isNull(), groups[F.col("role")])).drop("used", "taken")


def context(index: dict[str, DataFrame], queries: DataFrame, scope: str = "local", limit: int = 20, max_chars: int = 12_000, filters: SearchFilters = SearchFilters()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, exclusions, summary) for each query: the best texts in groups within a character budget.

    Candidates are the best 200 of active records; in public scope the best 200 of every record
    status, merged by rank, so that unsafe ones can be named.
    """
    if not 1 <= max_chars <= 100_000 or not 1 <= limit <= 200:
        raise ValueError("SEARCH_QUERY_INVALID")
    public = scope == "public"
    found = matched(index, queries)
    if public:  # one search for all statuses; each has candidates of its own
        found = apply_search_filters(found, filters, schemas.STATUSES)
        best = Window.partitionBy("query_id", "record_status").orderBy(*_order())
        found = ranked(found.withColumn("nth", F.row_number().over(best)).where("nth <= 200").drop("nth"), 200 * len(schemas.STATUSES))
    else:
        found = ranked(apply_search_filters(found, filters), 200)
    found = public_exclusion(found, index) if public else found.withColumn("public_code", F.lit(None).cast("string"))
    done = budgeted(shown(with_text(found, index)), limit, max_chars)
    items = done.where("code is null").select("query_id", "rank", "group", "segment_id", "object_id", "section_id", "role", "text", "score")
    exclusions = done.where("code is not null").select("query_id", "rank", "segment_id", "object_id", "section_id", "code")
    summary = done.groupBy("query_id").agg(F.count_if(F.col("code").isNull()).alias("n_items"), F.coalesce(F.sum(F.when(F.col("code").isNull(), F.length("text"))), F.lit(0)).alias("n_chars"), F.count_if(F.col("code").isNotNull()).alias("n_excluded"), (F.count_if(F.col("code").isin("LIMIT_EXCEEDED", "CHARACTER_BUDGET_EXCEEDED")) > 0).alias("truncated"))
    return items, exclusions, summary


def _columns(line: str, query: str) -> list[int]:
    """1-based places in the line at which the query stands in the line's normal form, without overlap.

    The place of a character of the normal form is the longest beginning of the line whose own
    normal form ends before it; that length never falls, so it is found by halving.
    """
    normal = lambda i: len(unicodedata.normalize("NFKC", line[:i]).casefold())
    whole, out = unicodedata.normalize("NFKC", line).casefold(), []
    at = whole.find(query)
    while at >= 0:
        out.append(at + 1 if line.isascii() else max(1, bisect_right(range(len(line) + 1), at, key=normal)))
        at = whole.find(query, at + max(1, len(query)))
    return out


def lines_with(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``rows`` joined with each query (query_id, q) whose q stands in their ``normal``.

    All queries are looked for at once by an automaton over them (Aho-Corasick), so a line is
    read once however many there are.  Queries are taken in blocks of about ``BROADCAST_CHARS``
    characters, dealt by their hash; more queries take more passes over the lines.
    """
    spark = rows.sparkSession
    chars = wanted.agg(F.sum(F.length("q") + 8)).first()[0] or 0
    blocks = max(1, -(-chars // BROADCAST_CHARS))
    texts = wanted.select("q").distinct().withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    hits = [_hits(rows, spark.sparkContext.broadcast([r["q"] for r in texts.where(F.col("block") == i).select("q").collect()])) for i in range(blocks)]
    return reduce(DataFrame.unionByName, hits).join(wanted, "q")


def _hits(rows: DataFrame, queries) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for q in queries.value:
            automaton.add_word(q, q)
        if queries.value:
            automaton.make_automaton()
        for batch in batches:
            found = [sorted({q for _, q in automaton.iter(x)}) if queries.value and x else [] for x in batch.column(place).to_pylist()]
            at = [i for i, f in enumerate(found) for _ in f]
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([q for f in found for q in f], pa.string())], [*batch.schema.names, "q"])

    place = rows.columns.index("normal")
    return rows.mapInArrow(kernel, T.StructType([*rows.schema.fields, T.StructField("q", T.StringType())]))


def grep(files: DataFrame, queries: DataFrame, limit: int = 20, prefix: str = MARKER) -> DataFrame:
    """(query_id, path, line, column, excerpt, object_id, section_id, rank): literal occurrences, line by line.

    ``files`` is (path, text, object_id).  Only lines that hold a query reach the helper that maps
    places back to the source line.  The section is that of the last marker above, in Markdown
    files only; a file's few markers ride along with its lines.
    """
    return _placed(lines_with(_lines(files, prefix), _wanted(queries, limit)).withColumn("section_id", _section(F.col("line"))), limit)


def _wanted(queries: DataFrame, limit: int) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("SEARCH_QUERY_INVALID")
    return queries.select("query_id", tx.normalize_query(F.col("query")).alias("q")).where("q is not null")


def _whole(files: DataFrame, prefix: str) -> DataFrame:
    """(path, object_id, lines, marks) of every file: its lines, and the places and ids of its section markers."""
    mark = rf"<!--\s*{prefix}:section\s+id=(sec_[a-z0-9][a-z0-9_-]{{2,63}})\s"
    whole = files.select("path", "object_id", tx.lines(F.col("text")).alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, mark, 1).alias("id"))), lambda m: m["id"] != "")
    return whole.withColumn("marks", F.when(F.col("path").endswith(".md"), marks))


def _lines(files: DataFrame, prefix: str) -> DataFrame:
    """(path, object_id, marks, n, source, line, normal) of every line."""
    return _whole(files, prefix).select("path", "object_id", "marks", F.posexplode("lines").alias("n", "source")).withColumns({"line": F.col("n") + 1, "normal": tx.normalized(F.col("source"))})


def _section(line: Column) -> Column:
    return F.try_element_at(F.filter("marks", lambda m: m["i"] < line), F.lit(-1))["id"]


def _placed(hits: DataFrame, limit: int) -> DataFrame:
    @F.pandas_udf("array<int>")
    def places(line: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([_columns(a, b) for a, b in zip(line, query, strict=True)])

    found = hits.withColumn("column", F.explode(places("source", "q"))).withColumn("excerpt", F.trim("source"))
    order = Window.partitionBy("query_id").orderBy("path", "line", "column")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "path", "line", "column", "excerpt", "object_id", "section_id", "rank")


#: Lines of a file that the trigram index holds together.
BLOCK_LINES = 32
#: Trigrams of a query that a block must hold before its lines are read.
RAREST = 3
#: Low bits of a block's number that a list of blocks keeps; the others are the list's group.
GROUP_BITS = 15
#: Characters of blocks whose trigrams are gathered at a time, about.
GATHERED_CHARS = 2_000_000


def _codes(text: str) -> np.ndarray:
    """The distinct runs of three characters within the text's lines, each as a number."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    within = (c[:-2] != 10) & (c[1:-1] != 10) & (c[2:] != 10)
    return np.unique((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[within])


def _lists(ids: list[int], codes: list[np.ndarray]) -> pa.RecordBatch:
    """(trigram, grp, at): for each trigram and group of blocks the blocks that hold it."""
    trigram, block = np.concatenate(codes), np.repeat(np.array(ids, np.int64), [len(c) for c in codes])
    order = np.lexsort((block, trigram))
    trigram, block = trigram[order], block[order]
    first = np.flatnonzero(np.append(True, (trigram[1:] != trigram[:-1]) | (block[1:] >> GROUP_BITS != block[:-1] >> GROUP_BITS))) if len(block) else np.empty(0, np.int64)
    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(block)), pa.int32()), pa.array((block & (1 << GROUP_BITS) - 1).astype(np.int16)))
    return pa.RecordBatch.from_arrays([pa.array(trigram[first]), pa.array(block[first] >> GROUP_BITS), at], ["trigram", "grp", "at"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, codes, chars = [], [], 0
    for batch in batches:
        for block, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(block.as_py())
            codes.append(_codes(text))
            chars += len(text)
            if chars > GATHERED_CHARS:
                yield _lists(ids, codes)
                ids, codes, chars = [], [], 0
    if ids:
        yield _lists(ids, codes)


def grep_index(files: DataFrame, prefix: str = MARKER) -> dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]]:
    """line_blocks(block_id, path, object_id, lines), trigrams(trigram, grp, at), trigram_stats(trigram, df): what ``grep_indexed`` reads.

    To be written with ``write_projection``, which makes the trigrams from the written blocks, and
    their statistics from the written trigrams.  Blocks are cut from a file's own row and stay
    where it is; a list ``at`` holds the numbers within ``grp`` of the blocks with a trigram, so only short lists are shuffled.
    """
    # Markers are found in the file's row, before it is cut; so they are not looked for again in each block.
    cut = F.transform(F.sequence(F.lit(1), F.size("lines"), F.lit(BLOCK_LINES)), lambda i: F.slice("lines", i, BLOCK_LINES))
    blocks = _whole(files, prefix).where(F.size("lines") > 0).select("path", "object_id", "marks", F.posexplode(cut).alias("k", "lines"))
    line = F.transform("lines", lambda x, i: F.struct((F.col("k") * BLOCK_LINES + i + 1).alias("line"), x.alias("source"), _section(F.col("k") * BLOCK_LINES + i + 1).alias("section_id")))
    blocks = blocks.select("path", "object_id", line.alias("lines"), F.monotonically_increasing_id().alias("block_id"))

    def trigrams(written: dict[str, DataFrame]) -> DataFrame:
        texts = written["line_blocks"].select("block_id", tx.normalized(F.array_join("lines.source", "\n")).alias("normal"))
        return texts.mapInArrow(_gathered, "trigram long, grp long, at array<short>")

    return {"line_blocks": blocks, "trigrams": trigrams, "trigram_stats": lambda written: written["trigrams"].groupBy("trigram").agg(F.sum(F.size("at")).alias("df"))}


def candidate_lines(index: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """(path, object_id, line, source, section_id, normal) of the blocks that hold the rarest trigrams of some query (query_id, q).

    A query of which a trigram is nowhere reads nothing.
    """

    @F.pandas_udf("array<long>")
    def trigrams(queries: pd.Series) -> pd.Series:
        # a line break is in no line, so its own number is kept, which is nowhere
        return queries.map(lambda q: np.append(_codes(q), 10) if "\n" in q else _codes(q))

    grams = wanted.select("q").distinct().select("q", F.explode(trigrams("q")).alias("trigram"))
    grams = grams.withColumn("n", F.count("*").over(Window.partitionBy("q"))).persist(StorageLevel.DISK_ONLY)  # read at every step below
    small = F.broadcast if grams.count() <= BROADCAST_TERMS else lambda df: df
    known = small(grams.select("trigram").distinct()).join(index["trigram_stats"], "trigram")
    by_rarity = Window.partitionBy("q").orderBy("df", "trigram")
    picks = grams.join(known, "trigram").withColumns({"place": F.row_number().over(by_rarity), "present": F.count("*").over(Window.partitionBy("q"))}).where((F.col("present") == F.col("n")) & (F.col("place") <= RAREST))
    picks = picks.select("trigram", F.xxhash64("q").alias("asked"), F.least("n", F.lit(RAREST)).alias("n"))  # queries with one hash would only read more blocks
    found = pruned(index["trigrams"], picks.select("trigram")).join(small(picks), "trigram")
    found = found.select("asked", "n", "grp", F.explode("at").alias("at")).select("asked", "n", (F.shiftleft("grp", GROUP_BITS) + F.col("at")).alias("block_id"))
    blocks = found.groupBy("asked", "block_id").agg(F.count("*").alias("held"), F.min("n").alias("n")).where(F.col("held") >= F.col("n")).select("block_id").distinct()
    return _block_lines(pruned(index["line_blocks"], blocks).join(blocks, "block_id", "left_semi"))


def _block_lines(blocks: DataFrame) -> DataFrame:
    return blocks.select("path", "object_id", F.explode("lines").alias("l")).select("path", "object_id", "l.*").withColumn("normal", tx.normalized(F.col("source")))


def grep_indexed(index: dict[str, DataFrame], queries: DataFrame, limit: int = 20) -> DataFrame:
    """What ``grep`` gives, from a trigram index (``grep_index``).

    Only blocks that hold a query's rarest trigrams are read, and the automaton verifies their
    lines.  Queries of fewer than three characters have no trigram: they read all lines.
    """
    wanted = _wanted(queries, limit)
    short = F.length("q") < 3
    hits = lines_with(candidate_lines(index, wanted.where(~short)), wanted.where(~short))
    brief = wanted.where(short)
    if not brief.isEmpty():
        hits = hits.unionByName(lines_with(_block_lines(index["line_blocks"].drop("bucket")), brief))
    return _placed(hits, limit)
