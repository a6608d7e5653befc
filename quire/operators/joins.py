"""Lookups by id, alias, identifier and parent (JO1-JO4, JO7)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import identity as idn


#: Hubs known by broadcast at most; of more the joins are left to the optimizer, which splits skewed ones.
BROADCAST_HUBS = 100_000


def get_objects(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing ids): each object with its body nested; its relations come apart (``edge_parts``), since a hub may have millions.

    Children are filtered to the wanted ids before they are gathered; a body is as long as its file.
    """
    wanted = ids.select("id").distinct()
    found = tables["objects"].join(wanted, "id", "left_semi")
    of = lambda df, key: df.join(wanted.withColumnRenamed("id", key), key, "left_semi")
    segs = of(tables["segments"], "object_id").select("segment_id", "object_id", "section_id", "role", "ordinal", "text")
    cited = tables["citations"].join(segs.select("segment_id"), "segment_id", "left_semi").groupBy("segment_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "source_id", "locator"))).alias("citations"))
    places = of(tables["sections"], "object_id").select("object_id", "section_id", F.col("ordinal").alias("place"), "heading")
    body = segs.join(cited, "segment_id", "left").join(places, ["object_id", "section_id"], "left").groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("place", "ordinal", "section_id", "role", "heading", "text", "citations"))).alias("body"))
    return found.join(body.withColumnRenamed("object_id", "id"), "id", "left"), wanted.join(tables["objects"].select("id"), "id", "left_anti")


def edge_parts(relations: DataFrame, ids: DataFrame, size: int = 1000) -> DataFrame:
    """(id, direction, part, edges): the edges at the ids in arrays of at most ``size``, sorted within a part by type, ends, section and locator.

    Objects with more edges are hubs: theirs are dealt by hash to as many salts as they have full
    parts, and a salt's surplus is cut off into further parts.  Only counts, summed where the
    edges lie, tell a hub; an object without edges has no row.
    """
    wanted = ids.select("id").distinct()
    edge = F.struct("relation_type", "from_id", "to_id", "to_section_id", "locator").alias("edge")
    at = lambda direction, end: relations.select(F.col(end).alias("id"), F.lit(direction).alias("direction"), edge).join(wanted, "id", "left_semi")
    rows = at("outgoing", "from_id").unionByName(at("incoming", "to_id"))
    hubs = rows.groupBy("id", "direction").agg(F.count("*").alias("n")).where(F.col("n") > size).select("id", "direction", F.ceil(F.col("n") / size).alias("salts")).persist(StorageLevel.DISK_ONLY)
    few = hubs.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS
    rows = rows.join(F.broadcast(hubs) if few else hubs, ["id", "direction"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("edge"), "salts"))
    nth = F.row_number().over(Window.partitionBy("id", "direction", "salt").orderBy("edge")) - 1
    rows = rows.withColumn("part", (F.col("salt") + F.col("salts") * F.floor(nth / size)).cast("int"))
    return rows.groupBy("id", "direction", "salt", "part").agg(F.array_sort(F.collect_list("edge")).alias("edges")).select("id", "direction", "part", "edges")


def list_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, from_id, to_id, relation_type, to_section_id) of all edges at the ids, one row each whatever their number."""
    wanted = ids.select("id").distinct()
    cols = ["id", "direction", "from_id", "to_id", "relation_type", "to_section_id"]
    out = relations.join(wanted, F.col("from_id") == F.col("id")).withColumn("direction", F.lit("outgoing")).select(cols)
    into = relations.join(wanted, F.col("to_id") == F.col("id")).withColumn("direction", F.lit("incoming")).select(cols)
    return out.unionByName(into).orderBy("id", "direction", "from_id", "to_id", "relation_type", "to_section_id")


def alias_hits(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, n_sources, first_id, n_types, source_type): how many sources, and types of them, share an alias with each request.

    Two least and greatest ids and types tell one from several, so nothing is gathered.
    """
    a = requests.select("request_id", F.explode("aliases").alias("alias"))
    b = sources.select(F.col("id").alias("source_id"), F.col("subtype").alias("source_type"), F.explode("aliases").alias("alias"))
    several = lambda c: F.when(F.min(c) == F.max(c), 1).otherwise(2)
    return a.join(b, "alias").groupBy("request_id").agg(several("source_id").alias("n_sources"), F.min("source_id").alias("first_id"), several("source_type").alias("n_types"), F.min("source_type").alias("source_type"))


def match_aliases(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """(request_id, source_ids): sources that share an alias with a request; both sides carry ``aliases``."""
    a = requests.select("request_id", F.explode("aliases").alias("alias"))
    b = sources.select(F.col("id").alias("source_id"), F.explode("aliases").alias("alias"))
    return a.join(b, "alias").groupBy("request_id").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def exact_candidates(requests: DataFrame, metadata: DataFrame) -> DataFrame:
    """(request_id, item_key): metadata items whose identifier equals a request's, in normal form.

    requests: request_id, doi, arxiv, isbn, url (normalised); metadata: item_key, doi, arxiv_id, isbn, url as found.
    """
    wish = requests.select("request_id", F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(p), F.col(c))) for c, p in (("doi", "doi:"), ("arxiv", "arxiv:"), ("isbn", "isbn:"), ("url", "url:")))))).alias("alias"))
    tagged = lambda p, c: F.when(c.isNotNull(), F.array(F.concat(F.lit(p), c))).otherwise(F.array().cast("array<string>"))
    books = F.coalesce(F.transform(idn.isbn_values(F.col("isbn")), lambda x: F.concat(F.lit("isbn:"), x)), F.array().cast("array<string>"))
    have = F.concat(tagged("doi:", idn.normalize_doi(F.col("doi"))), tagged("arxiv:", idn.normalize_arxiv(F.col("arxiv_id"))["base"]), books, tagged("url:", idn.canonicalize_url(F.col("url"))))
    return wish.join(metadata.select("item_key", F.explode(have).alias("alias")), "alias").select("request_id", "item_key").distinct()


#: What an attachment brings along, where the children have it.
CARRIED = ("version", "filename", "size", "sha256")


def _single(items: DataFrame, children: DataFrame, eligible: Column, none: str, several: str) -> DataFrame:
    """(item_key, child_key, code, what is CARRIED): the only eligible attachment of each item."""
    carried = [c for c in CARRIED if c in children.columns]
    first = F.min(F.struct(F.col("item_key").alias("child"), *carried)).alias("c")
    per = children.where(F.col("item_type") == "attachment").where(eligible).groupBy("parent_key").agg(F.count("*").alias("n"), first)
    rows = items.select("item_key").distinct().join(per, F.col("item_key") == F.col("parent_key"), "left")
    only = lambda c: F.when(F.col("n") == 1, F.col(f"c.{c}"))
    return rows.select("item_key", only("child").alias("child_key"), F.when(F.col("n").isNull(), none).when(F.col("n") > 1, several).alias("code"), *(only(c).alias(c) for c in carried))


def select_primary_attachment(items: DataFrame, children: DataFrame) -> DataFrame:
    """(item_key, child_key, code, ...): the only PDF of each item; none or several are coded.

    children: parent_key, item_key, item_type, filename, content_type, link_mode and what is
    ``CARRIED``.  A PDF is an attachment with a file name, stored or linked, that has the PDF
    type or a name that ends in ``.pdf``.  The only one's name must not be a path.
    """
    named = F.coalesce(F.col("filename"), F.lit("")) != ""
    pdf = F.col("content_type").eqNullSafe("application/pdf") | F.lower("filename").endswith(".pdf")
    out = _single(items, children, named & pdf, "PAPER_ATTACHMENT_UNAVAILABLE", "PAPER_ATTACHMENT_AMBIGUOUS")
    unsafe = F.col("filename").contains("/") | F.col("filename").isin(".", "..")
    return out.withColumns({"code": F.when(unsafe, "ZOTERO_RESPONSE_INVALID").otherwise(F.col("code")), "child_key": F.when(~unsafe, F.col("child_key"))})


def select_web_snapshot(items: DataFrame, children: DataFrame) -> DataFrame:
    """(item_key, child_key, code, ...): the only stored HTML or XHTML snapshot of each web page; any other number, or another kind of item, is coded."""
    html = F.col("content_type").isin("text/html", "application/xhtml+xml") & (F.col("link_mode") == "imported_url")
    out = _single(items, children, html, "ZOTERO_ITEM_UNAVAILABLE", "ZOTERO_ITEM_UNAVAILABLE")
    kinds = items.select("item_key", F.col("item_type").alias("kind_")).distinct()
    page = F.coalesce(F.col("kind_") == "webpage", F.lit(False))
    out = out.join(kinds, "item_key").withColumns({"child_key": F.when(page, F.col("child_key")), "code": F.when(page, F.col("code")).otherwise("ZOTERO_ITEM_UNAVAILABLE")})
    return out.drop("kind_")
