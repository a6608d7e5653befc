"""Locators: canonical JSON and mismatch with the source that they point into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.identity import normalize_isbn

SNAPSHOT = "struct<captured_at:string,content_hash:string,identifier:string,provider:string>"
#: One struct for all source types, fields in alphabetical order so that to_json is canonical.
LOCATOR = (
    f"struct<chapter:string,commit:string,edition:string,end_line:int,figure:string,heading_path:array<string>,isbn:string,location:string,locator_version:int,page:int,page_label:string,"
    f"paragraph:int,path:string,repository_host:string,repository_path:string,section:string,snapshot_ref:{SNAPSHOT},source_type:string,start_line:int,symbol:string,table:string>"
)


def locator_json(locator: Column) -> Column:
    """Sorted keys, absent fields left out; an empty heading path counts as absent; '' without a locator."""
    path = F.when(F.size(locator["heading_path"]) > 0, locator["heading_path"])
    return F.coalesce(F.to_json(locator.withField("heading_path", path)), F.lit(""))


def locator_mismatches(locator: Column, source: Column) -> Column:
    """array of the fields in which a locator disagrees with its source (a struct of source columns)."""
    differs = lambda a, b: ~a.eqNullSafe(b)
    kind = locator["source_type"]
    snap, own = locator["snapshot_ref"], source["snapshot_ref"]
    name = lambda n, when: F.when(when, F.lit(n))
    web = [name(f"snapshot_ref.{f}", own.isNull() | differs(snap[f], own[f])) for f in ("provider", "identifier")]
    moment = lambda x: F.coalesce(x.try_cast("timestamp").cast("string"), x)
    web += [name("snapshot_ref.captured_at", own.isNull() | differs(moment(snap["captured_at"]), moment(own["captured_at"]))), name("snapshot_ref.content_hash", own.isNull() | differs(snap["content_hash"], own["content_hash"]))]
    book = [name("isbn", locator["isbn"].isNotNull() & differs(locator["isbn"], normalize_isbn(source["isbn"]))), name("edition", locator["edition"].isNotNull() & differs(locator["edition"], source["edition"]))]
    host = lambda x: F.lower(F.regexp_replace(x, r"\.$", ""))
    oss = [name("repository_host", differs(host(locator["repository_host"]), host(source["repository_host"])))] + [name(f, differs(locator[f], source[f])) for f in ("repository_path", "commit")]
    none = F.array().cast("array<string>")
    return (
        F.when(differs(kind, source["subtype"]), F.array(F.lit("source_type")))
        .when(kind == "web", F.array_compact(F.array(*web))).when(kind == "book", F.array_compact(F.array(*book))).when(kind == "oss", F.array_compact(F.array(*oss)))
        .otherwise(none)
    )
