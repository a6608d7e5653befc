"""Files of a knowledge base: reading, parsing, rendering, and the projection's tables on disk."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import schemas
from quire.functions.text import checksum, finding_category
from quire.sources.contract import CITATION, PREFIXES, SHARD, Bad, Stamp, check_object, check_sections, kind_of, list_of, need, object_id, one_of


@dataclass(frozen=True)
class Roots:
    """Folders of a vault, relative to its root."""

    sources: str = "sources"
    notes: str = "notes"
    snippets: str = "snippets"
    ai_artifacts: str = "ai"
    relations: str = "relations"

    def all(self) -> tuple[str, ...]:
        return (self.sources, self.notes, self.snippets, self.ai_artifacts, self.relations)


def read_files(spark: SparkSession, root: str, roots: Roots = Roots()) -> DataFrame:
    """(path, checksum, content) of every file below the roots; paths are relative to ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(f"{root.rstrip('/')}/{{{','.join(roots.all())}}}")
    relative = F.regexp_extract("path", rf"/((?:{'|'.join(map(re.escape, roots.all()))})/.*)$", 1)
    return files.select(relative.alias("path"), checksum(F.col("content")).alias("checksum"), "content")


#: PyYAML with libyaml, where it is there; it is some six times as fast.
_QUICK_LOADER, _QUICK_DUMPER = getattr(yaml, "CSafeLoader", yaml.SafeLoader), getattr(yaml, "CSafeDumper", yaml.SafeDumper)
#: Characters that libyaml and PyYAML's own parser don't take in the same way everywhere.
_APART = re.compile(r"[\t\\\x7f-\x9f\u2028\u2029\ufeff]")


class _Loader(yaml.SafeLoader):
    """Dates and times stay text, but are told from other text."""


class _QuickLoader(_QUICK_LOADER):
    """The same by libyaml."""


for _l in (_Loader, _QuickLoader):
    _l.add_constructor("tag:yaml.org,2002:timestamp", lambda loader, node: Stamp(node.value))


def yaml_loaded(text: str, quick: type = _QUICK_LOADER, own: type = yaml.SafeLoader) -> object:
    """What ``own`` loads or raises; texts that ``quick`` takes in the same way are loaded by it."""
    if not _APART.search(text) and not ("?" in text and re.search(r"[\[{]", text)):
        try:
            return yaml.load(text, quick)  # noqa: S506
        except (yaml.YAMLError, ValueError, TypeError, RecursionError):
            pass  # the other parser has the last word on errors
    return yaml.load(text, own)  # noqa: S506


def yaml_dumped(data: object, **how) -> str:
    """What ``yaml.safe_dump`` gives, by libyaml where its text is the same."""
    how = {"allow_unicode": True, "sort_keys": False} | how
    out = yaml.dump(data, Dumper=_QUICK_DUMPER, **how)
    return out if out.isascii() and "\\" not in out else yaml.safe_dump(data, **how)


def _load(text: str, code: str = "FRONTMATTER_INVALID") -> object:
    try:
        return yaml_loaded(text, _QuickLoader, _Loader)
    except (yaml.YAMLError, ValueError, TypeError, RecursionError) as error:
        raise Bad(code, str(error).split("\n")[0]) from error


def _decoded(content: bytes, code: str) -> str:
    """The text of a file, lines ended by line feeds only."""
    try:
        return bytes(content).decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError as error:
        raise Bad(code, "not UTF-8") from error


#: The patterns of the file format, frontmatter and the marker and heading of a section.
FRONTMATTER = r"\A---\r?\n(.*?)\r?\n---(?:\r?\n|\Z)(.*)\Z"
SECTION = r"<!--\s*{prefix}:section\s+id=(sec_[a-z0-9][a-z0-9_-]{{2,63}})\s+role=([a-z]+)\s*-->\s*\n##\s+([^\r\n]+)"


def _front(text: str) -> tuple[dict, str]:
    m = re.match(FRONTMATTER, text, re.DOTALL)
    if m is None:
        raise Bad("FRONTMATTER_MISSING", "no frontmatter")
    data = _load(m[1])
    need(isinstance(data, dict), "FIELD_INVALID", "frontmatter must be a mapping")
    return data, m[2]


def _blocks(text: str, section: str, kind: str, prefix: str) -> list[dict]:
    """Blocks of a fact or ai section: a comment with YAML, then the text up to the next such comment after an empty line."""
    opening = re.compile(rf"<!--\s*{prefix}:{kind}\r?\n(.*?)\r?\n-->\s*", re.DOTALL)
    marks = [m for m in opening.finditer(text) if re.search(r"(?:\A|(?:\r?\n){2})\Z", text[: m.start()])]
    if text[: marks[0].start() if marks else len(text)].strip():
        raise Bad("NOTE_BLOCK_METADATA_MISSING", section)
    out = []
    for m, end in zip(marks, [*(n.start() for n in marks[1:]), len(text)], strict=True):
        meta, own = _load(m[1]), text[m.end() : end].strip()
        need(isinstance(meta, dict), "FIELD_INVALID", "block metadata must be a mapping")
        need(own, "NOTE_BLOCK_METADATA_MISSING", section)
        cited = meta.get("citations", []) if kind == "fact" else []
        list_of(CITATION)(cited, "citations")
        need(cited or kind == "ai", "FACT_CITATION_MISSING", section)
        if kind == "ai":
            object_id(meta.get("artifact_id"), "artifact_id")
            need(kind_of(meta["artifact_id"]) == "ai_artifact", "AI_ARTIFACT_INVALID", section)
        out.append({"kind": kind, "text": own, "artifact_id": meta["artifact_id"] if kind == "ai" else None, "citations": cited})
    return out


def note_sections(body: str, prefix: str = schemas.MARKER) -> list[dict]:
    """Sections of a note body in order, each with its blocks.

    A section begins with a comment ``prefix:section id=sec_x role=fact`` and a ``##`` heading
    below it; text before the first isn't part of any.  In fact and ai sections each block
    begins with a comment ``prefix:fact`` that holds its citations, or ``prefix:ai`` with the
    artifact's id, in YAML; any other text is an error there.
    """
    mark = re.compile(SECTION.format(prefix=re.escape(prefix)))
    marks, out = list(mark.finditer(body)), []
    for m, end in zip(marks, [*(n.start() for n in marks[1:]), len(body)], strict=False):
        section, role, text = m[1], m[2], body[m.end() : end].strip()
        one_of(schemas.ROLES)(role, "section role")
        if role in ("human", "evolution"):
            blocks = [{"kind": role, "text": text, "artifact_id": None, "citations": []}] if text else []
        else:
            blocks = _blocks(text, section, role, prefix)
        need(m[3].strip(), "NOTE_BLOCK_ROLE_MISMATCH", section)
        out.append({"section_id": section, "role": role, "heading": m[3].strip(), "blocks": blocks})
    return out


_PARSED = "path string, checksum string, data string, text string, sections string, code string, message string"


def parse_objects(files: DataFrame, roots: Roots = Roots(), prefix: str = schemas.MARKER, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, bodies, findings) of the files outside the relations folder.

    Objects have the columns of ``schemas.OBJECTS``, bodies (object_id, kind, text, sections);
    a file with an error is one finding with its first error and nothing else.  ``keep`` may write
    what is parsed, since all three are made from it.
    """

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, check, content in zip(frame["path"], frame["checksum"], frame["content"], strict=True):
                row = dict.fromkeys(("data", "text", "sections", "code", "message")) | {"path": path, "checksum": check}
                try:
                    need(path.lower().endswith(".md"), "OBJECT_LAYOUT_INVALID", "not a Markdown file")
                    data, body = _front(_decoded(content, "OBJECT_READ_FAILED"))
                    kind = check_object(data)
                    data = dict(data)
                    data["subtype"] = data.pop({"source": "source_type", "note": "note_type", "ai_artifact": "artifact_type"}.get(kind, ""), None)
                    if kind == "snippet":
                        data["snippet_path"] = data.pop("path")
                    if kind == "note":
                        sections = note_sections(body, prefix)
                        check_sections(sections)
                        row["sections"] = json.dumps(sections)
                    else:
                        row["text"] = body.strip()
                    row["data"] = json.dumps(data)
                except Bad as error:
                    row["code"], row["message"] = error.args
                rows.append(row)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _PARSED.split(", ")])

    documents = files.where(~F.col("path").startswith(roots.relations + "/")).select("path", "checksum", "content")
    wide = T.StructType.fromDDL(schemas.OBJECTS)
    parsed = documents.mapInPandas(kernel, _PARSED).select("path", "checksum", F.from_json("data", wide).alias("record"), "text", F.from_json("sections", schemas.BODY).alias("sections"), "code", "message")
    parsed = keep(parsed)
    good, record = parsed.where("code is null"), F.col("record")
    objects = good.select(*((F.col(f.name) if f.name in ("path", "checksum") else record[f.name]).alias(f.name) for f in wide))
    bodies = good.select(record["id"].alias("object_id"), record["kind"].alias("kind"), "text", "sections")
    return objects, bodies, _findings(parsed)


def _findings(parsed: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return parsed.where("code is not null").select(
        "code", F.lit("error").alias("severity"), finding_category(F.col("code")).alias("category"), "message", "path", none.alias("object_id"), none.alias("section_id"), F.lit(None).cast("map<string,array<string>>").alias("details")
    )


#: A scalar that YAML reads as just this text.
_WORD = r"(?!(?i:yes|no|true|false|on|off|null)\n)[A-Za-z_][A-Za-z0-9_./-]*"
_ID = rf"(?:{'|'.join(PREFIXES)})_[0-9A-HJKMNP-TV-Z]{{26}}"
_MOMENT = r"(?!0000)[0-9]{4}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z"
#: The beginning of a relation file as ``render_relation_shards`` writes it, and an edge in it whose every value is sound; other files are read by the YAML parser.
_SHARD_HEAD = rf"schema_version: {schemas.RELATION_VERSION}\nfrom_id: ({_ID})\nrelations:\n- "
_IN_LOCATOR = lambda **fields: "".join(f"(?:    {k}: {_WORD}\n)?" if v is None else f"    {k}: {v}\n" for k, v in fields.items())
_LOCATORS = "|".join((
    _IN_LOCATOR(figure=None, locator_version=schemas.LOCATOR_VERSION, page="[1-9][0-9]{0,8}", page_label=None, section=None, source_type="paper", table=None),
    _IN_LOCATOR(commit=_WORD, locator_version=schemas.LOCATOR_VERSION, path=_WORD, repository_host=_WORD, repository_path=_WORD, source_type="oss", symbol=_WORD),
))
_SOUND_EDGE = (
    rf"\Ato_id: {_ID}\n(?:  to_section_id: sec_[a-z0-9][a-z0-9_-]{{2,63}}\n)?  relation_type: (?:{'|'.join(schemas.RELATIONS)})\n(?:  locator:\n(?:{_LOCATORS}))?(?:  reason: {_WORD}\n)?"
    rf"  created_at: '{_MOMENT}'\n  actor:\n    id: {_WORD}\n    type: (?:human|system)\n\z"
)


def parse_relation_shards(files: DataFrame, roots: Roots = Roots(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(relations, findings) of ``relations/<from_id>.yaml`` files.

    Files in the form in which ``render_relation_shards`` writes plain values are cut and read by
    column expressions; only the others reach the YAML parser.  ``keep`` may write what is parsed,
    since both results are made from it.
    """

    @F.pandas_udf("data string, code string, message string")
    def read(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for path, content in zip(paths, contents, strict=True):
            row = dict.fromkeys(("data", "code", "message"))
            try:
                if content is not None:
                    folder, _, name = path.rpartition("/")
                    need(folder == roots.relations and name.lower().endswith(".yaml"), "RELATION_LAYOUT_INVALID", "relations lie in one folder of YAML files")
                    data = _load(_decoded(content, "RELATION_READ_FAILED"), "RELATION_PARSE_FAILED")
                    SHARD(data, "relation shard")
                    row["data"] = json.dumps([{"from_id": data["from_id"], **r} for r in data["relations"]])
            except Bad as error:
                row["code"], row["message"] = error.args
            rows.append(row)
        return pd.DataFrame(rows, columns=["data", "code", "message"])

    row = T.StructType.fromDDL(schemas.RELATION_ROWS)
    inner = T.StructType([f for f in row if f.name != "path"])
    text = F.decode("content", "UTF-8")
    head = F.regexp_extract(F.substring(text, 1, 200), rf"\A{_SHARD_HEAD}", 0)
    cut = F.when((head != "") & F.col("path").rlike(rf"\A{re.escape(roots.relations)}/[^/]+\.yaml\z") & text.endswith("\n"), F.transform(F.split(F.substring(text, F.length(head) + 1, F.length(text) - F.length(head) - 1), r"\n- "), lambda e: F.concat(e, F.lit("\n"))))
    whole = files.where(F.col("path").startswith(roots.relations + "/")).select("path", "checksum", "content", F.regexp_extract(head, _SHARD_HEAD, 1).alias("own"), cut.alias("cut"))
    whole = whole.withColumn("cut", F.when(F.forall("cut", lambda e: e.rlike(_SOUND_EDGE)), F.col("cut")))
    parsed = keep(whole.withColumn("read", read("path", F.when(F.col("cut").isNull(), F.col("content")))).select("path", "own", "cut", "read.*"))
    none = lambda t: F.lit(None).cast(t)
    edge = F.coalesce(F.transform("cut", lambda e: F.struct(e.alias("e"), none(inner).alias("r"))), F.transform(F.from_json("data", T.ArrayType(inner)), lambda r: F.struct(none("string").alias("e"), r.alias("r"))))
    edges = parsed.where("code is null").select("path", "own", F.explode(edge).alias("x")).select("path", "own", "x.*")
    edges = edges.withColumn("m", F.str_to_map(F.col("e"), F.lit("\n *"), F.lit(": ?")))
    at = lambda k, t="string": F.try_element_at("m", F.lit(k)).cast(t)
    fields = {f.name: (at(f.name, f.dataType)).alias(f.name) for f in inner if isinstance(f.dataType, T.StringType)} | {"from_id": F.col("own"), "created_at": F.substring(at("created_at"), 2, 20)}
    fields["locator"] = F.when(at("locator_version").isNotNull(), F.struct(*((at(f.name, f.dataType) if f.dataType.simpleString() in ("string", "int") else none(f.dataType)).alias(f.name) for f in inner["locator"].dataType)))
    fields["actor"] = F.struct(*(at(f.name).alias(f.name) for f in inner["actor"].dataType))
    return edges.select("path", *(F.when(F.col("e").isNotNull(), fields[f.name]).otherwise(F.col("r")[f.name]).alias(f.name) for f in inner)), _findings(parsed)


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where the session is one process."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows written below the shared folder and read again: what is built on them starts from there, also where an executor was lost."""
    at = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


#: Tables that are hashed to buckets, and by which column.
BUCKETED = {"segments": "segment_id", "postings": "term", "trigrams": "trigram", "line_blocks": "block_id", "score_blocks": "term"}
#: Bucketed tables with very frequent keys, by which other column a bucket is dealt to several tasks, and to how many.
SPREAD = {"score_blocks": ("block", 8)}
#: Bucketed tables of large rows, which stay in the tasks that make them: each writes to its buckets.
UNMOVED = ("line_blocks",)
#: How a change takes rows out of a table: the list of keys that names them, and the table's column with that key.
OUT_BY = {
    "objects": ("objects", "id"), "details": ("objects", "id"), "type_transitions": ("objects", "object_id"), "sections": ("objects", "object_id"), "segments": ("objects", "object_id"), "object_tags": ("objects", "object_id"),
    "search_fields": ("objects", "object_id"), "relations": ("shards", "from_id"), "citations": ("segments", "segment_id"), "postings": ("segments", "segment_id"), "segment_stats": ("segments", "segment_id"), "scan_state": ("paths", "path"),
}
#: Tables of a few rows, which every change holds whole.
WHOLE = ("corpus_stats", "index_metadata")
_VERSIONS = "version string, tables array<string>, buckets int, at timestamp, parts array<string>"


def overlaid(name: str, parts: Sequence[DataFrame], gone: DataFrame) -> DataFrame:
    """A table from its base and the rows that later changes added, in order.

    ``gone`` (list, key, n) takes a key's rows out of all parts before the n-th.  Document
    frequencies are differences and are summed.
    """
    if name in WHOLE:
        return parts[-1]
    if name == "term_stats":
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    which, key = OUT_BY[name]
    rows = reduce(DataFrame.unionByName, (p.withColumn("part_", F.lit(i)) for i, p in enumerate(parts)))
    keys = gone.where(F.col("list") == which).select(F.col("key").alias("key_"), "n")
    return rows.join(keys, (F.col(key) == F.col("key_")) & (F.col("part_") < F.col("n")), "left_anti").drop("part_")


def _write(tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], at: str, buckets: int) -> None:
    """Writes the tables in order; one may be a function of those written before it."""
    written = {}
    for name, df in tables.items():
        if callable(df):
            df = df(written)
        spark = df.sparkSession
        if name in BUCKETED:
            df = df.withColumn("bucket", bucket_of(F.col(BUCKETED[name]), buckets))
            if name in UNMOVED:
                pass
            elif name in SPREAD:
                by, ways = SPREAD[name]
                df = df.repartition(buckets * ways, "bucket", bucket_of(F.col(by), ways))
            else:
                df = df.repartition(buckets, "bucket")
            df = df.sortWithinPartitions("bucket", BUCKETED[name])
            df.write.partitionBy("bucket").parquet(f"{at}/{name}")
        else:
            df.write.parquet(f"{at}/{name}")
        written[name] = spark.read.schema(df.schema).parquet(f"{at}/{name}")


def _list_version(spark: SparkSession, out: str, version: str, tables: Sequence[str], buckets: int, parts: Sequence[str]) -> None:
    row = spark.createDataFrame([(version, sorted(tables), buckets, list(parts))], "version string, tables array<string>, buckets int, parts array<string>")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{out}/versions")


def _fresh(spark: SparkSession) -> str:
    return spark.range(1).select(F.expr("uuid()")).first()[0]


def write_projection(tables: dict[str, DataFrame], out: str, buckets: int = 64, sound: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Writes all tables below a new version folder and adds it to ``versions`` once it is complete and ``sound``, given the written tables, raises nothing.

    Nothing is deleted or replaced: readers take the newest complete version, and those of an
    older one are not disturbed.
    """
    spark = next(iter(tables.values())).sparkSession
    version = _fresh(spark)
    _write(tables, f"{out}/{version}", buckets)
    if sound is not None:
        sound({name: spark.read.parquet(f"{out}/{version}/{name}") for name in tables})
    _list_version(spark, out, version, list(tables), buckets, [version])
    return version


def write_changes(added: dict[str, DataFrame], gone: DataFrame, out: str, sound: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
    """Writes what an update adds, and the keys (list, key) whose older rows it takes out, below a new version that names the folders of the rest.

    An update of any size touches most buckets of terms, so no older bucket is written again: a
    reader leaves the rows of ``gone`` out.  ``sound`` sees the tables as they would be read.
    """
    spark = gone.sparkSession
    now = newest(spark, out)
    version = _fresh(spark)
    _write(added | {"gone": gone.select("list", "key").distinct()}, f"{out}/{version}", now["buckets"])
    parts = [*now["parts"], version]
    if sound is not None:
        sound(_tables(spark, out, now["tables"], now["buckets"], parts))
    _list_version(spark, out, version, now["tables"], now["buckets"], parts)
    return version


def compact(spark: SparkSession, out: str) -> str:
    """Writes the newest version's tables whole, so that a reader has one folder to read again."""
    return write_projection(read_projection(spark, out), out, newest(spark, out)["buckets"])


def newest(spark: SparkSession, out: str) -> dict:
    """The newest complete version: its name, tables, number of buckets and the versions it is made of, oldest first."""
    row = spark.read.schema(_VERSIONS).parquet(f"{out}/versions").orderBy(F.desc("at"), "version").first().asDict()
    return row | {"parts": row["parts"] or [row["version"]]}


def read_projection(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the newest complete version; bucketed ones keep ``bucket``, which knows how many there are (``pruned``)."""
    now = newest(spark, out)
    return _tables(spark, out, now["tables"], now["buckets"], now["parts"])


def _tables(spark: SparkSession, out: str, names: Sequence[str], buckets: int, parts: Sequence[str]) -> dict[str, DataFrame]:
    tables = {name: spark.read.parquet(f"{out}/{parts[0]}/{name}") for name in names}
    if len(parts) > 1:
        # A change may have no row for a table in buckets, and so no file to take a schema from.
        later = lambda name: [spark.read.schema(tables[name].schema).parquet(f"{out}/{v}/{name}") for v in parts[1:]]
        gone = reduce(DataFrame.unionByName, (spark.read.schema("list string, key string").parquet(f"{out}/{v}/gone").withColumn("n", F.lit(i)) for i, v in enumerate(parts) if i))
        tables |= {name: overlaid(name, [tables[name], *later(name)], gone) for name in names if name != "tags"}
        if "tags" in names:
            tables["tags"] = tables["object_tags"].select("tag").distinct()
    return {name: df.withMetadata("bucket", {"buckets": buckets}) if name in BUCKETED else df for name, df in tables.items()}


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pruned(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table, without ``bucket``, read from the buckets of ``keys`` (one column) only, where it has buckets.

    Only the buckets' numbers reach the driver, of which there are as many as the table has at most.
    """
    if "bucket" not in table.columns:
        return table
    if n := table.schema["bucket"].metadata.get("buckets"):
        some = keys.select(bucket_of(F.col(keys.columns[0]), n).alias("b")).distinct().collect()
        table = table.where(F.col("bucket").isin([r["b"] for r in some]))
    return table.drop("bucket")


def projection_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of the given tables."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in sorted(tables.items())]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


#: Keys that documents of a kind have even without a value.
NULLABLE = {"note": ("type_history",), "ai_artifact": ("prompt_ref", "reviewed_by", "reviewed_at")}


@F.pandas_udf(T.StringType())
def _document(data: pd.Series, body: pd.Series) -> pd.Series:
    def one(d: str, b: str | None) -> str:
        fields = json.loads(d)
        # keys that are required even where they have no value
        fields = {k: fields.get(k, [] if k == "type_history" else None) for k in NULLABLE.get(fields["kind"], ())} | {k: v for k, v in fields.items() if v is not None}
        return "---\n" + yaml_dumped(fields) + "---\n" + (f"\n{b}\n" if b else "")

    return pd.Series([one(d, b) for d, b in zip(data, body, strict=True)])


def render_objects(objects: DataFrame, bodies: DataFrame, prefix: str = schemas.MARKER) -> DataFrame:
    """(path, content): each object as a document that parses back to the same row and body."""
    names = [c for c in objects.columns if c not in ("path", "checksum", "subtype", "snippet_path")]
    own = [F.col(f"o.`{c}`").alias(c) for c in names]
    subtype = [F.when(F.col("o.kind") == k, F.col("o.subtype")).alias(n) for k, n in (("source", "source_type"), ("note", "note_type"), ("ai_artifact", "artifact_type"))]
    block = lambda b: F.when(b["kind"].isin("fact", "ai"), F.concat(F.lit(f"<!-- {prefix}:"), b["kind"], F.lit("\n"), F.to_json(F.struct(b["artifact_id"].alias("artifact_id"), F.when(b["kind"] == "fact", b["citations"]).alias("citations"))), F.lit("\n-->\n"), b["text"])).otherwise(b["text"])
    section = lambda s: F.concat(F.lit(f"<!-- {prefix}:section id="), s["section_id"], F.lit(" role="), s["role"], F.lit(" -->\n\n## "), s["heading"], F.lit("\n\n"), F.array_join(F.transform(s["blocks"], block), "\n\n"))
    body = F.coalesce(F.concat(F.lit("# "), F.col("o.title"), F.lit("\n\n"), F.array_join(F.transform("b.sections", section), "\n\n")), F.col("b.text"))
    rows = objects.alias("o").join(bodies.alias("b"), F.col("o.id") == F.col("b.object_id"), "left")
    data = F.to_json(F.struct(*own, *subtype, F.col("o.snippet_path").alias("path")))
    return rows.select("o.path", _document(data, body).alias("content"))


def render_relation_shards(relations: DataFrame) -> DataFrame:
    """(from_id, content): one YAML file for each start, edges in the order of their key.

    Edges are written apart from each other; those with plain values and no nested locator by
    column expressions, which give what ``yaml.safe_dump`` would.
    """
    names = ("to_id", "to_section_id", "relation_type", "locator", "reason", "created_at", "actor")
    loc, actor = (relations.schema[c].dataType for c in ("locator", "actor"))

    @F.pandas_udf("string")
    def dumped(s: pd.Series) -> pd.Series:
        return s.map(lambda d: yaml_dumped([json.loads(d)]), na_action="ignore")

    line = lambda name, value, inset="  ": F.concat(F.lit(f"{inset}{name}: "), value.cast("string"), F.lit("\n"))
    maybe = lambda name, value, inset="  ": F.coalesce(line(name, value, inset), F.lit(""))
    nested = [f.name for f in loc if f.dataType.simpleString() not in ("string", "int")]
    values = [F.col(c) for c in names if c not in ("locator", "actor")] + [F.col("actor")[f.name] for f in actor] + [F.col("locator")[f.name] for f in loc if f.dataType.simpleString() == "string"]
    inside = F.concat(*(maybe(f.name, F.col("locator")[f.name], "    ") for f in loc if f.name not in nested))
    where = F.when(F.col("locator").isNull(), "").otherwise(F.concat(F.lit("  locator:\n"), inside))
    text = F.concat(
        line("to_id", F.col("to_id"), ""), maybe("to_section_id", F.col("to_section_id")), line("relation_type", F.col("relation_type")), where, maybe("reason", F.col("reason")),
        line("created_at", F.concat(F.lit("'"), "created_at", F.lit("'"))), F.lit("  actor:\n"), *(line(f.name, F.col("actor")[f.name], "    ") for f in actor),
    )
    simple = reduce(lambda a, c: a & F.col("locator")[c].isNull(), nested, ~F.contains(F.concat_ws("", *values), F.lit("\n")))
    rows = relations.withColumn("text", text).withColumn("plain", F.when(F.col("text").rlike(_SOUND_EDGE) & simple, F.concat(F.lit("- "), "text")))
    one = F.coalesce("plain", dumped(F.when(F.col("plain").isNull(), F.to_json(F.struct(*names)))))
    rows = rows.select("from_id", "to_id", F.coalesce("to_section_id", F.lit("")).alias("section"), "relation_type", F.to_json("locator").alias("key"), one.alias("text"))
    rows = rows.groupBy("from_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("to_id", "section", "relation_type", "key", "text"))), lambda x: x["text"]).alias("edges"))

    @F.pandas_udf("string")
    def head(s: pd.Series) -> pd.Series:
        return s.map(lambda d: yaml_dumped({"schema_version": schemas.RELATION_VERSION} | ({} if d is None else {"from_id": d})) + "relations:\n")

    return rows.select("from_id", F.concat(head("from_id"), F.array_join("edges", "")).alias("content"))
