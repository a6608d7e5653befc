"""Schemas and closed value sets of the knowledge base."""

from __future__ import annotations

from quire.functions.locators import LOCATOR, SNAPSHOT

#: The closed sets of the data model.
KINDS = ("source", "note", "snippet", "ai_artifact")
SOURCE_TYPES = ("paper", "web", "book", "oss")
VISIBILITIES = ("private", "public")
STATUSES = ("active", "archived", "superseded")
STAGES = ("inbox", "reading", "processed", "integrated")
NOTE_TYPES = ("idea", "literature", "concept", "synthesis")
MATURITIES = ("seed", "developing", "mature", "evergreen")
ARTIFACT_TYPES = ("summary", "extraction", "relation_candidate", "draft")
REVIEWS = ("unreviewed", "accepted", "rejected", "promoted")
ROLES = ("human", "fact", "ai", "evolution")
SEARCH_ROLES = ("source", "human", "fact", "snippet", "ai", "evolution")
SEVERITIES = ("error", "warning")
RELATIONS = ("cites", "derived_from", "summarizes", "synthesizes", "supports", "contradicts", "related_to", "snippet_from", "promoted_from", "supersedes")
#: Relation type, kinds it may start from, kinds it may lead to.
RELATION_MATRIX = (
    ("cites", ("note",), ("source",)),
    ("summarizes", ("note",), ("source",)),
    ("synthesizes", ("note",), ("source", "note")),
    ("supports", ("source", "note"), ("note",)),
    ("contradicts", ("source", "note"), ("note",)),
    ("related_to", ("note",), ("note",)),
    ("snippet_from", ("snippet",), ("source",)),
    ("derived_from", ("note", "ai_artifact"), ("source", "note")),
    ("promoted_from", ("note",), ("ai_artifact",)),
    ("supersedes", KINDS, KINDS),
)
CONTENT_DEPENDENCIES = ("cites", "summarizes", "synthesizes", "supports", "contradicts", "snippet_from", "derived_from")
#: Folders below the roots of sources and notes.
SOURCE_FOLDERS = {"paper": "papers", "web": "web", "book": "books", "oss": "oss"}
NOTE_FOLDERS = {"idea": "ideas", "literature": "literature", "concept": "concepts", "synthesis": "syntheses"}
#: Versions of the contracts, and all that an index depends on.
OBJECT_VERSION, LOCATOR_VERSION, RELATION_VERSION = 2, 2, 2
VERSIONS = {"locator": "2", "object_contract": "2", "parser": "1", "projection": "2", "relation_schema": "2", "segment_algorithm": "1", "tokenizer": "1"}

#: Prefix of the comments that mark sections and blocks in note bodies, where none is given.
MARKER = "kb"

ACTOR = "struct<id:string,type:string>"
HISTORY = f"array<struct<actor:{ACTOR},changed_at:string,from:string,to:string>>"
#: All kinds in one wide row; columns of other kinds are null.
OBJECTS = (
    "id string, kind string, subtype string, path string, checksum string, schema_version int, title string, visibility string, record_status string, workflow_stage string, "
    "maturity string, review_status string, created string, updated string, tags array<string>, canonical_url string, doi string, arxiv_id string, arxiv_version int, isbn string, edition string, "
    f"captured_at string, snapshot_ref {SNAPSHOT}, repository_host string, repository_path string, default_branch string, `commit` string, license string, zotero_library_type string, "
    "zotero_library_id string, zotero_key string, zotero_item_version int, synced_at string, managed_fields_hash string, attachment_key string, attachment_version int, attachment_filename string, "
    f"attachment_media_type string, attachment_size long, attachment_sha256 string, year int, authors array<string>, type_history {HISTORY}, source_id string, snippet_path string, start_line int, "
    "end_line int, publication_approved boolean, input_refs array<struct<object_id:string,section_id:string>>, generated_by string, model string, prompt_ref string, reviewed_by string, reviewed_at string"
)
BODY = f"array<struct<section_id:string,role:string,heading:string,blocks:array<struct<kind:string,text:string,artifact_id:string,citations:array<struct<source_id:string,locator:{LOCATOR}>>>>>>"
RELATION_ROWS = f"path string, from_id string, to_id string, to_section_id string, relation_type string, locator {LOCATOR}, reason string, created_at string, actor {ACTOR}"
FINDINGS = "code string, severity string, category string, message string, path string, object_id string, section_id string, details map<string,array<string>>"
