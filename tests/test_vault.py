"""Files to tables and back, validation, incremental update, on a small vault."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators.index import build_postings, score_blocks
from quire.operators import bulk, catalog, joins, maintain, migrate, projection, search, validate
from quire.sources import vault
from quire.streaming import refresh

U = "0123456789ABCDEFGHJKMNPQR"
ID = {n: f"{p}_{U}{n[-1]}" for p, n in (("src", "web1"), ("src", "oss2"), ("note", "lit3"), ("note", "con4"), ("snip", "sn5"), ("ai", "art6"))}
HEAD = "schema_version: 2\nid: {id}\nkind: {kind}\ntitle: {title}\nvisibility: {vis}\nrecord_status: active\ncreated: 2024-01-01\n"
SNAP = '{"provider": "p", "identifier": "i", "captured_at": "2024-01-01T00:00:00Z", "content_hash": "sha256:h"}'


def doc(name, kind, extra, body, vis="public", dated=True):
    head = HEAD.format(id=ID[name], kind=kind, title=f"Title {name}", vis=vis) + ("updated: 2024-01-02\ntags: [alpha, beta]\n" if dated else "") + extra
    return f"---\n{head}---\n{body}\n"


def files():
    cite = '{"citations": [{"source_id": "%s", "locator": {"locator_version": 2, "source_type": "web", "heading_path": ["About"], "snapshot_ref": %s}}]}' % (ID["web1"], SNAP)
    return {
        "sources/web/w.md": doc("web1", "source", f"source_type: web\nworkflow_stage: inbox\ncanonical_url: https://x.org/\ncaptured_at: '2024-01-01T00:00:00Z'\nsnapshot_ref: {SNAP}\n", "About winter wheat"),
        "sources/oss/o.md": doc("oss2", "source", "source_type: oss\nworkflow_stage: reading\ncanonical_url: https://github.com/a/b\nrepository_host: github.com\nrepository_path: a/b\ncommit: c1\nlicense: MIT\n", ""),
        "notes/literature/l.md": doc("lit3", "note", "note_type: literature\nmaturity: mature\ntype_history: []\n", f"# Title\n\n<!-- kb:section id=sec_mine role=human -->\n## Mine\n\nMy own wheat words\n\n<!-- kb:section id=sec_facts role=fact -->\n\n## Facts\n\n<!-- kb:fact\n{cite}\n-->\nWheat is sown\n\n<!-- kb:fact\n{cite}\n-->\nRye\n\nis not\n"),
        "notes/ideas/c.md": doc("con4", "note", "note_type: concept\nmaturity: seed\ntype_history:\n- {from: idea, to: concept, changed_at: '2024-01-01T00:00:00Z', actor: {type: human, id: me}}\n", "<!-- kb:section id=sec_mine role=human -->\n## Mine\n\nConcept of rye\n"),
        "snippets/s.md": doc("sn5", "snippet", f"source_id: {ID['oss2']}\nrepository_host: github.com\nrepository_path: a/b\ncommit: c1\npath: f.py\nstart_line: 1\nend_line: 2\nlicense: MIT\npublication_approved: true\n", "wheat = 1"),
        "ai/a.md": doc("art6", "ai_artifact", f"artifact_type: summary\nreview_status: unreviewed\ninput_refs: [{{object_id: {ID['lit3']}, section_id: sec_mine}}]\ngenerated_by: g\nmodel: m\nprompt_ref: p\nreviewed_by: null\nreviewed_at: null\n", "AI wheat", "private", False),
        f"relations/{ID['lit3']}.yaml": f"schema_version: 2\nfrom_id: {ID['lit3']}\nrelations:\n- {{to_id: {ID['web1']}, relation_type: summarizes, reason: r, created_at: '2024-01-01T00:00:00Z', actor: {{type: human, id: me}}}}\n",
    }


def written(root, contents):
    for name, text in contents.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def parsed(spark, root):
    f = vault.read_files(spark, str(root)).cache()
    objects, bodies, bad = vault.parse_objects(f)
    edges, worse = vault.parse_relation_shards(f)
    return f, objects.cache(), bodies.cache(), edges.cache(), bad.unionByName(worse)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("vault")
    written(root, files())
    return parsed(spark, root)


def codes(found):
    return sorted((r.code, r.path) for r in found.select("code", "path").collect())


def scan(objects, bodies, edges, bad):
    return validate.scan(objects, bodies, edges, projection.project_sections(bodies), [bad])


def test_a_sound_vault_has_no_findings(small):
    f, objects, bodies, edges, bad = small
    assert codes(scan(objects, bodies, edges, bad)) == []
    assert catalog.is_healthy(bad)
    assert tuple(catalog.scan_summary(f, objects, edges, bad).first()) == (7, 6, 1, 0)


def test_projection_and_round_trip(spark, small, tmp_path):
    f, objects, bodies, edges, bad = small
    tables = maintain.rebuild(spark, f, objects, bodies, edges, bad, "now")
    assert {r.table_name: r.n for r in vault.projection_counts({k: tables[k] for k in ("objects", "sections", "segments", "citations", "relations", "scan_state", "type_transitions", "object_tags")}).collect()} == {
        "objects": 6, "sections": 7, "segments": 8, "citations": 2, "relations": 1, "scan_state": 7, "type_transitions": 1, "object_tags": 10}
    assert maintain.check_foreign_keys(tables).count() == 0
    vault.write_projection(tables, f"{tmp_path}/p", 4)
    back = vault.read_projection(spark, f"{tmp_path}/p")
    assert back["segments"].count() == 8
    for r in vault.render_objects(objects, bodies).collect():
        written(tmp_path / "again", {r.path: r.content})
    for r in vault.render_relation_shards(edges).collect():
        written(tmp_path / "again", {f"relations/{r.from_id}.yaml": r.content})
    _, o2, b2, e2, bad2 = parsed(spark, tmp_path / "again")
    assert codes(bad2) == []
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(objects.drop("checksum"), o2) and same(bodies, b2) and same(edges, e2)


def test_broken_files_give_their_first_error(spark, tmp_path):
    good = files()
    web = good["sources/web/w.md"]
    broken = {
        "sources/web/1.md": "no frontmatter", "sources/web/2.md": "---\n: [\n---\n", "sources/web/3.md": web.replace("title: Title web1\n", ""), "sources/web/4.md": web.replace("---\nschema", "---\nextra: 1\nschema", 1),
        "sources/web/5.md": web.replace("schema_version: 2", "schema_version: 3"), "sources/web/6.md": web.replace("src_", "note_"), "sources/web/7.md": web.replace(ID["web1"], "src_1"), "sources/web/8.txt": web, "sources/web/9.md": web.replace("visibility: public", "visibility: open"),
        "sources/papers/p.md": web, "relations/x.yaml": "schema_version: 2\nfrom_id: bad\nrelations: []\n",
    }
    written(tmp_path, good | broken)
    f, objects, bodies, edges, bad = parsed(spark, tmp_path)
    want = ["FRONTMATTER_MISSING", "FRONTMATTER_INVALID", "FIELD_MISSING", "FIELD_UNKNOWN", "OBJECT_VERSION_UNSUPPORTED", "OBJECT_KIND_MISMATCH", "OBJECT_ID_INVALID", "OBJECT_LAYOUT_INVALID", "FIELD_INVALID"]
    got = dict((p, c) for c, p in codes(bad))
    assert [got[p] for p in list(broken)[:9]] == want and got["relations/x.yaml"] == "OBJECT_ID_INVALID"
    rest = [c for c, _ in codes(scan(objects, bodies, edges, bad)) if c not in want or c == "OBJECT_LAYOUT_INVALID"]
    assert "OBJECT_ID_DUPLICATE" in rest


def test_a_rescan_equals_a_scan_for_removed_added_and_changed_targets(spark, tmp_path):
    old = files() | {"notes/ideas/twin.md": files()["notes/ideas/c.md"], "sources/web/broken.md": "no frontmatter"}
    old[f"relations/{ID['con4']}.yaml"] = f"schema_version: 2\nfrom_id: {ID['con4']}\nrelations:\n- {{to_id: {ID['lit3']}, to_section_id: sec_mine, relation_type: supports, reason: r, created_at: '2024-01-01T00:00:00Z', actor: {{type: human, id: me}}}}\n"
    new = dict(old)
    del new["sources/oss/o.md"], new["notes/ideas/twin.md"], new["sources/web/broken.md"]  # a snippet's source, a second file of an id, a file with an error
    new["sources/web/w.md"] = new["sources/web/w.md"].replace("visibility: public", "visibility: private").replace("sha256:h", "sha256:i")  # a literature note cites and summarizes it
    new["notes/literature/l.md"] = new["notes/literature/l.md"].replace("sec_mine", "sec_ours")  # an artifact and an edge name its section
    new["ai/none.md"] = "---\n: [\n---\n"
    written(tmp_path / "old", old)
    written(tmp_path / "new", new)
    states = [parsed(spark, tmp_path / name) for name in ("old", "new")]
    scans = [vault.stored(scan(o, b, e, bad)) for _, o, b, e, bad in states]
    rows = lambda df: sorted(map(str, df.collect()))
    assert {"SNIPPET_SOURCE_INVALID", "RELATION_PRIVATE_DEPENDENCY", "FACT_LOCATOR_MISMATCH", "AI_INPUT_SECTION_MISSING", "RELATION_SECTION_MISSING", "FRONTMATTER_INVALID"} <= {r.code for r in scans[1].collect()} - {r.code for r in scans[0].collect()}
    for i, j in ((0, 1), (1, 0)):
        (f, o, _, e, _), (g, now, b, links, bad) = states[i], states[j]
        changed = catalog.changed_paths(g, f)
        worse = bad.join(changed.select("path"), "path", "left_semi").select(bad.columns)
        got = validate.rescan(scans[i], changed, o, e, now, b, links, projection.project_sections(b), [worse])
        assert rows(got) == rows(scans[j].select(got.columns))


def test_only_sound_projections_are_published(spark, small, tmp_path):
    f, objects, bodies, edges, bad = small
    out = f"{tmp_path}/p"
    made = lambda **more: maintain.publish(spark, f, objects, bodies, more.pop("edges", edges), more.pop("bad", bad), out, "t", buckets=2, **more)
    with pytest.raises(ValueError, match="INDEX_SOURCE_INVALID"):
        made(bad=validate.findings(objects.limit(1), "FIELD_INVALID"))
    with pytest.raises(ValueError, match="INDEX_CORRUPT"):
        made(edges=edges.withColumn("to_id", F.lit("src_gone")))
    with pytest.raises(ValueError, match="INDEX_SOURCE_CHANGED"):
        made(again=lambda: f.where("path not like 'snippets%'"))
    assert not (tmp_path / "p" / "versions").exists()
    made(again=lambda: f)
    assert vault.read_projection(spark, out)["objects"].count() == 6


def test_incremental_equals_rebuild(spark, tmp_path):
    written(tmp_path / "old", files())
    f, objects, bodies, edges, bad = parsed(spark, tmp_path / "old")
    before = maintain.rebuild(spark, f, objects, bodies, edges, bad, "t")
    later = files()
    del later["snippets/s.md"]
    later["notes/ideas/c.md"] = later["notes/ideas/c.md"].replace("Concept of rye", "Concept of spelt and rye")
    written(tmp_path / "new", later)
    f2, o2, b2, e2, bad2 = parsed(spark, tmp_path / "new")
    state, changed = maintain.index_status(before, f2.select("path", "checksum"))
    with pytest.raises(ValueError, match="INDEX_SOURCE_CHANGED"):
        maintain.require_searchable(state, True)
    with pytest.raises(ValueError, match="INDEX_SOURCE_INVALID"):
        maintain.require_searchable(state, False)
    assert state == "stale" and sorted(r.change for r in changed.collect()) == ["changed", "removed"]
    touched = o2.join(changed.select("path"), "path", "left_semi")
    after = maintain.incremental_update(before, changed, touched, b2.join(touched.select(F.col("id").alias("object_id")), "object_id", "left_semi"), e2.limit(0), f2.select("path", "checksum"), "t")
    full = maintain.rebuild(spark, f2, o2, b2, e2, bad2, "t")
    for name in full:
        cols = full[name].columns
        assert sorted(map(str, after[name].select(cols).collect())) == sorted(map(str, full[name].collect())), name
    assert maintain.index_status(full, f2)[0] == "fresh" and maintain.index_status(full, f2, healthy=False)[0] == "stale" and maintain.index_status(None, f2)[0] == "missing"
    maintain.require_searchable("fresh", True)
    assert catalog.snapshot_digest(f2) == catalog.snapshot_digest(f2.repartition(5)) != catalog.snapshot_digest(f)


def test_incremental_equals_rebuild_after_moves_and_broken_files(spark, tmp_path):
    old, new = files(), files()
    new["notes/syntheses/moved.md"] = new.pop("notes/literature/l.md")
    new["sources/oss/o.md"] = "no frontmatter any more"
    written(tmp_path / "old", old)
    written(tmp_path / "new", new)
    before = maintain.rebuild(spark, *parsed(spark, tmp_path / "old"), "t")
    f, o, b, e, bad = parsed(spark, tmp_path / "new")
    _, changed = maintain.index_status(before, f.select("path", "checksum"))
    assert sorted(r.change for r in changed.collect()) == ["added", "changed", "removed"]
    touched = o.join(changed.select("path"), "path", "left_semi")
    after = maintain.incremental_update(before, changed, touched, b.join(touched.select(F.col("id").alias("object_id")), "object_id", "left_semi"), e.limit(0), f.select("path", "checksum"), "t", findings=bad)
    full = maintain.rebuild(spark, f, o, b, e, bad, "t")
    for name in full:
        cols = full[name].columns
        assert sorted(map(str, after[name].select(cols).collect())) == sorted(map(str, full[name].collect())), name


def test_lookups_open_only_the_buckets_of_their_terms(spark, tmp_path):
    fields = spark.createDataFrame([(f"s{i}", [f"t{i % 50}", "all", "all", f"u{i}"]) for i in range(200)] + [("none", [])], "segment_id string, tokens array<string>")
    tables = build_postings(fields)
    assert "Exchange" not in tables["postings"]._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.tf) for r in tables["postings"].where("segment_id = 's7'").collect()} == {("t7", 1), ("all", 2), ("u7", 1)}
    vault.write_projection(tables, f"{tmp_path}/p", 64)
    back = vault.read_projection(spark, f"{tmp_path}/p")
    queries = spark.createDataFrame([(1, "t7 all"), (2, "u9"), (3, "--")], "query_id int, query string")
    found = search.matches(back, queries)
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line and "bucket" in line]
    assert scans and all("bucket#" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in scans)
    parts = [line.split("PartitionFilters:")[1].split("]")[0] for line in scans]
    assert all(p.count(",") < 5 for p in parts)  # three terms lie in three buckets of 64 at most
    plain = search.matches(tables, queries)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() == 5
    assert [tuple(r) for r in search.invalid_queries(queries).collect()] == [(3, "SEARCH_QUERY_INVALID")]


def test_newest_projection_is_read_and_older_ones_stay(spark, tmp_path):
    tables = {"objects": spark.range(2), "segments": spark.range(3).selectExpr("cast(id as string) as segment_id")}
    first = vault.write_projection(tables, f"{tmp_path}/p", 2)
    second = vault.write_projection({"objects": spark.range(5)}, f"{tmp_path}/p", 2)
    assert {k: t.count() for k, t in vault.read_projection(spark, f"{tmp_path}/p").items()} == {"objects": 5}
    assert spark.read.parquet(f"{tmp_path}/p/{first}/segments").count() == 3 and first != second


def size_of(at):
    return sum(f.stat().st_size for f in at.rglob("*") if f.is_file())


def same_tables(got, want):
    assert sorted(got) == sorted(want)
    for name in want:
        cols = [c for c in want[name].columns if c != "bucket"]
        assert sorted(map(str, got[name].select(cols).collect())) == sorted(map(str, want[name].select(cols).collect())), name


def many(n, changed=()):
    """Sources with a note's edge to each; the changed ones say something else."""
    ids = [U[:-4] + "ABCDEFGH"[i // 64 % 8] + "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[i >> k & 31] for k in (10, 5, 0)) + "0" for i in range(n)]
    rows = []
    for i, own in enumerate(ids):
        words = " ".join(f"w{(i * 7 + k * k) % 997}{'x' if i in changed else ''} {(i * 31 + k) * 2654435761 % 4294967296:x}" for k in range(400))
        front = f"schema_version: 2\nid: src_{own}\nkind: source\ntitle: T {i}\nvisibility: public\nrecord_status: active\ncreated: 2024-01-01\nupdated: 2024-01-02\ntags: [t{i % 3}]\nsource_type: book\nworkflow_stage: inbox\nisbn: '9780306406157'\nedition: 2nd\n"
        rows.append((f"sources/books/{i}.md", f"---\n{front}---\n{words}\n"))
        edge = f"- {{to_id: src_{ids[(i + 1) % n]}, relation_type: cites, reason: r, created_at: '2024-01-01T00:00:00Z', actor: {{type: human, id: me}}}}\n"
        rows.append((f"relations/src_{own}.yaml", f"schema_version: 2\nfrom_id: src_{own}\nrelations:\n{edge}"))
    return rows


def as_files(spark, rows):
    f = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in rows], "path string, content binary")
    return f.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("checksum"), "content")


def read_rows(f):
    objects, bodies, bad = vault.parse_objects(f)
    edges, worse = vault.parse_relation_shards(f)
    return objects, bodies, edges, bad.unionByName(worse)


def test_an_update_writes_what_it_adds(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/p"
    first = as_files(spark, many(300)).cache()
    base = maintain.publish(spark, first, *read_rows(first), out, "t", buckets=2)
    rows = many(300, {5, 6, 250})
    rows = [r for r in rows if r[0] not in ("relations/src_" + rows[14][1].split("id: src_")[1][:26] + ".yaml",)]  # the seventh's edges are gone
    later = as_files(spark, rows).cache()
    again = lambda: vault.read_projection(spark, out)
    state, changed = maintain.index_status(again(), later)
    assert state == "stale" and sorted(r.change for r in changed.collect()) == ["changed"] * 3 + ["removed"]
    touched = later.join(changed.select("path"), "path", "left_semi")
    objects, bodies, edges, bad = read_rows(touched)
    update = lambda **more: maintain.publish_changes(spark, out, changed, objects, bodies, edges, later, more.pop("bad", bad), "t", **more)
    with pytest.raises(ValueError, match="INDEX_SOURCE_INVALID"):
        update(bad=validate.findings(objects.limit(1), "FIELD_INVALID"))
    with pytest.raises(ValueError, match="INDEX_SOURCE_CHANGED"):
        update(again=lambda: first)
    assert vault.newest(spark, out)["parts"] == [base]
    second = update(again=lambda: later)
    assert vault.newest(spark, out)["parts"] == [base, second]
    assert size_of(tmp_path / "p" / second) < 0.05 * size_of(tmp_path / "p" / base)
    full = maintain.rebuild(spark, later, *read_rows(later), "t")
    same_tables(again(), full)
    assert maintain.index_status(again(), later)[0] == "fresh"
    # lookups still open the buckets of their terms only, in every part
    queries = spark.createDataFrame([(1, "w35x"), (2, "t1 w49")], "query_id int, query string")
    found = search.matches(again(), queries.where("query_id = 1"))
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in line and "bucket" in line]
    assert len(scans) >= 2 and all("bucket#" in line.split("PartitionFilters:")[1].split("PushedFilters")[0] for line in scans)
    assert sorted(map(str, search.matches(again(), queries).collect())) == sorted(map(str, search.matches(full, queries).collect()))
    # the way back, in a version that has too many parts and so is written whole
    monkeypatch.setattr(maintain, "MOST_PARTS", 2)
    _, back = maintain.index_status(again(), first)
    objects, bodies, edges, bad = read_rows(first.join(back.select("path"), "path", "left_semi"))
    third = maintain.publish_changes(spark, out, back, objects, bodies, edges, first, bad, "t")
    assert vault.newest(spark, out)["parts"] == [third]
    same_tables(again(), maintain.rebuild(spark, first, *read_rows(first), "t"))


def test_an_update_that_empties_everything(spark, tmp_path):
    out, first = f"{tmp_path}/p", as_files(spark, many(4))
    maintain.publish(spark, first, *read_rows(first), out, "t", buckets=2)
    none = first.limit(0)
    _, changed = maintain.index_status(vault.read_projection(spark, out), none)
    maintain.publish_changes(spark, out, changed, *read_rows(none)[:3], none, read_rows(none)[3], "t")
    same_tables(vault.read_projection(spark, out), maintain.rebuild(spark, none, *read_rows(none), "t"))


@pytest.mark.parametrize("body,code", [
    ("<!-- kb:section id=sec_abc role=fact -->\n## F\n\nloose text", "NOTE_BLOCK_METADATA_MISSING"), ("<!-- kb:section id=sec_abc role=odd -->\n## F\n", "FIELD_INVALID"), ("<!-- kb:section id=sec_abc role=ai -->\n## F\n\n<!-- kb:ai\nx: 1\n-->\ntext", "FIELD_INVALID"),
    ("<!-- kb:section id=sec_abc role=fact -->\n## F\n\n<!-- kb:fact\ncitations: [\n-->\ntext", "FRONTMATTER_INVALID"), ("<!-- kb:section id=sec_abc role=fact -->\n## F\n\n<!-- kb:fact\ncitations: []\n-->\n", "NOTE_BLOCK_METADATA_MISSING"),
])
def test_broken_bodies(body, code):
    with pytest.raises(vault.Bad) as error:
        vault.note_sections(body)
    assert error.value.args[0] == code


def test_markers_have_a_prefix_of_choice():
    one, two = ID["art6"], ID["art6"][:-1] + "7"
    body = f"lead\n<!-- my:section id=sec_abc role=ai -->\n## A b\n\n<!-- my:ai\nartifact_id: {one}\n-->\none\n\n<!-- my:ai\nartifact_id: {two}\n-->\ntwo"
    (section,) = vault.note_sections(body, "my")
    assert [(b["artifact_id"], b["text"]) for b in section["blocks"]] == [(one, "one"), (two, "two")] and section["heading"] == "A b"
    assert vault.note_sections(body) == []


def test_incremental_drops_edges_of_removed_and_emptied_shards(spark, tmp_path):
    def shard(name, *to):
        edges = "".join(f"\n- {{to_id: {ID[t]}, relation_type: derived_from, reason: r, created_at: '2024-01-01T00:00:00Z', actor: {{type: human, id: me}}}}" for t in to)
        return {f"relations/{ID[name]}.yaml": f"schema_version: 2\nfrom_id: {ID[name]}\nrelations:{edges or ' []'}\n"}

    old = files() | shard("con4", "web1", "oss2") | shard("art6", "web1") | shard("sn5", "web1", "oss2")
    new = old | shard("con4") | shard("sn5", "oss2")
    del new[f"relations/{ID['lit3']}.yaml"]
    written(tmp_path / "old", old)
    written(tmp_path / "new", new)
    before = maintain.rebuild(spark, *parsed(spark, tmp_path / "old"), "t")
    f, o, b, e, bad = parsed(spark, tmp_path / "new")
    _, changed = maintain.index_status(before, f.select("path", "checksum"))
    assert sorted(r.change for r in changed.collect()) == ["changed", "changed", "removed"]
    after = maintain.incremental_update(before, changed, o.limit(0), b.limit(0), e.join(changed.select("path"), "path", "left_semi"), f.select("path", "checksum"), "t")
    full = maintain.rebuild(spark, f, o, b, e, bad, "t")
    assert sorted((r.from_id, r.to_id) for r in after["relations"].collect()) == sorted([(ID["art6"], ID["web1"]), (ID["sn5"], ID["oss2"])])
    for name in full:
        cols = full[name].columns
        assert sorted(map(str, after[name].select(cols).collect())) == sorted(map(str, full[name].collect())), name


def test_search_context_and_lookup(spark, small):
    f, objects, bodies, edges, bad = small
    tables = maintain.rebuild(spark, f, objects, bodies, edges, bad, "t")
    tables["objects"] = tables["objects"].join(objects.select("id", "tags"), "id")
    q = spark.createDataFrame([(1, "WHEAT"), (2, "wheat OR rye"), (3, "-!")], "query_id int, query string")
    got = sorted((r.query_id, r.role) for r in search.search(tables, q).collect())
    assert got == [(1, "fact"), (1, "human"), (1, "snippet"), (1, "source")]
    assert {r.role for r in search.search(tables, q, search.SearchFilters(kind="ai_artifact")).collect()} == {"ai"}
    assert {r.role for r in search.search(tables, q, scope="public").collect()} == {"fact", "human", "snippet", "source"}
    with pytest.raises(ValueError):
        search.search(tables, q, search.SearchFilters(role="ai"), "public")
    with pytest.raises(ValueError):
        search.SearchFilters(tags=[])
    items, out, total = search.context(tables, q, "public", max_chars=30)
    assert total.first().n_chars <= 30 and items.count() + out.count() == 4 and total.first().truncated
    assert not search.context(tables, q, "public")[2].first().truncated
    found, missing = joins.get_objects(tables, spark.createDataFrame([(ID["web1"],), ("src_none",)], "id string"))
    (part,) = joins.edge_parts(tables["relations"], found).collect()
    assert (part.id, part.direction, part.part, [e.from_id for e in part.edges]) == (ID["web1"], "incoming", 0, [ID["lit3"]]) and [r.id for r in missing.collect()] == ["src_none"]


def test_edges_of_a_hub_come_in_parts(spark, monkeypatch):
    rows = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("from_id"), F.when(F.col("id") % 10 > 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 7)).alias("to_id"), F.lit("cites").alias("relation_type"), F.lit("").alias("to_section_id"), F.lit(None).cast("string").alias("locator"))
    rows = rows.unionByName(rows.where("from_id = 'n1'")).unionByName(rows.where("from_id = 'n1'"))  # the same edge again counts again
    ids = spark.createDataFrame([("hub",), ("n1",), ("n3",), ("none",), ("hub",), (None,)], "id string")
    parts = joins.edge_parts(rows, ids, 500)
    seen = parts.select("id", "direction", "part", F.size("edges").alias("n")).collect()
    assert max(r.n for r in seen) <= 500 and len({(r.id, r.direction, r.part) for r in seen}) == len(seen) and sum(r.id == "hub" for r in seen) >= 181
    edges = lambda df: df.select("id", "direction", F.explode("edges").alias("e")).select("id", "direction", "e.from_id", "e.to_id", "e.relation_type", "e.to_section_id")
    want = joins.list_relations(rows, ids)
    assert edges(parts).exceptAll(want).isEmpty() and want.exceptAll(edges(parts)).isEmpty()
    monkeypatch.setattr(joins, "BROADCAST_HUBS", 0)
    assert edges(joins.edge_parts(rows, ids, 500)).exceptAll(want).isEmpty()
    assert joins.edge_parts(rows.limit(0), ids).isEmpty()


def test_budget_closes_for_good(spark):
    rows = [(1, k, "human", t, None) for k, t in ((1, "1234"), (2, "5678"), (3, "x"))]
    got = search.budgeted(spark.createDataFrame(rows, "query_id int, rank int, role string, text string, public_code string"), 20, 6).orderBy("rank").collect()
    assert [r.code for r in got] == [None, "CHARACTER_BUDGET_EXCEEDED", "CHARACTER_BUDGET_EXCEEDED"]


def test_grep_places(spark):
    text = "<!-- kb:section id=sec_abc role=human -->\nStraße Knowledge knowledge\nﬁ ﬁ"
    f = spark.createDataFrame([("a.md", text, "o"), ("b.txt", text, "o")], "path string, text string, object_id string")
    q = spark.createDataFrame([(1, "knowledge"), (2, "FI"), (3, "?!")], "query_id int, query string")
    got = [(r.query_id, r.path, r.line, r.column, r.section_id) for r in search.grep(f, q).orderBy("query_id", "rank").collect()]
    assert got == [(1, "a.md", 2, 8, "sec_abc"), (1, "a.md", 2, 18, "sec_abc"), (1, "b.txt", 2, 8, None), (1, "b.txt", 2, 18, None), (2, "a.md", 3, 1, "sec_abc"), (2, "a.md", 3, 3, "sec_abc"), (2, "b.txt", 3, 1, None), (2, "b.txt", 3, 3, None)]


def test_grep_finds_decomposed_words_as_composed_ones(spark):
    lines = ["ein cafe\u0301 und cafe\u0301s", "ein café", "ﬁﬁ café"]
    f = spark.createDataFrame([("a.md", "\n".join(lines), "o")], "path string, text string, object_id string")
    q = spark.createDataFrame([(1, "CAFÉ")], "query_id int, query string")
    assert [(r.line, r.column) for r in search.grep(f, q).orderBy("rank").collect()] == [(1, 5), (1, 15), (2, 5), (3, 4)]


def test_grep_reads_only_blocks_with_the_rarest_trigrams(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)] + ["Straße", "ﬁn", "cafe\u0301", "𝔘nd", "日本語"]
    texts = ["\n".join(" ".join(rng.choices(words, k=8)) if k != 40 else "<!-- kb:section id=sec_late role=human -->" for k in range(rng.randint(0, 120))) for _ in range(60)]
    f = spark.createDataFrame([(f"{i}.md", t, f"o{i}") for i, t in enumerate(texts)] + [("empty.md", "", "e"), ("none.md", None, "n")], "path string, text string, object_id string")
    asked = [words[3], words[77] + " " + words[9], "STRASSE", "fin", "café", "日本語", "ab", "a", "nowhere at all", "?!", "aa\nbb"] + [" ".join(t.split("\n")[0].split()[1:3]) for t in texts[:20]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    vault.write_projection(search.grep_index(f), f"{tmp_path}/t", 8)
    index = vault.read_projection(spark, f"{tmp_path}/t")
    got, want = (sorted(map(str, df.collect())) for df in (search.grep_indexed(index, queries, 200), search.grep(f, queries, 200)))
    assert got == want and len({r.query_id for r in search.grep(f, queries, 200).select("query_id").distinct().collect()}) > 20
    few = queries.where("query_id between 11 and 14").select("query_id", F.col("query").alias("q"))
    lines = sum(len(t.split("\n")) for t in texts)
    assert 0 < search.candidate_lines(index, few).count() < 0.25 * lines
    assert search.candidate_lines(index, spark.createDataFrame([(1, "nowhere at all")], "query_id int, q string")).isEmpty()
    assert search.grep_indexed(index, queries.limit(0)).isEmpty()


def test_bounded_search_equals_search_and_scores_fewer_postings(spark, tmp_path):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    tokens = [rng.choices(words, weights, k=rng.choice([0, 3, 8, 20, 60, 150])) for _ in range(4000)]
    tokens += [["w1", "w2", "tie"]] * 300  # equal scores beyond every limit
    fields = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "segment_id string, tokens array<string>")
    rows = [(f"s{i}", f"o{i % 900}", "__body__" if i % 5 else "sec", i % 7, rng.choice(["human", "fact", "ai"]), " ".join(t)) for i, t in enumerate(tokens)]
    objects = [(f"o{i}", "note", "idea", rng.choice(["public", "private"]), rng.choice(["active", "active", "archived"]), "inbox", "mature", None, ["en"]) for i in range(900)]
    columns = "id string, kind string, subtype string, visibility string, record_status string, workflow_stage string, maturity string, review_status string, tags array<string>"
    index = build_postings(fields) | {
        "segments": spark.createDataFrame(rows, "segment_id string, object_id string, section_id string, ordinal int, role string, text string"), "objects": spark.createDataFrame(objects, columns),
    }
    held = {name: df.cache() for name, df in index.items()}
    vault.write_projection({"score_blocks": score_blocks(fields, 4)}, f"{tmp_path}/s", 8)
    blocks = vault.read_projection(spark, f"{tmp_path}/s")
    asked = ["w0", "w1 w2", "w150", "w0 w1 w2 w3", "tie", "w2 tie w2", "nowhere", "w0 nowhere", "?!"] + [" ".join(rng.choices(words, weights, k=rng.randint(1, 4))) for _ in range(12)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    for filters, limit in ((search.SearchFilters(), 5), (search.SearchFilters(visibility="public", role="ai"), 1), (search.SearchFilters(), 200)):
        got, want = (sorted(map(str, f(held | blocks, queries, filters, limit=limit).select("query_id", "rank", "segment_id", "score").collect())) for f in (search.bounded_search, search.search))
        assert got == want and len(want) > 15
    one = spark.createDataFrame([(1, "w5")], "query_id int, query string")
    _, chosen = search.bounded_matches(held | blocks, one, lambda hits: hits, 5)
    _, every = search.bounded_matches(held | blocks, one, lambda hits: hits.limit(0), 5)
    assert 0 < chosen.agg(F.sum("n")).first()[0] < 0.5 * every.agg(F.sum("n")).first()[0]
    assert search.bounded_search(held | blocks, queries.limit(0)).isEmpty()
    assert score_blocks(fields.limit(0)).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_large_query_tables_are_not_broadcast_whole(spark, monkeypatch):
    f = spark.createDataFrame([("a.md", "one two\nthree one", "o"), ("b.md", "two", "o")], "path string, text string, object_id string")
    q = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three one"), (4, "none")], "query_id int, query string")
    whole = search.grep(f, q)
    want = sorted(map(str, whole.collect()))
    monkeypatch.setattr(search, "BROADCAST_CHARS", 10)
    parts = search.grep(f, q)
    assert sorted(map(str, parts.collect())) == want and len(want) == 5
    assert plan_of(parts).count("MapInArrow") > plan_of(whole).count("MapInArrow")
    one = lambda s, row: spark.createDataFrame([row], s)
    index = {"term_stats": one("term string, df long", ("one", 1)), "postings": one("term string, segment_id string, tf long", ("one", "s", 1)), "segment_stats": one("segment_id string, n_tokens long", ("s", 2)), "corpus_stats": one("n_segments long, avg_tokens double", (1, 2.0))}
    monkeypatch.setattr(search, "BROADCAST_TERMS", 5)
    few, many = (search.matches(index, spark.createDataFrame([(1, text)], "query_id int, query string")) for text in ("one", "one two three four five six"))
    assert plan_of(few).count("broadcast") > plan_of(many).count("broadcast")


def test_paging(spark):
    rows = spark.range(51).select(F.format_string("n%02d", "id").alias("id"), F.lit("d").alias("updated"))
    second, facts = catalog.paginate(rows, [F.desc("updated"), "id"], 2)
    assert [r.id for r in second.collect()] == ["n50"] and facts == {"total": 51, "page": 2, "pages": 2, "has_previous": True, "has_next": False}
    with pytest.raises(ValueError):
        catalog.paginate(rows, ["id"], 0)


def test_capture(spark, small):
    _, objects, _, _, _ = small
    asked = [(1, "https://x.org/", None), (2, "10.1000/new", None), (3, "doi:10.1000/NEW", None), (4, "words", None), (5, "https://other.org/a", None), (6, "10.1000/none", None), (7, "https://github.com/a/b", None), (8, "https://github.com/c/d", None)]
    meta = spark.createDataFrame([("k1", "report", "T", "10.1000/new", None, None, None)], "item_key string, item_type string, title string, doi string, arxiv_id string, isbn string, url string")
    kids = spark.createDataFrame([("c1", "k1", "attachment", "f.pdf", None, "linked_file")], "item_key string, parent_key string, item_type string, filename string, content_type string, link_mode string")
    repos = spark.createDataFrame([("https://github.com/a/b", "b", "c1", "main"), ("https://github.com/c/d", "d", "c2", "main")], "url string, title string, commit string, default_branch string")
    results, new = bulk.bulk_capture(spark.createDataFrame(asked, "request_id int, input string, type string"), objects, meta, kids, "2024-02-02T00:00:00Z", repositories=repos)
    got = {r.request_id: (r.result, r.source_id, r.warning) for r in results.collect()}
    assert [got[k][0] for k in range(1, 9)] == ["EXISTING", "CREATED", "EXISTING", "ADD_INPUT_INVALID", "ADD_METADATA_UNAVAILABLE", "ADD_TYPE_AMBIGUOUS", "EXISTING", "CREATED"]
    assert got[1][1] == ID["web1"] and got[2][1] == got[3][1] and got[7][1] == ID["oss2"] and {r.attachment_key for r in new.collect()} == {"c1", None}
    assert new.where(~F.col("id").rlike("^src_[0-9A-HJKMNP-TV-Z]{26}$")).count() == 0


def test_bulk_changes(spark, small):
    _, objects, _, edges, _ = small
    evolve = spark.createDataFrame([(1, ID["con4"], "me"), (2, "note_x", "me")], "request_id int, id string, actor_id string")
    assert {r.request_id: r.result for r in bulk.evolve_notes(evolve, objects, "2024-02-02T00:00:00Z").collect()} == {1: "NOTE_TRANSITION_INVALID", 2: "NOTE_NOT_FOUND"}
    made, notes, bodies, links = bulk.create_notes(spark.createDataFrame([(1, ID["web1"], None)], "request_id int, source_id string, title string"), objects, "2024-02-02T00:00:00Z")
    assert made.first().result == "CREATED" and notes.first().title == "Untitled literature" and (links.first().to_id, links.first().actor.type) == (ID["web1"], "human")
    assert [s.role for s in bodies.first().sections] == ["human"]
    gone, stay = bulk.remove_relations(edges, edges.select(F.lit(1).alias("request_id"), "from_id", "to_id", "to_section_id", "relation_type", "locator"))
    assert gone.first().result == "REMOVED" and stay.count() == 0


def test_migration_of_sound_files_may_be_applied(spark):
    source = "---\nschema_version: 1\nid: {id}\nkind: source\ntitle: T\nvisibility: public\nrecord_status: active\nsource_type: web\nworkflow_stage: inbox\ncreated: 2024-01-01\nupdated: 2024-01-01\ntags: []\ncanonical_url: https://x.org/\ncaptured_at: 2024-01-01T00:00:00Z\n---\nAbout\n"
    note = "---\nschema_version: 1\nid: {id}\nkind: note\ntitle: N\nvisibility: public\nrecord_status: active\nnote_type: literature\nmaturity: seed\ncreated: 2024-01-01\nupdated: 2024-01-01\ntags: []\nsource_ids: [{web}]\n---\n<!-- section_id: sec_my_interpretation -->\n## Mine\n\nOwn\n"
    rows = [("sources/web/w.md", source.format(id=ID["web1"])), ("notes/literature/n.md", note.format(id=ID["lit3"], web=ID["web1"]))]
    f = spark.createDataFrame([(p, "c", bytearray(t.encode())) for p, t in rows], "path string, checksum string, content binary")
    plan = migrate.plan(spark, f, "2024-02-02T00:00:00Z", apply=True)
    assert plan.allowed and sorted((r.code, r.status) for r in plan.report.collect()) == [(f"MIGRATION_{c}", "resolved") for c in ("OBJECT_CONVERTED", "OBJECT_CONVERTED", "RELATION_SHARD_CREATED", "VAULT_CONFIG_CREATED")]
    assert sorted(r.path for r in plan.writes.collect()) == ["notes/literature/n.md", f"relations/{ID['lit3']}.yaml", "sources/web/w.md"]
    new = plan.writes.select("path", F.lit("c").alias("checksum"), F.encode("content", "UTF-8").alias("content"))
    assert [r.code for r in migrate.plan(spark, new, "t", contract_version=2).report.collect()] == ["MIGRATION_ALREADY_APPLIED"]
    with pytest.raises(ValueError, match="MIGRATION_VAULT_INVALID"):
        migrate.plan(spark, f, "t", contract_version=2)
    nothing = migrate.plan(spark, f.limit(0), "t")
    assert not nothing.allowed and sorted(r.code for r in nothing.report.collect()) == ["MIGRATION_INPUT_MISSING", "MIGRATION_VAULT_CONFIG_CREATED"]


def test_markers_without_a_heading_are_text():
    body = "a <!-- section_id: sec_one -->\ntext\n<!-- section_id: sec_two -->\n\n## Two\n<!--section_id:sec_six-->\r\n##\tSix \r\nend"
    assert [(s[0], s[1], body[s[3] : s[4]].strip()) for s in migrate.v1_sections(body)] == [("sec_two", "Two", ""), ("sec_six", "Six", "end")]


def test_stream_equals_batch(spark, tmp_path):
    fields = spark.createDataFrame([("s1", ["a", "b", "a"]), ("s2", ["b"])], "segment_id string, tokens array<string>")
    fields.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(fields.schema).parquet(f"{tmp_path}/in")
    refresh.stream_postings(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = refresh.current_stats(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, got["term_stats"].collect())) == [("a", 1), ("b", 2)] and got["corpus_stats"].first().avg_tokens == 2.0


def test_plain_relation_files_are_written_and_read_without_the_yaml_parser(spark, monkeypatch):
    import yaml

    assert vault.yaml_dumped({"b": ["ü", "x y"], "a": "yes"}) == yaml.safe_dump({"b": ["ü", "x y"], "a": "yes"}, allow_unicode=True, sort_keys=False)
    for text in ("a:\tb", '"\\\'"', "[a?b]", "a: [", "a: 1\nb: {c: [d, 'e']}\n", "2024-01-01"):
        results = []
        for f in (vault.yaml_loaded, yaml.safe_load):
            try:
                results.append(f(text))
            except yaml.YAMLError as error:
                results.append(str(error))
        assert results[0] == results[1], text
    at, actor = "'2024-01-01T00:00:00Z'", "  actor:\n    id: me\n    type: human\n"
    note, src = "note_" + "1".zfill(26), "src_" + "2".zfill(26)
    paper = "  locator:\n    locator_version: 2\n    page: 3\n    source_type: paper\n"
    oss = "  locator:\n    commit: c1\n    locator_version: 2\n    path: a/b.py\n    repository_host: git.example.org\n    repository_path: a/b\n    source_type: oss\n    symbol: f\n"
    tail = f"  created_at: {at}\n{actor}"
    plain = f"schema_version: 2\nfrom_id: {note}\nrelations:\n- to_id: {src}\n  relation_type: cites\n{paper}  reason: R\n{tail}- to_id: {src}\n  to_section_id: sec_mine\n  relation_type: derived_from\n{oss}{tail}"
    edits = [
        ("reason: R", "reason: yes"), ("reason: R", "reason: No"), ("reason: R", "reason: 'no'"), ("reason: R", "reason: two words"), ("reason: R", "reason: R # r"), ("reason: R", "reason: ~"), ("page: 3", "page: 0"), ("page: 3", "page: x"), ("page: 3", "pages: 3"),
        ("2024-01-01T", "2024-02-30T"), (at, "2024-01-01T00:00:00Z"), ("type: human", "type: robot"), ("sec_mine", "sec_M"), ("cites", "likes"), (src, "src_1"), ("from_id: note", "from_id: x"), ("version: 2", "version: 1"), ("symbol: f\n", "symbol: f\n    start_line: 2\n"), ("    symbol: f\n", ""),
        ("  reason: R\n", "  reason: R\n  reason: S\n"), ("\n- to", "\n\n- to"), (tail, f"{actor}  created_at: {at}\n"),
    ]
    texts = [plain, plain + "\n", plain.rstrip("\n"), *(plain.replace(a, b) for a, b in edits)]
    rows = [(f"relations/{i}.yaml", "c", bytearray(t.encode())) for i, t in enumerate(texts)] + [("relations/a/b.yaml", "c", bytearray(plain.encode()))]
    files_ = spark.createDataFrame(rows, "path string, checksum string, content binary")
    results = []
    for head in (vault._SHARD_HEAD, "never"):  # by expressions where they can, and by the parser alone
        monkeypatch.setattr(vault, "_SHARD_HEAD", head if head != "never" else "never(x)")
        results.append([sorted(map(str, df.collect())) for df in vault.parse_relation_shards(files_)])
    assert results[0] == results[1] and len(results[0][1]) >= 12
    monkeypatch.undo()
    edges = vault.parse_relation_shards(files_.where("path in ('relations/0.yaml', 'relations/4.yaml', 'relations/5.yaml', 'relations/6.yaml')"))[0].withColumn("from_id", F.concat("from_id", F.regexp_extract("path", "[0-9]", 0)))
    for r in vault.render_relation_shards(edges).collect():
        assert r.content == yaml.safe_dump(yaml.safe_load(r.content), allow_unicode=True, sort_keys=False)
    cut = []
    vault.parse_relation_shards(files_, keep=lambda df: cut.append(df) or df)
    assert [r.path for r in cut[0].where("cut is not null").collect()] == ["relations/0.yaml"]


def test_files_of_a_scan_are_parsed_once(spark):
    from quire.plans import documents

    for df in documents._parsed(spark, documents.files(spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_trigrams_lie_in_lists_and_blocks_are_not_shuffled(spark, tmp_path):
    f = spark.createDataFrame([(f"{i}.md", "\n".join(["same words"] * 70), "o") for i in range(50)], "path string, text string, object_id string").coalesce(1)
    tables = search.grep_index(f)
    assert "Exchange" not in tables["line_blocks"]._jdf.queryExecution().sparkPlan().toString()
    vault.write_projection(tables, f"{tmp_path}/t", 1)
    index = vault.read_projection(spark, f"{tmp_path}/t")
    assert index["line_blocks"].count() == 150 and index["trigrams"].count() == index["trigram_stats"].count() == 8
    assert {r.df for r in index["trigram_stats"].collect()} == {150}


def test_a_public_audit_reads_its_hits_from_a_table(spark):
    from quire.plans import fixtures as fx

    index = fx.built_index(spark, "/root/testdata/sf0.001")
    hits = index["segments"].select("segment_id", "object_id", "role").mapInPandas(lambda frames: frames, "segment_id string, object_id string, role string")
    found = search.public_exclusion(hits, index)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == hits.count()


def test_private_hits_leave_before_the_audit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(search, "public_exclusion", lambda hits, tables: seen.append(hits) or hits.withColumn("public_code", F.lit(None).cast("string")))
    rows = [("public", "active", "human"), ("private", "active", "human"), ("public", "archived", "fact"), ("public", "active", "ai"), (None, "active", "human")]
    search.public_safe(spark.createDataFrame(rows, "visibility string, record_status string, role string"), {})
    assert sorted(map(str, seen[0].collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[4]], seen[0].schema).collect()))


def test_a_page_and_its_total_come_from_one_run(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            runs.add(len(frame))
            yield frame

    rows = spark.range(0, 120, 1, 6).mapInPandas(counted, "id long")
    page, facts = catalog.paginate(rows, [F.desc("id")], 2)
    assert [r.id for r in page.collect()] == list(range(69, 19, -1)) and facts == {"total": 120, "page": 2, "pages": 3, "has_previous": True, "has_next": True}
    assert runs.value == 120
    last, facts = catalog.paginate(rows.where("id < 0"), ["id"], 1)
    assert last.isEmpty() and facts["total"] == 0 and facts["pages"] == 1
