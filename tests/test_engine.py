"""Files, extraction, index, results, streams and workflows on small fixtures."""

from __future__ import annotations

import io
import os
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.extract import extract_files
from siltstone.operators import index, results, search, vectors
from siltstone.query import build_query
from siltstone.sources import adapters, walker
from siltstone.streaming import queue
from siltstone.workflow import Runner, WorkflowError, validate
from siltstone.workflow.model import Store

T = datetime(2030, 1, 1)


@pytest.fixture
def tree(tmp_path):
    for path, text in {"a.txt": "alpha\nbeta match\nfoo and bar\n", "sub/b.txt": "beta match\nbar only\n", ".git/c.txt": "beta", "sub/.hidden": "beta", "sub/_d.log": "beta\0", "empty/": None}.items():
        p = tmp_path / path
        if text is None:
            p.mkdir(parents=True)
        else:
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    return str(tmp_path)


def test_walk(spark, tree):
    names = lambda df: {r.path[len(tree) :] for r in df.where("not is_directory").collect()}
    assert names(walker.walk(spark, [tree, "/no/such/root"])) == {"/a.txt", "/sub/b.txt", "/sub/_d.log"}
    assert names(walker.walk(spark, [tree], recursive=False)) == {"/a.txt"}
    assert names(walker.walk(spark, [tree], include_hidden=True, exclude=[])) >= {"/.git/c.txt", "/sub/.hidden"}
    folders = {r.path[len(tree) :] for r in walker.walk(spark, [tree]).where("is_directory").collect()}
    assert folders == {"", "/sub", "/empty"}
    assert walker.walk(spark, [tree, tree]).where("not is_directory").count() == 6
    assert walker.extension_list("*.X; y, .Z  y") == [".x", ".y", ".z"]


def test_live_equals_indexed(spark, tree):
    got = extract_files(walker.read_bytes(walker.walk(spark, [tree])))
    lines = got.where("line_number is not null").select(F.col("path").alias("file_id"), F.col("line_number").cast("bigint").alias("line_number"), "content").cache()
    assert lines.where("file_id like '%_d.log'").count() == 0  # binary
    posts = index.postings(lines)
    for text in ("match", "beta match", "foo AND bar", "beta NOT match", "(foo OR only) bar", "/b.r/"):
        q = build_query(text, "boolean")
        live = {(r.file_id, r.line_number) for r in search.search_lines(q, lines).collect()}
        assert {(r.file_id, r.line_number) for r in index.search_indexed(q, lines, posts).collect()} == live


def _zip(members: dict[str, bytes]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in members.items():
            z.writestr(k, v)
    return b.getvalue()


def test_extractors(spark):
    w = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:r></w:p><w:p/></w:body></w:document>'
    x = {"xl/workbook.xml": '<workbook><sheets><sheet name="S1"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>one</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>'}
    eml = "Subject: =?utf-8?Q?caf=C3=A9?=\nFrom: a@b\nContent-Type: multipart/mixed; boundary=\"X\"\n\n--X\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nna=C3=AFve\n--X\nContent-Type: text/html\n\n<b>bold</b> text\n--X\nContent-Type: text/plain\nContent-Disposition: attachment\n\nno\n--X--\n"
    files = {
        "t.txt": "a\r\nb\rc\n".encode(), "u.txt": "\ufeffü".encode("utf-16-le"), "bin.dat": b"\0\1", "no_ext": b"plain", "e.txt": b"",
        "h.html": b"<p>a<script>x</script>&amp;b</p><!-- c --><div>d</div>", "r.rtf": rb"{\rtf1{\fonttbl{\f0 Arial;}}{\*\x y}caf\'e9 \u8364? a\par b}",
        "c.ics": b"BEGIN:VCALENDAR\nSUMMARY:long\n  text\\, more\nEND:VCALENDAR", "m.eml": eml.encode(), "w.docx": _zip({"word/document.xml": w.encode()}), "x.xlsx": _zip({k: v.encode() for k, v in x.items()}),
        "p.pptx": _zip({"ppt/slides/slide1.xml": b'<s xmlns:a="a"><a:t>Title</a:t></s>', "ppt/notesSlides/notesSlide1.xml": b'<s xmlns:a="a"><a:t>note</a:t></s>'}),
        "o.odt": _zip({"content.xml": b"<d><p>open</p> <p>doc</p></d>"}), "b.epub": _zip({"META-INF/container.xml": b"<x/>", "c1.xhtml": b"<p>chapter</p>"}),
        "z.zip": _zip({"in.txt": b"inside", "deep.zip": b"x", "pic.png": b"x", "d/": b""}), "broken.docx": b"plain words", "bad.zip": b"\0\0",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("gone.txt", None)], "path string, content binary")
    rows = extract_files(df).collect()
    text = {}
    for r in sorted((r for r in rows if r.line_number), key=lambda r: (r.path, r.line_number)):
        text.setdefault(r.path, []).append(r.content)
    assert text["t.txt"] == ["a", "b", "c"] and text["u.txt"] == ["ü"] and text["no_ext"] == ["plain"]
    assert text["h.html"] == ["a &b d"] and text["r.rtf"] == ["café € a", "b"] and text["c.ics"] == ["SUMMARY:long text, more"]
    assert text["m.eml"] == ["Subject: café", "From: a@b", "naïve", "bold text"]
    assert text["w.docx"] == ["Hello\tyou"] and text["x.xlsx"] == ["[S1] one\t2"] and text["p.pptx"] == ["[Slide 1] Title", "[Slide 1 Notes] note"]
    assert text["o.odt"] == ["open doc"] and text["b.epub"] == ["[c1.xhtml] chapter"] and text["z.zip"] == ["=== in.txt ===", "inside"]
    assert text["broken.docx"] == ["plain words"]
    issues = {(r.path, r.issue) for r in rows if r.issue}
    assert {("z.zip", "archive_member_nested_archive_disabled"), ("z.zip", "archive_member_unsupported_type"), ("gone.txt", "missing"), ("bad.zip", "unreadable"), ("bin.dat", "no_text"), ("e.txt", "no_text")} <= issues


def test_difference_and_snapshots(spark, tmp_path):
    schema = "path string, size_bytes long, modified timestamp, extractor_id string, extractor_version string, status string"
    row = lambda p, n=1, st="ok": (p, n, T, "e", "1", st)
    have = spark.createDataFrame([row("same"), row("grown"), row("gone"), row("failed", st="error"), ("null", None, None, None, None, "ok")], schema)
    seen = spark.createDataFrame([row("same"), row("grown", 2), row("new"), row("failed"), ("null", None, None, None, None, "ok")], schema)
    assert {r.path: r.change for r in index.difference(seen, have).collect()} == {"same": "unchanged", "grown": "changed", "gone": "removed", "new": "new", "failed": "changed", "null": "unchanged"}
    assert {r.path: r.kind for r in index.drifts(seen, have).collect()} == {"grown": "stale", "gone": "orphaned", "new": "missing", "failed": "failed"}
    fresh = index.refresh(have, seen)
    assert {(r.path, r.size_bytes) for r in fresh.collect()} == {(r.path, r.size_bytes) for r in seen.collect()}
    store = index.SnapshotStore(spark, str(tmp_path / "ix"))
    assert store.manifest() is None
    store.commit({"files": have}, {"root": {"recursive": True}})
    before = store.read("files")
    store.commit({"files": fresh})
    assert before.count() == 5 and store.read("files").count() == 5 and store.manifest()["version"] == 2
    store.clear_root("files", "grown", "path")
    store.compact()
    assert store.read("files").count() == 4
    open(tmp_path / "ix/.lock", "w").close()
    with pytest.raises(FileExistsError):
        store.commit({"files": have})
    assert index.covers({"recursive": True, "include": [".txt"]}, {"include": [".txt"]}) == "covered"
    assert index.covers({"recursive": False}, {}) == "not-recursive" and index.covers({}, {}) == "missing"
    assert index.covers({"recursive": True, "include": [".txt"]}, {}) == "narrower"


def test_fusion_and_rerank(spark):
    c = spark.createDataFrame([("metadata", "m", "a.txt", 10.0), ("lexical", "l", "A.txt", 5.0), ("lexical", "l", "b.txt", 20.0), ("regex", "r", "cc.txt", 0.0)], "provider string, provider_id string, path string, score double")
    got = [(r.path.lower(), r.score, r.rank) for r in results.fuse(c, {"metadata": 2.0}).orderBy("rank").collect()]
    assert got == [("a.txt", 25.0, 1), ("b.txt", 20.0, 2), ("cc.txt", 1.0, 3)]
    many = results.ranked(spark.range(1000).repartition(7).withColumn("x", F.col("id") % 10), [F.col("x"), F.col("id")])
    rows = many.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 1001)) and [(r.x, r.id) for r in rows] == sorted((r.x, r.id) for r in rows)
    x = results.fuse(c).withColumn("text", F.lit("b")).withColumn("modified", F.lit(T))
    top = results.rerank(x, results.rerank_terms("cc, z"), F.lit(T)).where("path = 'cc.txt'").first()
    assert abs(top.score - (1 + 0.30 + 0.03 * 0.6931472 + 0.08)) < 1e-6


def test_metadata_terms():
    t = lambda q, **k: search.metadata_terms(build_query(q, "boolean"), **k)
    assert t("alpha") == (["alpha"], True, True) and t("a b") is None and t("a.txt b") == (["a.txt", "b"], True, True)
    assert t("a OR b") is None and t("a OR b1") == (["a", "b1"], False, True) and t("/x/") is None
    assert search.metadata_terms(build_query("ext:pdf"))[0] == [".pdf"]
    assert list(search.plan_query(build_query("foo~1 /x/ bar"))) == ["lexical", "regex", "fuzzy"]
    assert list(search.plan_query(build_query("semantic:x name:y"))) == ["metadata", "semantic"]


def test_highlight_merge_and_windows(spark):
    df = spark.createDataFrame([([(5, 3), (0, 4), (2, 4)],)], "s array<struct<start:int,length:int>>")
    assert [(s.start, s.length) for s in df.select(search.merge_highlights(F.col("s")).alias("m")).first().m] == [(0, 4), (4, 2), (6, 2)]
    hits = spark.createDataFrame([(1, n) for n in (1, 2, 9, 14, 30)], "file_id int, line_number long")
    assert sorted((r.first_line, r.last_line) for r in results.preview_windows(hits).collect()) == [(1, 4), (7, 16), (28, 32)]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.5]), ("c", [-1.0, 0.0]), ("n", None), ("z", [0.0, 0.0]), ("d", [1.0])], "id string, vector array<float>")
    assert [r.id for r in vectors.top_k(df, [1.0, 0.0], 5).collect()] == ["a", "b"]
    many = vectors.top_k_many(df.where("id in ('a', 'b', 'c', 'n')"), df.where("id = 'a'"), 2)
    assert [(r.query_id, r.id) for r in many.collect()] == [("a", "b")]
    f = vectors.file_vectors(df.where("id in ('a', 'b')").withColumn("file_id", F.lit(1))).first().vector
    assert abs(f[0] ** 2 + f[1] ** 2 - 1) < 1e-9 and f[0] > f[1]
    e = spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(vectors.hashing_embedder(8)("t").alias("v")).collect()
    assert sum(x * x for x in e[0].v) == pytest.approx(1) and not any(e[1].v) and not any(e[2].v)


def test_hashed_search_recall(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no test data")
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).cache()
    ix = vectors.signatures(v, 64).cache()
    found = total = 0
    for q in (0, 100, 200, 300):
        own = v.where(F.col("id") == q).first().vector
        exact = {r.id for r in vectors.top_k(v, own, 10).collect()}
        found += len(exact & {r.id for r in vectors.hashed_top_k(v, ix, own, 10).collect()})
        total += len(exact)
    assert found / total >= 0.9


def test_hashed_search_of_every_hundredth_vector(spark):
    from siltstone.plans import index_queries

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no test data")
    exact = {}
    for r in index_queries.knn_every_hundredth(spark, d).collect():
        exact.setdefault(r.query_id, set()).add(r.vec_id)
    got = {}
    for r in index_queries.lsh_topk(spark, d).collect():
        assert r.query_id != r.vec_id
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(got) == set(exact) and all(len(x) == 20 for x in got.values())
    found = sum(len(own & {v for _, v in sorted(got[q])[:10]}) for q, own in exact.items())
    assert found / sum(map(len, exact.values())) >= 0.9


def test_hashed_search_falls_back_per_query(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [-1.0, 0.1]), ("n", None)], "id string, vector array<float>")
    own = df.where("id in ('a', 'c')")
    got = vectors.hashed_top_k_many(df, vectors.signatures(df, 2).where("id = 'x'"), own, 1)
    assert {(r.query_id, r.id) for r in got.collect()} == {("a", "b")}


def test_chunks(spark):
    units = spark.createDataFrame([(i, 1, "x" * 80) for i in range(1, 5)] + [(9, 2, " "), (10, 3, "y" * 500), (11, 3, None), (12, 3, "z")], "id long, file_id long, text string")
    got = {(r.file_id, tuple(r.unit_ids)) for r in vectors.chunks(units, 160, 200, 1).collect()}
    assert got == {(1, (1, 2)), (1, (2, 3)), (1, (3, 4)), (3, (10,)), (3, (12,))}
    assert vectors.chunks(units.limit(0)).count() == 0


def test_queue(spark):
    e = spark.createDataFrame([("r", "a", "upsert", 2, 0), ("r", "a", "delete", 1, 1), ("r", "a", "upsert", 2, 9), ("r", None, "refresh", 0, 5), ("r", "b", "upsert", 1, 20), ("q", "a", "upsert", 1, 0)], "root string, path string, kind string, priority int, s int").withColumn("ts", F.timestamp_seconds("s"))
    items = queue.coalesce(e)
    got = {(r.key, r.kind, r.priority, r.events) for r in items.collect()}
    assert got == {("F|r|a", "delete", 1, 2), ("F|r|a", "upsert", 2, 1), ("R|r", "refresh", 0, 1), ("F|r|b", "upsert", 1, 1), ("F|q|a", "upsert", 1, 1)}
    assert {r.key for r in queue.subsume(items).collect()} == {"R|r", "F|r|a", "F|r|b", "F|q|a"}
    assert queue.subsume(items).count() == 4
    w = spark.createDataFrame([("r", "n", "o", "renamed"), ("r", "x", None, "error"), ("r", "d", None, "deleted")], "root string, path string, old_path string, event string").withColumn("priority", F.lit(1)).withColumn("ts", F.lit(T))
    assert {(r.path, r.kind) for r in queue.from_watcher(w).collect()} == {("o", "delete"), ("n", "upsert"), (None, "refresh"), ("d", "delete")}
    v = {"journal_id": "j", "first_usn": 10, "next_usn": 99}
    why = lambda **c: queue.resume_point(v, c or None)
    assert [why(), why(usn=50, journal_id="j"), why(usn=50, journal_id="k"), why(usn=5, journal_id="j"), why(usn=500, journal_id="j")] == ["no-checkpoint", "replay", "journal-recreated", "records-lost", "ahead-of-journal"]


def test_streams(spark, tmp_path):
    rows = [("r", "a", "upsert", 1, 0), ("r", "a", "delete", 1, 1), ("r", "b", "upsert", 1, 40), ("r", "z", "upsert", 1, 4000)]
    df = spark.createDataFrame(rows, "root string, path string, kind string, priority int, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = queue.coalesce(stream.withWatermark("ts", "10 seconds")).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    assert {(r.key, r.kind, r.events) for r in spark.table("bursts").collect()} >= {("F|r|a", "delete", 2), ("F|r|b", "upsert", 1)}
    more = spark.createDataFrame([("r", "a", "upsert", 2), ("r", None, "refresh", 1), ("r", "b", "upsert", 0), ("s", "c", "delete", 1)], "root string, path string, kind string, priority int").withColumn("ts", F.lit(T))
    more.coalesce(1).write.parquet(str(tmp_path / "in2"))
    s2 = queue.stateful_queue(spark.readStream.schema(more.schema).parquet(str(tmp_path / "in2")), quiet_ms=500)
    q = s2.writeStream.format("memory").queryName("work").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(processingTime="1 second").start()
    try:
        import time

        for _ in range(60):
            time.sleep(1)
            if spark.table("work").count() >= 2:
                break
        assert {(r.root, r.path, r.kind, r.priority) for r in spark.table("work").collect()} == {("r", None, "refresh", 1), ("s", "c", "delete", 1)}
    finally:
        q.stop()


def test_workflow(spark, tmp_path):
    hits = spark.createDataFrame([("/d/a.txt", 1, "alpha"), ("/d/a.txt", 2, "beta, x"), ("/d/b.txt", 1, "beta")], "path string, line_number long, content string")

    def run(q, scope):
        df = hits if scope is None else hits.join(scope, "path", "left_semi")
        return search.search_lines(q, df)

    w = {"name": "w", "steps": [
        {"type": "search", "id": "s1", "query": "alpha"},
        {"type": "search", "id": "s2", "query": "beta", "scope": "s1"},
        {"type": "if", "id": "i", "condition": {"metric": "hitCount", "op": "==", "value": 1, "step": "s2"}, "then": [{"type": "export", "id": "e", "source": "s2", "format": "csv", "path": str(tmp_path / "${name}.csv")}]},
        {"type": "retry", "id": "r", "condition": {"metric": "fileCount", "op": ">=", "value": 2}, "parameterSets": [{"t": "alpha"}, {"t": "beta"}, {"t": "never"}], "steps": [{"type": "search", "id": "s3", "query": "${t}"}]},
        {"type": "forEach", "id": "f", "source": "s3", "steps": [{"type": "runProgram", "id": "p", "program": "cat", "arguments": ["${fileName}", "${unknown}"]}]},
        {"type": "fileOperation", "id": "c", "operation": "copy", "source": "s3", "target": str(tmp_path / "to")},
        {"type": "stop", "id": "x", "message": "done ${name}"},
    ]}
    out = Runner(run).run(w, {"name": "out"})
    assert (out.status, out.message) == ("stopped", "done out"), out
    assert (tmp_path / "out.csv").read_text() == 'path,lineNumber,line\n/d/a.txt,2,"beta, x"\n'
    log = [x for _, x in out.log]
    assert "met after 2" in log and "not started: cat a.txt ${unknown}" in log and not (tmp_path / "to").exists()
    assert validate({"name": "x", "steps": [{"type": "search", "id": "a", "query": "q", "scope": "b"}, {"type": "what", "id": "c"}, {"type": "search", "id": "a", "query": ""}]}) != []
    with pytest.raises(WorkflowError):
        Runner(run).run({"name": "", "steps": []})
    store = Store(str(tmp_path / "store"))
    store.save(w)
    assert store.names() == ["w"] and store.get("w")["steps"] == w["steps"]


def test_exports_and_answers(spark, tmp_path):
    hits = spark.createDataFrame([("b", 1, 'say "x"'), ("a", 2, "y")], "path string, line_number long, content string")
    for kind in ("json", "csv", "markdown"):
        assert results.export_document(hits, str(tmp_path / kind), kind) == 2
    assert (tmp_path / "csv").read_text().endswith('b,1,"say ""x"""\n')
    results.export(hits, str(tmp_path / "jl"), "jsonl")
    assert spark.read.json(str(tmp_path / "jl")).count() == 2
    ev = results.evidence(hits.select("path", F.lit(1).alias("search_rank"), F.lit(0).alias("hit_rank"), F.lit(1.0).alias("score"), F.col("content").alias("text")))
    assert results.answer_markdown("q?", ev).startswith("# q?\n\n2 passages from 2 files.")
    assert "No evidence" in results.answer_markdown("q?", ev.limit(0))


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "x\n\ny")], "k int, text string")
    got = [(r.file_id, r.line_number, r.content) for r in adapters.text_lines(df, "k").orderBy("file_id", "line_number").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, "x"), (4, 2, ""), (4, 3, "y")]
