import io
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from folioscope.api import Engine
from folioscope.config import EmbeddingConfig, EngineConfig
from folioscope.embedding import BatchEmbedder, HashingEmbedder, PromptEmbedder
from folioscope.operators import context, graph, index, read, search
from folioscope.sources.scan import scan
from folioscope.tools import Server


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    for path, text in {
        "src/TokenChecker.cs": "namespace A;\npublic class TokenChecker\n{\n    public bool Check(string t) { return t.Length > 3; }\n}\n",
        "docs/guide.md": "# Guide\n\nThe TokenChecker validates every login.\n\n## Storage\n\nRows are kept in a table and an index.\n",
        "notes.txt": "Plain notes about the login index.\n",
        "bin/skip.cs": "class Skipped { }",
        "data.csv": "a,b\n1,2\n",
        "secret.env": "X=1",
        "broken.docx": "not a zip",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "index"), EngineConfig(embedding=EmbeddingConfig(provider="hashing", dimension=32)))


def test_scan(spark, tree):
    rows = {os.path.relpath(r.path, tree): r for r in scan(spark, str(tree)).collect()}
    assert set(rows) == {"src/TokenChecker.cs", "docs/guide.md", "notes.txt", "data.csv", "broken.docx"}
    assert len(rows["notes.txt"].hash) == 64
    with pytest.raises(NotADirectoryError):
        scan(spark, str(tree / "notes.txt"))


def test_incremental_runs(engine, tree, tmp_path):
    first = engine.index(str(tree))
    assert (first.scanned, first.indexed, first.failed, first.skipped) == (5, 4, 1, 0)
    ids = {r.path: r.doc_id for r in engine.documents.collect()}
    again = engine.index(str(tree))
    assert (again.indexed, again.skipped, again.failed, again.deleted) == (0, 4, 1, 0)
    (tree / "notes.txt").write_text("Changed notes about tables.\n")
    (tree / "data.csv").unlink()
    third = engine.index(str(tree))
    assert (third.indexed, third.skipped, third.deleted) == (1, 2, 1)
    now = {r.path: r.doc_id for r in engine.documents.collect()}
    assert now.items() <= ids.items() and len(now) == 3
    assert engine.chunks.where(F.col("content").contains("Changed")).count() == 1 and engine.chunks.where("embedding is null").count() == 0
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.txt").write_text("another root")
    assert engine.index(str(other)).deleted == 0 and engine.documents.count() == 4
    assert engine.index(str(other), prune_outside_root=True).deleted == 3 and engine.documents.count() == 1


def test_one_change_rewrites_one_bucket(spark, tree, tmp_path, monkeypatch):
    store = index.Store(spark, str(tmp_path / "bucketed"), buckets=16)
    for k in range(30):
        (tree / f"docs/n{k}.txt").write_text(f"Note number {k} about lying and tables.\n")
    first = index.run_index(store, str(tree))
    index.rebuild_edges(store)
    assert first.indexed == 34 and first.duration_ms > 0
    before = store.manifest()["tables"]
    hashed = []
    real = index.parsed_files
    monkeypatch.setattr(index, "parsed_files", lambda files, *a: hashed.append(files.count()) or real(files, *a))
    path = str(tree / "docs/n3.txt")
    (tree / "docs/n3.txt").write_text("Note number 3, changed.\n")
    again = index.run_index(store, str(tree), only=path)
    assert (again.scanned, again.indexed, hashed) == (1, 1, [1])
    after = store.manifest()["tables"]
    for name in ("documents", "document_chunks", "document_sections"):
        assert sum(after[name].get(b) != before[name].get(b) for b in {*after[name], *before[name]}) == 1, name
    assert store.table("documents").count() == 34 and store.table("document_chunks").where(F.col("content").contains("changed")).count() == 1
    owner = store.table("documents").select(store.bucket_of(F.col("doc_id")).alias("b")).distinct().count()
    assert owner == len(after["documents"])
    for r in store.table("document_chunks").select("id", "document_id").collect():
        assert r.id % 16 == r.document_id % 16
    os.remove(path)
    assert index.run_index(store, str(tree), only=path).deleted == 1 and store.table("documents").count() == 33
    assert index.run_index(store, str(tree), only=path).indexed == 0
    odd = tree / "docs/odd [1]{a}*?.txt"
    odd.write_text("a name of special characters")
    assert index.run_index(store, str(tree), only=[str(odd), str(tree / "docs/n4.txt")]).scanned == 2
    # A path that isn't under the root is none of this run's business.
    assert index.run_index(store, str(tree / "src"), only=str(odd)).deleted == 0 and store.table("documents").count() == 34


def test_stored_postings_equal_the_scan(spark, tree, tmp_path):
    store = index.Store(spark, str(tmp_path / "posted"), buckets=4)
    texts = {"a.txt": "the dying plant and the lie", "b.txt": "he was lying about the plants", "c.txt": "planting, tied and tying", "d.txt": "plant plant plant", "e.txt": "nothing of it"}
    for name, text in texts.items():
        (tree / name).write_text(text)
    index.run_index(store, str(tree))
    (tree / "d.txt").write_text("now it lies elsewhere")
    (tree / "e.txt").unlink()
    index.run_index(store, str(tree))
    assert len(store.manifest()["postings"]) == 2
    chunks, documents = store.table("document_chunks"), store.table("documents")
    for merged in (False, True):
        if merged:
            store.merge_postings(most=1)
            assert len(store.manifest()["postings"]) == 1
        for text in ("dying", "lie", "plant", "tie", "lie plant", '"dying plant"', "plant -lying", "plants or tying", "elsewhere", "login index"):
            q = search.SearchQuery(text)
            rows = [[(r.chunk_id, round(r.fts_rank, 9)) for r in search.text_top(chunks, documents, q, postings=p).collect()] for p in (None, store.postings())]
            assert rows[0] == rows[1] and rows[0], text
    plan = search.posting_scores(store.postings(), search.parse_web_query("lie"))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "term" in plan.split("PushedFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        index.Store(spark, str(tmp_path / "x"), buckets=3)


def test_graph_and_reads(engine, tree):
    engine.index(str(tree))
    n = engine.build_relationships()
    assert engine.build_relationships() == n and engine.edges.select("id").distinct().count() == n
    kinds = {r.relationship_type for r in engine.edges.collect()}
    assert kinds == {"CONTAINS", "DEFINED_IN", "MENTIONS"}
    refs = engine.references("TokenChecker")
    assert refs and refs[0]["source_path"].endswith("guide.md") and refs[0]["confidence"] == 0.85
    assert {r["direction"] for r in engine.related("TokenChecker")} == {"incoming"}
    assert "validates" in engine.read(read.ReadRequest("guide.md"))["content"]
    assert engine.read(read.ReadRequest("guide.md", section="storage"))["content"].startswith("Rows are kept")
    assert "Check" in engine.read(read.ReadRequest("TokenChecker.cs", symbol="check"))["content"]
    assert engine.read(read.ReadRequest("notes.txt", line_start=1, line_end=1))["content"].startswith("Plain")
    assert engine.read(read.ReadRequest("data.csv", line_start=40))["content"] == "" and engine.read(read.ReadRequest("nope.txt")) is None
    assert engine.find("token")[0]["name"] == "TokenChecker"
    labels = [r["label"] for r in engine.outline("TokenChecker.cs")]
    assert "Class TokenChecker" in labels and "Method Check" in labels
    doc = engine.list(document_type="code")[0]
    assert engine.open(doc["doc_id"])["kind"] == "document" and len(engine.document(doc["doc_id"])["symbols"]) == 2
    chunk = engine.chunks.first()["id"]
    assert engine.open(chunk)["kind"] == "chunk" and engine.open(1) is None
    status = engine.status()
    assert status["documents"] == 4 and status["type:code"] == 1
    assert engine.delete(str(tree / "docs/guide.md")) and not engine.delete("x") and engine.references("TokenChecker") == []


def test_search_modes(engine, tree):
    engine.index(str(tree))
    text = engine.results("login index", "text")
    assert text[0]["filename"] == "notes.txt" and "<b>login</b>" in text[0]["preview"]
    assert engine.results("   ", "hybrid") == [] and engine.results("the of", "text") == []
    hybrid = engine.results("login index")
    assert hybrid[0]["filename"] == "notes.txt" and {"rrf_score", "fts_score", "semantic_score"} == set(hybrid[0]["score_components"])
    assert engine.results(search.SearchQuery("login", extension="md"), "text")[0]["filename"] == "guide.md"
    semantic = engine.results("plain notes about the login index", "semantic")
    assert semantic[0]["filename"] == "notes.txt" and 0 <= semantic[0]["score"] <= 1.0001
    assert engine.metrics.snapshot()["total_searches"] == 6
    pack = engine.context("login", 400)
    assert "## Relevant Excerpts" in pack["text"] and pack["chunks"] >= 1 and pack["tokens"] <= 400


def test_inverted_lists(spark, engine, tree):
    import numpy as np

    from folioscope.operators import vector_index as V

    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24))
    x[1500:] = x[rng.integers(0, 1500, 1500)] + rng.standard_normal((1500, 24)) * 0.2
    bad = [(90_000, 1, 5, None), (90_001, 1, 5, [0.0] * 24), (90_002, 1, 5, [1.0] * 3), (90_003, 1, 5, [float("nan")] * 24)]
    rows = spark.createDataFrame([(i, 1, 5, [float(v) for v in r]) for i, r in enumerate(x)] + bad, "chunk_id bigint, document_id bigint, version bigint, embedding array<float>")
    lists = V.fit(rows, 24, lists=40)
    held = V.assigned(rows, lists).cache()
    assert held.count() == held.select("chunk_id").distinct().count() == 3000 and lists.probes <= len(lists.centroids) == 40
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = read = 0
    for q in rng.choice(3000, 20, replace=False):
        near = {r.chunk_id for r in V.candidates(held, lists, x[q].tolist()).select("chunk_id").collect()}
        top = np.argsort(-(u @ u[q]), kind="stable")[1:11]
        found, total, read = found + sum(int(k) in near for k in top), total + 10, read + len(near)
    assert found >= 0.9 * total and read < 20 * 3000 * 0.9
    assert V.fit(rows.limit(0), 24).probes == 1 and V.assigned(rows.limit(0), lists).count() == 0
    # In the engine: rows added later and changed later are found, stale ones are not.
    engine.index(str(tree))
    want = [r["path"] for r in engine.results("plain notes about the login index", "semantic")]
    assert engine.build_vector_index(lists=2) >= 1 and engine.store.vectors()[0].count() == engine.chunks.count()
    assert [r["path"] for r in engine.results("plain notes about the login index", "semantic")][0] == want[0]
    (tree / "late.txt").write_text("zebra crossing")
    (tree / "notes.txt").write_text("something else")
    engine.index(str(tree))
    assert len(engine.store.manifest()["vectors"]["segments"]) == 2
    assert engine.results("zebra crossing", "semantic")[0]["filename"] == "late.txt"
    assert all("Plain" not in r["preview"] for r in engine.results("plain notes about the login index", "semantic"))


def test_fusion_order(spark):
    t = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.4), (3, 1, 0.4)], "chunk_id bigint, document_id bigint, fts_rank double")
    s = spark.createDataFrame([(1, 1, 0.9), (4, 1, 0.8), (2, 1, -0.2)], "chunk_id bigint, document_id bigint, similarity double")
    rows = search.fuse(t, s).orderBy(*search.fused_order()).collect()
    assert [r.chunk_id for r in rows] == [1, 2, 4, 3]
    assert abs(rows[0].score - 100 / 61) < 1e-9 and rows[1].semantic_score == 0.0 and rows[2].text_pos is None


def test_packing_overflow(spark):
    c = spark.createDataFrame([(i, i, f"f{i}", "/p", None, "line 1", 0.5) for i in range(1, 5)], "chunk_id bigint, rank int, filename string, path string, section_title string, location string, score double")
    k = spark.createDataFrame([(1, "a" * 300), (2, "a" * 300), (3, "b" * 900), (4, "c" * 10)], "id bigint, content string")
    rows = context.pack(context.excerpts(c, k), 1000).orderBy("rank").collect()
    assert [(r.chunk_id, r.truncated) for r in rows] == [(1, False), (3, True)] and sum(len(r.excerpt) for r in rows) <= 1000
    assert [r.chunk_id for r in context.pack(context.excerpts(c, k), 600).collect()] == [1]


def test_mention_cap(spark):
    docs = spark.createDataFrame([(1, "/a", "code"), (2, "/b", "document")], "doc_id bigint, path string, document_type string")
    symbols = spark.createDataFrame([(1, 1, "Alpha"), (2, 2, "Beta1"), (3, 2, "Gamma"), (4, 1, "abc"), (5, 1, "Delta")], "id bigint, document_id bigint, name string")
    chunks = spark.createDataFrame([(10, 1, "Beta1 Gamma Alpha"), (11, 2, "xAlphax Delta abc"), (11, 2, "xAlphax Delta abc"), (12, 2, None), (13, 1, " ")], "id bigint, document_id bigint, content string")
    got = {(r.source_id, r.target_id, r.relationship_type) for r in graph.mentions(chunks, symbols, docs).collect()}
    assert got == {(10, 2, "REFERENCES"), (10, 3, "REFERENCES"), (11, 1, "MENTIONS"), (11, 5, "MENTIONS")}
    one = {(r.source_id, r.target_id) for r in graph.mentions(chunks, symbols, docs, max_symbols=1).collect()}
    assert one == {(10, 2), (11, 1)}


def test_providers():
    seen = []

    def post(url, body, headers=None):
        seen.append((url, body, headers))
        return {"embedding": [0.1, 0.2]} if "prompt" in body else {"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]}

    assert PromptEmbedder(EmbeddingConfig(endpoint="http://h/"), post)(["x"]) == [[0.1, 0.2]] and seen[0][0] == "http://h/api/embeddings"
    assert BatchEmbedder(EmbeddingConfig(endpoint="http://h", api_key="k"), post)(["a", "b"]) == [[1, 0], [0, 1]] and seen[1][2] == {"Authorization": "Bearer k"}
    assert HashingEmbedder(8)(["", "a b"])[0] is None


def test_failing_provider_keeps_chunks(spark):
    df = spark.createDataFrame([(1, "x", None, {"k": "v"}), (2, " ", None, None), (3, "y", [1.0], None)], "id bigint, content string, embedding array<float>, metadata map<string,string>")

    def fail(texts):
        raise OSError("down")

    rows = {r.id: r for r in index.embed_missing(df, fail).collect()}
    assert rows[1].embedding is None and rows[1].metadata == {"k": "v"} and rows[3].embedding == [1.0]
    rows = {r.id: r.embedding for r in index.embed_missing(df, lambda t: [[0.5]] * len(t)).collect()}
    assert rows == {1: [0.5], 2: None, 3: [1.0]}


def test_tool_server(engine, tree, monkeypatch):
    engine.index(str(tree))
    monkeypatch.chdir(tree)
    server = Server(engine)
    call = lambda tool, **a: server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": a}}))
    assert server.handle("{")["error"]["code"] == -32700
    assert server.handle('{"id": 1, "method": "zz"}')["error"]["code"] == -32601
    assert server.handle('{"method": "notifications/initialized"}') is None
    assert len(server.handle('{"id": 2, "method": "tools/list"}')["result"]["tools"]) == 7
    assert call("nope")["error"]["code"] == -32602 and call("search")["result"]["isError"]
    assert "TokenChecker" in call("find", name="token")["result"]["content"][0]["text"]
    assert call("open", file="../../etc/x.md")["result"]["isError"] and not call("open", file="docs/guide.md")["result"]["isError"]
    assert "Guide" in call("outline", file="docs/guide.md")["result"]["content"][0]["text"]
    for tool, args in (("search", {"query": "login"}), ("references", {"symbol": "Token"}), ("related", {"target": "Token"}), ("context", {"query": "login"})):
        assert not call(tool, **args)["result"]["isError"]
    body = b'{"id": 5, "method": "ping"}'
    out = io.BytesIO()
    server.serve(io.BytesIO(body + b"\nContent-Length: %d\r\n\r\n%s" % (len(body), body)), out)
    assert out.getvalue().startswith(b'{"jsonrpc": "2.0", "id": 5, "result": {}}\nContent-Length: ')


def test_changes_wait_until_the_directory_is_quiet(tree, tmp_path):
    from folioscope.streaming.watch import _Reader

    reader = _Reader({"path": str(tree), "statedir": str(tmp_path / "state"), "quietms": "400"})
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == []
    for k in range(3):  # each change starts the wait anew
        (tree / "notes.txt").write_text(f"version {k} " + "x" * k)
        assert list(reader.read(start)[0]) == []
        time.sleep(0.25)
        assert list(reader.read(start)[0]) == []
    time.sleep(0.3)
    rows, end = reader.read(start)
    assert [(os.path.basename(r[0]), r[1]) for r in rows] == [("notes.txt", "UPSERT")] and end == {"n": 1}
    assert [r[:2] for r in reader.readBetweenOffsets(start, end)] == [(str(tree / "notes.txt"), "UPSERT")]
    assert list(reader.read(end)[0]) == []


def test_watch(spark, tree, tmp_path):
    from folioscope.streaming.watch import watch

    store = index.Store(spark, str(tmp_path / "watched"))
    index.run_index(store, str(tree))
    query = watch(store, str(tree), str(tmp_path / "state"), quiet_ms=200)
    try:
        query.processAllAvailable()
        (tree / "new.txt").write_text("fresh file")
        (tree / "notes.txt").unlink()
        os.rename(tree / "data.csv", tree / "moved.csv")
        (tree / "~$lock.txt").write_text("x")
        for _ in range(60):
            query.processAllAvailable()
            names = {r.filename for r in store.table("documents").collect()}
            if {"new.txt", "moved.csv"} <= names and not {"notes.txt", "data.csv"} & names:
                break
            time.sleep(0.5)
        assert query.exception() is None
        assert {"new.txt", "moved.csv"} <= names and not {"notes.txt", "data.csv"} & names
    finally:
        query.stop()
