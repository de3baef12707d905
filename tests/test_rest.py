import json
import os
import sys
import threading
import urllib.error
import urllib.request

import pytest

from folioscope import rest
from folioscope.api import Engine
from folioscope.callgraph import CallGraphProgram, declarations
from folioscope.config import EmbeddingConfig, EngineConfig


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("rest")
    (root / "src").mkdir()
    (root / "src/TokenChecker.cs").write_text("namespace A;\npublic class TokenChecker\n{\n    public bool Check(string t) { return true; }\n}\n")
    (root / "guide.md").write_text("# Guide\n\nThe TokenChecker validates every login.\n\n## Storage\n\nRows are kept in an index.\n")
    engine = Engine(spark, str(root / ".index"), EngineConfig(embedding=EmbeddingConfig(provider="hashing", dimension=16)))
    engine.index(str(root))
    engine.build_relationships()
    engine.folder = root
    return engine


def _ask(routes, method, target, /, **body):
    return routes.handle(method, target, json.dumps(body).encode() if body else b"")


def test_routes(engine, monkeypatch):
    monkeypatch.chdir(engine.folder)
    routes = rest.Routes(engine)
    status, found = _ask(routes, "GET", "/api/status")
    assert status == 200 and found["stats"]["documents"] == 2 and found["observability"]["indexed"] == 2
    for target, body in (("/api/search", {"query": "login", "mode": "text"}), ("/api/search", {"query": "login"}), ("/api/semantic-search", {"query": "login"}), ("/api/hybrid-search", {"query": "login", "extension": "md", "limit": 3})):
        status, found = _ask(routes, "POST", target, **body)
        assert status == 200 and found[0]["filename"] == "guide.md", target
    status, found = _ask(routes, "GET", "/api/documents?docType=code&limit=5")
    assert status == 200 and [d["filename"] for d in found] == ["TokenChecker.cs"]
    key = found[0]["doc_id"]
    status, found = _ask(routes, "GET", f"/api/documents/{key}")
    assert status == 200 and len(found["symbols"]) == 2
    assert "Class TokenChecker" in [r["label"] for r in _ask(routes, "GET", f"/api/documents/{key}/outline")[1]]
    assert _ask(routes, "POST", "/api/read", pathOrFilename="guide.md", section="storage")[1]["content"].startswith("Rows")
    assert _ask(routes, "POST", "/api/find", name="token", symbolType="Class")[1][0]["name"] == "TokenChecker"
    assert _ask(routes, "POST", "/api/related", target="TokenChecker")[1][0]["direction"] == "incoming"
    assert _ask(routes, "POST", "/api/references", symbol="TokenChecker")[1][0]["source_path"].endswith("guide.md")
    (engine.folder / "late.txt").write_text("a late note")
    assert _ask(routes, "POST", "/api/index", path=str(engine.folder / "late.txt"))[1]["indexed"] == 1
    assert _ask(routes, "POST", "/api/index", path=str(engine.folder))[1]["indexed"] == 0


def test_refusals(engine):
    routes = rest.Routes(engine)
    for want, method, target, body in (
        (404, "GET", "/api/nothing", {}), (405, "POST", "/api/status", {}), (404, "GET", "/api/documents/1", {}), (404, "GET", "/api/documents/1/outline", {}), (400, "POST", "/api/find", {"name": " "}), (400, "POST", "/api/related", {}),
        (400, "POST", "/api/references", {}), (400, "POST", "/api/read", {}), (400, "POST", "/api/read", {"pathOrFilename": "../../x.pem"}), (404, "POST", "/api/read", {"pathOrFilename": "nope.md"}), (400, "POST", "/api/index", {"path": "/no/such/place"}),
        (400, "POST", "/api/search", {"query": "x", "limit": "many"}),
    ):
        status, found = _ask(routes, method, target, **body)
        assert status == want and found["error"], target
    assert routes.handle("POST", "/api/search", b"{")[0] == 400 and routes.handle("POST", "/api/search", b"[1]")[0] == 400


def test_server(engine):
    http = rest.server(engine, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = "http://127.0.0.1:{}".format(http.server_address[1])
    try:
        with urllib.request.urlopen(f"{base}/api/documents?limit=1") as answer:
            assert answer.status == 200 and len(json.load(answer)) == 1
        request = urllib.request.Request(f"{base}/api/find", json.dumps({"name": "check"}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request) as answer:
            assert {r["name"] for r in json.load(answer)} == {"Check", "TokenChecker"}
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"{base}/api/none")
        assert e.value.code == 404
    finally:
        http.shutdown()
        http.server_close()


def test_outside_call_graph(spark, engine, tmp_path):
    assert declarations("=== a.cs\n public class Foo : Bar\n## b.cs (lines 1-9)\nx record Point(int X)\nno\n") == [("class", "Foo", "a.cs"), ("record", "Point", "b.cs (lines 1-9)")]
    program = tmp_path / "program.py"
    program.write_text("import sys\nif sys.argv[1] == 'explore': print('## caller.cs\\nclass Caller uses ' + sys.argv[2])\nelse: sys.exit(sys.argv[1] != 'sync')\n")
    deep = tmp_path / "work" / "deep"
    deep.mkdir(parents=True)
    tool = CallGraphProgram([sys.executable, str(program)], str(deep))
    assert not tool.available() and tool.explore("x").symbols == [] and not tool.explore("x").available
    os.mkdir(tmp_path / "work" / ".codegraph")
    assert tool.root() == str(tmp_path / "work") and tool.sync()
    found = tool.explore("TokenChecker")
    assert found.available and found.symbols == [("class", "Caller", "caller.cs")]
    os.mkdir(deep / ".git")
    assert CallGraphProgram(["x"], str(deep)).root() is None
    assert not CallGraphProgram(["/no/such/program"], str(tmp_path / "work")).sync()
    engine.call_graph = tool
    os.rmdir(deep / ".git")
    try:
        assert [r["neighbour"] for r in engine.related("TokenChecker") if r["relationship_type"] == "CALLS"] == ["class Caller"]
        assert {r["source_path"] for r in engine.references("TokenChecker") if r["source_type"] == "CodeSymbol"} == {"caller.cs"}
    finally:
        engine.call_graph = None
