import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from quern.__main__ import main
from quern.config import ACKNOWLEDGED, Settings, is_private
from quern.operators.retrieval import search
from quern.sources import services


class Models(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("embeddings"):
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        elif self.path.endswith("rerank"):
            out = {"results": [{"index": i, "relevance_score": -float(len(t))} for i, t in enumerate(body["documents"])]}
        elif self.path.endswith("completions"):
            out = {"choices": [{"message": {"content": f"{body['messages'][1]['content'].splitlines()[-1]} [1]"}}]}
        else:
            out = {}
        data = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Models)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_services(spark, url):
    texts = spark.createDataFrame([("x" * n,) for n in range(40)], "t string").repartition(1)
    got = texts.select(F.length("t").alias("n"), services.embedder(url, 2)("t").alias("v")).collect()
    assert all(r["v"] == [float(r["n"]), 1.0] for r in got) and len(got) == 40
    assert services.rerank_scores(url, "q", ["a", "bb"]) == [-1.0, -2.0] and services.rerank_scores(url, "q", []) == []
    for bad in (lambda: services.embed_batch(url, ["a"], 3), lambda: services.post("http://127.0.0.1:1/x", {})):
        with pytest.raises(services.ServiceError):
            bad()
    assert services.events('event: token\ndata: {"t": 1}\n\n: note\n\ndata: [DONE]\n\ndata: {"u": 2}\n') == [("token", {"t": 1}), ("message", {"u": 2})]
    chunks = spark.createDataFrame([("a", "pump filter long text", 5, "s", "prose"), ("b", "pump", 1, "s", "prose")], "id string, text string, token_count int, source string, kind string")
    vectors = chunks.select("id", services.embedder(url)("text").alias("embedding"))
    hits = search(spark.createDataFrame([(1, "pump")], "query_id int, text string"), chunks, vectors=vectors, embed=services.embedder(url), rerank=services.reranker(url))
    assert [(r["id"], r["score"]) for r in hits.orderBy("rank").collect()] == [("b", -4.0)]


def test_settings():
    assert all(map(is_private, ["http://10.1.2.3", "http://embed:80", "http://localhost", "http://[::1]", "http://x.lan"])) and not any(map(is_private, ["https://api.example.com", "http://8.8.8.8", ""]))
    assert Settings.from_env({"QUERN_DIMENSION": "8", "QUERN_REQUIRE_LOCAL_LLM": "true"}).dimension == 8
    assert Settings(llm_url="https://api.example.com", llm_key="k").sovereignty == "external" and Settings().sovereignty == "local"
    assert Settings(llm_url="https://api.example.com", llm_key="k", require_local_llm=True, external_llm_ack=ACKNOWLEDGED).llm_key
    for bad in (dict(llm_url="https://api.example.com"), dict(llm_url="https://api.example.com", llm_key="k", require_local_llm=True)):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_commands(spark, tmp_path, capsys, url):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "manual.md").write_text("# Oven\n\n## Cleaning\n\nClean the filter weekly with soap.\n\n## Errors\n\nCode E07 means too hot.\n")
    (folder / "broken.xlsx").write_text("no")
    s = Settings(index=f"file://{tmp_path}/index", dimension=16)
    run = lambda *a, s=s: (main(list(a), spark, s), capsys.readouterr().out)
    assert run("docs")[0] == 1
    code, out = run("ingest", f"file://{folder}")
    assert code == 1 and "added: 1" in out and "failed: 1" in out
    assert run("inspect", f"file://{folder}")[0] == 1 and "2 manual.md" in run("docs")[1]
    code, out = run("search", "E07", "--mode", "sparse")
    assert code == 0 and "Oven › Errors" in out and "too hot" in out
    assert run("search", "zzz", "--mode", "sparse")[0] == 1
    code, out = run("ask", "E07", "--mode", "sparse")
    assert code == 0 and "[1] manual.md" in out
    code, out = run("ask", "E07", "--mode", "sparse", s=Settings(index=s.index, dimension=16, llm_url=url))
    assert code == 0 and "E07 [1]" in out
    cases = tmp_path / "cases.jsonl"
    cases.write_text(json.dumps({"id": "1", "question": "E07", "expected_sources": ["manual.md"]}) + "\n" + json.dumps({"id": "2", "question": "zzz", "expected_sources": []}))
    code, out = run("eval", str(cases), "--mode", "sparse")
    assert code == 0 and "hit 100.0%" in out
    assert run("ingest", f"file://{tmp_path}/none")[0] == 2


def test_answers_are_streamed_and_failures_of_a_rewriter_are_null(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            for piece in ("One ", "two", None):
                delta = {"content": piece} if piece else {}
                self.wfile.write(f"data: {json.dumps({'choices': [{'delta': delta}]})}\n\n".encode())
            self.wfile.write(b"data: [DONE]\n\n")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert list(services.stream_completion(url, [{"role": "user", "content": "?"}])) == ["One ", "two"]
    server.shutdown()
    server.server_close()
    with pytest.raises(services.ServiceError):
        list(services.stream_completion(url, []))
    df = spark.createDataFrame([("s", "p")], "a string, b string")
    assert df.select(services.completer(url, strict=False)("a", "b")).first()[0] is None
