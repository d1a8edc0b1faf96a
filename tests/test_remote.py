"""Endpoints and paged datasets against servers on the loopback interface, which fail now and then."""

import json
import threading
from collections import Counter
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tamga import cli
from tamga.sources import config, endpoints, paged, providers, readers


@contextmanager
def serving(reply):
    """The address of a server; reply(path, body, headers, times asked alike) gives a status and an object."""
    asked, lock = Counter(), threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def respond(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            with lock:
                asked[self.path, body] += 1
                times = asked[self.path, body]
            status, said = reply(self.path, json.loads(body) if body else None, self.headers, times)
            out = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = respond

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}", asked
    finally:
        server.shutdown()
        server.server_close()


def rows_of(rows, longest=100, fails=1):
    """A dataset server: its pages have `longest` rows at most, and each request fails `fails` times first."""

    def reply(path, body, headers, times):
        if times <= fails:
            return 503, {"error": "overloaded"}
        asked = {k: v[0] for k, v in parse_qs(urlparse(path).query).items()}
        if asked["dataset"] != "own/rows":
            return 404, {"error": "not found"}
        at, n = int(asked["offset"]), min(int(asked["length"]), longest)
        return 200, {"rows": [{"row_idx": i, "row": r} for i, r in list(enumerate(rows))[at : at + n]], "num_rows_total": len(rows)}

    return reply


def test_pages(spark):
    rows = [{"id": f"r{i}", "text": "so‘z\n\"x\"" if i % 3 else None, "n": i, "ord": -i, "tags": ["a"] * (i % 3)} for i in range(257)]
    hashes = set()
    for longest, page, pages in ((100, 10, 3), (7, 50, 1), (100, 100, 50)):
        with serving(rows_of(rows, longest)) as (url, asked):
            got, sha = paged.read_hub(spark, "own/rows", endpoint=url, page=page, pages=pages, pause=0)
            assert [(r.ord, r.id, r.text, r.n, r.tags) for r in got.orderBy("ord").collect()] == [(i, r["id"], r["text"], r["n"], r["tags"]) for i, r in enumerate(rows)]
            assert set(asked.values()) == {2}  # no page is fetched again once it came
            hashes.add(sha)
    assert len(hashes) == 1
    with serving(rows_of(rows[:-1])) as (url, _):
        assert paged.read_hub(spark, "own/rows", endpoint=url, pause=0)[1] not in hashes


def test_pages_that_fail(spark):
    spark.dataSource.register(paged.PagedSource)
    read = lambda url, **kw: spark.read.format("paged").options(endpoint=url, dataset="own/rows", pause="0", **kw).load().count()
    with serving(rows_of([], fails=0)) as (url, _):
        assert read(url) == 0
        with pytest.raises(ValueError, match="no rows"):
            paged.read_hub(spark, "own/rows", endpoint=url)
        with pytest.raises(Exception, match="404"):
            paged.read_hub(spark, "other/rows", endpoint=url)
    with serving(rows_of([{"a": 1}] * 9, fails=3)) as (url, _):
        assert read(url, tries="4") == 9
        with pytest.raises(Exception, match="503"):
            read(url, tries="2", split="b")
    # a server that leaves rows out, or gives others
    for wrong in ([], [{"row_idx": 5, "row": {}}]):
        with serving(lambda path, body, headers, times, wrong=wrong: (200, {"rows": wrong, "num_rows_total": 3})) as (url, _), pytest.raises(Exception, match="not what the server gave"):
            read(url)


def test_hub_by_name(spark, monkeypatch, tmp_path):
    rows = [{"id": str(i), "question": f"savol {i}", "option_A": "a", "option_B": "b", "option_C": "c", "option_D": "d", "answer": "ABCD"[i % 4], "subject": "fizika"} for i in range(25)]
    with serving(rows_of(rows, fails=0)) as (url, _):
        monkeypatch.setenv(paged.ENDPOINT[0], url)
        data = readers.load(spark, "own/rows", revision="abc")
        assert data.source == "hub://own/rows@abc" and data.placed and data.rows.count() == 25 and len(data.sha256) == 64
        entry = cli.run_task(spark, config.TaskConfig("dtm", "own/rows"), config.ModelConfig("m", "stub"), str(tmp_path))
        assert entry["metrics"]["primary"] == 28.0 and entry["dataset_sha256"] == data.sha256


REPLIES = {
    "openai": ("/chat/completions", {"choices": [{"message": {"content": "ha"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}),
    "local": ("/chat/completions", {"choices": [{"message": {"content": None}, "finish_reason": None}]}),
    "anthropic": ("/v1/messages", {"content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "ha"}], "stop_reason": "max_tokens", "usage": {"input_tokens": 3, "output_tokens": 4}}),
    "gemini": ("/models/m:generateContent", {"candidates": [{"content": {"parts": [{"text": "h"}, {"text": "a"}]}, "finishReason": "MAX_TOKENS"}], "usageMetadata": {"promptTokenCount": 3, "candidatesTokenCount": 4}}),
    "ollama": ("/api/chat", {"message": {"content": "ha", "thinking": "x"}, "done_reason": "length", "prompt_eval_count": 3, "eval_count": 4}),
}


@pytest.mark.parametrize("name", REPLIES)
def test_endpoint(spark, name):
    path, said = REPLIES[name]
    seen = []

    def reply(at, body, headers, times):
        if at == "/api/show":
            return 200, {"digest": "0123456789abcdefg", "details": {"quantization_level": "Q4", "family": "f"}}
        if times <= 2:
            return 429, {"error": "rate limit"}
        seen.append((at, body, headers))
        return 200, said

    with serving(reply) as (url, _):
        made = providers.get_provider(name)("m", base_url=url + ("/v1" if name == "ollama" else ""), temperature=0.5, top_p=0.9, seed=7, reasoning="off", pause=0, timeout=20)
        got = providers.run_items(spark.createDataFrame([("1", "savol?")], "item_id string, prompt string"), made, 55).first()
        about = made.describe()
    want = ("", "stop", 0, 0) if name == "local" else ("ha", "length", 3, 4)
    assert (got.text, got.finish_reason, got.prompt_tokens, got.completion_tokens) == want and got.error is None
    ((at, body, headers),) = seen
    assert at == path and "savol?" in json.dumps(body, ensure_ascii=False) and 55 in [*body.values(), *body.get("options", {}).values(), *body.get("generationConfig", {}).values()]
    flat = {**body, **body.get("options", {}), **body.get("generationConfig", {})}
    assert flat["temperature"] == 0.5 and 0.9 in (flat.get("top_p"), flat.get("topP"))
    assert flat.get("seed") == (7 if name in ("openai", "local", "ollama") else None)
    assert flat.get("think", 0) is (False if name in ("openai", "local", "ollama") else 0) or "think" not in flat
    assert (about["revision"], about["quantization"]) == (("0123456789abcdef", "Q4") if name == "ollama" else ("", ""))


def test_endpoint_settings(monkeypatch):
    monkeypatch.setenv("OWN_KEY", "k1")
    monkeypatch.setenv("OPENAI_API_KEY", "k2")
    of = lambda **kw: providers.get_provider(kw.pop("provider", "openai")).configured(config.ModelConfig("gpt-oss:20b", "openai", **kw), {"timeout": 9, "reasoning": kw.get("reasoning", "default")})
    asked = of(api_key_env="OWN_KEY", reasoning="off", extra_body={"n": 1}).request("x", 5)
    assert asked[1] == {"Authorization": "Bearer k1"} and asked[2]["think"] == "low" and asked[2]["n"] == 1 and "seed" not in asked[2]
    assert of().request("x", 5)[1] == {"Authorization": "Bearer k2"} and "think" not in of().request("x", 5)[2]
    assert of(provider="local").url == "http://localhost:8000/v1" and of(provider="local", reasoning="high").request("x", 5)[2]["think"] == "high"
    daemon = of(provider="ollama", extra_body={"options": {"num_ctx": 1}, "raw": True}).request("x", 5)[2]
    assert daemon["options"] == {"num_predict": 5, "temperature": 0.0, "num_ctx": 1} and daemon["raw"] is True
    assert "k1" not in json.dumps(of(api_key_env="OWN_KEY").describe())
    gone = endpoints.ChatDaemon("m", base_url="http://127.0.0.1:9", retries=2, pause=0)
    assert gone.describe()["revision"] == "" and "refused" in gone.generate("x", 5)["error"].lower()


def test_probes(spark):
    def reply(path, body, headers, times):
        model, tokens, think = body["model"], body["options"]["num_predict"], body.get("think")
        if model == "lost":
            return 404, {"error": "no such model"}
        enough = {"plain": True, "thinks": think is False, "long": tokens >= 1024, "longer": tokens >= 4096, "never": False}[model]
        return 200, {"message": {"content": "A" if enough else ""}, "done_reason": "stop" if enough else "length"}

    with serving(reply) as (url, _):
        got = endpoints.probe_models(spark, ["plain", "thinks", "long", "longer", "never", "lost"], "Javob:", url, 0).collect()
    assert {r.model: (r.setting, r.reasoning, r.tokens) for r in got} == {"plain": ("direct", "default", 256), "thinks": ("think off", "off", 256), "long": ("1024", "off", 1024), "longer": ("4096", "off", 4096), "never": ("exclude", None, None), "lost": ("unreachable", None, None)}
    assert {r.model for r in got if r.error} == {"lost"}


def test_shared_folder(spark):
    assert readers.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert spark.range(1).select(F.lit(1)).count() == 1
