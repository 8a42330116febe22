"""The ASGI host in process, the stream bridge, and live invokers over a fake transport."""

import asyncio
import io
import json

import pytest
from pyspark.sql import functions as F

from tabscout import errors, host, settings
from tabscout.operators import answers, live

CSV = b"Fecha;Cliente;Importe\n2024-01-01;x;1.50\n2024-01-02;y;2.50\n"


def call(app, method, path, body=(b"",), query="", headers=()):
    """(status, json, headers) of one request."""
    parts, out = list(body), []

    async def receive():
        part = parts.pop(0) if parts else b""
        return {"type": "http.request", "body": part, "more_body": bool(parts)}

    async def reply(message):
        out.append(message)

    scope = {"type": "http", "method": method, "path": path, "query_string": query.encode(), "headers": list(headers)}
    asyncio.run(app(scope, receive, reply))
    return out[0]["status"], json.loads(out[1]["body"]), {k.decode(): v.decode() for k, v in out[0]["headers"]}


def test_raw_body(spark):
    app = host.create(spark)
    status, body, headers = call(app, "POST", "/inspect/raw", [CSV[:10], CSV[10:]], headers=[(b"x-request-id", b"abc-1")])
    assert status == 200 and body["delimiter"] == ";" and body["columns"] == ["Fecha", "Cliente", "Importe"]
    assert headers["X-Request-ID"] == "abc-1" and headers["X-Inspection-Model"] == "heuristic"


def test_errors_are_problems(spark):
    app = host.create(spark, options=host.Options(max_body_bytes=20))
    assert call(app, "POST", "/inspect/raw", [b""])[:2] == (422, {"title": "Empty source", "status": 422, "detail": "the source is empty", "error": "EmptySampleError"})
    assert call(app, "POST", "/inspect/raw", [CSV])[0] == 413 and call(app, "POST", "/inspect/raw", headers=[(b"content-length", b"99")])[0] == 413
    assert call(app, "POST", "/inspect/raw", [CSV], "n_bytes=1")[0] == 422 and call(app, "POST", "/inspect/raw", [CSV], "model=m")[0] == 403
    assert call(app, "GET", "/nowhere")[0] == 404
    assert call(app, "POST", "/inspect/object", [b'{"uri": "gs://bucket/a.csv"}'])[0] == 503 and call(app, "POST", "/inspect/object", [b'{"uri": "file:///etc/passwd"}'])[0] == 422


def test_object_and_health(spark):
    class Blob(io.BytesIO):
        size, generation = len(CSV), 7

    app = host.create(spark, settings.Settings(llm_backend="api", api_model="m"), host.Options(open_object=lambda uri, generation: Blob(CSV)))
    status, body, headers = call(app, "POST", "/inspect/object", [b'{"uri": "gs://bucket/a.csv", "generation": 7}'])
    assert (status, body["delimiter"], headers["X-Object-Size"], headers["X-Object-Generation"]) == (200, ";", str(len(CSV)), "7")
    assert call(app, "GET", "/health")[0] == 200 and call(app, "GET", "/health", query="probe=true")[0] == 503


def test_slots_turn_away():
    async def run():
        slots = host.Slots(1, 0.02)
        async with slots:
            with pytest.raises(host.ServerBusyError) as busy:
                async with slots:
                    pass
        async with slots:
            return busy.value.after

    assert asyncio.run(run()) == 1 and host.problem(host.ServerBusyError("x", 3))[2] == {"Retry-After": "3"}


def test_reader_stalls_and_closes():
    async def forever():
        yield b"abc"
        await asyncio.sleep(30)

    async def run():
        reader = host.AsyncReader(forever(), asyncio.get_running_loop(), seconds=0.05)
        assert await asyncio.to_thread(reader.read, 2) == b"ab" and await asyncio.to_thread(reader.read, 9) == b"c"
        with pytest.raises(errors.FileSampleReadError):
            await asyncio.to_thread(reader.read, 1)
        reader.close()
        with pytest.raises(errors.FileSampleReadError):
            reader.read(1)

    asyncio.run(run())


def test_request_ids(spark):
    assert host.request_id("ok") == "ok" and len(host.request_id("no blanks")) == 36 and len(host.request_id(None)) == 36
    rows = spark.createDataFrame([("ok",), ("no blanks",), (None,)], "g string").select(host.request_id_column(F.col("g")).alias("i")).collect()
    assert rows[0]["i"] == "ok" and len(rows[1]["i"]) == 36 and len(rows[2]["i"]) == 36
    with pytest.raises(ValueError):
        host.Options(timeout_seconds=400)


class Server:
    """Answers in turn, and what it was asked."""

    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def __call__(self, method, url, headers, body, seconds):
        self.asked.append((method, url.split("/api/")[-1], body and json.loads(body), headers))
        status, reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return status, {"Retry-After": "2"} if status in (429, 503) else {}, json.dumps(reply).encode()


CHAT = {"message": {"content": "{}"}, "prompt_eval_count": 5, "eval_count": 2, "load_duration": 2_000_000_000}


def test_local_chat():
    server = Server((200, {"capabilities": ["thinking"]}), (400, {"error": "invalid format"}), (200, CHAT), (200, CHAT))
    local = live.LocalChat(fields=40, transport=server)
    reply = local("p", "m")
    assert (reply.text, reply.prompt_tokens, reply.completion_tokens, reply.load_seconds) == ("{}", 5, 2, 2.0)
    assert [a[1] for a in server.asked] == ["show", "chat", "chat"] and server.asked[1][2]["format"] == answers.response_schema() and server.asked[2][2]["format"] == "json"
    assert server.asked[1][2]["think"] is False and server.asked[1][2]["options"]["num_predict"] == 832 and server.asked[1][2]["options"]["num_ctx"] == 8192
    local("p", "m")
    assert len(server.asked) == 4
    for reply, kind in (((200, {"message": {"content": ""}}), errors.ModelInvocationError), ((0, TimeoutError()), errors.ModelTimeoutError), ((500, {}), errors.ModelInvocationError)):
        with pytest.raises(kind):
            live.LocalChat(transport=Server((404, {}), reply))("p", "m")
    assert live.LocalChat(transport=Server((200, {"models": [{"name": "m", "size": 9, "size_vram": 4}]}))).footprint("m") == {"size": 9, "vram": 4}


def test_cloud_generate():
    good = {"candidates": [{"content": {"parts": [{"text": "{}"}]}}], "usageMetadata": {"promptTokenCount": 3}}
    waits = []
    reply = live.CloudGenerate("key", transport=Server((429, {}), (200, good)), sleep=waits.append)("p", "m")
    assert (reply.text, reply.prompt_tokens, reply.retries, waits) == ("{}", 3, 1, [2.0])
    with pytest.raises(errors.BackendConfigurationError) as denied:
        live.CloudGenerate("key", transport=Server((403, {"error": "key is bad"})))("p", "m")
    assert "key is" not in str(denied.value)
    with pytest.raises(errors.ModelInvocationError, match="SAFETY"):
        live.CloudGenerate("key", transport=Server((200, {"candidates": [{"finishReason": "SAFETY"}]})))("p", "m")
    with pytest.raises(errors.BackendConfigurationError):
        live.CloudGenerate(None)
