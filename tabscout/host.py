"""An HTTP host as a plain ASGI application: inspection of a streamed body or of an object by URI.

    application = host.create(spark)           # any ASGI server runs it

POST /inspect/raw    the body is the file; it is read as it arrives, with bounded memory
POST /inspect/object {"uri": ..., "generation": ...}, through the injected opener
GET  /health         with ?probe=true the settings are checked too
"""

from __future__ import annotations

import asyncio
import json
import logging
import math
import re
import time
import uuid
from collections.abc import AsyncIterator, Callable
from dataclasses import dataclass
from typing import Any
from urllib.parse import parse_qs

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabscout import constants as C
from tabscout import errors, settings
from tabscout.operators import inspection, invokers
from tabscout.sources import windows

logger = logging.getLogger(__name__)
logger.addHandler(logging.NullHandler())


class ServerBusyError(errors.TabscoutError):
    """No slot became free in time; `after` is the Retry-After."""

    def __init__(self, message: str, after: int) -> None:
        super().__init__(message)
        self.after = after


class Slots:
    """Inspections that may run at once; one that waits too long is turned away."""

    def __init__(self, n: int = C.HOST_SLOTS, wait: float = C.HOST_QUEUE_SECONDS) -> None:
        self.n, self.wait, self._free = n, wait, asyncio.Semaphore(n)

    async def __aenter__(self) -> None:
        try:
            await asyncio.wait_for(self._free.acquire(), self.wait)
        except (TimeoutError, asyncio.TimeoutError):
            raise ServerBusyError(f"all {self.n} slots stayed busy for {self.wait:g} s", max(1, math.ceil(self.wait))) from None

    async def __aexit__(self, *_: Any) -> None:
        self._free.release()


class AsyncReader:
    """A blocking binary stream over an asynchronous one, for a worker thread.

    Chunks come from the loop one at a time; more than `most` bytes is BodyTooLargeError, a chunk that takes
    longer than `seconds` FileSampleReadError. close() lets a waiting thread go.
    """

    def __init__(self, chunks: AsyncIterator[bytes], loop: asyncio.AbstractEventLoop, most: int = C.HOST_MAX_BODY_BYTES, seconds: float | None = None) -> None:
        self._chunks, self._loop, self._most, self._seconds = chunks, loop, most, seconds
        self._rest, self._ended, self._closed, self._waiting = b"", False, False, None
        self.bytes_read = 0

    def seekable(self) -> bool:
        return False

    async def _next(self) -> bytes:
        return await asyncio.wait_for(anext(self._chunks, b""), self._seconds)

    def read(self, n: int = -1) -> bytes:
        if self._closed:
            raise errors.FileSampleReadError("the reader is closed")
        while not self._rest and not self._ended:
            self._waiting = asyncio.run_coroutine_threadsafe(self._next(), self._loop)
            try:
                self._rest = self._waiting.result()
            except (TimeoutError, asyncio.TimeoutError):
                raise errors.FileSampleReadError(f"no data for {self._seconds:g} s") from None
            except (asyncio.CancelledError, RuntimeError):
                raise errors.FileSampleReadError("the reader was closed") from None
            self._ended = not self._rest
            self.bytes_read += len(self._rest)
            if self.bytes_read > self._most:
                raise errors.BodyTooLargeError(f"the body exceeds {self._most} bytes")
        out, self._rest = (self._rest, b"") if n < 0 else (self._rest[:n], self._rest[n:])
        return out

    def close(self) -> None:
        self._closed = True
        if self._waiting is not None:
            self._waiting.cancel()


def request_id(given: str | None) -> str:
    """The caller's id if it is short and printable, else a new one."""
    return given if given and re.fullmatch(C.REQUEST_ID, given) else str(uuid.uuid4())


def request_id_column(given: Column) -> Column:
    """The same for a table of requests."""
    return F.when(given.rlike(rf"\A{C.REQUEST_ID}\z"), given).otherwise(F.uuid())


def usage_headers(usage: dict[str, Any] | None) -> dict[str, str]:
    """The model that answered, and token counts that it reported."""
    pairs = (("X-Inspection-Model", "model"), ("X-Inspection-Prompt-Tokens", "prompt_tokens"), ("X-Inspection-Completion-Tokens", "completion_tokens"))
    return {h: str(usage[k]) for h, k in pairs if usage and usage.get(k) is not None}


def problem(error: BaseException) -> tuple[int, dict[str, Any], dict[str, str]]:
    """Status, body and headers of an error, as problem details."""
    if isinstance(error, ServerBusyError):
        status, title, extra = 503, "Server busy", {"Retry-After": str(error.after)}
    elif isinstance(error, PermissionError):
        status, title, extra = 403, "Not allowed", {}
    elif isinstance(error, (ValueError, KeyError)):
        status, title, extra = 422, "Invalid request", {}
    else:
        (status, title), extra = errors.status_of(error), {}
    detail = str(error) if isinstance(error, (errors.TabscoutError, ValueError, PermissionError)) else "see the server's log"
    return status, {"title": title, "status": status, "detail": detail, "error": type(error).__name__}, extra


@dataclass
class Options:
    """What the host allows. `open_object` gives a binary stream for (uri, generation)."""

    invoker: invokers.Invoker = invokers.heuristic
    allow_model_override: bool = False
    max_body_bytes: int = C.HOST_MAX_BODY_BYTES
    slots: int = C.HOST_SLOTS
    queue_seconds: float = C.HOST_QUEUE_SECONDS
    timeout_seconds: float = C.HOST_TIMEOUT_SECONDS
    max_timeout_seconds: float = C.HOST_MAX_TIMEOUT_SECONDS
    open_object: Callable[[str, int | None], Any] | None = None

    def __post_init__(self) -> None:
        if self.timeout_seconds > self.max_timeout_seconds:
            raise ValueError("the default time-out is above the longest")


def _asked(query: str, options: Options) -> dict[str, Any]:
    """The parameters of a request, each in range."""
    q = {k: v[-1] for k, v in parse_qs(query).items()}
    number = lambda k, d, kind=int: kind(q.get(k, d))
    return settings.check_request(number("n_bytes", C.DEFAULT_HEAD_BYTES), number("tail_bytes", C.DEFAULT_TAIL_BYTES), number("timeout_seconds", options.timeout_seconds, float), q.get("model"), options.allow_model_override, options.max_timeout_seconds)


def create(spark: SparkSession, own: settings.Settings | None = None, options: Options | None = None) -> Callable:
    """The ASGI application."""
    options, own = options or Options(), own or settings.Settings()
    slots = Slots(options.slots, options.queue_seconds)

    async def inspected(source: Any, asked: dict[str, Any]) -> tuple[dict[str, Any], dict[str, str]]:
        model, fallback = own.models()
        call = {"head_bytes": asked["head_bytes"], "tail_bytes": asked["tail_bytes"], "budget": asked["budget"], "invoker": options.invoker, "model": asked["model"] or model, "fallback": fallback}
        async with slots:
            result = await asyncio.to_thread(inspection.inspect_one, spark, source, **call)
        return {k: v for k, v in result.items() if k != "usage"}, usage_headers(result["usage"])

    async def answer(scope: dict, receive: Callable) -> tuple[int, Any, dict[str, str]]:
        headers = {k.decode().lower(): v.decode() for k, v in scope["headers"]}
        query, route = scope.get("query_string", b"").decode(), (scope["method"], scope["path"])
        if route == ("GET", "/health"):
            if parse_qs(query).get("probe") == ["true"]:
                own.ready()
            return 200, {"status": "ok", "backend": own.llm_backend}, {}
        if route == ("POST", "/inspect/raw"):
            asked = _asked(query, options)
            if headers.get("content-length", "").isdigit() and int(headers["content-length"]) > options.max_body_bytes:
                raise errors.BodyTooLargeError(f"the body exceeds {options.max_body_bytes} bytes")

            async def chunks() -> AsyncIterator[bytes]:
                more = True
                while more:
                    message = await receive()
                    if message["type"] == "http.disconnect":
                        return
                    more = message.get("more_body", False)
                    if message.get("body"):
                        yield message["body"]

            reader = AsyncReader(chunks(), asyncio.get_running_loop(), options.max_body_bytes, asked["budget"])
            try:
                return 200, *await inspected(reader, asked)
            finally:
                reader.close()
        if route == ("POST", "/inspect/object"):
            asked, body = _asked(query, options), b""
            while True:
                message = await receive()
                body += message.get("body", b"")
                if not message.get("more_body", False):
                    break
            wanted = json.loads(body)
            uri = windows.check_object_uri(wanted["uri"])
            if options.open_object is None:
                raise errors.BackendConfigurationError("no object store is configured")
            stream = await asyncio.to_thread(options.open_object, uri, wanted.get("generation"))
            try:
                result, extra = await inspected(stream, asked)
            finally:
                stream.close()
            about = {"X-Object-Size": getattr(stream, "size", None), "X-Object-Generation": getattr(stream, "generation", None)}
            return 200, result, extra | {k: str(v) for k, v in about.items() if v is not None}
        return 404, {"title": "Not found", "status": 404}, {}

    async def application(scope: dict, receive: Callable, reply: Callable) -> None:
        if scope["type"] != "http":
            return
        began, given = time.perf_counter(), dict(scope["headers"]).get(b"x-request-id", b"").decode("latin-1")
        try:
            status, body, extra = await answer(scope, receive)
        except Exception as error:  # noqa: BLE001  every error is an answer
            status, body, extra = problem(error)
            logger.log(logging.ERROR if status >= 500 else logging.WARNING, "%s: %s", type(error).__name__, body["detail"])
        own_id = request_id(given)
        kind = "application/problem+json" if status >= 400 else "application/json"
        lines = {"Content-Type": kind, "X-Request-ID": own_id} | extra
        await reply({"type": "http.response.start", "status": status, "headers": [(k.encode(), v.encode("latin-1", "replace")) for k, v in lines.items()]})
        await reply({"type": "http.response.body", "body": json.dumps(body, ensure_ascii=False).encode()})
        logger.info("%s %s %d %.0f ms %s", scope["method"], scope["path"], status, 1000 * (time.perf_counter() - began), own_id)

    return application
