"""Outside services as interfaces, called in batches from tasks; deterministic fakes for offline use."""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Retryable(Exception):
    """A failure worth another try; `wait` overrides the back-off."""

    def __init__(self, message: str, wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


class DeadlineExceeded(Retryable):
    """No whole answer within the wall-clock deadline, whatever bytes kept the connection alive."""


class MissingKey(Exception):
    """The environment holds no key for the service."""


#: HTTP states worth another try.
BUSY = (429, 500, 502, 503, 504)


def answer(request: urllib.request.Request, deadline: float, quiet: float = 60.0, clock: Callable[[], float] = time.monotonic) -> Any:
    """The JSON answer to a request, read as it arrives with an eye on the clock.

    A dripping connection ends at the deadline, one that is silent for `quiet`
    seconds then. Busy states and lost connections are Retryable, with the
    wait that the service asks for.
    """
    end, body = clock() + deadline, bytearray()
    try:
        with urllib.request.urlopen(request, timeout=min(deadline, quiet)) as reply:
            while chunk := reply.read1(65536):
                body += chunk
                if clock() > end:
                    raise DeadlineExceeded(f"no whole answer within {deadline} s")
    except urllib.error.HTTPError as e:
        if e.code in BUSY:
            wait = e.headers.get("Retry-After", "")
            raise Retryable(f"state {e.code}", float(wait) if wait.isdigit() else None) from e
        raise
    except (TimeoutError, urllib.error.URLError, http.client.HTTPException, ConnectionError) as e:
        if isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError):
            raise DeadlineExceeded("silent for too long") from e
        raise Retryable(str(e)) from e
    return json.loads(body)


def get_json(url: str, params: dict[str, str], deadline: float = 30.0, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """GET with retries; an answer whose error code is `maxlag` counts as busy."""

    def call() -> Any:
        got = answer(urllib.request.Request(f"{url}?{urllib.parse.urlencode(params)}"), deadline)
        if isinstance(got, dict) and (got.get("error") or {}).get("code") == "maxlag":
            raise Retryable("maxlag")
        return got

    return retried(call, tries, sleep=sleep)


@dataclass
class Reply:
    text: str | None = None
    input_tokens: int = 0
    output_tokens: int = 0
    truncated: bool = False


class TextModel(Protocol):
    def complete(self, model: str, prompt: str, max_tokens: int) -> Reply: ...


class PageHistory(Protocol):
    def last_modified(self, ids: list[str]) -> dict[str, str | None]: ...

    def created(self, id: str) -> str | None: ...


def retried(call: Callable[[], Reply], tries: int = 5, first: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """Up to `tries` calls; waits double up to `most`, unless the failure says how long."""
    wait = first
    for k in range(tries):
        try:
            return call()
        except Retryable as e:
            if k == tries - 1:
                raise
            sleep(min(most, e.wait if e.wait is not None else wait))
            wait = min(most, wait * 2)
    raise AssertionError("unreachable")


def generate(prompts: DataFrame, client: TextModel, tokens: int = 8192, most: int = 32768, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, model, prompt) -> id, text, input_tokens, output_tokens, error, and what all tries billed.

    An empty or truncated reply is asked again with twice the tokens, up to `most`;
    then it is an error. Failures are rows, so their costs stay on record.
    """

    def one(model: str, prompt: str) -> tuple:
        room, billed_in, billed_out, error = tokens, 0, 0, "empty"
        while room <= most:
            try:
                r = retried(lambda room=room: client.complete(model, prompt, room), sleep=sleep)
            except Exception as e:  # a task outlives one bad call
                return None, None, None, type(e).__name__, billed_in, billed_out
            billed_in, billed_out = billed_in + r.input_tokens, billed_out + r.output_tokens
            if r.text and r.text.strip() and not r.truncated:
                return r.text, r.input_tokens, r.output_tokens, None, billed_in, billed_out
            error, room = "truncated" if r.truncated else "empty", room * 2
        return None, None, None, error, billed_in, billed_out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *one(m, p)) for i, m, p in zip(frame["id"], frame["model"], frame["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "text", "input_tokens", "output_tokens", "error", "billed_input", "billed_output"]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    return prompts.select("id", "model", "prompt").mapInPandas(run, "id string, text string, input_tokens long, output_tokens long, error string, billed_input long, billed_output long")


def with_dates(pages: DataFrame, client: PageHistory, batch: int = 50) -> DataFrame:
    """(id) -> id, created, last_modified as text; null for ids the service doesn't know."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, last = frame["id"].tolist(), {}
            for k in range(0, len(ids), batch):
                last |= client.last_modified(ids[k : k + batch])
            yield pd.DataFrame({"id": ids, "created": [client.created(i) for i in ids], "last_modified": [last.get(i) for i in ids]})

    return pages.select("id").mapInPandas(run, "id string, created string, last_modified string")


@dataclass
class ChatService:
    """A chat-completion service over HTTP; its key comes from an environment variable of the executor.

    Replies that may take more than `escalated` tokens get the longer deadline.
    """

    url: str
    key_name: str
    deadline: float = 300.0
    long_deadline: float = 600.0
    escalated: int = 8192
    options: dict = field(default_factory=dict)

    def complete(self, model: str, prompt: str, max_tokens: int) -> Reply:
        key = os.environ.get(self.key_name)
        if not key:
            raise MissingKey(self.key_name)
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "max_tokens": max_tokens, **self.options}
        head = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        got = answer(urllib.request.Request(self.url, json.dumps(body).encode(), head), self.long_deadline if max_tokens > self.escalated else self.deadline)
        choice, usage = got["choices"][0], got.get("usage") or {}
        return Reply(choice["message"].get("content"), usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0), choice.get("finish_reason") == "length")


class FakeModel:
    """Replies that depend on the prompt alone; some prompts come back truncated at first."""

    def complete(self, model: str, prompt: str, max_tokens: int) -> Reply:
        digest = hashlib.md5(f"{model}:{prompt}".encode()).hexdigest()
        if digest[0] in "01":
            return Reply("cut", len(prompt), max_tokens, truncated=max_tokens < 16384)
        return Reply(f"reply {digest}", len(prompt), 8)


class FakeHistory:
    def last_modified(self, ids: list[str]) -> dict[str, str | None]:
        return {i: f"2021-0{int(i) % 9 + 1}-01T00:00:00Z" for i in ids if i.isdigit() and int(i) % 7}

    def created(self, id: str) -> str | None:
        return f"201{int(id) % 10}-05-01T00:00:00Z" if id.isdigit() and int(id) % 7 else None
