"""Language-model clients behind one protocol, with an offline extractive default.

A client has ``invoke(prompt) -> str``. Plans call it once a prompt inside an Arrow batch; a client is made
on the executor by its factory, once a task. Network clients use the standard library only.
"""

from __future__ import annotations

import asyncio
import json
import re
import threading
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomquery.plans.ship import ship


class Client(Protocol):
    """``invoke`` is all that plans need; ``Base`` derives the rest from it."""

    def invoke(self, prompt: str) -> str: ...


class Base:
    """Streams, asynchronous and batch calls, and token counts of a client with ``invoke``."""

    def stream(self, prompt: str) -> Iterator[str]:
        yield from re.findall(r"\S+\s*", self.invoke(prompt))

    async def ainvoke(self, prompt: str) -> str:
        return await asyncio.to_thread(self.invoke, prompt)

    async def astream(self, prompt: str):
        pieces, done = iter(self.stream(prompt)), object()
        while (piece := await asyncio.to_thread(next, pieces, done)) is not done:
            yield piece

    def batch(self, prompts: Iterable[str]) -> list[str]:
        return [self.invoke(p) for p in prompts]

    async def abatch(self, prompts: Iterable[str]) -> list[str]:
        return await asyncio.gather(*[self.ainvoke(p) for p in prompts])

    def n_tokens(self, text: str) -> int:
        """1.5 for each CJK character, a quarter for each other, rounded down."""
        other = len(re.sub("[一-鿿]", "", text))
        return int(1.5 * (len(text) - other) + 0.25 * other)


@dataclass
class Response:
    content: str
    model: str = ""
    usage: dict[str, int] = field(default_factory=dict)
    finish_reason: str = "stop"


def retry(f: Callable, times: int = 3, wait: float = 0.5, most: float = 8.0):
    """f with exponential waits between its failures; the last one is raised."""
    for i in range(times):
        try:
            return f()
        except Exception:  # noqa: BLE001
            if i == times - 1:
                raise
            time.sleep(min(most, wait * 2**i))
    return None


class Extractive(Base):
    """Answers with the prompt's sentences that share most words with its last line."""

    def invoke(self, prompt: str) -> str:
        *body, question = [x for x in prompt.split("\n") if x.strip()] or [""]
        words = set(question.lower().split())
        found = [s.strip() for s in re.split(r"(?<=[.!?。！？])\s*", " ".join(body)) if s.strip()]
        ranked = sorted(range(len(found)), key=lambda i: (-len(words & set(found[i].lower().split())), i))
        return " ".join(found[i] for i in sorted(ranked[:2])) or question


class _Service:
    """JSON requests to a service, with retries."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 120.0, retries: int = 3):
        self.url, self.model, self.key, self.timeout, self.retries = url.rstrip("/"), model, key, timeout, retries

    def _open(self, path: str, body: dict):
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        return urllib.request.urlopen(urllib.request.Request(self.url + path, json.dumps(body).encode(), headers), timeout=self.timeout)

    def _post(self, path: str, body: dict) -> dict:
        def call() -> dict:
            with self._open(path, body) as r:
                return json.load(r)

        return retry(call, self.retries)


class Http(_Service, Base):
    """A chat-completions service."""

    def _body(self, prompt: str, **more) -> dict:
        return {"model": self.model, "messages": [{"role": "user", "content": prompt}], **more}

    def respond(self, prompt: str) -> Response:
        r = self._post("/v1/chat/completions", self._body(prompt))
        return Response(r["choices"][0]["message"]["content"], r.get("model", self.model), r.get("usage") or {}, r["choices"][0].get("finish_reason") or "stop")

    def invoke(self, prompt: str) -> str:
        return self.respond(prompt).content

    def stream(self, prompt: str) -> Iterator[str]:
        """Pieces as the service sends them: events of ``data:`` lines up to ``[DONE]``."""
        with retry(lambda: self._open("/v1/chat/completions", self._body(prompt, stream=True)), self.retries) as r:
            for line in r:
                event = line.decode("utf-8", "replace").strip()
                if not event.startswith("data:"):
                    continue
                if event[5:].strip() == "[DONE]":
                    return
                piece = (json.loads(event[5:])["choices"] or [{}])[0].get("delta", {}).get("content")
                if piece:
                    yield piece


class HttpEmbedder(_Service):
    """An embeddings service, called for ``batch`` texts at a time."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60.0, retries: int = 3, batch: int = 32):
        super().__init__(url, model, key, timeout, retries)
        self.batch = batch

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            rows = self._post("/v1/embeddings", {"model": self.model, "input": texts[i : i + self.batch]})["data"]
            out += [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]
        return out


PROVIDERS: dict[str, Callable[..., Client]] = {"extractive": Extractive, "http": Http}


def register(name: str, factory: Callable[..., Client]) -> None:
    PROVIDERS[name] = factory


def create(name: str = "extractive", **options) -> Client:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name](**options)


class Slots:
    """Calls with a time limit on at most ``n`` threads.

    A call that outlives its limit keeps its slot until it ends by its client's own timeout; while all slots are taken, a call waits for
    one as long as its own limit and then gives up. So a slow service holds ``n`` threads of a task, never more.
    """

    def __init__(self, n: int = 8):
        self.free = threading.BoundedSemaphore(n)

    def within(self, call: Callable[[], str], seconds: float | None) -> str | None:
        """The call's result; null if it fails or takes longer."""
        got: list[str | None] = [None]

        def run(release: bool) -> None:
            try:
                got[0] = call()
            except Exception:  # noqa: BLE001  the plan falls back on null
                got[0] = None
            finally:
                if release:
                    self.free.release()

        if seconds is None:
            run(False)
            return got[0]
        began = time.monotonic()
        if not self.free.acquire(timeout=seconds):
            return None
        t = threading.Thread(target=run, args=(True,), daemon=True)
        t.start()
        t.join(max(0.0, seconds - (time.monotonic() - began)))
        return None if t.is_alive() else got[0]


def complete(df: DataFrame, factory: Callable[[], Client], prompt_col: str = "prompt", out_col: str = "reply", timeout: float | None = None) -> DataFrame:
    """``df`` with the client's reply to each prompt; a failed call, or one over ``timeout`` seconds, leaves null.

    Equal prompts of a batch are asked once.
    """
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, slots = factory(), Slots()
        for b in batches:
            replies = {p: slots.within(lambda p=p: client.invoke(p), timeout) for p in b[prompt_col].dropna().unique()}
            yield b.assign(**{out_col: b[prompt_col].map(replies).astype(object).where(lambda x: x.notna(), None)})

    return df.mapInPandas(run, schema)
