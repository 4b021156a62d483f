"""Batch text generation: a client is any object with `generate` and `name`; one is made for each partition.

A client may cost money and answer differently each time, so `respond` is meant to be written once (tkanyna.plans does)
and read from there.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Client(Protocol):
    """What generates text from a system and a user prompt; None for a failure."""

    name: str

    def generate(self, system_prompt: str, user_prompt: str, num_sentences: int = 0) -> str | None: ...


# Defaults of a client.
MAX_TOKENS, TEMPERATURE, MAX_RETRIES, RETRY_DELAY, TIMEOUT = 2048, 0.7, 5, 5.0, 120
# Fixed value: where the public service takes chat completions.
URL = "https://openrouter.ai/api/v1/chat/completions"
LONGEST = 4096  # tokens of a prompt that a local model sees


@dataclass(frozen=True)
class ClientConfig:
    model: str
    max_tokens: int = MAX_TOKENS
    temperature: float = TEMPERATURE
    max_retries: int = MAX_RETRIES
    retry_delay: float = RETRY_DELAY
    timeout: float = TIMEOUT


@dataclass(frozen=True)
class RemoteConfig(ClientConfig):
    """api_key comes from the caller and never enters a table. headers: further headers by name; referer and title name
    the caller to the service."""

    url: str = URL
    api_key: str = ""
    structured: bool = True
    headers: dict = field(default_factory=dict)
    referer: str = ""
    title: str = ""


class StubClient:
    """Deterministic and offline: each numbered sentence of the prompt, with fixed replacements of words."""

    WORDS = {"і": "тай", "для": "дльи", "біля": "коло", "не": "ни", "від": "вид"}

    def __init__(self, config: ClientConfig):
        self.config = config
        self.name = f"stub:{config.model}"

    def generate(self, system_prompt: str, user_prompt: str, num_sentences: int = 0) -> str | None:
        parts = re.split(r"(?:^|\n)(?=\d+\. )", user_prompt)  # a line without a number goes on with the sentence before
        said = [part.split(". ", 1)[1] for part in parts if re.match(r"\d+\. ", part)]
        turned = [" ".join(self.WORDS.get(w, w) for w in s.split(" ")) for s in said]
        return json.dumps({"translations": turned}, ensure_ascii=False) if num_sentences else "\n".join(turned)


def response_format() -> dict:
    """The JSON schema of a structured reply."""
    # The schema by which a service returns translations.
    items = {"type": "array", "description": "One rendering for each numbered sentence, in their order", "items": {"type": "string"}}
    schema = {"type": "object", "properties": {"translations": items}, "required": ["translations"], "additionalProperties": False}
    return {"type": "json_schema", "json_schema": {"name": "translations", "strict": True, "schema": schema}}


def payload(config: RemoteConfig, system_prompt: str, user_prompt: str, num_sentences: int = 0) -> dict:
    """The body of a request; the reply is structured if the client wants it and sentences are counted."""
    turns = [{"role": role, "content": text} for role, text in (("system", system_prompt), ("user", user_prompt))]
    body: dict[str, Any] = {"model": config.model, "messages": turns, "max_tokens": config.max_tokens, "temperature": config.temperature}
    return body | ({"response_format": response_format()} if config.structured and num_sentences > 0 else {})


def _post(url: str, headers: dict, body: dict, timeout: float) -> tuple[int, Any]:
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return reply.status, json.loads(reply.read())
    except urllib.error.HTTPError as e:
        return e.code, None


class RemoteClient:
    """A chat-completion service over HTTP, tried again with growing waits.

    Too many requests (429): delay * 2^i. Server error: delay * (i + 1). Timeout, a reply that isn't JSON or another error: delay, but
    not after the last try. A reply without choices is a failure at once.
    """

    def __init__(self, config: RemoteConfig, post: Callable = _post, sleep: Callable[[float], None] = time.sleep):
        if not config.api_key:
            raise ValueError("a remote client needs an API key")
        self.config, self._post, self._sleep = config, post, sleep
        self.name = f"openrouter:{config.model}"

    def generate(self, system_prompt: str, user_prompt: str, num_sentences: int = 0) -> str | None:
        c = self.config
        headers = {"Authorization": f"Bearer {c.api_key}", "Content-Type": "application/json"} | c.headers
        headers |= {name: value for name, value in (("HTTP-Referer", c.referer), ("X-Title", c.title)) if value}
        body = payload(c, system_prompt, user_prompt, num_sentences)
        for i in range(c.max_retries):
            try:
                status, data = self._post(c.url, headers, body, c.timeout)
            except (OSError, ValueError):  # timeouts, lost connections, and replies that aren't JSON
                status, data = 0, None
            if status == 429:
                self._sleep(c.retry_delay * 2**i)
            elif status >= 500:
                self._sleep(c.retry_delay * (i + 1))
            elif 200 <= status < 300:
                choices = data.get("choices") if isinstance(data, dict) else None
                return choices[0]["message"]["content"] if choices else None
            elif i < c.max_retries - 1:
                self._sleep(c.retry_delay)
        return None


class LocalClient:
    """A model held by the worker, given as a function of one prompt; any error of it is a failure.

    The prompt is cut to LONGEST tokens where the function has an `encode` and a `decode`. Where sentences are counted,
    the JSON object inside the reply is given if there is one.
    """

    def __init__(self, config: ClientConfig, run: Callable[..., str], quantisation: str = "fp16", sampling: dict | None = None):
        self.config, self._run, self._sampling = config, run, sampling or {}
        self.name = f"local:{config.model}:{quantisation}"

    def generate(self, system_prompt: str, user_prompt: str, num_sentences: int = 0) -> str | None:
        prompt = f"<s>[INST] {system_prompt}\n\n{user_prompt} [/INST]"
        try:
            if hasattr(self._run, "encode"):
                prompt = self._run.decode(self._run.encode(prompt)[:LONGEST])
            said = self._run(prompt, **self._sampling)
        except Exception:
            return None
        return inner_object(said) if num_sentences > 0 and said else said


def inner_object(text: str) -> str:
    """The first JSON object with translations inside a text, or the text."""
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer("{", text)):
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(value, dict) and "translations" in value:
            return text[at:end]
    return text


def loaded(path: str) -> Callable:
    """The function that `module:name` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


PROVIDERS: dict[str, Callable[..., Client]] = {
    "stub": lambda model, **kw: StubClient(ClientConfig(model, **kw)),
    "openrouter": lambda model, **kw: RemoteClient(RemoteConfig(model, **kw)),
    "local": lambda model, run, quantisation="fp16", sampling=None, **kw: LocalClient(ClientConfig(model, **kw), loaded(run)(model, quantisation) if isinstance(run, str) else run, quantisation, sampling),
}


def register(provider: str, make: Callable[..., Client]) -> None:
    PROVIDERS[provider] = make


def create_client(provider: str, model: str, **options: Any) -> Client:
    """The client of a provider; ValueError for an unknown one."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[provider](model, **options)


def respond(prompts: DataFrame, make: Callable[[], Client]) -> DataFrame:
    """(batch_id, response, client): the reply to each row of (batch_id, system_prompt, user_prompt, n); null for a failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            client = client or make()
            said = [client.generate(s, u, int(n)) for s, u, n in zip(batch["system_prompt"].tolist(), batch["user_prompt"].tolist(), batch["n"].tolist())]
            yield pd.DataFrame({"batch_id": batch["batch_id"], "response": pd.Series(said, dtype=object), "client": client.name})

    return prompts.select("batch_id", "system_prompt", "user_prompt", "n").mapInPandas(run, "batch_id bigint, response string, client string")


def predict(inputs: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], size: int = 8) -> DataFrame:
    """(idx, prediction) of (idx, source), in lists of at most size; make gives the function of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or make()
            texts = batch["source"].fillna("").tolist()
            said = [p for i in range(0, len(texts), size) for p in model(texts[i : i + size])]
            yield pd.DataFrame({"idx": batch["idx"], "prediction": said})

    return inputs.select("idx", "source").mapInPandas(run, "idx bigint, prediction string")
