"""Providers of answers: a class by name, one client in each task, replies checked and retried a bounded number of times.

Tests and dry runs use Template or Echo, which need no network. What calls a server uses the standard library only.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_METRIC = {"K": 1024, "M": 1024**2, "G": 1024**3}


class Provider(Protocol):
    def query(self, prompt: str, max_tokens: int | None = None) -> str: ...


def metric(value: str | int) -> int:
    """'128K' and the like as a number."""
    s = str(value).strip()
    return int(s[:-1]) * _METRIC[s[-1]] if s[-1:] in _METRIC else int(s)


def budget(prompt: str, window: int, wanted: int) -> int:
    """Tokens for the answer: those wanted, unless prompt and answer exceed the window."""
    used = len(prompt) // 4
    return max(1024, window - used - 500) if used + wanted > window else wanted


class Base:
    """What all providers share: settings with a context window."""

    def __init__(self, settings: dict[str, Any]):
        self.settings, self.window = settings, metric(settings.get("context-window", "1K"))

    def num_tokens(self) -> int:
        return self.window

    def query(self, prompt: str, max_tokens: int | None = None) -> str:
        raise NotImplementedError

    def query_image(self, prompt: str, image: bytes, kind: str = "image/png") -> str:
        raise NotImplementedError(f"{type(self).__name__} takes no pictures")

    def transcribe(self, sound: bytes, name: str = "audio.mp3") -> str:
        raise NotImplementedError(f"{type(self).__name__} takes no sound")


class Template(Base):
    """Answers with its template, filled with the prompt."""

    def query(self, prompt: str, max_tokens: int | None = None) -> str:
        return str(self.settings.get("template", "{prompt}")).replace("{prompt}", prompt)


class Echo(Base):
    """Answers with the prompt, or with its first words if max_tokens is given: deterministic, for tests."""

    def query(self, prompt: str, max_tokens: int | None = None) -> str:
        return " ".join(prompt.split()[:max_tokens]) if max_tokens else prompt


def _post(url: str, body: Any, headers: dict[str, str], timeout: float) -> Any:
    data = body if isinstance(body, bytes) else json.dumps(body).encode()
    kind = {} if isinstance(body, bytes) else {"Content-Type": "application/json"}
    with urllib.request.urlopen(urllib.request.Request(url, data, kind | headers), timeout=timeout) as reply:  # noqa: S310
        return json.loads(reply.read())


class Compatible(Base):
    """A server with the widespread chat-completions interface. Settings: host, model, key or key-variable, timeout."""

    def _call(self, path: str, body: Any, extra: dict[str, str] | None = None) -> Any:
        key = self.settings.get("key") or os.environ.get(self.settings.get("key-variable", ""), "")
        headers = ({"Authorization": f"Bearer {key}"} if key else {}) | (extra or {})
        return _post(self.settings["host"].rstrip("/") + path, body, headers, float(self.settings.get("timeout", 300)))

    def _chat(self, content: Any, max_tokens: int | None) -> str:
        turn = {"role": "user", "content": content}
        body = {"temperature": self.settings.get("temperature", 0), "model": self.settings["model"], "messages": [turn]}
        return self._call("/chat/completions", body | ({"max_tokens": max_tokens} if max_tokens else {}))["choices"][0]["message"]["content"]

    def query(self, prompt: str, max_tokens: int | None = None) -> str:
        return self._chat(prompt, budget(prompt, self.window, max_tokens) if max_tokens else None)

    def query_image(self, prompt: str, image: bytes, kind: str = "image/png") -> str:
        return self._chat([{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": f"data:{kind};base64,{base64.b64encode(image).decode()}"}}], None)

    def transcribe(self, sound: bytes, name: str = "audio.mp3") -> str:
        mark = uuid.uuid4().hex
        field = lambda head, data: f"--{mark}\r\nContent-Disposition: form-data; {head}\r\n\r\n".encode() + data + b"\r\n"
        body = field('name="model"', str(self.settings["model"]).encode()) + field(f'name="file"; filename="{name}"', sound) + f"--{mark}--\r\n".encode()
        return self._call("/audio/transcriptions", body, {"Content-Type": f"multipart/form-data; boundary={mark}"})["text"]


class Ollama(Base):
    """A local server of open models. Settings: host, model, timeout."""

    def _call(self, body: dict) -> str:
        return _post(self.settings.get("host", "http://localhost:11434").rstrip("/") + "/api/generate", {"model": self.settings["model"], "stream": False} | body, {}, float(self.settings.get("timeout", 300)))["response"]

    def query(self, prompt: str, max_tokens: int | None = None) -> str:
        return self._call({"prompt": prompt} | ({"options": {"num_predict": budget(prompt, self.window, max_tokens)}} if max_tokens else {}))

    def query_image(self, prompt: str, image: bytes, kind: str = "image/png") -> str:
        return self._call({"prompt": prompt, "images": [base64.b64encode(image).decode()]})


class Bedrock(Base):
    """A hosted service by its public client library, where that is installed. Settings: model, region, profile."""

    def _converse(self, content: list[dict], max_tokens: int | None) -> str:
        import boto3  # absent in most installations: an ImportError says so

        client = boto3.Session(profile_name=self.settings.get("profile")).client("bedrock-runtime", region_name=self.settings.get("region"))
        reply = client.converse(modelId=self.settings["model"], messages=[dict(role="user", content=content)], inferenceConfig={"maxTokens": max_tokens or 2048})
        return "".join(c.get("text", "") for c in reply["output"]["message"]["content"])

    def query(self, prompt: str, max_tokens: int | None = None) -> str:
        return self._converse([{"text": prompt}], budget(prompt, self.window, max_tokens or 2048))

    def query_image(self, prompt: str, image: bytes, kind: str = "image/png") -> str:
        return self._converse([{"text": prompt}, {"image": {"format": kind.rpartition("/")[2], "source": {"bytes": image}}}], None)


CLASSES: dict[str, type[Base]] = {"template": Template, "echo": Echo, "ollama": Ollama, "openai_compatible": Compatible, "bedrock": Bedrock}


def from_config(settings: dict[str, Any]) -> Base:
    """The provider named by class, with all of the settings."""
    try:
        return CLASSES[settings["class"]](settings)
    except KeyError:
        raise ValueError(f"unknown provider class {settings.get('class')!r}") from None


def retried(call: Callable[[], Any], tries: int = 3, wait: float = 1.0) -> Any:
    """The first answer that is no error; the last error after so many tries."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def ask(df: DataFrame, settings: dict[str, Any], prompt: Column, *, id_col: str = "doc_id", max_tokens: int | None = None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """id, answer, error of every row: each task makes one client; a failure is a row, never a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = from_config(settings)
        for batch in batches:
            rows = []
            for name, text in zip(batch["id"], batch["prompt"]):
                if text is None:
                    rows.append((name, None, None))
                    continue
                try:
                    rows.append((name, retried(lambda: provider.query(text, max_tokens), tries, wait), None))  # noqa: B023
                except Exception as e:
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "answer", "error"])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), prompt.alias("prompt")).mapInPandas(run, f"id {kind}, answer string, error string")


def repaired_or_own(answer: Column, own: Column) -> Column:
    """A model's version of a text, or the text where that is blank or failed."""
    return F.coalesce(F.when(F.trim(answer) != "", answer), own)
