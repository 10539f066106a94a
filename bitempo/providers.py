"""Models over HTTP: completions and embeddings, retried where that can help. No error names the key."""

from __future__ import annotations

import json
import math
import os
import re
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field


class ProviderError(RuntimeError):
    """What a provider or the way to it refused."""


@dataclass(frozen=True)
class Network:
    """The proxy, the hosts reached without it, and the file of certificates to trust instead of the system's."""

    proxy: str | None = None
    direct: tuple[str, ...] = ()
    ca_file: str | None = None

    @staticmethod
    def from_env(get: Callable[[str], str | None] = os.environ.get) -> Network:
        """By the usual variables, upper case first. HTTP_PROXY is not read: a request's header can set it."""
        first = lambda *names: next((v.strip() for v in map(get, names) if v and v.strip()), None)
        hosts = first("NO_PROXY", "no_proxy") or ""
        return Network(first("HTTPS_PROXY", "https_proxy", "ALL_PROXY", "all_proxy"), tuple(h for h in (x.strip().lstrip(".").lower() for x in hosts.split(",")) if h), first("SSL_CERT_FILE", "CURL_CA_BUNDLE"))

    def bypasses(self, host: str) -> bool:
        """Whether a host is reached directly; this machine always is."""
        h = host.strip().strip("[]").lower()
        return h in ("localhost", "::1") or h.startswith("127.") or any(d in ("*", h) or h.endswith(f".{d}") for d in self.direct)

    def opener(self, url: str) -> urllib.request.OpenerDirector:
        proxies = {}
        if self.proxy and not self.bypasses(urllib.parse.urlsplit(url).hostname or ""):
            if not urllib.parse.urlsplit(self.proxy).hostname:
                raise ProviderError("the proxy is not a URL")
            proxies = {"http": self.proxy, "https": self.proxy}
        context = ssl.create_default_context(cafile=self.ca_file) if self.ca_file else ssl.create_default_context()
        return urllib.request.build_opener(urllib.request.ProxyHandler(proxies), urllib.request.HTTPSHandler(context=context))


def retry_after(headers) -> float | None:
    """Seconds that a response asks to wait."""
    try:
        seconds = float((headers.get("retry-after") or "").strip())
    except ValueError:
        return None
    return seconds if math.isfinite(seconds) and seconds >= 0 else None


@dataclass
class HttpProvider:
    """A provider with `chat/completions` and `embeddings` below its base URL. send and sleep can be replaced in tests."""

    base_url: str
    api_key: str = field(repr=False)
    completion_model: str
    embedding_model: str
    attempts: int = 6
    base_delay: float = 0.25
    max_delay: float = 16.0
    network: Network = field(default_factory=Network.from_env)
    send: Callable | None = field(default=None, repr=False)
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def redact(self, text: str) -> str:
        """text without the key, whole or as its first eight and last four characters."""
        if not self.api_key:
            return text
        text = text.replace(self.api_key, "[REDACTED]")
        if len(self.api_key) >= 12:
            text = re.sub(re.escape(self.api_key[:8]) + r"\S*?" + re.escape(self.api_key[-4:]), "[REDACTED]", text)
        return text

    def _send(self, path: str, body: bytes) -> tuple[int, dict, str]:
        url = f"{self.base_url.rstrip('/')}/{path}"
        if self.send is not None:
            return self.send(url, body)
        request = urllib.request.Request(url, body, {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        try:
            with self.network.opener(url).open(request, timeout=120) as r:
                return r.status, r.headers, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.headers, e.read().decode("utf-8", "replace")

    def post(self, path: str, body: dict) -> str:
        """The response's text. Too many requests, the provider's own failures and broken connections are tried again, after the time asked for, unless that is longer than max_delay."""
        delay, raw = self.base_delay, json.dumps(body).encode()
        for attempt in range(1, max(1, self.attempts) + 1):
            last = attempt >= self.attempts
            try:
                status, headers, text = self._send(path, raw)
            except OSError as e:
                if last:
                    raise ProviderError(self.redact(f"the provider could not be reached: {e}")) from None
                wait = delay
            else:
                if status < 300:
                    return text
                asked = retry_after(headers)
                if last or not (status == 429 or 500 <= status < 600) or asked is not None and asked > self.max_delay:
                    raise ProviderError(self.redact(f"{path}: {status}: {_api_error(text) or text[:200]}"))
                wait = delay if asked is None else asked
            self.sleep(wait)
            delay = min(2 * delay, self.max_delay)
        raise ProviderError("no attempt was made")

    def complete(self, prompt: str) -> str:
        return parse_completion(self.post("chat/completions", {"model": self.completion_model, "messages": [{"role": "user", "content": prompt}]}))

    def embed(self, text: str) -> list[float]:
        return parse_embedding(self.post("embeddings", {"model": self.embedding_model, "input": text}))

    def probe(self) -> int:
        """The dimension of the embedding model."""
        return len(self.embed("dimension"))


def _api_error(body: str) -> str | None:
    try:
        found = json.loads(body)
        return str(found["error"]["message"])
    except (ValueError, KeyError, TypeError):
        return None


def _first(body: str, name: str, *path: str):
    """An item of a response's list; its own error comes first, though the status was fine."""
    said = _api_error(body)
    if said is not None:
        raise ProviderError(said)
    try:
        rows = json.loads(body)[name]
        if not rows:
            raise ProviderError(f"the response has no {name}")
        out = rows[0]
        for p in path:
            out = out[p]
        return out
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ProviderError("the response is not what was expected") from e


def parse_completion(body: str) -> str:
    """The first choice's text; an empty text is an answer, no choice is none."""
    out = _first(body, "choices", "message", "content")
    if not isinstance(out, str):
        raise ProviderError("the response is not what was expected")
    return out


def parse_embedding(body: str) -> list[float]:
    out = _first(body, "data", "embedding")
    if not isinstance(out, list) or not all(isinstance(x, int | float) and not isinstance(x, bool) for x in out):
        raise ProviderError("the response is not what was expected")
    return [float(x) for x in out]
