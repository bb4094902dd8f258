"""The model client that enrichment calls, and what each call costs.

A client runs on the executors, one a partition. ``generate`` returns all its
attempts with the reply, so that cost is data: rows of ``CallRecord``, summed
by queries rather than kept in a live log.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable
from dataclasses import asdict, dataclass, field


class ModelError(RuntimeError):
    """All attempts failed; ``attempts`` are those that were made."""

    def __init__(self, message: str, attempts: list[CallRecord]):
        super().__init__(message)
        self.attempts = attempts


@dataclass
class CallRecord:
    model: str
    prompt: int
    completion: int
    latency_ms: int
    ok: bool
    tag: str
    error: str | None
    started_at: float

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass
class Client:
    """Retries with backoff, which grows twofold and is not slept after the last attempt."""

    model: str = "stub"
    max_retries: int = 2
    backoff_s: float = 1.0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def complete(self, prompt: str, system: str | None) -> tuple[str, int, int]:
        """The reply with its prompt and completion tokens."""
        raise NotImplementedError

    def generate(self, prompt: str, system: str | None = None, tag: str = "") -> tuple[str, list[CallRecord]]:
        attempts: list[CallRecord] = []
        for i in range(self.max_retries + 1):
            at, clock = time.time(), time.perf_counter()
            try:
                reply, p, c = self.complete(prompt, system)
            except Exception as e:  # noqa: BLE001  whatever a backend raises is a failed attempt
                attempts.append(CallRecord(self.model, 0, 0, int(1000 * (time.perf_counter() - clock)), False, tag, str(e), at))
                if i < self.max_retries:
                    self.sleep(self.backoff_s * 2**i)
                continue
            attempts.append(CallRecord(self.model, p, c, int(1000 * (time.perf_counter() - clock)), True, tag, None, at))
            return reply, attempts
        raise ModelError(f"{self.model}: {len(attempts)} attempts failed: {attempts[-1].error}", attempts)


@dataclass
class StubClient(Client):
    """Answers by a function of (prompt, system); fails so many times first."""

    responder: Callable[[str, str | None], str] = field(default=lambda prompt, system: "[]", repr=False)
    usage: tuple[int, int] = (10, 5)
    fail_times: int = 0

    def complete(self, prompt: str, system: str | None) -> tuple[str, int, int]:
        if self.fail_times > 0:
            self.fail_times -= 1
            raise ConnectionError("stub failure")
        return self.responder(prompt, system), *self.usage


@dataclass
class OllamaClient(Client):
    """A local model server's generate endpoint."""

    host: str = "http://localhost:11434"
    temperature: float = 0.0
    timeout_s: float = 120.0

    def complete(self, prompt: str, system: str | None) -> tuple[str, int, int]:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature}}
        if system:
            body["system"] = system
        request = urllib.request.Request(f"{self.host.rstrip('/')}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
            got = json.load(reply)
        return got.get("response", ""), int(got.get("prompt_eval_count") or 0), int(got.get("eval_count") or 0)
