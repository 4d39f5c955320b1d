"""Hosted services (R11, G13): attempts, keys in turn, request limits, and providers over any callable client."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from typing import Any

from marlstone.functions.text import RATE_LIMITS
from marlstone.plans.prompts import filled
from marlstone.plans.providers import KeyRing, RateLimiter

ATTEMPTS, PAUSE_SECONDS = 3, 20.0
#: Requests a minute by kind of call.
LIMITS = {"chat": 20, "embed": 2000, "rerank": 10}
MOST_INPUT = 1000


class ServiceError(ConnectionError):
    """A service failed for good; callers keep what they had."""


def is_rate_limit(error: BaseException) -> bool:
    text = str(error).lower()
    return any(words.lower() in text for words in RATE_LIMITS)


class Hosted:
    """Calls ``client(key, payload)``. A rate-limit error moves to the next key at once, or without one waits PAUSE_SECONDS;
    after ATTEMPTS, and on any other error, ServiceError is raised. Requests stay within ``limiter``."""

    def __init__(self, client: Callable[[str | None, Any], Any], keys: list[str], kind: str = "chat", sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.client, self.keys, self.limiter, self.sleep, self.clock = client, KeyRing(keys), RateLimiter(LIMITS[kind]), sleep, clock

    def call(self, payload: Any) -> Any:
        for attempt in range(ATTEMPTS):
            pause = self.limiter.wait(self.clock())
            if pause:
                self.sleep(pause)
            try:
                return self.client(self.keys.current(), payload)
            except Exception as error:  # whatever the client raises
                if not is_rate_limit(error) or attempt == ATTEMPTS - 1:
                    raise ServiceError(str(error)) from error
                if self.keys.at + 1 < len(self.keys.keys):
                    self.keys.advance()
                else:
                    self.sleep(PAUSE_SECONDS)
        raise ServiceError("no attempt was made")


class HostedReranker:
    """``client(key, {"query", "documents"})`` gives a score for each document; queries are simplified before."""

    source, hosted = "reranked_hosted", True

    def __init__(self, client: Callable, keys: list[str], **options) -> None:
        self.service = Hosted(client, keys, "rerank", **options)

    def available(self) -> bool:
        return self.service.keys.current() is not None

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        """One call for each run of equal queries, of at most MOST_INPUT documents."""
        out: list[float] = []
        at = 0
        while at < len(queries):
            end = at
            while end < len(queries) and queries[end] == queries[at] and end - at < MOST_INPUT:
                end += 1
            out += self.service.call({"query": queries[at], "documents": texts[at:end]})
            at = end
        return out


class HostedModel:
    """Text, JSON and embeddings of a hosted service; a failure gives None."""

    def __init__(self, chat: Callable, embed: Callable, keys: list[str], size: int = 1024, batch: int = 96, **options) -> None:
        self.chat, self.vectors, self.size, self.batch = Hosted(chat, keys, "chat", **options), Hosted(embed, keys, "embed", **options), size, batch

    def generate(self, prompts: list[str], temperature: float = 0.0) -> list[str | None]:
        out: list[str | None] = []
        for p in prompts:
            try:
                out.append(self.chat.call({"prompt": p, "temperature": temperature}))
            except ServiceError:
                out.append(None)
        return out

    def generate_json(self, text: str) -> dict:
        """The first JSON object of the reply; empty without one."""
        reply = self.generate([text])[0] or ""
        start = reply.find("{")
        try:
            found, _ = json.JSONDecoder().raw_decode(reply[start:]) if start >= 0 else ({}, 0)
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for s in range(0, len(texts), self.batch):
            part = texts[s : s + self.batch]
            try:
                out += self.vectors.call({"texts": part, "kind": kind})
            except ServiceError:
                out += [None] * len(part)
        return out


class HostedJudge:
    """Need-more decisions and judge scores by a model that replies in JSON."""

    def __init__(self, model: HostedModel) -> None:
        self.model = model

    def need_more(self, question: str, context: str, answer: str) -> tuple[bool, str]:
        found = self.model.generate_json(filled("agent.need_more", question=question, context=context, answer=answer))
        return found.get("need_more") is True, str(found.get("reason") or "")

    def score(self, criterion: str, question: str, context: str, answer: str, ground_truth: str) -> float | None:
        found = self.model.generate_json(filled(f"judge.{criterion}", question=question, context=context, answer=answer, ground_truth=ground_truth)).get("score")
        return float(found) if isinstance(found, int | float) else None
