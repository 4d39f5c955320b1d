"""Provider interfaces for outside services, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Protocol

import numpy as np

WORD = re.compile(r"\w{2,}")


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]: ...


class TextModel(Protocol):
    def generate(self, prompts: list[str], temperature: float = 0.0) -> list[str | None]: ...


class RerankProvider(Protocol):
    source: str

    def available(self) -> bool: ...
    def score(self, queries: list[str], texts: list[str]) -> list[float]: ...


class AnswerJudge(Protocol):
    def score(self, criterion: str, question: str, context: str, answer: str, ground_truth: str) -> float | None:
        """``criterion`` is faithfulness, answer_relevance, completeness or abstention_quality."""


class OcrProvider(Protocol):
    def words(self, images: list[bytes]) -> list[list[tuple[str, float]]]: ...


class WebSearch(Protocol):
    def search(self, query: str, most: int = 3) -> list[dict]: ...


class HashingEmbedder:
    """Words and word pairs, signed-hashed into ``size`` dimensions, unit length."""

    def __init__(self, size: int = 384) -> None:
        self.size = size

    def embed(self, texts: list[str], kind: str = "document") -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            words = WORD.findall((text or "").lower())
            for w in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 63 else -1
            norm = np.sqrt((v * v).sum())
            out.append((v / norm if norm else v).tolist())
        return out


class ExtractiveModel:
    """Answers with the sentence of the prompt's documents that shares most words with its question."""

    def generate(self, prompts: list[str], temperature: float = 0.0) -> list[str | None]:
        out = []
        for p in prompts:
            body, _, rest = (p or "").rpartition("## Question: ")
            asked = set(WORD.findall(rest.split("\n")[0].lower()))
            best = max(re.split(r"(?<=[.!?])\s+", body), key=lambda s: (len(asked & set(WORD.findall(s.lower()))), -len(s)), default="")
            out.append(re.sub(r"^(?:##[^\n]*\n)*#{0,3} ?(?:Content: )?", "", best).strip())
        return out


class OverlapJudge:
    """Scores a text by the share of the other's words that it has."""

    def share(self, wanted: str, given: str) -> float:
        need = set(WORD.findall((wanted or "").lower()))
        return len(need & set(WORD.findall((given or "").lower()))) / len(need) if need else 0.0

    def verdict(self, wanted: str, given: str, least: float = 0.2) -> str:
        return json.dumps({"score": "yes" if self.share(wanted, given) >= least else "no"})

    def need_more(self, question: str, context: str, answer: str) -> tuple[bool, str]:
        """G9 offline: more is needed if the context has few of the question's words."""
        need = self.share(question, context) < 0.2
        return need, "the context has few of the question's words" if need else "the context has the question's words"

    def score(self, criterion: str, question: str, context: str, answer: str, ground_truth: str) -> float:
        """E18, E19 offline: words of the answer in the context, of the question in the answer, of the ground truth
        (else of the question) in the answer, and of the question missing from the context."""
        if criterion == "faithfulness":
            return self.share(answer, context)
        if criterion == "answer_relevance":
            return self.share(question, answer)
        return self.share(ground_truth or question, answer) if criterion == "completeness" else 1.0 - self.share(question, context)


class LexicalReranker:
    """A stand-in for a cross-encoder: share of the query's words in the text, plus word-pair matches."""

    source, hosted = "reranked", False

    def available(self) -> bool:
        return True

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = WORD.findall(q.lower()), WORD.findall(t.lower())
            pairs = lambda w: set(zip(w, w[1:], strict=False))
            one = len(set(a) & set(b)) / len(set(a)) if a else 0.0
            two = len(pairs(a) & pairs(b)) / len(pairs(a)) if len(a) > 1 else 0.0
            out.append(0.7 * one + 0.3 * two)
        return out


class NoOcr:
    """No words, as when recognition is missing."""

    def words(self, images: list[bytes]) -> list[list[tuple[str, float]]]:
        return [[] for _ in images]


class NoWeb:
    """Canned results that name the query."""

    def search(self, query: str, most: int = 3) -> list[dict]:
        return [{"title": f"Result {i + 1}", "snippet": f"Offline result for: {query}"} for i in range(most)] if query.strip() else []


def web_text(results: list[dict], backend: str = "offline") -> str:
    """Results as one text."""
    return f"[Web Search Results — {backend}]\n\n" + "\n\n---\n\n".join(f"**{r['title']}**\n{r['snippet']}" for r in results)


class KeyRing:
    """Keys in turn; the next one after a rate-limit error, and None after the last."""

    def __init__(self, keys: list[str]) -> None:
        self.keys, self.at = [k for k in keys if k], 0

    def current(self) -> str | None:
        return self.keys[self.at] if self.at < len(self.keys) else None

    def advance(self) -> str | None:
        self.at += 1
        return self.current()


class RateLimiter:
    """At most ``most`` requests within ``window`` seconds; returns how long to wait before the next."""

    def __init__(self, most: int, window: float = 60.0) -> None:
        self.most, self.window, self.times = most, window, []

    def wait(self, now: float) -> float:
        self.times = [t for t in self.times if now - t < self.window]
        pause = 0.0 if len(self.times) < self.most else self.times[0] + self.window - now + 0.1
        self.times.append(now + pause)
        return pause
