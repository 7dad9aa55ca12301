"""Model calls behind interfaces, each with a deterministic stand-in."""

from __future__ import annotations

import hashlib
import json
import re
from abc import ABC, abstractmethod

import numpy as np


class ProviderError(RuntimeError):
    """A model call failed or gave no usable answer."""


class EmbeddingProvider(ABC):
    model: str
    size: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]:
        """One vector for each text, in order."""


class TextProvider(ABC):
    @abstractmethod
    def complete(self, prompt: str, max_tokens: int = 4000) -> str: ...

    def complete_json(self, prompt: str, required: tuple[str, ...] = (), max_tokens: int = 4000) -> dict:
        """The answer as an object with the required keys."""
        raw = self.complete(prompt, max_tokens)
        if not raw:
            raise ProviderError("empty answer")
        try:
            got = json.loads(raw)
        except ValueError as e:
            raise ProviderError(f"no JSON: {raw[:80]}") from e
        if not isinstance(got, dict) or any(k not in got for k in required):
            raise ProviderError("the answer lacks a required key")
        return got

    def available(self) -> bool:
        return True


class VisionProvider(ABC):
    @abstractmethod
    def transcribe(self, images: list[bytes], prompt: str) -> str: ...


class HashingEmbedder(EmbeddingProvider):
    """Feature hashing of character trigrams into unit vectors: equal for equal texts on every machine."""

    def __init__(self, size: int = 64) -> None:
        self.model, self.size = "hashing-trigrams", size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            s = f"  {t.lower()} "
            for i in range(len(s) - 2):
                h = int.from_bytes(hashlib.blake2b(s[i : i + 3].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                v[h % self.size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out


class RuleJudge(TextProvider):
    """Answers a comparison of two passages by their numbers: a conflict where the same words carry different ones."""

    def complete(self, prompt: str, max_tokens: int = 4000) -> str:
        a, _, b = prompt.partition("\n---\n")
        x, y = re.findall(r"\d+", a), re.findall(r"\d+", b)
        kind = "numeric" if x and y and x != y else "none"
        hit = kind != "none"
        return json.dumps({"hasContradiction": hit, "kind": kind, "severity": "medium" if hit else "low", "claimA": a[:200], "claimB": b[:200], "explanation": f"{x[:3]} / {y[:3]}", "confidence": 0.8 if hit else 0.2})
