"""Model providers, run inside tasks. A failed request becomes a row with its error, never a failed task."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame

# Parts of messages that mark an error as passing.
RETRYABLE = ("rate", "429", "500", "502", "503", "504", "timeout", "timed out", "connection", "overloaded", "temporarily")
PROVIDERS: dict = {}
RESPONSE = "text string, finish_reason string, prompt_tokens int, completion_tokens int, latency_s double, error string"


def register_provider(cls):
    if not getattr(cls, "name", ""):
        raise ValueError("a provider needs a name")
    if cls.name in PROVIDERS:
        raise ValueError(f"there is a provider {cls.name!r} already")
    PROVIDERS[cls.name] = cls
    return cls


def get_provider(name: str):
    if name not in PROVIDERS:
        raise KeyError(f"no provider {name!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]


class Provider:
    """Base class: complete(prompt, max_tokens) gives (text, finish_reason, prompt_tokens, completion_tokens) or raises."""

    name = ""

    def __init__(self, model: str, retries: int = 5, pause: float = 1.0, **options):
        self.model, self.retries, self.pause, self.options = model, retries, pause, options

    @classmethod
    def configured(cls, model, chosen: dict):
        """As a model's configuration and what was chosen for a task say."""
        return cls(model.model, **model.extra_body)

    def complete(self, prompt: str, max_tokens: int) -> tuple[str, str, int, int]:
        raise NotImplementedError

    def describe(self) -> dict[str, str]:
        return {"provider": self.name, "model": self.model, "revision": "", "quantization": ""}

    def described(self, reasoning: str) -> dict[str, str]:
        """What a manifest says about how a task was asked."""
        return {"reasoning": reasoning} | {k: v for k, v in self.describe().items() if k in ("revision", "quantization") and v}

    def generate(self, prompt: str, max_tokens: int) -> dict:
        """One response; passing errors are tried again after a growing, jittered pause."""
        begun = time.monotonic()
        for attempt in range(self.retries):
            begun = time.monotonic()
            try:
                text, reason, asked, made = self.complete(prompt, max_tokens)
                return {"text": text, "finish_reason": reason, "prompt_tokens": asked, "completion_tokens": made, "latency_s": round(time.monotonic() - begun, 3), "error": None}
            except Exception as e:  # noqa: BLE001  any failure becomes a row
                said = f"{type(e).__name__}: {e}"
                if attempt == self.retries - 1 or not any(x in said.lower() for x in RETRYABLE):
                    break
                time.sleep(self.pause * min(2**attempt, 30) * random.uniform(0.5, 1.5))
        return {"text": "", "finish_reason": "error", "prompt_tokens": 0, "completion_tokens": 0, "latency_s": round(time.monotonic() - begun, 3), "error": said}


@register_provider
class StubProvider(Provider):
    """Always answers alike: for trying the whole path without a model."""

    name = "stub"

    def complete(self, prompt, max_tokens):
        return ("Javob: A", "stop", 0, 3) if "Javob:" in prompt else ("Bu sinov javobi.", "stop", 0, 4)


@register_provider
class ReplayProvider(Provider):
    """Answers from a table of parts of prompts: the first part that the prompt holds; an answer that is an exception is raised."""

    name = "replay"

    def complete(self, prompt, max_tokens):
        for part, answer in self.options.get("answers", {}).items():
            if part in prompt:
                if isinstance(answer, Exception):
                    raise answer
                return answer, "stop", 0, len(answer.split())
        return self.options.get("default", ""), "stop", 0, 0


def run_items(items: DataFrame, provider: Provider, max_tokens: int = 1024, concurrency: int = 4, requests: int = 0) -> DataFrame:
    """items (item_id, prompt) with responses. `concurrency` requests per task are under way at a time; `requests` is the
    number of tasks that ask at once, 0 keeps the items' partitions."""

    def ask(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                got = list(pool.map(lambda p: provider.generate(p or "", max_tokens), batch.column("prompt").to_pylist()))
                columns = [batch.column("item_id"), *(pa.array([g[k] for g in got], t) for k, t in (("text", pa.string()), ("finish_reason", pa.string()), ("prompt_tokens", pa.int32()), ("completion_tokens", pa.int32()), ("latency_s", pa.float64()), ("error", pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "finish_reason", "prompt_tokens", "completion_tokens", "latency_s", "error"])

    rows = items.select("item_id", "prompt")
    return (rows.repartition(requests) if requests else rows).mapInArrow(ask, f"item_id {items.schema['item_id'].dataType.simpleString()}, {RESPONSE}")


def probe_decision(rows: list[tuple[str, bool]]) -> str:
    """Setting for a model from its probes, in order of preference: the first that answered, else exclude."""
    return next((name for name, answered in rows if answered), "exclude")
