"""Batch completion: a pluggable generator run over prompts in Python workers."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfill.functions.text import format_prompt, parse_prompt, truncate_at_stops

#: Token limits and sampling of the greedy, sampled, served and quick-test modes.
GREEDY = {"max_tokens": 128, "temperature": 0.0, "top_p": 1.0}
SAMPLED = {"max_tokens": 128, "temperature": 0.8, "top_p": 0.95}
SERVED = {"max_tokens": 128, "temperature": 0.2, "top_p": 0.95}
QUICK = {"max_tokens": 64, "temperature": 0.2, "top_p": 0.95}


class Generator(Protocol):
    """Completes one prompt; returns the text and its number of tokens."""

    def complete(self, prompt: str, draw: int, max_tokens: int, temperature: float, top_p: float) -> tuple[str, int]: ...


class StubGenerator:
    """Deterministic stand-in: pseudo-words from a digest of the prompt and draw."""

    def __init__(self, name: str = "stub"):
        self.name = name

    def complete(self, prompt: str, draw: int, max_tokens: int, temperature: float, top_p: float) -> tuple[str, int]:
        salt = draw if temperature > 0 else 0
        digest = hashlib.md5(f"{self.name}|{salt}|{prompt}".encode()).hexdigest()
        out = [digest[i : i + 4] for i in range(0, 32, 4)][: max(1, min(8, max_tokens))]
        return " ".join(out), len(out)


def complete(prompts: DataFrame, make: Callable[[], Generator], model: str, k: int = 5, greedy: dict = GREEDY, sampled: dict = SAMPLED) -> DataFrame:
    """Completions ``sample_id, model, text, k_samples, time_ms, tokens`` of ``prompts(sample_id, prompt)``.

    ``make`` runs once in each worker, where a model is loaded; the clock
    covers the greedy completion only.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for frame in frames:
            rows = []
            for sample_id, prompt in zip(frame["sample_id"], frame["prompt"]):
                start = time.perf_counter()
                text, tokens = generator.complete(prompt, 0, **greedy)
                took = (time.perf_counter() - start) * 1000
                rows.append((sample_id, model, text, [generator.complete(prompt, i + 1, **sampled)[0] for i in range(k)], took, tokens))
            yield pd.DataFrame(rows, columns=["sample_id", "model", "text", "k_samples", "time_ms", "tokens"])

    return prompts.select("sample_id", "prompt").mapInPandas(run, "sample_id long, model string, text string, k_samples array<string>, time_ms double, tokens int")


def prompts(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", format_prompt(F.col("prefix"), F.col("suffix")).alias("prompt"))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Completion requests with defaults filled in and ``errors``, the names of the fields that break a rule."""
    rows = requests.withColumns(
        {
            "max_tokens": F.coalesce("max_tokens", F.lit(SERVED["max_tokens"])),
            "temperature": F.coalesce("temperature", F.lit(SERVED["temperature"])),
            "stop_sequences": F.coalesce("stop_sequences", F.array().cast("array<string>")),
        }
    )
    bad = {
        "prefix": F.col("prefix").isNull(),
        "suffix": F.col("suffix").isNull(),
        "max_tokens": ~F.col("max_tokens").between(1, 512),
        "temperature": ~F.col("temperature").between(0.0, 2.0) | F.isnan(F.col("temperature").cast("double")),
        "stop_sequences": F.exists("stop_sequences", lambda s: F.coalesce(s, F.lit("")) == ""),
    }
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in bad.items()])))


def serve(requests: DataFrame, make: Callable[[], Generator], model: str) -> DataFrame:
    """Answer valid requests ``request_id, prefix, suffix, max_tokens, temperature, stop_sequences``:
    ``request_id, status, completion, tokens, time_ms, model, errors``; invalid ones get status 422."""
    checked = validate_requests(requests).withColumn("prompt", format_prompt(F.col("prefix"), F.col("suffix")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generator = make()
        for frame in frames:
            texts, tokens, took = [], [], []
            for prompt, most, temperature in zip(frame["prompt"], frame["max_tokens"], frame["temperature"]):
                start = time.perf_counter()
                text, n = generator.complete(prompt, 0, int(most), float(temperature), SERVED["top_p"])
                took.append((time.perf_counter() - start) * 1000)
                texts.append(text)
                tokens.append(n)
            yield frame[["request_id", "stop_sequences"]].assign(completion=texts, tokens=tokens, time_ms=took)

    valid = checked.where(F.size("errors") == 0)
    id_type = dict(requests.dtypes)["request_id"]
    done = valid.select("request_id", "stop_sequences", "prompt", "max_tokens", "temperature").mapInPandas(
        run, f"request_id {id_type}, stop_sequences array<string>, completion string, tokens int, time_ms double"
    )
    answers = done.select(
        "request_id", F.lit(200).alias("status"), truncate_at_stops(F.col("completion"), F.col("stop_sequences")).alias("completion"), "tokens", "time_ms", F.lit(model).alias("model"), F.array().cast("array<string>").alias("errors")
    )
    refused = checked.where(F.size("errors") > 0).select(
        "request_id", F.lit(422).alias("status"), F.lit(None).cast("string").alias("completion"), F.lit(0).alias("tokens"), F.lit(None).cast("double").alias("time_ms"), F.lit(model).alias("model"), "errors"
    )
    return answers.unionByName(refused)


def prompt_requests(requests: DataFrame) -> DataFrame:
    """Prompt-style requests ``request_id, prompt, suffix, max_tokens, temperature`` as completion requests; no bounds, no stops."""
    prefix, suffix = parse_prompt(F.col("prompt"), F.col("suffix"))
    return requests.select("request_id", prefix.alias("prefix"), suffix.alias("suffix"), "max_tokens", "temperature", F.array().cast("array<string>").alias("stop_sequences"))


def prompt_response(answers: DataFrame, created: int) -> DataFrame:
    """Prompt-style responses of :func:`serve`'s answers; prompt tokens are not tracked."""
    choice = F.struct(F.col("completion").alias("text"), F.lit(0).alias("index"), F.lit(None).cast("string").alias("logprobs"), F.lit("stop").alias("finish_reason"))
    usage = F.struct(F.lit(0).alias("prompt_tokens"), F.col("tokens").alias("completion_tokens"), F.col("tokens").alias("total_tokens"))
    return answers.select(
        "request_id", F.lit(f"cmpl-{created}").alias("id"), F.lit("text_completion").alias("object"), F.lit(created).cast("long").alias("created"), "model", F.array(choice).alias("choices"), usage.alias("usage")
    )


def health(loaded: bool, device: str, model: str) -> dict:
    return {"status": "healthy" if loaded else "unhealthy", "model_loaded": loaded, "device": device, "model_name": model}


#: Texts that a tokenizer must give back unchanged.
WHITESPACE_PROBES = [
    "pub use builder::*;\n",
    "fn clone(&self) -> Self {\n    Self { value: self.value.clone() }\n}\n",
    "<｜fim▁begin｜>impl X {\n    <｜fim▁hole｜>\n}<｜fim▁end｜>Self { value }\n<｜end▁of▁sentence｜>",
]


def check_round_trip(encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], probes: list[str] | None = None) -> None:
    """Raise at the first probe that a tokenizer changes."""
    for probe in WHITESPACE_PROBES if probes is None else probes:
        got = decode(encode(probe))
        if got != probe:
            raise ValueError(f"tokenizer does not preserve white space: {probe!r} became {got!r}")
