"""Providers of what lies outside the engine: completions, log-probabilities, and runs of tests.

A provider is a small picklable object that works on batches inside ``mapInPandas``; the partitions of the input are its
parallelism. Offline ones are deterministic; ``HttpCompletions`` speaks the common chat-completions format. Errors become
columns, so a row never fails a job; infrastructure failures are left to Spark's task retry.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import sys
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

from evalweave.functions.code import backoff, extract_code, syntax_error


class Completion(NamedTuple):
    """What came back for a prompt: a text, or an error message."""

    text: str | None
    error: str | None = None
    finish_reason: str | None = None
    metadata: dict[str, str] | None = None


class CompletionProvider(Protocol):
    def complete(self, prompts: list[str]) -> list[tuple]:
        """A ``Completion``, or the start of one (text, error message), for each prompt."""


class ContinuationProvider(Protocol):
    def continue_(self, prefixes: list[str]) -> list[tuple[str, list[tuple[str, float]]] | None]:
        """The continuation of each prefix and its tokens with log-probabilities; null where it failed."""


class LogprobProvider(Protocol):
    def score(self, texts: list[str], suffixes: list[str | None]) -> list[list[tuple[str, float]] | None]:
        """Tokens with log-probabilities, of the suffix only where one is given; null where scoring failed."""


class EchoProvider:
    """An offline completion: a fenced function whose name hangs on the prompt."""

    def complete(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        return [(f"```python\ndef solve_{hashlib.sha256(p.encode()).hexdigest()[:8]}(x):\n    return x\n```", None) for p in prompts]


class HttpCompletions:
    """Completions and continuations of a server with the common chat-completions format, one request a prompt.

    The key is read from an environment variable of the worker, so it is never part of a plan. A status other than 200, a
    body without choices, an empty text and a lost connection each become an error message.
    """

    def __init__(self, url: str, model: str, temperature: float = 0.0, max_tokens: int = 4096, timeout_s: float = 60.0, key_variable: str | None = None) -> None:
        self.url, self.model, self.temperature, self.max_tokens, self.timeout_s, self.key_variable = url, model, temperature, max_tokens, timeout_s, key_variable

    def _post(self, prompt: str, more: dict) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens} | more
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ.get(self.key_variable, '')}"
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
            return json.load(reply)

    def complete(self, prompts: list[str]) -> list[Completion]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> Completion:
        try:
            body = self._post(prompt, {})
        except urllib.error.HTTPError as e:
            return Completion(None, f"HTTP_{e.code}: {e.read()[:500].decode(errors='replace')}")
        except Exception as e:
            return Completion(None, f"HTTP_ERROR: {type(e).__name__}: {e}"[:500], None, {"exception_type": type(e).__name__})
        choices = body.get("choices") or []
        if not choices:
            return Completion(None, "No candidates in response")
        reason = choices[0].get("finish_reason")
        text = (choices[0].get("message") or {}).get("content") or ""
        about = {"model_returned": str(body.get("model", self.model))} | {f"usage.{k}": str(v) for k, v in (body.get("usage") or {}).items()}
        return Completion(text, None, reason, about) if text.strip() else Completion(None, "No content in response", reason, about)

    def continue_(self, prefixes: list[str]) -> list[tuple[str, list[tuple[str, float]]] | None]:
        out: list = []
        for prefix in prefixes:
            try:
                choice = self._post(prefix, {"logprobs": True, "temperature": 0.0})["choices"][0]
                tokens = [(t["token"], float(t["logprob"])) for t in (choice.get("logprobs") or {}).get("content") or [] if t.get("logprob") is not None]
                out.append((choice["message"]["content"] or "", tokens))
            except Exception:
                out.append(None)
        return out


class HashContinuations:
    """Offline continuations: a few of the prefix's words, each with a log-probability that hangs on the word."""

    def __init__(self, words: int = 5) -> None:
        self.words = words

    def continue_(self, prefixes: list[str]) -> list[tuple[str, list[tuple[str, float]]] | None]:
        out: list = []
        for p in prefixes:
            words = sorted(set(p.split()), key=lambda w: hashlib.md5(w.encode()).hexdigest())[: self.words]
            out.append((" ".join(words), [(w, -1.0 - int(hashlib.md5(w.encode()).hexdigest()[:4], 16) / 65536) for w in words]) if words else None)
        return out


class Retrying:
    """A provider that tries again, with rising waits, where an error is worth it; what fails to the end says so."""

    def __init__(self, inner: CompletionProvider, attempts: int = 7, wait=time.sleep) -> None:
        self.inner, self.attempts, self.wait = inner, attempts, wait

    def complete(self, prompts: list[str]) -> list[tuple]:
        from evalweave.functions.code import RETRYABLE

        def again(error: str | None) -> bool:
            return bool(error) and any(p.lower() in error.lower() for p in RETRYABLE)

        out = list(self.inner.complete(prompts))
        for attempt in range(self.attempts - 1):
            failed = [k for k, r in enumerate(out) if again(r[1])]
            if not failed:
                break
            jitter = int(hashlib.md5(f"{prompts[failed[0]]}|{attempt}".encode()).hexdigest()[:4], 16) / 32768 - 1
            self.wait(backoff(attempt, jitter))
            for k, r in zip(failed, self.inner.complete([prompts[k] for k in failed])):
                out[k] = r
        return [(None, f"RETRY_EXHAUSTED({self.attempts}): {r[1]}", *r[2:]) if again(r[1]) else r for r in out]


class HashLogprobs:
    """Offline log-probabilities: each word has one that hangs on the word, and a better one if the text before holds it."""

    def score(self, texts: list[str], suffixes: list[str | None]) -> list[list[tuple[str, float]] | None]:
        out = []
        for text, suffix in zip(texts, suffixes):
            start = len(text) - len(suffix) if suffix and text.endswith(suffix) else 0
            seen = set(text[:start].split())
            words = text[start:].split()
            out.append([(w, -1.0 - int(hashlib.md5(w.encode()).hexdigest()[:4], 16) / 65536 * 8 + (2.0 if w in seen else 0.0)) for w in words])
        return out


def generate(tasks: DataFrame, prompt: str, provider: CompletionProvider, batch: int = 16) -> DataFrame:
    """Tasks with raw_llm_output, error_message, finish_reason, generation_metadata, latency_s, generated_solution, ast_error and
    prompt_hash."""
    schema = StructType([*tasks.schema.fields]).add("raw_llm_output", "string").add("error_message", "string").add("finish_reason", "string")
    schema = schema.add("generation_metadata", MapType(StringType(), StringType())).add("latency_s", "double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                began = time.monotonic()
                try:
                    found = [Completion(*r) for r in provider.complete(part[prompt].fillna("").tolist())]
                except Exception as e:
                    found = [Completion(None, f"{type(e).__name__}: {e}")] * len(part)
                took = (time.monotonic() - began) / max(1, len(part))
                yield part.assign(raw_llm_output=[r.text for r in found], error_message=[r.error for r in found], finish_reason=[r.finish_reason for r in found], generation_metadata=[r.metadata for r in found], latency_s=took)

    out = tasks.mapInPandas(run, schema).withColumn("generated_solution", extract_code(F.col("raw_llm_output")))
    return out.withColumn("ast_error", syntax_error("generated_solution")).withColumn("prompt_hash", F.sha2(F.coalesce(F.col(prompt), F.lit("")), 256))


def in_rounds(tasks: DataFrame, key: Sequence[str], rounds: int, run: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]) -> None:
    """Run and write tasks in ``rounds`` shares by the hash of their key: a stage that dies keeps all rounds before."""
    for k in range(rounds):
        write(run(tasks.where(F.pmod(F.xxhash64(*key), F.lit(rounds)) == k)))


def continuations(rows: DataFrame, prefix: str, provider: ContinuationProvider) -> DataFrame:
    """Rows with continuation, avg_logprob and logprobs (token, logprob) of it; nulls where it failed."""
    kind = ArrayType(StructType([StructField("token", StringType()), StructField("logprob", DoubleType())]))
    schema = StructType([*rows.schema.fields]).add("continuation", "string").add("avg_logprob", "double").add("logprobs", kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [r or (None, None) for r in provider.continue_(pdf[prefix].fillna("").tolist())]
            yield pdf.assign(
                continuation=[t for t, _ in found],
                avg_logprob=[sum(p for _, p in k) / len(k) if k else None for _, k in found],
                logprobs=[None if k is None else [{"token": t, "logprob": p} for t, p in k] for _, k in found],
            )

    return rows.mapInPandas(run, schema)


def score(rows: DataFrame, text: str, suffix: str | None, provider: LogprobProvider) -> DataFrame:
    """Rows with logprobs: an array of (token, logprob), null where scoring failed."""
    kind = ArrayType(StructType([StructField("token", StringType()), StructField("logprob", DoubleType())]))
    schema = StructType([*rows.schema.fields, StructField("logprobs", kind)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = provider.score(pdf[text].fillna("").tolist(), pdf[suffix].tolist() if suffix else [None] * len(pdf))
            yield pdf.assign(logprobs=[None if f is None else [{"token": t, "logprob": p} for t, p in f] for f in found])

    return rows.mapInPandas(run, schema)


def run_tests(rows: DataFrame, script: str, stdin: str | None = None, expected: str | None = None, timeout_s: float = 10.0, allow: bool = False) -> DataFrame:
    """Rows with status, error, time_s of running ``script`` as a program of its own.

    It runs code from the data, so it must be allowed explicitly, and it belongs into a sandbox. status is success,
    test_failure (the output differs), execution_error, timeout or empty_code; errors are cut to 1,000 characters.
    """
    if not allow:
        raise PermissionError("running code from data has to be allowed: allow=True")
    schema = StructType([*rows.schema.fields]).add("status", "string").add("error", "string").add("time_s", "double")

    def one(code: str | None, given: str | None, want: str | None) -> tuple[str, str | None, float]:
        if not code or not code.strip():
            return "empty_code", None, 0.0
        began = time.monotonic()
        try:
            done = subprocess.run([sys.executable, "-I", "-c", code], input=given or "", capture_output=True, text=True, timeout=timeout_s)
        except subprocess.TimeoutExpired:
            return "timeout", f"TIMEOUT: more than {timeout_s} s", timeout_s
        except Exception as e:
            return "execution_error", f"HARNESS_ERROR: {e}"[:1000], time.monotonic() - began
        took = time.monotonic() - began
        if done.returncode:
            failed = "AssertionError" in done.stderr
            return ("test_failure" if failed else "execution_error"), done.stderr[-1000:], took
        if want is not None and done.stdout.strip() != want.strip():
            return "test_failure", f"expected {want.strip()!r}, got {done.stdout.strip()!r}"[:1000], took
        return "success", None, took

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            none = [None] * len(pdf)
            found = [one(c, i, w) for c, i, w in zip(pdf[script], pdf[stdin] if stdin else none, pdf[expected] if expected else none)]
            yield pdf.assign(status=[f[0] for f in found], error=[f[1] for f in found], time_s=[f[2] for f in found])

    return rows.mapInPandas(run, schema)


#: Fixed value: what programs under test may take for granted.
PRELUDE = "import sys\nimport math\nfrom typing import *\nimport collections\nimport itertools\nimport functools\nimport heapq\nimport bisect\n\n"


def run_test_lists(rows: DataFrame, code: str, tests: str, timeout_s: float = 3.0, prelude: str = PRELUDE, allow: bool = False) -> DataFrame:
    """Rows with status, pass, error, time_s, timeout, n_run of running ``code`` against its ``tests`` (input, output), in order.

    The first test that fails decides and ends the run. status is success, test_failure, execution_error, timeout, empty_code,
    or error where there are no tests; errors are cut to 1,000 characters. Running code from data has to be allowed and
    belongs into a sandbox.
    """
    if not allow:
        raise PermissionError("running code from data has to be allowed: allow=True")
    schema = StructType([*rows.schema.fields]).add("status", "string").add("pass", "boolean").add("error", "string").add("time_s", "double").add("timeout", "boolean").add("n_run", "integer")

    def one(program: str | None, wanted) -> tuple:
        if not program or not program.strip():
            return "empty_code", "Empty generated solution", 0.0, 0
        if wanted is None or len(wanted) == 0:
            return "error", "Missing tests object", 0.0, 0
        began = time.monotonic()
        for k, test in enumerate(wanted):
            try:
                done = subprocess.run([sys.executable, "-I", "-c", prelude + program], input=test["input"] or "", capture_output=True, text=True, timeout=timeout_s)
            except subprocess.TimeoutExpired:
                return "timeout", f"Timeout on test {k}", time.monotonic() - began, k + 1
            except Exception as e:
                return "execution_error", f"HARNESS_ERROR: {e}"[:1000], time.monotonic() - began, k + 1
            if done.returncode:
                return "execution_error", done.stderr[-1000:], time.monotonic() - began, k + 1
            if done.stdout.strip() != (test["output"] or "").strip():
                return "test_failure", f"Test {k} failed. Expected:\n{(test['output'] or '').strip()}\nGot:\n{done.stdout.strip()}"[:1000], time.monotonic() - began, k + 1
        return "success", None, time.monotonic() - began, len(wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [one(c, w) for c, w in zip(pdf[code], pdf[tests])]
            yield pdf.assign(**{"status": [f[0] for f in found], "pass": [f[0] == "success" for f in found], "error": [f[1] for f in found], "time_s": [f[2] for f in found], "timeout": [f[0] == "timeout" for f in found], "n_run": [f[3] for f in found]})

    return rows.mapInPandas(run, schema)
