"""Models behind HTTP, as pandas UDFs: embeddings, re-ranking, chat completions. Calls go out in batches from tasks."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 16


class ServiceError(RuntimeError):
    """A service could not be reached, or answered in another shape."""


def post(url: str, body: dict, token: str | None = None, timeout: float = 120) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
            return json.load(answer)
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise ServiceError(f"{url}: {e}") from e


def embed_batch(url: str, texts: list[str], dimension: int | None) -> list[list[float]]:
    """Vectors in the order of the texts, whatever the order of the answer; all of one dimension."""
    got = post(f"{url}/v1/embeddings", {"input": texts}).get("data")
    try:
        vectors = [x["embedding"] for x in sorted(got, key=lambda x: x["index"])]
    except (TypeError, KeyError) as e:
        raise ServiceError("no embeddings in the answer") from e
    sizes = {len(v) for v in vectors} | ({dimension} if dimension else set())
    if len(vectors) != len(texts) or len(sizes) > 1:
        raise ServiceError(f"{len(vectors)} vectors of {sorted(sizes)} for {len(texts)} texts")
    return vectors


def embedder(url: str, dimension: int | None = None):
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t or "" for t in s]
            yield pd.Series([v for i in range(0, len(texts), BATCH) for v in embed_batch(url, texts[i : i + BATCH], dimension)], dtype=object)

    return embed


def rerank_scores(url: str, query: str, texts: list[str]) -> list[float]:
    """A score for each text, in the order of the texts."""
    if not texts:
        return []
    got = post(f"{url}/v1/rerank", {"query": query, "documents": texts}).get("results")
    try:
        scores = {int(x["index"]): float(x["relevance_score"]) for x in got}
    except (TypeError, KeyError, ValueError) as e:
        raise ServiceError("no scores in the answer") from e
    if sorted(scores) != list(range(len(texts))):
        raise ServiceError(f"{len(scores)} scores for {len(texts)} texts")
    return [scores[i] for i in range(len(texts))]


def reranker(url: str):
    """For `search(rerank=...)`: one call a query, over its few candidates."""

    def rerank(hits: DataFrame) -> DataFrame:
        names, schema = hits.columns, ", ".join(f"`{c}` {t}" for c, t in hits.dtypes) + ", score double"

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pdf[names].assign(score=rerank_scores(url, pdf["query"].iloc[0], pdf["text"].tolist()))

        return hits.groupBy("query_id").applyInPandas(run, schema)

    return rerank


def _completion(url: str, body: dict, token: str | None) -> str:
    got = post(f"{url}/v1/chat/completions", body, token)
    try:
        return got["choices"][0]["message"]["content"]
    except (KeyError, IndexError, TypeError) as e:
        raise ServiceError("no text in the answer") from e


def completer(url: str, model: str = "default", token: str | None = None, temperature: float = 0.1, max_tokens: int = 512, strict: bool = True):
    """For `answers(complete=...)`: a UDF of (system, prompt). If not `strict`, null where the service fails, as rewriting a question wants it."""

    @F.pandas_udf("string")
    def complete(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for system, prompt in batches:
            out = []
            for s, p in zip(system, prompt):
                said = [{"role": "system", "content": s}, {"role": "user", "content": p}]
                try:
                    out.append(_completion(url, {"model": model, "messages": said, "temperature": temperature, "max_tokens": max_tokens}, token))
                except ServiceError:
                    if strict:
                        raise
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return complete


def chat_completer(url: str, model: str = "default", token: str | None = None, temperature: float = 0.1, max_tokens: int = 512):
    """For `answers` of rows with `messages`: a UDF of an array of (role, content)."""

    @F.pandas_udf("string")
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for said in batches:
            yield pd.Series([_completion(url, {"model": model, "messages": [{"role": m["role"], "content": m["content"]} for m in row], "temperature": temperature, "max_tokens": max_tokens}, token) for row in said], dtype=object)

    return complete


def stream_completion(url: str, messages: list[dict], model: str = "default", token: str | None = None, temperature: float = 0.1, max_tokens: int = 512, timeout: float = 120) -> Iterator[str]:
    """The pieces of one answer as the service sends them, for a reader who waits; a malformed event is an error."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
    body = {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, "stream": True}
    try:
        with urllib.request.urlopen(urllib.request.Request(f"{url}/v1/chat/completions", json.dumps(body).encode(), headers), timeout=timeout) as answer:
            for line in answer:
                data = line.decode().strip().removeprefix("data:").strip() if line.startswith(b"data:") else ""
                if data == "[DONE]":
                    return
                if data and (piece := (json.loads(data)["choices"] or [{}])[0].get("delta", {}).get("content")):
                    yield piece
    except (urllib.error.URLError, TimeoutError, ValueError, KeyError, TypeError) as e:
        raise ServiceError(f"{url}: {e}") from e


def events(stream: str) -> list[tuple[str, dict]]:
    """(event, data) of a server-sent event stream's text; blocks without data are left out."""
    out = []
    for block in re.split(r"\r?\n\r?\n", stream):
        lines = block.splitlines()
        data = "\n".join(x[5:].lstrip() for x in lines if x.startswith("data:"))
        if data and data != "[DONE]":
            out.append((next((x[6:].strip() for x in lines if x.startswith("event:")), "message"), json.loads(data)))
    return out
