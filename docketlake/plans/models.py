"""Models as plain Python functions over Arrow batches, with deterministic stand-ins for use without a network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Models(Protocol):
    """What a deployment provides; each function takes lists, so that it can batch its calls."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def rerank(self, pairs: list[tuple[str, str]]) -> list[float]: ...

    def chat(self, messages: list[list[dict]]) -> list[dict]: ...


class Offline:
    """Deterministic stand-ins that SQL can follow.

    Vectors count words by their first letter and length; a rerank score is the share of the query's words in the text. A
    question with excerpts is answered with the ids of the first two; any other message is read as a query, whose first
    word is a filter and whose number of words tells the intent.
    """

    dim = 64

    @staticmethod
    def words(text: str | None) -> list[str]:
        return re.findall(r"[^\W_]+", (text or "").lower())

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in self.words(text):
                v[(ord(w[0]) * 31 + len(w) * 7) % self.dim] += 1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    def rerank(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            q, t = set(self.words(query)), set(self.words(text))
            out.append(round(len(q & t) / len(q), 6) if q else 0.0)
        return out

    def chat(self, messages: list[list[dict]]) -> list[dict]:
        out = []
        for given in messages:
            asked = given[-1]["content"]
            if asked.startswith("Question: "):
                ids = list(dict.fromkeys(re.findall(r"^\[([^\]]+)\]", asked.partition("\nRelevant excerpts:\n")[2], re.M)))
                content = " ".join(f"See [{i}]." for i in ids[:2])
                out.append({"content": content, "reasoning": f"{len(ids)} documents", "tool_calls": []})
                continue
            found = self.words(asked)
            read = {"rewritten_query": asked, "intent": "citation_lookup" if len(found) % 2 else "conceptual", "filters": {"act": found[0]} if found else {}}
            out.append({"content": json.dumps(read), "tool_calls": []})
        return out


class Researcher(Offline):
    """A stand-in for the agent too, that SQL can follow.

    It searches by full text and by words, looks up the first document that it has found and cites the first of each search. For a question with an even number of
    words it first cites an id that nobody has seen, and does better when that is sent back.
    """

    UNSEEN = "x-999999"

    @staticmethod
    def _first(result: str) -> str | None:
        try:
            hits = json.loads(result)
        except ValueError:  # a search without hits gives an error message
            return None
        return hits[0]["doc_id"] if isinstance(hits, list) and hits else None

    def _step(self, given: list[dict]) -> dict:
        asked = [m["content"] for m in given if m["role"] == "user"]
        told = [m["content"] for m in given if m["role"] == "tool"]
        call = lambda n, name, **arguments: {"id": f"c{n}", "name": name, "arguments": json.dumps(arguments)}
        if not told:
            return {"content": "", "tool_calls": [call(1, "search_es", query=asked[0]), call(2, "search_milvus_sparse", query=asked[0])]}
        found = list(dict.fromkeys(x for x in map(self._first, told[:2]) if x))
        if found and len(told) == 2:
            return {"content": "", "tool_calls": [call(3, "lookup_doc", doc_id=found[0])]}
        if found and len(asked) == 1 and len(self.words(asked[0])) % 2 == 0:
            found = [self.UNSEEN]
        return {"content": f"It is {' and '.join(f'[{x}]' for x in found)}." if found else "Nothing was found.", "tool_calls": []}

    def chat(self, messages: list[list[dict]]) -> list[dict]:
        agent = [len(m) > 1 and any(x["role"] == "system" and "tools" in x["content"] for x in m) for m in messages]
        return [self._step(m) if a else super(Researcher, self).chat([m])[0] for m, a in zip(messages, agent, strict=True)]


# The models of the roles, which a request may override except for embedding.
ROLES = {"slm": ("Qwen3-30B-A3B", "deepinfra"), "synthesis": ("Qwen3-235B-A22B", "deepinfra"), "agent": ("DeepSeek-V4-Flash", "deepinfra"), "reranker": ("Qwen3-Reranker", "deepinfra"), "embedder": ("voyage", "voyage")}


def resolved(role: Column, override: Column) -> Column:
    """The model of a role: the override where the role takes one; null for an unknown role."""
    table = F.create_map(*(F.lit(x) for k, (m, _) in ROLES.items() for x in (k, m)))
    return F.when(role == "embedder", F.element_at(table, role)).when(F.map_contains_key(table, role), F.coalesce(override, F.element_at(table, role)))


def _each(call: Callable[[list], list], items: list, failed: Callable[[Exception], object]) -> list:
    """call(items); if that fails, each half by itself, so that one bad item spoils no other and costs few calls.

    A time-out is the service's, not an item's: all items in hand get it, and none is asked again one by one.
    """
    try:
        return call(items)
    except TimeoutError as error:
        return [failed(error)] * len(items)
    except Exception as error:  # noqa: BLE001 - a model's error is a value of its row
        if len(items) <= 1:
            return [failed(error)] * len(items)
        half = len(items) // 2
        return _each(call, items[:half], failed) + _each(call, items[half:], failed)


def embedded(df: DataFrame, text: str, models: Models, name: str = "vector") -> DataFrame:
    """df with the vectors of a text column; each distinct text is embedded once. The vector is null where the model fails."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_each(models.embed, batch.tolist(), lambda error: None))

    udf = F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    vectors = df.select(text).distinct().withColumn(name, udf(F.col(text)))
    return df.join(vectors, text)


def reranked(df: DataFrame, query: str, text: str, models: Models, name: str = "rerank_score") -> DataFrame:
    """df with a score of each (query, text) row, made in the row, so that no position has to be matched; null where the model fails."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(_each(models.rerank, list(zip(q, t, strict=True)), lambda error: None), dtype="float64")

    return df.withColumn(name, F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col(query), F.col(text)))


def answered(df: DataFrame, messages: str, models: Models, name: str = "reply") -> DataFrame:
    """df with the reply to a JSON list of messages, as JSON with content and tool_calls, or with error where the model fails."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            replies = _each(models.chat, [json.loads(m) for m in batch], lambda error: {"error": f"{type(error).__name__}: {error}"})
            yield pd.Series([json.dumps(r) for r in replies])

    return df.withColumn(name, F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(messages)))


Tool = Callable[[DataFrame], DataFrame]
