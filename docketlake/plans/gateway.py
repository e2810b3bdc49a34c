"""Models behind an HTTP gateway: bodies of the requests, and what is read from the replies."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

#: Tokens of an answer at most.
MOST_TOKENS = 32768
#: What sends a body to a path and returns the reply, both as parsed JSON.
Post = Callable[[str, dict], dict]


def chat_body(model: str, messages: list[dict], tools: list[dict] | None = None, tool_choice: str | None = None, response_format: dict | None = None) -> dict:
    """A chat request; the choice of tools is only there with tools, and left to the model unless it is given."""
    body: dict = {"model": model, "messages": messages, "max_tokens": MOST_TOKENS}
    if tools:
        body |= {"tools": tools, "tool_choice": tool_choice or "auto"}
    if response_format is not None:
        body["response_format"] = response_format
    return body


def chat_reply(raw: dict) -> dict:
    """content, reasoning, tool_calls (id, name, arguments) and usage of a reply; only the numbers of tokens that it names."""
    message = raw["choices"][0]["message"]
    calls = [{"id": c["id"], "name": c["function"]["name"], "arguments": c["function"]["arguments"]} for c in message.get("tool_calls") or []]
    names = (("prompt_tokens", "input"), ("completion_tokens", "output"))
    usage = {ours: raw["usage"][theirs] for theirs, ours in names if theirs in (raw.get("usage") or {})}
    return {"content": message.get("content"), "reasoning": message.get("reasoning_content"), "tool_calls": calls, "usage": usage}


def http(base: str, key: str | None = None, timeout: float = 60.0) -> Post:
    """Posts JSON to addresses below ``base``; an answer later than ``timeout`` seconds is an error."""

    def post(path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(f"{base.rstrip('/')}/{path}", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)

    return post


class Gateway:
    """Models whose roles (slm, synthesis, agent, reranker, embedder) are names at a gateway; a role without a name is an error."""

    def __init__(self, post: Post, names: dict[str, str], role: str = "slm", tools: list[dict] | None = None, response_format: dict | None = None):
        self.post, self.names, self.role, self.tools, self.response_format = post, names, role, tools, response_format

    def name(self, role: str) -> str:
        if role not in self.names:
            raise ValueError(f"unknown role: {role}")
        return self.names[role]

    def embed(self, texts: list[str]) -> list[list[float]]:
        reply = self.post("embeddings", {"model": self.name("embedder"), "input": texts})
        return [row["embedding"] for row in sorted(reply["data"], key=lambda r: r["index"])]

    def rerank(self, pairs: list[tuple[str, str]]) -> list[float]:
        """Scores of (query, text) pairs: one request for each distinct query, scores put back by their index."""
        out = [0.0] * len(pairs)
        for query in dict.fromkeys(q for q, _ in pairs):
            at = [i for i, (q, _) in enumerate(pairs) if q == query]
            reply = self.post("rerank", {"model": self.name("reranker"), "query": query, "documents": [pairs[i][1] for i in at]})
            for row in reply["results"]:
                out[at[row["index"]]] = float(row["relevance_score"])
        return out

    def chat(self, messages: list[list[dict]]) -> list[dict]:
        name = self.name(self.role)
        return [chat_reply(self.post("chat/completions", chat_body(name, m, self.tools, response_format=self.response_format))) for m in messages]
