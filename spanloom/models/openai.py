"""Clients of a model server with the OpenAI interface. ``openai`` is imported where none is handed in."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from spanloom.errors import SpanloomError


def _connect(client: Any, **options: Any) -> Any:
    if client is not None:
        return client
    try:
        from openai import OpenAI
    except ImportError as error:
        raise SpanloomError("the openai package isn't installed; hand in a client") from error
    return OpenAI(**options)


class ChatClient:
    """Answers of a chat model; with a schema, a JSON object."""

    def __init__(self, model: str, *, client: Any = None, **options: Any):
        self.model, self.client = model, _connect(client, **options)

    def complete(self, messages: Sequence[Mapping], *, schema: Mapping | None = None, trace: Mapping | None = None, **params: Any) -> dict:
        if schema:
            params["response_format"] = {"type": "json_schema", "json_schema": {"name": schema.get("title", "answer"), "schema": dict(schema)}}
        if trace:
            params["extra_headers"] = {"traceparent": trace["traceparent"]}
        found = self.client.chat.completions.create(model=self.model, messages=[dict(m) for m in messages], **params)
        text, parsed, error = found.choices[0].message.content or "", None, None
        if schema:
            try:
                parsed = json.loads(text)
            except ValueError as bad:
                error = f"no JSON: {bad}"
        usage = {"input_tokens": found.usage.prompt_tokens, "output_tokens": found.usage.completion_tokens} if found.usage else None
        return {"text": text, "parsed": parsed, "error": error, "usage": usage}


class Embeddings:
    """Vectors of an embedding model. Connects where it is used, so it can be sent to executors."""

    def __init__(self, model: str, dimensions: int, *, client: Any = None, **options: Any):
        self.model_id, self.dimensions, self._client, self._options = model, dimensions, client, options

    def embed(self, texts: Sequence[str], *, trace: Mapping | None = None) -> list[list[float]]:
        if not texts:
            return []
        self._client = _connect(self._client, **self._options)
        found = self._client.embeddings.create(model=self.model_id, input=list(texts))
        return [list(d.embedding) for d in sorted(found.data, key=lambda d: d.index)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_client": None}
