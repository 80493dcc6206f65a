"""Schema texts from where they are: a text, a file, a callable, or a service's address."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable

from graphweave.errors import GraphError

QUESTION = json.dumps({"query": "{_service{sdl}}"}).encode()


def _fetch(url: str, timeout: float) -> str:
    request = urllib.request.Request(url, QUESTION, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        if answer.status != 200:
            raise GraphError(f"{url} answered {answer.status}")
        return (((json.load(answer) or {}).get("data") or {}).get("_service") or {}).get("sdl") or ""


def load_schema(source: str | os.PathLike | Callable[[], str], attempts: int = 1, timeout: float = 5.0) -> str:
    """The schema text; sources that fail or give an empty one are asked ``attempts`` times (once at least)."""
    last: Exception | None = None
    for _ in range(max(1, attempts)):
        try:
            if callable(source):
                text = source()
            elif isinstance(source, os.PathLike) or isinstance(source, str) and source.endswith((".graphql", ".graphqls")) and "{" not in source:
                with open(source, encoding="utf-8") as file:
                    text = file.read()
            elif source.startswith(("http://", "https://")):
                text = _fetch(source, timeout)
            else:
                text = source
            if not text.strip():
                raise GraphError("the schema is empty")
            return text
        except Exception as e:
            last = e
    raise GraphError(f"no schema: {last}") from last
