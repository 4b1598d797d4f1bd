"""What answers prompts.

An executor is pickled to the workers, so it holds plain settings and opens
clients when first used there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import OrderedDict
from collections.abc import Mapping
from typing import Any, Protocol, runtime_checkable

from ..plans.nodes import PromptSpec, QueryValidationError, ResolvedPrompt


@runtime_checkable
class PromptExecutor(Protocol):
    def execute(self, op_type: str, prompt: PromptSpec, resolved_prompt: ResolvedPrompt, payload: Any, context: Mapping[str, Any]) -> Any: ...


class StaticPromptExecutor:
    """Answers by operator and prompt: a constant, or a function of (resolved prompt, payload, context)."""

    def __init__(self, handlers: Mapping[tuple[str, Any], Any]) -> None:
        self.handlers = dict(handlers)

    def execute(self, op_type: str, prompt: PromptSpec, resolved_prompt: ResolvedPrompt, payload: Any, context: Mapping[str, Any]) -> Any:
        key = op_type, prompt.cache_key()
        if key not in self.handlers:
            raise QueryValidationError(f"no answer is given for {key}")
        found = self.handlers[key]
        return found(resolved_prompt, payload, context) if callable(found) else found


#: Answers of this process by the name of the cache: they outlive the executor, which comes with each task anew.
_ANSWERS: dict[str, OrderedDict[str, Any]] = {}


class CachingPromptExecutor:
    """Remembers answers by operator, prompt and resolved values, so that a task tried again on a worker asks nothing twice.

    ``name`` says which answers belong together; without one, those of this
    executor and of its pickled copies.
    """

    def __init__(self, executor: PromptExecutor, limit: int = 100_000, name: str | None = None) -> None:
        self.executor, self.limit = executor, limit
        self.name = name or uuid.uuid4().hex

    @property
    def held(self) -> OrderedDict[str, Any]:
        return _ANSWERS.setdefault(self.name, OrderedDict())

    def execute(self, op_type: str, prompt: PromptSpec, resolved_prompt: ResolvedPrompt, payload: Any, context: Mapping[str, Any]) -> Any:
        asked = json.dumps([op_type, repr(prompt.cache_key()), list(resolved_prompt.parts), prompt.output_schema, getattr(self.executor, "model", None)], sort_keys=True, default=repr)
        key, held = hashlib.sha256(asked.encode()).hexdigest(), self.held
        if key in held:
            return held[key]
        answer = held[key] = self.executor.execute(op_type, prompt, resolved_prompt, payload, context)
        while len(held) > self.limit:
            held.popitem(last=False)
        return answer
