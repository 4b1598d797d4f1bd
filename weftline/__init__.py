"""Semantic data queries on Spark: a small operator language compiled to DataFrames.

Names are imported at first use, so Python workers load what they need only.
"""

from importlib import import_module as _import_module

_HOMES = {
    "functions.catalog": ["UdfCatalog", "UdfEntry", "discover_udfs"],
    "functions.native": ["native"],
    "operators.compiler": ["Compiler", "compile_query", "execute"],
    "operators.detect": ["Backend"],
    "operators.executors": ["CachingPromptExecutor", "PromptExecutor", "StaticPromptExecutor"],
    "operators.gemini": ["GeminiPromptExecutor"],
    "plans.dsl": ["Detect", "Filter", "ForEach", "Input", "Map", "Reduce", "Unnest"],
    "plans.nodes": ["Assignment", "DatasetExpr", "DetectSpec", "ForEachPrompt", "JsonValue", "PromptSpec", "QueryProgram", "QueryValidationError", "Record", "RecordPath", "ResolvedPrompt", "Row", "UdfSpec"],
    "plans.rewrite": ["LLMClient", "StaticLLMClient", "build_rewrite_prompt", "canonicalize", "optimize", "rewrite"],
    "plans.text": ["load_query", "parse_query", "program_from_plan", "render_query"],
    "sources.video": ["Video", "VideoView", "open_video"],
    "streaming.queries": ["compile_stream"],
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME_OF)


def __getattr__(name: str):
    if name in _HOME_OF:
        return getattr(_import_module(f".{_HOME_OF[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def main() -> None:
    """Console entry."""
    print(f"Import operators from {__name__}: Input, Map, Filter, Reduce, Unnest, Detect, Record, ForEach.")
