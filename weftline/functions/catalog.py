"""What functions a ``udfs`` folder has, read from its sources without importing them."""

from __future__ import annotations

import ast
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class UdfEntry:
    """A function: implemented in a ``.py`` file, or only declared in a ``.pyi`` one."""

    module: str
    name: str
    signature: str
    docstring: str | None
    implemented: bool


@dataclass(frozen=True)
class UdfCatalog:
    entries: tuple[UdfEntry, ...]

    def get(self, module: str, name: str) -> UdfEntry | None:
        return next((e for e in self.entries if (e.module, e.name) == (module, name)), None)


def _functions(path: Path) -> dict[str, tuple[str, str | None]]:
    found = {}
    for node in ast.parse(path.read_text(encoding="utf-8"), str(path)).body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            result = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            found[node.name] = (f"{head} {node.name}({ast.unparse(node.args)}){result}", ast.get_docstring(node))
    return found


def discover_udfs(root: str | Path = "udfs") -> UdfCatalog:
    """All top-level functions under ``root``.  A stub gives the signature, and the docstring if it has one."""
    base = Path(root)
    files = {kind: {p.relative_to(base.parent).with_suffix(""): _functions(p) for p in sorted(base.rglob(f"*.{kind}"))} for kind in ("py", "pyi")}
    entries = []
    for place in sorted(files["py"].keys() | files["pyi"].keys()):
        code, stub = files["py"].get(place, {}), files["pyi"].get(place, {})
        parts = place.parts[:-1] if place.name == "__init__" else place.parts
        for name in sorted(code.keys() | stub.keys()):
            shown = stub.get(name) or code[name]
            doc = shown[1] if shown[1] is not None else code.get(name, (None, None))[1]
            entries.append(UdfEntry(".".join(parts), name, shown[0], doc, name in code))
    return UdfCatalog(tuple(entries))
