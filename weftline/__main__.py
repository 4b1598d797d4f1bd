"""``python -m weftline text FILE``: run a query in its text form.  ``python -m weftline expr FILE``: run a Python file's ``output``.

Rows are printed as JSON lines.  ``--gemini`` answers prompts by the Gemini API.
"""

from __future__ import annotations

import argparse
import json
import runpy
import sys
from pathlib import Path

from . import GeminiPromptExecutor, execute, parse_query


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weftline", description=__doc__)
    parser.add_argument("form", choices=["text", "expr"])
    parser.add_argument("file", type=Path)
    parser.add_argument("--gemini", action="store_true")
    given = parser.parse_args(args)
    sys.path.insert(0, str(Path.cwd()))  # for udfs
    query = parse_query(given.file.read_text(encoding="utf-8")) if given.form == "text" else runpy.run_path(str(given.file))["output"]
    for row in execute(query, GeminiPromptExecutor() if given.gemini else None):
        print(json.dumps(row, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
