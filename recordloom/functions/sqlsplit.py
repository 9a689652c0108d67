"""Statements of an SQL script."""

from __future__ import annotations

import re

_QUOTED = re.compile(r"""['"`]|--|/\*""")


def statements(script: str) -> list[str]:
    """Parts between semicolons that aren't within quotes or comments; blank ones are dropped."""
    if not _QUOTED.search(script):
        return [x for part in script.split(";") if (x := part.strip())]
    out, start, i, n = [], 0, 0, len(script)
    while i < n:
        c = script[i]
        if c in "'\"`":
            end = script.find(c, i + 1)
            i = n if end < 0 else end
        elif script.startswith("--", i):
            end = script.find("\n", i)
            i = n if end < 0 else end
        elif script.startswith("/*", i):
            end = script.find("*/", i + 2)
            i = n if end < 0 else end + 1
        elif c == ";":
            out.append(script[start:i])
            start = i + 1
        i += 1
    out.append(script[start:])
    return [x.strip() for x in out if x.strip()]
