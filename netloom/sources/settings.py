"""Settings of a run: the command line goes before the environment, that before a file."""

from __future__ import annotations

import json
import shlex
from collections.abc import Mapping

PREFIX = "NETLOOM_"
#: Words that switch a flag on; everything else switches it off.
ON = ("1", "true", "yes", "on")


def listed(text: str | None) -> list[str]:
    """The items of a list in one text, apart by commas or blanks, each once; quotes keep an item together."""
    lexer = shlex.shlex(text or "", posix=True)
    lexer.whitespace += ","
    lexer.whitespace_split, lexer.commenters = True, ""
    return list(dict.fromkeys(x for x in lexer if x))


def read_settings(names: dict[str, type], path: str | None, environ: Mapping[str, str]) -> dict:
    """Values by name, for names with their types (list, bool, int, str), of a file with one JSON object and of variables
    ``NETLOOM_<NAME>``, which go before it; the items of lists are taken from both. Empty values and variables of other
    names are passed over; a name in the file that is none is an error."""
    stored: dict = {}
    if path:
        with open(path, encoding="utf-8") as opened:
            stored = json.load(opened)
        if not isinstance(stored, dict) or not set(stored) <= set(names):
            raise ValueError(f"{path}: expected an object with names among {sorted(names)}")
    found = {}
    for name, kind in names.items():
        given = environ.get(PREFIX + name.upper(), "").strip()
        kept = stored.get(name)
        if kind is list:
            of_file = listed(kept) if isinstance(kept, str) else list(kept or [])
            value = list(dict.fromkeys([*listed(given), *of_file]))
        elif kind is bool:
            value = str(given or ("" if kept is None else kept)).lower()
            value = None if value == "" else value in ON
        else:
            value = given or kept
            value = None if value in (None, "") else kind(value)
        if value not in (None, []):
            found[name] = value
    return found
