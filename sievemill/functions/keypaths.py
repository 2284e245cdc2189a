"""The names of all settings in a text, as dotted paths, and a hash of their shape."""

from __future__ import annotations

import configparser
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Which files are read in which way, and what a setting's name looks like in them.
NESTED, OBJECTS, SECTIONS = (".yml", ".yaml"), (".json",), (".ini", ".cfg", ".conf")
NESTED_KEY = re.compile(r"^( *)(?:- +)?([\w.\-]+)\s*:")
PLAIN_KEY = re.compile(r"^\s*([A-Za-z0-9_.\-]+)\s*[:=]")


def nested(text: str) -> list[str]:
    """Paths by indentation: a name belongs to the last one before it that is indented less."""
    out, open_ = [], []
    for line in text.splitlines():
        hit = None if line.lstrip().startswith("#") else NESTED_KEY.match(line)
        if hit is None:
            continue
        depth = len(hit[1])
        del open_[next((i for i, (d, _) in enumerate(open_) if d >= depth), len(open_)) :]
        path = f"{open_[-1][1]}.{hit[2]}" if open_ else hit[2]
        open_.append((depth, path))
        out.append(path)
    return out


def objects(text: str) -> list[str]:
    """Paths of a JSON text's values: ``a.b`` within objects, ``a[]`` within arrays; an empty one is a value itself."""
    out, todo = [], [("", json.loads(text))]
    while todo:
        path, value = todo.pop()
        if value and isinstance(value, dict):
            # a name under no path stands alone, even an empty one
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif value and isinstance(value, list):
            todo += [(f"{path}[]", v) for v in reversed(value)]
        else:
            out.append(path)
    return out


def sections(text: str) -> list[str]:
    """``section.option`` of an INI text; options are in lower case, those of the default section belong to every one."""
    found = configparser.ConfigParser(strict=False, allow_no_value=True)
    found.read_string(text)
    return [f"{s}.{o}" for s in found.sections() for o in found.options(s)]


def plain(text: str) -> list[str]:
    """The name that begins a line and stands before ``:`` or ``=``."""
    return [hit[1] for hit in map(PLAIN_KEY.match, text.splitlines()) if hit]


def _paths(text: str | None, ending: str | None) -> list[str] | None:
    if text is None or ending is None:
        return None
    ending = ending.lower()
    read = nested if ending in NESTED else objects if ending in OBJECTS else sections if ending in SECTIONS else plain
    try:
        return read(text)
    except Exception:  # noqa: BLE001  whatever makes a text unreadable: it is kept as it is
        return None


#: Texts whose paths are Python strings at a time; those before are kept as Arrow arrays, a fraction of their size.
_ROWS = 64


@F.arrow_udf(ArrayType(StringType()))
def key_paths(text: pa.Array, ending: pa.Array) -> pa.Array:
    """Paths of a text's settings in the order they stand, repeats included, by the file's ending (``.yml``); null if the
    text can't be read, or text or ending is null.  One pass over a text with a stack, which no built-in expresses
    without going over the lines again for each line."""
    kind, parts = pa.list_(pa.string()), []
    for lo in range(0, len(text), _ROWS):
        rows = zip(text.slice(lo, _ROWS).to_pylist(), ending.slice(lo, _ROWS).to_pylist(), strict=True)
        parts.append(pa.array([_paths(t, e) for t, e in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def shape(paths: Column) -> Column:
    """SHA-1 of the different paths, sorted, one a line; null without any: such a file is like no other."""
    return F.when(F.size(paths) > 0, F.sha1(F.array_join(F.array_sort(F.array_distinct(paths)), "\n").cast("binary")))
