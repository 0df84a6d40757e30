"""File names, checksums and the guards around uploads."""

from __future__ import annotations

import hashlib
import os
import string
import unicodedata
from itertools import groupby
from pathlib import Path

EXTENSIONS = ("csv", "json", "jsonl", "ndjson", "parquet", "xlsx")
#: Characters of stored names, and the most of them before and after the last dot.
PLAIN = frozenset(string.ascii_letters + string.digits + "._-")
MOST_STEM, MOST_SUFFIX = 100, 15


def sanitize_filename(name: str) -> str:
    """A name that any store takes: the last part of a path, with every run of other characters as one
    underscore. Control characters go first, so they do not leave one."""
    last = max(name.rfind("/"), name.rfind("\\")) + 1
    shown = (c for c in unicodedata.normalize("NFKC", name[last:]) if unicodedata.category(c) != "Cc")
    plain = "".join("".join(run) if is_plain else "_" for is_plain, run in groupby(shown, PLAIN.__contains__)).strip("._")
    stem, dot, suffix = plain.rpartition(".") if "." in plain else (plain, "", "")
    return (stem[:MOST_STEM] or "upload") + dot + suffix.lower()[:MOST_SUFFIX]


def validate_extension(name: str) -> str:
    """The format that a file name announces."""
    kind = os.path.splitext(name)[1][1:].lower()
    if kind in EXTENSIONS:
        return kind
    raise ValueError(f"{name!r}: datasets are files of the kinds {', '.join(EXTENSIONS)}")


def contained(path: str | Path, root: str | Path) -> Path:
    """The real path, links followed, if it lies below the real root."""
    full, top = os.path.realpath(path), os.path.realpath(root)
    if os.path.commonpath([full, top]) != top:
        raise ValueError(f"{path} is outside {root}")
    return Path(full)


def sha256_text(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8")).hexdigest()


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()
