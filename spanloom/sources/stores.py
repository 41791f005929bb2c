"""Files opened inside tasks, by the URIs that Spark's readers give."""

from __future__ import annotations

import re

from pyarrow import fs

_URI = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*):(//[^/]*)?(/.*)$", re.DOTALL)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of `path` and the path on it. Spark's paths are not percent-encoded, so only
    scheme and authority go through the URI parser."""
    parts = _URI.match(path)
    if parts is None or parts[1].lower() == "file":
        return fs.LocalFileSystem(), parts[3] if parts else path
    system, base = fs.FileSystem.from_uri(f"{parts[1]}:{parts[2] or '//'}/")
    return system, base.rstrip("/") + parts[3]
