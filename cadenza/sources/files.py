"""Names of files below a folder, and the file systems of paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative(file_path: Column, root: str) -> Column:
    """A file's path below ``root``, whatever scheme either is written with; the whole path if it is not below it."""
    plain = F.regexp_replace(F.try_url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B"))), "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/")
    top = "/" + re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", root).strip("/") + "/"
    return F.when(plain.startswith(top), F.substring(plain, F.lit(len(top) + 1), F.length(plain))).otherwise(plain)


def store_of(path: str):
    """(file system, folder) of a path: a plain path is local, else the scheme decides (file, hdfs, s3, ...)."""
    from pyarrow import fs

    path = re.sub("^file:/+", "/", path)  # one slash or three
    return fs.FileSystem.from_uri(path) if re.match("^[a-zA-Z][a-zA-Z0-9+.-]*://", path) else (fs.LocalFileSystem(), path)
