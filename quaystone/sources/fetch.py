"""Outside documents fetched once, under a pinned digest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from urllib.request import urlopen

from pyspark.sql import SparkSession

from quaystone.config import DocumentSource
from quaystone.session import read_bytes, write_bytes
from quaystone.sources.scan import ScanError


def over_http(url: str) -> bytes:
    with urlopen(url, timeout=60) as answer:  # noqa: S310  the form of the URL was checked
        return answer.read()


def fetch(spark: SparkSession, source: DocumentSource, folder: str, get: Callable[[str], bytes] = over_http) -> tuple[str, bool]:
    """(path, fetched now). A file that is there under the pinned digest stays; anything else never gets its name."""
    path = f"{folder}/{source.file_name}"
    held = read_bytes(spark, path)
    if held is not None and hashlib.sha256(held).hexdigest() == source.sha256:
        return path, False
    content = get(source.canonical_url)
    found = hashlib.sha256(content).hexdigest()
    if found != source.sha256:
        raise ScanError(f"{source.source_id}: the digest is {found}, {source.sha256} is pinned")
    write_bytes(spark, path, content)
    return path, True
