"""Bytes read by position: in memory, from a file, over HTTP ranges or from a store that
Arrow's file systems know, such as ``s3://`` or ``hdfs://``."""

from __future__ import annotations

import http.client
import os
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from email.message import Message

from pyarrow import fs

HTTP_BLOCK = 8192
#: Blocks that an HTTP source keeps, blocks that it fetches without need to save a request, and
#: blocks of one request.
HTTP_KEPT = 4096
GAP = 3
LONGEST = 512
#: Tries of a request, seconds before it is given up and before it is tried again at first.
TRIES, TIMEOUT, PAUSE = 4, 60, 0.2


class Source:
    """Bytes by position. Those that cost nothing to ask for have no use for a plan."""

    requests = fetched = 0

    def prefetch(self, places: list[int], gap: int = 0) -> None:
        """What will be read soon."""


class MemorySource(Source):

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise ValueError(f"read of {n} bytes at {offset} is past the end ({self.size})")
        return self.data[offset : offset + n]


class FileSource(Source):
    def __init__(self, path: str):
        self.file = open(path, "rb")
        self.size = os.fstat(self.file.fileno()).st_size

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise ValueError(f"read of {n} bytes at {offset} is past the end ({self.size})")
        self.file.seek(offset)
        return self.file.read(n)


class StoreSource(Source):
    """A file of a remote store, by its URI."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise ValueError(f"read of {n} bytes at {offset} is past the end ({self.size})")
        return self.file.read_at(n, offset)


class HttpSource(Source):
    """Aligned blocks are cached; missing neighbours are fetched by one request, and a plan's
    blocks together with small gaps between them. A request that fails is tried again, up to
    TRIES times in all."""

    def __init__(self, url: str, block: int = 0):
        self.url = url
        self.block = block or int(os.environ.get("GENOFRAME_HTTP_BLOCK", HTTP_BLOCK))
        self.kept: OrderedDict[int, bytes] = OrderedDict()
        self.requests = self.fetched = 0
        _, headers, self.url = self._get(0, 1)
        whole = (headers.get("Content-Range") or "").rpartition("/")[2]
        if not whole.isdigit():
            raise ValueError(f"{url}: the server does not answer range requests")
        self.size = int(whole)

    def _get(self, low: int, high: int) -> tuple[bytes, Message, str]:
        for k in range(TRIES):
            try:
                request = urllib.request.Request(self.url, headers={"Range": f"bytes={low}-{high - 1}"})
                with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
                    data = answer.read(high - low + 1)
                    if len(data) == high - low or not answer.headers.get("Content-Range"):
                        return data, answer.headers, answer.geturl()
                failed: Exception = ValueError(f"{self.url}: {len(data)} bytes of a range of {high - low}")
            except urllib.error.HTTPError as e:
                if e.code < 500 and e.code != 429:
                    raise
                failed = e
            except (OSError, http.client.HTTPException) as e:
                failed = e
            if k + 1 < TRIES:
                time.sleep(PAUSE * 2**k)
        raise failed

    def _fetch(self, first: int, last: int) -> None:
        low, high = first * self.block, min(self.size, (last + 1) * self.block)
        data, _, _ = self._get(low, high)
        if len(data) != high - low:
            raise ValueError(f"{self.url}: {len(data)} bytes of a range of {high - low}")
        self.requests += 1
        self.fetched += len(data)
        for k in range(first, last + 1):
            self.kept[k] = data[(k - first) * self.block : (k - first + 1) * self.block]

    def prefetch(self, places: list[int], gap: int = GAP) -> None:
        """Fetch the blocks of some places, as many as half the cache holds: those that are
        near each other, with up to ``gap`` blocks between them, by one request."""
        missing = sorted({p // self.block for p in places if 0 <= p < self.size} - self.kept.keys())[: HTTP_KEPT // 2]
        while len(self.kept) + len(missing) > HTTP_KEPT and self.kept:
            self.kept.popitem(last=False)
        runs: list[list[int]] = []
        for k in missing:
            if runs and k - runs[-1][1] <= 1 + gap and k - runs[-1][0] < LONGEST:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        for first, last in runs:
            self._fetch(first, last)

    def read_at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise ValueError(f"read of {n} bytes at {offset} is past the end ({self.size})")
        if not n:
            return b""
        first, last = offset // self.block, (offset + n - 1) // self.block
        k = first
        while k <= last:
            if k in self.kept:
                self.kept.move_to_end(k)
                k += 1
                continue
            end = k
            while end < last and end + 1 not in self.kept:
                end += 1
            self._fetch(k, end)
            k = end + 1
        data = b"".join(self.kept[k] for k in range(first, last + 1))
        while len(self.kept) > max(HTTP_KEPT, last - first + 1):
            self.kept.popitem(last=False)
        return data[offset - first * self.block :][:n]


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def in_store(path: str) -> bool:
    """Whether a path names a remote store other than HTTP."""
    scheme, colon, _ = path.partition("://")
    return bool(colon) and scheme.lower() not in ("http", "https", "file")


def local_path(path: str) -> str:
    return path.removeprefix("file://")


def beneath(path: str, name: str) -> str:
    """The path or URI of a file in a folder; a store's options stay behind it."""
    head, mark, options = path.partition("?") if in_store(path) else (path, "", "")
    return f"{head.rstrip('/')}/{name}{mark}{options}"


def beside(path: str, suffix: str) -> str:
    """The path or URI of a file named as another is, and a suffix."""
    head, mark, options = path.partition("?") if in_store(path) else (path, "", "")
    return head + suffix + mark + options


def list_store(uri: str) -> list[str]:
    """The URIs of a store's files under a folder, or of the one file."""
    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        return [uri]
    found = store.get_file_info(fs.FileSelector(path))
    return sorted(beneath(uri, f.base_name) for f in found if f.type == fs.FileType.File)


def open_source(path: str) -> FileSource | HttpSource | StoreSource:
    if is_url(path):
        return HttpSource(path)
    return StoreSource(path) if in_store(path) else FileSource(local_path(path))


def read_beside(path: str, suffix: str, span: tuple[int, int] | None = None) -> bytes | None:
    """An index file that stands beside a file, or a span of it, if it is there; a URL's must be."""
    try:
        source = open_source(beside(path, suffix))
    except FileNotFoundError:
        return None
    low, high = span or (0, source.size)
    return source.read_at(low, high - low)
