"""Landing files on the driver before Spark reads them: throttled, cached, with a manifest."""

from __future__ import annotations

import hashlib
import time
import urllib.request
from datetime import datetime, timezone
from pathlib import Path

PAUSE_S = 1.5


class Fetcher:
    """Requests at most once in ``pause`` seconds; a file that is there is not fetched again."""

    def __init__(self, folder: str, pause: float = PAUSE_S, timeout: float = 60.0, clock=time.monotonic, sleep=time.sleep):
        self.folder, self.pause, self.timeout = Path(folder), pause, timeout
        self.clock, self.sleep = clock, sleep
        self.last: float | None = None
        self.rows: list[tuple] = []

    def get(self, url: str) -> bytes:
        if self.last is not None and (wait := self.last + self.pause - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        with urllib.request.urlopen(url, timeout=self.timeout) as answer:
            return answer.read()

    def download(self, url: str, filename: str, force: bool = False) -> Path:
        """The landed file; fetching it adds a manifest row (filename, url, sha256, bytes, retrieved)."""
        path = self.folder / filename
        if path.exists() and not force:
            return path
        content = self.get(url)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(path.name + ".part")
        part.write_bytes(content)
        part.replace(path)
        self.rows.append((filename, url, hashlib.sha256(content).hexdigest(), len(content), datetime.now(timezone.utc)))
        return path

    def manifest(self, spark):
        return spark.createDataFrame(self.rows, "filename string, url string, sha256 string, bytes long, retrieved timestamp")
