"""Resumable downloads to a local file: a byte limit, ranges, and a checksum where the server gives one."""

from __future__ import annotations

import hashlib
import os
import re
import urllib.request
from collections.abc import Callable
from pathlib import Path

BLOCK = 1 << 20


class DownloadError(RuntimeError):
    """The server sent other bytes, or more, than it may."""


def md5_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "md5").hexdigest()


def _checked_tag(tag: str | None) -> str | None:
    """An ETag that is an MD5; those of multipart uploads are not."""
    tag = (tag or "").strip('"')
    return tag if re.fullmatch(r"[0-9a-f]{32}", tag) else None


def fetch(url: str, to: str | Path, most_bytes: int, opener: Callable = urllib.request.urlopen) -> Path:
    """The file at the url under its final name; what an earlier call left is continued, a whole file is kept.

    The part file appears under the final name only when its size, and the MD5 if there is one, are right."""
    to = Path(to)
    with opener(urllib.request.Request(url, method="HEAD")) as head:
        size, tag = int(head.headers.get("Content-Length", -1)), _checked_tag(head.headers.get("ETag"))
    if size > most_bytes:
        raise DownloadError(f"{url}: {size} bytes, at most {most_bytes}")
    if to.exists() and to.stat().st_size == size and (tag is None or md5_of(to) == tag):
        return to
    part = to.with_name(to.name + ".part")
    have = part.stat().st_size if part.exists() else 0
    if 0 <= size < have:
        part.unlink()
        have = 0
    if have != size or not part.exists():
        request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
        with opener(request) as answer:
            ranged = re.fullmatch(r"bytes (\d+)-(\d+)/(\d+|\*)", answer.headers.get("Content-Range", "") or "")
            if have and not ranged:
                have = 0  # the server sends all of it
            elif have and int(ranged[1]) != have:
                raise DownloadError(f"{url}: range starts at {ranged[1]}, not {have}")
            with part.open("ab" if have else "wb") as f:
                while block := answer.read(BLOCK):
                    have += len(block)
                    if have > most_bytes:
                        raise DownloadError(f"{url}: more than {most_bytes} bytes")
                    f.write(block)
                f.flush()
                os.fsync(f.fileno())
    if size >= 0 and part.stat().st_size != size:
        raise DownloadError(f"{url}: {part.stat().st_size} of {size} bytes")
    if tag and md5_of(part) != tag:
        part.unlink()
        raise DownloadError(f"{url}: checksum differs")
    part.replace(to)
    return to
