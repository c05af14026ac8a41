"""Pages and archives over HTTP: retries with waits that the server may ask for, a store of answers, downloads in byte ranges."""

from __future__ import annotations

import hashlib
import http.client
import json
import os
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from pathlib import Path
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from ..errors import IngestError
from .files import check_archive

AGENT = "medsentry"
#: Statuses after which a request is worth another try, and the longest wait in seconds.
PASSING, LONGEST_WAIT = (429, 500, 502, 503, 504), 120.0
#: What breaks off on the way; HTTPError, an answer with a status, is told apart first.
BROKEN = (OSError, http.client.HTTPException)
#: Files below this size come in one piece.
WHOLE, PIECE = 8 << 20, 1 << 20


@dataclass(frozen=True)
class Answer:
    status: int
    headers: dict[str, str]
    body: bytes
    stored: bool = False


def asked_wait(headers: dict[str, str], now: datetime | None = None) -> float:
    """Seconds that Retry-After asks for, as a number or as a date; 0 if it asks for nothing readable."""
    raw = {k.lower(): v for k, v in headers.items()}.get("retry-after", "").strip()
    try:
        return max(0.0, float(raw))
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(raw)
    except (TypeError, ValueError):
        return 0.0
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return max(0.0, (at - (now or datetime.now(timezone.utc))).total_seconds())


@dataclass
class Client:
    """``get`` answers from the store if it can. Only answers with status 200 are stored: an outage must not last."""

    store: str | Path | None = None
    tries: int = 5
    first_wait: float = 1.0
    timeout: float = 60.0
    sleep: Callable[[float], None] = time.sleep
    headers: dict[str, str] = field(default_factory=lambda: {"User-Agent": AGENT})

    def _place(self, url: str, params: dict[str, str] | None) -> Path | None:
        name = hashlib.sha256(json.dumps(["GET", url, sorted((params or {}).items())]).encode()).hexdigest()
        return Path(self.store, name[:2], name) if self.store else None

    def holds(self, url: str, params: dict[str, str] | None = None) -> bool:
        """Whether ``get`` needs no request, so callers that pace themselves needn't wait."""
        at = self._place(url, params)
        return bool(at) and at.with_suffix(".body").exists()

    def open(self, url: str, method: str = "GET", headers: dict[str, str] | None = None):
        return urlopen(Request(url, method=method, headers=self.headers | (headers or {})), timeout=self.timeout)

    def _once(self, url: str) -> Answer:
        try:
            with self.open(url) as r:
                return Answer(r.status, dict(r.headers), r.read())
        except HTTPError as e:
            with e:
                return Answer(e.code, dict(e.headers), e.read())

    def get(self, url: str, params: dict[str, str] | None = None, fresh: bool = False) -> Answer:
        """The last answer, whatever its status; a connection that fails on every try raises."""
        at = self._place(url, params)
        if at and not fresh and self.holds(url, params):
            try:
                return Answer(200, json.loads(at.with_suffix(".json").read_text()), at.with_suffix(".body").read_bytes(), stored=True)
            except (OSError, ValueError):
                pass  # an entry that can't be read is asked for again
        full = f"{url}{'&' if '?' in url else '?'}{urlencode(params)}" if params else url
        for k in range(1, self.tries + 1):
            wait = self.first_wait * 2 ** (k - 1) * (1 + random.random() / 4)
            try:
                answer = self._once(full)
            except BROKEN as e:
                if k == self.tries:
                    raise IngestError(f"{full}: {e}") from e
            else:
                if answer.status not in PASSING or k == self.tries:
                    break
                wait = max(wait, asked_wait(answer.headers))
            self.sleep(min(wait, LONGEST_WAIT))
        if at and answer.status == 200:
            at.parent.mkdir(parents=True, exist_ok=True)
            # The body is decoded as it is read, so what told how it travelled isn't kept.
            kept = {k: v for k, v in answer.headers.items() if k.lower() not in ("content-encoding", "content-length", "transfer-encoding")}
            at.with_suffix(".json").write_text(json.dumps(kept))
            aside = at.with_suffix(f".{os.getpid()}")
            aside.write_bytes(answer.body)
            aside.replace(at.with_suffix(".body"))
        return answer


def _size(client: Client, url: str) -> tuple[int | None, bool]:
    """(bytes, whether ranges of them can be asked for); None where the server doesn't say."""
    try:
        with client.open(url, "HEAD") as r:
            n = r.headers.get("Content-Length")
            return (int(n) if n else None), r.headers.get("Accept-Ranges", "").lower() == "bytes"
    except HTTPError as e:
        e.close()
        return None, False


def _range(client: Client, url: str, out: int, first: int, last: int, tries: int) -> None:
    """Fill bytes first..last of the open file. Each try asks only for what is still missing."""
    at = first
    for _ in range(tries):
        try:
            with client.open(url, headers={"Range": f"bytes={at}-{last}"}) as r:
                if r.status != 206:
                    raise IngestError(f"{url}: status {r.status} for a range")
                while at <= last and (piece := r.read(min(PIECE, last + 1 - at))):
                    at += os.pwrite(out, piece, at)
        except HTTPError as e:
            e.close()
            if e.code not in PASSING:
                raise IngestError(f"{url}: status {e.code} for a range") from e
        except BROKEN:
            pass
        if at > last:
            return
        client.sleep(client.first_wait)
    raise IngestError(f"{url}: {at - first} of {last + 1 - first} bytes of a range after {tries} tries")


def download(url: str, path: str | Path, client: Client | None = None, ranges: int = 4, tries: int = 8, least: int = 1 << 20, whole: int = WHOLE) -> str:
    """A zip archive's checksum, once it lies at ``path`` complete; an incomplete one never does.

    A large file comes in ``ranges`` that are fetched side by side into their places in one file.
    """
    client, aside = client or Client(), Path(f"{path}.part")
    aside.parent.mkdir(parents=True, exist_ok=True)
    try:
        size, in_ranges = _size(client, url)
        out = os.open(aside, os.O_CREAT | os.O_TRUNC | os.O_RDWR)
        try:
            if size and in_ranges and size >= max(whole, ranges):
                os.truncate(out, size)
                cuts = [size * i // ranges for i in range(ranges + 1)]
                with ThreadPoolExecutor(ranges) as pool:
                    for done in [pool.submit(_range, client, url, out, a, b - 1, tries) for a, b in zip(cuts, cuts[1:], strict=False)]:
                        done.result()
            else:
                answer = client.get(url, fresh=True)
                if answer.status != 200:
                    raise IngestError(f"{url}: status {answer.status}")
                os.pwrite(out, answer.body, 0)
        finally:
            os.close(out)
        checksum = check_archive(aside, least, size)
        aside.replace(path)
        return checksum
    finally:
        aside.unlink(missing_ok=True)
