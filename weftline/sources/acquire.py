"""Dumps from elsewhere: fetched once, checked, unpacked in one pass; and a paged query service.

These run on the driver and write to a local folder, from which the dumps are put where Spark reads them. Every result has
a JSON file beside it that says where it came from, and is not made again while both are there.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tarfile
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

#: Bytes moved at once; how many times a dump's size must be free on disk.
CHUNK, FREE_FACTOR = 1 << 20, 2
#: Seconds before each further try of a query, and the answers that are worth another try.
WAITS, WORTH_RETRYING = (5, 15, 45, 120), frozenset({429, 500, 502, 503, 504})


class AcquireError(RuntimeError):
    """A dump that cannot be had whole."""


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def pour(source, target=None) -> tuple[int, str]:
    """(bytes, SHA-256) of a stream, copied to target on the way if there is one."""
    digest, n = hashlib.sha256(), 0
    while chunk := source.read(CHUNK):
        digest.update(chunk)
        n += len(chunk)
        if target is not None:
            target.write(chunk)
    return n, digest.hexdigest()


def file_sha256(path: str) -> tuple[int, str]:
    with open(path, "rb") as f:
        return pour(f)


def need_disk(folder: str, size: int | None) -> int:
    """Free bytes at folder; an error if they are less than FREE_FACTOR times size."""
    os.makedirs(folder, exist_ok=True)
    free = shutil.disk_usage(folder).free
    if size and free < FREE_FACTOR * size:
        raise AcquireError(f"{free} bytes free at {folder}, {FREE_FACTOR * size} needed")
    return free


def beside(path: Path) -> Path:
    return path.with_name(path.name + ".json")


def record(path: Path, facts: dict) -> dict:
    beside(path).write_text(json.dumps(facts, indent=1, sort_keys=True) + "\n", encoding="utf-8")
    return facts


def fetch(url: str, folder: str, name: str | None = None, agent: str = "weftline", timeout: float = 120) -> dict:
    """Fetch url into folder once: into a .part file, which gets its name when it is whole."""
    path = Path(folder) / (name or urllib.parse.urlparse(url).path.rpartition("/")[2])
    if path.exists() and beside(path).exists():
        return json.loads(beside(path).read_text(encoding="utf-8"))
    started, clock, part = now(), time.monotonic(), path.with_name(path.name + ".part")
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
        told = answer.headers.get("Content-Length")
        free = need_disk(folder, int(told) if told else None)
        with part.open("wb") as f:
            size, digest = pour(answer, f)
    if told and size != int(told):
        part.unlink()
        raise AcquireError(f"{url}: {size} of {told} bytes came")
    part.rename(path)
    return record(path, {"url": url, "file": path.name, "bytes": size, "sha256": digest, "seconds": round(time.monotonic() - clock, 1), "started_at_utc": started, "finished_at_utc": now(), "free_before": free})


def unpack(archive: str, members: dict[str, str], folder: str) -> dict:
    """Write the members of a tar archive (name in it: name in folder) in one pass, which ends with the last one wanted.

    What is there already is not written again; every pass that was needed is in the record.
    """
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    notes = out / "unpacked"
    known = json.loads(beside(notes).read_text(encoding="utf-8")) if beside(notes).exists() else {"files": {}, "passes": []}
    wanted = {m: f for m, f in members.items() if not (out / f).exists()}
    if wanted:
        clock, seen, found = time.monotonic(), 0, {}
        with tarfile.open(archive, mode="r|*") as tar:
            for member in tar:
                seen += 1
                if member.name in wanted and member.isfile():
                    name = wanted[member.name]
                    with (out / f"{name}.part").open("wb") as f:
                        size, digest = pour(tar.extractfile(member), f)
                    (out / f"{name}.part").rename(out / name)
                    found[name] = {"bytes": size, "sha256": digest}
                if len(found) == len(wanted):
                    break
        known["passes"].append({"files": sorted(found), "members_seen": seen, "seconds": round(time.monotonic() - clock, 1)})
        known["files"] |= found
        record(notes, known)
        missing = sorted(set(wanted.values()) - set(found))
        if missing:
            raise AcquireError(f"{archive} lacks {', '.join(missing)}")
    for name in members.values():
        if name not in known["files"]:
            size, digest = file_sha256(str(out / name))
            known["files"][name] = {"bytes": size, "sha256": digest}
    return record(notes, known)


def post(url: str, query: str) -> bytes:
    """The answer of a SPARQL endpoint in JSON."""
    data = urllib.parse.urlencode({"query": query, "format": "json"}).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"User-Agent": "weftline", "Accept": "application/sparql-results+json"}), timeout=120) as answer:
        return answer.read()


@dataclass
class PagedClient:
    """Asks a query service page by page, keeps every page, and tries again where that is worth it.

    send and sleep can be given, so the client is tested without a network.
    """

    url: str
    folder: str
    send: Callable[[str, str], bytes] = post
    sleep: Callable[[float], None] = time.sleep
    waits: tuple[float, ...] = WAITS
    requests: int = 0
    retries: int = 0
    kept: int = 0
    digest: object = field(default_factory=hashlib.sha256)

    def ask(self, name: str, query: str) -> list[dict]:
        """The bindings of one query, from the folder if it was asked before under that name."""
        page = Path(self.folder) / f"{name}.json"
        if page.exists():
            self.kept += 1
            body = page.read_bytes()
        else:
            body = self._send(query)
            page.parent.mkdir(parents=True, exist_ok=True)
            page.write_bytes(body)
        self.digest.update(body)
        return json.loads(body)["results"]["bindings"]

    def _send(self, query: str) -> bytes:
        for wait in (0, *self.waits):
            if wait:
                self.retries += 1
                self.sleep(wait)
            self.requests += 1
            try:
                return self.send(self.url, query)
            except urllib.error.HTTPError as e:
                if e.code not in WORTH_RETRYING:
                    raise
                last = e
            except (urllib.error.URLError, TimeoutError) as e:
                last = e
        raise AcquireError(f"no answer after {len(self.waits) + 1} tries") from last

    def pages(self, name: str, query: str, size: int, least: int = 100) -> Iterator[dict]:
        """All bindings of a query that is asked with LIMIT and OFFSET until a page is short; a page that does not come is
        asked for in halves."""
        at = 0
        while True:
            try:
                found = self.ask(f"{name}-{at}-{size}", f"{query} LIMIT {size} OFFSET {at}")
            except AcquireError:
                if size // 2 < least:
                    raise
                size //= 2
                continue
            yield from found
            at += len(found)
            if len(found) < size:
                return


def flat(binding: dict) -> dict[str, str | None]:
    """A binding's values by variable."""
    return {k: v.get("value") for k, v in binding.items()}
