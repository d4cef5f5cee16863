"""Input files and service answers, brought by the driver into a folder of any file system that Spark writes to.

A file is received into memory (beyond `SPOOL` bytes into an unnamed file of the driver), checked by its kind, written to
the folder under a name that readers skip, and renamed: what has its own name in the folder is whole and checked.
"""

from __future__ import annotations

import json
import os
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable
from http.client import HTTPException
from tempfile import SpooledTemporaryFile
from typing import IO
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import SparkSession

SPOOL = 64 << 20
BLOCK = 4 << 20


class Refused(RuntimeError):
    """What arrived isn't what was asked for, or nothing arrived."""


class Landing:
    """A folder whose files appear whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at("."))) if self.has(".") else []

    def put(self, name: str, blocks: Iterable[bytes]) -> None:
        folder, _, last = name.rpartition("/")
        hidden = self._at(f"{folder}/_{last}-{uuid.uuid4().hex}" if folder else f"_{last}-{uuid.uuid4().hex}")
        try:
            out = self.fs.create(hidden, False)
            try:
                for block in blocks:
                    out.write(bytearray(block))
            finally:
                out.close()
            if self.has(name):  # a rename replaces nothing
                self.fs.delete(self._at(name), False)
            if not self.fs.rename(hidden, self._at(name)):
                raise Refused(f"{self.root}/{name} could not be put in place")
        finally:
            self.fs.delete(hidden, False)

    def get(self, name: str) -> IO[bytes]:
        """The file's bytes, at their start."""
        body, stream = SpooledTemporaryFile(SPOOL), self.fs.open(self._at(name))
        try:
            while len(block := bytes(stream.readNBytes(BLOCK))):
                body.write(block)
        finally:
            stream.close()
        body.seek(0)
        return body

    def drop(self, name: str) -> None:
        self.fs.delete(self._at(name), False)


def _blocks(body: IO[bytes]) -> Iterable[bytes]:
    return iter(lambda: body.read(BLOCK), b"")


def whole_archive(body: IO[bytes], kind: str, source: str) -> None:
    """Every member passes its checksum."""
    try:
        with zipfile.ZipFile(body) as archive:
            broken = archive.testzip()
    except zipfile.BadZipFile as e:
        raise Refused(f"{source}: no whole zip archive ({e})") from e
    if broken:
        raise Refused(f"{source}: {broken} is damaged in its zip archive")


def no_page(body: IO[bytes], kind: str, source: str) -> None:
    if kind == "text/html":
        raise Refused(f"{source}: a web page came in place of the table")


#: What a file must pass before it gets its name, by the name's ending.
CHECKS: dict[str, Callable[[IO[bytes], str, str], None]] = {"zip": whole_archive, "csv": no_page}


def fetch(landing: Landing, url: str, name: str, refresh: bool = False, timeout: int = 60, send=urlopen) -> bool:
    """Bring url's file into landing as name; whether it was fetched. A file that is there stays, unless refresh is set.
    Answers that fail their check, and requests that fail, raise Refused and leave the folder as it was."""
    if not refresh and landing.has(name):
        return False
    with SpooledTemporaryFile(SPOOL) as body:
        try:
            with send(Request(url, headers={"User-Agent": "terrasift"}), timeout=timeout) as answer:
                kind = answer.headers.get_content_type()
                for block in _blocks(answer):
                    body.write(block)
        except (OSError, HTTPException) as e:
            raise Refused(f"{url}: {e}") from e
        body.seek(0)
        if check := CHECKS.get(name.rpartition(".")[2].lower()):
            check(body, kind, url)
        body.seek(0)
        landing.put(name, _blocks(body))
    return True


def unpack(landing: Landing, name: str) -> list[str]:
    """Put an archive's members beside it, each whole, and delete it; the members' names. None is put if one is damaged."""
    with landing.get(name) as body:
        whole_archive(body, "", name)
        with zipfile.ZipFile(body) as archive:
            members = [m for m in archive.namelist() if not m.endswith("/")]
            if bad := [m for m in members if m.startswith("/") or ".." in m.split("/")]:
                raise Refused(f"{name}: {bad[0]} leads out of the folder")
            for member in members:
                with archive.open(member) as content:
                    landing.put(member, _blocks(content))
    landing.drop(name)
    return members


def secret(name: str) -> str:
    """A key from the environment."""
    if not (value := os.environ.get(name, "").strip()):
        raise Refused(f"set {name} in the environment")
    return value


# What the two services are asked for. The box is south, west, north, east.
RECORDS_ASKED = {"output": "json", "countrycode": "AU", "maxresults": "100000", "compact": "false", "verbose": "false"}
BOX = (-45.0, 105.0, -9.0, 160.0)
KIND_ASKED = '"amenity"="charging_station"'
PATIENCE = {"records": 300, "elements": 180}


def records_request(url: str, key: str) -> Request:
    """One request for all records of the country."""
    return Request(f"{url}?{urlencode({**RECORDS_ASKED, 'key': key})}", headers={"User-Agent": "terrasift"})


def elements_request(url: str, box: tuple[float, float, float, float] = BOX) -> Request:
    """One request for the nodes and ways of the kind inside the box, with the ways' centres."""
    inside = ",".join(map(str, box))
    parts = "".join(f"{what}[{KIND_ASKED}]({inside});" for what in ("node", "way"))
    query = f"[out:json][timeout:{PATIENCE['elements']}];({parts});out center tags;"
    return Request(url, data=urlencode({"data": query}).encode(), headers={"User-Agent": "terrasift (batch analytics)"}, method="POST")


def ask(landing: Landing, name: str, request: Callable[[], Request], member: str | None = None, refresh: bool = False, timeout: int = 180, waits: tuple[int, ...] = (), send=urlopen) -> bool:
    """Keep a service's JSON answer in landing as name; whether it was asked. request is only made if it is needed, so a
    kept answer needs no key. Anything but status 200 with JSON (that has member) is asked again after each wait."""
    if not refresh and landing.has(name):
        return False
    said = ""
    for wait in (*waits, None):
        try:
            with send(request(), timeout=timeout) as answer:
                if answer.status == 200:
                    value = json.load(answer)
                    if member and member not in value:
                        raise ValueError(f"no {member} in the answer")
                    landing.put(name, [json.dumps(value).encode()])
                    return True
                said = f"status {answer.status}"
        except HTTPError as e:
            said = f"status {e.code}"
        except (OSError, HTTPException, ValueError) as e:
            said = str(e)
        if wait is not None:
            time.sleep(wait)
    raise Refused(f"{name}: no answer after {len(waits) + 1} attempts ({said})")


def ask_records(landing: Landing, name: str, url: str, key_name: str, refresh: bool = False, **how) -> bool:
    return ask(landing, name, lambda: records_request(url, secret(key_name)), None, refresh, PATIENCE["records"], **how)


def ask_elements(landing: Landing, name: str, url: str, refresh: bool = False, waits: tuple[int, ...] = (20, 40, 60), **how) -> bool:
    return ask(landing, name, lambda: elements_request(url), "elements", refresh, PATIENCE["elements"], waits, **how)
