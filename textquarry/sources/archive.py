"""Fetching a packed index: download, checksum, safe extraction. Driver-side, standard library only."""

from __future__ import annotations

import hashlib
import os
import tarfile
import time
import urllib.error
import urllib.request
import zipfile

_RETRY = (408, 429, 500, 502, 503, 504)


def fetch(url: str, target: str, tries: int = 3, wait: float = 1.0) -> str:
    """Download to a file; time-outs, lost connections and temporary errors are tried again, waiting twice as long."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as source, open(target, "wb") as out:
                while block := source.read(1 << 20):
                    out.write(block)
            return target
        except urllib.error.HTTPError as e:
            if e.code not in _RETRY or attempt == tries - 1:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == tries - 1 or url.startswith("file:"):
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError("unreachable")


def verify(path: str, checksum_text: str) -> None:
    """Compare the SHA-256 sum with the first word of a checksum file."""
    want = checksum_text.split()[0].lower() if checksum_text.split() else ""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    if digest.hexdigest() != want:
        raise ValueError(f"checksum mismatch for {os.path.basename(path)}")


def extract(path: str, target: str) -> list[str]:
    """Unpack a zip, tar.gz or tgz; members that would leave the target folder, and links, are refused."""
    os.makedirs(target, exist_ok=True)
    root = os.path.realpath(target)

    def checked(name: str) -> str:
        full = os.path.realpath(os.path.join(root, name))
        if os.path.commonpath([root, full]) != root:
            raise ValueError(f"unsafe member {name!r}")
        return name

    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            names = [checked(n) for n in z.namelist()]
            z.extractall(target)
        return names
    with tarfile.open(path) as t:
        members = t.getmembers()
        if any(not (m.isfile() or m.isdir()) for m in members):
            raise ValueError("archives with links or devices are refused")
        names = [checked(m.name) for m in members]
        t.extractall(target, filter="data")
    return names


def bootstrap(url: str, target: str) -> list[str]:
    """Fetch an archive and its checksum (address + ``.sha256``), verify and unpack it."""
    os.makedirs(target, exist_ok=True)
    packed = fetch(url, os.path.join(target, ".download"))
    sums = fetch(url + ".sha256", os.path.join(target, ".download.sha256"))
    try:
        with open(sums) as f:
            verify(packed, f.read())
        return extract(packed, target)
    finally:
        os.remove(packed)
        os.remove(sums)
