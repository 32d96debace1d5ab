"""Volume change journals: binary records, and a stream whose offset is the record number.

``spark.readStream.format("change_journal").option("path", folder)`` reads folders of record files (``*.usn``, concatenated
records) in order of their numbers, at most ``maxRecords`` (512) a batch.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "file_ref string, parent_ref string, usn long, ts timestamp, reason long, attributes long, name string, version int"
_EPOCH = datetime(1601, 1, 1, tzinfo=UTC)
#: Reason bits.
REASONS = {"data": 0x7, "create": 0x100, "delete": 0x200, "rename_old": 0x1000, "rename_new": 0x2000, "close": 0x80000000}


def action(reason: int) -> str:
    """What an index does about a record: the strongest of its reasons."""
    if reason & REASONS["delete"]:
        return "delete"
    if reason & REASONS["rename_old"]:
        return "delete"
    return "upsert"


def parse_records(data: bytes) -> Iterator[tuple]:
    """Records of version 2 (64-bit references, decimal) and 3 (128-bit, hexadecimal in stored order); a broken tail ends the reading."""
    at = 0
    while at + 8 <= len(data):
        length, major = struct.unpack_from("<IH", data, at)
        if length < 8 or at + length > len(data):
            return
        wide = {2: 8, 3: 16}.get(major)
        head = 8 + 2 * (wide or 0)
        if wide and length >= head + 36:
            refs = [data[at + 8 + k * wide : at + 8 + (k + 1) * wide] for k in (0, 1)]
            usn, stamp, reason, _source, _security, attributes, size, start = struct.unpack_from("<qqIIIIHH", data, at + head)
            if start + size <= length:
                name = data[at + start : at + start + size].decode("utf-16-le", "replace")
                spell = (lambda r: str(int.from_bytes(r, "little"))) if major == 2 else (lambda r: r.hex().upper())
                yield spell(refs[0]), spell(refs[1]), usn, _EPOCH + timedelta(microseconds=stamp // 10), reason, attributes, name, major
        at += (length + 7) // 8 * 8


def build_record(file_ref: int, parent_ref: int, usn: int, ts: datetime, reason: int, name: str, version: int = 2, attributes: int = 32) -> bytes:
    """One record, for tests and generators."""
    wide = 8 if version == 2 else 16
    raw = name.encode("utf-16-le")
    head = 8 + 2 * wide + 36
    length = (head + len(raw) + 7) // 8 * 8
    stamp = int((ts - _EPOCH) / timedelta(microseconds=1)) * 10
    body = struct.pack("<IHH", length, version, 0) + file_ref.to_bytes(wide, "little") + parent_ref.to_bytes(wide, "little")
    body += struct.pack("<qqIIIIHH", usn, stamp, reason, 0, 0, attributes, len(raw), head) + raw
    return body.ljust(length, b"\0")


#: Bytes that hold a first record whatever its name.
_HEAD = 4096


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("maxrecords", options.get("maxRecords", "512")))
        self.starts: dict[str, int] = {}
        self.first = int(options.get("startusn", options.get("startUsn", "-1")))

    def initialOffset(self) -> dict:
        return {"usn": self.first}

    def _files(self) -> list[tuple[int, str]]:
        """``(first number, file)`` in order; only the head of a file that is new or has grown from nothing is read."""
        for f in glob.glob(os.path.join(self.path, "*.usn")):
            if f not in self.starts:
                with open(f, "rb") as h:
                    first = next(iter(parse_records(h.read(_HEAD))), None)
                if first is not None:
                    self.starts[f] = first[2]
        return sorted((usn, f) for f, usn in self.starts.items() if os.path.exists(f))

    def _after(self, usn: int, up_to: int | None = None, most: int | None = None) -> list[tuple]:
        """Records above ``usn``: of files whose numbers follow each other only those that can hold one are read."""
        files = self._files()
        rows: list[tuple] = []
        for (first, f), (following, _) in zip(files, [*files[1:], (None, None)], strict=True):
            if following is not None and following <= usn + 1 or up_to is not None and first > up_to:
                continue
            if most is not None and len(rows) >= most and first > rows[-1][2]:
                break
            with open(f, "rb") as h:
                rows += [r for r in parse_records(h.read()) if r[2] > usn and (up_to is None or r[2] <= up_to)]
            rows.sort(key=lambda r: r[2])
        return rows[:most]

    def read(self, start: dict):
        rows = self._after(start["usn"], most=self.most)
        return iter(rows), {"usn": rows[-1][2] if rows else start["usn"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._after(start["usn"], end["usn"]))


class ChangeJournal(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_journal"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))
