"""Heads of photo files as a Spark data source: sizes and capture times without reading the rest."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that may hold its capture time, and the tags that lead to it.
EXIF_BYTES, EXIF_TAG, TIME_TAG, ZONE_TAG = 256 * 1024, 0x8769, 0x9003, 0x9011


def exif_time(content: bytes) -> tuple[str | None, str | None]:
    """(date and time, zone) as a JPEG file's EXIF block has them; None where it has none."""
    data, at = content[:EXIF_BYTES], 2
    if data[:2] != b"\xff\xd8":
        return None, None
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2:
            break
        if data[at + 1] == 0xE1 and data[at + 4 : at + 8] == b"Exif":
            try:
                return _tiff_time(data[at + 10 :])
            except (struct.error, UnicodeDecodeError):
                break
        at += 2 + size
    return None, None


def _tiff_time(tiff: bytes) -> tuple[str | None, str | None]:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        return None, None

    def entry(directory: int, tag: int):
        for i in range(struct.unpack_from(order + "H", tiff, directory)[0]):
            found, _, count, value = struct.unpack_from(order + "HHII", tiff, directory + 2 + 12 * i)
            if found == tag:
                return count, value, directory + 2 + 12 * i + 8
        return None

    def text(directory: int, tag: int) -> str | None:
        found = entry(directory, tag)
        if found is None:
            return None
        count, value, inline = found
        start = inline if count <= 4 else value
        return tiff[start : start + count].split(b"\0")[0].decode("ascii") if start + count <= len(tiff) else None

    exif = entry(struct.unpack_from(order + "I", tiff, 4)[0], EXIF_TAG)
    return (text(exif[1], TIME_TAG), text(exif[1], ZONE_TAG)) if exif else (None, None)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class PhotoHeaders(DataSource):
    """(path, size, time, zone, error): a row for each file below the path of load().

    Partitions are runs of files that together hold about ``partition_mb`` MB of heads. A file that can't be opened is a row with an error. Paths may be local
    or of a store that Arrow knows (file:, s3:, gs:, hdfs:).
    """

    @classmethod
    def name(cls) -> str:
        return "photo_headers"

    def schema(self) -> str:
        return "path string, size long, time string, zone string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], float(self.options.get("partition_mb", "64")) * (1 << 20))


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: float):
        self.path, self.most = path, most

    def _opened(self):
        """The store, the path in it, and what goes before a path to name it as Spark does."""
        from pyarrow import fs

        if "://" not in self.path and not self.path.startswith("file:"):
            return fs.LocalFileSystem(), self.path, "file:"
        store, inside = fs.FileSystem.from_uri(self.path.replace("s3a://", "s3://", 1).replace("file:///", "file:/", 1).replace("file:/", "file:///", 1))
        scheme, _, rest = self.path.partition("://")
        if isinstance(store, fs.LocalFileSystem):
            return store, inside, "file:"
        return store, inside, f"{scheme}://" if isinstance(store, (fs.S3FileSystem, fs.GcsFileSystem)) else f"{scheme}://{rest.split('/', 1)[0]}"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, inside, _ = self._opened()
        found = [f for f in store.get_file_info(fs.FileSelector(inside, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        out, held = [], float("inf")
        for f in sorted(found, key=lambda f: f.path):
            if held >= self.most:
                out.append(Files([]))
                held = 0
            out[-1].files.append((f.path, f.size))
            held += min(f.size, EXIF_BYTES)
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _, before = self._opened()
        for path, size in partition.files:
            try:
                with store.open_input_file(path) as f:
                    yield (before + path, size, *exif_time(f.read_at(min(size, EXIF_BYTES), 0)), None)
            except OSError as e:
                yield (before + path, size, None, None, str(e))
