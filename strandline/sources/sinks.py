"""Sinks of named objects, safe under failed and repeated tasks.

A task writes below a folder of its job that readers don't look into; only when all tasks have ended well does the
driver move the objects to their names, and the folder goes. So a task that fails, or runs twice, leaves nothing. Paths are
those of ``pyarrow.fs`` (local or shared folders, ``s3://``, ``gs://``, ``hdfs://``), reachable from all executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder and the names in it."""

    folder: str
    names: list[str]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path)
    return system, root.rstrip("/")


class Objects(DataSourceWriter):
    """Writes what ``objects`` makes of a task's rows: names, each with its content in parts, one after another."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex
        system, _, pending = self._pending()
        system.create_dir(pending, recursive=True)  # by the driver alone: a task that outlives its job finds no place to write

    def objects(self, rows: Iterator[Row]) -> Iterator[tuple[str, Iterator[bytes]]]:
        raise NotImplementedError

    def _pending(self) -> tuple[fs.FileSystem, str, str]:
        system, root = _place(self.path)
        return system, root, f"{root}/_pending-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, _, pending = self._pending()
        folder, names = f"{pending}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=False)
        for name, parts in self.objects(iterator):
            if "/" in name or name.startswith((".", "_")):
                raise ValueError(f"{name} is no name for an object")
            with system.open_output_stream(f"{folder}/{name}") as out:
                for part in parts:
                    out.write(part)
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root, pending = self._pending()
        done = [m for m in messages if m]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two objects have one name")
        for m in done:
            for name in m.names:
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._drop(system, pending)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, pending = self._pending()
        self._drop(system, pending)

    @staticmethod
    def _drop(system: fs.FileSystem, pending: str) -> None:
        if system.get_file_info(pending).type != fs.FileType.NotFound:
            system.delete_dir(pending)


class _NamedFiles(Objects):
    def objects(self, rows):
        for row in rows:
            yield row["name"], iter([bytes(row["content"])])


class _SequenceDrawings(Objects):
    """Rows come by sequence and frame; a sequence's drawing is written as its rows come."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.width, self.height, self.rate = (int(options[k]) for k in ("width", "height", "rate"))

    def objects(self, rows):
        row = next(rows, None)
        while row is not None:
            sequence, rest = row["sequence_id"], [row]

            def drawing():
                yield f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {self.width} {self.height}" font-size="14">\n'.encode()
                shown = 0
                while rest[0] is not None and rest[0]["sequence_id"] == sequence:
                    frame, marks = rest[0]["frame_idx"], []
                    while rest[0] is not None and (rest[0]["sequence_id"], rest[0]["frame_idx"]) == (sequence, frame):
                        marks.append(_mark(rest[0]))
                        rest[0] = next(rows, None)
                    begin = f"{shown / self.rate:g}s"
                    yield (f'<g id="frame{frame}" visibility="hidden"><set attributeName="visibility" to="visible" begin="{begin}" dur="{1 / self.rate:g}s"/>' + "".join(marks) + "</g>\n").encode()
                    shown += 1
                yield b"</svg>\n"

            yield f"{sequence}.svg", drawing()
            row = rest[0]


def _mark(row: Row) -> str:
    """A box with its label above it; nothing for a null box."""
    if row["x1"] is None:
        return ""
    x, y, w, h = row["x1"], row["y1"], row["x2"] - row["x1"], row["y2"] - row["y1"]
    return f'<rect x="{x:g}" y="{y:g}" width="{w:g}" height="{h:g}" fill="none" stroke="red"/><text x="{x:g}" y="{y - 4:g}">{escape(row["label"] or "")}</text>'


class Files(DataSource):
    """Rows ``name, content`` as files."""

    @classmethod
    def name(cls) -> str:
        return "strandline_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _NamedFiles(dict(self.options))


class Drawings(DataSource):
    """Rows ``sequence_id, frame_idx``, box and ``label``, dealt and sorted by sequence and frame, as one SVG per sequence."""

    @classmethod
    def name(cls) -> str:
        return "strandline_drawings"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SequenceDrawings(dict(self.options))
