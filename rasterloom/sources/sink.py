"""Rendered tiles as files: a PySpark data source to write to, whose files appear when a job is done.

`df.write.format("tile_images").option("kind", "png").save(folder)` takes rows of col, row and image and makes folder/col-row.png.
Tasks write under a hidden folder of the job; the files of the attempts that succeeded are moved to their names when all
tasks have ended (append: beside the images there, replacing those of the same tiles; overwrite: instead of them), and a job
that fails leaves nothing. The driver moves one file for each tile, on some threads. Two images of one tile are an error.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rasterloom.sources.files import file_system, local_path


class Folder:
    """What a sink needs of a folder, local or in an object store."""

    def __init__(self, path: str, options: dict | None = None):
        self.local = local_path(path)
        if self.local is None:
            self.system, self.place = file_system(path, options)

    def put(self, name: str, data: bytes) -> None:
        if self.local is not None:
            target = os.path.join(self.local, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as file:
                file.write(data)
            return
        self.system.create_dir(f"{self.place}/{name}".rpartition("/")[0])
        with self.system.open_output_stream(f"{self.place}/{name}") as file:
            file.write(data)

    def move(self, name: str, to: str) -> None:
        if self.local is not None:
            os.replace(os.path.join(self.local, name), os.path.join(self.local, to))
        else:
            self.system.move(f"{self.place}/{name}", f"{self.place}/{to}")

    def names(self) -> list[str]:
        """Files of the folder itself."""
        if self.local is not None:
            return [e.name for e in os.scandir(self.local) if e.is_file()] if os.path.isdir(self.local) else []
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self.place, allow_not_found=True))
        return [f.base_name for f in found if f.type == fs.FileType.File]

    def delete(self, name: str) -> None:
        if self.local is not None:
            os.remove(os.path.join(self.local, name))
        else:
            self.system.delete_file(f"{self.place}/{name}")

    def clear(self, name: str) -> None:
        """Deletes a folder in this one, if it is there."""
        if self.local is not None:
            shutil.rmtree(os.path.join(self.local, name), ignore_errors=True)
            return
        from pyarrow import fs

        if self.system.get_file_info(f"{self.place}/{name}").type != fs.FileType.NotFound:
            self.system.delete_dir(f"{self.place}/{name}")


@dataclass
class Written(WriterCommitMessage):
    """A task's folder and the names of its files."""

    stage: str
    names: list[str]


class ImageWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "png"), overwrite
        self.job = options.get("job") or uuid.uuid4().hex
        self.options = {k: v for k, v in options.items() if k not in ("path", "kind", "job")}

    @property
    def hidden(self) -> str:
        return f".images-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        folder, stage, names = Folder(self.path, self.options), f"{self.hidden}/{uuid.uuid4().hex}", []
        for r in iterator:
            names.append(f"{r['col']}-{r['row']}.{self.kind}")
            folder.put(f"{stage}/{names[-1]}", bytes(r["image"]))
        return Written(stage, names)

    def commit(self, messages: list) -> None:
        folder = Folder(self.path, self.options)
        staged = sorted((name, m.stage) for m in messages if m for name in m.names)
        named = {name for name, _ in staged}
        if len(named) < len(staged):
            raise ValueError("two images of one tile")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda s: folder.move(f"{s[1]}/{s[0]}", s[0]), staged))
            if self.overwrite:
                list(pool.map(folder.delete, [n for n in folder.names() if n.endswith(f".{self.kind}") and not n.startswith(".") and n not in named]))
        folder.clear(self.hidden)

    def abort(self, messages: list) -> None:
        Folder(self.path, self.options).clear(self.hidden)


class TileImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_images"

    def schema(self) -> str:
        return "col int, row int, image binary"

    def writer(self, schema, overwrite: bool) -> ImageWriter:
        missing = {"col", "row", "image"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return ImageWriter(dict(self.options), overwrite)
