"""A folder of notes as a data source: `spark.read.format("note_folder").load(folder)`.

The driver lists the folder, without the folders that hold no notes or, by the filters that Spark pushes down, not the kinds or
paths asked for, and plans partitions of files by their bytes. Tasks open their own files on any store that pyarrow reaches. A
file that can't be read as a note is a row with `error`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from lodestone.session import ship_package
from lodestone.sources.files import KIND_FOLDERS, LISTS, SCALARS, SKIPPED, checked_notes
from lodestone.sources.front_matter import parse

FORMAT = "note_folder"
#: Bytes of files, with a part for opening each, that one partition holds.
PARTITION_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
_FENCE = re.compile(r"^---[ \t]*\n(.*?\n)?---[ \t]*(?:\n|$)", re.DOTALL)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(paths)
        self.paths = paths


def split_note(text: str) -> tuple[str | None, str, str | None]:
    """Front matter as JSON, body, and why there is none."""
    text = re.sub(r"\r\n?", "\n", text)
    m = _FENCE.match(text)
    if not m:
        return None, text.strip(), "no front matter"
    try:
        return json.dumps(parse(m[1] or ""), ensure_ascii=False), text[m.end() :].strip(), None
    except ValueError as e:
        return None, text[m.end() :].strip(), f"front matter: {e}"


class NoteFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, kind_folder string, front string, body string, error string"

    def reader(self, schema: StructType) -> NoteReader:
        return NoteReader(self.options["path"], tuple(x for x in self.options.get("skipped", "").split(",") if x), int(self.options.get("partitionBytes", PARTITION_BYTES)))


class NoteReader(DataSourceReader):
    def __init__(self, folder: str, skipped: tuple[str, ...], partition_bytes: int) -> None:
        self.folder, self.skipped, self.partition_bytes = folder, {*SKIPPED, *skipped}, partition_bytes
        self.kinds: set[str] = set(KIND_FOLDERS.values())
        self.paths: set[str] | None = None
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters that name kinds' folders or paths, and gives the others back."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("kind_folder",):
                self.kinds &= values
            elif values is not None and f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            else:
                yield f

    def _store(self):
        from pyarrow import fs

        if "://" not in self.folder and not self.folder.startswith("file:"):
            return fs.LocalFileSystem(), self.folder.rstrip("/")
        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", self.folder))
        return store, root.rstrip("/")

    def _found(self) -> Iterator[tuple[str, int]]:
        """Paths of notes below the folder and their bytes; folders of other kinds aren't opened."""
        from pyarrow import fs

        store, root = self._store()
        if self.paths is not None:
            # a path that leads out of the folder, or isn't a note's, has none
            wanted = [p for p in self.paths if not p.startswith("/") and ".." not in p.split("/") and self._is_note(p)]
            yield from ((p, info.size) for p, info in zip(wanted, store.get_file_info([f"{root}/{p}" for p in wanted]) if wanted else [], strict=True) if info.type == fs.FileType.File)
            return
        todo = [""]
        while todo:
            at = todo.pop()
            self.listed.append(at)
            for info in sorted(store.get_file_info(fs.FileSelector(f"{root}/{at}".rstrip("/"))), key=lambda i: i.path):
                path = f"{at}/{info.base_name}".lstrip("/")
                if info.type == fs.FileType.Directory:
                    if info.base_name not in self.skipped and (info.base_name in self.kinds or info.base_name not in KIND_FOLDERS.values()):
                        todo.append(path)
                elif self._is_note(path):
                    yield path, info.size

    def _is_note(self, path: str) -> bool:
        parts = path.split("/")
        return len(parts) > 1 and parts[-2] in self.kinds and parts[-1].endswith(".md") and parts[-1] != "INDEX.md" and not self.skipped.intersection(parts[:-1])

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for path, n in self._found():
            if held and size + n + OPEN_BYTES > self.partition_bytes:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n + OPEN_BYTES
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, root = self._store()
        for path in partition.paths:
            kind = path.split("/")[-2]
            try:
                with store.open_input_stream(f"{root}/{path}") as f:
                    front, body, error = split_note(f.read().decode("utf-8"))
            except (OSError, UnicodeDecodeError) as e:
                front, body, error = None, "", f"not read: {type(e).__name__}"
            yield path, kind, front, body, error


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark push filters down to it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NoteFolder)


def read_note_folder(spark: SparkSession, folder: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """Wide rows of the notes below `folder`, as `parse_notes` gives them, with `kind_folder`. Filters on that and on `path` reach the listing."""
    register(spark)
    rows = spark.read.format(FORMAT).option("skipped", ",".join(skipped)).load(folder)
    front = F.try_parse_json("front")
    text = lambda k: F.try_variant_get(front, f"$['{k}']", "string").alias(k)
    many = lambda k: F.coalesce(F.filter(F.try_variant_get(front, f"$['{k}']", "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>")).alias(k)
    known = [*SCALARS, *LISTS, "graduate"]
    others = F.map_filter(F.from_json("front", "map<string,string>"), lambda k, _: ~k.isin(*known))
    wide = rows.select("path", "kind_folder", "body", *map(text, SCALARS), *map(many, LISTS), (text("graduate") == "true").alias("graduate"), F.coalesce(others, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("extra"), F.col("error").alias("unread"))
    return checked_notes(wide, F.col("unread")).drop("unread")
