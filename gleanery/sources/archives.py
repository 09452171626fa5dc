"""Zip archives of CSV rosters as a data source: a partition a member, rows as the member is unpacked.

    archives.read(spark, folder, {"tbpe_firms": "Firms.csv"}).where("recipe = 'tbpe_firms'")

An archive lies at <folder>/<recipe>/<name>.zip. Of each one member is read: the one its recipe names, or,
if that isn't in it, the first whose name ends in .csv; with every=True all of these. Conditions on recipe,
archive and member are pushed to the source: archives of other recipes are not even opened, and
members that nobody wants get no partition. A member is read as a stream, so it may be larger than memory.

An archive without such a member, and what isn't a zip archive, gives one row with nothing but a reason.
Files are opened through Arrow's file systems, in the driver for their tables of contents and in the tasks.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "recipe string, archive string, member string, ord bigint, fields map<string,string>, reason string"
_ARROW = pa.schema([("recipe", pa.string()), ("archive", pa.string()), ("member", pa.string()), ("ord", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])
#: Rows of a batch, and characters of a field that are accepted.
ROWS, FIELD = 2000, 1 << 27


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI lies in, and its path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Member(InputPartition):
    recipe: str
    archive: str
    member: str | None
    reason: str | None = None


class Reader(DataSourceReader):
    def __init__(self, folder: str, wanted: dict[str, str], every: bool):
        self.folder, self.wanted, self.every, self.only = folder, wanted, every, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("recipe", "archive", "member"):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.only[f.attribute[0]] = self.only.get(f.attribute[0], values) & values
            else:
                yield f

    def _fits(self, column: str, value: str | None) -> bool:
        return column not in self.only or value in self.only[column]

    def partitions(self) -> list[Member]:
        system, folder = opened(self.folder)
        out = []
        for info in sorted(system.get_file_info(fs.FileSelector(folder, recursive=True)), key=lambda i: i.path):
            recipe = info.path.rsplit("/", 2)[-2]
            if info.type != fs.FileType.File or not info.base_name.lower().endswith(".zip") or not self._fits("recipe", recipe) or not self._fits("archive", info.base_name):
                continue
            try:
                with system.open_input_file(info.path) as file, zipfile.ZipFile(file) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                    named = self.wanted.get(recipe)
                    chosen = names if self.every else [named] if named in archive.namelist() else names[:1]
            except (zipfile.BadZipFile, OSError) as error:
                chosen, names = [], [type(error).__name__]
                out += [Member(recipe, info.path, None, "not_an_archive")] if self._fits("member", None) else []
                continue
            if chosen:
                out += [Member(recipe, info.path, n) for n in chosen if self._fits("member", n)]
            elif self._fits("member", None):
                out.append(Member(recipe, info.path, None, "no_csv_in_archive"))
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        name = partition.archive.rsplit("/", 1)[-1]

        def batch(rows: list[dict], first: int, reason: str | None = None) -> pa.RecordBatch:
            n = len(rows)
            columns = [[partition.recipe] * n, [name] * n, [partition.member] * n, [None if reason else first + i for i in range(n)], [None if reason else list(r.items()) for r in rows], [reason] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        if partition.reason:
            yield batch([{}], 0, partition.reason)
            return
        system, _ = opened(self.folder)
        with system.open_input_file(partition.archive) as file, zipfile.ZipFile(file) as archive, archive.open(partition.member) as raw:
            held, first = [], 0
            for row in records(io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="")):
                held.append(row)
                if len(held) == ROWS:
                    yield batch(held, first)
                    held, first = [], first + ROWS
            if held:
                yield batch(held, first)


def records(text: io.TextIOBase) -> Iterator[dict[str, str]]:
    """Rows of a CSV text by the names in its header, in lower case; missing fields are empty, surplus ones and empty rows go."""
    csv.field_size_limit(FIELD)
    rows = csv.reader(text)
    names = [n.strip().lstrip("﻿").lower() for n in next(rows, [])]
    for row in rows:
        if row:
            yield {**dict.fromkeys(names, ""), **dict(zip(names, row, strict=False))}


class Archives(DataSource):
    """Options: path, members (a JSON object of recipe to member), every."""

    @classmethod
    def name(cls) -> str:
        return "roster_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], json.loads(self.options.get("members", "{}")), self.options.get("every", "false") == "true")


def read(spark: SparkSession, folder: str, members: dict[str, str] | None = None, every: bool = False) -> DataFrame:
    """Rows of the archives under a folder. Turns the session's push-down to Python sources on, which is off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Archives)
    return spark.read.format(Archives.name()).option("path", folder).option("members", json.dumps(members or {})).option("every", str(every).lower()).load()


def write(archives: DataFrame, folder: str) -> int:
    """Write a zip archive for each row (recipe, archive, members: map of name to text); how many there are."""

    def run(batches):
        system, root = opened(folder)
        for batch in batches:
            n = 0
            for recipe, name, members in zip(*(batch.column(c).to_pylist() for c in ("recipe", "archive", "members")), strict=True):
                system.create_dir(f"{root}/{recipe}", recursive=True)
                # A lost task writes its archives again, to the same names.
                with system.open_output_stream(f"{root}/{recipe}/{name}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as out:
                    for member, text in members:
                        out.writestr(zipfile.ZipInfo(member), text, zipfile.ZIP_DEFLATED)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    found = archives.select("recipe", "archive", "members").mapInArrow(run, "n long")
    return found.agg({"n": "sum"}).first()[0] or 0
