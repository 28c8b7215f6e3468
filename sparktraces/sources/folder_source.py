"""Folders of trace files as a data source: ``spark.read.format("trace_folders")``.

Experiments are the sub-folders of ``path``, and each is ``slices`` partitions, so the driver lists folders and the tasks list the
files of theirs: what the folder holds is dealt to its slices by name. A task reads a file once: comment lines, the header, and of the rows only the
cells that are asked for.

Options: ``path``; ``columns``, a comma list of cells (``Target=first name|second name`` takes the first of several that the file
has); ``pattern``, a regular expression that file names must match (``.csv`` files by default); ``comment`` (``#``);
``report=true`` gives the files that hold no trace instead of rows; ``slices`` (1), the tasks that share an experiment folder.

Rows: experiment, path, file_name, trap_id, line, then the cells as text, empty ones NULL. Report: experiment, path, reason.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PLACE = "experiment string, path string, file_name string, trap_id int, line long"
REPORT = "experiment string, path string, reason string"
TRAP = re.compile(r"trap_(\d+)", re.IGNORECASE)
BLOCK_BYTES = 1 << 22


class Folder(InputPartition):
    def __init__(self, name: str, path: str, slice: int = 0) -> None:
        super().__init__(name)
        self.name, self.path, self.slice = name, path, slice


def targets(option: str) -> dict[str, list[str]]:
    """Target column -> names of the file's columns that may hold it."""
    out = {}
    for part in filter(None, (p.strip() for p in option.split(","))):
        target, _, names = part.partition("=")
        out[target] = names.split("|") if names else [target]
    return out


class FolderReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.root = options["path"]
        self.columns = targets(options.get("columns", ""))
        self.pattern = options.get("pattern", r"\.csv$")
        self.comment = options.get("comment", "#")
        self.report = options.get("report", "false").lower() == "true"
        self.slices = int(options.get("slices", "1"))
        self.schema = schema

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(fs.FileSelector(root))
        folders = [f for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.Directory]
        return [Folder(f.base_name.removeprefix("experiment="), f.path, k) for f in folders for k in range(self.slices)]

    def _files(self, system: fs.FileSystem, partition: Folder) -> Iterator[fs.FileInfo]:
        """All files of the slice."""
        if self.slices == 1:
            yield from system.get_file_info(fs.FileSelector(partition.path, recursive=True))
            return
        for found in system.get_file_info(fs.FileSelector(partition.path)):
            if zlib.crc32(found.base_name.encode()) % self.slices == partition.slice:
                yield found
                if found.type == fs.FileType.Directory:
                    yield from system.get_file_info(fs.FileSelector(found.path, recursive=True))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        arrow = to_arrow_schema(self.schema)
        wanted = re.compile(self.pattern)
        files = [f for f in self._files(system, partition) if f.type == fs.FileType.File and wanted.search(f.base_name)]
        # natural order: by trap number, then by name
        for file in sorted(files, key=lambda f: (_trap(f, partition) or -1, f.path)):
            reason = None
            rows = 0
            opened = _opener(system, file)
            header, skipped = self._header(opened)
            if not header:
                reason = "empty"
            elif any(not set(names) & set(header) for names in self.columns.values()):
                reason = "missing columns"
            # a file of another layout is no trace: it is in the report and not among the rows
            if reason is None:
                for batch in self._rows(opened, file, header, skipped, partition, arrow if not self.report else None):
                    rows += batch.num_rows
                    if self.report:
                        break
                    yield batch
            if self.report and (reason or not rows):
                yield pa.RecordBatch.from_pydict({"experiment": [partition.name], "path": [file.path], "reason": [reason or "no rows"]}, schema=arrow)

    def _header(self, opened: Callable[[], pa.NativeFile]) -> tuple[list[str], int]:
        """Names of the columns, and the number of lines before the first row."""
        with opened() as stream:
            lines = 0
            rest = b""
            while block := stream.read(1 << 16):
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    lines += 1
                    if (text := line.decode("utf-8-sig").strip()) and not text.startswith(self.comment):
                        return [n.strip().strip('"') for n in text.split(",")], lines
            text = rest.decode("utf-8-sig").strip()
            return ([n.strip().strip('"') for n in text.split(",")], lines + 1) if text and not text.startswith(self.comment) else ([], lines)

    def _rows(self, opened: Callable[[], pa.NativeFile], file: fs.FileInfo, header: list[str], skipped: int, partition: Folder, arrow: pa.Schema | None) -> Iterator[pa.RecordBatch]:
        names = [f"{i}:{n}" for i, n in enumerate(header)]
        place = {n: names[i] for i, n in reversed(list(enumerate(header)))}
        picked = {target: next((place[n] for n in choice if n in place), None) for target, choice in self.columns.items()}
        include = list(dict.fromkeys([names[0], *filter(None, picked.values())]))
        with opened() as stream:
            try:
                reader = csv.open_csv(
                    stream,
                    read_options=csv.ReadOptions(column_names=names, skip_rows=skipped, block_size=BLOCK_BYTES),
                    parse_options=csv.ParseOptions(invalid_row_handler=lambda row: "skip"),
                    convert_options=csv.ConvertOptions(column_types={n: pa.string() for n in names}, include_columns=include, strings_can_be_null=True, null_values=[""]),
                )
            except pa.ArrowInvalid:
                # no row behind the header
                return
            line = 0
            for batch in reader:
                numbers = pa.array(range(line, line + batch.num_rows), pa.int64())
                line += batch.num_rows
                first = batch.column(names[0])
                keep = pa.compute.invert(pa.compute.fill_null(pa.compute.starts_with(first, self.comment), False))
                batch = batch.append_column("line", numbers).filter(keep)
                if arrow is None:
                    yield batch
                    continue
                n = batch.num_rows
                cells = {t: batch.column(c) if c else pa.nulls(n, pa.string()) for t, c in picked.items()}
                head = {"experiment": [partition.name] * n, "path": [file.path] * n, "file_name": [file.base_name] * n, "trap_id": [_trap(file, partition)] * n}
                yield pa.RecordBatch.from_pydict({**head, "line": batch.column("line"), **cells}, schema=arrow)


def _opener(system: fs.FileSystem, file: fs.FileInfo) -> Callable[[], pa.NativeFile]:
    """Opens the file for the header and for the rows; a small one is fetched once."""
    if file.size is None or file.size > BLOCK_BYTES:
        return lambda: system.open_input_stream(file.path)
    with system.open_input_stream(file.path) as stream:
        whole = pa.py_buffer(stream.read())
    return lambda: pa.BufferReader(whole)


def _trap(file: fs.FileInfo, folder: Folder) -> int | None:
    """The number after trap_ in the name of the file, or of a folder between it and the experiment."""
    found = TRAP.findall(file.path[len(folder.path):])
    return int(found[-1]) if found else None


class TraceFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace_folders"

    def schema(self) -> str:
        if self.options.get("report", "false").lower() == "true":
            return REPORT
        return ", ".join([PLACE, *(f"`{t}` string" for t in targets(self.options.get("columns", "")))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(schema, dict(self.options))


def write_files(df: DataFrame, root: str, folders: Sequence[str]) -> int:
    """Writes one CSV file with a header for each value of ``folders``, in nested folders name=value, and gives their number.

    The tasks write in Python, for making a folder and a file through Hadoop's local file system starts a process each time. A file
    gets its name when it is whole, so a task that runs again replaces its files.
    """
    folders = list(folders)
    cells = [c for c in df.columns if c not in folders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(root)
        key, writer, stream, place, written = None, None, None, "", 0

        def close() -> None:
            if writer is not None:
                writer.close()
                stream.close()
                system.move(f"{place}/{attempt}", f"{place}/rows.csv")

        attempt = f"rows.{uuid.uuid4().hex}"
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in folders)))
            starts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)]):
                rows = batch.slice(start, end - start).select(cells)
                if writer is None or keys[start] != key:
                    close()
                    key = keys[start]
                    place = "/".join([top, *(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else quote(str(v), safe=' ')}" for c, v in zip(folders, key))])
                    system.create_dir(place, recursive=True)
                    stream = system.open_output_stream(f"{place}/{attempt}")
                    writer = csv.CSVWriter(stream, rows.schema)
                    written += 1
                writer.write_batch(rows)
        close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    # an explicit number is not merged into few tasks because the rows are few
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = df.repartition(parts, *folders).sortWithinPartitions(*folders).mapInArrow(run, "files long")
    return files.agg(F.sum("files")).first()[0] or 0


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(TraceFolders)
