"""Landing folders of collector runs as a data source, for batch and streams.

``spark.read.format("newsloom_landing").load(root)`` lists ``*.json`` below ``root`` (names with "seen" left out), gives
every row its outlet folder and file, and reads JSON arrays, single objects and JSON lines; every file is a partition
of its own.  Options:

* ``latest`` = ``true``: of each outlet folder only its newest run (the ``run_ts=`` folder of largest name, else the
  newest file);
* ``require`` = ``full_text,summary``: a record is admitted if one of the keys is present (an explicit null counts).

What can't be read is not lost: it is a row with the file, the reason in ``problem`` and the piece of text in
``rejected``; all other fields are null.  :func:`admitted` and :func:`quarantined` tell the two apart.

As a stream, the offset is the newest modification time read so far with the files that share it, so every file is
read once, a batch can be replayed from its two offsets, and files that arrive later in the same instant are not
missed.  Folders are reached through ``pyarrow.fs`` (local paths and the schemes it knows).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from newsloom.sources.files import RAW_ARTICLE_FIELDS

NAME = "newsloom_landing"
REJECTED_CHARS = 2_000   # of a record that can't be read, kept in its quarantine row
_RUN = re.compile(r"/?run_ts=([^/]+)$")


class LandedFile(InputPartition):
    def __init__(self, path: str, folder: str, run: str, modified: int) -> None:
        self.path, self.folder, self.run, self.modified = path, folder, run, modified


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def list_landed(root: str) -> list[LandedFile]:
    """A1, A2: the JSON files below a folder, in the order of their arrival."""
    from pyarrow import fs

    system, base = _open(root)
    found = []
    for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        name = info.base_name.lower()
        inside = info.path[len(base):].strip("/")
        hidden = any(part.startswith(("_", ".")) for part in inside.split("/"))
        if info.type == fs.FileType.File and name.endswith(".json") and "seen" not in name and not hidden:
            folder = inside.rpartition("/")[0]
            run = _RUN.search(folder)
            found.append(LandedFile(info.path, _RUN.sub("", folder), run[1] if run else "", info.mtime_ns or 0))
    return sorted(found, key=lambda f: (f.modified, f.path))


def latest_runs(found: list[LandedFile]) -> list[LandedFile]:
    """A3: the files of each folder's newest run; of a folder without runs its newest file."""
    newest: dict[str, LandedFile] = {}
    for f in found:
        have = newest.get(f.folder)
        if have is None or (f.run, f.modified, f.path) > (have.run, have.modified, have.path):
            newest[f.folder] = f
    return [f for f in found if f.run == newest[f.folder].run and (f.run or f.path == newest[f.folder].path)]


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def parse_records(data: bytes) -> Iterator[tuple[dict | None, str | None, str | None]]:
    """A5: ``(record, problem, rejected)`` for an array, an object or JSON lines."""
    try:
        body = data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        yield None, f"not UTF-8: {e.reason}", data[:REJECTED_CHARS].decode("utf-8", "replace")
        return
    if not body.strip():
        return
    try:
        whole = json.loads(body)
        items = whole if isinstance(whole, list) else [whole]
    except ValueError as whole_problem:
        lines = [line for line in body.splitlines() if line.strip()]
        items = []
        if len(lines) == 1 or body.lstrip().startswith("["):   # a cut-off or broken file
            yield None, f"not JSON: {whole_problem}", body[:REJECTED_CHARS]
            return
        for line in lines:
            try:
                items.append(json.loads(line))
            except ValueError as e:
                yield None, f"not JSON: {e}", line[:REJECTED_CHARS]
    for item in items:
        if isinstance(item, dict):
            yield item, None, None
        else:
            yield None, "not an object", (_text(item) or "null")[:REJECTED_CHARS]


class _Reading:
    """What batch and stream share: options, and the rows of one file."""

    def __init__(self, schema, options: dict) -> None:
        self.root = options.get("path") or ""
        if not self.root:
            raise ValueError("the landing source needs a path")
        self.latest = options.get("latest", "false").lower() == "true"
        self.require = [k.strip() for k in options.get("require", "").split(",") if k.strip()]
        self.fields = [f.name for f in schema.fields]

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        system, _ = _open(self.root)
        about = {"source_folder": partition.folder, "source_file": partition.path}
        with system.open_input_stream(partition.path) as f:
            data = f.read()
        for n, (record, problem, rejected) in enumerate(parse_records(data)):
            if record is not None and self.require and not any(k in record for k in self.require):
                continue
            values = {k: _text(v) for k, v in (record or {}).items()}
            values.update(about, source_pos=n, problem=problem, rejected=rejected)
            yield tuple(values.get(name) for name in self.fields)


class LandingReader(_Reading, DataSourceReader):
    def partitions(self) -> list[LandedFile]:
        found = list_landed(self.root)
        # A source needs a partition: an empty folder has one without a file.
        return (latest_runs(found) if self.latest else found) or [LandedFile("", "", "", 0)]

    def read(self, partition: LandedFile) -> Iterator[tuple]:
        return super().read(partition) if partition.path else iter(())


class LandingStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": -1, "at": []}

    def latestOffset(self) -> dict:
        found = list_landed(self.root)
        if not found:
            return self.initialOffset()
        until = found[-1].modified
        return {"until": until, "at": [f.path for f in found if f.modified == until]}

    def partitions(self, start: dict, end: dict) -> list[LandedFile]:
        def known(f: LandedFile, offset: dict) -> bool:
            return f.modified < offset["until"] or (f.modified == offset["until"] and f.path in offset["at"])

        return [f for f in list_landed(self.root) if known(f, end) and not known(f, start)]

    def commit(self, end: dict) -> None:
        pass


class LandingDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        record = ", ".join(f"{f} string" for f in RAW_ARTICLE_FIELDS)
        return f"{record}, source_folder string, source_file string, source_pos int, problem string, rejected string"

    def reader(self, schema) -> LandingReader:
        return LandingReader(schema, self.options)

    def streamReader(self, schema) -> LandingStreamReader:
        return LandingStreamReader(schema, self.options)


def register_source(spark: SparkSession) -> None:
    """Make the format known to a session (again is harmless)."""
    spark.dataSource.register(LandingDataSource)


def read_landed(spark: SparkSession, root: str, latest: bool = False, require: tuple[str, ...] = ()) -> DataFrame:
    register_source(spark)
    return spark.read.format(NAME).option("latest", str(latest).lower()).option("require", ",".join(require)).load(root)


def stream_landed(spark: SparkSession, root: str, require: tuple[str, ...] = ()) -> DataFrame:
    register_source(spark)
    return spark.readStream.format(NAME).option("require", ",".join(require)).load(root)


def admitted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("problem").isNull()).drop("problem", "rejected")


def quarantined(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("problem").isNotNull()).select("source_folder", "source_file", "source_pos", "problem", "rejected")
