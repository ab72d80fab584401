"""Files written from tables: names by rule, and a sink that puts files in place only when all tasks are done."""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from rasterloom.functions.errors import ImageError

# Extensions by format.
EXTENSIONS = {"jpeg": "jpg"}


def output_name(verb: str, path: Column, format: Column) -> Column:
    """The name of a result: picture.png becomes picture.scrambled.png, back picture.png, picture.restored.png
    if it was not named so, or picture.rekeyed.png."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    extension = F.coalesce(*(F.when(format == k, F.lit(v)) for k, v in EXTENSIONS.items()), format)
    plain = F.regexp_replace(stem, r"\.scrambled$", "")
    new = {
        "encode": F.concat(stem, F.lit(".scrambled.")),
        "rekey": F.concat(stem, F.lit(".rekeyed.")),
        "decode": F.when(stem.endswith(".scrambled"), F.concat(F.when(plain == "", stem).otherwise(plain), F.lit("."))).otherwise(F.concat(stem, F.lit(".restored."))),
    }
    if verb not in new:
        raise ImageError("BAD_OPTION", f"verb has to be one of {', '.join(new)}")
    return F.concat(new[verb], extension)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Each task writes to a hidden folder of the write; commit moves files to their names, abort removes the folder."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.hidden = f"_writing-{uuid.uuid4().hex}"

    def place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else "file://" + os.path.abspath(self.folder.removeprefix("file:")))

    def write(self, iterator) -> Written:
        store, root = self.place()
        names = []
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name in (".", "..") or name.startswith("_"):
                raise ValueError(f"no name of a file: {name!r}")
            own = posixpath.join(root, self.hidden, uuid.uuid4().hex)
            store.create_dir(own, recursive=True)
            with store.open_output_stream(posixpath.join(own, name)) as out:
                out.write(row["content"])
            names.append(posixpath.join(posixpath.basename(own), name))
        return Written(names)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = self.place()
        written = [n for m in messages if m is not None for n in m.names]
        finals = [posixpath.basename(n) for n in written]
        twice = sorted({n for n in finals if finals.count(n) > 1}) if len(set(finals)) < len(finals) else []
        there = [] if self.overwrite else [n for n in finals if store.get_file_info(posixpath.join(root, n)).type != fs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise FileExistsError(f"names that are there already: {', '.join([*twice, *there][:8])}")
        store.create_dir(root, recursive=True)
        for part, name in zip(written, finals):
            store.move(posixpath.join(root, self.hidden, part), posixpath.join(root, name))
        self.clear(store, root)

    def abort(self, messages) -> None:
        self.clear(*self.place())

    def clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(posixpath.join(root, self.hidden)).type != fs.FileType.NotFound:
            store.delete_dir(posixpath.join(root, self.hidden))


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterloom_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes each row of files (name, content) as a file of a folder that all executors see. Rows of null
    content are left out; two rows of one name, or a name that is there, fail the write without a trace."""
    files.sparkSession.dataSource.register(FilesSink)
    rows = files.where("content is not null").select("name", "content")
    rows.write.format("rasterloom_files").mode("overwrite" if overwrite else "append").save(folder)


def put_text(path: str, text: str, create: bool = False) -> None:
    """Writes a file of the driver so that no reader ever sees half of it; with create, it must not be there."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(text)
    try:
        if create:
            try:
                os.link(beside, path)
            except FileExistsError as e:
                raise ImageError("EXISTS", f"{path} is there already") from e
        else:
            os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)


def key_file(data: bytes) -> bytes:
    """A key file's bytes without a byte order mark at the begin and one line end at the end."""
    data = re.sub(rb"\r?\n\Z", b"", data.removeprefix(b"\xef\xbb\xbf"))
    if not data:
        raise ImageError("BAD_OPTION", "the key file is empty")
    return data


def from_stdin(spark: SparkSession, data: bytes) -> DataFrame:
    """One file that was piped in, as a table like that of a folder."""
    return spark.createDataFrame([("stdin", len(data), data)], "path string, length bigint, content binary")
