"""Folders of metadata profiles and watermarks: JSON files by id, read and written on the driver."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

from rasterloom.functions.errors import ImageError
from rasterloom.metadata.policy import PRESETS, PROFILE_ID, profile, profile_text
from rasterloom.sources.sink import put_text
from rasterloom.watermark.definition import ASSET, FONT, ID, compiled, definition_text, json_text, normal_definition


class Store:
    """A folder of files id.json in a normal form."""

    def __init__(self, folder: str, pattern: str, what: str, code: str, normal, text):
        self.folder, self.pattern, self.what, self.code, self.normal, self.text = folder, pattern, what, code, normal, text

    def path(self, name: str) -> str:
        if not isinstance(name, str) or not re.fullmatch(self.pattern, name):
            raise ImageError(self.code, f"no {self.what} id: {name!r}")
        return os.path.join(self.folder, f"{name}.json")

    def exists(self, name: str) -> bool:
        return os.path.exists(self.path(name))

    def get(self, name: str) -> dict:
        if not self.exists(name):
            raise ImageError("NOT_FOUND", f"{self.what} {name!r} is not found")
        with open(self.path(name), encoding="utf-8") as f:
            try:
                found = self.normal(json.load(f))
            except ValueError as e:
                raise e if isinstance(e, ImageError) else ImageError(self.code, f"{self.what} {name!r} is no JSON") from e
        if found["id"] != name:
            raise ImageError(self.code, f"the file of {self.what} {name!r} holds {found['id']!r}")
        return found

    def ids(self) -> list[str]:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return sorted(n[:-5] for n in names if n.endswith(".json") and re.fullmatch(self.pattern, n[:-5]))

    def list(self) -> list[dict]:
        """All that can be read, by id."""
        out = []
        for name in self.ids():
            try:
                out.append(self.get(name))
            except ImageError:
                continue
        return out

    def save(self, value: dict, create: bool = False) -> dict:
        found = self.normal(value)
        os.makedirs(self.folder, exist_ok=True)
        put_text(self.path(found["id"]), self.text(found), create)
        return found

    def remove(self, name: str) -> None:
        if not self.exists(name):
            raise ImageError("NOT_FOUND", f"{self.what} {name!r} is not found")
        os.remove(self.path(name))

    def table(self, spark: SparkSession) -> DataFrame:
        """id and JSON, a row each, to be joined to tables that name ids."""
        return spark.createDataFrame([(v["id"], json.dumps(v, ensure_ascii=False)) for v in self.list()], "id string, definition string")


def profiles(folder: str) -> Store:
    return Store(folder, PROFILE_ID, "metadata profile", "BAD_METADATA", profile, profile_text)


def definitions(folder: str) -> Store:
    return Store(folder, ID, "watermark", "BAD_WATERMARK", normal_definition, definition_text)


def compiled_watermarks(folder: str) -> Store:
    """Watermarks as they are drawn; text is compiled elsewhere, as there are no fonts here."""
    return Store(os.path.join(folder, "compiled"), ID, "watermark", "BAD_WATERMARK", compiled, lambda v: json_text(v) + "\n")


def names_of(folder: str, pattern: str = ASSET) -> list[str]:
    """Names of assets, or of fonts with the pattern FONT (without their extensions)."""
    found = os.listdir(folder) if os.path.isdir(folder) else []
    return sorted({n if pattern != FONT else n.rsplit(".", 1)[0] for n in found if re.fullmatch(pattern, n if pattern != FONT else n.rsplit(".", 1)[0])})


def read_json(path: str, code: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError as e:
        raise ImageError(code, f"{path}: no such file") from e
    except ValueError as e:
        raise ImageError(code, f"{path}: no JSON") from e


def is_path(reference: str) -> bool:
    return bool(re.search(r"[/\\]|\.json$", reference))


def load_policy(reference: str, folder: str) -> str | dict:
    """A policy by the path of a file, a preset's name, or a profile's id."""
    if is_path(reference):
        return read_json(reference, "BAD_METADATA")
    return reference if reference in PRESETS else profiles(folder).get(reference)


def load_watermark(reference: str, folder: str) -> dict:
    """A compiled watermark by the path of a file or by id."""
    return compiled(read_json(reference, "BAD_WATERMARK")) if is_path(reference) else compiled_watermarks(folder).get(reference)
