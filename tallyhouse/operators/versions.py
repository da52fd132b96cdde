"""A dataset of several tables that changes as a whole or not at all.

    root/data/<table>/<token>/part files     rows of one load, never changed again
    root/versions/<number>.json              {"tables": {table: [token, ...]}, "order": [table, ...]}

A load writes the missing rows of every table under new tokens first; the dataset changes by the one rename
that puts the next version file in place. Readers resolve the greatest version (or a named one) to its folders, so
a job that dies between two tables leaves the version before it in force, and a reader never sees half a load. The
rename fails if that number exists already: of two loads at a time one wins, the other raises and can be repeated.
Folders that no version names are removed by `remove_orphans`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.blocks import stack
from tallyhouse.operators.lifecycle import _same_key, ambiguous_match_keys, conflicts, new_rows, unload, verify
from tallyhouse.schemas import SCHEMAS

TablesMap = Mapping[str, DataFrame]
Match = Mapping[str, Sequence[str]]


class LaterVersion(RuntimeError):
    """Somebody else has committed the next version first."""


class Store:
    """The versions under one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._java = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(self._conf)

    def _path(self, below: str):
        return self._java.Path(f"{self.root}/{below}" if below else self.root)

    def _names(self, below: str) -> list[str]:
        folder = self._path(below)
        return sorted(f.getPath().getName() for f in self._files.listStatus(folder)) if self._files.exists(folder) else []

    def versions(self) -> list[int]:
        return [int(name[:-5]) for name in self._names("versions") if name[:1].isdigit() and name.endswith(".json")]

    def _content(self, version: int | None) -> tuple[int, dict]:
        """A version's number and content; 0 and nothing before the first load."""
        known = self.versions()
        if version is None:
            version = max(known, default=0)
        if version == 0:
            return 0, {"tables": {}, "order": []}
        if version not in known:
            raise ValueError(f"no version {version}")
        stream = self._files.open(self._path(f"versions/{version:09d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def read(self, like: TablesMap | None = None, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version; those without rows take their schema from `like`, else from the model."""
        _, content = self._content(version)
        return {name: self._table(name, tokens, like[name].schema if like else SCHEMAS[name])
                for name, tokens in content["tables"].items()}

    def _table(self, name: str, tokens: Sequence[str], schema) -> DataFrame:
        if not tokens:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{name}/{token}" for token in tokens])

    def _commit(self, number: int, content: dict) -> int:
        draft, final = self._path(f"versions/.{uuid4().hex}"), self._path(f"versions/{number:09d}.json")
        stream = self._files.create(draft, False)
        try:
            stream.write(json.dumps(content, sort_keys=True).encode())
        finally:
            stream.close()
        none = self._java.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self._java.Options.Rename, 1)
        options[0] = none
        try:
            self._java.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)
        except Exception as error:  # noqa: BLE001 - whatever the file system says, the version is there or not
            self._files.delete(draft, False)
            if number in self.versions():
                raise LaterVersion(f"version {number} was committed by another job") from error
            raise
        return number

    def _write(self, name: str, rows: DataFrame) -> str:
        token = uuid4().hex
        rows.write.parquet(f"{self.root}/data/{name}/{token}")
        return token

    def load(self, source: TablesMap, match: Match, order: Sequence[str],
             between: Callable[[str], None] = lambda table: None) -> int:
        """Adds the missing rows of all tables and returns the version in force; loading again changes nothing.

        Every check is made before anything is written: match keys unique in the source and where stored,
        and stored rows equal to the source's. `between` is called behind each written table.
        """
        number, content = self._content(None)
        stored = {name: self._table(name, content["tables"].get(name, []), source[name].schema) for name in order}
        for name in order:
            keys = list(match[name])
            if not ambiguous_match_keys(source[name], keys).isEmpty():
                raise ValueError(f"{name}: a match key is not unique in the source")
            wanted = source[name].select(*[F.col(c).alias(f"_{c}") for c in keys])
            if not ambiguous_match_keys(stored[name].join(wanted, _same_key(keys), "left_semi"), keys).isEmpty():
                raise ValueError(f"{name}: a match key is stored more than once")
            if not conflicts(source[name], stored[name], keys).isEmpty():
                raise ValueError(f"{name}: a stored row differs from the source")
        tables, changed = dict(content["tables"]), False
        for name in order:
            missing = new_rows(source[name], stored[name], list(match[name])) if tables.get(name) else source[name]
            tables.setdefault(name, [])
            if not missing.isEmpty():
                tables[name] = [*tables[name], self._write(name, missing)]
                changed = True
            between(name)
        if not changed and set(order) <= set(content["tables"]):
            return number
        return self._commit(number + 1, {"tables": tables, "order": list(dict.fromkeys([*content["order"], *order]))})

    def unload(self, source: TablesMap, match: Match, order: Sequence[str], strict: bool = True) -> int:
        """Takes the owned rows out of all tables, last table first, in one version.

        Unless `strict` is off, an owned row that is missing or changed fails the job before anything is written.
        """
        number, content = self._content(None)
        stored = {name: self._table(name, content["tables"].get(name, []), source[name].schema) for name in reversed(order)}
        for name, kept in stored.items():
            if strict and not verify(source[name], kept, list(match[name])).filter("problem <> 'excess'").isEmpty():
                raise ValueError(f"{name}: an owned row is missing or changed")
        tables = dict(content["tables"])
        for name, kept in stored.items():
            left = unload(source[name], kept, list(match[name]))
            tables[name] = [] if left.isEmpty() else [self._write(name, left)]
        return self._commit(number + 1, {"tables": tables, "order": content["order"]})

    def verify(self, source: TablesMap, match: Match, order: Sequence[str], version: int | None = None) -> DataFrame:
        """(table_name, problem, row_count) over all tables of a version; empty if it equals the source."""
        found = self._content(version)[1]["tables"]
        parts = [
            verify(source[name], self._table(name, found.get(name, []), source[name].schema), list(match[name]))
            .select(F.lit(name).alias("table_name"), "problem") for name in order
        ]
        return stack(*parts).groupBy("table_name", "problem").agg(F.count(F.lit(1)).alias("row_count"))

    def remove_orphans(self, keep: Sequence[int] | None = None) -> list[str]:
        """Deletes the folders that no kept version names (default: all versions) and returns them.

        Not to be run beside a load, whose folders no version names yet.
        """
        kept = self.versions() if keep is None else keep
        named = {(name, token) for version in kept for name, tokens in self._content(version)[1]["tables"].items() for token in tokens}
        gone = []
        for name in self._names("data"):
            for token in self._names(f"data/{name}"):
                if (name, token) not in named:
                    self._files.delete(self._path(f"data/{name}/{token}"), True)
                    gone.append(f"{name}/{token}")
        for version in set(self.versions()) - set(kept):
            self._files.delete(self._path(f"versions/{version:09d}.json"), False)
        return gone
