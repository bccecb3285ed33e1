"""Tables in hash buckets under commits: a version is a small file that names the files of every bucket.

New files become part of the store when a commit names them, and the commit appears in one step. A
writer that is killed before leaves files that no commit names. A version replaces the buckets it touches, or adds
files to them, and takes over all others; older versions stay readable.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import atomic


class Buckets:
    """``schemas``: DDL of each table; ``keys``: the columns whose hash is a row's bucket; ``buckets``: how many a new store has."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], keys: dict[str, list[str]], buckets: int):
        self.spark, self.root, self.schemas, self.keys, self.buckets = spark, root.rstrip("/"), schemas, keys, buckets

    # Commits

    def _commit_path(self, version: int) -> str:
        return f"{self.root}/_commits/{version:020d}.json"

    def commit(self, version: int) -> dict | None:
        text = atomic.read_text(self.spark, self._commit_path(version))
        return None if text is None else json.loads(text)

    def version(self) -> int:
        """The last version that is committed, -1 before the first."""
        known = [n for n in atomic.names(self.spark, f"{self.root}/_commits") if n.endswith(".json") and not n.startswith(".")]
        return int(known[-1][:-5]) if known else -1

    def empty(self) -> dict:
        return {"version": -1, "buckets": self.buckets, "files": {name: {} for name in self.schemas}, "facts": {}}

    def at(self, version: int | None = None) -> dict:
        """The commit of a version, the last one if none is named; ValueError if it isn't committed."""
        version = self.version() if version is None else version
        if version < 0:
            return self.empty()
        if (commit := self.commit(version)) is None:
            raise ValueError(f"version {version} is not committed")
        return commit

    def base(self, version: int) -> dict:
        """The commit that ``version`` is built on: the last one, which has to be before it."""
        last = self.version()
        if last >= version:
            raise ValueError(f"version {version} is not after {last}")
        return self.at(last)

    # Rows

    def bucket(self, name: str, commit: dict) -> Column:
        return F.pmod(F.xxhash64(*self.keys[name]), F.lit(commit["buckets"])).cast("int")

    def touched(self, rows: DataFrame, name: str, commit: dict) -> list[int]:
        """The buckets of a table that the keys of ``rows`` fall into; at most as many numbers as there are buckets."""
        return [r[0] for r in rows.select(self.bucket(name, commit)).distinct().collect()]

    def files(self, commit: dict, name: str, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.root}/{p}" for b, of in commit["files"][name].items() if buckets is None or int(b) in buckets for p in of]

    def read(self, commit: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table at a commit, only of ``buckets`` if they are named."""
        paths = self.files(commit, name, buckets)
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def _write(self, rows: DataFrame, name: str, commit: dict, draft: str) -> dict[str, str]:
        where = f"{name}/{draft}"
        columns = [f.name for f in T.StructType.fromDDL(self.schemas[name])]
        # Ranges of buckets, keys and a hash of the rest: a task's share does not hang on the number of buckets or on a frequent key.
        rest = [c for c in columns if c not in self.keys[name]]
        marked = rows.select(*columns).withColumn("_bucket", self.bucket(name, commit)).withColumn("_tie", F.xxhash64(*rest))
        dealt = marked.repartitionByRange("_bucket", *self.keys[name], "_tie").drop("_tie").sortWithinPartitions("_bucket", *self.keys[name])
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{where}")
        return {n[8:]: f"{where}/{n}" for n in atomic.names(self.spark, f"{self.root}/{where}") if n.startswith("_bucket=")}

    def publish(self, version: int, base: dict, replace: dict[str, tuple[DataFrame, list[int]]], add: dict[str, DataFrame] | None = None, **facts) -> None:
        """Commit ``version``: tables whose rows in some buckets are now these (rows, buckets), and rows that are added to tables."""
        draft = f"v={version}-{uuid.uuid4().hex}"
        files = {name: dict(of) for name, of in base["files"].items()}
        for name, (rows, buckets) in replace.items():
            new = self._write(rows, name, base, draft)
            files[name] = {b: of for b, of in files[name].items() if int(b) not in buckets} | {b: [p] for b, p in new.items()}
        for name, rows in (add or {}).items():
            for b, p in self._write(rows, name, base, draft).items():
                files[name][b] = [*files[name].get(b, []), p]
        commit = {"version": version, "buckets": base["buckets"], "files": files, "facts": {**base["facts"], **facts}}
        atomic.write_new(self.spark, self._commit_path(version), json.dumps(commit, sort_keys=True))
