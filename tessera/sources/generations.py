"""Generations of a set of tables: written out of sight, sealed by a manifest, shown by a pointer.

A generation is a folder of tables. When all of them are written, its manifest is written in one step: for each
table its folder, columns, number of rows and a digest of all of its rows. Last, the pointer is swapped to
it. Readers follow the pointer and never see a generation without a manifest, and what they load has to have
the rows that the manifest names. A generation is never written twice; it can take over tables of an
earlier one, which are not copied.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import canonical
from tessera.sources import atomic


def table_digests(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """rows and fingerprint of each table over all values of all columns, in any order of rows; one job for all."""
    parts = [canonical.values_fingerprint(df).select(F.lit(name).alias("name"), "rows", "fingerprint") for name, df in tables.items()]
    rows = reduce(DataFrame.unionByName, parts).collect() if parts else []  # a row a table
    return {r["name"]: {"rows": r["rows"], "fingerprint": r["fingerprint"], "columns": tables[r["name"]].columns} for r in rows}


class Generations:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, generation: str) -> str:
        return f"{self.root}/generation={generation}"

    def manifest(self, generation: str) -> dict | None:
        """The manifest of a generation, None as long as it isn't sealed."""
        text = atomic.read_text(self.spark, f"{self._folder(generation)}/_manifest.json")
        return None if text is None else json.loads(text)

    def current(self) -> str | None:
        """The generation that is shown, None before the first."""
        return atomic.read_text(self.spark, f"{self.root}/_current")

    def write(self, generation: str, tables: dict[str, DataFrame]) -> None:
        """Write tables of a generation that isn't sealed yet; what an earlier attempt left is overwritten."""
        if self.manifest(generation) is not None:
            raise FileExistsError(f"generation {generation} is sealed")
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self._folder(generation)}/{name}")

    def seal(self, generation: str, names: list[str], *, taken: dict[str, str] | None = None, show: bool = True) -> dict:
        """Write the manifest of a generation of the written tables ``names`` and, if ``show``, swap the pointer to it.

        ``taken``: tables to take over, name -> sealed generation that holds them.
        """
        written = {n: self.spark.read.parquet(f"{self._folder(generation)}/{n}") for n in names}
        tables = {n: {"folder": f"generation={generation}/{n}", **told} for n, told in table_digests(written).items()}
        for name, of in (taken or {}).items():
            earlier = self.manifest(of)
            if earlier is None:
                raise ValueError(f"generation {of} is not sealed")
            tables[name] = earlier["tables"][name]
        manifest = {"generation": generation, "tables": tables}
        atomic.write_new(self.spark, f"{self._folder(generation)}/_manifest.json", json.dumps(manifest, sort_keys=True))
        if show:
            self.show(generation)
        return manifest

    def show(self, generation: str) -> None:
        """Swap the pointer to a sealed generation."""
        if self.manifest(generation) is None:
            raise ValueError(f"generation {generation} is not sealed")
        atomic.replace(self.spark, f"{self.root}/_current", generation)

    def publish(self, generation: str, tables: dict[str, DataFrame], *, taken: dict[str, str] | None = None) -> dict:
        self.write(generation, tables)
        return self.seal(generation, list(tables), taken=taken)

    def table(self, name: str, generation: str | None = None) -> DataFrame:
        """A table of a sealed generation, the shown one if none is named."""
        return self._tables(generation, [name])[name]

    def _tables(self, generation: str | None, names: list[str] | None) -> dict[str, DataFrame]:
        generation = generation if generation is not None else self.current()
        manifest = self.manifest(generation) if generation is not None else None
        if manifest is None:
            raise ValueError(f"generation {generation} is not sealed")
        return {n: self.spark.read.parquet(f"{self.root}/{manifest['tables'][n]['folder']}") for n in names or manifest["tables"]}

    def problems(self, generation: str | None = None) -> list[str]:
        """Tables whose rows or columns are not those of the manifest; every value of every row is looked at."""
        generation = generation if generation is not None else self.current()
        tables = self._tables(generation, None)
        told = self.manifest(generation)["tables"]
        return sorted(n for n, is_ in table_digests(tables).items() if is_ != {k: told[n][k] for k in is_})

    def load(self, generation: str | None = None) -> dict[str, DataFrame]:
        """All tables of a sealed generation, after a look at every row; ValueError if they are not those of the manifest."""
        generation = generation if generation is not None else self.current()
        tables = self._tables(generation, None)
        if bad := self.problems(generation):
            raise ValueError(f"tables of generation {generation} are not those of its manifest: {bad}")
        return tables
