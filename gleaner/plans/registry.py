"""Named queries: built-in ones, and SQL texts that users add. Nothing here runs a shell."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from gleaner.runtime import get_text, put_text

NAME = re.compile(r"^[a-z][a-z0-9_-]{0,63}$")


@dataclass
class Registry:
    """Built-in queries shadow added ones; a disabled query runs only by force."""

    builtin: dict = field(default_factory=dict)
    added: dict[str, str] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, name: str, sql: str, force: bool = False) -> str:
        if not NAME.match(name):
            raise ValueError(f"bad name: {name}")
        if name in self.builtin or (name in self.added and not force):
            raise ValueError(f"name is taken: {name}")
        known = name in self.added
        self.added[name] = sql
        return "updated" if known else "registered"

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the added queries to a new file; the names of files tell their order."""
        put_text(spark, path, json.dumps({"added": self.added, "disabled": sorted(self.disabled)}))

    def load(self, spark: SparkSession, path: str) -> None:
        """Takes over the added queries of a saved file; built-in names are never taken."""
        held = json.loads(get_text(spark, path))
        self.added |= {n: sql for n, sql in held["added"].items() if NAME.match(n) and n not in self.builtin}
        self.disabled |= set(held["disabled"])

    def unregister(self, name: str) -> bool:
        return self.added.pop(name, None) is not None

    def list(self) -> list[tuple[str, str, bool]]:
        return sorted([(n, "builtin", n not in self.disabled) for n in self.builtin] + [(n, "added", n not in self.disabled) for n in self.added])

    def run(self, spark: SparkSession, name: str, sf_dir: str, force: bool = False) -> DataFrame:
        if name in self.disabled and not force:
            raise ValueError(f"query is disabled: {name}")
        if name in self.builtin:
            return self.builtin[name](spark, sf_dir)
        return spark.sql(self.added[name])
