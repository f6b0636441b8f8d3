"""Plug-ins: named DataFrame functions, by hand or from entry points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Plugin:
    """Hooks of a domain: each takes and gives a table; lints give findings (rule, severity, location, line, message)."""

    name: str
    post_extract: Callable[[DataFrame], DataFrame] | None = None
    lints: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


class Registry:
    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        self.plugins[plugin.name] = plugin

    def load(self, group: str = "brindle.plugins") -> None:
        for point in entry_points(group=group):
            self.register(point.load()())

    def extract(self, table: DataFrame) -> DataFrame:
        for p in self.plugins.values():
            table = p.post_extract(table) if p.post_extract else table
        return table

    def lint(self, table: DataFrame) -> DataFrame | None:
        """The union of all lints' findings; a lint that can't be planned becomes a finding itself."""
        out = None
        for p in self.plugins.values():
            for lint in p.lints:
                try:
                    found = lint(table)
                    found.schema  # noqa: B018  plans it
                except Exception as e:  # noqa: BLE001
                    found = table.sparkSession.createDataFrame([("lint-crash", "warning", p.name, 0, str(e)[:500])], "rule string, severity string, location string, line int, message string")
                found = found.select("rule", "severity", "location", F.col("line").cast("int").alias("line"), "message")
                out = found if out is None else out.unionByName(found)
        return out
