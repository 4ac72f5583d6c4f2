"""Readers of telemetry files: the first that takes a file reads it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import delimited, native

Sniffer = Callable[[SparkSession, str], bool]
Reader = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    readers: list[tuple[str, Sniffer, Reader]] = field(default_factory=list)

    def add(self, name: str, takes: Sniffer, read: Reader) -> None:
        self.readers.append((name, takes, read))

    def add_format(self, name: str, options: delimited.DelimitedOptions) -> None:
        """A delimited format, known by its file signature."""
        self.add(name, lambda s, p: delimited.is_compatible(s, p, options), lambda s, p: delimited.read(s, p, options))

    def find(self, spark: SparkSession, path: str) -> tuple[str, Reader]:
        """The first reader that takes the file; ValueError if none does."""
        for name, takes, read in self.readers:
            if takes(spark, path):
                return name, read
        raise ValueError(f"no reader takes {path}")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return self.find(spark, path)[1](spark, path)


def standard() -> Registry:
    """The native format, then delimited files whose header names the common channels."""

    def has_header(spark: SparkSession, path: str) -> bool:
        try:
            return bool(delimited.channels(spark, path))
        except ValueError:
            return False

    out = Registry()
    out.add("native", native.is_native, lambda s, p: native.read_all(s, p).fixes)
    out.add("delimited", has_header, delimited.read)
    return out
