"""Registries: parsers, named functions, plugins, ordered hooks whose failures stay their own."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession


@runtime_checkable
class Extension(Protocol):
    name: str

    def on_load(self, spark: SparkSession) -> None: ...


class Registry:
    """Names to callables; a name is given once."""

    def __init__(self) -> None:
        self.items: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, item: Callable[..., Any]) -> None:
        if name in self.items:
            raise ValueError(f"{name} is registered")
        self.items[name] = item

    def resolve(self, name: str) -> Callable[..., Any]:
        try:
            return self.items[name]
        except KeyError:
            raise KeyError(f"unknown name: {name}; known: {', '.join(sorted(self.items))}") from None

    def call(self, name: str, *args: Any, **kwargs: Any) -> Any:
        return self.resolve(name)(*args, **kwargs)


#: name -> (DataFrame) -> DataFrame
parsers = Registry()
#: name -> column function
columns = Registry()


class Hooks:
    """Callbacks by hook, in order of registration; one that fails counts as None and the others run on."""

    def __init__(self) -> None:
        self.by_name: dict[str, list[Callable[..., Any]]] = {}

    def on(self, name: str, callback: Callable[..., Any]) -> None:
        self.by_name.setdefault(name, []).append(callback)

    def fire(self, name: str, *args: Any) -> list[Any]:
        out = []
        for callback in self.by_name.get(name, []):
            try:
                out.append(callback(*args))
            except Exception:  # noqa: BLE001  isolated on purpose
                out.append(None)
        return out

    def summary(self) -> dict[str, int]:
        return {k: len(v) for k, v in sorted(self.by_name.items())}


def load_extension(module: str, spark: SparkSession) -> Extension:
    """Import a module, take its get_extension() or Extension, and load it."""
    loaded = importlib.import_module(module)
    extension = loaded.get_extension() if hasattr(loaded, "get_extension") else loaded.Extension()
    extension.on_load(spark)
    return extension


def register_defaults() -> None:
    from siltworks.functions import text
    from siltworks.operators import logs

    if not parsers.items:
        parsers.register("structured", logs.parse_logs)
        for name in ("redact", "safe_filename", "category_slug", "clean_title", "markdown_escape", "remove_newlines", "preprocess_description"):
            columns.register(name, getattr(text, name))


def apply_parser(name: str, rows: DataFrame) -> DataFrame:
    register_defaults()
    return parsers.call(name, rows)
