"""Registry of operators that users add: transformers, validators, extractors and exporters, run in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

KINDS = ("transformer", "validator", "extractor", "exporter", "hook")


@dataclass
class Registry:
    held: dict[str, dict[str, tuple[Callable, tuple[str, ...]]]] = field(default_factory=lambda: {k: {} for k in KINDS})
    versions: dict[str, tuple[int, ...]] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)
    #: (plugin, what went wrong) of steps that were left out.
    failures: list[tuple[str, str]] = field(default_factory=list)

    def add(self, kind: str, name: str, function: Callable, needs: tuple[str, ...] = (), version: str = "1.0.0") -> None:
        """Add a function under a kind. What it needs must be there already, each as a name, or as name>=version."""
        if kind not in self.held:
            raise ValueError(f"no such kind: {kind}")
        asked = {n: tuple(map(int, v.split("."))) if v else () for n, _, v in (x.partition(">=") for x in needs)}
        if lacking := {n for n, v in asked.items() if n not in self.versions or self.versions[n] < v}:
            raise ValueError(f"{name} needs {sorted(lacking)}")
        self.versions[name] = tuple(map(int, version.split(".")))
        self.held[kind][name] = (function, needs)

    def active(self, kind: str) -> dict[str, Callable]:
        return {n: f for n, (f, _) in self.held[kind].items() if n not in self.disabled}

    def transform(self, df: DataFrame) -> DataFrame:
        """df through all transformers in order; one whose plan can't be made is left out and noted."""
        for name, step in self.active("transformer").items():
            try:
                after = df.transform(step)
                _ = after.schema  # analysed here, so that what is wrong shows here
            except Exception as e:
                self.failures.append((name, str(e)))
            else:
                df = after
        return df

    def run_hooks(self, context: dict) -> dict:
        """The context through all hooks in order; what fails leaves it as it was and is noted."""
        for name, hook in self.active("hook").items():
            try:
                context = hook(dict(context))
            except Exception as e:
                self.failures.append((name, str(e)))
        return context

    def rules(self, item_type: str | None = None) -> dict[str, Column]:
        """Conditions of all validators by name; those that take an item type are asked for that one."""
        return {name: f(item_type) if f.__code__.co_argcount else f() for name, f in self.active("validator").items()}

    def export(self, df: DataFrame, name: str, path: str) -> None:
        self.held["exporter"][name][0](df, path)
