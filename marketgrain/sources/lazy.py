"""Tables by name, opened when first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class LazyTables(Mapping):
    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._builders[name]()
        return self._opened[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def mapped(self, change: Mapping[str, Callable[[Mapping[str, DataFrame]], DataFrame]]) -> LazyTables:
        """The same tables with some rebuilt by a function of the originals."""
        rebuilt = {name: (lambda build=build: build(self)) for name, build in change.items()}
        return LazyTables({**{name: (lambda name=name: self[name]) for name in self}, **rebuilt})
