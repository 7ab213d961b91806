"""Plug-ins: extractors and adapters that callers add, applied to pages in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

ENTITIES = "page_id long, adapter string, kind string, entity_id string, fields map<string,string>, parent_id string"


@dataclass
class Adapter:
    """``matches(url)`` says for which pages it is meant, ``extract(html, url)`` gives entities
    ``(kind, id, fields, parent id)``, ``valid`` may refuse one."""

    name: str
    matches: Callable[[str], bool]
    extract: Callable[[str, str], list[tuple[str, str, dict[str, str], str | None]]]
    valid: Callable[[tuple], bool] = field(default=lambda e: True)


class Registry:
    """Adapters in order; the first that matches a page is used."""

    def __init__(self) -> None:
        self.adapters: list[Adapter] = []

    def add(self, adapter: Adapter) -> None:
        if any(a.name == adapter.name for a in self.adapters):
            raise ValueError(f"there is an adapter {adapter.name} already")
        self.adapters.append(adapter)

    def apply(self, pages: DataFrame) -> DataFrame:
        """Entities of ``page_id, url, html``; a page that no adapter matches gives none."""
        adapters = self.adapters

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for i, u, h in zip(b["page_id"], b["url"], b["html"]):
                    a = next((a for a in adapters if u and h and a.matches(u)), None)
                    if a:
                        rows += [(i, a.name, *e) for e in a.extract(h, u) if a.valid(e)]
                yield pd.DataFrame(rows, columns=["page_id", "adapter", "kind", "entity_id", "fields", "parent_id"])

        return pages.select("page_id", "url", "html").mapInPandas(run, ENTITIES)
