"""Settings of the engine."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EngineConfig:
    similarity_enabled: bool = True
    similarity_threshold: float = 0.15
    max_similar_per_note: int = 10
    result_limit: int = 20
    graph_node_cap: int = 500
    snippet_before: int = 40
    snippet_after: int = 80
    preview_length: int = 160
    #: Retrieval over-fetch: None filters the full match set; a factor keeps only ``limit * factor`` rows before filters.
    overfetch: int | None = None
    #: Keep letters beyond ASCII in normalised terms (by default they are stripped, as in the reference behaviour).
    unicode_terms: bool = False
    marker: str = ".notebook"
    ignore_file: str = ".notebookignore"

    def configured(self, **settings) -> tuple[EngineConfig, bool]:
        """Apply settings whose type fits; ignore the others. Gives the new settings and whether anything changed.

        The cap is floored to an integer of at least 1; the threshold is taken as it is.
        """
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
        fit = {}
        if isinstance(settings.get("similarity_enabled"), bool):
            fit["similarity_enabled"] = settings["similarity_enabled"]
        if number(settings.get("similarity_threshold")):
            fit["similarity_threshold"] = float(settings["similarity_threshold"])
        if number(settings.get("max_similar_per_note")):
            fit["max_similar_per_note"] = max(1, math.floor(settings["max_similar_per_note"]))
        new = replace(self, **fit)
        return new, new != self
