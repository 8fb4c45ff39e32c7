"""Counters, gauges and histograms of a running engine as Prometheus text."""

from __future__ import annotations

import threading
from collections import defaultdict

from hashloom.operators.merge import SCANNED_BLOCKS, SCANNED_DOCS, SECONDS

COUNTERS = ("searches", "search_hits", "search_misses", "updates", "checkpoints", "memory_merges", "file_merges")
GAUGES = {"docs": "Number of documents in an index", "version": "Position of the feed an index reflects"}
HISTOGRAMS = {"search_duration_seconds": SECONDS, "scanned_docs_per_hash": SCANNED_DOCS, "scanned_blocks_per_hash": SCANNED_BLOCKS}


class Metrics:
    def __init__(self, prefix: str = "hashloom") -> None:
        self.prefix = prefix
        self._lock = threading.Lock()
        self._counters: dict[tuple, int] = defaultdict(int)
        self._gauges: dict[tuple, float] = {}
        self._histograms: dict[tuple, list] = {}
        self._calls: dict[str, int] = defaultdict(int)

    def add(self, name: str, index: str | None = None, by: int = 1) -> None:
        with self._lock:
            self._counters[name, index] += by

    def set(self, name: str, value: float, index: str | None = None) -> None:
        with self._lock:
            self._gauges[name, index] = value

    def due(self, name: str, every: int) -> bool:
        """True for the first of each ``every`` calls with this name."""
        with self._lock:
            self._calls[name] += 1
            return bool(every) and self._calls[name] % every == 1 % every

    def observe(self, name: str, value: float, index: str | None = None, times: int = 1) -> None:
        bounds = HISTOGRAMS[name]
        with self._lock:
            cell = self._histograms.setdefault((name, index), [[0] * len(bounds), 0, 0.0])
            for i, bound in enumerate(bounds):
                cell[0][i] += times * (value <= bound)
            cell[1] += times
            cell[2] += times * value

    def value(self, name: str, index: str | None = None) -> float:
        with self._lock:
            return self._counters.get((name, index), self._gauges.get((name, index), 0))

    def drop_index(self, index: str) -> None:
        """Forget an index's counters and gauges; its histograms stay."""
        with self._lock:
            for cells in (self._counters, self._gauges):
                for key in [k for k in cells if k[1] == index]:
                    del cells[key]

    def render(self) -> str:
        def label(index: str | None, **more: object) -> str:
            pairs = ([("index", index)] if index is not None else []) + list(more.items())
            return "{" + ",".join(f'{k}="{v}"' for k, v in pairs) + "}" if pairs else ""

        lines: list[str] = []
        with self._lock:
            for name in COUNTERS:
                lines.append(f"# TYPE {self.prefix}_{name}_total counter")
                lines += [f"{self.prefix}_{name}_total{label(i)} {v}" for (n, i), v in sorted(self._counters.items(), key=str) if n == name]
            for name, help_text in GAUGES.items():
                lines += [f"# HELP {self.prefix}_{name} {help_text}", f"# TYPE {self.prefix}_{name} gauge"]
                lines += [f"{self.prefix}_{name}{label(i)} {v:g}" for (n, i), v in sorted(self._gauges.items(), key=str) if n == name]
            for name, bounds in HISTOGRAMS.items():
                lines.append(f"# TYPE {self.prefix}_{name} histogram")
                for (n, i), (cells, count, total) in sorted(self._histograms.items(), key=str):
                    if n == name:
                        lines += [f"{self.prefix}_{name}_bucket{label(i, le=b)} {c}" for b, c in zip(bounds, cells, strict=True)]
                        lines += [f"{self.prefix}_{name}_bucket{label(i, le='+Inf')} {count}", f"{self.prefix}_{name}_sum{label(i)} {total:g}", f"{self.prefix}_{name}_count{label(i)} {count}"]
        return "\n".join(lines) + "\n"
