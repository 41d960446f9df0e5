"""Where extraction, recognition and embedding plug in; each is a plain callable run in batches on executors.

No extractor, model or network is part of this package. A plug-in gives rows, a failure becomes a
row with its error, and a window of pages that fails is tried again in halves, then reported missing.
"""

from __future__ import annotations

import importlib.util
import re
import shutil
import subprocess
import tempfile
import threading
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame


class Extractor(ABC):
    """Turns the pages ``first`` to ``last`` of a file into Markdown."""

    name = "extractor"

    def is_available(self) -> bool:
        return True

    def warm_up(self) -> None:
        """Called once in each worker before the first file."""

    @abstractmethod
    def extract(self, path: str, first: int, last: int) -> str: ...


class TextExtractor(Extractor):
    """Reads a text file; a page is a form feed's worth of it."""

    name = "text"

    def extract(self, path: str, first: int, last: int) -> str:
        with open(path.removeprefix("file:"), encoding="utf-8", errors="replace") as f:
            return "\f".join(f.read().split("\f")[first : last + 1])


class ModuleExtractor(Extractor):
    """An engine that is an installed module: there only if it can be imported, loaded once in each worker.

    ``open_file`` takes the module and a path and gives the text of each page.
    """

    def __init__(self, name: str, module: str, open_file: Callable[[object, str], list[str]]) -> None:
        self.name, self.module, self.open_file = name, module, open_file

    def is_available(self) -> bool:
        return importlib.util.find_spec(self.module) is not None

    def warm_up(self) -> None:
        importlib.import_module(self.module)

    def extract(self, path: str, first: int, last: int) -> str:
        pages = self.open_file(importlib.import_module(self.module), path.removeprefix("file:"))
        return "\f".join(pages[first : last + 1])


class CommandExtractor(Extractor):
    """An engine in an interpreter of its own: a command that writes Markdown into a folder.

    ``{path}``, ``{out}``, ``{first}`` and ``{last}`` are filled in. The largest Markdown file below the
    folder is the text; the command is stopped after ``seconds``.
    """

    def __init__(self, name: str, command: list[str], seconds: float = 1200) -> None:
        self.name, self.command, self.seconds = name, command, seconds

    def is_available(self) -> bool:
        return shutil.which(self.command[0]) is not None

    def extract(self, path: str, first: int, last: int) -> str:
        with tempfile.TemporaryDirectory() as out:  # of this one call, on the machine that makes it
            values = {"path": path.removeprefix("file:"), "out": out, "first": str(first), "last": str(last)}
            filled = [re.sub(r"\{(path|out|first|last)\}", lambda m: values[m[1]], part) for part in self.command]
            done = subprocess.run(filled, capture_output=True, text=True, timeout=self.seconds)
            if done.returncode:
                raise RuntimeError(done.stderr.strip()[-500:] or f"exit code {done.returncode}")
            files = sorted(Path(out).rglob("*.md"), key=lambda f: (-f.stat().st_size, str(f)))
            if not files:
                raise FileNotFoundError("the engine wrote no Markdown")
            return files[0].read_text(encoding="utf-8", errors="replace")


def page_count(entries: list[dict]) -> int:
    """Pages of an engine's list of contents: distinct page indexes."""
    return len({e["page_idx"] for e in entries if e.get("page_idx") is not None})


# Pages looked at, confidence and number of tables of a model that finds tables in images.
MOST_PAGES, LEAST_CONFIDENCE, MOST_TABLES = 100, 0.7, 50


def detected_tables(found: list[tuple[int, float, tuple[float, float, float, float]]]) -> list[tuple[int, tuple[float, float, float, float]]]:
    """(page, box) of a table model's findings (page, confidence, box): on the first 100 pages, sure enough, at most 50 in order."""
    kept = [(page, box) for page, confidence, box in found if page < MOST_PAGES and confidence >= LEAST_CONFIDENCE]
    return sorted(kept, key=lambda f: (f[0], f[1][1], f[1][0]))[:MOST_TABLES]


def with_timeout(call: Callable[[], str], seconds: float) -> str:
    """The call's result, or TimeoutError; the caller goes on, the thread ends with its process."""
    result: list = []

    def run() -> None:
        try:
            result.append((True, call()))
        except BaseException as error:
            result.append((False, error))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not result:
        raise TimeoutError(f"no result within {seconds} seconds")
    ok, value = result[0]
    if not ok:
        raise value
    return value


_REGISTRY: dict[str, Extractor] = {}


def registered() -> dict[str, Extractor]:
    return dict(_REGISTRY)


def register(extractor: Extractor) -> None:
    _REGISTRY[extractor.name] = extractor


def choose(name: str = "auto", order: tuple[str, ...] = ()) -> Extractor:
    """The named extractor, or the first available one."""
    names = [name] if name != "auto" else [*order, *_REGISTRY]
    for n in names:
        if n in _REGISTRY and _REGISTRY[n].is_available():
            return _REGISTRY[n]
    raise LookupError(f"no extractor {name!r} is available")


register(TextExtractor())


def windows(page_count: int, size: int = 80, least: int = 100) -> list[tuple[int, int]]:
    """Page windows: one for up to ``least`` pages, else windows of ``size``."""
    if page_count <= least:
        return [(0, max(0, page_count - 1))]
    return [(a, min(a + size, page_count) - 1) for a in range(0, page_count, size)]


def with_retries(call: Callable[[], str], attempts: int = 2, pause: float = 0.0) -> str:
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError


def extract_window(extractor: Extractor, path: str, first: int, last: int, fallback: Extractor | None = None) -> tuple[str, str, str]:
    """(status, text, error): ok, degraded by the fallback, or missing in part or whole with a visible note."""
    try:
        return "ok", with_retries(lambda: extractor.extract(path, first, last)), ""
    except Exception as error:
        reason = f"{type(error).__name__}: {error}"
    if fallback is not None:
        try:
            text = fallback.extract(path, first, last)
            if len(text.strip()) >= 50 * (last - first + 1):
                return "degraded", text, reason
        except Exception:
            pass
        return "missing", f"[pages {first + 1}-{last + 1} are missing]", reason
    if last <= first:
        return "missing", f"[page {first + 1} is missing]", reason
    middle = (first + last) // 2
    parts = []
    for a, b in ((first, middle), (middle + 1, last)):
        try:
            parts.append(("ok", extractor.extract(path, a, b)))
        except Exception:
            parts.append(("missing", f"[pages {a + 1}-{b + 1} are missing]"))
    status = "ok" if all(s == "ok" for s, _ in parts) else "missing"
    return status, "\n\n".join(t for _, t in parts), reason


def extract_segments(segments: DataFrame, extractor: Extractor, fallback: Extractor | None = None) -> DataFrame:
    """(doc_id, first, last, status, text, error) of segments (doc_id, path, first, last), one row each, whatever fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor.warm_up()
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("path", "first", "last"))))
            done = [extract_window(extractor, *r, fallback) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("first"), b.column("last"), *(pa.array([x[k] for x in done], pa.string()) for k in range(3))],
                names=["doc_id", "first", "last", "status", "text", "error"],
            )

    return segments.select("doc_id", "path", "first", "last").mapInArrow(run, "doc_id string, first int, last int, status string, text string, error string")


def assemble(segments: DataFrame) -> DataFrame:
    """(doc_id, text, missing, degraded): segments put together in order."""
    from pyspark.sql import functions as F

    ordered = F.sort_array(F.collect_list(F.struct("first", "text", "status")))
    df = segments.groupBy("doc_id").agg(ordered.alias("s"))
    pick = lambda status: F.transform(F.filter("s", lambda x: x["status"] == status), lambda x: x["first"])
    return df.select("doc_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n\n").alias("text"), pick("missing").alias("missing"), pick("degraded").alias("degraded"))
