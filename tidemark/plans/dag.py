"""Running a graph of stages with reuse: a stage whose inputs and upstream outputs are unchanged isn't run again.

A final stage (``finally_``) takes all others as read: it runs after them, whatever failed, and again when the output
of any of them changed or went away. Only a need of its own that failed skips it.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DONE, REUSED, FAILED, SKIPPED = "done", "reused", "failed", "skipped"
#: Files above this size are known by their modification time instead of their content.
HASHED_BYTES = 16 << 20
#: Stands for the output of a stage that failed or was skipped.
GONE = "gone"


@dataclass(frozen=True)
class Stage:
    """``run`` does the work and leaves ``outputs``, and may say on how many items it worked; with ``finally_`` it runs last,
    unless a need of its own failed."""

    name: str
    run: Callable[[], int | None]
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    outputs: Callable[[], Iterable[str]] | tuple[str, ...] = ()
    version: int = 1
    finally_: bool = False
    force: bool = False

    def files(self) -> list[str]:
        return sorted(self.outputs() if callable(self.outputs) else self.outputs)


@dataclass
class Result:
    status: str
    seconds: float = 0.0
    error: str = ""
    digest: str = field(default="", repr=False)
    items: int | None = None


def checked(stages: list[Stage]) -> dict[str, Stage]:
    """By name; a repeated or unknown name or a cycle is an error."""
    by: dict[str, Stage] = {}
    for s in stages:
        if s.name in by:
            raise ValueError(f"stage {s.name} is defined twice")
        by[s.name] = s
    for s in stages:
        for n in s.needs:
            if n not in by:
                raise ValueError(f"stage {s.name} needs {n}, which isn't a stage")
    try:
        TopologicalSorter({s.name: s.needs for s in stages}).prepare()
    except CycleError as e:
        raise ValueError("stages need each other: " + " -> ".join(e.args[1])) from e
    return by


def selected(stages: list[Stage], targets: list[str] | None) -> list[Stage]:
    """The targets and all they need, in the order of definition; all stages without targets."""
    by = checked(stages)
    if not targets:
        return stages
    if unknown := [t for t in targets if t not in by]:
        raise ValueError("no such stage: " + ", ".join(unknown))
    want, stack = set(), list(targets)
    while stack:
        if (name := stack.pop()) not in want:
            want.add(name)
            stack += by[name].needs
    return [s for s in stages if s.name in want]


def digest(paths: Iterable[str]) -> str:
    """Of files or folders: names, sizes and contents, or times of large files; empty if any is missing."""
    h = hashlib.sha256()
    for path in sorted(paths):
        p = Path(path)
        if not p.exists():
            return ""
        for f in sorted(x for x in p.rglob("*") if x.is_file()) if p.is_dir() else [p]:
            st = f.stat()
            h.update(f"{f}\0{st.st_size}\0".encode())
            h.update(str(st.st_mtime_ns).encode() if st.st_size > HASHED_BYTES else f.read_bytes())
    return h.hexdigest()


def rows_digest(df: DataFrame) -> str:
    """Of a table's rows, in any order: their number and hashes. Columns must not be maps."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]) if df.columns else F.lit(0)
    n, total, mixed = df.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first()
    return f"{df.schema.simpleString()}|{n}|{total}|{mixed}"


def table_digest(spark: SparkSession) -> Callable[[Iterable[str]], str]:
    """A digest of tables by their rows, wherever they are: rewritten files with the same rows count as unchanged."""

    def of(paths: Iterable[str]) -> str:
        parts = []
        for path in sorted(paths):
            try:
                parts.append(path + "|" + rows_digest(spark.read.parquet(path)))
            except AnalysisException:  # there is no such table
                return ""
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()

    return of


def fingerprint(stage: Stage, upstream: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps([stage.name, stage.version, list(stage.inputs), sorted(upstream.items())]).encode()).hexdigest()


def load_state(path: str) -> dict:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def save_state(path: str, state: dict) -> None:
    """Replaced in one step, so that a crash leaves the old or the new one."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    temporary = f"{path}.new"
    Path(temporary).write_text(json.dumps(state, indent=1, sort_keys=True))
    os.replace(temporary, path)


class StateFile:
    """A run's state in a local file."""

    def __init__(self, path: str):
        self.path = path

    def load(self) -> dict:
        return load_state(self.path)

    def save(self, state: dict) -> None:
        save_state(self.path, state)


def run(stages: list[Stage], state_path, targets: list[str] | None = None, slots: int = 3, digest: Callable[[Iterable[str]], str] = digest) -> dict[str, Result]:
    """Runs stages as their needs are met, at most ``slots`` at a time; a failure skips only what depends on it.
    ``digest`` tells outputs apart, and is empty where one is missing. ``state_path`` is a local file, or an object that
    loads and saves the state.

    Spark jobs of several stages share the session; with the fair scheduler they share its executors too.
    """
    own = selected(stages, targets)
    names = [s.name for s in own if not s.finally_]
    store = StateFile(state_path) if isinstance(state_path, str) else state_path
    state, results = store.load(), {}

    def reads(s: Stage) -> list[str]:
        return sorted({*names, *s.needs}) if s.finally_ else list(s.needs)

    def one(s: Stage) -> Result:
        began = time.monotonic()
        mark = fingerprint(s, {n: results[n].digest or GONE for n in reads(s)})
        old = state.get(s.name, {})
        now = digest(s.files()) if old.get("fingerprint") == mark and not s.force else ""
        if now and now == old.get("digest"):
            return Result(REUSED, digest=now)
        try:
            items = s.run()
            if not (now := digest(s.files())):
                raise FileNotFoundError("it left no " + ", ".join(f for f in s.files() if not digest([f])))
        except Exception as e:  # noqa: BLE001 - any failure of a stage is its result
            state.pop(s.name, None)  # what it may have left half done is never reused
            return Result(FAILED, time.monotonic() - began, str(e))
        state[s.name] = {"fingerprint": mark, "digest": now}
        return Result(DONE, time.monotonic() - began, digest=now, items=items)

    waiting, running = {s.name: s for s in own}, {}
    with ThreadPoolExecutor(slots) as pool:
        while waiting or running:
            for s in list(waiting.values()):
                if all(n in results for n in reads(s)):
                    del waiting[s.name]
                    if any(results[n].status in (FAILED, SKIPPED) for n in s.needs):
                        results[s.name] = Result(SKIPPED)
                    else:
                        running[pool.submit(one, s)] = s
            if running:
                for f in wait(running, return_when=FIRST_COMPLETED).done:
                    results[running.pop(f).name] = f.result()
                    store.save(state)
    return {s.name: results[s.name] for s in own}


def stale(found: Iterable[str], wanted: Iterable[str], managed: Iterable[str]) -> list[str]:
    """Managed files that are no longer wanted."""
    keep = set(wanted)
    return sorted(f for f in found if f not in keep and any(f == m or f.startswith(m + "/") for m in managed))


def record(results: dict[str, Result], tools: dict[str, str], prompts: dict[str, str]) -> str:
    """What ran with what, as JSON."""
    return json.dumps({"stages": {n: {"status": r.status, "seconds": round(r.seconds, 3), "error": r.error} | ({"items": r.items} if r.items is not None else {}) for n, r in results.items()}, "tools": tools, "prompts": prompts}, indent=1)


def summary(results: dict[str, Result]) -> str:
    return "\n".join(f"{n:<24}{r.status:<9}{r.seconds:8.1f} s  {r.error}".rstrip() for n, r in results.items())
