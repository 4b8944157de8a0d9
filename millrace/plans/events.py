"""Events of jobs, steps and chunks, marked hooks and the stopwatch."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

#: Groups of hooks and their names.
HOOKS = {
    "job": ("before_job", "after_job", "job_failed"),
    "step": ("before_step", "after_step", "step_failed"),
    "chunk": ("before_chunk", "after_chunk", "chunk_failed"),
    "read": ("before_read", "after_read", "on_read_error"),
    "process": ("before_process", "after_process", "on_process_error"),
    "write": ("before_write", "after_write", "on_write_error"),
    "skip": ("on_skip_in_read", "on_skip_in_process", "on_skip_in_write"),
}
KNOWN = {h for group in HOOKS.values() for h in group}


@dataclass(frozen=True)
class Event:
    """What happened to which job, step or chunk; error is set where it failed."""

    name: str
    subject: Any
    chunk: int | None = None
    error: BaseException | None = None
    at: float = field(default_factory=time.time)


class EventListener:
    """Publishes an Event for each hook of jobs, steps and chunks to a callable."""

    def __init__(self, publish: Callable[[Event], None]):
        self.publish = publish

    def __getattr__(self, hook: str) -> Callable[..., None]:
        if hook not in (*HOOKS["job"], *HOOKS["step"], *HOOKS["chunk"]):
            raise AttributeError(hook)

        def told(subject: Any, *more: Any) -> None:
            chunk = next((m for m in more if isinstance(m, int)), None)
            self.publish(Event(hook, subject, chunk, next((m for m in more if isinstance(m, BaseException)), None)))

        return told


def hook(name: str) -> Callable[[Callable], Callable]:
    """Marks a method, whatever its name, as the hook of that name."""
    if name not in KNOWN:
        raise ValueError(f"no hook is named {name}")

    def mark(method: Callable) -> Callable:
        method.hook = name
        return method

    return mark


class Hooked:
    """A listener made of an object's marked methods; several of one name are called in their order."""

    def __init__(self, target: Any):
        self.found: dict[str, list[Callable]] = {}
        for n in dir(type(target)):
            if (name := getattr(getattr(type(target), n), "hook", None)) in KNOWN:
                self.found.setdefault(name, []).append(getattr(target, n))

    def __getattr__(self, name: str) -> Callable[..., Any]:
        if name == "found" or name not in self.found:
            raise AttributeError(name)

        def run(*arguments: Any) -> Any:
            out = None
            for f in self.found[name]:
                given = f(*arguments)
                out = given if given is not None else out
            return out

        return run


class Stopwatch:
    """Seconds of each job, step and chunk, by name."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self._begun, self.seconds = clock, {}, {}

    def _name(self, kind: str, subject: Any, more: tuple) -> str:
        name = subject.instance.name if kind == "job" else subject.name
        return f"{kind} {name}" + (f" {more[0]}" if kind == "chunk" else "")

    def __getattr__(self, name: str) -> Callable[..., None]:
        before, _, kind = name.partition("_")
        if kind not in ("job", "step", "chunk") or before not in ("before", "after"):
            raise AttributeError(name)

        def run(subject: Any, *more: Any) -> None:
            label = self._name(kind, subject, more)
            if before == "before":
                self._begun[label] = self.clock()
            elif label in self._begun:
                self.seconds[label] = self.seconds.get(label, 0.0) + self.clock() - self._begun.pop(label)

        return run
