"""Values that live as long as a step or a job execution (J23), and the listener that ends them."""

from __future__ import annotations

from collections.abc import Callable
from threading import RLock
from typing import Any

from millrace.plans.domain import JobExecution, StepExecution
from millrace.plans.errors import ScopeNotActiveError


class Scope:
    """Values by name, made when first asked for within an execution and dropped when it ends.

    A factory gets the execution, so parameters and contexts bind late. Executions
    that run at once have values of their own; on_drop of a value is called at the end.
    """

    def __init__(self, name: str):
        self.name, self._factories, self._held, self._lock = name, {}, {}, RLock()

    def register(self, name: str, factory: Callable[[Any], Any], on_drop: Callable[[Any], None] | None = None) -> None:
        self._factories[name] = (factory, on_drop)

    def enter(self, execution: StepExecution | JobExecution) -> None:
        with self._lock:
            self._held.setdefault(id(execution), (execution, {}))

    def get(self, name: str, execution: StepExecution | JobExecution) -> Any:
        with self._lock:
            if id(execution) not in self._held:
                raise ScopeNotActiveError(f"no {self.name} is active for {name}")
            if name not in self._factories:
                raise ScopeNotActiveError(f"the {self.name} scope has no {name}")
            values = self._held[id(execution)][1]
            if name not in values:
                values[name] = self._factories[name][0](execution)
            return values[name]

    def leave(self, execution: StepExecution | JobExecution) -> None:
        with self._lock:
            _, values = self._held.pop(id(execution), (None, {}))
        for name, value in reversed(values.items()):
            if self._factories[name][1]:
                self._factories[name][1](value)


class ScopeListener:
    """Opens a step's and a job's scope before it and closes it after it, whatever its end."""

    def __init__(self, step: Scope | None = None, job: Scope | None = None):
        self.step, self.job = step, job

    def before_step(self, step: StepExecution) -> None:
        if self.step:
            self.step.enter(step)

    def after_step(self, step: StepExecution) -> None:
        if self.step:
            self.step.leave(step)

    def before_job(self, job: JobExecution) -> None:
        if self.job:
            self.job.enter(job)

    def after_job(self, job: JobExecution) -> None:
        if self.job:
            self.job.leave(job)
