"""Builders of steps, flows and jobs (J6, J7, J17, J18): each call gives a new builder, build() checks and makes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column

from millrace.operators.faults import RetryTemplate, SimpleRetry
from millrace.plans import jobs
from millrace.plans.errors import FlowExecutionError


@dataclass(frozen=True)
class StepBuilder:
    """A step by name: of several kinds that were given, a flow goes before a job, a partition, a tasklet and a chunk step."""

    name: str
    kinds: dict[str, dict[str, Any]] = field(default_factory=dict)
    common: dict[str, Any] = field(default_factory=dict)
    hooks: tuple[Any, ...] = ()

    def _kind(self, kind: str, **values: Any) -> StepBuilder:
        return replace(self, kinds=self.kinds | {kind: self.kinds.get(kind, {}) | values})

    def chunk(self, size: int, group: int = 1) -> StepBuilder:
        if size < 1:
            raise ValueError("a chunk has an item at least")
        return self._kind("chunk", size=size, group=group)

    def reader(self, reader: Callable) -> StepBuilder:
        return self._kind("chunk", reader=reader)

    def processor(self, processor: Callable) -> StepBuilder:
        return self._kind("chunk", processor=processor)

    def keep(self, predicate: Column) -> StepBuilder:
        return self._kind("chunk", keep=predicate)

    def each(self, process: Callable, schema: str, hooks: Sequence[Any] = ()) -> StepBuilder:
        """A callable per item, in the workers."""
        return self._kind("chunk", process=process, schema=schema, item_hooks=tuple(hooks))

    def writer(self, writer: Callable) -> StepBuilder:
        return self._kind("chunk", writer=writer)

    def retry(self, most: int, *kinds: type) -> StepBuilder:
        """So many attempts of an item, after errors of these kinds."""
        return self._kind("chunk", item_retry=RetryTemplate(SimpleRetry(most, dict.fromkeys(kinds or (Exception,), True))))

    def retry_writes(self, template: RetryTemplate) -> StepBuilder:
        return self._kind("chunk", retry=template)

    def retry_reads(self, template: RetryTemplate) -> StepBuilder:
        return self._kind("chunk", read_retry=template)

    def skip(self, limit: int, *kinds: type | str) -> StepBuilder:
        if limit < 1:
            raise ValueError("to skip takes a limit of one at least")
        return self._kind("chunk", skip_limit=limit, skippable=tuple(k if isinstance(k, str) else k.__name__ for k in kinds))

    def tasklet(self, tasklet: Callable) -> StepBuilder:
        return self._kind("tasklet", tasklet=tasklet)

    def partition(self, low: int, high: int, worker: Callable, grid: int = 6, concurrency: int = 4) -> StepBuilder:
        return self._kind("partition", low=low, high=high, worker=worker, grid=grid, concurrency=concurrency)

    def job(self, job: jobs.Job, extract: Callable | None = None) -> StepBuilder:
        return self._kind("job", job=job, **({"extract": extract} if extract else {}))

    def flow(self, flow: jobs.Flow) -> StepBuilder:
        return self._kind("flow", flow=flow)

    def start_limit(self, most: int) -> StepBuilder:
        return replace(self, common=self.common | {"start_limit": most})

    def allow_restart_complete(self) -> StepBuilder:
        return replace(self, common=self.common | {"allow_restart_complete": True})

    def listener(self, *listeners: Any) -> StepBuilder:
        return replace(self, hooks=(*self.hooks, *listeners))

    def build(self) -> jobs.Step:
        made = {"flow": jobs.FlowStep, "job": jobs.JobStep, "partition": jobs.PartitionStep, "tasklet": jobs.TaskletStep, "chunk": jobs.ChunkStep}
        kind = next((k for k in made if k in self.kinds), None)
        if kind is None:
            raise ValueError(f"the step {self.name} has nothing to do")
        if kind == "chunk" and (missing := [k for k in ("reader", "writer") if k not in self.kinds["chunk"]]):
            raise ValueError(f"the chunk step {self.name} has no {' and no '.join(missing)}")
        return made[kind](name=self.name, listeners=jobs.Listeners(*self.hooks), **self.common, **self.kinds[kind])


@dataclass(frozen=True)
class FlowBuilder:
    """A flow: start(step), then on(code).to(step), end(), fail() or stop() of the step named last."""

    name: str
    steps: dict[str, jobs.Step] = field(default_factory=dict)
    first: str | None = None
    at: str | None = None
    code: str = "COMPLETED"
    moves: dict[tuple[str, str], str] = field(default_factory=dict)
    deciders: dict[str, Callable] = field(default_factory=dict)
    codes: dict[tuple[str, str], str] = field(default_factory=dict)

    def start(self, step: jobs.Step) -> FlowBuilder:
        return replace(self, steps=self.steps | {step.name: step}, first=step.name, at=step.name)

    def source(self, step: jobs.Step | str) -> FlowBuilder:
        """Go on from a step that is there already."""
        name = step if isinstance(step, str) else step.name
        if name not in self.steps:
            raise FlowExecutionError(f"the flow {self.name} has no step {name}")
        return replace(self, at=name, code="COMPLETED")

    def on(self, code: str) -> FlowBuilder:
        return replace(self, code=code)

    def to(self, step: jobs.Step) -> FlowBuilder:
        return replace(self, steps=self.steps | {step.name: step}, moves=self.moves | {(self._from(), self.code): step.name}, at=step.name, code="COMPLETED")

    def next(self, step: jobs.Step) -> FlowBuilder:
        return self.on("COMPLETED").to(step)

    def decider(self, decide: Callable) -> FlowBuilder:
        return replace(self, deciders=self.deciders | {self._from(): decide})

    def _from(self) -> str:
        if self.at is None:
            raise FlowExecutionError(f"the flow {self.name} has no start")
        return self.at

    def _end(self, to: str) -> FlowBuilder:
        return replace(self, moves=self.moves | {(self._from(), self.code): to})

    def end(self, code: str | None = None) -> FlowBuilder:
        out = self._end(jobs.END)
        return out if code is None else replace(out, codes=self.codes | {(self._from(), self.code): code})

    def fail(self) -> FlowBuilder:
        return self._end(jobs.FAIL)

    def stop(self) -> FlowBuilder:
        return self._end(jobs.STOP)

    def build(self) -> jobs.Flow:
        return jobs.Flow(self.name, dict(self.steps), self.first or self._from(), dict(self.moves), dict(self.deciders), dict(self.codes))


@dataclass(frozen=True)
class JobBuilder:
    name: str
    steps: tuple[jobs.Step, ...] = ()
    given: dict[str, Any] = field(default_factory=dict)
    hooks: tuple[Any, ...] = ()

    def start(self, step: jobs.Step) -> JobBuilder:
        return replace(self, steps=(step,))

    def next(self, step: jobs.Step) -> JobBuilder:
        return replace(self, steps=(*self.steps, step))

    def flow(self, flow: jobs.Flow | jobs.SplitFlow) -> JobBuilder:
        return replace(self, given=self.given | {"flow": flow})

    def split(self, *flows: jobs.Flow) -> JobBuilder:
        return replace(self, given=self.given | {"splits": (*self.given.get("splits", ()), jobs.SplitFlow(flows))})

    def validator(self, *validators: Callable) -> JobBuilder:
        return replace(self, given=self.given | {"validator": jobs.composite_validator(*validators)})

    def incrementer(self, *incrementers: Callable) -> JobBuilder:
        return replace(self, given=self.given | {"incrementer": jobs.composite_incrementer(*incrementers)})

    def prevent_restart(self) -> JobBuilder:
        return replace(self, given=self.given | {"restartable": False})

    def allow_completed(self) -> JobBuilder:
        return replace(self, given=self.given | {"allow_completed": True})

    def listener(self, *listeners: Any) -> JobBuilder:
        return replace(self, hooks=(*self.hooks, *listeners))

    def build(self) -> jobs.Job:
        if not self.steps and not self.given:
            raise ValueError(f"the job {self.name} has nothing to do")
        names = [s.name for s in self.steps]
        if len(set(names)) < len(names):
            raise ValueError(f"the job {self.name} names a step twice")
        return jobs.Job(self.name, self.steps, listeners=jobs.Listeners(*self.hooks), **self.given)
