"""What tests of jobs need (J29): one job or one step against a store in memory, made-up executions, files compared."""

from __future__ import annotations

import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import jobs
from millrace.plans.domain import BatchStatus, JobExecution, JobInstance, JobParameter, JobParameters, StepExecution
from millrace.plans.repository import JobRepository


def unique_parameters(**values: Any) -> JobParameters:
    """Parameters of an instance that no other run has."""
    return JobParameters.of(**values) | {"random": JobParameter.of("random", uuid.uuid4().hex)}


class JobRunner:
    """Runs jobs, or single steps of them, against a store of its own."""

    def __init__(self, spark: SparkSession | None = None, repository: JobRepository | None = None):
        self.runtime = jobs.Runtime(spark, repository or JobRepository(":memory:"))

    def job(self, job: jobs.Job, parameters: JobParameters | None = None) -> JobExecution:
        return jobs.Launcher(self.runtime).run(job, JobParameters(parameters if parameters is not None else unique_parameters()))

    def step(self, job: jobs.Job, name: str, parameters: JobParameters | None = None, context: dict[str, Any] | None = None) -> StepExecution:
        """One step of a job, as the only one of a run; context: what the job's context holds before it."""
        step = next((s for s in (*job.steps, *(job.flow.steps.values() if isinstance(job.flow, jobs.Flow) else ())) if s.name == name), None)
        if step is None:
            raise KeyError(f"the job {job.name} has no step {name}")
        alone = jobs.Job(f"{job.name}.{name}", [step], listeners=jobs.Listeners(_Preset(context or {})))
        return self.job(alone, parameters).steps[0]

    def remove_all(self, name: str) -> int:
        """Delete the instances of a job with all that hangs on them."""
        found = self.runtime.repository.instances(name, 0, 1 << 31)
        for i in found:
            self.runtime.repository.delete_instance(i.id)
        return len(found)


class _Preset:
    def __init__(self, context: dict[str, Any]):
        self.context = context

    def before_job(self, job: JobExecution) -> None:
        job.context.update(self.context)


def job_execution(name: str = "job", number: int = 1, status: BatchStatus = BatchStatus.STARTING, **parameters: Any) -> JobExecution:
    """An execution that no store knows."""
    given = JobParameters.of(**parameters)
    out = JobExecution(JobInstance(number, name, given.key()), given, number)
    out.status = status
    return out


def step_execution(name: str = "step", job: JobExecution | None = None, **counts: int) -> StepExecution:
    out = StepExecution(name, job or job_execution())
    out.counts |= counts
    return out


def assert_same_lines(expected: str | Path, found: str | Path) -> None:
    """Two text files agree line by line; the first difference is told."""
    a, b = (Path(p).read_text(encoding="utf-8").splitlines() for p in (expected, found))
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        assert x == y, f"line {i + 1}: expected {x!r}, found {y!r}"
    assert len(a) == len(b), f"expected {len(a)} lines, found {len(b)}"


def assert_same_rows(expected: DataFrame, found: DataFrame) -> None:
    """Two DataFrames have the same rows, repeats counted, in any order; compared where they are, not on the driver."""
    assert sorted(expected.columns) == sorted(found.columns), f"columns {expected.columns} and {found.columns}"
    found = found.select(*expected.columns)
    missing, extra = expected.exceptAll(found), found.exceptAll(expected)
    assert missing.isEmpty(), f"missing {missing.first()}"
    assert extra.isEmpty(), f"not expected {extra.first()}"
