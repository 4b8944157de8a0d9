"""The metadata store: SQLite on the driver, exposed as DataFrames."""

from __future__ import annotations

import json
import sqlite3
import threading
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.domain import BatchStatus, ExecutionContext, ExitStatus, JobExecution, JobInstance, JobParameter, JobParameters, StepExecution
from millrace.plans.errors import NoSuchJobExecution, OptimisticLockingFailure

SHORT_CONTEXT = 2500
COUNTERS = ("read_count", "write_count", "filter_count", "commit_count", "rollback_count", "read_skip_count", "process_skip_count", "write_skip_count")
TABLES = {
    "job_instance": "id bigint, version bigint, job_name string, job_key string",
    "job_execution": "id bigint, version bigint, job_instance_id bigint, create_time timestamp, start_time timestamp, end_time timestamp, status string, exit_code string, exit_message string, last_updated timestamp, stop_requested boolean",
    "job_execution_params": "job_execution_id bigint, param_name string, param_type string, param_value string, identifying string",
    "step_execution": "id bigint, version bigint, step_name string, job_execution_id bigint, start_time timestamp, end_time timestamp, status string, " + ", ".join(f"{c} bigint" for c in COUNTERS) + ", exit_code string, exit_message string, last_updated timestamp",
    "step_execution_context": "step_execution_id bigint, short_context string, serialized_context string",
    "job_execution_context": "job_execution_id bigint, short_context string, serialized_context string",
}
RUNNING = ("STARTING", "STARTED", "STOPPING")


def now() -> datetime:
    return datetime.now(timezone.utc)


def _stamp(at: datetime | None) -> str | None:
    return None if at is None else at.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def _time(text: str | None) -> datetime | None:
    return None if text is None else datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f").replace(tzinfo=timezone.utc)


class JobRepository:
    """Instances, executions, parameters, steps and contexts, with optimistic versions.

    A stop request is a column of its own, so it doesn't collide with the running
    job's updates. Chunk commits have a table too: a step's chunk counts once it
    stands there.
    """

    def __init__(self, path: str = ":memory:", prefix: str = "batch_", isolation: str = "IMMEDIATE"):
        if isolation not in ("DEFERRED", "IMMEDIATE", "EXCLUSIVE"):
            raise ValueError(f"no isolation is named {isolation}")
        self.prefix, self.isolation, self._lock = prefix, isolation, threading.RLock()
        self._db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self._depth = 0
        for name, columns in TABLES.items():
            shape = columns.replace("bigint", "INTEGER").replace("string", "TEXT").replace("timestamp", "TEXT").replace("boolean", "INTEGER")
            shape = shape.replace("id INTEGER", "id INTEGER PRIMARY KEY AUTOINCREMENT", 1) if shape.startswith("id ") else shape
            shape = shape.replace("_id INTEGER", "_id INTEGER PRIMARY KEY", 1) if name.endswith("_context") else shape
            self._run(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({shape}{', UNIQUE(job_name, job_key)' if name == 'job_instance' else ''})")
        self._run(f"CREATE TABLE IF NOT EXISTS {prefix}chunk_commit (job_execution_id INTEGER, step_name TEXT, chunk_id INTEGER, counters TEXT, PRIMARY KEY (job_execution_id, step_name, chunk_id))")

    def _run(self, sql: str, *values: Any) -> sqlite3.Cursor:
        with self._lock:
            return self._db.execute(sql, values)

    def _all(self, sql: str, *values: Any) -> list[tuple]:
        with self._lock:
            return self._db.execute(sql, values).fetchall()

    @contextmanager
    def transaction(self):
        """A transaction; inner ones are savepoints."""
        with self._lock:
            point = f"sp_{self._depth}"
            self._run(f"BEGIN {self.isolation}" if self._depth == 0 else f"SAVEPOINT {point}")
            self._depth += 1
            try:
                yield self
            except BaseException:
                self._depth -= 1
                self._run("ROLLBACK" if self._depth == 0 else f"ROLLBACK TO {point}")
                raise
            self._depth -= 1
            self._run("COMMIT" if self._depth == 0 else f"RELEASE {point}")

    # instances and executions

    def instance(self, name: str, parameters: JobParameters, create: bool = True) -> JobInstance | None:
        key, t = parameters.key(), f"{self.prefix}job_instance"
        with self.transaction():
            found = self._all(f"SELECT id FROM {t} WHERE job_name = ? AND job_key = ?", name, key)
            if not found and not create:
                return None
            number = found[0][0] if found else self._run(f"INSERT INTO {t} (version, job_name, job_key) VALUES (0, ?, ?)", name, key).lastrowid
        return JobInstance(number, name, key)

    def instance_by_id(self, number: int) -> JobInstance | None:
        found = self._all(f"SELECT id, job_name, job_key FROM {self.prefix}job_instance WHERE id = ?", number)
        return JobInstance(*found[0]) if found else None

    def instances(self, name: str, start: int = 0, count: int = 20) -> list[JobInstance]:
        return [JobInstance(*r) for r in self._all(f"SELECT id, job_name, job_key FROM {self.prefix}job_instance WHERE job_name = ? ORDER BY id DESC LIMIT ? OFFSET ?", name, count, start)]

    def job_names(self) -> list[str]:
        return [r[0] for r in self._all(f"SELECT DISTINCT job_name FROM {self.prefix}job_instance ORDER BY job_name")]

    def create_execution(self, instance: JobInstance, parameters: JobParameters) -> JobExecution:
        out = JobExecution(instance, parameters, created=now())
        with self.transaction():
            out.id = self._run(f"INSERT INTO {self.prefix}job_execution (version, job_instance_id, create_time, status, exit_code, exit_message, last_updated, stop_requested) VALUES (0, ?, ?, 'STARTING', 'UNKNOWN', '', ?, 0)", instance.id, _stamp(out.created), _stamp(now())).lastrowid
            for p in parameters.values():
                self._run(f"INSERT INTO {self.prefix}job_execution_params VALUES (?, ?, ?, ?, ?)", out.id, p.name, p.type, None if p.value is None else p.text(), "Y" if p.identifying else "N")
        return out

    def _update(self, table: str, item: Any, values: dict[str, Any]) -> None:
        names = ", ".join(f"{k} = ?" for k in values)
        done = self._run(f"UPDATE {self.prefix}{table} SET version = version + 1, last_updated = ?, {names} WHERE id = ? AND version = ?", _stamp(now()), *values.values(), item.id, item.version)
        if done.rowcount == 0:
            raise OptimisticLockingFailure(f"{table} {item.id} has another version than {item.version}")
        item.version += 1

    def update_execution(self, e: JobExecution) -> None:
        self._update("job_execution", e, {"start_time": _stamp(e.start), "end_time": _stamp(e.end), "status": e.status.name, "exit_code": e.exit.code, "exit_message": e.exit.description[:4000]})

    def request_stop(self, execution: int) -> None:
        self._run(f"UPDATE {self.prefix}job_execution SET stop_requested = 1 WHERE id = ?", execution)

    def stop_requested(self, execution: int) -> bool:
        return bool(self._all(f"SELECT stop_requested FROM {self.prefix}job_execution WHERE id = ?", execution)[0][0])

    def execution(self, number: int) -> JobExecution | None:
        """With its parameters, context and step executions."""
        t = self.prefix
        rows = self._all(f"SELECT e.id, e.version, e.create_time, e.start_time, e.end_time, e.status, e.exit_code, e.exit_message, e.stop_requested, i.id, i.job_name, i.job_key FROM {t}job_execution e JOIN {t}job_instance i ON i.id = e.job_instance_id WHERE e.id = ?", number)
        if not rows:
            return None
        r = rows[0]
        out = JobExecution(JobInstance(*r[9:12]), self._parameters(number), r[0], r[1], BatchStatus[r[5]], ExitStatus(r[6], r[7]), _time(r[2]), _time(r[3]), _time(r[4]), stop_requested=bool(r[8]))
        out.context = self._context("job_execution", number)
        out.steps = [self._step(s, out) for s in self._all(f"SELECT id, version, step_name, start_time, end_time, status, exit_code, exit_message, {', '.join(COUNTERS)} FROM {t}step_execution WHERE job_execution_id = ? ORDER BY id", number)]
        return out

    def _step(self, r: tuple, job: JobExecution) -> StepExecution:
        out = StepExecution(r[2], job, r[0], r[1], BatchStatus[r[5]], ExitStatus(r[6], r[7]), _time(r[3]), _time(r[4]), dict(zip(COUNTERS, r[8:], strict=True)))
        out.context = self._context("step_execution", out.id)
        return out

    def _parameters(self, execution: int) -> JobParameters:
        read = {"STRING": str, "LONG": int, "DOUBLE": float, "DATE": datetime.fromisoformat}
        rows = self._all(f"SELECT param_name, param_type, param_value, identifying FROM {self.prefix}job_execution_params WHERE job_execution_id = ?", execution)
        return JobParameters({n: JobParameter(n, None if v is None else read[k](v), k, i == "Y") for n, k, v, i in rows})

    def executions(self, instance: JobInstance) -> list[JobExecution]:
        """Newest first."""
        return [self.execution(r[0]) for r in self._all(f"SELECT id FROM {self.prefix}job_execution WHERE job_instance_id = ? ORDER BY id DESC", instance.id)]

    def last_execution(self, instance: JobInstance) -> JobExecution | None:
        return next(iter(self.executions(instance)), None)

    def running(self, name: str) -> list[JobExecution]:
        t, marks = self.prefix, ", ".join("?" * len(RUNNING))
        return [self.execution(r[0]) for r in self._all(f"SELECT e.id FROM {t}job_execution e JOIN {t}job_instance i ON i.id = e.job_instance_id WHERE i.job_name = ? AND e.status IN ({marks}) ORDER BY e.id", name, *RUNNING)]

    # steps and contexts

    def add(self, step: StepExecution) -> None:
        step.id = self._run(f"INSERT INTO {self.prefix}step_execution (version, step_name, job_execution_id, status, exit_code, exit_message, {', '.join(COUNTERS)}, last_updated) VALUES (0, ?, ?, ?, ?, '', {', '.join('0' * len(COUNTERS))}, ?)", step.name, step.job.id, step.status.name, step.exit.code, _stamp(now())).lastrowid
        self.save_context(step)

    def update(self, step: StepExecution) -> None:
        self._update("step_execution", step, {"start_time": _stamp(step.start), "end_time": _stamp(step.end), "status": step.status.name, "exit_code": step.exit.code, "exit_message": step.exit.description[:4000], **{c: step.counts.get(c, 0) for c in COUNTERS}})

    def save_context(self, item: StepExecution | JobExecution) -> None:
        kind = "step_execution" if isinstance(item, StepExecution) else "job_execution"
        text = json.dumps(item.context, ensure_ascii=False)
        short, full = (text, None) if len(text) <= SHORT_CONTEXT else ("", text)
        self._run(f"INSERT INTO {self.prefix}{kind}_context VALUES (?, ?, ?) ON CONFLICT DO UPDATE SET short_context = excluded.short_context, serialized_context = excluded.serialized_context", item.id, short, full)
        item.context.dirty = False

    def _context(self, kind: str, number: int) -> ExecutionContext:
        rows = self._all(f"SELECT short_context, serialized_context FROM {self.prefix}{kind}_context WHERE {kind}_id = ?", number)
        return ExecutionContext(json.loads(rows[0][1] or rows[0][0] or "{}")) if rows else ExecutionContext()

    def last_step(self, instance: JobInstance, name: str) -> StepExecution | None:
        t = self.prefix
        rows = self._all(f"SELECT s.id, s.job_execution_id FROM {t}step_execution s JOIN {t}job_execution e ON e.id = s.job_execution_id WHERE e.job_instance_id = ? AND s.step_name = ? ORDER BY s.id DESC LIMIT 1", instance.id, name)
        return next(s for s in self.execution(rows[0][1]).steps if s.id == rows[0][0]) if rows else None

    def step_count(self, instance: JobInstance, name: str) -> int:
        t = self.prefix
        return self._all(f"SELECT COUNT(*) FROM {t}step_execution s JOIN {t}job_execution e ON e.id = s.job_execution_id WHERE e.job_instance_id = ? AND s.step_name = ?", instance.id, name)[0][0]

    # chunks

    def commit_chunk(self, execution: int, step: str, chunk: int, counters: dict[str, int]) -> None:
        self._run(f"INSERT OR REPLACE INTO {self.prefix}chunk_commit VALUES (?, ?, ?, ?)", execution, step, chunk, json.dumps(counters))

    def committed_chunks(self, execution: int, step: str) -> dict[int, dict[str, int]]:
        return {r[0]: json.loads(r[1]) for r in self._all(f"SELECT chunk_id, counters FROM {self.prefix}chunk_commit WHERE job_execution_id = ? AND step_name = ? ORDER BY chunk_id", execution, step)}

    # deletion

    def delete_execution(self, number: int) -> None:
        t = self.prefix
        with self.transaction():
            if not self._all(f"SELECT 1 FROM {t}job_execution WHERE id = ?", number):
                raise NoSuchJobExecution(str(number))
            self._run(f"DELETE FROM {t}step_execution_context WHERE step_execution_id IN (SELECT id FROM {t}step_execution WHERE job_execution_id = ?)", number)
            for name in ("step_execution", "job_execution_params", "job_execution_context", "chunk_commit"):
                self._run(f"DELETE FROM {t}{name} WHERE job_execution_id = ?", number)
            self._run(f"DELETE FROM {t}job_execution WHERE id = ?", number)

    def delete_instance(self, number: int) -> None:
        with self.transaction():
            for (e,) in self._all(f"SELECT id FROM {self.prefix}job_execution WHERE job_instance_id = ?", number):
                self.delete_execution(e)
            self._run(f"DELETE FROM {self.prefix}job_instance WHERE id = ?", number)

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        """A table as a DataFrame with its fixed schema."""
        columns = [c.strip().split(" ") for c in TABLES[table].split(",")]
        read = {"timestamp": _time, "boolean": lambda v: None if v is None else bool(v)}
        rows = self._all(f"SELECT {', '.join(n for n, _ in columns)} FROM {self.prefix}{table}")
        return spark.createDataFrame([tuple(read.get(k, lambda v: v)(v) for v, (_, k) in zip(r, columns, strict=True)) for r in rows], TABLES[table])


# the same questions over metadata of any size, as plans


def with_instance(executions: DataFrame, instances: DataFrame) -> DataFrame:
    return executions.join(instances.select(F.col("id").alias("job_instance_id"), "job_name", "job_key"), "job_instance_id")


def running_executions(executions: DataFrame, instances: DataFrame) -> DataFrame:
    return with_instance(executions.where(F.col("status").isin(*RUNNING)), instances)


def last_step_executions(steps: DataFrame, executions: DataFrame) -> DataFrame:
    """The newest step execution of each instance and step, by an aggregate: no sort, no window."""
    placed = steps.join(executions.select(F.col("id").alias("job_execution_id"), "job_instance_id"), "job_execution_id")
    rest = [c for c in placed.columns if c not in ("job_instance_id", "step_name")]
    return placed.groupBy("job_instance_id", "step_name").agg(F.max_by(F.struct(*rest), "id").alias("last")).select("job_instance_id", "step_name", "last.*")


def step_start_counts(steps: DataFrame, executions: DataFrame) -> DataFrame:
    placed = steps.select("job_execution_id", "step_name").join(executions.select(F.col("id").alias("job_execution_id"), "job_instance_id"), "job_execution_id")
    return placed.groupBy("job_instance_id", "step_name").agg(F.count("*").alias("starts"))


def execution_counts(executions: DataFrame, instances: DataFrame) -> DataFrame:
    return with_instance(executions, instances).groupBy("job_name").agg(F.count("*").alias("executions"), F.countDistinct("job_instance_id").alias("instances"))


def instances_page(instances: DataFrame, name: str, start: int, count: int) -> DataFrame:
    return instances.where(F.col("job_name") == name).orderBy(F.desc("id")).offset(start).limit(count)


def recent_by_status(executions: DataFrame, instances: DataFrame, status: str | None, limit: int) -> DataFrame:
    """Executions of each job's newest `limit` instances, by status if given."""
    newest = Window.partitionBy("job_name").orderBy(F.desc("id"))
    listed = instances.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit).drop("rank")
    return with_instance(executions if status is None else executions.where(F.col("status") == status), listed)


def survivors(steps: DataFrame, deleted: DataFrame) -> DataFrame:
    """Step executions that a cascade over the deleted executions (id) leaves."""
    return steps.join(deleted.select(F.col("id").alias("job_execution_id")), "job_execution_id", "left_anti")


def merge_latest(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An upsert: of each key's changes the latest, and of the current rows those without one. Both have the same columns."""
    rest = [c for c in changes.columns if c not in keys]
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))
    return current.join(latest.select(*keys), keys, "left_anti").select(*changes.columns).unionByName(latest)


def roll_up(executions: DataFrame) -> DataFrame:
    """With the duration in milliseconds and whether the execution failed to complete."""
    spent = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1000
    return executions.withColumn("duration_ms", spent).withColumn("failed", F.col("status") != "COMPLETED")
