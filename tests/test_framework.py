"""Builders, scopes, events, the command line, the test harness, expressions, and the chunk step's faults."""

from __future__ import annotations

import json
import sqlite3
import sys
import types

import pytest
from pyspark.sql import functions as F

from millrace import __main__ as cli
from millrace.functions import guards, records
from millrace.operators import chunks, faults, processors
from millrace.plans import builders, errors, events, jobs, repository, scopes, testing
from millrace.plans.domain import BatchStatus, ExitStatus, JobParameters
from millrace.sources import readers, writers


def chunk_builder(spark, path, n=25, size=10):
    return builders.StepBuilder("s").chunk(size).reader(lambda s, e: (s.range(n), ["id"])).writer(writers.ChunkDirectoryWriter(str(path)))


def rows(spark, path):
    return sorted(r["id"] for r in spark.read.parquet(str(path)).select("id").collect())


def test_step_with_item_retry_skip_and_hooks(spark, tmp_path):
    tried = set()

    def process(item):
        if item["id"] == 4 and not tried:
            tried.add(4)
            raise errors.TransientError("once")
        if item["id"] % 10 == 3:
            raise ValueError(f"bad {item['id']}")
        return None if item["id"] % 10 == 5 else item

    class Told:
        def __init__(self):
            self.skipped, self.written = [], []

        def on_skip_in_process(self, step, index, kind, message):
            self.skipped.append((index, kind, message))

        def after_write(self, step, chunk):
            self.written.append(chunk)

    told = Told()
    step = chunk_builder(spark, tmp_path / "a").each(process, "id long").retry(2, errors.TransientError).skip(3, ValueError).listener(told).build()
    found = testing.JobRunner(spark).job(builders.JobBuilder("j").start(step).build())
    assert found.status == BatchStatus.COMPLETED
    counts = found.steps[0].counts
    assert [counts[c] for c in ("read_count", "write_count", "filter_count", "process_skip_count", "commit_count")] == [25, 20, 2, 3, 3]
    assert rows(spark, tmp_path / "a") == [i for i in range(25) if i % 10 not in (3, 5)]
    assert told.skipped == [(i, "ValueError", f"bad {i}") for i in (3, 13, 23)] and told.written == [0, 1, 2]


def test_step_fails_where_the_skip_budget_ends(spark, tmp_path):
    def process(item):
        if item["id"] % 10 == 3:
            raise ValueError("bad")
        return item

    step = chunk_builder(spark, tmp_path / "a").each(process, "id long").skip(1, ValueError).build()
    found = testing.JobRunner(spark).job(jobs.Job("j", [step]))
    assert found.status == BatchStatus.FAILED and "skip limit of 1" in found.steps[0].exit.description
    assert found.steps[0].counts["commit_count"] == 1 and found.steps[0].counts["rollback_count"] == 1
    assert rows(spark, tmp_path / "a") == [i for i in range(10) if i != 3]


def test_step_fails_at_an_error_that_may_not_be_skipped_and_restarts(spark, tmp_path):
    broken = [True]

    def job():
        bad = broken[0]

        def process(item):
            if bad and item["id"] == 17:
                raise KeyError("no")
            return item

        return jobs.Job("j", [chunk_builder(spark, tmp_path / "a").each(process, "id long").skip(5, ValueError).build()])

    run, p = testing.JobRunner(spark), JobParameters.of(a=1)
    first = run.job(job(), p)
    broken[0] = False
    second = run.job(job(), p)
    assert first.status == BatchStatus.FAILED and "KeyError" in first.steps[0].exit.description and second.status == BatchStatus.COMPLETED
    assert second.steps[0].counts["read_count"] == 15 and rows(spark, tmp_path / "a") == list(range(25))


def test_item_hooks_run_in_the_workers(spark, tmp_path):
    path = str(tmp_path / "log")

    class Log:
        def _put(self, text):
            with open(path, "a") as f:
                f.write(text + "\n")

        def before_process(self, item):
            self._put(f"before {item['id']}")

        def after_process(self, item, result):
            self._put(f"after {item['id']} {result is None}")

        def on_process_error(self, item, error):
            self._put(f"error {item['id']} {type(error).__name__}")

    def process(item):
        if item["id"] == 1:
            raise ValueError("bad")
        return None if item["id"] == 2 else item

    step = chunk_builder(spark, tmp_path / "a", 3).each(process, "id long", [Log()]).skip(1, "ValueError").build()
    assert testing.JobRunner(spark).step(jobs.Job("j", [step]), "s").status == BatchStatus.COMPLETED
    assert sorted((tmp_path / "log").read_text().split("\n")[:-1]) == ["after 0 False", "after 2 True", "before 0", "before 1", "before 2", "error 1 ValueError"]


def test_reads_are_tried_again(spark, tmp_path):
    calls = []

    def reader(s, e):
        calls.append(1)
        if len(calls) == 1:
            raise errors.TransientError("gone for a moment")
        return s.range(3), ["id"]

    step = builders.StepBuilder("s").chunk(5).reader(reader).retry_reads(faults.RetryTemplate(faults.SimpleRetry(2, {errors.TransientError: True}))).writer(writers.ChunkDirectoryWriter(str(tmp_path / "a"))).build()
    assert testing.JobRunner(spark).job(jobs.Job("j", [step])).status == BatchStatus.COMPLETED and len(calls) == 2


def test_ended_executions_are_refused(spark):
    done = testing.job_execution(status=BatchStatus.COMPLETED)
    with pytest.raises(errors.UnexpectedJobExecutionError):
        jobs.Job("j").execute(done, testing.JobRunner().runtime)


def tasklet(name, code="COMPLETED", ran=None):
    def run(step, runtime):
        if ran is not None:
            ran.append(name)
        if code == "FAILED":
            raise errors.StepExecutionError("as told")
        step.exit = ExitStatus(code)

    return builders.StepBuilder(name).tasklet(run).build()


def test_builders_check_what_they_make():
    with pytest.raises(ValueError, match="nothing to do"):
        builders.StepBuilder("s").build()
    with pytest.raises(ValueError, match="no writer"):
        builders.StepBuilder("s").chunk(3).reader(lambda s, e: None).build()
    with pytest.raises(ValueError, match="limit of one"):
        builders.StepBuilder("s").skip(0, ValueError)
    with pytest.raises(ValueError, match="twice"):
        builders.JobBuilder("j").start(tasklet("a")).next(tasklet("a")).build()
    with pytest.raises(errors.FlowExecutionError):
        builders.FlowBuilder("f").to(tasklet("a"))
    both = builders.StepBuilder("s").chunk(3).tasklet(lambda s, r: None).start_limit(2).allow_restart_complete().build()
    assert isinstance(both, jobs.TaskletStep) and both.start_limit == 2 and both.allow_restart_complete


def test_flow_builder():
    ran = []
    a, b, c = tasklet("a", ran=ran), tasklet("b", ran=ran), tasklet("c", ran=ran)
    flow = builders.FlowBuilder("f").start(a).decider(lambda job, step: "LEFT").on("LEFT").to(b).source(a).on("*").to(c).source("b").on("COMPLETED").end("DONE").build()
    found = testing.JobRunner().job(builders.JobBuilder("j").flow(flow).build())
    assert ran == ["a", "b"] and found.status == BatchStatus.COMPLETED and found.exit.code == "DONE"
    failing = builders.FlowBuilder("f").start(tasklet("x")).on("COMPLETED").fail().build()
    assert testing.JobRunner().job(builders.JobBuilder("j").flow(failing).build()).status == BatchStatus.FAILED


def test_scopes_live_as_long_as_their_execution():
    made, dropped = [], []
    step_scope = scopes.Scope("step")
    step_scope.register("value", lambda e: made.append(e.name) or f"of {e.name}", dropped.append)
    seen = []

    def run(step, runtime):
        seen.append((step_scope.get("value", step), step_scope.get("value", step)))

    steps = [builders.StepBuilder(n).tasklet(run).listener(scopes.ScopeListener(step_scope)).build() for n in ("a", "b")]
    assert testing.JobRunner().job(jobs.Job("j", steps)).status == BatchStatus.COMPLETED
    assert seen == [("of a", "of a"), ("of b", "of b")] and made == ["a", "b"] and dropped == ["of a", "of b"]
    with pytest.raises(errors.ScopeNotActiveError):
        step_scope.get("value", testing.step_execution())


def test_events_marked_hooks_and_stopwatch(spark, tmp_path):
    got, clock = [], iter(range(100))

    class Own:
        @events.hook("after_step")
        def anything(self, step):
            got.append("hooked")
            return ExitStatus("FAILED", "by a hook")

    watch = events.Stopwatch(lambda: next(clock))
    step = chunk_builder(spark, tmp_path / "a", 4).listener(events.EventListener(lambda e: got.append((e.name, e.chunk))), events.Hooked(Own()), watch).build()
    found = testing.JobRunner(spark).job(builders.JobBuilder("j").start(step).listener(events.EventListener(lambda e: got.append(e.name)), watch).build())
    assert got == ["before_job", ("before_step", None), ("before_chunk", 0), ("after_chunk", 0), ("after_step", None), "hooked", "after_job"]
    assert found.steps[0].exit.code == "FAILED" and set(watch.seconds) == {"job j", "step s", "chunk s 0"}
    with pytest.raises(ValueError, match="no hook"):
        events.hook("after_dinner")


@pytest.fixture
def environment(tmp_path):
    module = types.ModuleType("made_environment")
    ran = []

    @jobs.batch_job("good")
    def good():
        return builders.JobBuilder("good").start(tasklet("a", ran=ran)).incrementer(jobs.run_id_incrementer()).build()

    @jobs.batch_job("bad")
    def bad():
        return builders.JobBuilder("bad").start(tasklet("a", "FAILED")).build()

    module.good, module.bad = good, bad

    def make():
        out = jobs.environment(path=str(tmp_path / "store.db"))
        out.registry.scan(module)
        return out

    module.environment = make
    sys.modules["made_environment"] = module
    yield "made_environment:environment"
    del sys.modules["made_environment"]


def test_command_line(environment, capsys):
    call = lambda *a: (cli.main(["--environment", environment, *a]), capsys.readouterr())
    code, out = call("launch", "good", "run.id:7")
    assert code == 0 and "status=COMPLETED" in out.out
    assert call("launch", "good", "--next")[0] == 0 and call("launch", "bad")[0] == 1
    assert call("list")[1].out.split() == ["bad", "good"]
    listed = call("list", "good")[1].out.strip().splitlines()
    assert len(listed) == 2 and listed[0].startswith("JobExecution[id=2")
    assert "StepExecution[name=a" in call("status", "1")[1].out
    assert call("restart", "3")[0] == 1 and call("restart", "1")[0] == 1 and "JobInstanceAlreadyComplete" in call("restart", "1")[1].err
    assert call("stop", "1")[0] == 1 and call("status", "99")[0] == 1
    assert "ABANDONED" in call("abandon", "3")[1].out
    assert json.loads(call("health")[1].out) == {"store": "ok", "running": {"bad": [], "good": []}}
    assert call("cleanup", "good", "--days", "0")[1].out.strip() == "2" and call("list", "good")[1].out.strip() == ""
    assert cli.main(["--environment", "no_such_module:f", "list"]) == 2


def test_registry_finds_steps_and_marked_factories(environment):
    operator = sys.modules["made_environment"].environment()
    assert operator.registry.names() == ["bad", "good"] and operator.registry.step("good", "a").name == "a"
    with pytest.raises(errors.NoSuchStep):
        operator.registry.step("good", "z")


def test_tracing_launcher_notes_each_run():
    run = testing.JobRunner()
    trace = jobs.TracingLauncher(jobs.Launcher(run.runtime), iter(range(9)).__next__)
    p = JobParameters.of(a=1)
    trace.run(jobs.Job("j", [tasklet("a")]), p)
    with pytest.raises(errors.JobInstanceAlreadyComplete):
        trace.run(jobs.Job("j", [tasklet("a")]), p)
    assert [(e["job"], e["status"], e["seconds"]) for e in trace.seen] == [("j", "COMPLETED", 1), ("j", None, 1)] and "AlreadyComplete" in trace.seen[1]["error"]


def test_signals_stop_running_executions():
    import os
    import signal

    run, ran = testing.JobRunner(), []

    def first(step, runtime):
        os.kill(os.getpid(), signal.SIGTERM)
        ran.append("first")

    with jobs.SignalStop(run.runtime):
        found = run.job(jobs.Job("j", [builders.StepBuilder("a").tasklet(first).build(), tasklet("b", ran=ran)]))
    assert found.status == BatchStatus.STOPPED and ran == ["first"]


def test_single_steps_files_and_rows(spark, tmp_path):
    seen = []
    job = jobs.Job("j", [tasklet("a"), builders.StepBuilder("b").tasklet(lambda s, r: seen.append(s.job.context.get("k"))).build()])
    run = testing.JobRunner(spark)
    assert run.step(job, "b", context={"k": 5}).status == BatchStatus.COMPLETED and seen == [5]
    with pytest.raises(KeyError):
        run.step(job, "z")
    assert run.remove_all("j.b") == 1 and run.runtime.repository.instances("j.b") == []
    (tmp_path / "x").write_text("a\nb\n")
    (tmp_path / "y").write_text("a\nc\n")
    testing.assert_same_lines(tmp_path / "x", tmp_path / "x")
    with pytest.raises(AssertionError, match="line 2"):
        testing.assert_same_lines(tmp_path / "x", tmp_path / "y")
    testing.assert_same_rows(spark.range(3), spark.range(3).orderBy(F.desc("id")))
    with pytest.raises(AssertionError, match="missing"):
        testing.assert_same_rows(spark.range(3), spark.range(2))


def test_expressions():
    names = {"jobParameters": {"n": 4, "name": "x y"}, "stepExecutionContext": {"list": [1, 2]}}
    assert guards.evaluate("jobParameters['n'] * 2 + 1", names) == 9
    assert guards.evaluate("jobParameters.n > 3 and not jobParameters.missing", names) is True
    assert guards.evaluate("'a' if 2 in stepExecutionContext.list else 'b'", names) == "a"
    assert guards.bind_expressions("#{jobParameters.n // 3}", {"n": 10}) == 3
    assert guards.bind_expressions("in/#{jobParameters.name}/#{jobParameters.none}.csv", {"name": "x"}) == "in/x/.csv"
    for bad in ("__import__('os')", "jobParameters.__class__.x", "other", "(lambda: 1)()", "1 +", "[1] * 99999999", "'a' * 99999999", "2 ** 99999", "[x for x in (1,)]"):
        with pytest.raises(ValueError):
            guards.evaluate(bad, names)


def slow_square(item):
    return None if item["id"] == 3 else {"id": item["id"], "square": item["id"] ** 2}


def test_concurrent_processor_keeps_order(spark):
    found = processors.concurrent(slow_square, "id long, square long", 4)(spark.range(10).coalesce(1)).collect()
    assert [tuple(r) for r in found] == [(i, i * i) for i in range(10) if i != 3]


def test_more_field_rules(spark):
    rules = processors.rules_of({"v": ["email", "most_length:7"], "n": ["between:1,5", "integer"], "d": ["date"], "w": ["same:v", "not_in:x|y"]})
    df = spark.createDataFrame([("a@b.c", "3", "2025-01-31", "a@b.c"), ("a.b.c.d.e", "7", "2025-02-31", "x"), (None, None, None, None)], "v string, n string, d string, w string")
    found = df.select(*(r.alias(n) for n, r in rules.items())).collect()
    assert [list(r) for r in found] == [[True] * 7, [False, False, False, True, False, False, False], [True] * 7]


def test_worker_processes(tmp_path):
    step = jobs.PartitionStep("p", low=1, high=10, grid=3, worker=partition_worker, processes=True)
    found = testing.JobRunner().job(jobs.Job("j", [step]))
    assert found.status == BatchStatus.COMPLETED and found.steps[0].counts["write_count"] == 10


def partition_worker(spark, name, low, high):
    assert spark is None
    return {"write_count": high - low + 1}


def test_isolation_and_savepoints(tmp_path):
    with pytest.raises(ValueError):
        repository.JobRepository(isolation="LOOSE")
    store = repository.JobRepository(str(tmp_path / "a.db"), isolation="EXCLUSIVE")
    with store.transaction():
        store.instance("a", JobParameters.of(k=1))
        with pytest.raises(RuntimeError), store.transaction():
            store.instance("b", JobParameters.of(k=1))
            raise RuntimeError("inner")
    assert store.job_names() == ["a"]


def test_batched_writes_are_one_transaction(spark, tmp_path):
    path = str(tmp_path / "db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t (k INTEGER PRIMARY KEY, v INTEGER CHECK (v < 2500))")
    db.commit()
    good = spark.range(2500).select(F.col("id").alias("k"), F.col("id").alias("v")).coalesce(1)
    writer = writers.DbApiWriter(lambda: sqlite3.connect(path), writers.upsert_statement("t", ["k", "v"], ["k"]), ["k", "v"], batch=400)
    writer.write(good)
    assert db.execute("SELECT count(*), sum(v) FROM t").fetchone() == (2500, 2500 * 2499 // 2)
    with pytest.raises(Exception, match="CHECK"):
        writer.write(good.withColumn("v", F.when(F.col("k") == 2000, 9999).otherwise(0)))
    assert db.execute("SELECT sum(v) FROM t").fetchone() == (2500 * 2499 // 2,)


class Server:
    """A key-value server in a folder."""

    def __init__(self, path):
        self.path = path

    def _put(self, name, value):
        with open(f"{self.path}/{name}", "a") as f:
            f.write(json.dumps(value) + "\n")

    def push_once(self, key, token, texts):
        import os

        try:
            os.close(os.open(f"{self.path}/token-{token}", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return
        self._put(key, texts)

    def add(self, key, texts):
        self._put(key, texts)

    def append(self, key, entries):
        self._put(key, entries)


def test_queue_writes_repeat_nothing(spark, tmp_path):
    path = str(tmp_path)
    read = lambda key: [x for line in (tmp_path / key).read_text().splitlines() for x in json.loads(line)]
    for _ in range(2):
        writers.QueueWriter(lambda: Server(path), "l", 3).write(spark.range(10).repartition(2, "id"))
        writers.QueueWriter(lambda: Server(path), "x", 3, readers.QueueStructure.STREAM).write(spark.range(10).coalesce(1))
        writers.QueueWriter(lambda: Server(path), "s", 3, readers.QueueStructure.SET).write(spark.range(10))
    assert sorted(map(int, read("l"))) == list(range(10)) and {x for x in read("s")} == set(map(str, range(10)))
    assert {tuple(x) for x in read("x")} == {(f"0-0-{i}", str(i)) for i in range(10)}


class Held:
    items = [f"v{i}" for i in range(7)]

    def length(self, key):
        return len(self.items)

    def range(self, key, start, count):
        return self.items[start : start + count]

    def scan(self, key, cursor, count):
        end = cursor + count
        return (end if end < len(self.items) else 0), self.items[cursor:end]

    def after(self, key, last, count):
        return [(str(i + 1), v) for i, v in enumerate(self.items) if i >= int(last)][:count]


@pytest.mark.parametrize("structure", list(readers.QueueStructure))
def test_queue_structures(structure):
    source = readers._QueueBatch(Held, "k", 3, structure, 3 if structure is readers.QueueStructure.LIST else 1)
    assert [x for p in source.partitions() for x in source.read(p)] == [(i, f"v{i}") for i in range(7)]
    if structure is readers.QueueStructure.STREAM:
        stream = readers._QueueStream(Held, "k", 3, structure)
        got, at = stream.read(stream.initialOffset())
        more, end = stream.read(at)
        assert [v for _, v in (*got, *more)] == [f"v{i}" for i in range(6)] and end == {"at": 6, "id": "6"}
        assert list(stream.readBetweenOffsets(at, end)) == [(i, f"v{i}") for i in (3, 4, 5)]


class Outbox:
    def __init__(self, path):
        self.path = path

    def send(self, message):
        with open(self.path, "a") as f:
            f.write(message + "\n")


def test_messages_merges_and_resources(spark, tmp_path):
    path = str(tmp_path / "mail")
    writers.MessageWriter(lambda: Outbox(path), lambda r: f"to {r['id']}").write(spark.range(3).coalesce(1))
    assert (tmp_path / "mail").read_text() == "to 0\nto 1\nto 2\n"
    merge = writers.MergeWriter(str(tmp_path / "t"), ["k"], "at")
    merge.write(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int"))
    merge.write(spark.createDataFrame([(2, "c", 2), (3, "d", 0), (1, "old", 0)], "k int, v string, at int"))
    assert sorted(map(tuple, spark.read.parquet(merge.path).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 0)]
    assert readers.with_resource(readers.ParquetReader("a"), "b").path == "b"
    shared = readers.SynchronizedReader(readers.ListReader([1, 2], "value int"))
    assert shared.to_df(spark).count() == 2
    with pytest.raises(errors.ItemReaderError):
        readers.ScriptedReader([1, errors.ItemReaderError("gone")], "value int").to_df(spark)


def test_pages_are_ranges_of_one_numbering(spark):
    spark.range(25).createOrReplaceTempView("numbers_of_pages")
    reader = readers.PagedReader(readers.PagingQuery("id", "numbers_of_pages", None, "id DESC"), 10)
    assert [[r["id"] for r in p.collect()] for p in reader.pages(spark, 7)] == [[17, 16, 15], list(range(14, 4, -1)), list(range(4, -1, -1))]


def test_resumed_keeps_the_order(spark):
    found = readers.resumed(spark.range(50).repartition(4), ["id"], 20, 30)
    assert [r["id"] for r in found.collect()] == list(range(20, 30))


def test_pretty_arrays_and_appended_lines(spark, tmp_path):
    path = str(tmp_path / "a.json")
    rows_ = [(1, 'q"}{', None, [1, 2]), (2, "é\n", 1.5, [])]
    df = spark.createDataFrame(rows_, "id int, `a b` string, x double, l array<int>")
    for pretty in (True, False):
        writers.JsonArrayWriter(path, ["id"], pretty).write(df)
        text = (tmp_path / "a.json").read_text()
        assert json.loads(text) == [{"id": i, "a b": s, "x": x, "l": v} for i, s, x, v in rows_]
        assert ('\n    "a b": ' in text) is pretty
    for _ in range(2):
        writers.LineWriter(str(tmp_path / "lines"), F.col("id").cast("string"), ["id"], header="h", append=True).write(spark.range(2))
    assert "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*"))) == "h\n0\n1\nh\n0\n1\n"


def test_fields_are_checked(spark):
    df = spark.createDataFrame([(["a", "b"],)], "v array<string>")
    assert tuple(df.select(records.field_at(F.col("v"), 1), records.field_named(["x", "y"], F.col("v"), "x")).first()) == ("b", "a")
    with pytest.raises(ValueError, match="no field is named"):
        records.field_named(["x"], F.col("v"), "z")
    with pytest.raises(Exception, match="no field is at 2"):
        df.select(records.field_at(F.col("v"), 2)).collect()


def test_chunk_parts_and_repeat_template(spark):
    written = []
    provided = chunks.OrderedChunks(["id"], 4).provide(spark.range(10))
    processor = chunks.WritingProcessor(processors.filtering("id % 2 = 0"), lambda df, n: written.append((n, sorted(r["id"] for r in df.collect()))))
    for n in range(3):
        processor.process(provided.where(F.col("chunk_id") == n), n)
    assert written == [(0, [0, 2]), (1, [4, 6]), (2, [8])]

    class Told:
        def __init__(self):
            self.rounds = []

        def after(self, context, results):
            self.rounds.append(results)

    told, left = Told(), iter([chunks.CONTINUABLE] * 5 + [chunks.FINISHED] * 9)
    assert chunks.RepeatTemplate(listeners=[told], workers=3).iterate(lambda c: next(left)) == chunks.FINISHED and len(told.rounds) == 2
    assert chunks.RepeatTemplate(chunks.CountPolicy(4)).iterate(lambda c: chunks.CONTINUABLE) == chunks.CONTINUABLE


def test_stateful_retry_without_recovery():
    store = faults.MemoryStore()

    def fail():
        raise errors.TransientError("no")

    for _ in range(2):
        with pytest.raises(errors.TransientError):
            faults.StatefulRetry(2, store).execute("k", fail)
    with pytest.raises(errors.ExhaustedRetryError):
        faults.StatefulRetry(2, store).execute("k", fail)
