"""python -m millrace: start, list, show, restart, stop and abandon jobs.

--environment names a function, module:function, that gives an Operator with its
registered jobs; its store must be a file if several calls are to see the same executions.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Sequence
from datetime import timedelta

from millrace.plans.errors import BatchError
from millrace.plans.jobs import Operator
from millrace.plans.repository import now

#: Ends of the process: done, failed, wrongly called.
DONE, FAILED, WRONG = 0, 1, 2


def _operator(name: str) -> Operator:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function or "environment")()


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("millrace", description="jobs and their executions")
    out.add_argument("--environment", required=True, help="module:function that gives an Operator")
    commands = out.add_subparsers(dest="command", required=True)
    launch = commands.add_parser("launch", help="start a job")
    launch.add_argument("job")
    launch.add_argument("parameters", nargs="*", help="name:value")
    launch.add_argument("--next", action="store_true", help="with the parameters that its incrementer gives")
    listed = commands.add_parser("list", help="jobs, or the executions of one, newest first")
    listed.add_argument("job", nargs="?")
    listed.add_argument("--count", type=int, default=20)
    for name, text in (("status", "show an execution"), ("restart", "run a failed or stopped one again"), ("stop", "ask it to stop"), ("abandon", "give it up")):
        commands.add_parser(name, help=text).add_argument("execution", type=int)
    commands.add_parser("health", help="whether the store answers, and what runs")
    cleanup = commands.add_parser("cleanup", help="delete the instances of a job that ended long ago")
    cleanup.add_argument("job")
    cleanup.add_argument("--days", type=float, default=30)
    return out


def _listed(operator: Operator, job: str | None, count: int) -> list[str]:
    if job is None:
        return sorted({*operator.registry.names(), *operator.job_names()})
    return [operator.summary(e) for i in operator.instances(job, 0, count) for e in operator.executions(i)][:count]


def _cleaned(operator: Operator, job: str, days: float) -> int:
    repository, removed = operator.repository, 0
    for instance in repository.instances(job, 0, 1 << 31):
        last = repository.last_execution(instance)
        if last is None or (last.end is not None and now() - last.end > timedelta(days=days)):
            repository.delete_instance(instance.id)
            removed += 1
    return removed


def main(arguments: Sequence[str] | None = None) -> int:
    given = parser().parse_args(arguments)
    try:
        operator = _operator(given.environment)
        if given.command == "launch":
            number = operator.start_next(given.job) if given.next else operator.start(given.job, given.parameters)
            print(operator.summary(number))
            return FAILED if operator.repository.execution(number).status.unsuccessful else DONE
        if given.command == "list":
            print("\n".join(_listed(operator, given.job, given.count)))
        elif given.command == "status":
            print(operator.summary(given.execution))
            print("\n".join(operator.step_summaries(given.execution).values()))
        elif given.command == "restart":
            number = operator.restart(given.execution)
            print(operator.summary(number))
            return FAILED if operator.repository.execution(number).status.unsuccessful else DONE
        elif given.command == "stop":
            operator.stop(given.execution)
        elif given.command == "abandon":
            operator.abandon(given.execution)
            print(operator.summary(given.execution))
        elif given.command == "health":
            print(json.dumps({"store": "ok", "running": {n: operator.running(n) for n in operator.job_names()}}))
        else:
            print(_cleaned(operator, given.job, given.days))
        return DONE
    except BatchError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return FAILED
    except (ImportError, AttributeError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return WRONG


if __name__ == "__main__":
    sys.exit(main())
