"""Driver-side guards, signatures and late binding."""

from __future__ import annotations

import ast
import base64
import hashlib
import hmac
import json
import operator
import re
import time
from collections.abc import Callable, Mapping
from datetime import datetime
from pathlib import Path
from typing import Any

from millrace.plans.errors import JobExecutionError

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

# fixed values: statements and constructs that a raw query may not have
STATEMENTS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "GRANT", "REVOKE", "REPLACE", "MERGE")
CONSTRUCTS = (
    " union ", " into outfile ", " load_file", "into dumpfile", " outfile ", "exec ", "execute ", "call mysql.", "benchmark(",
    " information_schema", " pg_sleep", " waitfor ", " delay ", " sleep(", " xp_cmdshell", " get_lock(",
    " release_lock(", " version(", "@@version",
)
FORBIDDEN = (("\0", "NUL"), (";", "several statements"), ("--", "a comment"), ("/*", "a comment"), ("\u0085", "a line separator"), ("\u2028", "a line separator"), ("\u2029", "a line separator"))
KEY_LENGTH, LIST_LIMIT, EXPRESSION_LENGTH = 512, 500, 32_768
MESSAGE_AGE_SECONDS, LEEWAY_SECONDS = 7 * 24 * 3600, 300


def quoted_identifier(name: str) -> str:
    """A checked name, or schema.name, in backticks."""
    parts = name.split(".")
    if len(parts) > 2 or not all(IDENTIFIER.match(p) for p in parts):
        raise ValueError(f"not an SQL identifier: {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def check_fragment(sql: str, role: str = "query") -> str:
    """Refuse text that could hold a second statement, a comment, UNION or another unwanted construct."""
    lower = sql.lower()
    for bad, why in FORBIDDEN:
        if bad in sql:
            raise ValueError(f"unsafe SQL in {role}: {why}")
    if any(x in lower for x in CONSTRUCTS) or re.search(r"\bunion\b", lower):
        raise ValueError(f"unsafe SQL in {role}: a construct that isn't allowed")
    return sql


def check_select(sql: str, role: str = "query") -> str:
    """A fragment that is a statement which only reads."""
    check_fragment(sql, role)
    words = sql.split(None, 1)
    if not words:
        raise ValueError(f"unsafe SQL in {role}: empty")
    if words[0].upper() in STATEMENTS:
        raise ValueError(f"unsafe SQL in {role}: {words[0].upper()}")
    return sql


def local_path(path: str, base: str | None = None) -> Path:
    """A plain local path, within `base` once links are resolved."""
    if re.match(r"[a-z][a-z0-9+.-]*://", path, re.I) or "\0" in path or not path:
        raise ValueError(f"not a local path: {path!r}")
    full = Path(path).resolve()
    if base is not None and not full.is_relative_to(Path(base).resolve()):
        raise ValueError(f"{path!r} is outside {base!r}")
    return full


def queue_key(key: str) -> str:
    if not 1 <= len(key) <= KEY_LENGTH or not re.fullmatch(r"[A-Za-z0-9_.:{}\-]+", key):
        raise ValueError(f"not a queue key: {key[:40]!r}")
    return key


def list_limit(limit: int) -> int:
    if not 1 <= limit <= LIST_LIMIT:
        raise ValueError(f"limit must be between 1 and {LIST_LIMIT}")
    return limit


def execution_id(number: int) -> int:
    if number < 1:
        raise ValueError("an execution id is 1 or more")
    return number


def sign(secret: str, execution: int, job: str, issued: int | None = None, key: str | None = None) -> str:
    """HMAC-SHA256 of a message's fields, in URL-safe base64 without padding."""
    issued = int(time.time()) if issued is None else issued
    if not secret.strip() or issued < 1:
        raise ValueError("a signature needs a secret and a time")
    fields = [f"{'v2' if key is None else 'v3'}:{execution}", job, str(issued), *([] if key is None else [key])]
    return base64.urlsafe_b64encode(hmac.digest(secret.encode(), "\0".join(fields).encode(), hashlib.sha256)).decode().rstrip("=")


def verify(secret: str, execution: int, job: str, signature: str | None, issued: int, key: str | None = None, age: int = MESSAGE_AGE_SECONDS, now: float | None = None) -> None:
    """Refuse a message without a valid signature, too old, or from the future beyond the leeway."""
    now = time.time() if now is None else now
    if not secret.strip() or not signature or age < 60:
        raise JobExecutionError("the message has no signature to verify, or the limits are misconfigured")
    if issued < 1 or issued > now + LEEWAY_SECONDS or now - issued > age:
        raise JobExecutionError("the message's time is out of bounds")
    if not hmac.compare_digest(sign(secret, execution, job, issued, key), signature):
        raise JobExecutionError("the message's signature is invalid")


def typed_parameters(entries: list[str]) -> dict[str, Any]:
    """name:value texts with values as int, float, date or text; an entry without a colon has the value ''."""
    out: dict[str, Any] = {}
    for entry in entries:
        name, _, value = entry.partition(":")
        typed: Any = value
        if re.fullmatch(r"-?\d+", value):
            typed = int(value)
        elif re.fullmatch(r"-?\d+\.\d+", value):
            typed = float(value)
        elif re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?", value):
            try:
                typed = datetime.fromisoformat(value)
            except ValueError:
                typed = value
        out[name] = typed
    return out


_PLACE = re.compile(r"#\{\s*(jobParameters|stepExecutionContext|jobExecutionContext)\[\s*(['\"])(.*?)\2\s*\]\s*\}")


def bind(template: str, job_parameters: Mapping[str, Any] = (), step_context: Mapping[str, Any] = (), job_context: Mapping[str, Any] = ()) -> str:
    """Replace #{jobParameters['k']} and the like by values: none is '', a date ISO 8601, a list or map JSON."""
    if len(template) > EXPRESSION_LENGTH:
        raise ValueError("the template is too long")
    maps = {"jobParameters": dict(job_parameters), "stepExecutionContext": dict(step_context), "jobExecutionContext": dict(job_context)}

    def text(value: Any) -> str:
        if value is None:
            return ""
        if isinstance(value, datetime):
            return value.astimezone().isoformat(timespec="seconds") if value.tzinfo else value.isoformat(timespec="seconds") + "+00:00"
        if isinstance(value, (list, dict)):
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return ("1" if value else "") if isinstance(value, bool) else str(value)

    return _PLACE.sub(lambda m: text(maps[m[1]].get(m[3])), template)


_EXPRESSION = re.compile(r"#\{(.*?)\}", re.DOTALL)
_OPERATIONS: dict[type, Callable[..., Any]] = {
    ast.Add: operator.add,
    ast.Sub: operator.sub,
    ast.Mult: operator.mul,
    ast.Div: operator.truediv,
    ast.FloorDiv: operator.floordiv,
    ast.Mod: operator.mod,
    ast.Eq: operator.eq,
    ast.NotEq: operator.ne,
    ast.Lt: operator.lt,
    ast.LtE: operator.le,
    ast.Gt: operator.gt,
    ast.GtE: operator.ge,
    ast.In: lambda a, b: a in b,
    ast.NotIn: lambda a, b: a not in b,
    ast.USub: operator.neg,
    ast.Not: operator.not_,
}


def evaluate(expression: str, names: Mapping[str, Any]) -> Any:
    """An expression over named maps and values: literals, arithmetic, comparisons, and/or/not, a if c else b, m['k'] and m.k (none if missing).

    Nothing can be called, and nothing but the given names is seen.
    """
    if len(expression) > EXPRESSION_LENGTH:
        raise ValueError("the expression is too long")

    def value(node: ast.AST) -> Any:
        match node:
            case ast.Expression():
                return value(node.body)
            case ast.Constant():
                return node.value
            case ast.Name(id=name):
                if name not in names:
                    raise ValueError(f"unknown name {name}")
                return names[name]
            case ast.Subscript():
                held, key = value(node.value), value(node.slice)
                return held.get(key) if isinstance(held, Mapping) else held[key]
            case ast.Attribute(attr=key):
                held = value(node.value)
                if not isinstance(held, Mapping):
                    raise ValueError(f"{key} of something that is no map")
                return held.get(key)
            case ast.BinOp() if type(node.op) in _OPERATIONS:
                left, right = value(node.left), value(node.right)
                if isinstance(node.op, ast.Mult) and not all(isinstance(x, (int, float)) for x in (left, right)):
                    raise ValueError("only numbers can be multiplied")
                return _OPERATIONS[type(node.op)](left, right)
            case ast.UnaryOp() if type(node.op) in _OPERATIONS:
                return _OPERATIONS[type(node.op)](value(node.operand))
            case ast.BoolOp():
                out = None
                for part in node.values:
                    out = value(part)
                    if bool(out) == isinstance(node.op, ast.Or):
                        break
                return out
            case ast.Compare():
                left = value(node.left)
                for op, part in zip(node.ops, node.comparators, strict=True):
                    right = value(part)
                    if type(op) not in _OPERATIONS or not _OPERATIONS[type(op)](left, right):
                        return False
                    left = right
                return True
            case ast.IfExp():
                return value(node.body if value(node.test) else node.orelse)
            case ast.List() | ast.Tuple():
                return [value(x) for x in node.elts]
        raise ValueError(f"not allowed in an expression: {type(node).__name__}")

    try:
        return value(ast.parse(expression.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression}") from e


def bind_expressions(template: str, job_parameters: Mapping[str, Any] | None = None, step_context: Mapping[str, Any] | None = None, job_context: Mapping[str, Any] | None = None) -> Any:
    """A template whose #{...} are expressions: the value itself if it is one expression alone, else a text with them filled in."""
    names = {"jobParameters": job_parameters or {}, "stepExecutionContext": step_context or {}, "jobExecutionContext": job_context or {}}
    if (whole := _EXPRESSION.fullmatch(template)) and "#{" not in whole[1]:
        return evaluate(whole[1], names)
    return _EXPRESSION.sub(lambda m: "" if (v := evaluate(m[1], names)) is None else str(v), template)


def query(spark, template: str, **maps: Mapping[str, Any]):
    """spark.sql of a template whose places are bound as named parameters, never pasted into the text."""
    args: dict[str, Any] = {}
    names = {"jobParameters": maps.get("job_parameters") or {}, "stepExecutionContext": maps.get("step_context") or {}, "jobExecutionContext": maps.get("job_context") or {}}

    def place(m: re.Match) -> str:
        name = f"p{len(args)}"
        args[name] = names[m[1]].get(m[3])
        return f":{name}"

    return spark.sql(check_select(_PLACE.sub(place, template)), args)
