from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.functions import guards, records, typed
from millrace.plans.errors import JobExecutionError


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column).collect()]


def test_delimited_tokenizer_quotes_and_missing(spark):
    tokens = records.DelimitedTokenizer(("a", "b"))
    found = values(spark, ['1,"x ""y"", z"', "2", "3,"], tokens(F.col("t")))
    assert [tuple(r) for r in found] == [("1", 'x "y", z'), ("2", ""), ("3", "")]


def test_fixed_tokenizer_trims_unicode(spark):
    tokens = records.FixedTokenizer(((0, 3), (3, 6)), ("a", "b"))
    assert tuple(values(spark, ["ab  cd"], tokens(F.col("t")))[0]) == ("ab", "cd")
    with pytest.raises(ValueError):
        records.FixedTokenizer((), ())


def test_pattern_tokenizer_needs_a_match(spark):
    tokens = records.PatternTokenizer((("^A", records.FixedTokenizer(((1, 3),), ("code",))),))
    assert values(spark, ["Axy"], tokens(F.col("t"))["code"]) == ["xy"]
    with pytest.raises(Exception, match="no tokenizer"):
        values(spark, ["Bxy"], tokens(F.col("t"))["code"])


def test_formula_guard(spark):
    assert values(spark, ["=1'2", "-5", "a", None], records.delimited_line([F.col("t")])) == ["'=1''2", "'-5", "a", ""]


def test_typed_reads(spark):
    texts = ["12", " 12.9 ", "-3e1", "NaN", "abc", None, "9007199254740993", "1e400"]
    assert values(spark, texts, typed.read_long(F.col("t"))) == [12, 12, -30, None, None, None, 9007199254740993, None]
    assert values(spark, ["Yes", "0", None], typed.read_boolean(F.col("t"))) == [True, False, False]
    with pytest.raises(Exception, match="not a number"):
        values(spark, ["x"], typed.read_double(F.col("t"), strict=True))
    with pytest.raises(Exception, match="not a date"):
        values(spark, ["2024-13-01"], typed.read_date(F.col("t"), strict=True))


def test_redaction_truncates(spark):
    assert values(spark, ["password=hunter2 x", "jdbc:mysql://h/d y", None], typed.redact(F.col("t"))) == ["[REDACTED] x", "[REDACTED] y", None]
    assert values(spark, ["a" * 5000], typed.redact(F.col("t")))[0] == "a" * 4000 + "…[truncated]"


def test_guards(tmp_path):
    assert guards.quoted_identifier("a.b_1") == "`a`.`b_1`"
    for bad in ("a b", "a.b.c", "1a", "a;b"):
        with pytest.raises(ValueError):
            guards.quoted_identifier(bad)
    for bad in ("", "DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT 1 UNION SELECT 2", "SELECT sleep(1) FROM t WHERE x = sleep(1)"):
        with pytest.raises(ValueError):
            guards.check_select(bad)
    assert guards.check_select("SELECT 1") == "SELECT 1"
    assert guards.local_path(str(tmp_path / "x"), str(tmp_path)) == (tmp_path / "x").resolve()
    for bad in ("http://x/y", str(tmp_path / ".." / "y")):
        with pytest.raises(ValueError):
            guards.local_path(bad, str(tmp_path))
    for bad in (0, 501):
        with pytest.raises(ValueError):
            guards.list_limit(bad)
    with pytest.raises(ValueError):
        guards.queue_key("a b")


def test_signature():
    s = guards.sign("k", 5, "job", 1000, "key")
    guards.verify("k", 5, "job", s, 1000, "key", now=1001)
    for arguments in (("k", 6, "job", s, 1000, "key"), ("k", 5, "job", None, 1000, "key"), ("other", 5, "job", s, 1000, "key")):
        with pytest.raises(JobExecutionError):
            guards.verify(*arguments, now=1001)
    with pytest.raises(JobExecutionError):
        guards.verify("k", 5, "job", s, 1000, "key", now=1000 + guards.MESSAGE_AGE_SECONDS + 1)
    with pytest.raises(JobExecutionError):
        guards.verify("k", 5, "job", s, 1000, "key", now=600)


def test_parameters_and_binding(spark):
    assert guards.typed_parameters(["a:1", "b:1.5", "c:2024-01-02", "d:x:y", "e", "f:2024-99-99"]) == {"a": 1, "b": 1.5, "c": datetime(2024, 1, 2), "d": "x:y", "e": "", "f": "2024-99-99"}
    text = guards.bind("#{jobParameters['a']}/#{stepExecutionContext['b']}/#{jobExecutionContext['c']}", {"a": datetime(2024, 1, 2, tzinfo=timezone.utc)}, {"b": [1]}, {})
    assert text.endswith("/[1]/")
    assert guards.query(spark, "SELECT #{jobParameters['x']} AS v", job_parameters={"x": "a' OR 1=1"}).first()["v"] == "a' OR 1=1"
