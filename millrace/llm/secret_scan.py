"""Secret scanning with multipart credential linking, in DataFrame functions alone.

Strong patterns are reported as they stand. Weak parts (login names, short or
opaque values, endpoints) are common in clean text, so they are reported only
where complementary parts co-occur: parts are cut into cells by their start,
an interval join pairs those of one scope (a paragraph between blank lines)
whose starts lie within `window` code points, and a part counts if the roles
found beside it complete it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, fresh
from millrace.llm.sieve import marked, sieve

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LOGIN = r"""(?i:\b(?:user(?:_?name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?i:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|rediss?|amqps?|s3)://[A-Za-z0-9._~:@/-]+"
#: In the order in which kinds at one start are listed; `short` are assignments whose value is too short for `assign`.
KINDS = ("assign", "access", "hex", "login", "opaque", "short", "endpoint")
STRONG = KINDS[:3]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", "login": "id", "opaque": "secret", "short": "secret", "endpoint": "endpoint"}
#: A cheap test that every match of a costly pattern passes.
GUARDS = {"login": r"(?i)user|login|client_?id|account", "endpoint": "://"}
WINDOW, LEAST_VALUE, LEAST_SHORT = 200, 8, 4
BREAK = r"\n\n"


def _found(kind: str, pattern: str, text: Column) -> Column:
    """struct(kind, matches, code points before each and after the last) of all leftmost matches, null if none."""
    guard = text.contains(GUARDS[kind]) if kind == "endpoint" else text.rlike(GUARDS.get(kind, pattern))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return F.when(guard, F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), gaps.alias("gaps")))


def _lookup(values: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def scan(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, spans (array of struct start, end, kind, strong, in order of start, then kind).

    Positions are code points, ends exclusive. A null text is an empty one; null
    and repeated ids keep a row each; other columns are not read. A weak login
    needs a secret near it, a weak secret an id or an endpoint, an endpoint both
    an id and a secret. Assignments with values of 4 to 7 characters are weak.
    """
    scratch = Scratch(docs.sparkSession, "secret-scan")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "login": LOGIN, "opaque": OPAQUE, "endpoint": ENDPOINT}
    found = F.array_compact(F.array(*(_found(k, p, text) for k, p in patterns.items())))
    raw = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text"), found.alias("found"))
    breaks = F.when(F.size("found") > 0, F.array_compact(F.array(_found("break", BREAK, F.col("text")))))
    held = scratch.keep(raw.select("row", "doc_id", F.concat("found", F.coalesce(breaks, F.filter("found", lambda x: F.lit(False)))).alias("found")), "found")

    # positions: what stands before a match is all earlier gaps and matches of its kind
    one = held.where(F.size("found") > 0).select("row", F.explode("found").alias("f"))
    each = one.select("row", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("f.matches").alias("m"), F.col("f.gaps").alias("g"))).alias("i", "z")).where("z.m is not null")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("row", "kind", F.col("z.m").alias("m"), F.sum(F.col("z.g") + F.char_length("z.m")).over(so_far).alias("end"))
    value = F.char_length(F.regexp_extract("m", ASSIGN, 2))
    kind = F.when(F.col("kind") != "assign", F.col("kind")).when(value >= LEAST_VALUE, "assign").when(value >= LEAST_SHORT, "short")
    parts = each.select("row", kind.alias("kind"), (F.col("end") - F.char_length("m")).alias("start"), "end").where("kind is not null")
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("scope", F.sum((F.col("kind") == "break").cast("long")).over(before)).where("kind <> 'break'")
    parts = scratch.keep(parts.withColumn("strong", F.col("kind").isin(*STRONG)).withColumn("role", _lookup(ROLES, F.col("kind"))), "parts")

    # the interval join: each weak part against the parts of its own and the two neighbouring cells
    cell = F.floor(F.col("start") / window)
    weak = parts.where("not strong").select("row", "scope", "kind", "role", "start", "end", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = parts.select("row", "scope", cell.alias("cell"), F.col("role").alias("near_role"), F.col("start").alias("near_start"))
    pairs = weak.join(near, ["row", "scope", "cell"]).where(f"role <> near_role and abs(start - near_start) <= {window}")
    beside = pairs.groupBy("row", "kind", "role", "start", "end").agg(*(F.max(F.col("near_role") == r).alias(r) for r in ("id", "secret", "endpoint")))
    linked = beside.where("(role = 'id' and secret) or (role = 'secret' and (id or endpoint)) or (role = 'endpoint' and id and secret)")

    kept = parts.where("strong").select("row", "kind", "start", "end", "strong").union(linked.select("row", "kind", "start", "end", F.lit(False)))
    listed = F.array_sort(F.collect_list(F.struct("start", _order(F.col("kind")).alias("rank"), "end", "kind", "strong")))
    per_row = kept.groupBy("row").agg(listed.alias("spans"))
    out = held.select("row", "doc_id").join(per_row, "row", "left")
    empty = F.expr("cast(array() as array<struct<start: bigint, end: bigint, kind: string, strong: boolean>>)")
    shaped = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["strong"].alias("strong")))
    return out.select("doc_id", F.coalesce(shaped, empty).alias("spans"))


def masked(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs with every reported span's characters replaced by asterisks; null texts stay null.

    Other columns stay as they are, whatever their names; repeated rows and ids
    keep a row each. Rows without spans, most of them, aren't shuffled: a sieve of
    the others' numbers tells them apart, and an exact join follows for the rest.
    """
    scratch = Scratch(docs.sparkSession, "secret-mask")
    row, spans, may = (fresh(docs, n) for n in ("mask_row", "mask_spans", "mask_may"))
    numbered = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = scan(numbered, window, row, text_col).where(F.size("spans") > 0)
    found = scratch.keep(found.select(F.col("doc_id").alias(row), F.col("spans").alias(spans)), "spans")
    told = marked(numbered, row, sieve(found, row), may)
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(_blotted(F.col(text_col), F.col(spans)))
    exact = told.where(may).join(found.hint("merge"), row, "left").withColumn(text_col, text)
    return told.where(~F.col(may)).select(*map(_named, docs.columns)).union(exact.select(*map(_named, docs.columns)))


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _blotted(text: Column, spans: Column, piece: int = 4096) -> Column:
    """The text with asterisks over the spans, which are in order of their starts; piece by piece, so that no span counts from the text's start."""

    def one(part: Column, i: Column) -> Column:
        low, high = i * piece, i * piece + F.char_length(part)
        start = F.struct(F.lit("").alias("done"), low.cast("long").alias("at"))

        def cut(a: Column, s: Column) -> Column:
            begin = F.greatest(a["at"], s["start"])
            end = F.greatest(begin, F.least(s["end"], high))
            between = F.substring(part, (a["at"] - low + 1).cast("int"), (begin - a["at"]).cast("int"))
            return F.struct(F.concat(a["done"], between, F.repeat(F.lit("*"), (end - begin).cast("int"))).alias("done"), end.cast("long").alias("at"))

        rest = lambda a: F.concat(a["done"], F.substring(part, (a["at"] - low + 1).cast("int"), F.lit(piece)))
        return F.aggregate(F.filter(spans, lambda s: (s["end"] > low) & (s["start"] < high)), start, cut, rest)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % piece), F.lit(0)), one), "")


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the strong kinds, the SHA-256 of their list, and the list of all spans."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["strong"]), line), ",")
    return scanned.select("doc_id", *map(count, STRONG), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))
