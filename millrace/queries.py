"""Queries over the star-schema tables, one per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import guards, records, typed
from millrace.operators import chunks, faults, partitioning, processors, staging
from millrace.plans import builders, errors, jobs, repository
from millrace.plans.domain import JobParameters, StepExecution
from millrace.sources import readers, writers
from millrace.streaming import chunk_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

CHUNK, GRID, PAGE, ROLL = 500, 6, 100, 1000


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has any."""

    def mark(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return mark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# projections, filters, validation


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 30")
def filter_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.filtering("l_returnflag = 'R' and l_quantity > 30")(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey AS id, upper(o_orderstatus) AS status, o_totalprice * 2 AS doubled FROM orders WHERE o_totalprice > 100000 AND o_totalprice * 2 < 900000")
def composite_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = processors.composite(processors.filtering("o_totalprice > 100000"), processors.mapping(id="o_orderkey", status="upper(o_orderstatus)", doubled="o_totalprice * 2"), processors.filtering("doubled < 900000"))
    return steps(table(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def pass_through_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.chain()(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


@query("SELECT p_partkey, lower(p_name) AS name, CAST(p_retailprice AS DECIMAL(18, 2)) AS price FROM part")
def transform_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = processors.mapping(p_partkey="p_partkey", name="lower(p_name)", price="cast(p_retailprice as decimal(18, 2))")
    return readers.MappedReader(readers.ParquetReader(f"{sf_dir}/part.parquet"), mapped).to_df(spark)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY'")
def validate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processors.validating("c_acctbal >= 0 and c_mktsegment <> 'MACHINERY'", keep_valid=True)(table(spark, sf_dir, "customer")).select("c_custkey", "c_acctbal")


@query("""
SELECT c_custkey, concat_ws('; ', CASE WHEN NOT c_acctbal >= 0 THEN 'negative balance' END, CASE WHEN NOT c_nationkey < 20 THEN 'nation out of range' END,
  CASE WHEN NOT c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'MACHINERY') THEN 'unknown segment' END) AS messages FROM customer""")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"negative balance": "c_acctbal >= 0", "nation out of range": "c_nationkey < 20", "unknown segment": "c_mktsegment in ('BUILDING', 'HOUSEHOLD', 'MACHINERY')"}
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(processors.violations(rules), "; ").alias("messages"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0 AND s_acctbal <= 9000 AND regexp_matches(s_name, '^Supplier#[0-9]+$')")
def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = processors.rules_of({"s_acctbal": ["min:0", "max:9000"], "s_name": ["required", "regex:^Supplier#[0-9]+$"]})
    return processors.bean_validating(rules, keep_valid=True)(table(spark, sf_dir, "supplier")).select("s_suppkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'large' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'small' END AS class FROM orders")
def classify_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", processors.classify([("o_totalprice >= 400000", "large"), ("o_totalprice >= 100000", "medium")], "small").alias("class"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS target FROM orders")
def pattern_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", processors.lookup(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "other").alias("target"))


@query("SELECT p_partkey * 2 AS twice, upper(p_brand) AS brand FROM part WHERE p_size > 25")
def script_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = lambda item: {"twice": item["p_partkey"] * 2, "brand": item["p_brand"].upper()} if item["p_size"] > 25 else None
    return processors.script(call, "twice long, brand string")(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"))


# chunks and counters

_OUTCOME = "CASE WHEN o_totalprice < 50000 THEN 'process_skip' WHEN o_orderstatus = 'P' THEN 'filtered' ELSE 'written' END"
_COUNTS = """CAST(count(*) AS BIGINT) AS read_count, count(*) FILTER (outcome = 'written') AS write_count, count(*) FILTER (outcome = 'filtered') AS filter_count,
  CAST(0 AS BIGINT) AS read_skip_count, count(*) FILTER (outcome = 'process_skip') AS process_skip_count, CAST(0 AS BIGINT) AS write_skip_count"""


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_OUTCOME).alias("outcome"))
    return chunks.item_index(items, ["o_orderkey"]).withColumn("chunk_id", chunks.chunk_id(CHUNK))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS item_index FROM orders")
def item_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.item_index(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(f"SELECT chunk_id, {_COUNTS} FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // {CHUNK} AS chunk_id, {_OUTCOME} AS outcome FROM orders) GROUP BY chunk_id")
def chunk_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk_counters(_chunked(spark, sf_dir))


@query(f"SELECT {_COUNTS}, CAST(ceil(count(*) / {CHUNK}) AS BIGINT) AS commit_count FROM (SELECT {_OUTCOME} AS outcome FROM orders)")
def step_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.whole_totals(table(spark, sf_dir, "orders").select(F.expr(_OUTCOME).alias("outcome")), CHUNK)


@query("SELECT event_id, user_id, CAST(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS chunk_id FROM events")
def completion_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return chunks.boundary_chunks(events, F.col("event_type") == "purchase", ["user_id"], ["event_id"]).drop("event_type")


# sources


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT {PAGE} OFFSET {3 * PAGE}")
def page_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("paged_orders")
    return readers.PagedReader(readers.PagingQuery("o_orderkey, o_totalprice", "paged_orders", "o_orderstatus = 'F'", "o_orderkey"), PAGE).page(spark, 3)


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("paged_orders")
    return spark.sql(readers.PagingQuery("o_orderkey", "paged_orders", "o_orderstatus = 'F'").count())


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 250")
def max_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.resumed(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], most=250)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 1234")
def resume_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.resumed(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 1234)


@query("SELECT c_custkey AS k, c_name AS name, 0 AS resource_index FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier")
def multi_resource_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = readers.MappedReader(readers.ParquetReader(f"{sf_dir}/customer.parquet"), processors.mapping(k="c_custkey", name="c_name"))
    two = readers.MappedReader(readers.ParquetReader(f"{sf_dir}/supplier.parquet"), processors.mapping(k="s_suppkey", name="s_name"))
    return readers.MultiReader([one, two]).to_df(spark)


@query("SELECT c_nationkey, count(*) AS customers, max(c_custkey) AS last FROM customer WHERE c_acctbal > 500 GROUP BY c_nationkey")
def sql_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("cursor_customer")
    return readers.SqlReader("SELECT c_nationkey, count(*) AS customers, max(c_custkey) AS last FROM cursor_customer WHERE c_acctbal > :least GROUP BY c_nationkey", {"least": 500}).to_df(spark)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def criteria_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.CriteriaReader(lambda s: table(s, sf_dir, "orders"), {"o_orderstatus": "O", "o_orderpriority": ["1-URGENT", "2-HIGH"]}, ["o_orderkey"]).to_df(spark).select("o_orderkey")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "payloads")
    lines = F.regexp_replace("props", r"^\s*\{", F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", ")))
    table(spark, sf_dir, "events").select(lines.alias("value")).write.text(path)
    return readers.JsonLinesReader(path, "event_id long, k long").to_df(spark)


# sinks


@query("SELECT CASE WHEN event_type IN ('error', 'purchase') THEN event_type ELSE 'rest' END AS route, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def classified_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = processors.classify([("event_type = 'error'", "error"), ("event_type = 'purchase'", "purchase")], "rest")
    path = staging.folder(spark, "routes")
    routes = {r: writers.ParquetWriter(f"{path}/route={r}") for r in ("error", "purchase", "rest")}
    writers.RoutingWriter(route, routes).write(table(spark, sf_dir, "events").select("event_id", "event_type"))
    return spark.read.parquet(path).groupBy("route").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query(f"SELECT i // {ROLL} AS resource_index, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) GROUP BY 1")
def rolling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = chunks.item_index(table(spark, sf_dir, "events").select("event_id"), ["event_id"])
    path = staging.folder(spark, "rolling")
    writers.RollingWriter(path, limit=ROLL).write(indexed)
    found = spark.read.parquet(path).withColumn("resource_index", F.col("resource_index").cast("long"))
    return found.groupBy("resource_index").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT 'id,name' AS value UNION ALL SELECT c_custkey || ',' || c_name FROM customer UNION ALL SELECT 'END'")
def line_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "lines")
    writers.LineWriter(path, F.concat_ws(",", "c_custkey", "c_name"), ["c_custkey"], "id,name", "END").write(table(spark, sf_dir, "customer"))
    return spark.read.text(path)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{staging.folder(spark, 'array')}/nations.json"
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    writers.JsonArrayWriter(path, ["n_nationkey"]).write(nations)
    return readers.JsonReader(path, nations.schema).to_df(spark)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_lines_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "json-lines")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    writers.JsonLinesWriter(path).write(suppliers)
    return readers.JsonLinesReader(path, suppliers.schema).to_df(spark)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "csv")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    writers.LineWriter(path, records.delimited_line(parts.columns)).write(parts)
    return readers.CsvReader(path, parts.schema).to_df(spark)


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def merged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "merged")
    writer = writers.MergeWriter(path, ["c_custkey"], "version")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    writer.write(customers.withColumn("version", F.lit(1)))
    writer.write(customers.where("c_custkey % 2 = 0").withColumn("version", F.lit(2)))
    return spark.read.parquet(path)


# the chunk step: items under retry and skip, committed chunk by chunk

_GROUP = 5


def _step(spark: SparkSession, sf_dir: str, limit: int) -> tuple[StepExecution, DataFrame]:
    """A step over all events: errors are skipped, views filtered, every 89th item fails at its first attempt."""
    tried: set[int] = set()

    def process(item: dict) -> dict | None:
        if item["event_id"] % 89 == 0 and item["event_id"] not in tried:
            tried.add(item["event_id"])
            raise errors.TransientError("try again")
        if item["event_type"] == "error":
            raise ValueError("an error event")
        return None if item["event_type"] == "view" else {"event_id": item["event_id"], "doubled": item["value"] * 2}

    out = writers.ChunkDirectoryWriter(staging.folder(spark, "chunks"))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    retry = faults.RetryTemplate(faults.SimpleRetry(2, {errors.TransientError: True}))
    step = jobs.ChunkStep("events", reader=lambda s, e: (events, ["event_id"]), writer=out, size=CHUNK, group=_GROUP, process=process, schema="event_id long, doubled double", item_retry=retry, skip_limit=limit, skippable=("ValueError",))
    runtime = jobs.Runtime(spark, repository.JobRepository(":memory:"))
    execution = jobs.Launcher(runtime).run(jobs.Job("events", [step]), JobParameters())
    done = sorted(runtime.repository.committed_chunks(execution.id, "events"))
    return execution.steps[0], out.committed(spark, done).select("event_id", "doubled") if done else spark.createDataFrame([], "event_id long, doubled double")


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type NOT IN ('error', 'view')")
def step_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir, 1 << 30)[1]


@query(f"""SELECT count(*) AS read_count, count(*) FILTER (event_type NOT IN ('error', 'view')) AS write_count, count(*) FILTER (event_type = 'view') AS filter_count,
  count(*) FILTER (event_type = 'error') AS process_skip_count, CAST(ceil(count(*) / {CHUNK * _GROUP}) AS BIGINT) AS commit_count FROM events""")
def step_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _step(spark, sf_dir, 1 << 30)[0].counts
    names = ["read_count", "write_count", "filter_count", "process_skip_count", "commit_count"]
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"""WITH items AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), bad AS (SELECT i, row_number() OVER (ORDER BY i) AS n FROM items WHERE event_type = 'error')
  SELECT event_id, value * 2 AS doubled FROM items WHERE event_type NOT IN ('error', 'view') AND i // {CHUNK * _GROUP} < coalesce((SELECT i // {CHUNK * _GROUP} FROM bad WHERE n = 1501), 9223372036854775807)""")
def step_skip_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _step(spark, sf_dir, 1500)[1]


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    half = events.where("event_id % 2 = 0")
    current = half.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "event_id").alias("x")).select("user_id", "x.*")
    return repository.merge_latest(current, events, ["user_id"], "event_id")


# records and typed values

_GUARDED = "CASE WHEN regexp_matches({0}, '^[=+\\-@]') THEN '''' || replace({0}, '''', '''''') ELSE {0} END"


@query(f"SELECT c_custkey, concat_ws(';', {_GUARDED.format('CAST(c_custkey AS VARCHAR)')}, {_GUARDED.format('c_name')}, {_GUARDED.format('CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR)')}) AS line FROM customer")
def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", records.delimited_line(["c_custkey", "c_name", F.col("c_acctbal").cast("decimal(12,2)")], ";").alias("line"))


@query("SELECT p_partkey, printf('%-10s|%08d|%s', p_brand, p_partkey, p_type) AS line FROM part")
def formatted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", records.formatted_line("%-10s|%08d|%s", ["p_brand", "p_partkey", "p_type"]).alias("line"))


@query("SELECT s_suppkey, trim(substring(s_name, 1, 8)) AS kind, trim(substring(s_name, 10, 9)) AS number FROM supplier")
def fixed_width_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = records.FixedTokenizer(((0, 8), (9, 18)), ("kind", "number"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", tokens(F.col("s_name")).alias("t")).select("s_suppkey", "t.*")


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, split_part(o_orderpriority, '-', 2) AS label FROM orders")
def delimited_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = records.DelimitedTokenizer(("rank", "label"), "-")
    return table(spark, sf_dir, "orders").select("o_orderkey", tokens(F.col("o_orderpriority")).alias("t")).select("o_orderkey", "t.*")


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECO%' THEN 0 WHEN p_type LIKE 'S%' THEN 1 ELSE 2 END AS choice, CASE WHEN p_type LIKE 'ECO%' THEN trim(substring(p_type, 1, 3)) WHEN p_type LIKE 'S%' THEN trim(substring(p_type, 1, 1)) ELSE p_type END AS code FROM part")
def pattern_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = records.PatternTokenizer((("^ECO", records.FixedTokenizer(((0, 3),), ("code",))), ("^S", records.FixedTokenizer(((0, 1),), ("code",))), (".*", records.DelimitedTokenizer(("code",)))))
    return table(spark, sf_dir, "part").select("p_partkey", tokens.choice(F.col("p_type")).alias("choice"), tokens(F.col("p_type"))["code"].alias("code"))


_TEXT = "CASE CAST(o_orderkey % 5 AS INTEGER) WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN ' 12.75 ' WHEN 2 THEN 'abc' WHEN 3 THEN '-3e2' ELSE 'yes' END"


@query(f"""SELECT o_orderkey, CASE WHEN regexp_matches(t, '^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') THEN CAST(trunc(try_cast(trim(t) AS DOUBLE)) AS BIGINT) END AS as_long,
  CASE WHEN regexp_matches(t, '^\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') THEN try_cast(trim(t) AS DOUBLE) END AS as_double, lower(t) IN ('true', '1', 'yes', 'on') AS as_boolean
  FROM (SELECT o_orderkey, {_TEXT} AS t FROM orders)""")
def typed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(_TEXT.replace("VARCHAR", "STRING"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", typed.read_long(F.col("t")).alias("as_long"), typed.read_double(F.col("t")).alias("as_double"), typed.read_boolean(F.col("t")).alias("as_boolean"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def read_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(typed.read_date(text, "dd.MM.yyyy"), "yyyy-MM-dd").alias("day"))


@query("SELECT o_custkey, sha256(array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR) || '=' || o_orderstatus)), ',')) AS job_key FROM orders GROUP BY o_custkey")
def job_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.concat(F.col("o_orderkey").cast("string"), F.lit("="), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(typed.job_key_of(F.collect_list(pairs)).alias("job_key"))


@query("SELECT o_orderkey, sha256('customer=' || o_custkey || ',status=' || o_orderstatus) AS job_key FROM orders")
def row_job_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    return named.select("o_orderkey", typed.job_key(["status", "customer"]).alias("job_key"))


def _redacted(text: str) -> str:
    """The same patterns in the other engine's spelling."""
    for pattern in typed.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{typed.REDACTED}', 'g')"
    return text


@query(f"SELECT doc_id, CASE WHEN length(t) > 4000 THEN substring(t, 1, 4000) || '…[truncated]' ELSE t END AS text FROM (SELECT doc_id, {_redacted('text')} AS t FROM documents)")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", typed.redact(F.col("text")).alias("text"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000")
def late_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("bound_orders")
    text = "SELECT o_orderkey, o_totalprice FROM bound_orders WHERE o_orderstatus = #{jobParameters['status']} AND o_totalprice > #{stepExecutionContext['least']}"
    return guards.query(spark, text, job_parameters={"status": "F"}, step_context={"least": 250000})


# partitions

_RANGES = f"""SELECT 'partition' || i AS partition, CAST(i AS INTEGER) AS index, lo + i * w AS min_value, least(lo + (i + 1) * w - 1, hi) AS max_value
  FROM (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, CAST(ceil((max(o_orderkey) - min(o_orderkey) + 1) / {GRID}) AS BIGINT) AS w FROM orders), (SELECT unnest(range({GRID})) AS i) WHERE lo + i * w <= hi"""


@query(_RANGES)
def range_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.range_table(table(spark, sf_dir, "orders"), "o_orderkey", GRID)


@query(f"SELECT p.partition, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders JOIN ({_RANGES}) p ON o_orderkey BETWEEN p.min_value AND p.max_value GROUP BY p.partition")
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    placed = partitioning.partition_index(orders, "o_orderkey", partitioning.range_table(orders, "o_orderkey", GRID))
    return partitioning.partition_statistics(placed, "partition", [F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last")])


@query("SELECT o_custkey, arg_max(code, (sev, -o_orderkey)) AS code FROM (SELECT o_custkey, o_orderkey, code, CASE code WHEN 'UNKNOWN' THEN 0 WHEN 'EXECUTING' THEN 1 WHEN 'NOOP' THEN 2 WHEN 'STOPPED' THEN 4 WHEN 'FAILED' THEN 5 ELSE 3 END AS sev FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'STOPPED' WHEN 'O' THEN 'CUSTOM' ELSE 'COMPLETED' END AS code FROM orders)) GROUP BY o_custkey")
def exit_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr("CASE o_orderstatus WHEN 'F' THEN 'STOPPED' WHEN 'O' THEN 'CUSTOM' ELSE 'COMPLETED' END")
    return table(spark, sf_dir, "orders").withColumn("code", code).groupBy("o_custkey").agg(partitioning.fold_exit("code", "o_orderkey").alias("code"))


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'O' THEN 1 ELSE 5 END"


@query(f"SELECT o_custkey, max({_STATUS}) AS status FROM orders GROUP BY o_custkey")
def status_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.expr(_STATUS)).alias("status"))


# faults


@query("""SELECT event_id, event_type = 'error' AS failed, coalesce(CAST(count(*) FILTER (event_type = 'error') OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS prior_failures,
  CASE WHEN event_type = 'error' THEN value < 90 AND coalesce(count(*) FILTER (event_type = 'error') OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 200 END AS skipped FROM events""")
def skip_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "error").alias("failed"))
    return faults.skip_budget(outcomes, F.col("value") < 90, 200, "event_id").drop("value")


@query("""SELECT min(event_id) AS fail_index FROM (SELECT event_id, value, event_type, row_number() OVER (ORDER BY event_id) - 1 AS prior FROM events WHERE event_type = 'error') WHERE value >= 90 OR prior >= 200""")
def skip_limit_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "error").alias("failed"))
    return faults.fail_index(faults.skip_budget(outcomes, F.col("value") < 90, 200, "event_id"), "event_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def skip_counts_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = faults.skip_counts(table(spark, sf_dir, "events").select("event_type"), "event_type")
    return counted.select(F.explode("skip_counts").alias("event_type", "n"))


@query("SELECT n, least(100.0 * pow(2.0, n), 30000.0) AS milliseconds FROM (SELECT unnest(range(12)) AS n)")
def retry_backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(12).select(F.col("id").alias("n"), faults.schedule(F.col("id")).alias("milliseconds"))


@query("""SELECT event_id AS item_index, CASE WHEN event_id % 10 = 7 THEN 'failed' WHEN event_type = 'view' THEN 'filtered' ELSE 'written' END AS outcome,
  CASE WHEN event_id % 10 = 7 THEN 'RuntimeError' END AS error_class, CASE WHEN event_id % 10 = 7 THEN 3 ELSE 1 END AS attempts FROM events""")
def retried_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    def process(item: dict) -> dict | None:
        if item["item_index"] % 10 == 7:
            raise RuntimeError("the item fails whenever it is tried")
        return None if item["event_type"] == "view" else {"value": item["value"]}

    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_index"), "event_type", "value")
    return faults.attempt_items(items, process, faults.RetryTemplate(faults.SimpleRetry(3)), "value double").select("item_index", "outcome", "error_class", "attempts")


# metadata: an instance per customer, an execution per order, a step execution per event

_EXECUTION_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'STARTED' ELSE 'COMPLETED' END"
_INSTANCES = "(SELECT c_custkey AS id, c_mktsegment AS job_name, c_name AS job_key FROM customer)"
_EXECUTIONS = f"(SELECT o_orderkey AS id, o_custkey AS job_instance_id, {_EXECUTION_STATUS} AS status FROM orders)"
_STEPS = "(SELECT event_id AS id, event_type AS step_name, user_id AS job_execution_id FROM events)"


def _instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("job_name"), F.col("c_name").alias("job_key"))


def _executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("job_instance_id"), F.expr(_EXECUTION_STATUS).alias("status"))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("step_name"), F.col("user_id").alias("job_execution_id"))


@query(f"SELECT e.id, e.job_instance_id, e.status, i.job_name, i.job_key FROM {_EXECUTIONS} e JOIN {_INSTANCES} i ON i.id = e.job_instance_id")
def execution_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.with_instance(_executions(spark, sf_dir), _instances(spark, sf_dir))


@query(f"SELECT e.id, e.job_instance_id, e.status, i.job_name, i.job_key FROM {_EXECUTIONS} e JOIN {_INSTANCES} i ON i.id = e.job_instance_id WHERE e.status IN ('STARTING', 'STARTED', 'STOPPING')")
def running_executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.running_executions(_executions(spark, sf_dir), _instances(spark, sf_dir))


@query(f"SELECT e.job_instance_id, s.step_name, max(s.id) AS id, arg_max(s.job_execution_id, s.id) AS job_execution_id FROM {_STEPS} s JOIN {_EXECUTIONS} e ON e.id = s.job_execution_id GROUP BY ALL")
def last_step_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.last_step_executions(_steps(spark, sf_dir), _executions(spark, sf_dir))


@query(f"SELECT e.job_instance_id, s.step_name, count(*) AS starts FROM {_STEPS} s JOIN {_EXECUTIONS} e ON e.id = s.job_execution_id GROUP BY ALL")
def step_start_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.step_start_counts(_steps(spark, sf_dir), _executions(spark, sf_dir))


@query("SELECT DISTINCT c_mktsegment AS job_name FROM customer ORDER BY 1")
def job_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instances(spark, sf_dir).select("job_name").distinct().orderBy("job_name")


@query(f"SELECT * FROM {_INSTANCES} WHERE job_name = 'BUILDING' ORDER BY id DESC LIMIT 20 OFFSET 20")
def instances_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.instances_page(_instances(spark, sf_dir), "BUILDING", 20, 20)


@query(f"SELECT i.job_name, count(*) AS executions, count(DISTINCT i.id) AS instances FROM {_EXECUTIONS} e JOIN {_INSTANCES} i ON i.id = e.job_instance_id GROUP BY i.job_name")
def execution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.execution_counts(_executions(spark, sf_dir), _instances(spark, sf_dir))


@query(f"""SELECT e.id, e.job_instance_id, e.status, i.job_name, i.job_key FROM {_EXECUTIONS} e JOIN (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY id DESC) AS r FROM {_INSTANCES}) i
  ON i.id = e.job_instance_id WHERE i.r <= 10 AND e.status = 'FAILED'""")
def executions_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.recent_by_status(_executions(spark, sf_dir), _instances(spark, sf_dir), "FAILED", 10)


@query(f"SELECT s.id, s.step_name, s.job_execution_id FROM {_STEPS} s WHERE s.job_execution_id NOT IN (SELECT id FROM {_EXECUTIONS} WHERE status = 'FAILED')")
def cascade_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.survivors(_steps(spark, sf_dir), _executions(spark, sf_dir).where("status = 'FAILED'"))


@query("SELECT event_id AS id, event_type AS status, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000 AS duration_ms, event_type <> 'COMPLETED' AS failed FROM events")
def execution_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.expr("timestamp '2024-01-01 00:00:00 UTC'").alias("start_time"), F.col("ts").cast("timestamp").alias("end_time"))
    return repository.roll_up(timed).drop("start_time", "end_time")


# sinks, sources and steps beyond the ones above


@query("SELECT CAST(o_orderkey AS VARCHAR) || ',' || CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE CAST(o_custkey AS VARCHAR) END AS record, o_orderkey % 7 = 0 AS malformed FROM orders")
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "malformed")
    customer = F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.col("o_custkey").cast("string"))
    writers.LineWriter(path, F.concat_ws(",", "o_orderkey", customer)).write(table(spark, sf_dir, "orders"))
    good, bad = readers.CsvReader(path, "o_orderkey long, o_custkey long").quarantine(spark)
    return good.select(F.concat_ws(",", "o_orderkey", "o_custkey").alias("record"), F.lit(False).alias("malformed")).union(bad.select("_corrupt_record", F.lit(True)))


@query("SELECT i AS resource_index, n_nationkey, n_name FROM nation, (SELECT unnest([0, 1]) AS i)")
def tee_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "tee")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.CompositeWriter([writers.ParquetWriter(f"{path}/parquet"), writers.JsonLinesWriter(f"{path}/lines")]).write(nations)
    return readers.MultiReader([readers.ParquetReader(f"{path}/parquet"), readers.JsonLinesReader(f"{path}/lines", nations.schema)]).to_df(spark)


@query("SELECT p_partkey, p_size, p_brand FROM part")
def fixed_width_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "fixed-width")
    writers.LineWriter(path, records.formatted_line("%10d%4d%-10s", ["p_partkey", "p_size", "p_brand"])).write(table(spark, sf_dir, "part"))
    reader = readers.FixedWidthReader(path, records.FixedTokenizer(((0, 10), (10, 14), (14, 24)), ("p_partkey", "p_size", "p_brand")))
    typed_fields = processors.mapping(p_partkey="cast(p_partkey as long)", p_size="cast(p_size as long)", p_brand="p_brand")
    return readers.MappedReader(readers.SynchronizedReader(reader), typed_fields).to_df(spark)


@query("SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_custkey % 3 <> 0")
def concurrent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    def call(item: dict) -> dict | None:
        return None if item["c_custkey"] % 3 == 0 else {"c_custkey": item["c_custkey"], "name": item["c_name"].upper()}

    return processors.concurrent(call, "c_custkey long, name string")(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 2) AS label, split_part(o_orderpriority, '-', 1) AS rank FROM orders")
def field_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, fields = ["rank", "label"], F.split("o_orderpriority", "-")
    return table(spark, sf_dir, "orders").select("o_orderkey", records.field_named(names, fields, "label").alias("label"), records.field_map(names, fields)["rank"].alias("rank"))


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus <> 'F'")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.folder(spark, "stream")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    writers.ParquetWriter(f"{path}/in").write(table(spark, sf_dir, "orders").select(*columns).repartition(4))
    store = repository.JobRepository(":memory:")
    execution = jobs.Launcher(jobs.Runtime(spark, store)).admit(jobs.Job("stream", []), JobParameters())
    out = writers.ChunkDirectoryWriter(f"{path}/out")
    source = spark.readStream.schema("o_orderkey long, o_orderstatus string, o_totalprice double").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    process = processors.composite(processors.filtering("o_orderstatus <> 'F'"), processors.mapping(o_orderkey="o_orderkey", doubled="o_totalprice * 2"))
    chunk_stream.ChunkStream(source, out, store, execution.id, "stream", f"{path}/checkpoint", process).start().awaitTermination()
    done = sorted(store.committed_chunks(execution.id, "stream"))
    return out.committed(spark, done).select("o_orderkey", "doubled") if done else spark.createDataFrame([], "o_orderkey long, doubled double")


@query(f"SELECT p.partition, count(*) AS read_count, count(*) FILTER (o_orderstatus = 'F') AS filter_count FROM orders JOIN ({_RANGES}) p ON o_orderkey BETWEEN p.min_value AND p.max_value GROUP BY p.partition")
def partition_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    found: dict[str, tuple[int, int]] = {}

    def worker(session: SparkSession, name: str, low: int, high: int) -> dict[str, int]:
        counted = orders.where(F.col("o_orderkey").between(low, high)).agg(F.count("*"), F.count_if(F.col("o_orderstatus") == "F")).first()
        found[name.partition(":")[2]] = tuple(counted)
        return {"read_count": counted[0], "filter_count": counted[1]}

    low, high = orders.agg(F.coalesce(F.min("o_orderkey"), F.lit(0)), F.coalesce(F.max("o_orderkey"), F.lit(0))).first()
    step = jobs.PartitionStep("orders", low=low, high=high, grid=GRID, worker=worker)
    jobs.Launcher(jobs.Runtime(spark, repository.JobRepository(":memory:"))).run(jobs.Job("orders", [step]), JobParameters())
    return spark.createDataFrame([(name, *counts) for name, counts in found.items() if counts[0]], "partition string, read_count long, filter_count long")


@query("SELECT 'count' AS step, 'COMPLETED' AS status UNION ALL SELECT CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 0 THEN 'some' ELSE 'none' END, 'COMPLETED'")
def flow_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(step: StepExecution, runtime: jobs.Runtime) -> None:
        step.context["open"] = table(runtime.spark, sf_dir, "orders").where("o_orderstatus = 'P'").count()

    first, some, none = jobs.TaskletStep("count", tasklet=count), jobs.TaskletStep("some", tasklet=lambda s, r: None), jobs.TaskletStep("none", tasklet=lambda s, r: None)
    decided = builders.FlowBuilder("orders").start(first).decider(lambda job, step: "SOME" if step.context["open"] else "NONE")
    flow = decided.on("SOME").to(some).source(first).on("*").to(none).build()
    runtime = jobs.Runtime(spark, repository.JobRepository(":memory:"))
    execution = jobs.Launcher(runtime).run(builders.JobBuilder("orders").flow(flow).build(), JobParameters())
    return spark.createDataFrame([(s.name, s.status.name) for s in execution.steps], "step string, status string")
