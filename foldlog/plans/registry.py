"""Registered queries of the projection engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldlog import model
from foldlog.functions import scalars
from foldlog.operators import events as ops
from foldlog.operators import folds, handlers, inspection, transformers
from foldlog.sources.logs import event_range, event_table, mapped

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

#: The event log as the oracles see it.
LOG = """log AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS stream_id, event_type AS type, event_id + 1 AS position, ts AS occurred_at, value, props,
  CAST(round(value * 100) AS BIGINT) AS cents,
  CASE event_type WHEN 'view' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'applied' END AS outcome, event_id // 50 AS batch FROM events)"""
NAME = "accounts"
ACCOUNTS = model.Table("accounts", "user string, balance bigint, last_seen bigint", ("user",), ("balance",))
NOW = "2030-01-01 00:00:00"
#: Where replays and redeliveries in the queries begin and end: shares of the whole log, which grow with it.
EARLY, MIDDLE, LATE = (f"(SELECT max(position) * {tenths} // 10 FROM log)" for tenths in (3, 5, 6))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def note(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = f"WITH {LOG} {sql}" if " log" in sql or "log " in sql else sql
        return f

    return note


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its payload taken apart, in the session's UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return event_table(spark, sf_dir)


def reached(events: DataFrame, tenths: int) -> int:
    """The position that so many tenths of the log end at."""
    return (events.agg(F.max("position")).first()[0] or 0) * tenths // 10


def cents() -> F.Column:
    return F.round(F.get_json_object("data", "$.value").cast("double") * 100).cast("bigint")


def account_rules() -> handlers.Rules:
    """Sign-ups open accounts, purchases add, clicks are noted, views skipped; errors fail."""
    return (
        handlers.Rules().insert("signup", "accounts", {"user": F.col("stream_id"), "balance": F.lit(0)})
        .inc("purchase", "accounts", {"user": F.col("stream_id")}, {"balance": cents()}, name=F.concat(F.lit("inc-"), F.col("id")))
        .update("click", "accounts", {"user": F.col("stream_id")}, {"last_seen": F.col("position")})
        .skip("view").error("error", F.concat(F.lit("refused "), F.col("id")))
    )


def handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = account_rules().apply(ops.batches(log(spark, sf_dir), 50))
    return found.withColumn("outcome", handlers.outcome(F.col("result")))


def cursors(events: DataFrame) -> DataFrame:
    return events.groupBy("stream_id").agg(F.max("position").alias("position"))


def named(cursor_rows: DataFrame, version: int = 1) -> DataFrame:
    return cursor_rows.select(F.lit(NAME).alias("projection_name"), F.lit(version).alias("projection_version"), "stream_id", "position", F.lit(None).cast("timestamp").alias("updated_at"))


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of the log; their time of recording stands in as the event's, so that runs agree."""
    failed = handled(spark, sf_dir).where("outcome = 'failed'")
    rows = handlers.dead_letter_rows(failed, NAME, 1, F.col("occurred_at"))
    return rows.withColumn("id", F.col("position"))


# ---------------------------------------------------------------- sources

@query("event_envelope", "SELECT id, stream_id, type, position, epoch_us(occurred_at) AS occurred_us, value, json_extract_string(props, '$.k') AS k FROM log")
def event_envelope(spark, sf_dir):
    return log(spark, sf_dir).select("id", "stream_id", "type", "position", F.unix_micros("occurred_at").alias("occurred_us"), F.get_json_object("data", "$.value").cast("double").alias("value"), F.col("metadata")["k"].alias("k"))


@query("start_from_filter", f"SELECT id, position FROM log WHERE position > {MIDDLE}")
def start_from_filter(spark, sf_dir):
    all_ = log(spark, sf_dir)
    return ops.start_from(all_, reached(all_, 5)).select("id", "position")


@query("start_from_current", "SELECT id, position FROM log WHERE position > (SELECT max(position) FROM log)")
def start_from_current(spark, sf_dir):
    return ops.start_from(log(spark, sf_dir), "current").select("id", "position")


@query("lineitem_log", """SELECT CAST(l_orderkey AS VARCHAR) AS stream_id, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position,
  l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def lineitem_log(spark, sf_dir):
    """A second log, numbered without a global sort in one task: counts of earlier days plus ranks within a day."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = rows.groupBy("l_shipdate").agg(F.count("*").alias("n"))  # a row per day
    earlier = days.select("l_shipdate", F.coalesce(F.sum("n").over(Window.orderBy("l_shipdate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("l_shipdate").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    numbered = rows.withColumn("k", F.row_number().over(within)).join(earlier, "l_shipdate")
    return numbered.select(F.col("l_orderkey").cast("string").alias("stream_id"), (F.col("before") + F.col("k")).alias("position"), F.col("l_linenumber").alias("line"))


@query("conversation_log", "SELECT CAST(conv_id AS VARCHAR) AS stream_id, max(turn) AS position, count(*) AS n FROM conversations GROUP BY conv_id")
def conversation_log(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(F.max("turn").alias("position"), F.count("*").alias("n"))


@query("gapless_prefix", """SELECT b AS batch, max(CASE WHEN gap IS NULL OR position < gap THEN position END) AS acknowledged, count(*) FILTER (gap IS NOT NULL AND position >= gap) AS left_in_flight
  FROM (SELECT (position - 1) // 500 AS b, position, min(CASE WHEN position % 997 = 0 THEN position END) OVER (PARTITION BY (position - 1) // 500) AS gap FROM log) GROUP BY b""")
def gapless_prefix(spark, sf_dir):
    flight = ops.batches(log(spark, sf_dir), 500).withColumn("committed", F.col("position") % 997 != 0)
    return ops.gapless_prefix(flight, "batch")


@query("contiguous_watermark", "SELECT coalesce(max(position), 0) AS position FROM log WHERE position < coalesce((SELECT min(position) FROM log WHERE position % 997 = 0), 9223372036854775807)")
def contiguous_watermark(spark, sf_dir):
    flight = log(spark, sf_dir).withColumn("committed", F.col("position") % 997 != 0)
    return ops.gapless_prefix(flight).select(F.coalesce("acknowledged", F.lit(0)).cast("bigint").alias("position"))


@query("subscribe_delay_curve", "SELECT n::BIGINT AS attempt, (CASE n WHEN 1 THEN 50 WHEN 2 THEN 100 WHEN 3 THEN 200 WHEN 4 THEN 400 WHEN 5 THEN 800 ELSE CASE WHEN n <= 35 THEN 1000 ELSE 60000 END END)::INTEGER AS delay_ms FROM range(1, 41) t(n)")
def subscribe_delay_curve(spark, sf_dir):
    return spark.range(1, 41).select(F.col("id").alias("attempt"), scalars.subscribe_delay(F.col("id")).alias("delay_ms"))


# ---------------------------------------------------------------- dedup, partitions, batches

@query("partition_assignment", "SELECT stream_id, CAST('0x' || substr(md5(stream_id), 1, 8) AS BIGINT) % 16 AS part FROM (SELECT DISTINCT stream_id FROM log)")
def partition_assignment(spark, sf_dir):
    return log(spark, sf_dir).select("stream_id").distinct().select("stream_id", scalars.portable_partition_of(F.col("stream_id"), 16).alias("part"))


@query("dedup_redelivery", f"""SELECT id, stream_id, position, position <= coalesce(c, 0) AS repeated FROM log LEFT JOIN
  (SELECT stream_id, max(position) AS c FROM log WHERE position <= {LATE} GROUP BY stream_id) USING (stream_id) WHERE position > {EARLY}""")
def dedup_redelivery(spark, sf_dir):
    all_ = log(spark, sf_dir)
    early, late = reached(all_, 3), reached(all_, 6)
    return ops.dedup(all_.where(F.col("position") > early), cursors(all_.where(F.col("position") <= late))).select("id", "stream_id", "position", "repeated")


@query("skip_accounting", f"""SELECT CASE WHEN position <= {LATE} AND position <= c THEN 'dedup' ELSE 'handler' END AS reason, count(*) AS n FROM log LEFT JOIN
  (SELECT stream_id, max(position) AS c FROM log WHERE position <= {LATE} GROUP BY stream_id) USING (stream_id) WHERE (position <= coalesce(c, 0)) OR type = 'view' GROUP BY 1""")
def skip_accounting(spark, sf_dir):
    all_ = log(spark, sf_dir)
    found = account_rules().apply(ops.dedup(all_, cursors(all_.where(F.col("position") <= reached(all_, 6))))).withColumn("outcome", handlers.outcome(F.col("result"), F.col("repeated")))
    reason = F.when(F.col("outcome") == "deduped", "dedup").when(F.col("outcome") == "skipped", "handler")
    return found.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("stream_advances_by_batch", "SELECT batch, stream_id, max(position) AS position FROM log WHERE outcome <> 'skipped' GROUP BY batch, stream_id")
def stream_advances_by_batch(spark, sf_dir):
    return ops.advances(handled(spark, sf_dir), "batch")


@query("cursor_greatest_merge", "SELECT stream_id, max(position) AS position FROM log GROUP BY stream_id")
def cursor_greatest_merge(spark, sf_dir):
    """The cursors of the whole log meet a replay of a part that ends before them: none moves back."""
    all_ = log(spark, sf_dir)
    return ops.merge_cursors(cursors(all_), cursors(all_.where(F.col("position").between(reached(all_, 3), reached(all_, 5)))))


@query("stream_order_violations", """SELECT stream_id, count(*) AS n FROM (SELECT stream_id, position, max(position) OVER (PARTITION BY stream_id ORDER BY md5(id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM log)
  WHERE position < top GROUP BY stream_id""")
def stream_order_violations(spark, sf_dir):
    shuffled = log(spark, sf_dir).withColumn("arrival", F.md5("id"))
    return ops.order_violations(shuffled, "arrival").groupBy("stream_id").agg(F.count("*").alias("n"))


@query("fallback_stream_prefix", "SELECT stream_id, max(position) AS position, count(*) AS n FROM log LEFT JOIN (SELECT stream_id, min(position) AS stop FROM log WHERE position % 97 = 0 GROUP BY stream_id) USING (stream_id) WHERE stop IS NULL OR position < stop GROUP BY stream_id")
def fallback_stream_prefix(spark, sf_dir):
    marked = log(spark, sf_dir).withColumn("resolved", F.col("position") % 97 != 0)
    return ops.stream_prefix(marked).groupBy("stream_id").agg(F.max("position").alias("position"), F.count("*").alias("n"))


@query("multi_key_collision", "SELECT position, row_number() OVER (PARTITION BY batch, type ORDER BY position) > 1 AS collides FROM log")
def multi_key_collision(spark, sf_dir):
    return ops.collisions(ops.batches(log(spark, sf_dir), 50).withColumn("key", F.col("type"))).select("position", "collides")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event claims two keys in its batch of 50: one that few events share, and its stream."""
    return ops.batches(log(spark, sf_dir), 50).select("batch", "position", F.array(F.concat_ws("-", "type", F.col("position") % 3), "stream_id").alias("keys"))


#: Claims in order: of each batch what is taken, and who lost.
LOSERS = """losers AS (SELECT batch, unnest(list_reduce(list(struct_pack(p := position, ks := [type || '-' || (position % 3), stream_id], taken := []::VARCHAR[], lost := []::BIGINT[]) ORDER BY position),
  lambda a, x: CASE WHEN list_has_any(x.ks, a.taken) THEN struct_pack(p := x.p, ks := x.ks, taken := a.taken, lost := list_append(a.lost, x.p))
    ELSE struct_pack(p := x.p, ks := x.ks, taken := list_concat(a.taken, x.ks), lost := a.lost) END,
  struct_pack(p := 0::BIGINT, ks := []::VARCHAR[], taken := []::VARCHAR[], lost := []::BIGINT[])).lost) AS position FROM log GROUP BY batch)"""


@query("multi_keys_collision", f", {LOSERS} SELECT batch, position FROM losers")
def multi_keys_collision(spark, sf_dir):
    """Who loses a key in batches whose events claim two each; a loser claims nothing."""
    return ops.lost_claims(_keyed(spark, sf_dir), _cut(spark))


def _cut(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    import uuid

    root = f"{_shared(spark)}/claims-{uuid.uuid4().hex}"

    def cut(frame: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    return cut


def _shared(spark: SparkSession) -> str:
    import tempfile

    return (spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="foldlog-")).rstrip("/")


# ---------------------------------------------------------------- handlers and folds

@query("handler_outcomes", "SELECT type, outcome, CASE WHEN outcome = 'failed' THEN 'error' END AS error_kind, count(*) AS n FROM log GROUP BY ALL")
def handler_outcomes(spark, sf_dir):
    found = handled(spark, sf_dir)
    return found.groupBy("type", "outcome", F.when(F.col("outcome").isin("failed", "invalid"), handlers.error_kind(F.col("result"))).alias("error_kind")).agg(F.count("*").alias("n"))


@query("unmatched_clause", "SELECT CASE WHEN type IN ('signup', 'purchase') THEN 'applied' ELSE 'failed' END AS outcome, CASE WHEN type IN ('signup', 'purchase') THEN NULL ELSE 'no_clause' END AS error_kind, count(*) AS n FROM log GROUP BY ALL")
def unmatched_clause(spark, sf_dir):
    rules = handlers.Rules().insert("signup", "accounts", {"user": F.col("stream_id"), "balance": F.lit(0)}).inc("purchase", "accounts", {"user": F.col("stream_id")}, {"balance": cents()})
    found = rules.apply(log(spark, sf_dir)).withColumn("outcome", handlers.outcome(F.col("result")))
    return found.groupBy("outcome", F.when(F.col("outcome") != "applied", handlers.error_kind(F.col("result"))).alias("error_kind")).agg(F.count("*").alias("n"))


@query("invalid_returns", "SELECT position, 'invalid_return' AS error_kind FROM log WHERE type = 'click'")
def invalid_returns(spark, sf_dir):
    """An update that sets nothing is none of the accepted shapes."""
    found = handlers.Rules().on("click", handlers.result("update", handlers.step("update", "accounts", key={"user": F.col("stream_id")}))).skip("view").otherwise(handlers.result("skip")).apply(log(spark, sf_dir))
    found = found.withColumn("outcome", handlers.outcome(F.col("result"))).where("outcome = 'invalid'")
    return found.select("position", handlers.error_kind(F.col("result")).alias("error_kind"))


@query("account_balances", "SELECT stream_id, CAST(sum(cents) AS BIGINT) AS balance_cents, max(position) AS last_position FROM log WHERE type = 'purchase' GROUP BY stream_id")
def account_balances(spark, sf_dir):
    bought = log(spark, sf_dir).where("type = 'purchase'")
    return folds.sums(bought, "stream_id", cents()).select("stream_id", F.col("total").alias("balance_cents"), "last_position")


def _folded(spark: SparkSession, sf_dir: str, types: tuple[str, ...], rules: handlers.Rules, how=lambda *given: transformers.settle(*given).rows) -> DataFrame:
    found = rules.apply(log(spark, sf_dir).where(F.col("type").isin(*types)))
    return how(folds.steps_of(found), spark.createDataFrame([], ACCOUNTS.schema), ACCOUNTS)


@query("rm_insert", "SELECT stream_id AS user, min(position) AS created_at, count(*) - 1 AS refused FROM log WHERE type = 'signup' GROUP BY stream_id")
def rm_insert(spark, sf_dir):
    rules = handlers.Rules().insert("signup", "accounts", {"user": F.col("stream_id"), "balance": F.lit(0), "last_seen": F.col("position")})
    found = _folded(spark, sf_dir, ("signup",), rules, folds.inserts)
    return folds.typed(found.withColumn("n", F.size("broken")), ACCOUNTS).select("user", F.col("last_seen").alias("created_at")).join(found.select(F.get("id", F.lit(0)).alias("user"), F.size("broken").cast("bigint").alias("refused")), "user")


@query("rm_update_last_wins", """SELECT s.stream_id AS user, (SELECT max(position) FROM log c WHERE c.type = 'click' AND c.stream_id = s.stream_id AND c.position > s.born) AS last_seen
  FROM (SELECT stream_id, min(position) AS born FROM log WHERE type = 'signup' GROUP BY stream_id) s""")
def rm_update_last_wins(spark, sf_dir):
    """An update before the insert meets no row, which is no failure."""
    rules = handlers.Rules().insert("signup", "accounts", {"user": F.col("stream_id"), "balance": F.lit(0)}).update("click", "accounts", {"user": F.col("stream_id")}, {"last_seen": F.col("position")})
    return folds.typed(_folded(spark, sf_dir, ("signup", "click"), rules), ACCOUNTS).where("not __deleted").select("user", "last_seen")


@query("rm_delete", """SELECT stream_id AS user, min(position) AS last_seen FROM log l WHERE type = 'signup' AND position > coalesce((SELECT max(position) FROM log e WHERE e.type = 'error' AND e.stream_id = l.stream_id), 0) GROUP BY stream_id""")
def rm_delete(spark, sf_dir):
    """Errors delete the account here, and a later sign-up opens it again."""
    rules = handlers.Rules().insert("signup", "accounts", {"user": F.col("stream_id"), "balance": F.lit(0), "last_seen": F.col("position")}).delete("error", "accounts", {"user": F.col("stream_id")})
    return folds.typed(_folded(spark, sf_dir, ("signup", "error"), rules), ACCOUNTS).where("not __deleted").select("user", "last_seen")


@query("rm_inc_fold", "SELECT stream_id AS user, CAST(sum(cents) AS BIGINT) AS balance FROM log WHERE type = 'purchase' GROUP BY stream_id")
def rm_inc_fold(spark, sf_dir):
    """Additions as composed steps, which agree with the fast path of account_balances."""
    return folds.typed(_folded(spark, sf_dir, ("purchase",), account_rules()), ACCOUNTS).select("user", "balance")


@query("integrity_isolation", """SELECT position, CASE WHEN row_number() OVER (PARTITION BY stream_id, type ORDER BY position) > 1 THEN 'commit:23505 (unique_violation)' END AS error_kind FROM log""")
def integrity_isolation(spark, sf_dir):
    """One row per stream and type: repeated inserts are isolated one by one, the rest commits."""
    table = model.Table("kinds", "user string, kind string", ("user", "kind"))
    found = handlers.Rules().otherwise(handlers.result("insert", handlers.step("insert", "kinds", set={"user": F.col("stream_id"), "kind": F.col("type")}))).apply(log(spark, sf_dir))
    broken = transformers.settle(folds.steps_of(found), spark.createDataFrame([], table.schema), table).broken()
    label = F.when(F.col("state") == "23505", "commit:23505 (unique_violation)").when(F.col("state").isNotNull(), F.concat(F.lit("commit:"), "state"))
    return found.join(broken, "position", "left").select("position", label.alias("error_kind"))


@query("conservation", "SELECT count(*) AS delivered, count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'failed') AS dead, count(*) FILTER (outcome = 'skipped') AS skipped, true AS closed FROM log")
def conservation(spark, sf_dir):
    return inspection.conservation(handled(spark, sf_dir))


@query("conservation_with_collisions", f""", {LOSERS} SELECT count(*) AS delivered, count(*) FILTER (outcome = 'applied' AND l.position IS NULL) AS applied, count(*) FILTER (outcome = 'failed' OR (outcome = 'applied' AND l.position IS NOT NULL)) AS dead,
  count(*) FILTER (outcome = 'skipped') AS skipped, true AS closed FROM log LEFT JOIN losers l ON log.position = l.position""")
def conservation_with_collisions(spark, sf_dir):
    """Applied events that lose a key are dead letters, and the books still close."""
    lost = ops.lost_claims(_keyed(spark, sf_dir), _cut(spark)).select("position", F.lit(True).alias("lost"))
    found = handled(spark, sf_dir).join(lost, "position", "left")
    return inspection.conservation(found.withColumn("outcome", F.when((F.col("outcome") == "applied") & F.col("lost"), "collision").otherwise(F.col("outcome"))))


def _declared(spark: SparkSession, table: model.Table, rules: handlers.Rules, source=None):
    """A target in a folder of its own, and a projection into it."""
    import uuid

    from foldlog import config
    from foldlog.sources.logs import MemoryLog
    from foldlog.targets.epoch import EpochTarget

    target = EpochTarget(f"{_shared(spark)}/projection-{uuid.uuid4().hex}", [table])
    return target, config.declare(name=NAME, source=source or MemoryLog([]), target=target, handler=rules, parallelism=8)


def _run(spark: SparkSession, sf_dir: str, table: model.Table = ACCOUNTS, rules: handlers.Rules | None = None):
    """Rules through the whole engine: bounded passes into atomic epochs."""
    from foldlog.streaming.runtime import run_bounded

    target, projection = _declared(spark, table, rules or account_rules())
    run_bounded(spark, projection, log(spark, sf_dir), part=lambda a, b: event_range(spark, sf_dir, a, b))
    return target


_BALANCES = """SELECT b.stream_id AS user, CAST(coalesce(sum(cents) FILTER (type = 'purchase'), 0) AS BIGINT) AS balance, max(position) FILTER (type = 'click' AND position > born) AS last_seen
  FROM log l JOIN (SELECT stream_id, min(position) AS born FROM log WHERE type IN ('signup', 'purchase') GROUP BY stream_id) b ON l.stream_id = b.stream_id GROUP BY b.stream_id"""


@query("projection_run", _BALANCES)
def projection_run(spark, sf_dir):
    return _run(spark, sf_dir).table(spark, "accounts")


@query("projection_levels", _BALANCES)
def projection_levels(spark, sf_dir):
    """The same in four passes, whose epochs are merged into buckets on the way."""
    from foldlog.streaming.runtime import run_bounded

    target, projection = _declared(spark, ACCOUNTS, account_rules())
    target.compact_at = 1
    all_ = log(spark, sf_dir)
    run_bounded(spark, projection, all_, in_flight=-(-all_.agg(F.max("position")).first()[0] // 4), part=lambda a, b: event_range(spark, sf_dir, a, b))
    return target.table(spark, "accounts")


@query("projection_dead_letters", """SELECT CASE WHEN type = 'error' THEN 'error' ELSE 'commit:23505 (unique_violation)' END AS error_kind, count(*) AS n, max(position) AS last_position
  FROM log LEFT JOIN (SELECT stream_id, min(position) AS born FROM log WHERE type IN ('signup', 'purchase') GROUP BY stream_id) b USING (stream_id) WHERE type = 'error' OR (type = 'signup' AND position > born) GROUP BY 1""")
def projection_dead_letters(spark, sf_dir):
    return _run(spark, sf_dir).table(spark, "dead_letters").groupBy("error_kind").agg(F.count("*").alias("n"), F.max("position").alias("last_position"))


@query("projection_cursors", "SELECT stream_id, max(position) AS position FROM log WHERE type <> 'view' GROUP BY stream_id")
def projection_cursors(spark, sf_dir):
    return _run(spark, sf_dir).table(spark, "positions").select("stream_id", "position")


TICKETS = model.Table("tickets", "id string, user string, state string, paid bigint", ("id",))
_OPENED = ", opened AS (SELECT id, stream_id AS user, position FROM log WHERE type = 'signup')"


def _tickets(spark: SparkSession, sf_dir: str, rules: handlers.Rules):
    """A ticket for each signup; other events reach a user's tickets by a filter on the user."""
    rules = rules.insert("signup", "tickets", {"id": F.col("id"), "user": F.col("stream_id"), "state": F.lit("open")})
    for kind in ("view", "click", "error", "purchase"):
        rules = rules.skip(kind)
    return _run(spark, sf_dir, TICKETS, rules).table(spark, "tickets")


@query("rm_update_by_filter", f"""{_OPENED}
  SELECT o.id, o.user, CASE WHEN max(l.position) IS NULL THEN 'open' ELSE 'paid' END AS state, max(l.position) AS paid FROM opened o LEFT JOIN log l ON l.stream_id = o.user AND l.type = 'purchase' AND l.position > o.position
  GROUP BY o.id, o.user""")
def rm_update_by_filter(spark, sf_dir):
    """A purchase marks all tickets that its user has open by then or has paid before."""
    return _tickets(spark, sf_dir, handlers.Rules().update("purchase", "tickets", {"user": F.col("stream_id")}, {"state": F.lit("paid"), "paid": F.col("position")}))


@query("rm_delete_by_filter", f"""{_OPENED}
  SELECT id, "user", 'open' AS state, NULL::BIGINT AS paid FROM opened o WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.stream_id = o.user AND l.type = 'error' AND l.position > o.position)""")
def rm_delete_by_filter(spark, sf_dir):
    """An error deletes all tickets that its user has by then."""
    return _tickets(spark, sf_dir, handlers.Rules().delete("error", "tickets", {"user": F.col("stream_id")}))


@query("projection_bounded_then_stream", "SELECT stream_id AS user, CAST(sum(cents) FILTER (type = 'purchase') AS BIGINT) AS balance, CAST(NULL AS BIGINT) AS last_seen FROM log GROUP BY stream_id HAVING count(*) FILTER (type = 'purchase') > 0")
def projection_bounded_then_stream(spark, sf_dir):
    """Three tenths of the log in a bounded run, then all of it as a stream on the same target."""
    from foldlog.sources.logs import Source
    from foldlog.streaming.runtime import Engine, run_bounded

    class Log(Source):
        def batch(self, spark, after="origin"):
            return ops.start_from(log(spark, sf_dir), after)

        def stream(self, spark, after="origin"):
            rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)
            return ops.start_from(mapped(rows), after)

    rules = handlers.Rules().inc("purchase", "accounts", {"user": F.col("stream_id")}, {"balance": cents()}, name=F.col("id")).otherwise(handlers.result("skip"))
    target, projection = _declared(spark, ACCOUNTS, rules, Log())
    all_ = log(spark, sf_dir)
    run_bounded(spark, projection, all_.where(F.col("position") <= reached(all_, 3)))
    engine = Engine(spark, f"{target.root}-checkpoints", {"availableNow": True})
    running = engine.start(projection)
    running.query.awaitTermination()
    engine.stop(projection)
    return target.table(spark, "accounts")


# ---------------------------------------------------------------- dead letters, progress, inspection

@query("dead_letter_rows", "SELECT position, stream_id, type AS event_type, 'error' AS error_kind, 'refused ' || id AS error_message, json_extract_string(props, '$.k') AS k FROM log WHERE outcome = 'failed'")
def dead_letter_rows(spark, sf_dir):
    return letters(spark, sf_dir).select("position", "stream_id", "event_type", "error_kind", "error_message", F.get_json_object(F.get_json_object("event_data", "$.props"), "$.k").alias("k"))


@query("dead_letters_page", "SELECT position AS id, stream_id, epoch_us(occurred_at) AS occurred_us FROM log WHERE outcome = 'failed' ORDER BY occurred_at DESC, position DESC LIMIT 50 OFFSET 10")
def dead_letters_page(spark, sf_dir):
    return inspection.dead_letter_page(letters(spark, sf_dir), NAME, offset=10).select("id", "stream_id", F.unix_micros("occurred_at").alias("occurred_us"))


@query("dead_letter_count", "SELECT count(*) AS n FROM log WHERE outcome = 'failed' AND stream_id = '7' AND occurred_at >= (SELECT min(occurred_at) FROM log WHERE position = 100)")
def dead_letter_count(spark, sf_dir):
    since = log(spark, sf_dir).where("position = 100").agg(F.min("occurred_at").alias("t"))
    found = inspection.dead_letters(letters(spark, sf_dir), NAME, stream_id="7").join(since, F.col("occurred_at") >= F.col("t"))
    return found.agg(F.count("id").alias("n"))


@query("dead_letter_stats", """SELECT error_kind, n, first_us, last_us FROM (SELECT CASE WHEN g = 0 THEN 'error' END AS error_kind, count(*) AS n, min(epoch_us(occurred_at)) AS first_us, max(epoch_us(occurred_at)) AS last_us
  FROM log, range(2) t(g) WHERE outcome = 'failed' GROUP BY g)""")
def dead_letter_stats(spark, sf_dir):
    return inspection.dead_letter_stats(letters(spark, sf_dir), NAME).select("error_kind", "n", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query("stream_positions", "SELECT CASE WHEN n <= 1000 THEN stream_id END AS stream_id, CASE WHEN n <= 1000 THEN position END AS position, n > 1000 AS truncated FROM (SELECT stream_id, max(position) AS position, count(*) OVER () AS n, row_number() OVER () AS k FROM log GROUP BY stream_id) WHERE n <= 1000 OR k = 1")
def stream_positions(spark, sf_dir):
    return inspection.stream_positions(cursors(log(spark, sf_dir)))


@query("safe_position", "SELECT coalesce(min(p), 0) AS safe_position FROM (SELECT max(position) AS p FROM log GROUP BY stream_id)")
def safe_position(spark, sf_dir):
    return inspection.safe_position(cursors(log(spark, sf_dir)))


@query("cursor_preload", "SELECT stream_id, max(position) AS position FROM log GROUP BY stream_id ORDER BY stream_id LIMIT 10000")
def cursor_preload(spark, sf_dir):
    return inspection.preload(cursors(log(spark, sf_dir)))


@query("watermark_merge", "SELECT type, max(position) AS position, max_by(epoch_us(occurred_at), position) AS occurred_us FROM log GROUP BY type")
def watermark_merge(spark, sf_dir):
    """Progress by event type: what is stored stands at the log's end, what comes in halfway."""
    all_ = log(spark, sf_dir)
    at = lambda events: events.groupBy("type").agg(F.max("position").alias("position"), F.max_by("occurred_at", "position").alias("occurred_at"))
    return ops.merge_progress(at(all_), at(all_.where(F.col("position") <= reached(all_, 5))), "type").select("type", "position", F.unix_micros("occurred_at").alias("occurred_us"))


@query("lag_ms", f"SELECT stream_id, CAST(greatest(0, floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(occurred_at))) / 1000)) AS BIGINT) AS lag_ms FROM log GROUP BY stream_id")
def lag_ms(spark, sf_dir):
    newest = log(spark, sf_dir).groupBy("stream_id").agg(F.max("occurred_at").alias("at"))
    return newest.select("stream_id", scalars.lag_ms(F.col("at"), F.lit(NOW).cast("timestamp")).alias("lag_ms"))


@query("version_isolation", "SELECT 2::INTEGER AS version, stream_id, max(position) AS position FROM log GROUP BY stream_id")
def version_isolation(spark, sf_dir):
    all_ = log(spark, sf_dir)
    both = named(cursors(all_.where(F.col("position") <= reached(all_, 3)))).unionByName(named(cursors(all_), 2))
    return inspection.of(both, NAME, 2).select(F.col("projection_version").alias("version"), "stream_id", "position")


@query("reset_counts", "SELECT (SELECT count(DISTINCT stream_id) FROM log) AS cursors, 1::BIGINT AS progress, (SELECT count(*) FROM log WHERE outcome = 'failed') AS dead_letters")
def reset_counts(spark, sf_dir):
    all_ = log(spark, sf_dir)
    progress = all_.agg(F.max("position").alias("position")).select(F.lit(NAME).alias("projection_name"), F.lit(1).alias("projection_version"), "position")
    return inspection.reset_counts(named(cursors(all_)), progress, letters(spark, sf_dir), NAME, 1, dead_letters_too=True)


# ---------------------------------------------------------------- failures and curves

_STATES = ("23505", "23502", "23503", "23514", "22003", "22001", "22012", "40001", "40P01", "53300", "53200", "57014", "08006", "57P01", "57P02", "57P03", "25006", "42703", "42P01", "42501", "57P04", "40002", "XX000")


@query("failure_classification", "SELECT s AS state, CASE WHEN s = '57P04' THEN 'structural' WHEN s IN ('40001', '40P01', '25006') THEN 'transient' WHEN s[1:2] IN ('22', '23') THEN 'integrity' WHEN s[1:2] IN ('08', '53', '57') THEN 'transient' ELSE 'structural' END AS class FROM (SELECT unnest([" + ", ".join(f"'{s}'" for s in _STATES) + "]) AS s)")
def failure_classification(spark, sf_dir):
    return spark.createDataFrame([(s,) for s in _STATES], "state string").select("state", scalars.failure_class(F.col("state")).alias("class"))


@query("retry_schedule", "SELECT n::BIGINT AS attempt, (CASE n WHEN 1 THEN 100 WHEN 2 THEN 1000 END)::INTEGER AS wait_ms FROM range(1, 3) t(n)")
def retry_schedule(spark, sf_dir):
    return spark.range(1, scalars.RETRY_ATTEMPTS).select(F.col("id").alias("attempt"), scalars.retry_wait(F.col("id")).alias("wait_ms"))


@query("circuit_backoff_curve", "SELECT n::BIGINT AS attempt, (CASE n WHEN 1 THEN 0 WHEN 2 THEN 100 WHEN 3 THEN 500 WHEN 4 THEN 1000 WHEN 5 THEN 5000 WHEN 6 THEN 15000 ELSE 30000 END)::INTEGER AS delay_ms FROM range(1, 11) t(n)")
def circuit_backoff_curve(spark, sf_dir):
    return spark.range(1, 11).select(F.col("id").alias("attempt"), scalars.circuit_delay(F.col("id")).alias("delay_ms"))


_BATCHES = """tally AS (SELECT (position - 1) // 3 AS batch, (position - 1) // 300 AS part, count(*) FILTER (outcome <> 'skipped') AS attempted, count(*) FILTER (outcome = 'applied') AS committed, count(*) FILTER (outcome = 'failed') AS integrity FROM log GROUP BY 1, 2),
  marked AS (SELECT *, attempted > 0 AND committed = 0 AND integrity = attempted AS wiped, sum(CASE WHEN committed > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY part ORDER BY batch) AS island FROM tally),
  streaks AS (SELECT *, CASE WHEN wiped THEN CAST(sum(CASE WHEN wiped THEN 1 ELSE 0 END) OVER (PARTITION BY part, island ORDER BY batch) AS BIGINT) ELSE 0 END AS streak FROM marked)"""


def _tallied(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.batches(handled(spark, sf_dir).drop("batch"), 3).withColumn("part", F.floor((F.col("position") - 1) / 300).cast("bigint"))
    count = lambda *names: F.count(F.when(F.col("outcome").isin(*names), 1))
    return ops.wipeouts(found.groupBy("batch", "part").agg(count("applied", "failed").alias("attempted"), count("applied").alias("committed"), count("failed").alias("integrity")), "part")


@query("wipeout_streak", None)
def wipeout_streak(spark, sf_dir):
    return _tallied(spark, sf_dir).select("batch", "wiped", F.col("streak").cast("bigint").alias("streak"))


@query("wipeout_decision", None)
def wipeout_decision(spark, sf_dir):
    return _tallied(spark, sf_dir).where("wiped").select("batch", "attempted", "halts")


_ORACLES["wipeout_streak"] = f"WITH {LOG}, {_BATCHES} SELECT batch, wiped, streak FROM streaks"
_ORACLES["wipeout_decision"] = f"WITH {LOG}, {_BATCHES} SELECT batch, attempted, attempted > 1 OR streak >= 3 AS halts FROM streaks WHERE wiped"
