"""A target behind JDBC: executors stage a batch's rows, and one transaction merges them with cursors, progress and dead letters.

A batch is folded by Spark against the rows that the database has for its keys (the keys are staged, too, so the database joins them). Staged rows
are written by the executors in parallel; the transaction is a fixed number of statements, whatever the number of events. What the fold
cannot know, such as a value that is too long or a constraint of the database's own, makes the staging or the merge fail; then, and for steps that
do not compose, the batch is applied event by event in one transaction with a savepoint each, so that the database's SQLSTATEs
name the events to blame. Staged tables are dropped after each batch. Texts of dead letters are stored up to 32,000 characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlog import model
from foldlog.functions import failure
from foldlog.functions.failure import CommitFailure
from foldlog.operators import events as ops
from foldlog.operators import folds, handlers, transformers
from foldlog.targets.base import Batch, Report
from foldlog.targets.memory import OneByOne
from foldlog.telemetry import bus

_KINDS = {"string": "VARCHAR(255)", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "timestamp": "TIMESTAMP"}
_WHOSE = "projection_name VARCHAR(255) NOT NULL, projection_version INTEGER NOT NULL"
_ENGINE = {
    "positions": f"CREATE TABLE positions ({_WHOSE}, stream_id VARCHAR(255) NOT NULL, position BIGINT NOT NULL, updated_at TIMESTAMP, PRIMARY KEY (projection_name, projection_version, stream_id))",
    "dead_letters": f"CREATE TABLE dead_letters (id BIGINT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, {_WHOSE}, position BIGINT NOT NULL, stream_id VARCHAR(255), event_type VARCHAR(255), event_data VARCHAR(32000), error_kind VARCHAR(32000) NOT NULL, error_message VARCHAR(32000), error_stacktrace VARCHAR(32000), occurred_at TIMESTAMP NOT NULL)",
    "progress": f"CREATE TABLE progress ({_WHOSE}, position BIGINT NOT NULL, occurred_at TIMESTAMP, updated_at TIMESTAMP, PRIMARY KEY (projection_name, projection_version))",
}


_LETTER = {
    "position": "BIGINT", "stream_id": "VARCHAR(255)", "event_type": "VARCHAR(255)", "event_data": "VARCHAR(32000)", "error_kind": "VARCHAR(32000)", "error_message": "VARCHAR(32000)",
    "error_stacktrace": "VARCHAR(32000)", "occurred_at": "TIMESTAMP",
}


class JdbcTarget(OneByOne):
    def __init__(self, spark: SparkSession, url: str, tables: Iterable[model.Table]):
        self.spark, self.url, self.tables = spark, url, {t.name: t for t in tables}
        self.connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
        self.connection.setAutoCommit(False)

    def create_tables(self, from_: int = 0, to: int = max(model.SCHEMA_TABLES)) -> None:
        """Read models and the engine's tables of the schema versions beyond from_ up to to; those that exist stay."""
        for name in model.schema_steps(from_, to):
            self._create(_ENGINE[name], name)
        for t in self.tables.values():
            columns = [f"{f.name} {_KINDS[f.dataType.simpleString()]}" + (" NOT NULL" if f.name in (*t.key, *t.required) else "") for f in t.schema]
            self._create(f"CREATE TABLE {t.name} ({', '.join(columns)}, PRIMARY KEY ({', '.join(t.key)}))", t.name)
        self.connection.commit()

    def drop_tables(self, from_: int = max(model.SCHEMA_TABLES), to: int = 0) -> None:
        for name in reversed(model.schema_steps(to, from_)):
            if self._there(name):
                self._run(f"DROP TABLE {name}", [])
        self.connection.commit()

    def _there(self, name: str) -> bool:
        found = self.connection.getMetaData().getTables(None, None, name.upper(), None)
        there = found.next()
        found.close()
        return there

    def _create(self, sql: str, name: str) -> None:
        if not self._there(name):
            self._run(sql, [])

    def _run(self, sql: str, values: list) -> int:
        from py4j.protocol import Py4JJavaError

        try:
            statement = self.connection.prepareStatement(sql)
            for i, v in enumerate(values, 1):
                statement.setString(i, None if v is None else str(v))
            n = statement.executeUpdate()
            statement.close()
            return n
        except Py4JJavaError as e:
            cause = e.java_exception
            raise CommitFailure(cause.getSQLState() if hasattr(cause, "getSQLState") else None, str(cause.getMessage())) from e

    def _query(self, sql: str, n: int, values: list) -> list[tuple]:
        statement = self.connection.prepareStatement(sql)
        for i, v in enumerate(values, 1):
            statement.setString(i, str(v))
        found = statement.executeQuery()
        rows = []
        while found.next():
            rows.append(tuple(found.getObject(i) for i in range(1, n + 1)))
        statement.close()
        return rows

    def cursors(self, spark, identity):
        rows = self._query("SELECT stream_id, position FROM positions WHERE projection_name = ? AND projection_version = CAST(? AS INTEGER)", 2, list(identity))
        return spark.createDataFrame(rows, "stream_id string, position bigint")

    def commit(self, spark, batch, guard):
        stats = batch.stats()
        whole = all(t in self.tables and transformers.composes(self.tables[t], [(c, w) for name, c, w in stats["filters"] if name == t]) for t in stats["tables"])
        if not whole or any(c not in self.tables[t].schema.fieldNames() for t, c in stats["columns"]):
            return super().commit(spark, batch, guard)
        staged: list[str] = []
        try:
            try:
                broken, tables = self._staged(spark, batch, staged)
            except Exception:  # which event is to blame, the database says
                self.connection.rollback()
                return super().commit(spark, batch, guard)
            report = Report(stats["applied"], stats["applied"] - len(broken), sorted(broken.items()))
            guard(report)
            try:
                self._merge(batch, tables)
            except CommitFailure as e:
                self.connection.rollback()
                if failure.classify(e) != failure.INTEGRITY:
                    raise
                return super().commit(spark, batch, guard)
            if bus.listens("dead_letter"):
                rows = self._query(f"SELECT position, {', '.join(self._text(c, _LETTER[c]) for c in ('stream_id', 'event_type', 'error_kind'))} FROM {tables['dead_letters']} ORDER BY position", 4, [])
                report.letters = [dict(zip(("position", "stream_id", "event_type", "error_kind"), r, strict=True)) for r in rows]
            return report
        finally:
            for name in staged:
                self._run(f"DROP TABLE {name}", [])
            self.connection.commit()

    def _stage(self, frame: DataFrame, columns: dict[str, str], staged: list[str]) -> str:
        """A table of the frame's rows, written by the executors. Texts begin with a mark, as a null is an empty one; see _text."""
        name = f"staged_{uuid.uuid4().hex}"
        wider = {c: f"VARCHAR({int(kind[8:-1]) + 1})" if kind.startswith("VARCHAR") else kind for c, kind in columns.items()}
        self._run(f"CREATE TABLE {name} ({', '.join(f'{c} {kind}' for c, kind in wider.items())})", [])
        self.connection.commit()
        staged.append(name)
        marked = [F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c) if kind.startswith("VARCHAR") else F.col(c) for c, kind in columns.items()]
        frame.select(*marked).write.mode("append").jdbc(self.url, name)
        return name

    @staticmethod
    def _text(column: str, kind: str) -> str:
        """A staged column as it was given."""
        return f"CASE WHEN {column} = '' THEN CAST(NULL AS {kind}) ELSE CAST(SUBSTR({column}, 2) AS {kind}) END" if kind.startswith("VARCHAR") else column

    def _columns(self, table: model.Table) -> dict[str, str]:
        return {f.name: _KINDS[f.dataType.simpleString()] for f in table.schema}

    def _held(self, spark: SparkSession, table: model.Table, steps: DataFrame, staged: list[str]) -> DataFrame:
        """The rows that the database has for the steps' keys."""
        kinds = self._columns(table)
        key = {k: kinds[k] for k in table.key}
        asked = transformers.keys(steps, table).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema if f.name in key))
        keys = self._stage(asked.dropna().distinct(), key, staged)
        query = f"SELECT {', '.join(f't.{c}' for c in kinds)} FROM {table.name} t JOIN {keys} k ON {' AND '.join(f't.{c} = {self._text(f'k.{c}', kind)}' for c, kind in key.items())}"
        found = spark.read.format("jdbc").option("url", self.url).option("query", query).load()
        return found.select(*(F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(found.columns, table.schema, strict=True)))

    def _staged(self, spark: SparkSession, batch: Batch, staged: list[str]) -> tuple[dict[int, str], dict[str, str]]:
        """What breaks a constraint, and the staged tables: rows by read model, positions and dead letters."""
        stats, outcomes = batch.stats(), batch.outcomes
        steps = folds.steps_of(outcomes.where("outcome = 'applied'"))
        held = {t: self._held(spark, self.tables[t], steps, staged) for t in sorted(stats["tables"])}
        broken: dict[int, str] = {}
        while True:  # an event goes whole: without its broken step, its others go, too
            left = steps if not broken else steps.join(spark.createDataFrame([(p,) for p in broken], "position bigint"), "position", "left_anti")
            done = {t: transformers.settle(left, held[t], self.tables[t], many=stats["applied"] * (stats["most"] or 0) > transformers.HOT_STEPS) for t in held}
            fresh = {r[0]: r[1] for d in done.values() for r in d.broken().collect()}
            new = set(fresh) - set(broken)
            broken |= fresh
            if not new or (stats["most"] or 0) <= 1:
                break
        tables = {t: self._stage(folds.typed(d.rows, self.tables[t]).withColumn("gone", F.col("__deleted").cast("int")), self._columns(self.tables[t]) | {"gone": "INTEGER"}, staged) for t, d in done.items()}
        tables["positions"] = self._stage(ops.advances(outcomes), {"stream_id": "VARCHAR(255)", "position": "BIGINT"}, staged)
        states = spark.createDataFrame([(p, f"commit:{failure.label_of_state(s)}") for p, s in broken.items()], "position bigint, failure string")
        failed = outcomes.join(states, "position", "left").where("outcome in ('failed', 'invalid', 'collision') or (outcome = 'applied' and failure is not null)")
        failed = failed.withColumn("failure", F.coalesce("failure", F.when(F.col("outcome") == "collision", "multi_key_collision")))
        letters = handlers.dead_letter_rows(failed, *batch.identity, batch.recorded_at)
        cut = {c: F.substring(c, 1, 32000) for c, kind in _LETTER.items() if kind == "VARCHAR(32000)"}
        tables["dead_letters"] = self._stage(letters.withColumns(cut), _LETTER, staged)
        return broken, tables

    def _merge(self, batch: Batch, tables: dict[str, str]) -> None:
        """Rows, cursors, dead letters and progress from the staged tables, in one transaction."""
        mine, now = list(batch.identity), datetime.now(timezone.utc).replace(tzinfo=None)
        for t in sorted(batch.stats()["tables"]):
            kinds = self._columns(self.tables[t])
            same = " AND ".join(f"{self._text(f's.{k}', kinds[k])} = {t}.{k}" for k in self.tables[t].key)
            self._run(f"DELETE FROM {t} WHERE EXISTS (SELECT 1 FROM {tables[t]} s WHERE {same})", [])
            self._run(f"INSERT INTO {t} ({', '.join(kinds)}) SELECT {', '.join(self._text(c, kind) for c, kind in kinds.items())} FROM {tables[t]} WHERE gone = 0", [])
        moved, whose = tables["positions"], "projection_name = ? AND projection_version = CAST(? AS INTEGER)"
        stream = self._text("s.stream_id", "VARCHAR(255)")
        same = f"(SELECT s.position FROM {moved} s WHERE {stream} = positions.stream_id)"
        self._run(f"UPDATE positions SET updated_at = CAST(? AS TIMESTAMP), position = CASE WHEN position < {same} THEN {same} ELSE position END WHERE {whose} AND EXISTS {same}", [now, *mine])
        self._run(
            f"INSERT INTO positions SELECT CAST(? AS VARCHAR(255)), CAST(? AS INTEGER), {stream}, s.position, CAST(? AS TIMESTAMP) FROM {moved} s "
            f"WHERE NOT EXISTS (SELECT 1 FROM positions p WHERE p.{whose.replace('AND ', 'AND p.')} AND p.stream_id = {stream})", [*mine, now, *mine],
        )
        self._run(
            f"INSERT INTO dead_letters (projection_name, projection_version, {', '.join(_LETTER)}) SELECT CAST(? AS VARCHAR(255)), CAST(? AS INTEGER), "
            f"{', '.join(self._text(c, kind) for c, kind in _LETTER.items())} FROM {tables['dead_letters']} ORDER BY position", mine,
        )
        self._progress(batch, mine, now)
        self.connection.commit()

    def begin(self):
        return self.connection

    def abandon(self, txn):
        txn.rollback()

    def apply(self, txn, event):
        point = txn.setSavepoint()
        try:
            for s in event["result"]["steps"]:
                self._step(s)
        except CommitFailure:
            txn.rollback(point)
            raise
        txn.releaseSavepoint(point)

    def _step(self, s: dict) -> None:
        where, values, add = s["key"] or {}, s["set"] or {}, s["inc"] or {}
        test = " AND ".join(f"{c} IS NULL" if v is None else f"{c} = {self._slot(s['table'], c)}" for c, v in where.items()) or "1 = 1"
        given = [v for v in where.values() if v is not None]
        if s["action"] == "delete":
            self._run(f"DELETE FROM {s['table']} WHERE {test}", given)
            return
        if s["action"] in ("update", "upsert"):
            parts = [f"{c} = {self._slot(s['table'], c)}" for c in values] + [f"{c} = {c} + {self._slot(s['table'], c)}" for c in add]
            hit = self._run(f"UPDATE {s['table']} SET {', '.join(parts)} WHERE {test}", [*values.values(), *add.values(), *given])
            if hit or s["action"] == "update":
                return
        row = where | values | add
        self._run(f"INSERT INTO {s['table']} ({', '.join(row)}) VALUES ({', '.join(self._slot(s['table'], c) for c in row)})", list(row.values()))

    def _slot(self, table: str, column: str) -> str:
        own = self.tables.get(table)
        field = {f.name: f for f in own.schema}.get(column) if own else None
        kind = _KINDS[field.dataType.simpleString()] if field else "VARCHAR"
        return "?" if kind.startswith("VARCHAR") else f"CAST(? AS {kind})"  # a cast would cut long texts off without a word

    def finish(self, txn, batch, advances, letters):
        whose, mine = "projection_name = ? AND projection_version = CAST(? AS INTEGER)", list(batch.identity)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        for stream, position in advances.items():
            hit = self._run(f"UPDATE positions SET position = CASE WHEN position < CAST(? AS BIGINT) THEN CAST(? AS BIGINT) ELSE position END, updated_at = CAST(? AS TIMESTAMP) WHERE {whose} AND stream_id = ?", [position, position, now, *mine, stream])
            if not hit:
                self._run("INSERT INTO positions VALUES (?, CAST(? AS INTEGER), ?, CAST(? AS BIGINT), CAST(? AS TIMESTAMP))", [*mine, stream, position, now])
        for x in letters:
            values = [*mine, x["position"], x["stream_id"], x["event_type"], *(None if v is None else v[:32000] for v in (x["event_data"], x["error_kind"], x["error_message"], x["error_stacktrace"])), now]
            self._run("INSERT INTO dead_letters (projection_name, projection_version, position, stream_id, event_type, event_data, error_kind, error_message, error_stacktrace, occurred_at) VALUES (?, CAST(? AS INTEGER), CAST(? AS BIGINT), ?, ?, ?, ?, ?, ?, CAST(? AS TIMESTAMP))", values)
        self._progress(batch, mine, now)
        txn.commit()

    def _progress(self, batch: Batch, mine: list, now: datetime) -> None:
        whose = "projection_name = ? AND projection_version = CAST(? AS INTEGER)"
        stats = batch.stats()
        if stats["top"] is not None:
            hit = self._run(f"UPDATE progress SET position = CAST(? AS BIGINT), occurred_at = CAST(? AS TIMESTAMP), updated_at = CAST(? AS TIMESTAMP) WHERE {whose} AND position <= CAST(? AS BIGINT)", [stats["top"], stats["at"], now, *mine, stats["top"]])
            if not hit and not self._query(f"SELECT position FROM progress WHERE {whose}", 1, mine):
                self._run("INSERT INTO progress VALUES (?, CAST(? AS INTEGER), CAST(? AS BIGINT), CAST(? AS TIMESTAMP), CAST(? AS TIMESTAMP))", [*mine, stats["top"], stats["at"], now])

    def table(self, spark, name):
        found = spark.read.format("jdbc").option("url", self.url).option("dbtable", name).load()
        return found.select(*(F.col(c).alias(c.lower()) for c in found.columns))

    def reset(self, spark, identity, dead_letters=False):
        names = ["positions", "progress", *(["dead_letters"] if dead_letters else [])]
        counts = {n: self._run(f"DELETE FROM {n} WHERE projection_name = ? AND projection_version = CAST(? AS INTEGER)", list(identity)) for n in names}
        self.connection.commit()
        return counts
