"""Tables in Parquet with atomic epochs: data first, then one manifest by an atomic rename.

A manifest names the live folders of all tables at once, so a reader sees an epoch's rows, cursors and dead letters
together or none of them. Each epoch adds a folder of changed rows; readers take the newest of each key. A batch id that the manifest lists
for its run is not applied again. Two writers race for the same manifest number; the loser cannot create it and raises.

When a level has more than ``compact_at`` folders, these are merged into one of the next level, so a row is rewritten once a level. Merged folders are
partitioned by a hash of the key (``buckets`` of them): a pass reads of these the buckets that its own keys fall into, and of the others the
small folders of late epochs. Folders that no manifest names any more, and old manifests, are deleted ``retain_seconds`` later;
a reader that takes longer than that with one manifest has to begin again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Collection, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldlog import model
from foldlog.functions.failure import CommitFailure, label_of_state
from foldlog.operators import events as ops
from foldlog.operators import folds, handlers, inspection, transformers
from foldlog.streaming import files
from foldlog.targets.base import Batch, Refused, Report, Target
from foldlog.telemetry import bus

COMPACT_AT, BUCKETS, RETAIN_SECONDS = 24, 64, 3600.0
#: What makes a cursor one row.
_CURSOR = ("projection_name", "projection_version", "stream_id")


def _level(path: str) -> int:
    """0 for an epoch's own rows; the name of a merged folder tells its level."""
    return int(path.rpartition("-L")[2]) if "-L" in path.rpartition("/")[2] else 0


def _none(spark: SparkSession, ddl: str) -> DataFrame:
    """No rows, which the optimizer knows, so that joins with them are left out of plans."""
    return spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ddl)))


class EpochTarget(Target):
    def __init__(self, root: str, tables: Iterable[model.Table], compact_at: int = COMPACT_AT, buckets: int = BUCKETS, retain_seconds: float = RETAIN_SECONDS):
        self.root, self.tables, self.compact_at = root.rstrip("/"), {t.name: t for t in tables}, compact_at
        self.buckets, self.retain_seconds = buckets, retain_seconds

    def manifest(self, spark: SparkSession) -> dict:
        done = self._manifests(spark)
        if not done:
            return {"number": 0, "live": {}, "applied": {}, "letters": 0, "progress": {}, "dead": []}
        text = files.read(spark, f"{self.root}/manifests/{done[-1]:012d}.json")
        return self.manifest(spark) if text is None else {"dead": []} | json.loads(text)  # None: cleared meanwhile, so a newer one is there

    def _manifests(self, spark: SparkSession) -> list[int]:
        return [int(n[:-5]) for n in files.names(spark, f"{self.root}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def publish(self, spark: SparkSession, found: dict) -> None:
        """Make a manifest the newest; fails if another writer has taken its number."""
        found = found | {"number": found["number"] + 1}
        if not files.create(spark, f"{self.root}/manifests/{found['number']:012d}.json", json.dumps(found)):
            raise CommitFailure("40001", "another writer published this epoch")
        done = self._manifests(spark)
        if done[-1] != found["number"]:  # the number was free only because it is so old that it was cleared
            raise CommitFailure("40001", "another writer published later epochs")

    # reading

    def _key(self, name: str) -> tuple[str, ...]:
        return {"positions": _CURSOR, "dead_letters": ()}.get(name) or (self.tables[name].key if name in self.tables else ())

    def bucket(self, *key: Column) -> Column:
        """The bucket of a key, whose values are given as texts."""
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _raw(self, spark: SparkSession, name: str, found: dict, buckets: Collection[int] | None = None) -> DataFrame:
        """All rows of the live folders; of merged ones, those of the buckets only, if such are given."""
        schema = model.SCHEMAS[name] if name in model.SCHEMAS else self.tables[name].ddl + ", __deleted boolean"
        full = f"{schema}, __epoch bigint"
        paths = found["live"].get(name, [])
        late, merged = ([f"{self.root}/{p}" for p in paths if (_level(p) > 0) == deep] for deep in (False, True))
        rows = spark.read.schema(full).parquet(*late) if late else None
        for path in merged:
            deep = spark.read.schema(f"{full}, __bucket int").parquet(path)
            deep = (deep if buckets is None else deep.where(F.col("__bucket").isin(*buckets))).drop("__bucket")
            rows = deep if rows is None else rows.unionByName(deep)
        return _none(spark, full) if rows is None else rows

    def touched(self, keys: DataFrame, name: str, found: dict) -> list[int] | None:
        """The buckets that keys (columns of texts) fall into; None if nothing is merged yet, so that nothing is to be left out."""
        if not any(_level(p) for p in found["live"].get(name, [])):
            return None
        return [r[0] for r in keys.select(self.bucket(*map(F.col, keys.columns))).distinct().collect()]  # at most as many as there are buckets

    @staticmethod
    def _newest(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
        rest = [c for c in rows.columns if c not in key]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")

    def _rows(self, name: str, rows: DataFrame) -> DataFrame:
        """The newest row of each key, with its epoch; dead letters as they are."""
        if name == "positions":
            return self._newest(rows, _CURSOR, F.struct("position", "__epoch"))
        return self._newest(rows, self._key(name), F.col("__epoch")) if self._key(name) else rows

    def table(self, spark, name, found=None, buckets=None):
        found = found or self.manifest(spark)
        if name == "progress":
            rows = [(k.rpartition("/")[0], int(k.rpartition("/")[2]), *v) for k, v in found["progress"].items()]
            read = spark.createDataFrame(rows, "projection_name string, projection_version int, position bigint, at bigint, written bigint")
            return read.select("projection_name", "projection_version", "position", F.timestamp_micros("at").alias("occurred_at"), F.timestamp_micros("written").alias("updated_at"))
        rows = self._rows(name, self._raw(spark, name, found, buckets)).drop("__epoch")
        if name in model.SCHEMAS:
            return rows
        return rows.where("not __deleted").select(*[f.name for f in self.tables[name].schema])

    def cursors(self, spark, identity):
        return inspection.of(self.table(spark, "positions"), *identity).select("stream_id", "position")

    def cursors_of(self, spark, identity, events):
        """The cursors of the events' streams, and what else is in their buckets."""
        found = self.manifest(spark)
        keys = events.select(F.lit(identity[0]).alias("n"), F.lit(str(identity[1])).alias("v"), F.col("stream_id"))
        return inspection.of(self.table(spark, "positions", found, self.touched(keys, "positions", found)), *identity).select("stream_id", "position")

    @staticmethod
    def _run(identity: tuple[str, int], run: str | None) -> str:
        return f"{identity[0]}/{identity[1]}" + (f"/{run}" if run else "")

    def already(self, identity, batch_id, spark=None, run=None):
        spark = spark or SparkSession.active()
        return batch_id <= self.manifest(spark)["applied"].get(self._run(identity, run), -1)

    # writing

    def _write(self, frame: DataFrame, name: str, number: int) -> str:
        path = f"data/{name}/{number:012d}-{uuid.uuid4().hex}"
        frame.withColumn("__epoch", F.lit(number).cast("bigint")).write.parquet(f"{self.root}/{path}")
        return path

    def commit(self, spark, batch: Batch, guard) -> Report:
        found = self.manifest(spark)
        number, (name, version) = found["number"] + 1, batch.identity
        outcomes, stats = batch.outcomes, batch.stats()
        self._known(stats)
        columns = lambda t: [x.split()[0] for x in model.SCHEMAS[t].split(", ")]
        moved = ops.advances(outcomes).select(F.lit(name).alias("projection_name"), F.lit(version).alias("projection_version"), "stream_id", "position", batch.recorded_at.alias("updated_at"))
        with ThreadPoolExecutor(1) as pool:  # cursors are staged while rows are folded; neither is there before the manifest
            positions = pool.submit(self._write, moved.select(*columns("positions")), "positions", number)
            broken, staged, passing = self._settled(spark, found, outcomes, stats, number)
        staged["positions"] = positions.result()
        report = Report(stats["applied"], stats["applied"] - len(broken), broken)
        guard(report)
        n_letters = stats["failed"] + stats["invalid"] + stats["collision"] + len(broken)
        if n_letters:
            staged["dead_letters"] = self._write(self._letters(spark, batch, broken, found["letters"] + 1, n_letters).select(*columns("dead_letters")), "dead_letters", number)
        live = {k: list(v) for k, v in found["live"].items()}
        for t, path in staged.items():
            live.setdefault(t, []).append(path)
        key = f"{name}/{version}"
        reached = found["progress"] | ({key: self._reached(found["progress"].get(key), stats)} if stats["top"] is not None else {})
        dead = found["dead"] + [[path, time.time()] for path in passing]
        self.publish(spark, found | {"live": live, "dead": dead, "letters": found["letters"] + n_letters, "progress": reached, "applied": found["applied"] | ({} if batch.batch_id is None else {self._run(batch.identity, batch.run): batch.batch_id})})
        if n_letters and bus.listens("dead_letter"):
            rows = spark.read.parquet(f"{self.root}/{staged['dead_letters']}").select("position", "stream_id", "event_type", "error_kind").orderBy("position").collect()  # a batch's letters
            report.letters = [r.asDict() for r in rows]
        if any(sum(_level(p) == 0 for p in v) > self.compact_at for v in live.values()):
            self.compact(spark)
        return report

    @staticmethod
    def _reached(old: list | None, stats: dict) -> list:
        """[position, event time, time of writing] in microseconds; never back, the newer row on a tie."""
        micros = lambda t: None if t is None else round(t.replace(tzinfo=timezone.utc).timestamp() * 1e6)
        return old if old and old[0] > stats["top"] else [stats["top"], micros(stats["at"]), micros(datetime.now(timezone.utc))]

    def _letters(self, spark: SparkSession, batch: Batch, broken: Sequence[tuple[int, str]], first: int, n: int) -> DataFrame:
        failed = batch.outcomes.withColumn("failure", F.when(F.col("outcome") == "collision", "multi_key_collision"))
        if len(broken):
            labels = F.create_map(*(F.lit(x) for r in broken.frame.select("state").distinct().collect() for x in (r[0], f"commit:{label_of_state(r[0])}")))  # a handful of states
            states = broken.frame.select("position", labels[F.col("state")].alias("__state"))
            failed = failed.join(states, "position", "left").withColumn("failure", F.coalesce("failure", F.when(F.col("outcome") == "applied", F.col("__state"))))
        failed = failed.where("outcome in ('failed', 'invalid', 'collision') or failure is not null").select(*batch.outcomes.columns, "failure")
        breaks, held = [], None
        if batch.stats()["top"] is not None and n > inspection.NUMBERED_TOGETHER:
            at = batch.outcomes.where("outcome in ('failed', 'invalid', 'collision')").select("position")  # and of applied ones those that are broken: no join tells how many stand where
            at = at.unionByName(broken.frame.select("position")) if len(broken) else at
            found = list(ops.counted_ranges(at, batch.stats()["bottom"], batch.stats()["top"], inspection.NUMBERED_TOGETHER, n))
            breaks, held = [a for a, _, _ in found], [k for *_, k in found]
        return inspection.numbered(handlers.dead_letter_rows(failed, *batch.identity, batch.recorded_at), first, breaks, held)

    def _known(self, stats: dict) -> None:
        for t in sorted(map(str, stats["tables"] - set(self.tables))):
            raise CommitFailure("42P01", f"no table {t}")
        for t, c in sorted(stats["columns"]):
            if c not in self.tables[t].schema.fieldNames():
                raise CommitFailure("42703", f"no column {c} in {t}")

    def _settled(self, spark: SparkSession, found: dict, outcomes: DataFrame, stats: dict, number: int) -> tuple[Sequence[tuple[int, str]], dict[str, str], list[str]]:
        """Fold the applied events of a batch into staged rows, without those that break a constraint; an event goes whole.

        Returns what is broken, the staged folders, and the folders that only this pass needs: positions of broken events stay on the executors.
        """
        steps = folds.steps_of(outcomes.where("outcome = 'applied'"))
        broken, passing = Refused(spark.createDataFrame([], "position bigint, state string"), 0), []
        # filters that do not name a whole key reach any row
        loose: dict[str, list[tuple[tuple[str, ...], tuple[str, ...]]]] = {}
        for t, columns, written in sorted(stats["filters"]):
            if not set(self.tables[t].key) <= set(columns):
                loose.setdefault(t, []).append((columns, written))
        while True:
            left = steps if not broken else steps.join(broken.frame, "position", "left_anti")
            staged, fresh = {}, []
            for t in sorted(stats["tables"]):
                table = self.tables[t]
                asked = [(columns, written) for name, columns, written in stats["filters"] if name == t]
                composes = transformers.composes(table, asked)
                buckets = self.touched(transformers.keys(left, table), t, found) if composes else None
                current = self.table(spark, t, found, buckets)
                if composes:
                    done = transformers.settle(left, current, table, many=stats["applied"] * (stats["most"] or 0) > transformers.HOT_STEPS)
                else:
                    done = transformers.Settled(folds.fold(left, current, table, loose.get(t, ())))
                staged[t] = self._write(folds.typed(done.rows, table, "broken"), t, number)
                written = transformers.Settled(spark.read.parquet(f"{self.root}/{staged[t]}"), done.faults)
                fresh.append(written.broken())
            new = self._refused(spark, fresh, broken, number, (stats["most"] or 0) > 1)
            if new is None:
                return broken, staged, passing
            passing.append(new[0])
            broken = new[1]
            if (stats["most"] or 0) <= 1 and not loose:
                return broken, staged, passing

    def _refused(self, spark: SparkSession, fresh: list[DataFrame], known: Refused, number: int, several: bool = True) -> tuple[str, Refused] | None:
        """What was broken and what is now, a row for each event, and its folder; None if there is nothing new. several: whether an event may have several steps."""
        if not fresh:
            return None
        both = reduce(DataFrame.unionByName, (f.withColumn("__t", F.lit(i)) for i, f in enumerate(fresh)))
        one = both.groupBy("position").agg(F.max_by("state", F.struct("__t", "state")).alias("state")) if several else both.drop("__t")
        if known:
            one = one.join(known.frame, "position", "left_anti").unionByName(known.frame)
        path = f"data/refused/{number:012d}-{uuid.uuid4().hex}"
        one.write.parquet(f"{self.root}/{path}")
        frame = spark.read.schema("position bigint, state string").parquet(f"{self.root}/{path}")
        n = frame.count()
        if n == len(known):
            files.remove(spark, f"{self.root}/{path}")
            return None
        return path, Refused(frame, n)

    def compact(self, spark: SparkSession) -> None:
        """Merge the folders of each crowded level into one of the next, and clear what has been dead long enough."""
        found = self.manifest(spark)
        live, gone = {k: list(v) for k, v in found["live"].items()}, []

        def merge(name: str) -> None:
            level = 0
            while sum(_level(p) == level for p in live[name]) > self.compact_at:
                own = [p for p in live[name] if _level(p) == level]
                deeper = any(_level(p) > level for p in live[name])
                live[name] = [p for p in live[name] if p not in own] + [self._merged(spark, name, own, level + 1, found["number"], deeper)]
                gone.extend(own)
                level += 1

        with ThreadPoolExecutor(max(1, len(live))) as pool:  # tables are merged beside each other
            list(pool.map(merge, live))
        now = time.time()
        due = [p for p, since in found["dead"] if now - since >= self.retain_seconds]
        if gone or due:
            kept = [[p, since] for p, since in found["dead"] if p not in due]
            self.publish(spark, found | {"live": live, "dead": kept + [[p, now] for p in gone]})
        for path in due:
            files.remove(spark, f"{self.root}/{path}")
        for name, written in files.times(spark, f"{self.root}/manifests"):
            if name.endswith(".json") and int(name[:-5]) < found["number"] and now - written >= self.retain_seconds:
                files.remove(spark, f"{self.root}/manifests/{name}")

    def _merged(self, spark: SparkSession, name: str, paths: list[str], level: int, number: int, deeper: bool) -> str:
        """One folder in place of several, by buckets; what is deleted is kept only as long as a deeper level may have it."""
        rows = self._rows(name, self._raw(spark, name, {"live": {name: paths}}))
        if "__deleted" in rows.columns and not deeper:
            rows = rows.where("not __deleted")
        key = [F.col(c).cast("string") for c in self._key(name)]
        path = f"data/{name}/{number:012d}-{uuid.uuid4().hex}-L{level}"
        if not key:  # dead letters are never looked up by bucket: they are put together as they stand
            rows.hint("rebalance").write.parquet(f"{self.root}/{path}")
            return path
        rows.withColumn("__bucket", self.bucket(*key)).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{path}")
        return path

    def reset(self, spark, identity, dead_letters=False):
        found = self.manifest(spark)
        key = f"{identity[0]}/{identity[1]}"
        live, dead, counts = dict(found["live"]), list(found["dead"]), {"progress": int(key in found["progress"])}
        for name in ["positions", *(["dead_letters"] if dead_letters else [])]:
            rows = self.table(spark, name, found)
            counts[name] = inspection.of(rows, *identity).count()
            kept = rows.where(~((F.col("projection_name") == identity[0]) & (F.col("projection_version") == identity[1])))
            dead += [[p, time.time()] for p in live.get(name, [])]
            live[name] = [self._write(kept, name, found["number"] + 1)]
        without = lambda d: {k: v for k, v in d.items() if k != key and not k.startswith(f"{key}/")}
        self.publish(spark, found | {"live": live, "dead": dead, "applied": without(found["applied"]), "progress": without(found["progress"])})
        return counts
