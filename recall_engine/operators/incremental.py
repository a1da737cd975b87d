"""The fold kept up to date: batches of events go into a store, and its tables are those of ``fold.project`` over all of them.

The store is a folder of runs. What a batch brings is written once, where it lies, decoded and laid out by kind. Which of it is ready
is told from coordinates and ids alone: these, the origins' checkpoints and the coordinates of the events that still wait for a
gap to close meet, and each gets a state and the place of its event, the batch that brought it and its row there. So payloads don't
travel when a batch is applied, an event that waits is not written again, and the cost follows the batch and the coordinates of what
waits, not the log. Those ready are one new run. A commit names the runs that count; whatever a failed attempt left isn't named
and does no harm. The same batch may be applied again: it starts from the commit before, and gives the same.

Runs are merged in levels: ``fan`` runs of a level become one of the next, sorted by the key that each kind is looked up by,
and rows that can't change any table any more go: of additions that name the same thing all but the first, of removals
all but one for each thing and right to remove. Each event is rewritten once for each level, which is the logarithm of the log.

Events at or below an origin's checkpoint have been applied and are skipped; of two that claim one place the first to be applied
stays, and within a batch the least id. Events beyond a gap wait, or fail the batch if it is told so.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recall_engine.operators.chain import with_own_id
from recall_engine.operators.fold import ORDER, Decoded, ordered, project
from recall_engine.schemas import ENVELOPE, PAYLOADS

ORIGIN = ("device_id", "generation")
_COMMIT = "batch bigint, runs array<string>, applied bigint, waiting bigint, refused bigint"
#: What becomes of an event of a batch.
READY, WAITING, REFUSED = "ready", "waiting", "refused"
#: What is known of an event without its payload: sound is null where nobody looked.
_STATES = "event_id string, event_type string, device_id string, generation int, sequence bigint, previous_event_id string, sound boolean, home bigint, row bigint"
#: So many places are told to all tasks that look for their events; more are joined.
FEW = 100_000
#: What an event can't do without.
NEEDED = ("event_id", "event_type", "device_id", "generation", "sequence", "payload")

#: How each kind may be thinned: its key, and which of the rows of one key count. Kinds that aren't named keep all rows.
FIRST, LAST, ANY = "first", "last", "any"
THIN = {
    "message.retract": ("message_id", FIRST),
    "topic.link.add": ("link_id", FIRST),
    "blob.pin": ("pin_id", FIRST),
    "derivative.publish": ("derivative_id", LAST),
    "derivative.fail": ("derivative_id", LAST),
    "derivative.invalidate": ("derivative_id", ANY),
}
#: Kinds that list what they remove: the list's column.
LISTED = {"topic.link.remove": "removed_link_ids", "blob.unpin": "pin_ids"}
#: What the other kinds are looked up by, in the order of their rows.
SORTED = {"message.publish": "message_id", "message.revise_body": "message_id", "signal.emit": "message_id", "topic.create": "name"}


class GapError(ValueError):
    """Events came whose predecessors are not there."""


def _column(kind: str) -> str:
    return kind.replace(".", "_")


def _decoded(events: DataFrame) -> DataFrame:
    """Events with one struct for each kind, of which only their own isn't null; payloads are parsed once."""
    own = [F.when(F.col("event_type") == k, F.from_json("payload", d)).alias(_column(k)) for k, d in PAYLOADS.items()]
    return events.select("*", *own)


def thinned(kind: str, rows: DataFrame) -> DataFrame:
    """The rows of a kind, as ``fold.decoded`` gives them, without those that no table depends on."""
    if kind in LISTED:
        c = LISTED[kind]
        each = rows.withColumn("_one", F.explode(c)).withColumn("_may", F.col("actor") == "operator")
        w = Window.partitionBy("_one", "_may").orderBy("_at")
        kept = each.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
        return kept.withColumn(c, F.array("_one")).select(rows.columns)
    if kind not in THIN:
        return rows
    key, which = THIN[kind]
    w = Window.partitionBy(key).orderBy(F.desc("_at") if which == LAST else "_at")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def _names(ddl: str) -> list[str]:
    return [f.name for f in T.StructType.fromDDL(ddl).fields]


class Places(NamedTuple):
    """Where events lie, what their batches brought, None without events, and the kinds that are among them."""

    places: DataFrame
    brought: DataFrame | None
    kinds: set[str]

    def events(self, kind: str | None = None) -> DataFrame:
        """The events, or those of one kind; only the columns that are asked for travel, and none if the places are few."""
        places, brought = self.places, self.brought
        if kind is not None:
            places, brought = places.filter(F.col("event_type") == kind), brought.filter(F.col("event_type") == kind)
        return brought.join(places.select("home", "row"), ["home", "row"], "left_semi")


class Store:
    """A folded log in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = 8) -> None:
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan

    @classmethod
    def create(cls, spark: SparkSession, folder: str, fan: int = 8) -> Store:
        """A new, empty store; the commit before the first batch."""
        own = cls(spark, folder, fan)
        none = spark.createDataFrame([], ENVELOPE)
        own._write_origins(none.groupBy(*ORIGIN).agg(F.max("sequence").alias("last"), F.max("event_id").alias("head")), -1)
        own._commit(-1, [], 0, 0, 0)
        return own

    # Commits

    def _commit(self, batch: int, runs: list[str], applied: int, waiting: int, refused: int) -> None:
        self.spark.createDataFrame([(batch, runs, applied, waiting, refused)], _COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.folder}/commits/n={batch}")

    def commit(self, before: int | None = None) -> T.Row | None:
        """The last commit, or the last one before a batch."""
        held = self.spark.read.schema(f"{_COMMIT}, n bigint").json(f"{self.folder}/commits")
        held = held if before is None else held.filter(F.col("n") < before)
        return held.orderBy(F.desc("n")).first()

    def _write_origins(self, origins: DataFrame, batch: int) -> None:
        origins.write.mode("overwrite").parquet(f"{self.folder}/origins/n={batch}")

    # Applying

    def apply(self, batch: DataFrame, n: int, on_gap: str = "wait", verify: bool = False) -> dict[str, int]:
        """Applies a batch of events as number n; returns how many were applied, wait or were refused. A batch before the last one has
        been applied for good and is skipped. on_gap: wait, or fail, which changes nothing. verify refuses an event that doesn't name
        the one before it, or whose id doesn't commit to what it says, and what follows it in its origin's batch; the
        origin's checkpoint stays before it, so a sound event may still take its place."""
        if on_gap not in ("wait", "fail"):
            raise ValueError(f"on_gap must be wait or fail, not {on_gap!r}")
        last = self.commit()
        if last is None:
            raise ValueError("not a store: create it first")
        if n < last.batch:
            return {"applied": 0, "waiting": last.waiting, "refused": 0}
        if n < 0:
            raise ValueError("batches are numbered from 0")
        before = last if last.batch < n else self.commit(n)
        origins = self.origins(before.batch)
        self._bring(self._known(batch), n, verify)
        new = self._brought([n]).select(*_names(_STATES))
        if before.waiting:
            new = new.unionByName(self._looked_at(self._states(before.batch, WAITING), verify))
        # What follows needs an origin's events together: a batch's coordinates, and those that wait.
        new = new.repartition(*ORIGIN).join(origins, list(ORIGIN), "left").filter(F.col("last").isNull() | (F.col("sequence") > F.col("last")))
        # One of each coordinate, a sound one if there is one; then those that follow the checkpoint one by one are ready.
        sound = F.col("sound") if verify else F.lit(True)
        once = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*ORDER).orderBy(F.desc(sound.cast("int")), "event_id"))).filter("_rn = 1")
        w = Window.partitionBy(*ORIGIN).orderBy("sequence")
        follows = F.col("sequence") == F.coalesce("last", F.lit(0)) + F.row_number().over(w)
        named = F.coalesce("previous_event_id", F.lit("")) == F.coalesce(F.lag("event_id").over(w), F.col("head"), F.lit(""))
        placed = once.withColumns({"_follows": follows, "_bad": follows & ~(sound & named) if verify else F.lit(False)})
        broken = F.bool_or("_bad").over(w.rowsBetween(Window.unboundedPreceding, 0))
        state = F.when(broken, REFUSED).when(F.col("_follows"), READY).otherwise(WAITING)
        placed.select(*_names(_STATES), state.alias("state")).write.mode("overwrite").partitionBy("state").parquet(f"{self.folder}/staged/n={n}")
        counts = {r.state: r["count"] for r in self._states(n).groupBy("state").count().collect()}
        applied, waiting, refused = (counts.get(k, 0) for k in (READY, WAITING, REFUSED))
        if waiting and on_gap == "fail":
            gaps = self._states(n, WAITING).groupBy(*ORIGIN).agg(F.min("sequence").alias("first")).limit(5).collect()
            raise GapError("; ".join(f"{r.device_id}/{r.generation}: {r.first} came too early" for r in gaps))
        heads = self._states(n, READY).groupBy(*ORIGIN).agg(F.max("sequence").alias("last"), F.max_by("event_id", "sequence").alias("head"))
        every = origins.unionByName(heads).groupBy(*ORIGIN).agg(F.max_by("head", "last").alias("head"), F.max("last").alias("last"))
        self._write_origins(every.select(*ORIGIN, "last", "head"), n)
        runs = [*before.runs, f"staged/n={n}/state={READY}"] if applied else list(before.runs)
        self._commit(n, self._merged(runs, n), applied, waiting, refused)
        return {"applied": applied, "waiting": waiting, "refused": refused}

    def writer(self, stream: DataFrame, checkpoint: str, on_gap: str = "wait", verify: bool = False):
        """A stream writer that applies each batch."""
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n, on_gap, verify) and None).option("checkpointLocation", checkpoint)

    def _known(self, events: DataFrame) -> DataFrame:
        """The events in the columns of an envelope, those that are missing null."""
        have = set(events.columns)
        if missing := set(NEEDED) - have:
            raise ValueError(f"events lack {sorted(missing)}")
        own = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ENVELOPE).fields]
        return events.select(*own).filter("event_id IS NOT NULL AND device_id IS NOT NULL AND sequence IS NOT NULL AND generation IS NOT NULL")

    def _schema(self) -> str:
        kinds = ", ".join(f"{_column(k)} struct<{T.StructType.fromDDL(d).simpleString()[7:-1]}>" for k, d in PAYLOADS.items())
        return f"{ENVELOPE}, {kinds}"

    def _bring(self, came: DataFrame, n: int, verify: bool) -> None:
        """Writes what batch n brings, no row of which travels."""
        came = with_own_id(came, "_own").withColumn("sound", F.col("_own").eqNullSafe(F.col("event_id"))).drop("_own") if verify else came.withColumn("sound", F.lit(None).cast("boolean"))
        _decoded(came.withColumn("row", F.monotonically_increasing_id())).write.mode("overwrite").partitionBy("event_type").parquet(f"{self.folder}/brought/home={n}")

    def _brought(self, homes: list[int]) -> DataFrame:
        """What batches brought: all columns of an envelope, the decoded kinds and the place."""
        return self.spark.read.schema(f"{self._schema()}, sound boolean, home bigint, row bigint").option("basePath", f"{self.folder}/brought").parquet(*[f"{self.folder}/brought/home={h}" for h in homes])

    def _states(self, n: int, state: str | None = None) -> DataFrame:
        held = self.spark.read.schema(f"{_STATES}, state string").parquet(f"{self.folder}/staged/n={n}")
        return held if state is None else held.filter(F.col("state") == state).drop("state")

    def _looked_at(self, waiting: DataFrame, verify: bool) -> DataFrame:
        """Waiting events with sound filled in, if it is asked for: those of batches that weren't verified have it null."""
        unseen = waiting.filter("sound IS NULL")
        if not verify or unseen.isEmpty():
            return waiting
        own = with_own_id(self._places(unseen).events().select(*_names(ENVELOPE), "home", "row"), "_own")
        own = own.select("home", "row", F.col("_own").eqNullSafe(F.col("event_id")).alias("sound"))
        return waiting.filter("sound IS NOT NULL").unionByName(unseen.drop("sound").join(own, ["home", "row"]))

    def _places(self, states: DataFrame) -> Places:
        held = states.groupBy("home", "event_type").count().collect()
        places = states.select("event_type", "home", "row")
        homes = sorted({r.home for r in held})
        return Places(F.broadcast(places) if sum(r["count"] for r in held) <= FEW else places, self._brought(homes) if homes else None, {r.event_type for r in held})

    def _staged(self, n: int, state: str) -> DataFrame:
        """The events of a state after batch n, as they came."""
        held = self._places(self._states(n, state))
        return held.events().select(*_names(ENVELOPE)) if held.kinds else self.spark.createDataFrame([], ENVELOPE)

    # Runs and levels

    @staticmethod
    def _level(run: str) -> int:
        return 0 if run.startswith("staged/") else int(run.split("level=")[1].split("/")[0])

    def _merged(self, runs: list[str], n: int) -> list[str]:
        """The runs, of which those of a level that has enough of them are merged into one of the next."""
        level = 0
        while True:
            own = [r for r in runs if self._level(r) == level]
            if len(own) < self.fan:
                return runs
            to = f"merged/level={level + 1}/n={n}"
            lie = self._lie(own)
            for kind in PAYLOADS:
                rows = thinned(kind, self._kind(own, kind, lie))
                key = THIN[kind][0] if kind in THIN else SORTED.get(kind, "event_id")
                key = F.col(f"{LISTED[kind]}")[0] if kind in LISTED else F.col(key)
                rows.hint("rebalance").sortWithinPartitions(key).write.mode("overwrite").parquet(f"{self.folder}/{to}/kinds/{_column(kind)}")
            self._events(own, lie).sortWithinPartitions(*ORDER).write.mode("overwrite").parquet(f"{self.folder}/{to}/events")
            runs = [r for r in runs if r not in own] + [to]
            level += 1

    def _lie(self, runs: list[str]) -> list[Places]:
        """Where the events of the runs lie that haven't been merged."""
        return [self._places(self._states(int(r.split("n=")[1].split("/")[0]), READY)) for r in runs if not self._level(r)]

    def _events(self, runs: list[str], lie: list[Places]) -> DataFrame:
        """The events of runs, as they came."""
        out = self.spark.createDataFrame([], ENVELOPE)
        columns = out.columns
        for held in (x for x in lie if x.kinds):
            out = out.unionByName(held.events().select(columns))
        for r in (r for r in runs if self._level(r)):
            out = out.unionByName(self.spark.read.parquet(f"{self.folder}/{r}/events").select(columns))
        return out

    def _kind(self, runs: list[str], kind: str, lie: list[Places]) -> DataFrame:
        """The rows of a kind in runs, as ``fold.decoded`` gives them."""
        fields = _names(PAYLOADS[kind])
        picked = ("event_id", "actor", "task_id", F.col("wall_time").cast("timestamp").alias("created_at"), ordered().alias("_at"), *[F.col(f"{_column(kind)}.{f}").alias(f) for f in fields])
        out = self.spark.createDataFrame([], self._schema()).select(*picked)
        for held in (x for x in lie if kind in x.kinds):
            out = out.unionByName(held.events(kind).select(*picked))
        for r in (r for r in runs if self._level(r)):
            out = out.unionByName(self.spark.read.schema(out.schema).parquet(f"{self.folder}/{r}/kinds/{_column(kind)}"))
        return out

    # Reading

    def origins(self, batch: int | None = None) -> DataFrame:
        """(device_id, generation, last, head): how far each origin has been applied."""
        n = self.commit().batch if batch is None else batch
        return self.spark.read.schema("device_id string, generation int, last bigint, head string").parquet(f"{self.folder}/origins/n={n}")

    def waiting(self) -> DataFrame:
        """The events that wait for those before them."""
        return self._staged(self.commit().batch, WAITING)

    def refused(self, n: int) -> DataFrame:
        """The events of batch n that were refused."""
        return self._staged(n, REFUSED)

    def log(self) -> Decoded:
        """All applied events, decoded, for the functions of ``fold``."""
        runs = self.commit().runs
        lie = self._lie(runs)
        return Decoded(self._events(runs, lie), {k: self._kind(runs, k, lie) for k in PAYLOADS})

    def tables(self, objects: DataFrame | None = None) -> dict[str, DataFrame]:
        """All tables, as ``fold.project`` makes them from the same events."""
        return project(self.log(), objects)
