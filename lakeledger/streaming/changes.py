"""Applying file events to the catalog, classifying them on the way, counting them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import DEBOUNCE_SECONDS
from ..functions.paths import base_name, dir_name, extension
from ..operators.catalog import with_ids
from ..operators.classify import classify, default_category
from ..operators.organize import move_requests, plan_moves
from ..operators.ranking import dense_ids
from ..operators.rules import RuleSet
from ..operators.slabs import in_slabs, previous
from ..session import cut_lineage
from .debounce import DebounceSink


def _touches(events: DataFrame) -> DataFrame:
    """What events do to paths: (path, at, kind, node): ``in`` a file arrives, ``out`` the path is left empty, ``seen`` it has a file.

    ``at`` orders the events; a move touches two paths at once, and ``node`` is its name, the same on both.
    """
    # events without a path say nothing; a move that is delivered twice is one move
    moves = (events.filter((F.col("kind") == "moved") & F.col("path").isNotNull() & F.col("dest_path").isNotNull()
                           & (F.col("path") != F.col("dest_path")))
             .select("path", "dest_path", F.struct("ts", "event_id", "path").alias("node")).distinct())
    at = F.struct(F.col("node.ts").alias("ts"), F.col("node.event_id").alias("event_id"))
    sides = F.explode(F.array(F.struct(F.col("path"), F.lit("out").alias("kind")), F.struct(F.col("dest_path").alias("path"), F.lit("in").alias("kind"))))
    moved = moves.select(at.alias("at"), "node", sides.alias("_s")).select("_s.path", "at", "_s.kind", "node")
    leaves = (F.col("kind") == "deleted") | ((F.col("kind") == "moved") & F.col("dest_path").isNull())
    stays = (F.col("kind") != "moved") | F.col("dest_path").isNull() | (F.col("path") == F.col("dest_path"))
    others = events.filter(F.col("path").isNotNull() & stays).select(
        "path", F.struct("ts", "event_id").alias("at"), F.when(leaves, "out").otherwise("seen").alias("kind"),
        F.lit(None).cast(moved.schema["node"].dataType).alias("node"))
    return moved.unionByName(others)


def move_origins(touches: DataFrame) -> DataFrame:
    """(node, origin): for every move the path whose first file it carries; null if that file came up during the events.

    A path's versions open where something arrives or leaves, so a move's file is told by what happened last at its source: an earlier move
    brought it, or it was there from the start, or it appeared after the path had been left. Moves point to the
    moves that brought their files; the pointers jump twice as far every round, a chain of n moves takes about log2(n) joins.
    A version is left once, so no move is pointed to twice and no key is hot.
    """
    changes = in_slabs(touches.filter("kind <> 'seen'"), ["path"], ["at"])
    known = previous(changes, ["path"], ["at"], F.struct("kind", "node"), "_last").filter((F.col("kind") == "out") & F.col("node").isNotNull())
    hops = cut_lineage(known.select(
        "node", F.when(F.col("_last.kind") == "in", F.col("_last.node")).alias("next"),
        F.when(F.col("_last").isNull(), F.col("path")).alias("origin")))
    settled = hops.filter("next IS NULL").select("node", "origin")
    chained = hops.filter("next IS NOT NULL")
    while not chained.isEmpty():
        ahead = hops.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("origin").alias("_origin"))
        jumped = cut_lineage(chained.join(ahead, "next").select(
            "node", F.col("_next").alias("next"), F.col("_origin").alias("origin")))
        settled = settled.unionByName(jumped.filter("next IS NULL").select("node", "origin"))
        chained = hops = jumped.filter("next IS NOT NULL")
        # a chain of one more jump may point to a settled move
        hops = hops.unionByName(settled.select("node", F.lit(None).cast(hops.schema["next"].dataType).alias("next"), "origin"))
    return settled


def apply_events(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """The catalog after all events in the order of (ts, event_id), as if they were applied one by one.

    Created and modified paths have a file afterwards (the one that is there, or a new one without size and time until the next scan), deleted
    ones have none. A moved file keeps its row under the new path and replaces what is there; a move of a file nobody knew brings a new one, a
    move without a destination takes the file away. Paths may be used again and again, and moves may form chains.
    """
    touches = cut_lineage(_touches(events))
    change = F.when(F.col("kind") != "seen", F.struct("at", "kind", "node"))
    ends = touches.groupBy("path").agg(F.max_by("kind", "at").alias("kind"), F.max(change).alias("_last"))
    ends = cut_lineage(ends.select("path", "kind", F.col("_last.kind").alias("last"), F.col("_last.node").alias("node")))
    # nothing came or went: a file that is there stays, one that is not is new
    changed = ends.filter("last IS NOT NULL").select("path")
    staying = catalog.join(changed, "path", "left_anti")
    types = {f.name: f.dataType for f in catalog.schema}
    name = base_name("path")
    named = {"path": F.col("path"), "name": name, "extension": extension(name), "category": default_category(extension(name))}
    arrived = ends.filter("kind <> 'out' AND last = 'in'").join(move_origins(touches), "node")
    source = catalog.select(F.col("path").alias("origin"), *[F.col(c).alias(f"_s_{c}") for c in catalog.columns if c != "path"])
    moved = arrived.join(source, "origin", "left").select(*[named.get(c, F.col(f"_s_{c}")).cast(types[c]).alias(c) for c in catalog.columns])
    born = ends.filter("kind = 'seen' AND last = 'out'").select("path").unionByName(
        ends.filter("last IS NULL").select("path").join(catalog.select("path"), "path", "left_anti"))
    created = born.select(*[named.get(c, F.lit(None)).cast(types[c]).alias(c) for c in catalog.columns])
    fresh = moved.unionByName(created)
    return staying.select(*catalog.columns).unionByName(with_ids(fresh, catalog) if "id" in catalog.columns else fresh)


def classify_events(events: DataFrame, rules: DataFrame | RuleSet) -> DataFrame:
    """Created, modified and moved files with their classification under the name they have now.

    A projection: it works on streams as on tables.
    """
    now_at = F.when(F.col("kind") == "moved", F.col("dest_path")).otherwise(F.col("path"))
    arriving = events.filter(F.col("kind") != "deleted").withColumn("file", now_at)
    named = arriving.withColumn("name", base_name("file")).withColumn("extension", extension("name"))
    return classify(named, rules)


def stream_classify(events: DataFrame, rules: RuleSet, handle: Callable[[DataFrame, int], None], checkpoint: str,
                    **trigger):
    """Start a query that classifies events and hands every micro-batch to ``handle``."""
    writer = classify_events(events, rules).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def auto_organize(
    destination_base: str, entries: Callable[[], DataFrame], out_dir: str, route_by: str = "category"
) -> Callable[[DataFrame, int], None]:
    """A ``handle`` for ``stream_classify``: move plans for the files that arrive, one folder per micro-batch.

    ``entries`` gives the (dest_dir, name) rows that stand in the folders when the batch starts. Of several events of a file the
    newest counts; names are numbered in the order of (ts, event_id). A batch that is repeated overwrites its own folder.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        last = F.max_by(F.struct("ts", "event_id", route_by), F.struct("ts", "event_id")).alias("_e")
        newest = batch.groupBy(F.col("file").alias("path")).agg(last)
        # numbers go out in the order of arrival; files that arrive together stand in the order of their events
        arrived = dense_ids(newest.select("path", f"_e.{route_by}", "_e.ts", "_e.event_id"), ["ts", "event_id", "path"])
        plan = plan_moves(move_requests(arrived.drop("ts", "event_id"), destination_base, route_by=route_by), entries(), skip_in_place=True)
        plan.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    return handle


class OrganizeSink:
    """Watched folders that keep themselves in order, as a ``foreachBatch`` function: debounce, classify, number.

    Bursts go to the debounce sink; when a burst's timer has fired, its created, modified and moved files are classified under the
    name they have and get the first free name of their target folder, in the order of firing, then of events. The names given out are a table
    with a folder per micro-batch: a batch is planned against the ``entries`` at the start and the names of the batches before it,
    so a batch that is repeated gives the same names again, and one that comes later never gives a name twice. Ids go on from batch to batch.
    """

    GIVEN = "dest_dir STRING, name STRING"

    def __init__(self, rules: RuleSet, destination_base: str, entries: DataFrame, out_dir: str, state_dir: str,
                 gap_seconds: float = DEBOUNCE_SECONDS, delay_seconds: float = 0, route_by: str = "category"):
        self.rules, self.base, self.entries, self.route_by = rules, destination_base, entries, route_by
        self.out_dir, self.state_dir = out_dir.rstrip("/"), state_dir.rstrip("/")
        self.bursts = DebounceSink(f"{self.state_dir}/bursts", f"{self.state_dir}/debounce", gap_seconds, delay_seconds)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.bursts(batch, batch_id)
        self._plan(batch.sparkSession, batch_id)

    def flush(self, spark: SparkSession) -> None:
        """Plan the bursts that are open at the end of the input."""
        self.bursts.flush(spark)
        self._plan(spark, 0 if self.bursts.last_batch is None else self.bursts.last_batch + 1)

    def _plan(self, spark: SparkSession, batch_id: int) -> None:
        fired = spark.read.parquet(f"{self.state_dir}/bursts/batch={batch_id}")
        arriving = classify_events(fired, self.rules).select(F.col("file").alias("path"), self.route_by, "fires_at", "event_id")
        before = [f"{self.state_dir}/given/{i}" for i in range(batch_id)]
        held, start = self.entries.select("dest_dir", "name"), 0
        if before:
            held = held.unionByName(spark.read.schema(self.GIVEN).parquet(*before))
            start = spark.read.schema("next BIGINT").parquet(f"{self.state_dir}/next/{batch_id - 1}").first()["next"]
        numbered = cut_lineage(dense_ids(arriving, ["fires_at", "event_id", "path"], start))
        requests = move_requests(numbered.drop("fires_at", "event_id"), self.base, route_by=self.route_by)
        plan = plan_moves(requests, held, skip_in_place=True)
        folder = f"{self.out_dir}/batch={batch_id}"
        plan.write.mode("overwrite").parquet(folder)
        moved = spark.read.parquet(folder).filter("success").select("destination")
        moved.select(dir_name("destination").alias("dest_dir"), base_name("destination").alias("name")).write.mode("overwrite").parquet(
            f"{self.state_dir}/given/{batch_id}")
        numbered.agg((F.count(F.lit(1)) + start).alias("next")).write.mode("overwrite").parquet(f"{self.state_dir}/next/{batch_id}")


def event_counts(events: DataFrame, width: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Events per tumbling window and kind; with a ``delay`` the same on a stream."""
    if delay is not None:
        events = events.withWatermark("ts", delay)
    return (
        events.groupBy(F.window("ts", width), "kind")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.unix_seconds("window.start").alias("window_start"), "kind", "n_events")
    )
