"""Collision-free names for files that arrive in folders.

Files arrive in id order. A file named ``photo.jpg`` takes ``photo.jpg``, else ``photo_(1).jpg``, ... up to
``photo_(999).jpg``: the first one that neither stood there before nor was taken by an earlier file.

The sequential rule is computed in parallel because little of it is really sequential:

* The files of one (folder, name) use its 1,000 slots from the lowest up, so at most the first 1,000 of
  them succeed. Those are found by a salted ranking; later ones fail without being gathered anywhere.
* Slot ``photo_(1).jpg`` is wanted by files named ``photo.jpg`` and by files named ``photo_(1).jpg``. From the first
  arrival of the latter on it is occupied, whoever got it. So to ``photo.jpg`` it is a slot with a deadline,
  known in advance; to ``photo_(1).jpg`` only one question is left: was the plain name gone before?
* Those answers travel from name to numbered name, so a loop over the (few) contested names settles
  them; its length is the depth of names like ``x_(1)_(2)``, mostly one.

No group holds more than 1,000 ids and 1,000 slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import MAX_COLLISIONS
from ..functions.paths import suffix
from ..session import cut_lineage
from .skew import join_by_key

SLOTS = MAX_COLLISIONS + 1
SALTS = 1024
MAX_FOLDERS = 1000
KEY = ["dest_dir", "name"]


def numbered_parents(name: Column) -> Column:
    """The (base, slot) pairs for which ``name`` is the numbered form of ``base``; none, one, rarely two."""
    bare = r"(?s)\A(.+)_\(([1-9][0-9]{0,2})\)\z"
    dotted = r"(?s)\A(.+)_\(([1-9][0-9]{0,2})\)(\.[^.]+)\z"
    pairs = []
    for regex, tail in ((bare, F.lit("")), (dotted, F.regexp_extract(name, dotted, 3))):
        base = F.concat(F.regexp_extract(name, regex, 1), tail)
        slot = F.regexp_extract(name, regex, 2)
        fits = (slot != "") & (suffix(base) == tail)
        pairs.append(F.when(fits, F.struct(base.alias("base"), F.try_to_number(slot, F.lit("999")).cast("int")
                                           .alias("slot"))))
    nothing = F.array().cast("array<struct<base: string, slot: int>>")
    return F.when(name.contains("_("), F.array_compact(F.array(*pairs))).otherwise(nothing)


def slots_of(names: DataFrame) -> DataFrame:
    """(dest_dir, base, slot) for every name seen as a plain or a numbered name."""
    plain = F.array(F.struct(F.col("name").alias("base"), F.lit(0).alias("slot")))
    every = F.concat(plain, numbered_parents(F.col("name")))
    return names.select("dest_dir", "name", F.explode(every).alias("_s")).select("dest_dir", "name", "_s.*")


def _ranked(rows: DataFrame, salts: int) -> DataFrame:
    """Rank by id in (dest_dir, name); rows that cannot be among the first 1,000 get a ``_part`` above 0."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    in_salt = F.row_number().over(Window.partitionBy(*KEY, "_salt").orderBy("id"))
    parted = salted.withColumn("_in_salt", in_salt).withColumn(
        "_part", F.when(F.col("_in_salt") <= SLOTS, F.lit(0)).otherwise(F.col("_salt") + 1)
    )
    rank = F.row_number().over(Window.partitionBy(*KEY, "_part").orderBy("id"))
    return parted.withColumn("_rank", rank).drop("_salt", "_in_salt")


def _before(slots: Column, slot: Column) -> Column:
    return F.size(F.filter(slots, lambda s: s < slot))


def _skipped(ids: Column, taken: Column, contested: Column) -> Column:
    """Contested slots the base's files come to too late (or never)."""

    def step(skipped: Column, c: Column) -> Column:
        arriving = F.get(ids, c["slot"] - _before(taken, c["slot"]) - F.size(skipped))
        return F.when(arriving < c["until"], skipped).otherwise(F.array_append(skipped, c["slot"]))

    return F.aggregate(contested, F.array().cast("array<int>"), step)


def _solve(bases: DataFrame, edges: DataFrame, takes: DataFrame | None) -> DataFrame:
    """One round: which contested slots each base takes and which it misses, given the last round's takes."""
    if takes is None:
        known = bases.withColumn("_taken", F.col("taken")).withColumn("_contested", F.col("contested"))
    else:
        # what others took: my plain name, and slots I share with another base
        plain = takes.groupBy("dest_dir", F.col("child").alias("base")).agg(F.lit(True).alias("_gone"))
        shared = (
            takes.join(edges.select("dest_dir", "child", F.col("base").alias("_other")), ["dest_dir", "child"])
            .filter(F.col("base") != F.col("_other"))
            .groupBy("dest_dir", F.col("_other").alias("base"))
            .agg(F.map_from_entries(F.collect_list(F.struct("child", "taken_by"))).alias("_others"))
        )
        until = lambda c: F.least(c["until"], F.try_element_at("_others", c["child"]))
        known = (
            bases.join(plain, ["dest_dir", "base"], "left")
            .join(shared, ["dest_dir", "base"], "left")
            .withColumn("_taken", F.when(F.col("_gone"), F.array_union("taken", F.array(F.lit(0)))).otherwise(
                F.col("taken")))
            .withColumn("_contested", F.when(F.col("_others").isNull(), F.col("contested")).otherwise(
                F.transform("contested", lambda c: F.struct(
                    c["slot"].alias("slot"), until(c).alias("until"), c["child"].alias("child")))))
        )
    return known.withColumn("_skipped", _skipped(F.col("ids"), F.col("_taken"), F.col("_contested"))).select(
        "dest_dir", "base", "ids", "_taken", "_contested", "_skipped"
    )


def _takes(solved: DataFrame) -> DataFrame:
    """(dest_dir, base, child, taken_by): numbered names that files of the base took before the child's files."""
    won = solved.select(
        "dest_dir", "base", "ids", "_taken", "_skipped",
        F.explode(F.filter("_contested", lambda c: ~F.array_contains(F.col("_skipped"), c["slot"]))).alias("_c"),
    )
    slot = F.col("_c.slot")
    position = slot - _before(F.col("_taken"), slot) - _before(F.col("_skipped"), slot)
    return won.select("dest_dir", "base", F.col("_c.child").alias("child"),
                      F.get("ids", position).alias("taken_by"))


def _same(a: DataFrame, b: DataFrame) -> bool:
    key = ["dest_dir", "base", "child"]
    both = a.withColumnRenamed("taken_by", "_a").join(b.withColumnRenamed("taken_by", "_b"), key, "full_outer")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).isEmpty()


def _shared_slots(names: DataFrame, occupied: DataFrame) -> DataFrame:
    """Slots two present names have in common although no file arrives under that name itself.

    Only ``y_(i).`` and ``y._(j)`` share one, ``y_(i)._(j)``: both ends are read off the names, so the join is
    on (dest_dir, y) and almost always empty.
    """
    def cut(regex: str, number: str) -> DataFrame:
        found = names.filter(F.col("name").rlike(regex))
        return found.select("dest_dir", F.regexp_extract("name", regex, 1).alias("_y"),
                            F.regexp_extract("name", regex, 2).alias(number), F.col("name").alias(f"_of{number}"))

    pairs = (
        cut(r"(?s)\A(.+)_\(([1-9][0-9]{0,2})\)\.\z", "_i")
        .join(cut(r"(?s)\A(.+)\._\(([1-9][0-9]{0,2})\)\z", "_j"), ["dest_dir", "_y"])
        .withColumn("child", F.format_string("%s_(%s)._(%s)", "_y", "_i", "_j"))
    )
    taken = occupied.filter(F.col("slot") > 0).select("dest_dir", F.col("name").alias("base"), "slot")
    never = F.lit(2**63 - 1)
    absent = pairs.join(names.select("dest_dir", F.col("name").alias("child")), ["dest_dir", "child"], "left_anti")
    of_i = absent.select("dest_dir", F.col("_of_i").alias("base"), F.col("_j").cast("int").alias("slot"),
                         never.alias("until"), "child")
    of_j = absent.select("dest_dir", F.col("_of_j").alias("base"), F.col("_i").cast("int").alias("slot"),
                         never.alias("until"), "child")
    return of_i.unionByName(of_j).join(taken, ["dest_dir", "base", "slot"], "left_anti").select(
        "dest_dir", "base", "slot", "until", "child")


def _settle(ranked: DataFrame, names: DataFrame, occupied: DataFrame) -> DataFrame | None:
    """(dest_dir, name, slot) that contests between names make unavailable; None without contests."""
    wanted = slots_of(names.select(*KEY)).filter(F.col("slot") > 0)
    free = wanted.join(occupied.select("dest_dir", F.col("name").alias("base"), "slot"),
                       ["dest_dir", "base", "slot"], "left_anti")
    here = names.select("dest_dir", F.col("name").alias("base"))
    arriving = names.select("dest_dir", "name", F.col("first_id").alias("until"))
    edges = cut_lineage(
        free.join(here, ["dest_dir", "base"], "left_semi")
        .join(arriving, KEY)
        .select("dest_dir", "base", "slot", "until", F.col("name").alias("child"))
        .unionByName(_shared_slots(names, occupied))
    )
    # a numbered name that is a base itself, or has two bases, hands its answer on
    roles = (
        edges.select("dest_dir", F.col("child").alias("name"), F.lit(1).alias("as_child"), F.lit(0).alias("as_base"))
        .unionByName(edges.select("dest_dir", F.col("base").alias("name"), F.lit(0).alias("as_child"),
                                  F.lit(1).alias("as_base")).distinct())
        .groupBy(*KEY).agg(F.sum("as_child").alias("as_child"), F.max("as_base").alias("as_base"))
    )
    hands_on = (F.col("as_child") > 1) | ((F.col("as_child") > 0) & (F.col("as_base") > 0))
    found = roles.agg(F.count(F.lit(1)).alias("contests"), F.count_if(hands_on).alias("hand_on")).first()
    if not found["contests"]:
        return None
    contested = edges.groupBy("dest_dir", "base").agg(
        F.sort_array(F.collect_list(F.struct("slot", "until", "child"))).alias("contested")
    )
    keys = contested.select("dest_dir", F.col("base").alias("name"))
    ids = (
        ranked.filter((F.col("_part") == 0) & (F.col("_rank") <= SLOTS))
        .join(keys, KEY, "left_semi")
        .groupBy("dest_dir", F.col("name").alias("base"))
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    taken = occupied.withColumnRenamed("name", "base").groupBy("dest_dir", "base").agg(
        F.collect_set("slot").alias("taken"))
    bases = cut_lineage(
        contested.join(ids, ["dest_dir", "base"])
        .join(taken, ["dest_dir", "base"], "left")
        .withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    )
    solved = _solve(bases, edges, None)
    takes = _takes(solved)
    if found["hand_on"]:
        while True:
            again = cut_lineage(_solve(bases, edges, takes))
            new_takes = _takes(again)
            settled = _same(takes, new_takes)
            solved, takes = again, new_takes
            if settled:
                break
    missed = solved.select("dest_dir", F.col("base").alias("name"), F.explode("_skipped").alias("slot"))
    gone = takes.select("dest_dir", F.col("child").alias("name"), F.lit(0).alias("slot"))
    return missed.unionByName(gone)


def _in_folders(existing: DataFrame, names: DataFrame) -> DataFrame:
    """The existing files of the target folders, filtered in the scan where those are few enough to list."""
    folders = [r["dest_dir"] for r in names.select("dest_dir").distinct().limit(MAX_FOLDERS + 1).collect()]
    return existing.filter(F.col("dest_dir").isin(folders)) if len(folders) <= MAX_FOLDERS else existing


def assign_numbers(rows: DataFrame, existing: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add ``number`` to rows of (id, dest_dir, name, ...): 0 for the plain name, null where all are taken.

    ``existing`` lists (dest_dir, name) of the files that stand in the folders at the start. Names that
    the batch itself vacates are not handed out again: a plan must hold in whatever order it is carried out.
    """
    ranked = cut_lineage(_ranked(rows, salts))
    names = (
        ranked.filter((F.col("_part") == 0) & (F.col("_rank") == 1)).select(*KEY, F.col("id").alias("first_id"))
    )
    occupied = cut_lineage(
        slots_of(_in_folders(existing.select(*KEY), names))
        .drop("name").withColumnRenamed("base", "name")
        .join(names.select(*KEY), KEY, "left_semi")
        .select(*KEY, "slot").distinct()
    )
    contests = _settle(ranked, names, occupied)
    unavailable = occupied if contests is None else occupied.unionByName(contests)
    blocked = (
        unavailable.groupBy(*KEY)
        .agg(F.sort_array(F.collect_set("slot")).alias("_blocked"))
        .withColumn("_part", F.lit(0))
    )
    # the k-th free slot: every blocked one at or below it moves it up
    moved_up = F.aggregate("_blocked", F.col("_rank") - 1, lambda slot, b: F.when(b <= slot, slot + 1).otherwise(slot))
    number = F.when(F.col("_blocked").isNull(), F.col("_rank") - 1).otherwise(moved_up)
    possible = (F.col("_part") == 0) & (F.col("_rank") <= SLOTS) & (number < SLOTS)
    return (
        ranked.join(blocked, [*KEY, "_part"], "left")
        .withColumn("number", F.when(possible, number))
        .select(*rows.columns, "number")
    )


def first_free_number(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Add ``number`` to each row by the existing files alone, as if it were the only arrival."""
    wanted = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"))
    slots = F.sequence(F.lit(0), F.lit(MAX_COLLISIONS))
    blocked = cut_lineage(
        slots_of(existing.select(*KEY))
        .drop("name").withColumnRenamed("base", "name")
        .join(wanted, KEY)
        .groupBy(*KEY)
        .agg(F.max("_rows").alias("_rows"), F.collect_set("slot").alias("_blocked"))
        .select(*KEY, "_rows", F.array_min(F.array_except(slots, F.col("_blocked"))).alias("_free"),
                F.lit(True).alias("_seen"))
    )
    return join_by_key(rows, blocked, KEY, "left", "_rows").withColumn(
        "number", F.when(F.col("_seen").isNull(), F.lit(0)).otherwise(F.col("_free"))
    ).select(*rows.columns, "number")
