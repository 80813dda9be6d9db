"""Folder listings kept as a table: items(id, name, mime_type, parent_id)."""

from __future__ import annotations

import base64
import json
from contextlib import ExitStack
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from docvec.scratch import materialize, staged

# Fixed value: how a listing marks a folder.
FOLDER_MIME_TYPE = "application/vnd.google-apps.folder"
# Fixed value: items on one listing page.
PAGE_SIZE = 100
_SLOT_BITS = 33  # monotonically_increasing_id: partition above, place in the partition below
# Folders that go to every task of a join; more of them are shuffled.
_BROADCAST_FOLDERS = 100_000


def is_folder() -> Column:
    """An item without a type is a file."""
    return F.col("mime_type").eqNullSafe(FOLDER_MIME_TYPE)


def list_folder(items: DataFrame, folder_id: str, page_size: int = PAGE_SIZE, page: int | None = 1) -> DataFrame:
    """One page (from 1) of the files directly in one folder, by id; all of them if `page` is None."""
    inside = items.where((F.col("parent_id") == folder_id) & ~is_folder()).select("id", "name").orderBy("id", "name")
    return inside if page is None else inside.offset((page - 1) * page_size).limit(page_size)


def list_every_folder(items: DataFrame, page_size: int = PAGE_SIZE, page: int | None = 1) -> DataFrame:
    """One page (from 1) of every folder at once, with the place of each file; all files if `page` is None.

    Spark cuts each folder to its pages so far inside the map tasks (WindowGroupLimit), so a folder that holds
    most of the files sends no more than them per task. Without a page no place is needed and nothing is shuffled.
    """
    files = items.where(~is_folder()).select("parent_id", "id", "name")
    if page is None:
        return files
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("id", "name"))
    upto = files.withColumn("place", place).where(F.col("place") <= page * page_size)
    return upto.where(F.col("place") > (page - 1) * page_size)


def _token(row: Row, seen: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([row["id"], row["name"], seen]).encode()).decode()


def _placed(files: DataFrame) -> DataFrame:
    """id, name and the place of each file, from 0, by id and name: its place in its range and the rows of those before.

    Only one count per range is brought together.
    """
    ranges = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = files.repartitionByRange(ranges, "id", "name").sortWithinPartitions("id", "name")
    slot = F.monotonically_increasing_id()  # partition above, place in it below
    within = slot.bitwiseAND((1 << _SLOT_BITS) - 1).alias("_place")
    stored = materialize(ordered.select("id", "name", F.shiftright(slot, _SLOT_BITS).alias("_range"), within), "places")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.groupBy("_range").agg(F.count("*").alias("n"))
    starts = starts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return stored.join(F.broadcast(starts), "_range").select("id", "name", (F.col("_start") + F.col("_place")).alias("place"))


def list_folder_by_token(
    items: DataFrame, folder_id: str, token: str | None = None, page_size: int = PAGE_SIZE, to_the_end: bool = False
) -> tuple[DataFrame, str | None]:
    """The page of `list_folder` that follows a token, and the token of the next page; None where there is none.

    With `to_the_end` this page and all that would follow, each from the token of the one before, as (page, id, name) with
    pages from 1. They are numbered where they lie, in one sort of the rows behind the token; none goes through the driver.

    A token says which row came last and how many equal ones were given, so a page costs what it holds and not
    the pages before: rows below the token are left out by the scan, whose statistics can tell them by their id.
    """
    inside = items.where((F.col("parent_id") == folder_id) & ~is_folder()).select("id", "name")
    last, seen = None, 0
    if token is not None:
        *last, seen = json.loads(base64.urlsafe_b64decode(token))
        after_id, after_name = (F.lit(v).cast("string") for v in last)
        same_id = F.col("id").eqNullSafe(after_id)
        name_from = F.lit(True) if last[1] is None else F.col("name") >= after_name  # nulls come first
        id_behind = F.col("id").isNotNull() if last[0] is None else F.col("id") > after_id
        if last[0] is not None:
            inside = inside.where(F.col("id") >= after_id)
        inside = inside.where(id_behind | (same_id & name_from))
    if to_the_end:
        at = F.col("place") - seen
        return _placed(inside).where(at >= 0).select((F.floor(at / page_size) + 1).alias("page"), "id", "name"), None
    rows = inside.orderBy("id", "name").offset(seen).limit(page_size + 1).collect()
    page, more = rows[:page_size], len(rows) > page_size
    if not more:
        following = None
    else:
        end = page[-1]
        equal = sum(r == end for r in page)
        following = _token(end, equal + (seen if last == list(end) else 0))
    return items.sparkSession.createDataFrame(page, inside.schema), following


def _climb(items: DataFrame, root_id: str, stack: ExitStack, to_the_end: bool = False) -> tuple[list[DataFrame], int]:
    """Follow the parents of all folders by pointer doubling: tables of (id, up, least), and the rounds it took.

    Every folder points to its parents. In a round it points to where they point, so the way doubles, until it points to
    the root; one that does needs no other pointer. After r rounds all folders up to 2 ** r levels deep do, and a round that
    adds none is the last: what still points elsewhere hangs on a cycle, or on a folder that is not there. `least`
    is the least folder on the way. The tables of a round are shuffled, whatever their size: of many rounds each would send
    its own to the driver and from there to all tasks. With `to_the_end` the rounds go on until the way is as long as there are folders.
    """
    usable = is_folder() & F.col("id").isNotNull() & F.col("parent_id").isNotNull()
    usable = usable & (F.col("id") != root_id) & (F.col("id") != F.col("parent_id") if not to_the_end else F.lit(True))
    edges = items.where(usable).select("id", F.col("parent_id").alias("up")).distinct()
    to_root = F.col("up") == root_id
    has_root = F.max(to_root).over(Window.partitionBy("id"))

    def kept(pairs: DataFrame) -> tuple[DataFrame, int, int]:
        settled = pairs.withColumn("_root", has_root).where(to_root | ~F.col("_root")).drop("_root")
        table = stack.enter_context(staged(settled, "climb"))
        return table, *table.agg(F.count_if(to_root), F.count_if(~to_root)).first()

    newest, found, others = kept(edges.withColumn("least", F.least("id", "up")))
    tables, rounds, folders = [newest], 0, found + others
    while others and (2**rounds < folders if to_the_end else found or not rounds):
        settled = reduce(DataFrame.unionByName, (t.where(to_root) for t in tables))
        moving = newest.where(~to_root)
        onward = moving.unionByName(settled).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        joined = moving.hint("merge").join(onward, "up").groupBy("id", F.col("_up").alias("up")).agg(F.min(F.least("least", "_least")).alias("least"))
        newest, found, others = kept(joined)
        tables.append(newest)
        rounds += 1
    return tables, rounds


def reached_folders(items: DataFrame, root_id: str) -> tuple[DataFrame, int]:
    """Ids of the folders at any depth under `root_id`, itself included, as a stored table, and the rounds it took."""
    root = items.sparkSession.range(1).select(F.lit(root_id).cast("string").alias("id"))
    with ExitStack() as stack:
        tables, rounds = _climb(items, root_id, stack)
        settled = (t.where(F.col("up") == root_id).select("id") for t in tables)
        return materialize(reduce(DataFrame.unionByName, settled, root).distinct(), "reached"), rounds


def walk_folders(items: DataFrame, root_id: str) -> DataFrame:
    """All files at any depth under `root_id`, each folder once and each (id, name) once.

    Only the folder rows take part in the rounds, of which there are as many as the depth has binary digits, and one
    more; files are met once, at the end.
    """
    reached, _ = reached_folders(items, root_id)
    few = reached.limit(_BROADCAST_FOLDERS + 1).count() <= _BROADCAST_FOLDERS
    reached = reached.withColumnRenamed("id", "parent_id").hint("broadcast" if few else "merge")
    files = items.where(~is_folder()).join(reached, "parent_id", "left_semi")
    return files.select("id", "name").distinct()


def folder_cycles(items: DataFrame, root_id: str) -> DataFrame:
    """(id, cycle) of the folders whose parents lead back to themselves, a cycle named by its least folder.

    With several parents a folder between two cycles counts too. Folders that the root reaches are on none.
    """
    with ExitStack() as stack:
        last = _climb(items, root_id, stack, to_the_end=True)[0][-1].where(F.col("up") != root_id)
        on_cycle = last.select(F.col("up").alias("id")).distinct()
        named = last.join(on_cycle, "id", "left_semi").groupBy("id").agg(F.min("least").alias("cycle"))
        return materialize(named, "cycles")


def valid_file_refs(refs: DataFrame) -> DataFrame:
    """Drop references without an id or a name."""
    return refs.where("id <> '' and name <> ''")
