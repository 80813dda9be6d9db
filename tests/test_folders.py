import random

from pyspark.sql import functions as F

import pytest

from docvec.sources import folders as D


def listing(spark, rows):
    """Rows (id, parent); an id that ends with / is a folder."""
    kind = {True: D.FOLDER_MIME_TYPE, False: "text/plain"}
    rows = [(i, f"name of {i}", kind[i.endswith("/")], parent) for i, parent in rows]
    return spark.createDataFrame(rows, "id string, name string, mime_type string, parent_id string")


def walked(spark, rows, root="root/"):
    return sorted(r["id"] for r in D.walk_folders(listing(spark, rows), root).collect())


def test_walk_a_tree(spark):
    rows = [("a/", "root/"), ("b/", "a/"), ("x", "root/"), ("y", "b/"), ("other/", "else/"), ("z", "other/")]
    assert walked(spark, rows) == ["x", "y"]


def test_walk_ends_on_a_cycle(spark):
    rows = [("a/", "root/"), ("b/", "a/"), ("a/", "b/"), ("root/", "b/"), ("x", "b/")]
    assert walked(spark, rows) == ["x"]


def test_shared_folder_is_listed_once(spark):
    rows = [("a/", "root/"), ("b/", "root/"), ("d/", "a/"), ("d/", "b/"), ("x", "d/"), ("y", "a/"), ("y", "b/")]
    assert walked(spark, rows) == ["x", "y"]


def test_walk_of_an_empty_folder(spark):
    assert walked(spark, [("x", "else/")]) == []


def test_rounds_follow_the_digits_of_the_depth(spark):
    depth = 1200
    chain = [(f"{i:04d}/", "root/" if i == 0 else f"{i - 1:04d}/") for i in range(depth)]
    lost = [("lost1/", "lost2/"), ("lost2/", "lost3/"), ("lost3/", "lost1/"), ("x", "lost1/"), ("away/", "nowhere/"), ("y", "away/")]
    items = listing(spark, chain + lost + [("file", f"{depth - 1:04d}/")])
    reached, rounds = D.reached_folders(items, "root/")
    assert reached.count() == depth + 1 and rounds <= depth.bit_length() + 1
    shallow, rounds = D.reached_folders(listing(spark, [("a/", "root/"), ("b/", "a/"), *lost]), "root/")
    assert sorted(r["id"] for r in shallow.collect()) == ["a/", "b/", "root/"] and rounds <= 2


def test_reached_folders_against_a_plain_walk(spark):
    rng = random.Random(7)
    for _ in range(2):
        names = ["root/", *(f"{i}/" for i in range(25))]
        rows = [(rng.choice(names[1:]), rng.choice(names)) for _ in range(32)]
        seen, edge = {"root/"}, {"root/"}
        while edge:
            edge = {i for i, up in rows if up in edge} - seen
            seen |= edge
        reached, _ = D.reached_folders(listing(spark, rows), "root/")
        assert {r["id"] for r in reached.collect()} == seen


def test_cycles_have_the_name_of_their_least_folder(spark):
    rows = [("a/", "root/"), ("d/", "c/"), ("c/", "b/"), ("b/", "d/"), ("under/", "c/"), ("self/", "self/"), ("y/", "z/"), ("z/", "y/"), ("n/", None)]
    found = {r["id"]: r["cycle"] for r in D.folder_cycles(listing(spark, rows), "root/").collect()}
    assert found == {"b/": "b/", "c/": "b/", "d/": "b/", "self/": "self/", "y/": "y/", "z/": "y/"}
    assert D.folder_cycles(listing(spark, [("a/", "root/"), ("x", "a/")]), "root/").collect() == []


def test_pages_by_token_are_those_by_number(spark):
    names = [None, None, None, "a", "a", "a", "a", "b", *(f"f{i:02d}" for i in range(9))]
    rows = [(i, n, "text/plain", "root/") for i, n in [(None, "p"), (None, "q"), (None, None), *((n, n and n * 2) for n in names)]]
    items = spark.createDataFrame(rows, "id string, name string, mime_type string, parent_id string").repartition(3)
    for size in (2, 7):
        token, number = None, 1
        while True:
            page, token = D.list_folder_by_token(items, "root/", token, size)
            assert page.collect() == D.list_folder(items, "root/", size, number).collect()
            number += 1
            if token is None:
                break
        assert D.list_folder(items, "root/", size, number).count() == 0
    assert D.list_folder_by_token(items, "else/")[1] is None


def test_list_folder_gives_one_page(spark):
    rows = [(f"f{i:03d}", "root/") for i in range(150)] + [("sub/", "root/"), ("deep", "sub/")]
    items = listing(spark, rows)
    assert [r["id"] for r in D.list_folder(items, "root/").collect()] == [f"f{i:03d}" for i in range(100)]
    assert D.list_folder(items, "root/", 200).count() == 150
    assert [r["id"] for r in D.list_folder(items, "root/", page=2).collect()] == [f"f{i:03d}" for i in range(100, 150)]
    assert D.list_folder(items, "root/", page=None).count() == 150
    untyped = items.withColumn("mime_type", F.lit(None).cast("string"))
    assert D.list_folder(untyped, "root/", page=None).count() >= 150
    pages = D.list_every_folder(items)
    assert pages.groupBy("parent_id").count().collect() and pages.count() == 101


def test_a_full_folder_is_cut_before_the_shuffle(spark):
    plan = D.list_every_folder(listing(spark, [("x", "root/")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("row, kept", [(("1", "a"), 1), (("", "a"), 0), (("1", ""), 0), ((None, "a"), 0), (("1", None), 0)])
def test_valid_file_refs(spark, row, kept):
    refs = spark.createDataFrame([row], "id string, name string")
    assert D.valid_file_refs(refs).count() == kept


def test_all_pages_behind_a_token_are_made_without_the_driver(spark):
    """A job, and rows through the driver, for each page before."""
    names = [None, None, "a", "a", "a", "a", "a", "b", *(f"f{i:02d}" for i in range(40))]
    rows = [(n, n and n * 2, "text/plain", "root/") for n in names]
    items = spark.createDataFrame(rows, "id string, name string, mime_type string, parent_id string").repartition(3)
    for size in (2, 3, 7):
        first, token = D.list_folder_by_token(items, "root/", None, size)
        for start in (None, token):
            listed, after = D.list_folder_by_token(items, "root/", start, size, to_the_end=True)
            assert after is None and "LocalTableScan" not in listed._jdf.queryExecution().optimizedPlan().toString()
            expected, page, at = [], 1, start
            while True:
                some, at = D.list_folder_by_token(items, "root/", at, size)
                expected += [(page, r["id"], r["name"]) for r in some.collect()]
                page += 1
                if at is None:
                    break
            found = [tuple(r) for r in listed.collect()]
            assert sorted(found, key=str) == sorted(expected, key=str)


def test_rounds_of_a_walk_send_nothing_to_the_driver(spark):
    """Each round broadcast the table of the round before."""
    from contextlib import ExitStack

    made, join = [], type(listing(spark, [])).join

    def seen(self, other, *args, **kwargs):
        made.append(out := join(self, other, *args, **kwargs))
        return out

    rows = [("a/", "root/")] + [(f"{i}/", f"{i - 1}/" if i else "a/") for i in range(9)]
    from unittest import mock

    with mock.patch.object(type(listing(spark, [])), "join", seen), ExitStack() as stack:
        D._climb(listing(spark, rows), "root/", stack)
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in made]
    assert len(plans) > 2 and all("strategy=merge" in p for p in plans)
