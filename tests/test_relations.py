"""Who is in which photo: the household, and random tables against plain Python."""

from __future__ import annotations

import random
from datetime import datetime
from itertools import combinations

import pytest

from kithspark.operators import relations as rel
from kithspark.schemas import OCCURRENCES

AT = datetime(2024, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def home(spark):
    rows = [("John", p, 2) for p in "abc"] + [("Mary", p, 1) for p in "bcd"] + [("Alice", p, 1) for p in "ce"] + [("Nobody", "f", 1)]
    return spark.createDataFrame([(n, f"{p}.jpg", f, AT) for n, p, f in rows], OCCURRENCES)


def photos(df):
    return sorted(r.image_path[0] for r in df.collect())


@pytest.mark.parametrize("names, want", [(["John", "Mary"], "bc"), (["John", "Mary", "Alice"], "c"), (["Alice", "Nobody"], ""), (["Mary"], "bcd"), ([], ""), (["John", "Ghost"], ""), ([" JOHN", "john", "mary ", ""], "bc")])
def test_intersection(home, names, want):
    assert "".join(photos(rel.intersection(home, names))) == want


def test_intersections_of_many_requests(spark, home):
    asked = spark.createDataFrame([(1, "John"), (1, "MARY"), (2, "Alice"), (3, "John"), (3, "Ghost"), (4, " ")], "request_id int, person_name string")
    got = {(r.request_id, r.image_path[0]) for r in rel.intersections(home, asked).collect()}
    assert got == {(1, "b"), (1, "c"), (2, "c"), (2, "e")}


def test_resolve(home):
    assert rel.resolved(home, ["john", "Ghost", "MARY", "John"]) == (["John", "Mary"], ["Ghost"])
    assert rel.resolved(home, ["Al", "%"]) == (["Alice"], ["%"])


def test_summaries(home):
    people = {r.person_name: (r.photos, r.faces) for r in rel.people(home).collect()}
    assert people["John"] == (3, 6) and people["Nobody"] == (1, 1)
    assert [r.person_name for r in rel.people_in(home, "c.jpg").collect()] == ["Alice", "John", "Mary"]
    assert tuple(rel.intersection_summary(home, ["John", "Mary", "Ghost"]).first()) == (2, 6)
    assert photos(rel.photos_of(home, "MARY", 2)) == ["b", "c"]


def test_pairs(home):
    got = {(r.person_a, r.person_b): r.photos for r in rel.co_occurrence(home).collect()}
    assert got == {("John", "Mary"): 2, ("Alice", "John"): 1, ("Alice", "Mary"): 1}
    ranked = rel.ranked_pairs(rel.co_occurrence(home), 2).collect()
    assert [(r.person_a, r.weight) for r in ranked] == [("John", 100.0), ("Alice", 50.0)]


def test_recording_adds_faces(spark, home):
    batch = [("john", "a.jpg", 1, AT), ("JOHN", "z.jpg", None, None), (" ", "a.jpg", 1, AT), ("John", None, 1, AT), (None, "a.jpg", 4, AT)]
    got = {(r.person_name, r.image_path): r.faces for r in rel.record(home, spark.createDataFrame(batch, "person_name string, image_path string, faces bigint, seen_at timestamp")).collect()}
    assert got["John", "a.jpg"] == 3 and got["JOHN", "z.jpg"] == 1 and len(got) == home.count() + 1


def test_merge(spark, home):
    after = rel.merged(home, "john", "MARY")
    assert photos(rel.photos_of(after, "John")) == list("abcd")
    assert photos(rel.intersection(after, ["John", "Alice"])) == ["c"]
    assert {r.faces for r in after.where("person_name = 'John' and image_path = 'b.jpg'").collect()} == {3}
    for keep, other in (("John", "JOHN"), ("", "Mary"), ("John", "Ghost")):
        assert rel.merged(home, keep, other).count() == home.count()


def test_forget_and_gallery(home):
    assert rel.forget(home, "JOHN").count() == home.count() - 3
    assert rel.gallery_selection(home, ["mary"]).count() == 3 and rel.gallery_selection(home).count() == home.count()
    with pytest.raises(ValueError, match="Ghost"):
        rel.gallery_selection(home, ["Ghost"])


def test_empty(spark):
    none = rel.empty_occurrences(spark)
    assert rel.co_occurrence(none).count() == rel.people(none).count() == rel.intersection(none, ["x"]).count() == 0
    assert tuple(rel.intersection_summary(none, ["x"]).first()) == (0, 0)


def test_scopes_and_random_pairs(spark):
    r = random.Random(11)
    rows = {(r.randint(0, 2), f"P{r.randint(0, 12):02}", f"photo_{r.randint(0, 60)}") for _ in range(900)}
    df = spark.createDataFrame([(s, n if r.random() < 0.5 else n.lower(), p, 1, AT) for s, n, p in rows], "lib int, person_name string, image_path string, faces bigint, seen_at timestamp")
    want: dict = {}
    for s in range(3):
        for p in {x[2] for x in rows}:
            for a, b in combinations(sorted(n for l, n, q in rows if l == s and q == p), 2):
                want[s, a, b] = want.get((s, a, b), 0) + 1
    got = {(x.lib, x.person_a.upper(), x.person_b.upper()): x.photos for x in rel.co_occurrence(df, ["lib"]).collect()}
    assert got == want


def test_neighbours_wrap_around(home):
    from pyspark.sql import functions as F

    got = {(r.person_name, r.image_path[0]): (r.previous[0], r.following[0]) for r in rel.neighbours_in_order(home, "person_name", [F.col("image_path")], "image_path").collect()}
    assert got["John", "a"] == ("c", "b") and got["Nobody", "f"] == ("f", "f")
