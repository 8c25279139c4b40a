"""The queries of this subpackage over hostile and empty tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from kithspark.llm.queries import R
from tests import hostile


@pytest.fixture(scope="module")
def bad(spark, tmp_path_factory):
    return hostile.write(spark, str(tmp_path_factory.mktemp("hostile")))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return hostile.write(spark, str(tmp_path_factory.mktemp("empty")), empty=True)


@pytest.mark.parametrize("name", sorted(R.queries))
def test_empty_tables(spark, none, name):
    assert entry.queries()[name](spark, none).count() == 0


WANT = {
    "p1_found": {(1, 2), (1, 3), (1, 6), (4, 5)},
    "p3_found": {(1, 2), (1, 10), (1, 11), (1, 12), (1, 13), (7, 1), (7, 6)},
    "p4_found": {(1, 2), (6, 8)},
    "p5_found": {("embedding", 1, 2), ("embedding", 1, 3), ("embedding", 1, 6), ("embedding", 2, 3), ("embedding", 2, 6), ("embedding", 3, 6), ("embedding", 4, 5), ("eye_embedding", 2, 3), ("person", 1, 2), ("person", 1, 3), ("person", 1, 5), ("person", 1, 6), ("person", 1, 4), ("person", 2, 3), ("person", 2, 4), ("person", 2, 5), ("person", 2, 6), ("person", 3, 4), ("person", 3, 5), ("person", 3, 6), ("person", 4, 5), ("person", 4, 6), ("person", 5, 6)},
    "p8_found": {(5, 1)},
    "p9_found": {(4,)},
}


@pytest.mark.parametrize("name", sorted(R.queries))
def test_hostile_tables(spark, bad, name):
    got = {tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in entry.queries()[name](spark, bad).collect()}
    if name in WANT:
        assert got == WANT[name]


def test_hostile_names_and_ids(spark, bad):
    pairs = {tuple(r) for r in entry.queries()["p6_found"](spark, bad).collect()}
    assert {("person", 1, "person", 2), ("person", 1, "request", 1), ("person", 2, "request", 1)} <= pairs
    ids = {r.doc_id: len(r.ids) for r in entry.queries()["p7_ids"](spark, bad).collect()}
    assert ids[1] == ids[2] == 0 < ids[3] and ids[6] > 50_000 and None in ids


def test_hostile_groups_forms_items_scores_and_rates(spark, bad):
    run = lambda name: entry.queries()[name](spark, bad).collect()
    groups = {r.group_face_id: (r["size"], set(r.members)) for r in run("p1_groups")}
    assert groups[4] == (2, {4, 5}) and groups[1][0] == 4 and len(groups[1][1]) == 3 and groups[1][1] < {1, 2, 3, 6} and len(groups) == 2
    forms = {r.person_id: r.name_form for r in run("p4_names")}
    assert forms[1] == forms[2] == "Ann Sorel" != forms[3] and forms[4] is None
    assert [(r.item_id, r.documents, r.longest) for r in run("p8_items")] == [(1, 1, 24)]
    scores = {r.doc_id: (r.score, r.kind) for r in run("p9_scores")}
    assert len(scores) == 10 and scores[4][1] == "abusive" and scores[4][0] >= 0.5 and scores[1] == scores[2] == scores[3] == (0.0, None)
    assert {r.source: (r.documents, r.abusive, r.rate) for r in run("p9_sources")} == {None: (1, 1, 1.0), "mail": (9, 0, 0.0)}
