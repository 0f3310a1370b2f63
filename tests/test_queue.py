"""Review batches: every guard, all or nothing, draining and settling."""

import pytest

from factloom.operators import queue

Q = "id long, record_id long, model_id long, status string, resolved boolean, candidates array<string>"
ROWS = [
    (1, 10, None, "pending", False, ["acme-one", " acme-1 ", ""]), (2, 11, 1, "resolved", True, ["x"]), (3, 11, None, "pending", False, ["x"]), (4, 12, None, "pending", False, ["beta"]), (5, 12, None, "pending", False, ["beta"]),
    (6, 13, None, "pending", True, None), (7, 14, None, "pending", False, ["gamma", "delta"]), (8, 15, None, "pending", False, ["delta", "eps"]), (9, 16, None, "pending", False, []), (10, 17, None, "pending", False, [" "]), (11, 18, None, "pending", False, ["q"]),
]
RECORDS = [(10, "s", "acme-one", None), (11, "s", "eleven", "x"), (12, "s", "beta", None), (13, "s", "n", None), (14, "s", "acme-1", None), (15, "s", "delta", None), (16, "s", "eps", None), (17, "t", "acme-1", None), (18, "s", "q", "q")]


@pytest.fixture(scope="module")
def review(spark):
    return queue.Review(
        models=spark.createDataFrame([(1, "acme/one", "acme", "One"), (7, "acme/two", "acme", None)], "id long, slug string, developer_id string, display_name string"),
        organizations=spark.createDataFrame([("acme", "Acme", ["Acme Labs"]), ("beta", "Beta", None)], "id string, display_name string, aliases array<string>"),
        aliases=spark.createDataFrame([("s", "old", 1, "exact"), ("s", "free", None, None)], "source_id string, alias string, model_id long, method string"),
        records=spark.createDataFrame(RECORDS, "id long, source_id string, name string, alias string"),
        queue=spark.createDataFrame(ROWS, Q),
        audit=spark.createDataFrame([], "queue_id long, record_id long, model_id long, action string"),
    )


def approvals(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position long, queue_id long, model_id long")


def found(problems):
    return {r.position: r.problem for r in problems.collect()}


def test_guards_of_approvals(spark, review):
    rows = [(1, 1), (99, 1), (1, 1), (3, 1), (4, 7), (5, 7), (6, 1), (7, 55), (None, 1), (8, None), (2, 1)]
    waiting = "queue row is not pending without a candidate"
    assert found(queue.accept_problems(review, approvals(spark, *rows))) == {
        1: "queue row not found", 2: waiting, 3: "record has another authoritative row", 5: "record has another authoritative row", 6: waiting,
        7: "model not found", 8: "a number is missing", 9: "a number is missing", 10: waiting,
    }


def models(spark, *rows):
    return spark.createDataFrame([(i, *r, None) for i, r in enumerate(rows)], "position long, queue_id long, slug string, developer_id string, aliases array<string>, display_name string")


def test_guards_of_new_models(spark, review):
    ok = ("acme/new", "acme", ["n"])
    rows = [
        (1, "beta/x", "acme", ["a"]), (1, "acme/x/y", "acme", ["a"]), (1, "acme/one", "acme", ["a"]), (1, "none/x", "none", ["a"]), (99, "acme/b", "acme", ["b"]), (2, "acme/c", "acme", ["c"]), (3, "acme/d", "acme", ["d"]),
        (11, "acme/e", "acme", ["e"]), (7, "acme/f", "acme", ["F_g", "f-g"]), (8, "acme/g", "acme", ["old"]), (9, *ok), (4, "acme/new", "acme", ["m"]), (10, "acme/h", "acme", []), (None, "acme/i", "acme", ["i"]), (10, " ", "acme", ["j"]),
        (10, "acme/k", "acme", ["free", "n"]), (6, "acme/l", "acme", ["l", " "]),
    ]
    got = found(queue.new_model_problems(review, models(spark, *rows)))
    assert got == {
        0: "slug doesn't begin with the developer", 1: "slug has more than two parts", 2: "model exists", 3: "organization not found", 4: "queue row not found", 5: "queue row is not pending without a candidate",
        6: "record has another authoritative row", 7: "record is linked", 8: "an alias is named twice", 9: "alias is linked to a model", 11: "model exists", 12: "a text is missing", 13: "a number is missing", 14: "a text is missing",
        15: "queue row is not pending without a candidate", 16: "a text is missing",
    }
    both = models(spark, (8, "acme/p", "acme", ["same"]), (9, "acme/q", "acme", ["same"]), (10, "acme/r", "acme", ["same", "free"]))
    assert found(queue.new_model_problems(review, both)) == {1: "alias is linked to a model"}  # the third is of another source


def organizations(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position long, id string, display_name string, aliases array<string>")


def test_guards_of_organizations(spark, review):
    rows = [("acme", "A", []), ("acme-labs", "A", []), ("new", "N", ["Acme_Labs"]), ("Upper", "U", []), ("twice", "T", ["Twice"]), ("one", "O", ["Uno"]), ("uno", "U", []), ("", "E", []), ("blank", " ", None), ("good", "G", None), ("nul", "N", [None])]
    assert found(queue.organization_problems(review, organizations(spark, *rows))) == {
        0: "organization exists", 1: "organization exists", 2: "identity exists", 3: "id isn't normalized", 4: "an identity is named twice", 6: "identity is in the batch already", 7: "a text is missing", 8: "a text is missing", 10: "a text is missing",
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_batches_change_all_or_nothing(spark, review):
    with pytest.raises(queue.Rejected, match="99: queue row not found"):
        queue.accept_batch(review, approvals(spark, (1, 1), (99, 1)))
    with pytest.raises(queue.Rejected, match="model exists"):
        queue.accept_new_models(review, models(spark, (8, "acme/new", "acme", ["n"]), (9, "acme/one", "acme", ["m"])))
    with pytest.raises(queue.Rejected, match="exists"):
        queue.accept_organizations(review, organizations(spark, ("fine", "F", []), ("acme", "A", [])))
    assert rows(review.queue, "id", "status") == [(r[0], r[3]) for r in sorted(ROWS, key=lambda r: repr((r[0], r[3])))] and review.audit.isEmpty()

    more = queue.accept_organizations(review, organizations(spark, ("fine", "F", ["Fine Labs"])))
    minted = queue.accept_new_models(more, models(spark, (9, "fine/a", "fine", ["free", "fa"]), (8, "acme/b", "acme", ["ab"])))
    assert rows(minted.models.where("id > 7"), "id", "slug", "developer_id") == [(8, "fine/a", "fine"), (9, "acme/b", "acme")]
    assert rows(minted.aliases, "source_id", "alias", "model_id") == [("s", "ab", 9), ("s", "fa", 8), ("s", "free", 8), ("s", "old", 1)]
    assert rows(minted.queue.where("id IN (8, 9)"), "id", "model_id", "status", "resolved") == [(8, 9, "resolved", True), (9, 8, "resolved", True)]
    assert rows(minted.records.where("id IN (15, 16)"), "id", "alias") == [(15, "ab"), (16, "free")]
    assert rows(minted.audit, "queue_id", "record_id", "model_id", "action") == [(8, 15, 9, "new_model"), (9, 16, 8, "new_model")]


def test_draining_gives_names_once(spark, review):
    accepted = queue.accept_batch(review, approvals(spark, (1, 7), (9, 1), (10, 1)))
    done, summary = queue.drain(accepted)
    assert tuple(summary.first()) == (1, 2, 2)  # rows without a name are left out
    assert rows(done.aliases.where("alias LIKE 'acme%'"), "source_id", "alias", "model_id", "method") == [("s", "acme-1", 7, "manual_review"), ("s", "acme-one", 7, "manual_review")]
    assert rows(done.records.where("id = 10"), "alias") == [("acme-one",)] and rows(done.queue.where("id IN (1, 9)"), "id", "resolved") == [(1, True), (9, False)]
    again, summary = queue.drain(done)
    assert tuple(summary.first())[:2] == (0, 0) and rows(again.audit, "action") == [("accept",)] * 3 + [("drain",)]
    assert tuple(queue.drain(accepted, only=[])[1].first()) == (0, 0, 0)


def test_settling_follows_names_to_the_end(spark, review):
    done = queue.settle(queue.accept_batch(review, approvals(spark, (1, 7))))
    # 1 names acme-1, which is record 14; its row names delta, which is 15; that names eps, which is 16; another source isn't touched
    assert rows(done.queue.where("id IN (7, 8, 9, 10)"), "id", "model_id", "status", "resolved") == [(10, None, "pending", False), (7, 7, "accepted", True), (8, 7, "accepted", True), (9, 7, "accepted", True)]
    assert rows(done.records.where("id IN (14, 15, 16, 17)"), "id", "alias") == [(14, "acme-1"), (15, "delta"), (16, "eps"), (17, None)]
    assert rows(done.audit.where("action = 'settle'"), "queue_id") == [(7,), (8,), (9,)]
    with pytest.raises(RuntimeError, match="settle"):
        queue.settle(queue.accept_batch(review, approvals(spark, (1, 7))), max_rounds=2)


def test_settling_writes_nothing_again_round_by_round(spark):
    """A chain of 12 names, and one name that two rows of a round give: tables are changed once, the last row's model holds."""
    from unittest import mock

    chain = [(i, 100 + i, None, "pending", False, [f"n{i + 1}", f"n{i}"]) for i in range(12)]
    more = [(20, 120, None, "pending", False, ["both"]), (21, 121, None, "pending", False, ["both"]), (22, 122, None, "pending", False, [])]
    records = [(100 + i, "s", f"n{i}", None) for i in range(12)] + [(120, "s", "p", None), (121, "s", "q", None), (122, "s", "both", None)]
    r = queue.Review(
        models=spark.createDataFrame([(1, "a/b", "a", "B")], "id long, slug string, developer_id string, display_name string"), organizations=spark.createDataFrame([], "id string, display_name string, aliases array<string>"),
        aliases=spark.createDataFrame([("s", "n0", 1, "exact"), ("s", "p", 2, "exact"), ("s", "q", 3, "exact"), ("s", "n5", 9, "exact"), ("s", "n7", None, None)], "source_id string, alias string, model_id long, method string"),
        records=spark.createDataFrame(records, "id long, source_id string, name string, alias string"), queue=spark.createDataFrame(chain + more, Q), audit=spark.createDataFrame([], "queue_id long, record_id long, model_id long, action string"),
    )
    with mock.patch.object(queue, "_applied", wraps=queue._applied) as applied:
        done = queue.settle(r)
    assert applied.call_count == 2  # draining, and all rounds at once
    assert {t.id: t.model_id for t in done.queue.collect()} == {i: 1 if i < 5 else 9 for i in range(12)} | {20: 2, 21: 3, 22: 3}
    assert {(t.alias, t.model_id) for t in done.aliases.collect()} == {(f"n{i}", 1 if i < 5 else 9) for i in range(13)} | {("p", 2), ("q", 3), ("both", 3)}
    assert {t.alias for t in done.records.collect()} == {t.name for t in done.records.collect()}
