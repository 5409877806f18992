"""Streams in several deliveries: any split within the rules gives what one batch gives, restarts and repeats change nothing."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import revision
from tidemark.plans.streams import _bodies, paged
from tidemark.streaming import corrections, pipelines, refreshes, webhooks

RECEIPTS = "event_id long, ts timestamp, user_id long, value double, received long, day date"


def receipts(spark, rows):
    return spark.createDataFrame([(i, datetime(2024, 1, d, 12), u, v, r, date(2024, 1, d)) for i, d, u, v, r in rows], RECEIPTS)


def table(spark, path):
    return {(r.user_id, r.day.day): (r.event_id, r.value) for r in corrections.corrected(spark, path, "event_id long, ts timestamp, user_id long, value double, received long").collect()}


def test_corrections_in_three_deliveries_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.randint(10, 16), rng.randint(1, 5), float(rng.randint(0, 99)), rng.randint(0, 40)) for i in range(300)]
    want = {}
    for i, d, u, v, r in sorted(rows, key=lambda x: (x[4], x[0])):
        want[(u, d)] = (i, v)
    path = str(tmp_path)
    for part in (2, 0, 1):
        one = receipts(spark, [x for x in rows if x[0] % 3 == part])
        pipelines.land(one, f"{path}/landed")
        corrections.correct(one, path, ["user_id"], ["received", "event_id"])
    assert table(spark, path) == want

    settled = {p.name for p in (tmp_path / "days" / "day=2024-01-10").iterdir()}
    late = receipts(spark, [(900, 22, 1, 5.0, 99), (901, 15, 1, -1.0, 99), (902, 16, 1, 7.0, 99), (903, 9, 1, 7.0, 99), (0, *rows[0][1:])])
    pipelines.land(late, f"{path}/landed")
    corrections.correct(late, path, ["user_id"], ["received", "event_id"])
    assert table(spark, path) == {**want, (1, 22): (900, 5.0), (1, 16): (902, 7.0)}  # the 15th lies outside of the 16th to the 22nd
    assert {p.name for p in (tmp_path / "days" / "day=2024-01-10").iterdir()} == settled


def test_a_repeated_batch_and_an_older_receipt_change_nothing(spark, tmp_path):
    path, schema = str(tmp_path), "event_id long, ts timestamp, user_id long, value double, received long"
    merge = lambda rows, number: corrections.merge_days(receipts(spark, rows), number, path, schema, ["user_id"], ["received", "event_id"], 7)
    merge([(1, 10, 1, 1.0, 5), (2, 11, 1, 2.0, 5)], 0)
    merge([(3, 10, 1, 9.0, 6), (4, 11, 1, 8.0, 4)], 1)
    once = table(spark, path)
    assert once == {(1, 10): (3, 9.0), (1, 11): (2, 2.0)}
    merge([(3, 10, 1, 9.0, 6), (4, 11, 1, 8.0, 4)], 1)
    assert table(spark, path) == once
    merge([], 2)
    assert table(spark, path) == once
    with pytest.raises(ValueError, match="days"):
        corrections.correct(receipts(spark, []), path, ["user_id"], ["received"], days=15)


PAGES = "collection long, ts timestamp, epoch int, page int, terminal boolean, member string"


def pages(spark, *given):
    base = date(2024, 1, 1)
    rows = [(c, datetime(2024, 1, 1, hour) + timedelta(d), (base - date(1970, 1, 1)).days + d, page, end, m) for c, d, hour, page, end, members in given for m in members]
    return spark.createDataFrame(rows, PAGES)


def test_refreshes_are_promoted_whole_after_restarts(spark, tmp_path):
    path, first = str(tmp_path), (date(2024, 1, 1) - date(1970, 1, 1)).days

    def deliver(*given):
        rows = pages(spark, *given)
        pipelines.land(rows, f"{path}/landed")
        refreshes.refresh(rows, path)
        return sorted((r.collection, r.epoch - first, r.pages, r.outcome, r.added, r.kept, r.retired) for r in refreshes.outcomes(spark, path).collect())

    assert deliver((1, 0, 1, 1, True, "cd"), (2, 0, 1, 0, True, "x")) == [(2, 0, 1, "promoted", 1, 0, 0)]  # page 0 of collection 1 is missing
    seen = deliver((1, 0, 2, 0, False, "ab"))  # the state of the first run completes it
    assert seen == [(1, 0, 2, "promoted", 4, 0, 0), (2, 0, 1, "promoted", 1, 0, 0)]
    seen = deliver((1, 1, 1, 0, True, "bce"), (2, 1, 1, 0, False, "y"), (2, 1, 2, 2, True, "z"))  # a, d are gone; the hole of collection 2 retires nothing
    assert seen[1] == (1, 1, 1, "promoted", 1, 2, 2) and len(seen) == 3
    assert deliver((1, 1, 1, 0, True, "bce"))[1:3] == [(1, 1, 1, "promoted", 1, 2, 2), (1, 1, 1, "stale", 0, 0, 0)]
    seen = deliver((2, 5, 1, 0, True, "xy"), (1, 5, 1, 1, False, "q"))  # the watermark passes the second day's patience
    assert (2, 1, 2, "expired", 0, 0, 0) in seen and (2, 5, 1, "promoted", 1, 1, 0) in seen and len(seen) == 6


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_webhooks_in_any_split_equal_the_batch_ledger(spark, tmp_path, parts):
    path = str(tmp_path)
    bodies = _bodies(spark, "/root/testdata/sf0.001").persist()
    order = list(range(parts))
    random.Random(parts).shuffle(order)
    for part in [*order, order[0]]:  # the first delivery comes again
        pipelines.land(bodies.where(F.hash("arrived") % parts == part).union(bodies.where((F.hash("arrived") % parts) == part - parts)), f"{path}/landed")
        webhooks.ingest(bodies, path)
    good = webhooks.parsed(bodies).where("fault IS NULL")
    want = revision.ledger(good.select("user_id", "record", "value", "action", "arrived"), "user_id", ["arrived"])
    assert sorted(map(repr, webhooks.records(spark, path).collect())) == sorted(map(repr, want.collect()))
    bodies.unpersist()


def test_webhook_faults(spark):
    good = {"event": "insert", "userId": 1, "id": 2, "weight": 3.5}
    given = [json.dumps(good), "[1]", "", "{", None, json.dumps({**good, "event": "explode"}), json.dumps({**good, "userId": None}), json.dumps({"event": "delete", "userId": 1}), json.dumps({"event": "clear", "userId": 1}), json.dumps({**good, "weight": None}), json.dumps({**good, "event": "test"})]
    rows = webhooks.parsed(spark.createDataFrame(list(enumerate(given)), "arrived long, body string")).orderBy("arrived").collect()
    assert [r.fault for r in rows] == [None, "invalid_body", "invalid_body", "invalid_body", "invalid_body", "unknown_event", "no_user", "no_record", None, "no_value", None]
    assert (rows[0].user_id, rows[0].record, rows[0].value, rows[0].action) == (1, 2, 3.5, "upsert")


def test_streams_without_rows(spark, tmp_path):
    for name, rows, run, read in (
        ("a", receipts(spark, []), lambda r, p: corrections.correct(r, p, ["user_id"], ["received"]), lambda p: corrections.corrected(spark, p, "event_id long, ts timestamp, user_id long, value double, received long")),
        ("b", spark.createDataFrame([], "arrived long, body string"), webhooks.ingest, lambda p: webhooks.records(spark, p)),
        ("c", spark.createDataFrame([], PAGES), refreshes.refresh, lambda p: refreshes.outcomes(spark, p)),
    ):
        path = str(tmp_path / name)
        pipelines.land(rows, f"{path}/landed")
        run(rows, path)
        assert read(path).count() == 0


def test_pages_resume_from_their_token(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"row {i}", i // 4) for i in range(30)], "id long, text string, page int")

    def take(path, pages, **options):
        rows.where(F.col("page").isin(pages)).repartition("page").write.mode("append").partitionBy("page").parquet(f"{path}/pages")
        return sorted((r.page, r.id, r.text, r.error) for r in paged(spark, path, options.pop("window", "w"), "id long, text string", **options).collect())

    once = take(str(tmp_path / "once"), [0, 1, 2, 4, 5, 6, 7])
    assert [x for x in once if x[3]] == [(3, None, None, "missing_page")] and len(once) == 27
    parts = str(tmp_path / "parts")
    assert len(take(parts, [0, 1])) == 8
    assert len(take(parts, [])) == 8
    take(parts, [2])
    assert take(parts, [4, 5, 6, 7]) == once
    with pytest.raises(Exception, match="another_window"):
        take(parts, [8], window="other")
    assert len(take(str(tmp_path / "few"), [0, 1, 2], most=2)) == 8


class _State(dict):
    """A state variable that counts what is written to it."""

    writes = 0

    def updateValue(self, key, value):
        self[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self[key]
        self.writes += 1

    def update(self, value):
        self[None], self.writes = value, self.writes + 1

    iterator = dict.items
    exists = lambda self: bool(self)

    def get(self):
        return self[None]


class _Handle:
    def __init__(self):
        self.states, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _State())

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)


def test_whole_refreshes_never_enter_the_state():
    handle, made = _Handle(), refreshes.Refreshes(2)
    made.init(handle)
    pages = [(1, 0, False, "a"), (1, 1, True, "b"), (2, 0, False, "b"), (2, 1, False, "c"), (3, 1, True, "x")]
    first = list(made.handleInputRows((7,), iter([pd.DataFrame(pages, columns=["epoch", "page", "terminal", "member"])]), None))
    assert [tuple(r) for f in first for r in f.itertuples(index=False)] == [(7, 1, 2, "promoted", 2, 0, 0)]
    assert sum(s.writes for s in handle.states.values()) == 4  # what was promoted, and three pages that wait
    assert sorted(t // refreshes.DAY_MS for t in handle.timers) == [4, 5]
    then = list(made.handleInputRows((7,), iter([pd.DataFrame([(2, 2, True, "d")], columns=["epoch", "page", "terminal", "member"])]), None))
    assert [tuple(r) for f in then for r in f.itertuples(index=False)] == [(7, 2, 3, "promoted", 2, 1, 1)]
    assert list(handle.states["staged"]) == [(3, 1, "x")] and len(handle.timers) == 2
