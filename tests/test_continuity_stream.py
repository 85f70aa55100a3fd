"""Scans in micro-batches against the batch form, run by run."""

import datetime as dt
import json
import os
import random
import uuid

from eventlens.operators import completeness
from eventlens.streaming import continuity

DAY = dt.datetime(2024, 1, 1)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_runs(seed):
    """{(scope, run): (more_pages, [(page, position, id, instant)])}: complete, capped, gapped and empty runs."""
    rnd = random.Random(seed)
    runs = {}
    for scope in ("a", "b", "c", "d"):
        instants = {f"{scope}{i}": DAY + dt.timedelta(hours=i // 2) for i in range(20)}
        reach = 4
        for run in (1, 2, 3):
            reach += rnd.randint(0, 8)
            seen = [i for i in sorted(instants, key=lambda i: (-instants[i].timestamp(), i)) if int(i[1:]) < reach and rnd.random() > 0.25]
            more = rnd.random() < 0.4
            seen = seen[: rnd.choice([0, 3, 20])]
            runs[scope, run] = (more, [(n // 3, n % 3, i, instants[i]) for n, i in enumerate(seen)])
    return runs


def batch_form(spark, runs):
    """All runs by the batch operators, one after the other."""
    marks, boundary, out = {}, {}, []
    items_of = "scope string, page_number bigint, item_position bigint, source_comment_id string, published_at timestamp_ntz"
    for run in (1, 2, 3):
        scans = spark.createDataFrame([(s, runs[s, run][0]) for s, r in runs if r == run], "scope string, more_pages boolean")
        items = spark.createDataFrame([(s, *i) for s, r in runs if r == run for i in runs[s, r][1]], items_of)
        checkpoints = spark.createDataFrame(list(marks.items()), "scope string, committed_watermark_at timestamp_ntz")
        ids = spark.createDataFrame([(s, i) for s, found in boundary.items() for i in found], "scope string, source_comment_id string")
        states = completeness.advance_watermark(completeness.continuity(items, scans, checkpoints, ids))
        rows = states.collect()
        found = completeness.boundary_ids(items, states.filter("watermark_advanced")).collect()
        for r in rows:
            out.append((r.scope, run, r.continuity_status, r.watermark_reached, r.remaining_boundary_ids, r.records_observed, r.committed_watermark_at, r.candidate_watermark_at, r.watermark_advanced, r.next_watermark_at))
            if r.watermark_advanced:
                marks[r.scope] = r.next_watermark_at
                boundary[r.scope] = [f.source_comment_id for f in found if f.scope == r.scope]
    return sorted(out, key=repr), sorted((s, i, marks[s]) for s, found in boundary.items() for i in found)


def pages_of(runs):
    for (scope, run), (more, items) in runs.items():
        last = max((page for page, *_ in items), default=0)
        for page in range(last + 1):
            rows = [{"source_comment_id": i, "published_at": t.isoformat()} for p, _, i, t in items if p == page]
            yield {"scope": scope, "run_number": run, "page_number": page, "is_last": page == last, "items": rows} | ({"more_pages": more} if page == last else {})


def test_runs_in_micro_batches_are_those_of_the_batch_form(spark, tmp_path):
    runs = some_runs(3)
    want, boundary = batch_form(spark, runs)
    assert {w[2] for w in want} >= {"COMPLETE_TO_WATERMARK", "CAPPED_BEFORE_WATERMARK", "POTENTIAL_GAP", "INITIAL_LOAD_CAPPED"}
    assert any(w[5] == 0 for w in want)
    tables = continuity.continuity_tables(spark, str(tmp_path / "tables"), f"t{uuid.uuid4().hex}", buckets=4)
    folder = str(tmp_path / "arrived")
    os.makedirs(folder)
    # the last page of a run comes with the pages of the next one, two runs of a scope are complete at once
    arrivals = {0: [], 1: [], 2: []}
    for page in pages_of(runs):
        step = page["run_number"] - 1 + (page["is_last"] and page["scope"] in "ab")
        arrivals[min(step, 2)].append(page)
    for number, pages in arrivals.items():
        with open(f"{folder}/{number}.json", "w") as out:
            out.write("\n".join(json.dumps(p) for p in pages))
        continuity.run_scans(tables, folder, f"{tables.root}-state")
    assert plain(tables.live("continuity")) == want
    assert plain(continuity.current_boundary(tables)) == boundary


def test_an_older_run_that_ends_late_moves_nothing(spark, tmp_path):
    tables = continuity.continuity_tables(spark, str(tmp_path / "tables"), f"t{uuid.uuid4().hex}", buckets=4)
    page = lambda run, number, last, item: (
        "a", run, number, last, False if last else None, [(item, DAY + dt.timedelta(hours=int(item[1:])))]
    )
    schema = continuity.page_schema()
    continuity.fold(tables, spark.createDataFrame([page(2, 0, True, "x5"), page(1, 0, False, "x1")], schema), 0)
    continuity.fold(tables, spark.createDataFrame([page(1, 1, True, "x9")], schema), 1)
    log = {r.run_number: r.continuity_status for r in tables.live("continuity").collect()}
    assert log == {2: "COMPLETE_TO_WATERMARK", 1: "SUPERSEDED"}
    assert plain(continuity.current_boundary(tables)) == [("a", "x5", DAY + dt.timedelta(hours=5))]
    continuity.fold(tables, spark.createDataFrame([], schema), 1)  # run again: nothing changes
    assert tables.live("continuity").count() == 2
