"""Ordered scans, interval lookups, pairing and search against brute force on small data."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.text import key_fingerprint
from fleetlens.operators import dedupe, search
from fleetlens.operators.aggregates import distinct_text, ordered_members
from fleetlens.operators.joins import look_along_time, salted_join, within_minutes
from fleetlens.operators.windows import chunked_scan, fifo_pairs, first_n_per_group, stitch_runs


def rows_of(seed: int, n: int = 200):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), rnd.randrange(60), i, rnd.choice([None, rnd.randrange(9)])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_chunked_scan_equals_plain_scan(spark, width):
    data = rows_of(width)
    df = spark.createDataFrame(data, "k string, t long, i long, v int").repartition(3)
    got = {r.i: r for r in chunked_scan(
        df, ["k"], F.col("t"), ["i"], width=width, sums={"total": F.coalesce("v", F.lit(0))}, lags={"lagged": F.col("v")},
        carried={"now": F.col("v")}, carried_before={"before": F.col("v")}, upcoming={"ahead": F.col("v")}).collect()}
    assert len(got) == len(data)
    for key in "ab":
        ordered = sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2]))
        total, last = 0, None
        for n, (_, _, i, v) in enumerate(ordered):
            total += v or 0
            ahead = next((x[3] for x in ordered[n:] if x[3] is not None), None)
            expected = (total, ordered[n - 1][3] if n else None, v if v is not None else last, last, ahead)
            assert (got[i].total, got[i].lagged, got[i].now, got[i].before, got[i].ahead) == expected
            last = v if v is not None else last


def test_peers_share_a_total(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, 4)], "k string, t long, n long")
    got = chunked_scan(df, ["k"], F.col("t"), width=4, sums={"s": F.col("n")}, peers=True)
    assert sorted((r.t, r.s) for r in got.collect()) == [(5, 3), (5, 3), (9, 7)]


def test_stitched_runs(spark):
    values = "aabbbacca"
    df = spark.createDataFrame([("k", i * 10, v) for i, v in enumerate(values)], "k string, at long, v string")
    for width in (10, 35, 1000):
        got = [r.run_id for r in stitch_runs(df, ["k"], "at", "v", width=width).orderBy("at").collect()]
        assert got == [1, 1, 2, 2, 2, 3, 4, 4, 5]


def greedy_pairs(events):
    """Each login takes the earliest unused logout at or after it."""
    used, out = set(), {}
    for t, i, opens in sorted(e for e in events if e[2]):
        for t2, j, _ in sorted(e for e in events if not e[2]):
            if j not in used and t2 >= t:
                used.add(j)
                out[i] = j
                break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_fifo_pairs_equal_the_greedy_loop(spark, seed):
    rnd = random.Random(seed)
    data = [(k, rnd.randrange(40), n * 1000 + i, rnd.random() < 0.5)
            for n, k in enumerate("pqrs") for i in range(30)]
    df = spark.createDataFrame(data, "k string, t long, i long, opens boolean")
    rows = fifo_pairs(df, ["k"], F.col("t"), F.col("opens"), ["i"], width=6).collect()
    for key in "pqrs":
        opens = {r.pair_no: r.i for r in rows if r.k == key and r.opens}
        closes = {r.pair_no: r.i for r in rows if r.k == key and not r.opens and r.pair_no is not None}
        got = {opens[n]: closes[n] for n in opens if n in closes}
        assert got == greedy_pairs([(t, i, o) for k, t, i, o in data if k == key])


def test_look_along_time_equals_brute_force(spark):
    rnd = random.Random(5)
    items = [(rnd.choice("ab"), rnd.randrange(100), f"{n:03d}") for n in range(80)]
    anchors = [(rnd.choice("abc"), rnd.randrange(100), n) for n in range(40)]
    df_items = spark.createDataFrame(items, "k string, t long, event_hash string")
    df_anchors = spark.createDataFrame(anchors, "k string, at long, id long")
    for keys in (["k"], []):
        got = look_along_time(
            df_anchors.select(*keys, "at", "id"), df_items.select(*keys, "t", "event_hash"), anchor_id="id", keys=keys,
            instants={"before": F.col("at") - 11, "end": F.col("at")}, item_time=F.col("t"), sums={"n": F.lit(1)},
            item=F.col("event_hash"), width=13).collect()
        assert len(got) == len(anchors)
        by_id = {a[2]: a for a in anchors}
        for r in got:
            k, at, _ = by_id[r.id]
            mine = sorted((t, h) for kk, t, h in items if kk == k or not keys)
            assert r.end.n - r.before.n == sum(at - 10 <= t <= at for t, _ in mine)
            later = [x for x in mine if x[0] > at - 11]
            earlier = [x for x in mine if x[0] <= at]
            assert (r.before.next and (r.before.next.at, r.before.next.item)) == (later[0] if later else None)
            assert (r.end.last and (r.end.last.at, r.end.last.item)) == (earlier[-1] if earlier else None)


def test_within_minutes_takes_both_ends(spark):
    anchors = spark.sql("SELECT 1 AS a, timestamp'2024-01-01 00:10:00' AS anchor_ts")
    events = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS timestamp_utc FROM range(30)")
    near = lambda **kw: sorted(r.id for r in within_minutes(anchors, events, 5, **kw).collect())
    assert near() == list(range(5, 16)) and near(after=False) == list(range(5, 11))
    assert near(before=False) == list(range(10, 16))


def test_within_minutes_deals_its_pairs_over_many_tasks(spark):
    # A thousand buckets of a few bytes, which adaptive execution would put into a task or two.
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,5 * id)"
    anchors = spark.range(1000).selectExpr("id AS a", f"{at} AS anchor_ts")
    events = spark.range(1000).selectExpr("id", f"{at} AS timestamp_utc")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = within_minutes(anchors, events, 5).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.a, r.id) for r in rows) == [(a, i) for a in range(1000) for i in range(a - 1, a + 2) if 0 <= i < 1000]
    assert len({r.task for r in rows}) > 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_plain_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("none", 2)], "k string, i long")
    right = spark.createDataFrame([("hot", 7), ("cold", 8)], "k string, v long")
    got = sorted(map(tuple, salted_join(left, right, ["k"], how, salts=4).collect()))
    assert got == sorted(map(tuple, left.join(right, ["k"], how).collect()))


def test_long_lists_keep_their_count(spark):
    df = spark.createDataFrame([("hot", i) for i in range(9)] + [("cold", 1), ("cold", 1)], "k string, v int")
    got = {r.k: (r.n_vs, r.vs) for r in distinct_text(df.withColumn("v", F.col("v").cast("string")), ["k"], "v", "vs", 5).collect()}
    assert got == {"hot": (9, None), "cold": (1, "1")}
    got = {r.k: (r.members, r.ordered) for r in ordered_members(df, ["k"], ["v"], "v", 5).collect()}
    assert got == {"hot": (9, None), "cold": (2, [1, 1])}


def test_first_n(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 3)], "k string, t int")
    got = first_n_per_group(df, ["k"], [F.col("t")], 2)
    assert sorted((r.k, r.t, r.rank_in_group) for r in got.collect()) == [("a", 0, 1), ("a", 1, 2), ("b", 3, 1)]


def test_differences(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, dedupe.both_differences(left, right, ["k"]).collect())) == [(1, "left"), (3, "right")]


def test_search_details(spark):
    assert search.clamp_page("x", "-4") == (50, 0) and search.clamp_page(9999, 3) == (500, 3)
    df = spark.createDataFrame([("a%b",), ("Straße",), ("back\\slash",), (None,)], "t string")
    hit = lambda q: [r.t for r in df.filter(search.ascii_ilike(F.col("t"), q)).collect()]
    # Wildcards work, only ASCII letters fold, a backslash is an ordinary character.
    assert hit("A_B") == ["a%b"] and hit("STRASSE") == [] and hit("K\\S") == ["back\\slash"]
    assert hit("stra") == ["Straße"]


def test_page_puts_nulls_first_rising_and_last_falling(spark):
    df = spark.createDataFrame([("x", None, "3"), ("y", "b", "2"), ("z", "a", "1")],
                               "event_id string, actor_user string, event_hash string")
    ids = lambda **kw: [r.event_id for r in search.page(df, sort="actor_user", **kw).collect()]
    assert ids() == ["x", "z", "y"] and ids(order="desc") == ["y", "z", "x"] and ids(offset=1, limit=1) == ["z"]


def test_deep_pages_are_the_same_pages(spark):
    rnd = random.Random(2)
    users = [None, "a", "b", "c", "d"]
    rows = [(f"{rnd.randrange(16**5):05x}{n}", rnd.choice(users), f"{rnd.random():.9f}",
             None if n % 9 == 0 else f"2024-01-0{n % 3 + 1} 0{n % 7}:00:01") for n in range(300)]
    df = spark.createDataFrame(rows, "event_id string, actor_user string, event_hash string, t string").withColumn(
        "timestamp_utc", F.col("t").cast("timestamp")).cache()
    for sort in ("timestamp_utc", "actor_user", "event_id"):
        for order in ("asc", "desc"):
            for offset in (40, 155, 290, 400):
                ids = lambda **kw: [r.event_id for r in search.page(
                    df, sort=sort, order=order, limit=25, offset=offset, **kw).collect()]
                assert ids(deep_offset=0) == ids()


def test_linked_groups_are_components(spark):
    import random

    from fleetlens.operators.groups import linked_groups

    rng = random.Random(3)
    rows = [(f"h{rng.randrange(2)}", rng.choice(["a", "b", "c", "d", "e", "f", None]), rng.choice(["t1", "t2", "t3", "t4", "t5", None])) for _ in range(14)]
    by_user, by_terminal = linked_groups(spark.createDataFrame(rows + rows, "h string, u string, t string"), ["h"], "u", "t")
    got = {(r.h, "u", r.u): r.group for r in by_user.collect()} | {(r.h, "t", r.t): r.group for r in by_terminal.collect()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for h, u, t in rows:
        if u and t:
            parent[root((h, "u", u))] = root((h, "t", t))
    assert set(got) == set(parent)
    for x in parent:
        for y in parent:
            assert (root(x) == root(y)) == (x[0] == y[0] and got[x] == got[y])


def test_key_fingerprint_of_any_bytes_even_none(spark, tmp_path):
    from fleetlens.plans.catalogue import QUERIES
    texts = ["", None, " ", "ab==", "é" * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda t: "SHA256:" + base64.b64encode(hashlib.sha256(t.encode()).digest()).decode().rstrip("=")
    got = {r.doc_id: r.v for r in QUERIES["fn_18_key_fingerprint"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else digest(t) for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(b,) for b in ("=", "==", "====", "a", "a===", "ab c", "YWI", None)], "b string")
    assert {r.v for r in odd.select(key_fingerprint(F.col("b")).alias("v")).collect()} == {None}


def test_within_minutes_splits_one_window_over_tasks(spark):
    # All events lie in half an hour, which was one bucket and so one task.
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id % 30)"
    anchors, events = spark.range(60).selectExpr("id AS a", f"{at} AS anchor_ts"), spark.range(90).selectExpr("id", f"{at} AS timestamp_utc")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = within_minutes(anchors, events, 30).withColumn("task", F.spark_partition_id()).collect()
        [same] = within_minutes(anchors.filter("a = 3"), events.filter("id = 33"), 0).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.a, r.id) for r in rows) == [(a, i) for a in range(60) for i in range(90)]
    assert len({r.task for r in rows}) >= 3 and (same.a, same.id) == (3, 33)
