"""Hierarchies, orphan references and instants against brute force, and their defined cases."""

import datetime as dt
import random

from tests import brute
from tests.plans import no_broadcasts, plain_sides
from tracelark.operators.hierarchy import descendants, hierarchy, loop_descendants
from tracelark.operators.instants import PATH_SETTING, InstantDictionary, keyed_values, normalise_instants, own_dictionary
from tracelark.operators.orphans import orphan_cascade

UTC = dt.timezone.utc


def tree(spark, rows, extra=False):
    schema = "id string, parent string" + (", path string, w int" if extra else "")
    df = spark.createDataFrame([(*r, "x", 1) if extra else r for r in rows], schema)
    return {r.id: (r.root_id, r.depth, r.n_descendants, r.path) for r in hierarchy(spark, df).collect()}


def expected(rows):
    by = {}
    for i, p in rows:
        if i is not None:
            by.setdefault(i, []).append(p)
    return brute.hierarchy([(i, [p for p in ps if p is not None]) for i, ps in by.items()])


def test_hierarchy_random_forests_with_loops(spark):
    rnd = random.Random(5)
    n = 120
    rows = [(f"n{i:03}", rnd.choice([None, f"n{rnd.randrange(n):03}", f"n{max(0, i - 1):03}", "gone"])) for i in range(n)]
    rows += [("a", "b"), ("b", "a"), ("c", "a"), ("self", "self"), ("below", "self")]
    assert tree(spark, rows, extra=True) == expected(rows)


def test_hierarchy_long_chain_and_star(spark):
    rows = [(f"k{i:03}", f"k{i - 1:03}" if i else None) for i in range(70)] + [(f"s{i:03}", "hub") for i in range(150)] + [("hub", None)]
    assert tree(spark, rows) == expected(rows)


def test_hierarchy_repeats_nulls_and_empty(spark):
    rows = [("a", None), ("a", None), (None, "a"), ("b", "a"), ("b", "a"), ("b", None), ("c", "missing")]
    assert tree(spark, rows) == {"a": ("a", 0, 1, "a"), "b": ("a", 1, 0, "a/b"), "c": ("c", 0, 0, "c")}
    assert tree(spark, []) == {}


def test_descendant_pairs(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "id string, parent string")
    got = {tuple(r) for r in descendants(hierarchy(spark, df)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_ids_with_slashes(spark):
    df = spark.createDataFrame([("a/b", None), ("c", "a/b"), ("d/e/f", "c")], "id string, parent string")
    t = hierarchy(spark, df).persist()
    assert {tuple(r) for r in descendants(t).collect()} == {("a/b", "c", 1), ("a/b", "d/e/f", 2), ("c", "d/e/f", 1)}
    assert {r.id: r.path for r in t.collect()}["d/e/f"] == "a/b/c/d/e/f"


def walked(rows):
    """{(ancestor, id, distance)} of pairs on and below loops, by walking up from every node."""
    ids = {i for i, _ in rows}
    parent = {}
    for i, p in rows:
        if p in ids:
            parent[i] = min(p, parent.get(i, p))
    out = set()
    for i in ids:
        way, at = [i], i
        while at in parent and parent[at] not in way:
            at = parent[at]
            way.append(at)
        if at in parent:
            out |= {(a, i, k) for k, a in enumerate(way) if k}
    return out


def test_descendant_pairs_of_loops(spark):
    rnd = random.Random(15)
    rows = [(f"n{i:03}", rnd.choice([None, f"n{rnd.randrange(150):03}", f"n{rnd.randrange(150):03}", "gone"])) for i in range(150)]
    rows += [("a", "b"), ("b", "a"), ("c", "a"), ("d", "c"), ("z", "y"), ("y", "x"), ("x", "z"), ("w", "y"), ("self", "self"), ("below", "self")]
    df = spark.createDataFrame(rows, "id string, parent string")
    t = hierarchy(spark, df).persist()
    got = [tuple(r) for r in loop_descendants(spark, t, df).collect()]
    assert set(got) == walked(rows) and len(got) == len(set(got))
    counts = {r.id: r.n_descendants for r in t.collect()}
    n = dict.fromkeys(counts, 0)
    for a, *_ in [*got, *map(tuple, descendants(t).collect())]:
        n[a] += 1
    assert n == counts
    none = spark.createDataFrame([("a", None), ("b", "a")], "id string, parent string")
    assert loop_descendants(spark, hierarchy(spark, none), none).count() == 0


def test_hot_keys_meet_plain_exchanges(spark):
    """A key of a third of all rows: right rows, and joins whose partitions the adaptive planner can split."""
    from tracelark.operators import keys

    n = 3000
    with no_broadcasts(spark):
        refs = spark.range(n).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id)) as ref")
        targets = spark.createDataFrame([("hot",), ("hot",), ("k1",), (None,)], "key string")
        d = keys.dangling(refs, "ref", targets, "key")
        assert d.count() == n - n // 3 - 1 and plain_sides(d) == 2
        g = keys.duplicate_members(refs, ["ref"], "id")
        assert g.count() == n // 3 and plain_sides(g) == 2
        values = refs.selectExpr("'f' field_name", "id line_no", "if(id % 3 = 0, '2024-01-02T03:04:05Z', '2024-01-02') raw", "null zone", "null date_order").selectExpr("field_name", "line_no", "raw", "cast(zone as string) zone", "cast(date_order as string) date_order")
        v = normalise_instants(spark, values)
        assert v.count() == n and plain_sides(v) == 2


def ts(day):
    return dt.datetime(2024, 1, day, tzinfo=UTC)


def orphans(spark, refs, targets, gone):
    r = spark.createDataFrame(refs, "src_table string, field_name string, line_no bigint, src_id string, target_table string, ref_value string, ref_ts timestamp")
    t = spark.createDataFrame(targets, "target_table string, id string, ts timestamp")
    d = spark.createDataFrame(gone, "target_table string, id string, del_ts timestamp")
    return {(x.line_no, x.ref_value, x.reason, x.kind) for x in orphan_cascade(spark, r, t, d).collect()}


def test_orphans_reasons_and_cascade(spark):
    refs = [("n", "up", i, f"n{i}", "n", f"n{i - 1}", ts(9)) for i in range(2, 25)]  # a chain over several jobs
    refs += [("n", "up", 1, "n1", "n", "nowhere", ts(9)), ("n", "up", 1, "n1", "n", "nowhere", ts(9))]
    refs += [("m", "x", 50, "m", "t", "dead", ts(9)), ("m", "x", 51, "m", "t", "dead", ts(1)), ("m", "x", 52, "m", "t", "late", ts(3)),
             ("m", "x", 53, "m", "t", "fine", None), ("m", "x", 54, "m", "t", None, ts(3)), ("m", "x", 55, "m", "t", "fine", ts(9))]
    targets = [("n", f"n{i}", ts(1)) for i in range(1, 25)] + [("t", "dead", ts(1)), ("t", "late", ts(5)), ("t", "late", ts(4)), ("t", "fine", ts(2))]
    gone = [("t", "dead", ts(5)), ("t", "dead", ts(7)), ("t", None, ts(1))]
    got = orphans(spark, refs, targets, gone)
    want = {(1, "nowhere", "missing", "direct"), (50, "dead", "deleted", "direct"), (52, "late", "late", "direct")}
    assert got == want | {(i, f"n{i - 1}", None, "inherited") for i in range(2, 25)}


def test_orphans_loop_and_empty(spark):
    refs = [("n", "up", 1, "a", "n", "b", ts(9)), ("n", "up", 2, "b", "n", "a", ts(9)), ("n", "up", 2, "b", "n", "none", ts(9))]
    got = orphans(spark, refs, [("n", "a", ts(1)), ("n", "b", ts(1))], [])
    assert got == {(2, "none", "missing", "direct"), (1, "b", None, "inherited"), (2, "a", None, "inherited")}
    assert orphans(spark, [], [], []) == set()


TEXTS = [
    "2024-03-10T02:30:00", "2024-11-03T01:30:00", "2024-03-31 02:15", "10/12/2024 15:24", "12/27/2023 13:31", "05.12.2023 10:06", "2024-02-30",
    "２０２４-01-02T03:04:05Z", "  2024-01-02　", "1698538041", "1695722320330", "169853804", "Oct 30, 2023, 12:11 AM", "Oct 3, 2023, 12:11 PM",
    "2024年1月14日 上午12:18", "2023年12月30日 下午12:46", "2024年1月18日 19:51", "Wed, 15 Nov 2023 11:10:14 +0100", "Mon Dec 18 2023 05:54:22 GMT+0530",
    "20231109T164735Z", "2024-01-02 22:45:00 UTC", "2024-01-02T22:45:00,4767891Z", "2024-01-02T22:45:00.476789123-0330", "2024-01-02T22:45:00+05",
    "2024-06-11T21:20:26[Asia/Kolkata]", "2024-06-11T21:20:26[No/Where]", "T09:30", "pending", "", None, "0000-00-00 00:00:00", "2024-13-41T09:00:00",
    "2024-01-02T24:00:00Z", "Oct 30, 2023, 13:11 PM", "2023/12/10 08:41:12",
]


def test_instants_against_brute_force(spark, tmp_path):
    owners = [(None, None), ("America/New_York", "MDY"), ("Europe/Berlin", "DMY"), ("Asia/Shanghai", "DMY"), ("Bad/Zone", "YMD")]
    rows = [("f", i * 10 + k, t, z, o) for i, t in enumerate(TEXTS) for k, (z, o) in enumerate(owners)]
    df = spark.createDataFrame(rows, "field_name string, line_no bigint, raw string, zone string, date_order string")
    got = {r.line_no: r.utc_micros for r in normalise_instants(spark, df, str(tmp_path / "d")).collect()}
    want = {}
    for _, line, t, z, o in rows:
        z, o = (None, None) if z == "Bad/Zone" else (z, o)
        if t and "No/Where" in t:
            continue
        if (m := brute.micros(t, z, o)) is not None:
            want[line] = m
    assert got == want


def test_instant_dictionary_grows_once(spark, tmp_path):
    schema = "field_name string, line_no bigint, raw string, zone string, date_order string"
    one = spark.createDataFrame([("f", 1, "2024-01-02", None, None), ("f", 2, "2024-01-02", None, None)], schema)
    two = spark.createDataFrame([("f", 3, "2024-01-02", None, None), ("f", 4, "2024-01-03", None, None)], schema)
    d = InstantDictionary(spark, str(tmp_path / "d"))
    assert d.update(keyed_values(one)).count() == 1 == d.read().count()
    assert d.update(keyed_values(two)).count() == 2 == d.read().count()
    assert d.update(keyed_values(two)).count() == 2 == d.read().count()
    # A named folder lasts from call to call, else each call has its own.
    assert own_dictionary(spark) != own_dictionary(spark)
    spark.conf.set(PATH_SETTING, str(tmp_path / "lasting"))
    try:
        assert own_dictionary(spark) == own_dictionary(spark)
        assert normalise_instants(spark, one).count() == 2 and normalise_instants(spark, two).count() == 2
        assert InstantDictionary(spark, own_dictionary(spark)).read().count() == 2
    finally:
        spark.conf.unset(PATH_SETTING)
    # Two writers that add the same key at the same time: rows do not multiply.
    twin = str(tmp_path / "twin")
    InstantDictionary(spark, twin).update(keyed_values(two))
    batch = InstantDictionary(spark, twin)._batches()[0]
    spark.read.parquet(batch).write.parquet(f"{twin}/b-other")
    assert InstantDictionary(spark, twin).read().count() == 2
    assert normalise_instants(spark, two, twin).count() == 2
    assert normalise_instants(spark, one.limit(0), str(tmp_path / "e")).count() == 0
