"""Rules, keys, corpus build, lineage, scoring and reports on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tracelark.operators import corpus_build, keys, lineage, report, rules, scoring, search
from tracelark.operators.compare import version_diff


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", 3), (2, None, -1), (3, "b", None)], "id int, s string, n int")
    rs = [rules.Rule("S_MISSING", F.col("s").isNull()), rules.Rule("N_NEGATIVE", F.col("n") < 0, "warning")]
    v = rules.violations(df, rs, "id")
    assert rows(v) == {(2, "S_MISSING", "error"), (2, "N_NEGATIVE", "warning")}
    assert rows(rules.histogram(v)) == {("S_MISSING", "error", 1), ("N_NEGATIVE", "warning", 1)}
    assert rows(rules.status(v)) == {(1, 1, "failed")}
    assert rows(rules.status(v.limit(0))) == {(0, 0, "passed")}
    assert rules.first_failing_row(df, rs, "id").first().code == "S_MISSING"
    assert rules.first_failing_row(df.filter("id = 1"), rs, "id").first().code is None


def test_keys(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, "x")], "i int, k string")
    assert rows(keys.duplicate_members(df, ["k"], "i").select("i", "group_size", "first")) == {(1, 3, 1), (2, 3, 1), (6, 3, 1)}
    assert rows(keys.later_copies(df, ["k"], "i").select("i")) == {(2,), (6,)}
    assert rows(keys.conflicts(df, ["k"], "i")) == {("x", 3)}
    t = spark.createDataFrame([("x",), ("x",)], "id string")
    assert rows(keys.dangling(df, "k", t, "id").select("i")) == {(3,)}
    seq = spark.createDataFrame([("p", 1, 5), ("p", 2, 4), ("p", 6, 9), ("q", 1, 1)], "p string, n int, v int")
    assert rows(keys.out_of_order(seq, "n", "v", ["p"]).select("p", "n")) == {("p", 2)}
    assert rows(keys.gaps(seq, "n", ["p"])) == {("p", 2, 6, 3)}
    spans = keys.with_before(seq, "n", "v", ["p"], span=2)
    assert rows(spans.select("p", "n", "before")) == {("p", 1, None), ("p", 2, 5), ("p", 6, 4), ("q", 1, None)}
    d = spark.createDataFrame([("a", 2), ("b", None), ("c", 1)], "k string, n int")
    a = spark.createDataFrame([("a", 2), ("c", 3)], "k string, n int")
    assert rows(keys.agreement(d, a, "k")) == {("c", 1, 3)}


def test_capped_top_is_greedy(spark):
    data = [(i, "fgh"[i % 3], (i * 7) % 5) for i in range(30)]
    df = spark.createDataFrame(data, "id int, fam string, score int")
    got = [r.id for r in keys.capped_top(df, "fam", [F.desc("score"), F.col("fam"), F.col("id")], 2, 5).collect()]
    taken, count = [], {}
    for i, f, s in sorted(data, key=lambda r: (-r[2], r[1], r[0])):
        if count.get(f, 0) < 2 and len(taken) < 5:
            taken.append(i)
            count[f] = count.get(f, 0) + 1
    assert got == taken


def test_merge_is_idempotent(spark):
    one = spark.createDataFrame([("v1", "a", ["S1"])], "id string, art string, labels array<string>")
    two = spark.createDataFrame([("v1", "zzz", ["S2"]), ("v2", "b", ["S2"])], "id string, art string, labels array<string>")
    m = keys.merge_versions(one, two, "id", "labels")
    again = keys.merge_versions(m, two, "id", "labels")
    want = {("v1", "a", ("S1", "S2")), ("v2", "b", ("S2",))}
    assert {(r.id, r.art, tuple(r.labels)) for r in m.collect()} == want == {(r.id, r.art, tuple(r.labels)) for r in again.collect()}


PAGE = "Top bar\nMy title\nBy someone\nSep 1, 2026, 4:00 PM\n\n3 listened\n￼\nFirst.\n  Second.  \nEND\n\nThird.\nReads120\nAfter"


@pytest.mark.parametrize(
    ("page", "title", "want"),
    [
        (PAGE, "My title", ["First.", "Second.", "Third."]),
        ("Head\nOne\nTwo\nRead more\nx", "Nowhere", ["One", "Two"]),
        ("Only", "Only", []),
        ("", "t", []),
    ],
)
def test_article_lines(spark, page, title, want):
    df = spark.createDataFrame([(page, title)], "document_text string, title string")
    v = corpus_build.source_versions(df)
    assert corpus_build.article_lines(v, "document", "title").first().lines == want


def test_article_lines_of_a_long_page(spark):
    import time

    head = "T\x0bSep 1, 2026, 4:00 PM\u2028LISTENED\x85"
    df = spark.createDataFrame([(head + "\n".join(f" l{i} " for i in range(20_000)), "T"), ("x", None)], "document_text string, title string")
    v = corpus_build.article_lines(corpus_build.source_versions(df), "document", "title")
    v.filter("title is null").collect()
    began = time.time()
    assert v.filter("title = 'T'").first().lines == [f"l{i}" for i in range(20_000)]
    assert time.time() - began < 10


def test_paragraph_offsets(spark):
    df = spark.createDataFrame([("a\nbb\n\nccc",), ("",)], "document_text string")
    v = corpus_build.source_versions(df)
    lines = F.filter(F.split("document", "\n"), lambda x: x != "")
    p = corpus_build.paragraph_index(v, lines).orderBy("source_version_id", "paragraph_index").collect()
    spans = {(r.paragraph_index, r.text, r.char_start, r.char_end) for r in p}
    assert spans == {(0, "a", 0, 1), (1, "bb", 2, 4), (2, "ccc", 5, 8), (0, "", 0, 0)}
    s = corpus_build.carried_section(corpus_build.paragraph_index(v, lines), F.length("text") == 2)
    assert {(r.text, r.section) for r in s.collect()} == {("a", None), ("bb", "bb"), ("ccc", "bb"), ("", None)}


def test_version_chain(spark):
    df = spark.createDataFrame([("a", "v1", 1), ("a", "v2", 2), ("a", "v1", 3), ("b", "v9", 1)], "art string, source_version_id string, n int")
    c = corpus_build.version_chain(df, "art", ["n"])
    assert rows(c.select("art", "source_version_id", "supersedes")) == {("a", "v1", None), ("a", "v2", "v1"), ("b", "v9", None)}
    assert {(r.art, r.is_line) for r in corpus_build.chain_check(c, "art").collect()} == {("a", True), ("b", True)}
    broken = spark.createDataFrame([("a", "v1", None), ("a", "v2", "v1"), ("a", "v3", "v1"), ("b", "w1", "gone")], "art string, source_version_id string, supersedes string")
    assert {(r.art, r.is_line) for r in corpus_build.chain_check(broken, "art").collect()} == {("a", False), ("b", False)}


def test_number_gaps_over_thousands(spark, tmp_path):
    from tracelark.plans import corpus

    ids = [f"L2-{i}" for i in (998, 1003, 1004, 1006, 4001, 4002, 1_999_999, 2_000_001)] + ["L2-998"]
    spark.createDataFrame([(i,) for i in ids], "record_id string").write.parquet(str(tmp_path / "l2_article_maps.parquet"))
    got = rows(corpus.number_gaps(spark, str(tmp_path)))
    assert got == {(1, 998, 1003, 4), (1, 1004, 1006, 1), (4, 1006, 4001, 2994), (1999, 4002, 1_999_999, 1_995_996), (2000, 1_999_999, 2_000_001, 1)}


def test_deep_lineage(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(150)] + [("x", "y"), ("y", "x")], "id string, input string")
    got = rows(lineage.transitive_inputs(spark, e))
    chain = {(f"n{i}", f"n{k}", k - i) for i in range(150) for k in range(i + 1, 151)}
    assert got == chain | {("x", "y", 1), ("x", "x", 2), ("y", "x", 1), ("y", "y", 2)}
    assert max(d for *_, d in rows(lineage.transitive_inputs(spark, e, 10))) == 10


def test_reach_and_walks(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    for growth in (4, 0):  # with 0 the stride never doubles
        monkeypatch.setattr(lineage, "MOST_GROWTH", growth)
        data = {(f"n{i:02}", f"n{rnd.randrange(i):02}") for i in range(1, 60) for _ in range(rnd.randrange(3))} | {("x", "y"), ("y", "x"), ("z", "y"), ("p", "p")}
        e = spark.createDataFrame([*data, (None, "n00"), ("n01", None)], "id string, input string")
        seeds = {"n03", "x", "alone"}
        want, before = set(seeds), None
        while want != before:
            before, want = want, want | {i for i, j in data if j in want}
        assert {r.id for r in lineage.reached(spark, e, spark.createDataFrame([(s,) for s in [*seeds, None]], "id string")).collect()} == want
        starts = {i for i, _ in data}
        for n in range(1, 8):
            assert {r.id for r in lineage.with_walk(spark, e, n).collect()} == starts
            starts = {i for i, j in data if j in starts}


def test_lineage(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "x"), (None, "q")], "id string, input string")
    got = rows(lineage.transitive_inputs(spark, e))
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "b", 2), ("c", "b", 1), ("c", "c", 2), ("d", "x", 1)}
    n = spark.createDataFrame([(i, i != "bad") for i in "a b c d ok up bad on".split()], "id string, base boolean")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "x"), ("up", "ok"), ("on", "bad"), ("on", "ok")], "id string, input string")
    sound = {r.id for r in lineage.sound_records(spark, n, e).collect() if r.sound}
    assert sound == {"ok", "up"}


def test_contrasts_are_pairwise_complete(spark):
    long = [("c1", "C", 1.0), ("c1", "D", 3.0), ("c1", "E", 2.0), ("c1", "F", 6.0), ("c2", "C", 2.0), ("c2", "D", None), ("c2", "E", 5.0), ("c2", "F", 5.0)]
    df = spark.createDataFrame([(*r, "m") for r in long], "case_id string, grp string, value double, field string")
    got = {r.effect: (r.estimate, r.n_complete, r.n_missing) for r in scoring.contrasts(df).collect()}
    assert got["support_direct"] == (2.0, 1, 1) and got["support_when_framed"] == (2.0, 2, 0) and got["frame_without_support"] == (2.0, 2, 0)
    assert got["interaction"] == (2.0, 1, 1) and got["support_main_effect"] == (3.0, 1, 1)
    m = {r.grp: (r["mean"], r.n_observed, r.n_missing, r.total) for r in scoring.group_means(df).collect()}
    assert m["D"] == (3.0, 1, 1, 3.0) and m["C"] == (1.5, 2, 0, 3.0)


def test_planning_numbers(spark):
    one = spark.range(1)
    lit = {k: F.lit(v) for k, v in dict(chars=3000, claims=20, sources=4, v1=6, v2=2, v3=1, live=0, cards=0).items()}
    b = one.select(scoring.token_bands(**lit).alias("b")).first().b
    assert (b.v2_low, b.v2_high, b.v3_low, b.v3_high) == (5200, 16000, 7000, 22000)
    assert b.total_low == b.initial_low + b.v2_low + b.v3_low and b.total_high == b.initial_high + b.v2_high + b.v3_high
    s = one.select(scoring.scaled(F.lit(7), 10, 4).alias("a"), scoring.scaled(F.lit(8), 10, 4).alias("b")).first()
    assert (s.a, s.b) == (18, 20)


def test_version_diff(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, ""), (3, "same", "same")], "i int, before string, after string")
    got = {r.i: (r.added, r.removed, r.replaced, r.kept, r.ratio, r.char_delta, r.paragraph_delta) for r in version_diff(df, "i").collect()}
    assert got == {1: (1, 0, 1, 2, 0.571429, 2, 1), 2: (0, 0, 0, 0, 1.0, 0, 0), 3: (0, 0, 0, 1, 1.0, 0, 0)}


def test_search_columns(spark):
    df = spark.createDataFrame([(["General", " Price "], ["cn"]), ([], ["global"]), (None, ["us"])], "tags array<string>, j array<string>")
    got = df.select(search.family(F.col("tags")).alias("f"), search.dimension_score(F.col("j"), ["CN"], ["global"]).alias("s")).collect()
    assert [tuple(r) for r in got] == [("price", 1), ("general-review", 0), ("general-review", None)]


REPORT = "intro\n## One\ntext\n### 1. Item\n- 原文位置：p3\n### Two\nx\n## Two\n\n## 技术附录\n## Hidden\nR3"


def test_report(spark):
    df = spark.createDataFrame([(1, REPORT)], "id int, text string")
    parts = report.report_sections(df, "id")
    assert {(r.position, r.title, r["items"]) for r in parts.collect()} == {(1, "One", 2), (2, "Two", 0)}
    items = report.report_items(parts, "id")
    assert {(r.item_no, r.heading) for r in items.collect()} == {(1, "Item"), (2, "Two")}
    assert items.filter("item_no = 1").select(report.label_values(F.col("item"), "原文位置").alias("v")).first().v == ["p3"]
    assert rows(report.section_issues(parts, "id", ["Two", "One"])) == {(1, "SECTION_ORDER_INVALID"), (1, "REQUIRED_SECTION_BODY_EMPTY")}
    leaks = spark.createDataFrame([("see R2",), (REPORT,), ("<b>x</b>",)], "t string").select(report.reader_leaks(F.col("t")).alias("l")).collect()
    assert [r.l for r in leaks] == [["INTERNAL_CODE_IN_READER_LAYER"], [], ["RAW_HTML_IN_READER_CONTENT"]]


FULL = """intro
## 结论
可以发布。请勿在本周公开。
## 发布前需要处理
### 1. 口径
- 原文位置：第三段落
- 为什么重要：影响结论的口径
- 建议处理：补充数据来源说明
### 2、
- 原文位置：一二三四
- 原文位置：一二三四
- 建议处理：——
## Other
### not an item of its own section
## 可继续研究的新观点
本稿暂不足以形成可靠的新观点。
"""


def test_report_lists(spark):
    good = FULL.replace("请勿在本周公开。", "").replace(FULL[FULL.index("### 2、"):FULL.index("## 可继续")], "")
    many = good.replace("### 1. 口径", "\n".join(f"### {i}. 口径\n- 原文位置：第三段落\n- 为什么重要：影响结论\n- 建议处理：补充说明" for i in range(2, 10)) + "\n### 1. 口径")
    both = good.replace("本稿暂不足", "### 观点一二\n本稿暂不足").replace("可以发布。", "Well, 可以发布。 暂缓发布")
    df = spark.createDataFrame([(1, FULL), (2, good), (3, many), (4, both), (5, ""), (6, None)], "id int, text string")
    got = {}
    for r in report.list_issues(df, "id").collect():
        got.setdefault(r.id, set()).add(r.code)
    # The unnamed section belongs to the list before it, and so does its item.
    item = {"PRIORITY_ITEM_LOCATION_MISSING", "PRIORITY_ITEM_REASON_MISSING", "PRIORITY_ITEM_ACTION_MISSING"}
    assert got[1] == {"READY_CONCLUSION_CONTRADICTED", "PRIORITY_ITEM_HEADING_MISSING", *item}
    assert 2 not in got and got[3] == {"TOO_MANY_PRIORITY_ITEMS"} and 6 not in got
    view = {f"NEW_VIEWPOINT_{k}_LABEL_MISSING" for k in ("ACTOR", "DECISION", "MECHANISM", "BOUNDARY", "FALSIFICATION")}
    assert got[4] == {"MULTIPLE_PUBLICATION_STATUSES", "PUBLICATION_STATUS_NOT_LEADING", "NEW_VIEWPOINT_ZERO_MARKER_CONFLICT", *view}
    assert got[5] == {"MISSING_CHINESE_PUBLICATION_STATUS", "PRIORITY_ISSUE_ZERO_MARKER_MISSING", "NEW_VIEWPOINT_ZERO_MARKER_MISSING"}


def test_links_and_orders(spark):
    rows_ = spark.createDataFrame([(1, "a", ["S1"]), (2, "a", ["S2"]), (3, "z", ["S1", "S9"]), (4, "a", None), (5, "a", ["S1", "S2"])], "k int, e string, labels array<string>")
    seen = spark.createDataFrame([("S1", "a"), ("S1", "a"), ("S2", "b"), (None, "c")], "snapshot_id string, e string")
    assert rows(keys.snapshot_links(rows_, seen, "k", "e", "labels")) == {
        (2, "DISCOVERY_LINK_MISMATCH"), (3, "NOT_IN_DISCOVERY"), (3, "SNAPSHOT_LINK_MISSING"), (4, "SNAPSHOT_LINK_MISSING"),
    }
    o = spark.createDataFrame([(7,), (3,), (2_000_000,), (1_000_000,)], "n long")
    assert rows(keys.ordinals(o, "n", span=5)) == {(3, 1), (7, 2), (1_000_000, 3), (2_000_000, 4)}
    t = spark.createDataFrame([(1, 1, 2, 3), (2, 2, 2, 3), (3, 5, None, 4), (4, None, 3, 1), (5, None, None, None)], "k int, a int, b int, c int")
    assert rows(t.select("k", rules.first_disorder({x: F.col(x) for x in "abc"}))) == {(1, None), (2, "a>b"), (3, "a>c"), (4, "b>c"), (5, None)}
    e = spark.createDataFrame([("READ_ERROR;X-1",), ("no such file /home/jo",), (None,)], "m string")
    assert [r[0] for r in e.select(rules.safe_error(F.col("m"), "FAILED")).collect()] == ["READ_ERROR;X-1", "FAILED", "FAILED"]
    lists = spark.createDataFrame([(["a", "b"],), (["b", "a"],), (["a", "a"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in lists.select(keys.list_order(F.col("l"))).collect()] == [None, "UNSORTED", "REPEATED", None, None]


def test_appended_history(spark):
    old = spark.createDataFrame([("a", "v1", 1, None), ("a", "v2", 2, "v1"), ("b", "w1", 1, None), ("b", "w2", 2, None)], "art string, source_version_id string, n int, supersedes string")
    new = spark.createDataFrame([("a", "v4", 6), ("a", "v3", 5), ("a", "v3", 9), ("a", "v1", 7), ("b", "w3", 3), ("c", "x1", 1), ("c", "v2", 2), (None, "y", 1)], "art string, source_version_id string, n int")
    got = corpus_build.append_versions(old, new, "art", ["n"])
    added = {("a", "v3", 5, "v2", None), ("a", "v4", 6, "v3", None), ("b", "w3", 3, None, "HISTORY_WITHOUT_UNIQUE_TIP"), ("c", "x1", 1, None, None), ("c", "v2", 2, None, "VERSION_OF_ANOTHER_ENTITY")}
    assert rows(got) == {(*r, None) for r in rows(old)} | added
    again = corpus_build.append_versions(got.filter("problem is null").drop("problem"), new.filter("art = 'a'"), "art", ["n"])
    assert again.count() == got.filter("problem is null").count()


def test_unified_diff(spark):
    from tracelark.operators.compare import unified_diff

    df = spark.createDataFrame([(1, "a\nb\n", "a\n\nc"), (2, "same", "same"), (3, None, "x")], "i int, before string, after string")
    got = {r.i: r.lines for r in unified_diff(df, "i").collect()}
    assert got == {1: ["--- before", "+++ after", "@@ -1,2 +1,2 @@", " a", "-b", "+c"], 2: [], 3: ["--- before", "+++ after", "@@ -0,0 +1 @@", "+x"]}


def test_budgeted_manifest(spark):
    from tracelark.operators import budget

    df = spark.createDataFrame([("r", "f", 1, "aa"), ("r", "f", 2, "b"), ("r", "f", 3, "c"), ("r", "g", 4, "ddd"), ("s", "f", 5, "e" * 50)], "run string, fam string, n int, item string")
    r = budget.ranked(df, "run", "fam", [F.col("n")], 2, 3)
    assert rows(r.select("run", "n", "rank")) == {("r", 1, 1), ("r", 2, 2), ("r", 4, 3), ("s", 5, 1)}
    # [aa,b] has 6 characters, [aa,b,ddd] has 10; a run whose first item does not fit has no manifest.
    assert rows(budget.within(r, "run", "item", 9).select("n")) == {(1,), (2,)}
    assert rows(budget.within(r, "run", "item", 10).select("n")) == {(1,), (2,), (4,)}
    m = budget.manifests(budget.within(r, "run", "item", 10), "run", "fam", "item").first()
    assert (m.n_items, m.n_families, m.n_chars) == (3, 2, 10) and m.manifest_id.startswith("PM-")
