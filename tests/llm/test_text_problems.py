"""Repeated lines, look groups and hidden copies against brute force, and their defined cases."""

import random

from pyspark.sql import functions as F

from tests.llm import brute
from tests.plans import no_broadcasts, plain_sides
from tracelark.llm import collapse, forms, lines

VALUES = "field_name string, scope string, line_no bigint, value string"


def found_lines(spark, docs, least=3):
    df = spark.createDataFrame([(*d, "junk", 1) for d in docs], "doc_id bigint, source string, text string, h1 string, bucket int")
    return {tuple(r) for r in lines.repeated_lines(spark, df, least).collect()}


def test_repeated_lines_random(spark):
    rnd = random.Random(3)
    pool = ["Read more 12", "READ MORE 7!", "ｒead　more", "Шаринг: жми", "--- 1 ---", "", "12345", "Straße", "strasse", "re­ad more", "unique {}"]
    docs = []
    for i in range(400):
        n = rnd.randrange(6)
        text = "\n".join(rnd.choice(pool).replace("{}", f"x{'y' * i}") for _ in range(n))
        docs.append((i * 40_000, rnd.choice(["a", "a", "b", f"s{i % 90}", None]), rnd.choice([text] * 9 + [None])))
    assert found_lines(spark, docs) == brute.repeated_lines(docs, 3)


def test_repeated_lines_defined_cases(spark):
    assert found_lines(spark, []) == set()
    same = [(1, "a", "x\nx\nx"), (2, "a", "x")]
    assert found_lines(spark, same) == set()  # three occurrences, two documents
    assert found_lines(spark, [*same, (3, "a", "X 1\n\ny")]) == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    long = "z" * 300_000
    assert found_lines(spark, [(i, "a", long + "\nb\n") for i in range(3)]) == {(i, p) for i in range(3) for p in (0, 1)}


def test_containers_dense_and_sparse(spark):
    n = 40_000
    docs = spark.range(n).selectExpr("id * 3 as doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source", "concat('Line ', id, if(id % 2 = 0, '\nMenu', '\nother'), char(10), 'x', id % 5) as text")
    numbers = lines.document_numbers(docs.unionByName(docs.limit(50)), span=1000)
    got = numbers.groupBy("source_hash").agg(F.count("*").alias("n"), F.min("number").alias("a"), F.max("number").alias("b"), F.count_distinct("number").alias("d")).collect()
    assert all((r.a, r.b, r.d) == (0, r.n - 1, r.n) for r in got) and sum(r.n for r in got) == n
    found = lines.repeated_lines(spark, docs, 3000).persist()
    # "line" and "x" in all documents of a source count, "menu" and "other" in half of them: only those of the hot source do.
    sizes = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    got = {(r.source, r.line_pos): r["count"] for r in found.join(docs, "doc_id").groupBy("source", "line_pos").count().collect()}
    assert got == {(x, p): k for x, k in sizes.items() for p in ((0, 1, 2) if x == "hot" else (0, 2))}
    occ = lines.line_occurrences(docs).withColumn("bucket", F.lit(0)).withColumn("low", (F.col("doc_id") / 3).cast("smallint")).filter("doc_id < 90000 and source_hash = xxhash64('hot')")
    maps = lines.united(lines.variant_bitmaps(occ)).collect()
    assert {(r.n, r.lows is None, r.bits is None) for r in maps} == {(10_000, True, False), (5000, True, False)}
    few = lines.united(lines.variant_bitmaps(occ.filter("doc_id < 3000"))).collect()
    assert {(r.n, r.lows is None, r.bits is None) for r in few} == {(334, False, True), (167, False, True)}
    bits = spark.createDataFrame([(i,) for i in (0, 7, 8, 31, 4095, 32767)], "low smallint")
    one = bits.agg(F.bitmap_construct_agg("low").alias("bits")).withColumn("lows", F.lit(None).cast("array<smallint>"))
    tested = spark.range(32768).select(F.col("id").cast("smallint").alias("low")).crossJoin(one).filter(lines.has_bit(F.col("low"), F.col("lows"), F.col("bits")))
    assert sorted(r.low for r in tested.collect()) == [0, 7, 8, 31, 4095, 32767]


def test_without_lines(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc"), (2, "a"), (3, None), (4, "")], "doc_id bigint, text string")
    found = spark.createDataFrame([(1, 0), (1, 3), (2, 0)], "doc_id bigint, line_pos int")
    got = {r.doc_id: r.text_clean for r in lines.without_lines(docs, found).collect()}
    assert got == {1: "b\n", 2: "", 3: None, 4: ""}


def disguised(rnd, s):
    out = []
    for c in s:
        k = rnd.randrange(8)
        wide = chr(ord(c) + 0xFEE0) if 33 <= ord(c) < 127 else "　" if c == " " else c
        alike = {"a": "а", "e": "е", "o": "ο", "A": "Α", "p": "р"}.get(c, c)
        out.append([c, c, c, c, wide, alike, c + "​", "  " if c == " " else c][k])
    return "".join(out)


def test_look_groups_random(spark):
    rnd = random.Random(4)
    base = ["Paper one", "paper one", "café Op", "café Op", "x", "", "  ", "Привет, мир"]
    rows = [("f", rnd.choice(["p", "q"]), i, rnd.choice([None, *[disguised(rnd, rnd.choice(base))] * 9])) for i in range(300)]
    got = {(r.first_line_no, r.line_no) for r in forms.look_groups(spark, spark.createDataFrame(rows, VALUES)).collect()}
    assert got == brute.groups([(i, s, v) for _, s, i, v in rows], brute.look, True)


def test_look_groups_defined_cases(spark):
    df = lambda rows: spark.createDataFrame(rows, VALUES)
    assert forms.look_groups(spark, df([])).count() == 0
    assert forms.look_groups(spark, df([("f", "", 1, "a"), ("f", "", 2, "a"), ("g", "", 3, "ａ")])).count() == 0
    hot = [("f", "", i, "same") for i in range(2000)] + [("f", "", 5000, "sаme")]
    assert forms.look_groups(spark, df(hot)).count() == 2001
    out = forms.consistent(df([("f", "", 1, " ＡＢ​ｃ\n\td "), ("f", "", 2, None), ("f", "", 3, "Straße")]), fold=True)
    assert {r.line_no: r.form for r in out.collect()} == {1: "abc d", 2: None, 3: "strasse"}


def members(spark, rows):
    df = spark.createDataFrame(rows, VALUES)
    return {(r.first_line_no, r.line_no) for r in collapse.copy_members(spark, df).collect()}


def test_copies_random(spark):
    rnd = random.Random(6)
    base = ["One text, here.", "one TEXT here", "One-text\nhere", "Other", "ß", "SS", "...", "", "Ｏne text here"]
    rows = [("f", "", i, rnd.choice([None, *base])) for i in range(200)]
    assert members(spark, rows) == brute.groups([(i, None, v) for _, _, i, v in rows], brute.same_text, False)
    df = spark.createDataFrame(rows, VALUES)
    counts = {r.first_line_no: r.copies for r in collapse.copies(spark, df).collect()}
    assert sum(counts.values()) == sum(v is not None and bool(brute.same_text(v)) for *_, v in rows)
    assert members(spark, []) == set()


def test_hot_values_meet_plain_exchanges(spark):
    n = 3000
    values = spark.range(n).selectExpr("'f' as field_name", "'' as scope", "id as line_no", "case when id % 3 > 0 then concat('v', id) when id % 2 = 0 then 'Hot value' else 'Hot\u00a0value' end as value")
    docs = values.selectExpr("line_no as doc_id", "'s' as source", "value as text")
    with no_broadcasts(spark):
        g = forms.look_groups(spark, values)
        assert g.count() == n // 3 and plain_sides(g) == 2
        m = collapse.copy_members(spark, values)
        assert m.count() == n // 3 and plain_sides(m) == 2
        found = lines.repeated_lines(spark, docs)
        assert found.count() == n  # all lines are the same once digits are left out, or the hot one


RUSSIAN = ["Материал номер три, вот так", "Читайте также: новости", "Ёлка и йод, КВН", "Vine and nine", "νews Νews υp Υp", "Straße МОСТ"]


def cased(rnd, s):
    return rnd.choice([s, s.upper(), s.lower(), s.swapcase(), s.title()]) if not set(s) & set("νΝυΥ") else s


def test_copies_in_other_case(spark):
    rnd = random.Random(8)
    rows = [("f", "", i, disguised(rnd, cased(rnd, rnd.choice(RUSSIAN)))) for i in range(300)]
    assert members(spark, rows) == brute.groups([(i, None, v) for _, _, i, v in rows], brute.case_text, False)
    assert members(spark, [("f", "", i, v) for i, v in enumerate(["МАТЕРИАЛ", "материал", "мАТЕРИАЛ", "Mатериал"])]) == {(0, i) for i in range(4)}
    assert members(spark, [("f", "", 1, "vine"), ("f", "", 2, "nine"), ("f", "", 3, "Νine"), ("f", "", 4, "νine")]) == {(1, 1), (1, 4), (2, 2), (2, 3)}


def test_repeated_lines_in_other_case(spark):
    docs = [(1, "a", "Материал 1"), (2, "a", "МАТЕРИАЛ 2!"), (3, "a", "мАТЕРИАЛ"), (4, "b", "материал")]
    assert found_lines(spark, docs) == {(1, 0), (2, 0), (3, 0)}


def test_map_copies(spark):
    maps = [
        (1, {"clean_text": "A b", "lead": "x"}), (2, {"lead": "X!", "clean_text": "a B"}), (3, {"clean_text": "ab"}), (4, {"clean_text": "a", "lead": "bx"}),
        (5, {"clean_text": "ab", "lead": None}), (6, {"clean_text": "ab", "lead": ""}), (7, None), (8, {"clean_text": None}), (9, {"clean_text": " . ", "lead": "x"}),
        (10, {"clean_text": "A-B"}),
    ]
    df = spark.createDataFrame(maps, "line_no bigint, content map<string,string>")
    v = df.filter(collapse.has_text(F.col("content")["clean_text"])).select(F.lit("c").alias("field_name"), "line_no", collapse.map_form(F.col("content")).alias("value"))
    got = {(r.first_line_no, r.line_no) for r in collapse.copy_members(spark, v).collect()}
    assert got == brute.groups([(i, None, m) for i, m in maps], brute.map_key, False) == {(1, 1), (1, 2), (3, 3), (3, 10)}
