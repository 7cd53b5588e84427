"""Scans, sinks and incremental ingest over generated files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracelark.sources import filetree, jsonl, office, sinks
from tracelark.streaming.incremental import VersionedTable, ingest


def test_jsonl_scans(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_bytes("﻿{\"id\": \"x\", \"n\": 1}\r\n\n{\"id\": \"y\", \"n\": \"bad\"}\n[1]\n{oops\n{\"id\": \"z\", \"id\": \"w\"}\n".encode())
    (tmp_path / "d" / "b.txt").write_text('{"id": "not read"}\n')
    records, problems = jsonl.read_jsonl(spark, str(tmp_path / "d"), "id string, n int", strict=False)
    assert {(r.line_no, r.record.id) for r in records.collect()} == {(1, "x"), (3, "y")}
    assert {(r.line_no, r.problem) for r in problems.collect()} == {(4, "RECORD_NOT_OBJECT"), (5, "INVALID_JSON"), (6, "DUPLICATE_KEY")}
    with pytest.raises(Exception, match="RECORD_NOT_OBJECT|INVALID_JSON|DUPLICATE_KEY"):
        jsonl.read_jsonl(spark, str(tmp_path / "d"), "id string")[0].collect()
    assert jsonl.read_optional(spark, str(tmp_path / "none"), "id string").count() == 0
    (tmp_path / "o.json").write_text('{"k": {"v": 1}}')
    assert jsonl.read_object(spark, str(tmp_path / "o.json"), "CARD").first().problem is None
    (tmp_path / "p.json").write_text("[]")
    assert jsonl.read_object(spark, str(tmp_path / "p.json"), "CARD").first().problem == "CARD_NOT_OBJECT"


def test_lines_of_many_splits(spark, tmp_path):
    d = tmp_path / "big"
    d.mkdir()
    for name in ("a.jsonl", "b.jsonl"):
        (d / name).write_bytes(b"\xef\xbb\xbf" + b"".join(b'{"i": %d, "pad": "%s"}\r\n' % (i, b"x" * (i % 50)) + (b"\n" if i % 5 == 0 else b"") for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {(r.file[-7:], r.line_no): int(r.raw.split(":")[1].split(",")[0]) for r in jsonl.read_lines(spark, str(d)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    place = lambda i: i + 1 + (i + 4) // 5
    assert got == {(n, place(i)): i for n in ("a.jsonl", "b.jsonl") for i in range(3000)}


def test_keyed_records(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n')
    (tmp_path / "twice.jsonl").write_text('{"id": "a"}\n\n{"id": " a "}\n')
    (tmp_path / "none.jsonl").write_text('{"id": "a"}\n{"x": 1}\n')
    assert {r.record.id for r in jsonl.read_keyed(spark, str(tmp_path / "ok.jsonl"), "id string", "id").collect()} == {"a", "b"}
    for name, code in (("twice", "3 KEY_REPEATED"), ("none", "2 KEY_MISSING")):
        with pytest.raises(Exception, match=code):
            jsonl.read_keyed(spark, str(tmp_path / f"{name}.jsonl"), "id string", "id").collect()


def test_bound_inputs(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    h = hashlib.sha256(b"one").hexdigest()
    declared = spark.createDataFrame([("A", h.upper()), ("B", h), ("C", h), ("D", h), ("D", h)], "input_id string, sha256 string")
    given = {"A": str(tmp_path / "a.txt"), "B": str(tmp_path / "b.txt"), "C": str(tmp_path / "none"), "E": str(tmp_path / "a.txt"), "../x": str(tmp_path / "b.txt")}
    got = {r.input_id: r.problem for r in filetree.bind_inputs(spark, given, declared).collect()}
    assert got == {"A": None, "B": "INPUT_HASH_MISMATCH", "C": "INPUT_NOT_SUPPLIED", "D": "INPUT_DECLARED_TWICE", "E": "INPUT_NOT_DECLARED", "../x": "INPUT_ID_INVALID"}
    assert filetree.bind_inputs(spark, {}, declared.filter("input_id = 'A'")).first().problem == "INPUT_NOT_SUPPLIED"


def test_leak_scan(spark, tmp_path):
    from tracelark.sources import leakscan

    d = tmp_path / "pub"
    (d / "sub").mkdir(parents=True)
    (d / "__pycache__").mkdir()
    (d / "ok.md").write_text("fine\n")
    (d / "sub" / "bad.txt").write_text("x\nmail jo@firm.cn and jo@firm.cn\ncall 13912345678\n")
    (d / "t.csv").write_text("a,b\n1,=2\n")
    (d / "pic.png").write_bytes(b"\x89PNG")
    (d / "odd.xyz").write_text("?")
    (d / "__pycache__" / "x.txt").write_text("jo@firm.cn")
    (d / "c.docx").write_bytes(b"broken")
    (d / "ln.txt").symlink_to(d / "ok.md")
    rules = [(3, "fine", False)]
    found, end = leakscan.scan(spark, str(d), rules)
    got = [(r.path, r.line, r.code) for r in found.collect()]
    assert got == [
        ("c.docx", None, "OOXML_SCAN_ERROR"), ("c.docx", None, "RAW_BINARY_NOT_ALLOWED"), ("ln.txt", None, "SYMLINK_NOT_ALLOWED"), ("odd.xyz", None, "UNREVIEWED_FILE_TYPE"),
        ("ok.md", None, "PRIVATE_DENYLIST"), ("pic.png", None, "RAW_BINARY_NOT_ALLOWED"), ("sub/bad.txt", 2, "EMAIL_ADDRESS"), ("sub/bad.txt", 3, "MOBILE_NUMBER"), ("t.csv", 2, "CSV_FORMULA_INJECTION"),
    ]
    assert tuple(end.first()) == (True, 1)
    (d / "nul.txt").write_bytes(b"a\0b")
    found, end = leakscan.scan(spark, str(d), rules)
    assert ("nul.txt", "TEXT_SCAN_LIMIT") in {(r.path, r.code) for r in found.collect()} and tuple(end.first()) == (False, 2)


def test_private_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("b", None)], "z string, a string")
    root = tmp_path / "tree"
    root.mkdir()
    with pytest.raises(PermissionError):
        sinks.write_private_jsonl(df, str(root / "out"), str(root))
    at = str(root / "private" / "out")
    sinks.write_private_jsonl(df, at, str(root), ("private",))
    with pytest.raises(FileExistsError):
        sinks.write_private_jsonl(df, at, str(root), ("private",))
    sinks.write_private_jsonl(df.limit(0), at, str(root), ("private",), force=True)
    assert spark.read.text(at).count() == 0


def test_jsonl_sink_is_canonical(spark, tmp_path):
    df = spark.createDataFrame([("b", None)], "z string, a string")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":null,"z":"b"}'
    with pytest.raises(Exception, match="(?i)exists"):
        jsonl.write_jsonl(df, str(tmp_path / "out"))


def test_tree(spark, tmp_path):
    for p in ("l0_raw/a.txt", "l0_raw/deep/b.txt", "other/c.txt", "__pycache__/d.pyc", "e.txt"):
        f = tmp_path / "t" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * 3)
    (tmp_path / "t" / "link.txt").symlink_to(tmp_path / "t" / "e.txt")
    t = filetree.scan_tree(spark, str(tmp_path / "t"))
    assert {(r.path, r.n_bytes, r.is_link) for r in t.collect()} == {
        ("l0_raw/a.txt", 3, False), ("l0_raw/deep/b.txt", 3, False), ("other/c.txt", 3, False), ("e.txt", 3, False), ("link.txt", None, True),
    }
    s = filetree.structure(t.filter("not is_link"), {"l0_raw": "L0"})
    assert {(r.path, r.layer) for r in s.collect()} == {("l0_raw/a.txt", "L0"), ("l0_raw/deep/b.txt", "L0"), ("other/c.txt", None), ("e.txt", None)}
    g = t.filter("not is_link").select(filetree.grouped(F.col("top"), {"l0_raw": "L0"}, "support").alias("g")).groupBy("g").count()
    assert {tuple(r) for r in g.collect()} == {("L0", 2), ("support", 2)}
    assert filetree.scan_tree(spark, str(tmp_path / "none")).first().problem == "ROOT_NOT_DIRECTORY"


def test_texts_cells_denylist(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    (d / "u8.txt").write_bytes("﻿é".encode())
    (d / "u16.txt").write_bytes("中".encode("utf-16"))
    (d / "gb.txt").write_bytes("中文".encode("gb18030"))
    (d / "bin.txt").write_bytes(b"a\0b")
    (d / "big.txt").write_bytes(b"a" * 60)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in filetree.read_texts(spark, str(d), max_bytes=50).collect()}
    assert got == {"u8.txt": ("é", None), "u16.txt": ("中", None), "gb.txt": ("中文", None), "bin.txt": (None, "BINARY"), "big.txt": (None, "TEXT_SCAN_LIMIT")}
    (tmp_path / "c.csv").write_text('a,"=1\n2"\n,-x\n')
    cells = {(r.row_no, r.column_no, r.cell) for r in filetree.read_cells(spark, str(tmp_path / "c.csv")).collect()}
    assert cells == {(1, 1, "a"), (1, 2, "=1\n2"), (2, 2, "-x")}
    (tmp_path / "deny").write_text("# note\nSecret Name\n\nre:ab+c\n")
    rules = filetree.read_denylist(spark, str(tmp_path / "deny"), str(d))
    df = spark.createDataFrame([("a secret NAME",), ("xabbc",), ("ok",)], "t string")
    assert [r.d for r in df.select(filetree.denied(F.col("t"), rules).alias("d")).collect()] == [[2], [4], []]
    (d / "deny").write_text("x")
    with pytest.raises(ValueError):
        filetree.read_denylist(spark, str(d / "deny"), str(d))


def test_cells_of_wide_and_odd_rows(spark, tmp_path):
    d = tmp_path / "cells"
    d.mkdir()
    (d / "wide.csv").write_text(",".join(f"c{i}" for i in range(1, 30_001)) + "\n" + "," * 70 + "=1+1\n")
    (d / "odd.csv").write_bytes("\ufeffé;\"\";\"say \"\"x\"\"\"\r\n\r\n;b\n".encode() + b"\xff;" + b"z" * 200_000)
    (d / "empty.csv").write_bytes(b"")
    got = {(r.row_no, r.column_no, r.cell) for r in filetree.read_cells(spark, str(d / "wide.csv")).collect()}
    assert got == {(1, i, f"c{i}") for i in range(1, 30_001)} | {(2, 71, "=1+1")}
    got = {(r.row_no, r.column_no, r.cell) for r in filetree.read_cells(spark, str(d / "odd.csv"), ";").collect()}
    assert got == {(1, 1, "é"), (1, 2, ""), (1, 3, 'say "x"'), (3, 2, "b"), (4, 1, "\ufffd"), (4, 2, "z" * 200_000)}
    assert {r.file.rsplit("/", 1)[1] for r in filetree.read_cells(spark, str(d)).select("file").distinct().collect()} == {"wide.csv", "odd.csv"}


W = 'xmlns:w="w" xmlns:w15="w15"'


def package(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/").replace("_X_", "."), xml)
    return b.getvalue()


def test_office_documents(spark, tmp_path):
    docx = package(
        word__document_X_xml=f'<w:document {W}><w:body><w:p><w:commentRangeStart w:id="1"/><w:r><w:t>Sel</w:t></w:r><w:commentRangeEnd w:id="1"/><w:r><w:t> rest</w:t></w:r></w:p><w:p/><w:p><w:commentRangeStart w:id="10"/><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p><w:commentRangeEnd w:id="10"/><w:commentRangeStart w:id="7"/><w:commentRangeEnd w:id="7"/><w:r><w:t>tail</w:t></w:r></w:p><w:tbl/></w:body></w:document>',
        word__comments_X_xml=f'<w:comments {W}><w:comment w:id="1" w:author="Jo" w:date="2024-01-02"><w:p w:paraId="P1"><w:r><w:t>Why?</w:t></w:r></w:p><w:p w:paraId="P2"><w:r><w:t> More</w:t></w:r></w:p></w:comment><w:comment w:id="10"><w:p w:paraId="P3"/></w:comment><w:comment w:id="2"><w:p w:paraId="P4"/></w:comment></w:comments>',
        word__commentsExtended_X_xml=f'<w15:commentsEx {W}><w15:commentEx w15:paraId="P1" w15:done="true"/><w15:commentEx w15:paraId="P2" w15:done="0"/><w15:commentEx w15:paraId="P3"/><w15:commentEx w15:paraId="P4" w15:done="0"/></w15:commentsEx>',
        docProps__core_X_xml="<c xmlns:d='d'><d:creator>Jo</d:creator></c>",
    )
    pptx = package(ppt__slides__slide10_X_xml="<s xmlns:a='a'><a:p><a:t>Ten</a:t></a:p></s>", ppt__slides__slide2_X_xml="<s xmlns:a='a'><a:p><a:t>Two</a:t></a:p></s>")
    xlsx = package(
        xl__sharedStrings_X_xml="<sst><si><t>Name</t></si></sst>",
        xl__worksheets__sheet1_X_xml='<w><row><c t="s"><v>0</v></c><c><f>1+1</f><v>2</v></c></row></w>',
    )
    d = tmp_path / "docs"
    d.mkdir()
    for name, content in (("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.docx", b"broken"), ("e.txt", "中文\n\nx".encode("gb18030")), ("f.xyz", b"?"), ("g.pdf", b"%PDF")):
        (d / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: r.document for r in office.read_documents(spark, str(d)).collect()}
    a = got["a.docx"]
    assert (a.text, a.paragraphs, a.tables) == ("Sel rest\na b\ntail", 3, 1)
    # The state is that of a comment's first paragraph; an absent one is unknown. Anchors without a comment come out too.
    assert [tuple(c) for c in a.comments] == [
        ("CMT-001", "1", "Jo", "2024-01-02", "Why? More", "Sel", "Sel rest", True, True),
        ("CMT-002", "2", None, None, "", "", "", False, False),
        ("CMT-003", "7", None, None, None, "", "tail", True, None),
        ("CMT-004", "10", None, None, "", "a b", "a b\ntail", True, None),
    ]
    assert got["b.pptx"].text == "Two\n\nTen"
    assert (got["c.xlsx"].text, got["c.xlsx"].formulas) == ("Name\t2", 1)
    assert got["d.docx"].problem == "READ_ERROR:BadZipFile" and got["f.xyz"].problem == "UNSUPPORTED_TYPE" and got["g.pdf"].problem
    assert (got["e.txt"].text, got["e.txt"].paragraphs) == ("中文\n\nx", 2)
    codes = {(r.path.rsplit("/", 1)[1], r.code) for r in office.package_findings(office.read_documents(spark, str(d))).collect()}
    assert {("a.docx", "OFFICE_COMMENTS_OR_REVIEWERS"), ("a.docx", "OFFICE_PERSONAL_METADATA"), ("d.docx", "OOXML_SCAN_ERROR")} <= codes
    small = office.read_documents(spark, str(d), max_file=5).select("document.problem").distinct().collect()
    assert {r[0] for r in small} >= {"FILE_LIMIT"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    at = str(tmp_path / "t")
    assert sinks.write_once(df, at) == "written"
    assert sinks.write_once(df.orderBy(F.desc("i")), at) == "identical"
    with pytest.raises(FileExistsError):
        sinks.write_once(df.limit(1), at)
    sinks.write_object(df.limit(1), str(tmp_path / "o" / "x.json"))
    assert json.loads((tmp_path / "o" / "x.json").read_text()) == {"i": 1, "s": "a"}
    with pytest.raises(ValueError):
        sinks.write_object(df, str(tmp_path / "y.json"))
    root = str(tmp_path)
    with pytest.raises(PermissionError):
        sinks.private_path(f"{root}/out.json", root)
    assert sinks.private_path(f"{root}/private/out.json", root, ("private",)) and sinks.private_path("/elsewhere/x", root)
    assert sinks.without_content(df, ("i",)).columns == ["i"]


def test_incremental_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    table = VersionedTable(spark, str(tmp_path / "table"), "id string, art string, labels array<string>")
    prepare = lambda s: s.select("id", "art", F.array("label").alias("labels"))
    run = lambda: ingest(spark, str(src), "id string, art string, label string", table, str(tmp_path / "cp"), prepare, "id", "labels")
    (src / "1.json").write_text('{"id": "v1", "art": "a", "label": "S1"}\n')
    assert {(r.id, r.art, tuple(r.labels)) for r in run().collect()} == {("v1", "a", ("S1",))}
    (src / "2.json").write_text('{"id": "v1", "art": "a", "label": "S2"}\n{"id": "v2", "art": "b", "label": "S2"}\n')
    want = {("v1", "a", ("S1", "S2")), ("v2", "b", ("S2",))}
    assert {(r.id, r.art, tuple(r.labels)) for r in run().collect()} == want
    assert {(r.id, r.art, tuple(r.labels)) for r in run().collect()} == want
