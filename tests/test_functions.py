"""Text, Unicode, hash, URL and number functions on golden values."""

import decimal
import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracelark.functions import hashing, numbers, text, unicode, urls

D = decimal.Decimal


def ev(spark, values, fn, kind="string"):
    """Values of a column function over one column, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


SAMPLES = ["", " a ", "　ＡＢ１　", "é", "é", "ﬁ", "①", "straße", "İ", "x​y", "中文", "\x1c a\x85", None]


def test_nfkc_and_strip(spark):
    assert ev(spark, SAMPLES, unicode.nfkc) == [s and unicodedata.normalize("NFKC", s) if s is not None else None for s in SAMPLES]
    assert ev(spark, SAMPLES, unicode.strip_white) == [s.strip() if s is not None else None for s in SAMPLES]
    assert ev(spark, SAMPLES, text.scalar_form) == [unicodedata.normalize("NFKC", s).strip().casefold() if s is not None else None for s in SAMPLES]
    assert ev(spark, [" ", "", None, "L３-1 "], unicode.same_id) == [None, None, None, "L3-1"]


def test_body_and_document_forms(spark):
    bodies = ["\r\n a\rb \n\n", " " * 50_000 + "x" + " " * 50_000, "", None, "é\r\n"]
    norm = lambda b: b.replace("\r\n", "\n").replace("\r", "\n").strip()
    assert ev(spark, bodies, text.body_form) == [norm(b) if b is not None else None for b in bodies]
    assert ev(spark, bodies, hashing.body_sha256) == [hashlib.sha256(norm(b).encode()).hexdigest() if b is not None else None for b in bodies]
    assert ev(spark, bodies, text.document_form) == [unicodedata.normalize("NFC", norm(b)) + "\n" if b is not None else None for b in bodies]
    assert ev(spark, ["a\t\xa0 b \n \n\n\n c"], text.review_form) == ["a b\n\nc"]


def test_tokens(spark):
    got = ev(spark, ["A-b c_1 中文 中文字 中文", "", "!!", None], text.tokens)
    assert got == [["a-b", "c_1", "中文", "中文字", "文字"], [], [], None]


def test_ids(spark):
    df = spark.createDataFrame([(" WeChat ", "acct－1", "n1")], "p string, a string, n string")
    got = df.select(hashing.stable_article_id(F.col("p"), F.col("a"), F.col("n"))).first()[0]
    assert got == "art_" + hashlib.sha256("wechat\x1facct-1\x1fn1".encode()).hexdigest()[:24]


def test_canonical_json(spark):
    docs = ['{"b": 1, "a": {"d": null, "c": "é"}}', '{"a": 1, "a": 2}', "nope", '{"x": [true, "q\\n"]}']
    exact = [json.dumps(json.loads(d), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if d != "nope" else None for d in docs]
    assert ev(spark, docs, hashing.canonical_json) == [exact[0], None, None, exact[3]]
    assert ev(spark, [*docs, '{"f": 1.0}'], hashing.canonical_json_exact) == [*exact, '{"f":1.0}']
    a, b = ev(spark, ['{"h": "old", "k": "v"}', '{"k": "v", "h": "new"}'], lambda c: hashing.self_hash(c, "h"))
    assert a == b


def test_json_walk(spark):
    docs = ['{"a": {"k\\"x": [1, {"b:": "a:\\"c\\":"}]}, "p": "C:\\\\Users"}', '{"k": "https://x", ",": ":"}', '{"n": null, "e": "\\\\"}', None]
    canon = [hashing._dump(d) if d else None for d in docs]
    assert ev(spark, canon, text.json_keys) == [["a", 'k"x', "b:", "p"], [",", "k"], ["e", "n"], None]
    assert ev(spark, canon, text.holds_local_path) == [True, True, False, None]
    assert text.query_terms("Office-A 空置率 空置 office-a") == ev(spark, ["Office-A 空置率 空置 office-a"], text.tokens)[0]


def test_numbers_in_text(spark):
    lines = ["up 12.5％ now", "112.5", "12.5", "12.50", "a12.5", "12.5%", None]
    assert ev(spark, lines, lambda c: text.has_number(c, "12.5%")) == [True, False, False, False, False, True, None]
    assert ev(spark, lines, lambda c: text.has_number(c, "12.5")) == [False, False, True, False, False, False, None]


def test_negation_and_substance(spark):
    got = ev(spark, ["这里不存在风险。", "这里存在风险", "不存在风险，但存在风险", "别的"], lambda c: text.unnegated(c, "存在风险"))
    assert got == [False, True, True, False]
    assert ev(spark, ["不ab存在风险c存在风险", "不是，存在风险", None, "无需 存在风险"], lambda c: text.unnegated(c, "存在风险")) == [False, True, False, False]
    assert ev(spark, ["a b c d", "- - - -", "ab", None], lambda c: text.substantive(c, 4)) == [True, False, False, False]


def test_leaks(spark):
    lines = [
        r"see C:\Users\jo\x", "mail jo@firm.cn", "mail jo@example.com", "call 13912345678", "call 139123456789", "https://chatgpt.com/share/1",
        "https://a.example/x?token=1", "https://a.invalid/x?token=1", "file wxid_ab", "fine", None,
    ]
    want = [["WINDOWS_USER_PATH"], ["EMAIL_ADDRESS"], [], ["MOBILE_NUMBER"], [], ["PRIVATE_OR_TOKENIZED_URL"], ["PRIVATE_OR_TOKENIZED_URL"], [], ["MESSAGE_EXPORT_MARKER"], []]
    assert ev(spark, lines, text.line_leaks)[:-1] == want
    assert ev(spark, ["=1", " \t+x", "a=1", "-", None, ""], text.formula_cell) == [True, True, False, True, False, False]


def test_urls(spark):
    good = ["https://a.b/c?d#e", "http://127.0.0.1:80/", "https://münchen.de", "http://[::1]/"]
    bad = ["ftp://a.b", "https://u:p@a.b", "https://a b.c", "https://a.b:99999", "https://nolabel", "https://a.b/%zz", "https://-a.b", None, ""]
    assert ev(spark, good + bad, urls.web_url) == [True] * len(good) + [False] * len(bad)
    found = ["https://www.google.com/search?q=x", "https://google.de/url?u=1", "https://x.org/search?query=1", "https://bing.com/ck/a", "https://search.x.org/", "https://www.baidu.com/%73?wd=1"]
    pages = ["https://google.com/maps", "https://x.org/search", "https://x.org/?q=1", "not a url"]
    assert ev(spark, found + pages, urls.search_result) == [True] * len(found) + [False] * len(pages)
    assert ev(spark, ["a/b.txt", "../a", "/a", "a\\b", "a/../b", "c:/x"], urls.safe_relative_path) == [True, False, False, False, False, False]


def test_decimal_evaluator():
    ops = {"a": D("0.1"), "b": D(3)}
    assert numbers.evaluate("a * b + 1", ops) == D("1.3")
    assert numbers.evaluate("round(a / b, 4) ** 2", ops) == D("0.00110889") or numbers.evaluate("round(a / b, 4) ** 2", ops) == D("0.0333") ** 2
    for bad in ("__import__('os')", "a.b", "1.5 + a", "a / 0", "c + 1", "a ** a", "x" * 501, "a if b else 1", "True + 1"):
        with pytest.raises(ValueError):
            numbers.evaluate(bad, ops)
    assert numbers.evaluate(" b % 2 ", ops) == 1 and numbers.evaluate("-b % 2", ops) == -1 and numbers.evaluate("round(a * 25)", ops) == 2
    assert numbers.evaluate("b ** 100 ** 1 * 10 ** 100 ** 1", ops) > D(10) ** 147
    big = numbers.evaluate("x ** 100", {"x": D("1e9999")})
    assert big.adjusted() == 999_900  # results may leave the range of operands
    for bad in ("round(a, 29)", "b ** 101", "b % 0", " ", "1" * 257):
        with pytest.raises(ValueError):
            numbers.evaluate(bad, ops)
    assert numbers.influences("a * b", ops, "a", D("0.3"))
    assert not numbers.influences("a * 0 + b", ops, "a", D(3))
    assert numbers.influences("abs(a)", {"a": D(1)}, "a", D(1))
    # Moving b only ever leads to no value or to the same one: that is no influence.
    assert not numbers.influences("1 ** b", {"b": D(3)}, "b", D(1))
    assert not numbers.influences("0 % b", {"b": D(1)}, "b", D(0))
    assert numbers.parse(" 12.5% ") == (D("12.5"), True) and numbers.parse("1,000") is None and numbers.parse("12.5 %") is None
    assert numbers.parse(".5") == (D("0.5"), False) and numbers.parse("5.") == (D(5), False) and numbers.parse("1e10001") is None and numbers.parse("9" * 257) is None


def test_calculated_column(spark):
    df = spark.createDataFrame([("a * 2", {"a": "1e30"}), ("a +", {"a": "1"}), ("a * 0", {"a": "5"}), (None, None), ("a / 3", {"a": "1"}), ("a ** 100", {"a": "1e50"})], "e string, o map<string,string>")
    got = [tuple(r.c) if r.c is not None else None for r in df.select(numbers.calculated(F.col("e"), F.col("o")).alias("c")).collect()]
    assert got[0] == ("2" + "0" * 30, []) and got[1] == (None, None) and got[2] == ("0", ["a"]) and got[3] == (None, None)
    assert got[4] == ("0." + "3" * 50, []) and got[5] == ("1E+5000", [])
