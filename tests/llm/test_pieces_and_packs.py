"""Splitting, packing, mixing and spam pages: invariants, round trips, brute force."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import one_page
from tracelark.llm import mixing, packing, pages, spam, split, tokens


def checked(text, limit, overlap):
    ends = split.cut_points(text, limit, overlap)
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    begin = 0
    for k, end in enumerate(ends):
        first = max(0, begin - overlap) if k else 0
        assert end - first <= limit
        assert k == 0 or begin - first == overlap
        begin = end
    return ends


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Long sentence ends. ", "。", "中文字", "\n", "\n\n", "x" * 37, "é", "😀"]), max_size=120), st.integers(30, 90), st.integers(0, 25))
def test_cut_points_hold(parts, limit, overlap):
    checked("".join(parts), limit, overlap)


def test_cuts_prefer_strong_boundaries():
    text = "\n\n".join(["One. Two three four. Five." * 4] * 6)
    ends = checked(text, 250, 20)
    assert all(text[e - 2 : e] == "\n\n" for e in ends[:-1])
    assert split.cut_points("short", 10, 2) == [5]
    checked("a" * 100_000, 2000, 200)


def test_cuts_in_linear_time():
    import time

    began = time.time()
    for text in ("." * 400_000, "a" + "." * 400_000 + "b", "\n \t" * 100_000, ".)" * 200_000, "。" * 400_000, ", " * 200_000):
        checked(text, 2000, 200)
    assert time.time() - began < 20
    assert checked("Wait... what?! " * 40, 60, 5)[0] % 15 == 0


def test_pieces_round_trip(spark):
    rnd = random.Random(1)
    texts = {i: "".join(rnd.choice(["Ein Satz. ", "词语。", "\n", "wort "]) for _ in range(900)) for i in range(5)}
    rows = [("f", i, t, "x") for i, t in texts.items()] + [("f", 50, None, "x"), ("f", 51, "", "x"), ("f", 52, "s" * 2000, "x"), ("f", 53, "s" * 2001, "x")]
    p = split.pieces(spark.createDataFrame(rows, "field_name string, line_no bigint, value string, piece string")).collect()
    by = defaultdict(list)
    for r in sorted(p, key=lambda r: r.piece_no):
        by[r.line_no].append(r)
    assert set(by) == {i for i, t in texts.items() if len(t) > 2000} | {53}
    for i, ps in by.items():
        whole = ps[0].piece
        for r in ps[1:]:
            assert r.piece[:200] == whole[-200:] and len(r.piece) <= 2000
            whole += r.piece[200:]
        assert whole == texts.get(i, "s" * 2001) and [r.n_pieces for r in ps] == [len(ps)] * len(ps)


def naive_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(capacity)
        room[b] -= s
        out.append(b)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=80))
def test_tournament_tree_is_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    assert packing.first_fit_decreasing(sizes, 50) == naive_first_fit(sizes, 50)


def test_containers(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 5, 99, 100, 101, 250, 1000, None])) for i in range(600)] + [(7, 40), (8, 5030), (8, 5030), (8, 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.containers(df, len(rows), capacity=100, group_docs=100).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    assert Counter(r.doc_id for r in got if r.part_no == 0) == Counter(i for i, _ in rows)
    used = Counter()
    for r in got:
        used[r.container_id] += r.n_tokens
        assert r.part_no == 0 or r.token_start == 100 * r.part_no
    assert max(used.values()) <= 100
    assert all(used[r.container_id] == 100 for r in got if r.container_id.startswith("full"))
    divided = {r.doc_id for r in got if r.part_no > 0}
    assert divided == {8} | {i for i, n in rows if n and n > 100}
    assert packing.containers(df.limit(0), 0).count() == 0


def test_token_counts(spark):
    e = tokens.encoder()
    texts = ["plain text", "中文 text", "", None, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "doc_id", "text").collect()}
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert e.decode(e.encode_ordinary("中文 text")) == "中文 text"


@pytest.mark.parametrize("budget", [None, 500, 20_000, 10**9])
def test_mix(spark, budget):
    rnd = random.Random(8)
    docs = [(i, rnd.choice(["big", "big", "mid", "other", None]), rnd.randrange(1, 40)) for i in range(800)] + [(9000, "tiny", 10), (9001, "big", 0), (9002, "big", None)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 4), ("tiny", 0.1, 3), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(spark, sized, targets, budget)
    rows = mixed.collect()
    share, repeats = {"big": 0.5, "mid": 0.3, "tiny": 0.1}, {"big": 2, "mid": 4, "tiny": 3}
    # Brute force: the same shuffled order, every copy's finish time, sorted and cut at the budget.
    order = {r.doc_id: r.h for r in sized.selectExpr("doc_id", "xxhash64(doc_id, 29) as h").collect()}
    total = {s: sum(n for _, x, n in docs if x == s and n) for s in share}
    queue = []
    for s in share:
        cum = 0
        for d, n in sorted(((d, n) for d, x, n in docs if x == s and n), key=lambda t: (order[t[0]], t[0])):
            cum += n
            queue += [((k * total[s] + cum) / share[s], s, d, k, n) for k in range(repeats[s])]
    cap, used, want = budget if budget is not None else sum(total.values()), 0, []
    for f, s, d, k, n in sorted(queue):
        if used + n > cap:
            break
        used += n
        want.append((d, s, k, n))
    assert [(r.doc_id, r.source, r.copy_no, r.n_tokens) for r in rows] == want
    rep = {r.source: r for r in report.collect()}
    assert set(rep) == {"big", "mid", "tiny", "none"} and rep["none"].used_tokens == 0
    assert sum(r.used_tokens for r in rep.values()) == used
    assert max([r.copy_no for r in rows if r.source == "big"], default=0) < 2


def test_mix_empty(spark):
    sized = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(spark, sized, targets)
    assert mixed.count() == 0 and report.first().used_docs == 0


def simple_pages():
    rnd = random.Random(9)
    nouns, verbs = "report survey tenant forecast draft reviewer sample window market figure".split(), "shows limits supports explains updates questions".split()
    prose = lambda k: " ".join(f"The {rnd.choice(nouns)} of the {rnd.choice(nouns)} {rnd.choice(verbs)} what the {rnd.choice(nouns)} in the {rnd.choice(nouns)} {rnd.choice(verbs)} for a {rnd.choice(nouns)}." for _ in range(k))
    words = lambda k: " ".join(rnd.choice(["cheap desk", "desk space", "buy desk space", "best desk"]) for _ in range(k))
    links = lambda k: "\n".join(f"https://shop{rnd.randrange(99)}.example/tag/{rnd.randrange(9999)}" for _ in range(k))
    good = [prose(rnd.randrange(2, 12)) for _ in range(150)] + [prose(8) + "\n" + links(3) for _ in range(10)]
    bad = [words(60) for _ in range(6)] + [links(12) for _ in range(6)] + [prose(1) + "\n" + words(120) for _ in range(6)]
    return good, bad


def test_spam_pages(spark):
    good, bad = simple_pages()
    rows = [(i, t, "en" if i % 5 else None, "x") for i, t in enumerate(good)] + [(1000 + i, t, "EN", "x") for i, t in enumerate(bad)]
    rows += [(5000, None, "en", "x"), (5001, "", "en", "x"), (5002, "word", None, "x"), (None, "cheap " * 50, "en", "x")]
    got = spam.spam_pages(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, slope string")).collect()
    assert len(got) == len(good) + len(bad) + 2
    flagged = {r.doc_id for r in got if r.is_spam}
    assert {1000 + i for i in range(len(bad))} <= flagged
    assert not flagged & set(range(len(good))) and 5001 not in flagged


def test_rank_frequency_is_least_squares(spark):
    import numpy as np

    curve = {1: 20, 3: 5, 9: 1}
    df = spark.createDataFrame([(1, [(f, m) for f, m in curve.items()]), (2, [(4, 1)])], "doc_id bigint, curve array<struct<f:int,m:int>>")
    got = spam.rank_frequency(df).collect()
    xs, ys, at = [], [], 0
    for f, m in sorted(curve.items(), reverse=True):
        xs += [np.log((at + 1 + at + m) / 2)] * m
        ys += [np.log(f)] * m
        at += m
    slope, icpt = np.polyfit(xs, ys, 1)
    res = np.sqrt(np.mean((np.array(ys) - slope * np.array(xs) - icpt) ** 2))
    assert [r.doc_id for r in got] == [1]
    assert got[0].slope == pytest.approx(slope) and got[0].residual == pytest.approx(res)


def test_languages_are_fitted():
    rnd = random.Random(3)
    vocab = {k: [f"{k}x{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(40)] for k in ("aa", "bb", "cc")}
    df, n = defaultdict(Counter), Counter()
    for _ in range(900):
        k = rnd.choice("aaa bb cc".split())[:2]
        label = k if rnd.random() < 0.9 else rnd.choice(list(vocab))  # some labels are wrong
        n[label] += 1
        for w in {*rnd.sample(vocab[k], 12), *rnd.sample(["shared", "both", "all"], 2)}:
            df[w][label] += 1
    known = spam.Languages(dict(n), {w: dict(c) for w, c in df.items()})
    assert set(known.names) == set(vocab) and vocab["aa"][3] in known.common["aa"] and vocab["aa"][3] not in known.common["bb"]
    of = lambda words, declared, known=known: known.of(pages.Words([" ".join(words)]), [declared])[0]
    for k in vocab:
        assert of([*rnd.sample(vocab[k], 5), "shared", "x"], "cc") == k
    assert of(["nothing"], " BB ") == "bb" and of(["nothing"], "tlh") == known.names[0] and of([], None) == known.names[0]
    none = spam.Languages({}, {})
    assert of(["x"], "en", none) == "en" and of(["x"], None, none) == "" and not none.is_common(pages.Words(["x"]), ["en"]).any()


PARTS = ["word ", "another ", "ein Satz. ", "Ü ", "ﬁ", "x½ ", "１２a ", "中文字", "仮名。", "单", "，", ";", "! ", "?x", "...", "\n", "\n\n", " ", "\t", "-", "a, b, c | d", "https://a.b/c?d=e. ", "#tag ", "# ", "@me's ",
         "[t](u v) ", "[t](u)", "<a href=x>y</a>", "< 3 >", "<img alt='words of it'>", "\u200b", "\xad", "\x01", "𝔘nd ", "😀", "ſ", "İ", "the same the same the same ", "\u2028", "\xa0"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=150), min_size=1, max_size=6))
def test_pages_in_arrays_are_those_one_by_one(parts):
    import numpy as np

    texts = ["".join(p) for p in parts]
    common = frozenset(["the", "word", "中文", "a"])
    cut = [pages.without_links(pages.plain(t)) for t in texts]
    seg = pages.Segments([s for s, _ in cut], [x for _, x in cut])
    w, n = seg.words, len(texts)
    out = np.flatnonzero((seg.k >= 3) & ~seg.is_list)
    share = seg.share(np.isin(w.hash, pages.word_hashes(sorted(common))).astype(float))[out]
    fresh, variety = seg.share(1 / np.maximum(w.count, 1))[out], seg.variety(out)
    off = np.bincount(seg.page, weights=seg.n, minlength=n) - np.bincount(seg.page[out], weights=seg.n[out], minlength=n)
    turns, f, m = pages.curves(w, n)
    for i, t in enumerate(texts):
        one = one_page._segments(one_page._plain(t.replace("\x01", " ")))
        stream = [x for s in one for x in s[2]]
        counts = Counter(stream)
        n_off, rows = one_page._measured(one, stream, common, counts)
        mine = np.flatnonzero(seg.page[out] == i)
        got = [(seg.n[out][j], seg.m[out][j], seg.k[out][j], share[j], variety[j], fresh[j]) for j in mine]
        assert off[i] == n_off and got == [pytest.approx(r) for r in rows] and w.n_words[i] == len(stream)
        assert Counter(dict(zip(f[turns[i] : turns[i + 1]].tolist(), m[turns[i] : turns[i + 1]].tolist()))) == Counter(counts.values())
        assert {w.text[a:b] for a, b, p in zip(w.start, w.end, w.page) if p == i} == set(counts)
    value = np.array([3.0, 1.0, 2.0, 5.0])
    assert pages.middles(np.array([0, 0, 2, 0]), value, 3) == [3.0, None, 2.0]


def test_slices_hold_every_page():
    assert list(pages.slices([])) == [] and list(pages.slices(["", "a"])) == [(0, 2)]
    big = "x" * (pages.SLICE + 1)
    assert list(pages.slices([big, "a", "b", big, ""])) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    seg = pages.Segments(["", "", big], [[], [], []])
    assert seg.words.n_words.tolist() == [0, 0, 1] and seg.n.max() == len(big)


@pytest.fixture(scope="module")
def held_out():
    """Honest and spam pages of forms that set no threshold: other words, other layouts, mixed."""
    rnd = random.Random(77)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    nouns = sorted({"".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 4))) for _ in range(900)})
    function = "the of and to in that is for on with as by at from this which was are it not".split()
    verbs = [v + "s" for v in nouns[:60]]

    def sentence():
        out = []
        for _ in range(rnd.randrange(4, 9)):
            out += rnd.choice([[rnd.choice(function), rnd.choice(nouns)], [rnd.choice(function), rnd.choice(function), rnd.choice(nouns)], [rnd.choice(verbs)]])
        return " ".join(out).capitalize() + "."

    prose = lambda k: " ".join(sentence() for _ in range(k))
    link = lambda: f"https://{rnd.choice(nouns)}.example/{rnd.choice(nouns)}/{rnd.randrange(999)}"
    good = [prose(rnd.randrange(3, 40)) for _ in range(300)]
    good += [prose(10) + "\nSources:\n" + "\n".join(link() for _ in range(3)) for _ in range(30)]
    good += ["Summary\n" + "\n".join("- " + sentence() for _ in range(12)) for _ in range(30)]
    topic = lambda: rnd.sample(nouns, 4)

    def stuffed():
        t = topic()
        return prose(2) + "\n" + " ".join(rnd.choice(["best", "cheap", "buy", "top"]) + " " + rnd.choice(t) for _ in range(rnd.randrange(60, 200)))

    bad = [stuffed() for _ in range(25)]
    bad += [prose(1) + "\n" + "\n".join(f"{rnd.choice(nouns)} {rnd.choice(nouns)}: {link()}" for _ in range(rnd.randrange(15, 40))) for _ in range(25)]
    bad += ["Tags: " + ", ".join(rnd.choice(nouns) + " " + rnd.choice(nouns) for _ in range(rnd.randrange(40, 150))) for _ in range(25)]
    bad += [" ".join("#" + rnd.choice(nouns) for _ in range(60)) for _ in range(10)]
    return [(i, t, "en", "x") for i, t in enumerate(good)], [(10_000 + i, t, "en" if i % 4 else None, "x") for i, t in enumerate(bad)]


def test_precision_and_recall_on_held_out_pages(spark, held_out):
    good, bad = held_out
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, is_spam string")
    found = {r.doc_id for r in spam.spam_pages(spark, df).filter("is_spam").collect()}
    true = {d for d, *_ in bad}
    assert len(found & true) >= 0.9 * len(true) and len(found & true) >= 0.9 * len(found)


def test_each_measure_makes_pages_spam(spark, held_out):
    """Without any one of slope, residual and divergence other pages are spam."""
    rnd = random.Random(21)
    good, bad = held_out
    words = sorted({w for _, t, *_ in good for w in t.lower().replace(".", "").split() if w.isalpha()})
    common = "the of and to in that is for on with as by at from this which".split()

    def cycle(n, n_common, times):
        """The same words again and again, in new order: no window of 40 words repeats much and none is a list."""
        often = rnd.sample(words, n)
        return " ".join(" ".join([*rnd.sample(often, n), *rnd.sample(common, n_common)]) + "." for _ in range(times))

    # Steep curves that are straight, and curves of a usual slope that no line fits.
    pages = [cycle(20, 2, 7), cycle(34, 6, 12), cycle(20, 2, 7), cycle(34, 6, 7), cycle(34, 2, 7), cycle(26, 2, 7)]
    df = spark.createDataFrame(good + bad + [(20_000 + i, t, "en", "x") for i, t in enumerate(pages)], "doc_id bigint, text string, lang string, x string")
    run = lambda *m: {r.doc_id for r in spam.spam_pages(spark, df, m).filter("is_spam").collect()}
    every = run("slope", "residual", "divergence")
    assert run("slope", "divergence") < every and run("residual", "divergence") < every and run("slope", "residual") < every


def test_spam_empty(spark):
    assert spam.spam_pages(spark, spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_spam_by_the_curve_of_the_whole_page(spark):
    rnd = random.Random(10)
    good, bad = simple_pages()
    # Prose whose topic words differ from page to page, so that long pages stay as fresh as prose is.
    fill = ["".join(rnd.choice("bdklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(4000)]
    honest = [" ".join(f"The {rnd.choice(fill)} of the {rnd.choice(fill)} shows what the {rnd.choice(fill)} in the {rnd.choice(fill)} limits for a {rnd.choice(fill)}." for _ in range(rnd.randrange(30, 60))) for _ in range(120)]
    # A block of 60 words, half of them common ones, again and again: no window of 40 words repeats much, none is a list.
    common = "the of shows what in limits for a".split()
    block = [w for x in fill[:52] for w in ([x, rnd.choice(common)] if rnd.random() < 0.3 else [x])]
    stuffed = [" ".join((" ".join(rnd.sample(block, len(block))) + ".") for _ in range(9)) for _ in range(3)]
    docs = [(i, t, "en") for i, t in enumerate(honest)] + [(1000 + i, t, "en") for i, t in enumerate(stuffed)] + [(2000 + i, t, "en") for i, t in enumerate(good)]
    got = {r.doc_id: r for r in spam.spam_pages(spark, spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[1000 + i].divergence < 0.5 and got[1000 + i].is_spam for i in range(3))
    assert not any(r.is_spam for i, r in got.items() if i < 1000)


def test_tags_of_any_length_are_links():
    tag = '<img alt="' + "plain words of a caption " * 40 + '">'
    text = "The tenant moved. " + tag + " < " + "it is less than that, " * 20 + " >"
    s, sizes = pages.without_links(pages.plain(text))
    seg = pages.Segments([s], [sizes])
    got = {seg.words.text[a:b] for a, b in zip(seg.words.start, seg.words.end)}
    assert "caption" not in got and "less" in got
    assert (seg.n - seg.m).sum() >= len(tag)
