"""Keyword-stuffed pages and link lists (problem 10).

Three views of a page against pages of its language at comparable length (words, to a power of two):

* slope and residual of its rank-frequency curve, log frequency over log rank, fitted with windows;
* divergence: the share of its characters in segments (lines, sentences) that depart from prose. A segment
  departs if it is a link, if it is a mere list, if hardly any of its words are common in the language's
  documents, or if the words around it repeat far more than words of prose do. Repetition is measured in
  windows of equal length, so that long and short pages compare.

A page whose divergence passes a half is spam. On a page whose slope or residual is extreme a segment also departs if
its words come back too often on the page as a whole, at whatever distance, and that share decides.

Everything "usual" is a median over all pages of the language and length; no vocabulary is built in. Languages and the
words that tell them apart are fitted from the documents' own labels.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelark.llm import pages as pw
from tracelark.session import Scratch

#: A word is common if it is in this share of its language's documents.
COMMON_DF = 0.1
#: Least share of common words in prose, as a part of the language's median; lower where the words are pairs of characters.
LEAST_COMMON, LEAST_COMMON_PAIRS = 0.3, 0.2
#: Least variety of words in a window, as a part of the language's median.
LEAST_VARIETY = 0.68
#: Least freshness (mean of 1 / count on the page, over words) in prose of a page with an extreme curve, as a part of
#: the median of pages of the language and size.
LEAST_FRESH = 0.5
#: Pages that a length of a language must have for medians of its own words and variety; below it the whole language's serve.
LEAST_PAGES = 100
#: Share of the labelled documents that makes a label a language, so there are at most 200; words that tell one from the others.
LEAST_LANGUAGE, TELLING = 0.005, 40
#: Distance from the median, in deviations, that makes a curve extreme.
EXTREME = 3.5
#: Deviation that curves of a language and length have at least, so that two pages of one length are not far apart.
LEAST_SPREAD = 0.01

class Languages:
    """The languages of a corpus: their common words, and a classifier by the words that tell them apart.

    A word weighs for a language by the logarithm of its share of documents there over its mean share in all languages.
    A page's language is the one whose words in the page weigh most; without any such word it is the declared one, if
    known, else the most frequent one."""

    def __init__(self, n_docs: dict[str, int], df: dict[str, dict[str, int]]):
        """``df``: of each word its number of documents in each language."""
        self.names = sorted(n_docs, key=lambda k: (-n_docs[k], k))
        self.common = {k: frozenset(w for w, n in df.items() if n.get(k, 0) >= COMMON_DF * n_docs[k]) for k in self.names}
        self.weight: dict[str, tuple[float, ...]] = {}
        told: dict[str, list] = {k: [] for k in self.names}
        for w, n in df.items():
            share = [n.get(k, 0) / n_docs[k] for k in self.names]
            mean = sum(share) / len(share)
            weights = tuple(math.log((x + 0.001) / (mean + 0.001)) for x in share)
            for k, x, g in zip(self.names, share, weights):
                if g > 0:
                    told[k].append((x * g, w, weights))
        for k, found in told.items():
            self.weight |= {w: g for _, w, g in sorted(found, reverse=True)[:TELLING]}
        told_words = sorted(self.weight)
        self.telling = pw.word_hashes(told_words)
        order = np.argsort(self.telling)
        self.telling = self.telling[order]
        self.weights = np.array([self.weight[told_words[i]] for i in order]).reshape(len(order), len(self.names))
        self.common_hashes = {k: np.sort(pw.word_hashes(sorted(c))) for k, c in self.common.items()}

    def of(self, w: pw.Words, declared: list) -> list:
        """The language of each page of ``w``."""
        n = len(declared)
        labels = [d if (d := _label(x)) in self.common or not self.names else self.names[0] for x in declared]
        if not len(self.telling) or not len(w.hash):
            return labels
        firsts = w.before < 0
        at = np.minimum(np.searchsorted(self.telling, w.hash[firsts]), len(self.telling) - 1)
        hit = self.telling[at] == w.hash[firsts]
        at, page = at[hit], w.page[firsts][hit]
        score = np.stack([np.bincount(page, weights=self.weights[at, i], minlength=n) for i in range(len(self.names))])
        best, some = score.argmax(axis=0), np.bincount(page, minlength=n) > 0
        return [self.names[b] if s else d for b, s, d in zip(best.tolist(), some.tolist(), labels)]

    def is_common(self, w: pw.Words, langs: list) -> np.ndarray:
        """Which words are common in the language of their page."""
        out = np.zeros(len(w.hash), bool)
        of = np.array([self.names.index(x) if x in self.common else -1 for x in langs], np.int64)[w.page] if len(w.hash) else np.zeros(0, np.int64)
        for i, k in enumerate(self.names):
            mine = np.flatnonzero(of == i)
            if mine.size and len(self.common_hashes[k]):
                at = np.minimum(np.searchsorted(self.common_hashes[k], w.hash[mine]), len(self.common_hashes[k]) - 1)
                out[mine] = self.common_hashes[k][at] == w.hash[mine]
        return out


def _label(declared: str | None) -> str:
    """A declared language in lower case; the codes of undetermined, several and no languages are none (fixed values)."""
    d = (declared or "").strip().lower()
    return "" if d in ("und", "mul", "zxx") else d


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(lang, word, df): in how many documents of a label each word occurs; word '' counts the documents. Without a label
    the label is ''."""

    def run(batches):
        import pyarrow as pa

        df: dict[str, Counter] = {}

        def flush():
            rows = [(lang, w, n) for lang, c in df.items() for w, n in c.items()]
            df.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "df"]
            )

        for b in batches:
            texts, labels = b.column(0).to_pylist(), [_label(x) for x in b.column(1).to_pylist()]
            for a, z in pw.slices(texts):
                # Links and disguised letters stay in: words of links count nowhere else, disguised ones are rare.
                w, firsts = pw.document_words([t.lower() for t in texts[a:z]])
                part = labels[a:z]
                for label in set(part):
                    mine = firsts[np.array([x == label for x in part])[w.page[firsts]]] if len(firsts) else firsts
                    _, at, n = np.unique(w.hash[mine], return_index=True, return_counts=True)
                    c = df.setdefault(label, Counter())
                    at = mine[at]
                    c.update(dict(zip([w.text[i:j] for i, j in zip(w.start[at].tolist(), w.end[at].tolist())], n.tolist())))
                    c[""] += part.count(label)
            if sum(map(len, df.values())) > 200_000:  # what one task holds at once; the aggregation that follows sums up
                yield flush()
        if df:
            yield flush()

    pairs = docs.filter("text is not null").select("text", "lang").mapInArrow(run, "lang string, word string, df bigint")
    return pairs.groupBy("lang", "word").agg(F.sum("df").alias("df"))


def languages(docs: DataFrame, scratch: Scratch) -> Languages:
    """The languages of all labelled documents.

    A label may be missing or wrong on some documents; it counts as a language if LEAST_LANGUAGE of the labelled documents
    bear it. Words that are common in a language, at most (mean distinct words of a document) / COMMON_DF whatever the
    number of documents, are brought to the driver with their counts and sent with the tasks."""
    df = scratch.keep(document_frequencies(docs), "df")
    n_docs = {r["lang"]: r["df"] for r in df.filter("word = '' and lang <> ''").orderBy(F.desc("df")).limit(int(1 / LEAST_LANGUAGE)).collect()}
    whole = df.filter("word = '' and lang <> ''").agg(F.sum("df")).first()[0] or 0
    n_docs = {k: n for k, n in n_docs.items() if n >= LEAST_LANGUAGE * whole}
    if not n_docs:
        return Languages({}, {})
    needed = F.create_map(*[x for k, n in n_docs.items() for x in (F.lit(k), F.lit(COMMON_DF * n))])[F.col("lang")]
    known = df.filter(F.col("lang").isin(*n_docs)).filter("word <> ''")
    common = known.groupBy("word").agg(F.max((F.col("df") >= needed).cast("int")).alias("hit"), F.map_from_entries(F.collect_list(F.struct("lang", "df"))).alias("df"))
    # One entry a language in each list.
    return Languages(n_docs, {r["word"]: r["df"] for r in common.filter("hit = 1").select("word", "df").collect()})


_MEASURES = (
    "doc_id bigint, lang string, n_words int, n_off int, common float, variety float, "
    "segs array<struct<n:int,m:int,common:float,variety:float,fresh:float>>, curve array<struct<f:int,m:int>>"
)


def measured_pages(docs: DataFrame, known: Languages) -> DataFrame:
    """Per page its language, words, characters of what can't be prose, the other segments with their measures, the medians
    of two of these over segments of five words or more (null without any), and how many words occur how often."""

    def run(batches):
        import pyarrow as pa

        def nested(ends, **columns):
            parts = [pa.array(c, pa.int32() if c.dtype.kind == "i" else pa.float32()) for c in columns.values()]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=list(columns)))

        for b in batches:
            every, texts, labels = (b.column(i).to_pylist() for i in range(3))
            for a, z in pw.slices(texts):
                n = z - a
                cut = [pw.without_links(pw.plain(t)) for t in texts[a:z]]
                seg = pw.Segments([s for s, _ in cut], [x for _, x in cut])
                w = seg.words
                langs = known.of(w, labels[a:z])
                out = np.flatnonzero((seg.k >= 3) & ~seg.is_list)
                off = np.bincount(seg.page, weights=seg.n, minlength=n) - np.bincount(seg.page[out], weights=seg.n[out], minlength=n)
                share = seg.share(known.is_common(w, langs).astype(float))[out].astype(np.float32)
                fresh = seg.share(1 / np.maximum(w.count, 1))[out].astype(np.float32)
                variety = seg.variety(out).astype(np.float32)
                whole = seg.k[out] >= 5
                mid = lambda v: pa.array(pw.middles(seg.page[out][whole], v[whole], n), pa.float32())  # noqa: B023, E731
                ends = np.append(0, np.cumsum(np.bincount(seg.page[out], minlength=n)))
                turns, f, m = pw.curves(w, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(every[a:z], pa.int64()), pa.array(langs, pa.string()), pa.array(w.n_words, pa.int32()), pa.array(off.astype(np.int32)), mid(share), mid(variety),
                        nested(ends, n=seg.n[out], m=seg.m[out], common=share, variety=variety, fresh=fresh), nested(turns, f=f, m=m),
                    ],
                    names=["doc_id", "lang", "n_words", "n_off", "common", "variety", "segs", "curve"],
                )

    return docs.filter("text is not null and doc_id is not null").select("doc_id", "text", "lang").mapInArrow(run, _MEASURES)


def rank_frequency(pages: DataFrame, *carry: str) -> DataFrame:
    """(doc_id, *carry, slope, residual) of log frequency over log rank, for pages of at least two different frequencies.

    Words of equal frequency share the middle of their ranks; the window runs over a page's distinct frequencies. Rows of
    one doc_id are one page; ``carry`` are columns of the page."""
    c = pages.select("doc_id", *carry, F.explode("curve").alias("c")).select("doc_id", *carry, F.col("c.f").alias("f"), F.col("c.m").alias("m"))
    up_to = W.partitionBy("doc_id").orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, W.currentRow)
    r = c.withColumn("hi", F.sum("m").over(up_to))
    r = r.withColumn("x", F.log((F.col("hi") * 2 - F.col("m") + 1) / 2)).withColumn("y", F.log("f"))
    s = r.groupBy("doc_id").agg(
        *[F.first(k).alias(k) for k in carry],
        *[F.sum(F.col("m") * e).alias(a) for a, e in (
            ("w", F.lit(1)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") ** 2), ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") ** 2),
        )],
    )
    vx = F.col("sxx") - F.col("sx") ** 2 / F.col("w")
    vy = F.col("syy") - F.col("sy") ** 2 / F.col("w")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("w")
    ok = s.filter(vx > 1e-9)
    return ok.select("doc_id", *carry, (cov / vx).alias("slope"), F.sqrt(F.greatest(vy - cov**2 / vx, F.lit(0.0)) / F.col("w")).alias("residual"))


def usual(df: DataFrame, pooled: dict | None = None, **values: Column) -> DataFrame:
    """(lang, size, <name>...): medians of ``values`` and ``pooled`` by language and length, as a local table.

    ``pooled`` is for what does not depend on length: a length with values of less than LEAST_PAGES pages takes the
    language's. The result has a row for each language and length, at most 200 x 64."""
    pooled = pooled or {}
    mid = lambda cs: [F.percentile_approx(c, 0.5, 1000).alias(k) for k, c in cs.items()]
    rows = df.groupBy("lang", "size").agg(*[F.count(c).alias(f"n_{k}") for k, c in pooled.items()], *mid(pooled), *mid(values)).collect()
    whole = {r["lang"]: r for r in df.groupBy("lang").agg(*mid(pooled)).collect()} if pooled else {}
    of = lambda r, k: whole[r["lang"]][k] if k in pooled and r[f"n_{k}"] < LEAST_PAGES else r[k]
    as_double = lambda v: None if v is None else float(v)
    names = [*pooled, *values]
    out = [(r["lang"], r["size"], *[as_double(of(r, k)) for k in names]) for r in rows]
    return df.sparkSession.createDataFrame(out, "lang string, size bigint, " + ", ".join(f"{k} double" for k in names))


def _beside(df: DataFrame, medians: DataFrame) -> DataFrame:
    """``df`` with the medians of its language and length. They are few by construction, hence broadcast."""
    on = df["lang"].eqNullSafe(medians["lang"]) & (df["size"] == medians["size"])
    return df.join(F.broadcast(medians), on, "left").drop(medians["lang"]).drop(medians["size"])


def spam_pages(spark: SparkSession, docs: DataFrame, measures: tuple[str, ...] = ("slope", "residual", "divergence")) -> DataFrame:
    """One row per document with a text: doc_id, lang, n_chars, divergence, slope, residual, slope_z, residual_z, is_spam.

    ``docs``: doc_id BIGINT (unique), text, lang; other columns are ignored. A page is spam if, checked exactly, more than
    half of its characters diverge from prose. On a page with an extreme slope or residual, words that come back too often
    on the page as a whole diverge too; ``divergence`` is without these. Empty pages are not spam; a curve of a single
    frequency has no slope (null), which is extreme if its words recur. The whole of every text is measured. ``measures``
    names those that may make a page spam.
    """
    scratch = Scratch(spark, "spam")
    docs = docs.select("doc_id", "text", "lang")
    size = F.floor(F.log2(F.col("n_words") + 1)).alias("size")
    pages = measured_pages(docs, languages(docs, scratch)).select("*", size)
    pages = scratch.keep(pages, "pages")
    distinct = F.aggregate("curve", F.lit(0).cast("bigint"), lambda a, c: a + c["m"])
    fresh = F.when(F.col("n_words") > 0, distinct / F.col("n_words"))
    p = _beside(pages, usual(pages, {"u_common": F.col("common"), "u_variety": F.col("variety")}, u_fresh=fresh))
    least = F.when(F.col("lang") == "zh", LEAST_COMMON_PAIRS).otherwise(LEAST_COMMON)
    p = p.select(
        "doc_id",
        "lang",
        "n_off",
        "segs",
        ((F.size("curve") == 1) & (F.element_at("curve", 1)["f"] > 1)).alias("flat"),
        (least * F.coalesce("u_common", F.lit(0.0))).alias("l_common"),
        (LEAST_VARIETY * F.coalesce("u_variety", F.lit(0.0))).alias("l_variety"),
        (LEAST_FRESH * F.coalesce("u_fresh", F.lit(0.0))).alias("l_fresh"),
    )
    is_prose = lambda s: (s["common"] >= F.col("l_common")) & (s["variety"] >= F.col("l_variety"))
    zero = F.lit(0).cast("bigint")
    off = lambda good: F.aggregate("segs", zero, lambda a, s: a + s["n"] - F.when(good(s), s["m"]).otherwise(0))
    p = p.select(
        "doc_id",
        "lang",
        "flat",
        (F.col("n_off") + F.aggregate("segs", zero, lambda a, s: a + s["n"])).alias("n_chars"),
        (F.col("n_off") + off(is_prose)).alias("off_chars"),
        (F.col("n_off") + off(lambda s: is_prose(s) & (s["fresh"] >= F.col("l_fresh")))).alias("wide_chars"),
    )
    p = p.withColumn("divergence", F.when(F.col("n_chars") > 0, F.col("off_chars") / F.col("n_chars")).otherwise(0.0))

    curve = scratch.keep(rank_frequency(pages, "lang", "size"), "curves")
    z = _beside(curve, usual(curve, **{f"mid_{c}": F.col(c) for c in ("slope", "residual")}))
    away = lambda c: F.abs(F.col(c) - F.col(f"mid_{c}"))
    z = _beside(z, usual(z, **{f"mad_{c}": away(c) for c in ("slope", "residual")}))
    z = z.select("doc_id", "slope", "residual", *[((F.col(c) - F.col(f"mid_{c}")) / F.greatest(F.col(f"mad_{c}") * 1.4826, F.lit(LEAST_SPREAD))).alias(f"{c}_z") for c in ("slope", "residual")])
    p = p.join(z, "doc_id", "left")
    may = lambda name, c: F.coalesce(c, F.lit(False)) & F.lit(name in measures)
    extreme = may("slope", (F.abs("slope_z") > EXTREME) | F.col("flat")) | may("residual", F.abs("residual_z") > EXTREME)
    more = lambda c: F.col(c) * 2 > F.col("n_chars")
    return p.select(
        "doc_id", "lang", "n_chars", "divergence", "slope", "residual", "slope_z", "residual_z",
        (may("divergence", more("off_chars")) | (extreme & more("wide_chars"))).alias("is_spam"),
    )
