"""Markdown reports as rows: sections, items, labelled values, and what a reader must not see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelark.functions.hashing import sha256
from tracelark.functions.text import newlines, sections
from tracelark.functions.unicode import strip_white

# Names of machine fields, internal codes, English states, internal ids, hidden or raw markup in reader-facing text.
MACHINE_FIELDS = (
    "claim_id issue_id source_anchor claim_type evidence_status source_locator evidence_id action_id closure_id input_id viewpoint_id "
    "claim_refs evidence_refs fit_target_refs reader_binding reader_item_sha256 reader_grouping_reason item_index location_excerpt "
    "problem_excerpt reason_excerpt action_excerpt supplied_inputs media_type captured_at calculation_expression calculation_result "
    "calculation_operands derived_result calculation_evidence_ref closure_evidence_refs verification_action_refs closure_decision_ref "
    "requires_external_evidence input_evidence_refs predicate_results human_reviewed draft_sha256 report_sha256 framework_timing web_trace "
    "publication_status hidden_assumptions counterevidence granularity text_detectability discovery_channel discovery_channels "
    "discovery_origin prior_question_refs support_item_refs framework_node_refs framework_mapping_status risk_level verification_level "
    "level_basis required_evidence required_reviewer can_auto_close closure_route closure_routes closure_condition workflow_state "
    "disposition publication_effect closure_note reopen_conditions"
).split()
READER_LEAKS = {
    "INTERNAL_CODE_IN_READER_LAYER": r"(?<![A-Za-z0-9_])(?:R[1-3]|V[1-3]|T[1-3]|D[0-4]|C[0-7]|G[0-3])(?![A-Za-z0-9_])",
    "MACHINE_FIELD_IN_READER_LAYER": rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(MACHINE_FIELDS)})(?![A-Za-z0-9_])",
    "ENGLISH_STATUS_IN_READER_LAYER": r"(?i)(?<![A-Za-z0-9_])(?:ready|revise|hold)(?![A-Za-z0-9_])",
    "INTERNAL_ID_IN_READER_LAYER": r"(?i)(?<![A-Za-z0-9_])(?:CLM|ISS|EV|ACT|CLS|SUP|PQ|ESI|KC|CARD|NODE|FW)-[A-Za-z0-9][A-Za-z0-9_-]*",
    "HIDDEN_OR_CODE_FENCED_READER_CONTENT": r"(?m)<!--|-->|^\s*(?:```|~~~)",
    "RAW_HTML_IN_READER_CONTENT": r"</?[A-Za-z][^>]*>",
}
# Sections of a report, its states, the sections that list items with the most they may list, the line that
# says there are none, the labels of an item and the code stem; what contradicts the state that a text is fit to publish.
SECTIONS = ("结论", "这篇文章已经做好的地方", "发布前需要处理", "建议怎么改", "可继续研究的新观点", "如果还要继续核验", "本次审阅没有验证什么")
STATES = ("可以发布", "修改后发布", "暂缓发布")
LISTS = (
    ("发布前需要处理", 8, "TOO_MANY_PRIORITY_ITEMS", "本稿没有仍需在发布前处理的问题", "PRIORITY_ISSUE_ZERO_MARKER", "PRIORITY_ITEM_HEADING_MISSING",
     {"原文位置": "PRIORITY_ITEM_LOCATION_MISSING", "为什么重要": "PRIORITY_ITEM_REASON_MISSING", "建议处理": "PRIORITY_ITEM_ACTION_MISSING"}),
    ("可继续研究的新观点", 2, "TOO_MANY_READER_VIEWPOINTS", "本稿暂不足以形成可靠的新观点", "NEW_VIEWPOINT_ZERO_MARKER", "NEW_VIEWPOINT_HEADING_MISSING",
     {"适用对象": "NEW_VIEWPOINT_ACTOR_LABEL_MISSING", "决策问题": "NEW_VIEWPOINT_DECISION_LABEL_MISSING", "可能机制": "NEW_VIEWPOINT_MECHANISM_LABEL_MISSING",
      "适用边界": "NEW_VIEWPOINT_BOUNDARY_LABEL_MISSING", "反证条件": "NEW_VIEWPOINT_FALSIFICATION_LABEL_MISSING"}),
)
_PUBLISH = "发布|上线|公开|刊发|推送"
_STOP = "请勿|勿|禁止|严禁|不要|切勿|暂缓|暂不|推迟|延后|搁置|停止|取消|不适合|不具备|不满足|不得|不能|不可|不应|不宜"
CONTRADICTIONS = (
    rf"(?:{_STOP}|先别|尚不能|不建议).{{0,12}}(?:{_PUBLISH})",
    rf"(?:{_PUBLISH}).{{0,12}}(?:{_STOP}|撤回|下线)",
    r"(?:立即|应当|需要|建议|必须|仍需|先行)?.{0,4}(?:下线|撤回|作废|取消发稿|搁置)",
    r"结论.{0,4}(?:不成立|作废)",
    r"(?:当前|本|该)?版本.{0,4}(?:仅|只)(?:供|限于).{0,4}内部(?:流转|审阅|使用|参考)",
    r"(?:完成|待).{0,8}(?:修改|补证|核验|整改).{0,8}(?:后再|再)(?:对外|公开|发布|上线|刊发|推送)",
)
APPENDIX = r"(?m)^##\s+技术附录\s*$"


def reader_layer(text: Column) -> Column:
    """The text before the technical appendix."""
    return F.split(newlines(text), APPENDIX, 2)[0]


def report_sections(reports: DataFrame, key: str) -> DataFrame:
    """(key, position, title, body, items) of each second-level section of ``text`` before the appendix."""
    return reports.select(key, F.explode(sections(reader_layer(F.col("text")))).alias("s")).select(key, "s.*")


def report_items(parts: DataFrame, key: str) -> DataFrame:
    """(key, title, item_no, heading, item, item_sha256) of each third-level block of a section."""
    blocks = F.split(F.concat(F.lit("\n"), F.col("body")), r"\n(?=###[ \t]+\S)")
    items = F.filter(blocks, lambda b: b.rlike(r"^###[ \t]+\S"))
    t = parts.select(key, "title", F.posexplode(items).alias("p", "raw"))
    t = t.select(key, "title", (F.col("p") + 1).alias("item_no"), strip_white(F.col("raw")).alias("item"))
    return t.select(key, "title", "item_no", item_heading(F.col("item")).alias("heading"), "item", sha256(F.col("item")).alias("item_sha256"))


def item_heading(item: Column) -> Column:
    """The first line of a block without its hashes, and without a number and the stop or comma that follows it."""
    line = F.regexp_replace(F.substring_index(item, "\n", 1), "^#+", "")
    return F.trim(F.regexp_replace(strip_white(line), r"^\p{Nd}+[.、]", ""))


def label_values(item: Column, label: str) -> Column:
    """Values of a labelled bullet, for either colon."""
    return F.transform(F.regexp_extract_all(item, F.lit(rf"(?m)^\s*-\s*{label}\s*[：:]\s*(\S.*)$"), F.lit(1)), lambda v: F.trim(v))


def reader_leaks(text: Column) -> Column:
    """Codes of what a reader-facing text must not hold."""
    t = reader_layer(text)
    return F.array_compact(F.array(*[F.when(t.rlike(p), code) for code, p in READER_LEAKS.items()]))


def section_issues(parts: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(key, code): required sections missing, repeated, empty or out of order (order only if none is missing)."""
    want = F.array(*map(F.lit, required))
    seen = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda s: s["title"]), lambda t: F.array_contains(want, t))
    # A report has a handful of sections, so its own array is bounded by the document.
    g = parts.groupBy(key).agg(seen.alias("seen"), F.count(F.when(F.col("title").isin(*required) & (F.col("body") == ""), 1)).alias("empty"))
    missing = F.size(F.array_except(want, F.col("seen"))) > 0
    hit = [
        F.when(missing, "MISSING_REQUIRED_SECTION"),
        F.when(F.size("seen") > F.size(F.array_distinct("seen")), "DUPLICATE_REQUIRED_SECTION"),
        F.when(~missing & (F.array_distinct("seen") != want), "SECTION_ORDER_INVALID"),
        F.when(F.col("empty") > 0, "REQUIRED_SECTION_BODY_EMPTY"),
    ]
    return g.select(key, F.explode(F.array_compact(F.array(*hit))).alias("code"))


def _solid(c: Column, least: int = 4) -> Column:
    """At least so many letters or digits besides markup."""
    bare = F.regexp_replace(c, READER_LEAKS["RAW_HTML_IN_READER_CONTENT"], "")
    return F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")) >= least


def _has_one(item: Column, label: str) -> Column:
    values = label_values(item, label)
    return (F.size(values) == 1) & F.coalesce(_solid(F.get(values, F.lit(0))), F.lit(False))


def list_issues(reports: DataFrame, key: str) -> DataFrame:
    """(key, code): what is wrong with the lists and the conclusion of each report (``text``).

    Sections run from their heading to the next one of SECTIONS. More items than a section may list, no items without the
    line that says so or that line beside items, items without a heading or with other than one value of a label; a
    conclusion with no or several states, with text before its state, or with one that its text contradicts. One
    projection; nothing is shuffled. A null text has no codes."""
    heads = "|".join(SECTIONS)
    parts = F.split(F.concat(F.lit("\n"), reader_layer(F.col("text"))), rf"\n##[ \t]+(?=(?:{heads})[ \t]*(?:\n|\z))")
    d = reports.filter("text is not null").select(key, F.transform(F.slice(parts, F.lit(2), F.size(parts)), strip_white).alias("_p"))

    def body(name: str) -> Column:
        own = F.get(F.filter("_p", lambda p: strip_white(F.substring_index(p, "\n", 1)) == name), F.lit(0))
        return F.coalesce(F.when(F.contains(own, F.lit("\n")), strip_white(F.regexp_replace(own, "\\A[^\n]*\n", ""))), F.lit(""))

    d = d.select(key, *[body(s).alias(f"_{i}") for i, s in enumerate(SECTIONS)])
    codes = []
    end = F.col("_0")
    said = sum((F.size(F.split(end, s)) - 1 for s in STATES), F.lit(0))
    leading = end.rlike(rf"\A(?:{'|'.join(STATES)})[。.!！]")
    fit = F.regexp_extract(end, rf"(?s)\A{STATES[0]}[。.!！](.*)", 1)
    codes += [
        F.when(said == 0, "MISSING_CHINESE_PUBLICATION_STATUS"),
        F.when(said > 1, "MULTIPLE_PUBLICATION_STATUSES"),
        F.when((said > 0) & ~leading, "PUBLICATION_STATUS_NOT_LEADING"),
        F.when(fit.rlike("|".join(CONTRADICTIONS)), "READY_CONCLUSION_CONTRADICTED"),
    ]
    for name, most, too_many, none, marker, no_heading, labels in LISTS:
        text = F.col(f"_{SECTIONS.index(name)}")
        items = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=###[ \t]+\S)"), lambda b: b.startswith("###"))
        says_none = text.rlike(rf"(?m)^\s*{none}[。.!！]\s*$")
        n = F.size(items)
        codes += [
            F.when(n > most, too_many),
            F.when((n == 0) & ~says_none, f"{marker}_MISSING"),
            F.when((n > 0) & says_none, f"{marker}_CONFLICT"),
            F.when(F.exists(items, lambda i: ~_solid(item_heading(i), 2)), no_heading),
        ]
        for label, code in labels.items():
            codes.append(F.when(F.exists(items, lambda i: ~_has_one(i, label)), code))  # noqa: B023 (called at once)
    return d.select(key, F.explode(F.array_compact(F.array(*codes))).alias("code"))
