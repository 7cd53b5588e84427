"""Office documents: text, comments with their anchors, counts and metadata, through one Arrow function.

Spark reads the files as binary rows; limits are checked before anything is unpacked. A document that breaks a limit
or can't be read is a row with a problem.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelark.functions.batches import batched

MAX_FILE_BYTES = 100 * 1024 * 1024
MAX_EXPANDED_BYTES = 350 * 1024 * 1024
MAX_CHARS = 3_000_000

SCHEMA = (
    "kind string, text string, paragraphs int, tables int, images int, links int, formulas int, "
    "comments array<struct<comment_id:string,id:string,author:string,date:string,text:string,selected:string,context:string,anchored:boolean,resolved:boolean>>, "
    "properties map<string,string>, problem string"
)
_COLUMNS = ["kind", "text", "paragraphs", "tables", "images", "links", "formulas", "comments", "properties", "problem"]


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str):
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _text(e, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _tag(x) == tag)


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _natural(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]


# What a "done" attribute says when a comment is resolved, and the elements that stand for white space.
DONE = ("1", "true", "True")
WHITE_ELEMENTS = {"tab": "\t", "br": "\n", "cr": "\n"}


def _tidy(s: str) -> str:
    """Runs of blanks, tabs and no-break spaces as one blank, none around line ends, at most one empty line."""
    s = re.sub("[ \t\xa0]+", " ", s.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub("\n{3,}", "\n\n", re.sub(" *\n *", "\n", s)).strip()


def _docx(z: zipfile.ZipFile) -> dict:
    body = _xml(z, "word/document.xml")
    if body is None:
        raise ValueError("no main part")
    paragraphs, selected, contexts, anchored, open_now = [], {}, {}, set(), set()
    for p in (e for e in body.iter() if _tag(e) == "p"):
        whole, touched = [], set(open_now)
        for e in p.iter():
            t = _tag(e)
            if t in ("commentRangeStart", "commentRangeEnd") and (i := _attr(e, "id")):
                touched.add(i)
                if t == "commentRangeStart":
                    open_now.add(i)
                    anchored.add(i)
                else:
                    open_now.discard(i)
            elif (piece := WHITE_ELEMENTS.get(t, (e.text or "") if t in ("t", "delText") else None)) is not None:
                whole.append(piece)
                for i in open_now:
                    selected.setdefault(i, []).append(piece)
        if text := _tidy("".join(whole)):
            paragraphs.append(text)
            for i in touched:
                contexts.setdefault(i, {})[text] = None  # a dict keeps the order and drops repeats
    notes = {}
    if (part := _xml(z, "word/comments.xml")) is not None:
        for c in (e for e in part.iter() if _tag(e) == "comment" and _attr(e, "id")):
            first = next((p for p in c.iter() if _tag(p) == "p"), None)
            notes[_attr(c, "id")] = dict(
                author=_attr(c, "author"), date=_attr(c, "date"), text=_tidy(_text(c)), para=None if first is None else _attr(first, "paraId")
            )
    done = {}
    if (part := _xml(z, "word/commentsExtended.xml")) is not None:
        done = {_attr(e, "paraId"): _attr(e, "done") in DONE for e in part.iter() if _tag(e) == "commentEx" and _attr(e, "done") is not None}
    by_number = lambda i: (0, int(i), "") if i.isdigit() else (1, 0, i)
    comments = []
    for n, i in enumerate(sorted(notes.keys() | anchored, key=by_number), 1):
        note = notes.get(i, {})
        comments.append(
            {"comment_id": f"CMT-{n:03d}", "id": i, "author": note.get("author"), "date": note.get("date"), "text": note.get("text"),
             "selected": _tidy("".join(selected.get(i, []))), "context": _tidy("\n".join(contexts.get(i, {}))),
             "anchored": i in anchored, "resolved": done.get(note.get("para"))}
        )
    count = lambda t: sum(_tag(e) == t for e in body.iter())
    return dict(text=_tidy("\n".join(paragraphs)), paragraphs=len(paragraphs), tables=count("tbl"), images=sum(n.startswith("word/media/") and n[-1] != "/" for n in z.namelist()), links=count("hyperlink"), comments=comments)


def _pptx(z: zipfile.ZipFile) -> dict:
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_natural)
    slides = []
    for n in names:
        root = _xml(z, n)
        slides.append("\n".join(x for p in root.iter() if _tag(p) == "p" for x in [_text(p)] if x.strip()))
    return dict(text="\n\n".join(slides), paragraphs=len(slides), images=sum(n.startswith("ppt/media/") for n in z.namelist()))


def _xlsx(z: zipfile.ZipFile) -> dict:
    shared = []
    if (s := _xml(z, "xl/sharedStrings.xml")) is not None:
        shared = [_text(e) for e in s if _tag(e) == "si"]
    lines, formulas = [], 0
    for n in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_natural):
        for row in (e for e in _xml(z, n).iter() if _tag(e) == "row"):
            cells = []
            for c in (e for e in row if _tag(e) == "c"):
                formulas += sum(_tag(e) == "f" for e in c)
                v = next((e.text for e in c if _tag(e) == "v"), None)
                kind = c.get("t")
                if kind == "s" and v is not None and v.isdigit() and int(v) < len(shared):
                    v = shared[int(v)]
                elif kind == "inlineStr":
                    v = _text(c)
                if v:
                    cells.append(v)
            if cells:
                lines.append("\t".join(cells))
    return dict(text="\n".join(lines), paragraphs=len(lines), formulas=formulas)


def _properties(z: zipfile.ZipFile) -> dict:
    out = {}
    for part in ("docProps/core.xml", "docProps/custom.xml"):
        if (root := _xml(z, part)) is not None:
            for e in root:
                name = _attr(e, "name") or _tag(e)
                value = "".join(e.itertext()).strip()
                if value:
                    out[f"{part[9:-4]}:{name}"] = value
    return out


def _pdf(content: bytes) -> dict:
    try:
        from pypdf import PdfReader
    except ImportError:
        return dict(problem="PDF_SUPPORT_MISSING")
    r = PdfReader(io.BytesIO(content))
    if r.is_encrypted:
        return dict(problem="PDF_ENCRYPTED")
    pages = [p.extract_text() or "" for p in r.pages]
    return dict(text="\n\n".join(pages), paragraphs=len(pages))


def _plain(content: bytes) -> dict:
    for name in ("utf-8-sig", "utf-8", "gb18030"):
        try:
            t = content.decode(name)
        except UnicodeDecodeError:
            continue
        return dict(text=t, paragraphs=sum(bool(x.strip()) for x in t.split("\n")))
    return dict(problem="UNDECODABLE")


def extract(path: str, content: bytes | None, max_chars: int = MAX_CHARS, max_expanded: int = MAX_EXPANDED_BYTES) -> dict:
    """Everything about one document as a row of SCHEMA; whatever goes wrong is its problem."""
    kind = path.rpartition(".")[2].lower()
    out = dict.fromkeys(_COLUMNS)
    out["kind"] = kind
    if content is None:
        return out | {"problem": "FILE_LIMIT"}
    try:
        if kind in ("docx", "pptx", "xlsx"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                if sum(i.file_size for i in z.infolist()) > max_expanded:
                    return out | {"problem": "EXPANSION_LIMIT"}
                out |= {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[kind](z)
                out["properties"] = _properties(z)
        elif kind == "pdf":
            out |= _pdf(content)
        elif kind in ("txt", "md"):
            out |= _plain(content)
        else:
            out["problem"] = "UNSUPPORTED_TYPE"
    except Exception as e:  # broken archives and XML of any kind
        return dict.fromkeys(_COLUMNS) | {"kind": kind, "problem": f"READ_ERROR:{type(e).__name__}"}
    if out["text"] is not None and len(out["text"]) > max_chars:
        return dict.fromkeys(_COLUMNS) | {"kind": kind, "problem": "TEXT_LIMIT"}
    return out


def read_documents(spark: SparkSession, path: str, max_file: int = MAX_FILE_BYTES, max_chars: int = MAX_CHARS) -> DataFrame:
    """(path, n_bytes, sha256, document struct) of the documents below ``path``."""
    fields = lambda p, c: tuple(extract(p, None if c is None else bytes(c), max_chars)[k] for k in _COLUMNS)
    run = batched(fields, SCHEMA, _COLUMNS)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.when(F.col("length") <= max_file, F.col("content"))
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), run("path", small).alias("document"))


def package_findings(docs: DataFrame) -> DataFrame:
    """(path, code) of what an office package should not carry: comments, personal and custom metadata, unreadable parts."""
    personal = ("core:creator", "core:lastModifiedBy", "core:title", "core:subject", "core:keywords", "core:description", "core:category")
    keys = F.coalesce(F.map_keys("document.properties"), F.array().cast("array<string>"))
    hit = [
        F.when(F.size("document.comments") > 0, "OFFICE_COMMENTS_OR_REVIEWERS"),
        F.when(F.arrays_overlap(keys, F.array(*map(F.lit, personal))), "OFFICE_PERSONAL_METADATA"),
        F.when(F.exists(keys, lambda k: k.startswith("custom:")), "OFFICE_CUSTOM_METADATA"),
        F.when(F.col("document.problem").isin("EXPANSION_LIMIT", "FILE_LIMIT"), "OOXML_RESOURCE_LIMIT"),
        F.when(F.col("document.problem").startswith("READ_ERROR"), "OOXML_SCAN_ERROR"),
    ]
    return docs.select("path", F.explode(F.array_compact(F.array(*hit))).alias("code"))
