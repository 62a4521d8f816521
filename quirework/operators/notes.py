"""Notes of a book's chapters: note blocks and notes in other documents, drawn to the chapter's end.

Blocks nest, so they are found by a stack over a chapter's tags, in Arrow functions; what a link means in the archive is
joined. A chapter's notes are numbered by where their markers stand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.sources.zipscan import resolve

#: Elements that hold notes, words that tell notes, and those that tell markers of notes.
CONTAINERS = ("div", "aside", "section", "p", "li", "blockquote")
MARKERS = ("footnote-item", "footnote-ref", "note-ref", "noteref", "duokan-footnote-item")
WORDS = ("footnote", "endnote", "annotation", "duokan", "zhushi", "注释", "注解", "脚注", "尾注")
SURE_WORDS = ("注释", "注解", "脚注", "尾注", "footnote", "endnote")
TYPES = ("footnote", "endnote", "annotation", "note")
NUMBER_CLASSES = ("footnote-number", "note-number")
TEXT_CLASSES = ("duokan-footnote", "footnote-text", "note-text", "footnote-content")
TITLE = "【注释】"

_one_of = lambda words: re.compile("|".join(words), re.I)
_MARKER, _SURE, _TYPE = map(_one_of, (MARKERS, SURE_WORDS, TYPES))
_WORD = re.compile("|".join(WORDS) + r"|(?<![^\s_-])note(?![^\s_-])", re.I)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_ANCHOR = re.compile(r"<a\b([^>]*)>(.*?)</a>", re.I | re.S)
_NUMBER = re.compile(r"[\[(（【]?\d{1,3}[\])）】]?")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def blocks(html: str, names: tuple[str, ...], wanted: Callable[[str, dict, str], bool]) -> list[tuple[int, int, dict, str]]:
    """(start, end, attributes, inner) of the wanted elements of some names, by start; an end tag closes the last open one."""
    tags = re.compile(rf"<(/?)({'|'.join(names)})\b([^>]*)>", re.I)
    found, open_ = [], []
    for m in tags.finditer(html):
        if m[1]:
            if open_ and (top := open_.pop()):
                start, inner, attrs = top
                found.append((start, m.end(), attrs, html[inner : m.start()]))
            continue
        attrs = attributes(m[3])
        hit = wanted(m[2].lower(), attrs, m[3])
        if m[3].rstrip().endswith("/"):
            found += [(m.start(), m.end(), attrs, "")] if hit else []
        else:
            open_.append((m.start(), m.end(), attrs) if hit else None)
    return sorted(found, key=lambda b: b[0])


def is_note(name: str, attrs: dict, raw: str = "") -> bool:
    """Whether an element holds a note; plain text elements need a word that leaves no doubt."""
    kind = f"{attrs.get('epub:type', '')} {attrs.get('role', '')}"
    marks = f"{attrs.get('class', '')} {attrs.get('id', '')} {kind}"
    if _MARKER.search(marks):
        return False
    if _TYPE.search(kind):
        return True
    return bool(_WORD.search(marks)) and (name in ("div", "aside", "section") or bool(_SURE.search(marks)))


def tidy(html: str) -> str:
    """A note's markup without its own number, its wrappers, and breaks at the ends; paragraphs become breaks."""
    span = lambda classes: re.compile(rf"<span\b[^>]*class\s*=\s*[\"'][^\"']*(?:{'|'.join(classes)})[^\"']*[\"'][^>]*>(.*?)</span>", re.I | re.S)
    html = span(NUMBER_CLASSES).sub("", html)
    for _ in range(3):
        html = span(TEXT_CLASSES).sub(r"\1", html)
    html = re.sub(r"</p\s*>", "<br/>", re.sub(r"<p\b[^>]*>", "", html, flags=re.I), flags=re.I)
    html = re.sub(r"(?:\s*<br\s*/?>\s*)+", "<br/>", html, flags=re.I)
    html = re.sub(r"\A(?:\s|<br\s*/?>)+|(?:\s|<br\s*/?>)+\Z", "", html, flags=re.I)
    html = re.sub(r"\A[\[(（【]\s*\d{1,3}\s*[\])）】]\s*", "", html)
    return re.sub(r"\A\d{1,3}[.、]\s+", "", html).strip()


def split(body: str) -> tuple[str, list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """A body without its outermost note blocks, these (id, inner, start), and its links to notes elsewhere (file, id, place)."""
    found = [b for b in blocks(body, CONTAINERS, is_note) if b[3].strip()]
    outer: list[tuple[int, int, dict, str]] = []
    for b in found:
        if not outer or b[1] > outer[-1][1]:
            outer.append(b)
    rest, at = [], 0
    for start, end, _, _ in outer:
        rest.append(body[at:start])
        at = max(at, end)
    cleaned = "".join([*rest, body[at:]])
    refs = []
    for m in _ANCHOR.finditer(cleaned):
        attrs = attributes(m[1])
        file, _, mark = (attrs.get("href") or attrs.get("xlink:href") or "").partition("#")
        if not file or not mark or re.match("(?:data|https?|mailto):", file, re.I):
            continue
        shown = " ".join(unescape(re.sub("<[^>]*>", "", m[2])).split())
        if _NUMBER.fullmatch(shown) or _WORD.search(f"{attrs.get('class', '')} {attrs.get('id', '')} {shown}"):
            refs.append((file, mark, m.start()))
    return cleaned, [(b[2].get("id", ""), b[3], b[0]) for b in outer], refs


def element(html: str, mark: str) -> str:
    """What the element with an id holds, '' if there is none."""
    m = re.search(rf"<([a-zA-Z][\w:-]*)\b[^<>]*\sid\s*=\s*[\"']{re.escape(mark)}[\"']", html, re.I)
    if not m:
        return ""
    same = blocks(html[m.start() :], (re.escape(m[1]),), lambda n, a, raw: a.get("id", "").lower() == mark.lower())
    return same[0][3] if same else ""


def place(cleaned: str, mark: str, otherwise: int) -> int:
    """Where the first thing stands that has an id or links to it."""
    if not mark:
        return otherwise
    m = re.search(rf"\sid\s*=\s*[\"']{re.escape(mark)}[\"']|(?:xlink:)?href\s*=\s*[\"'][^\"']*#{re.escape(mark)}[\"']", cleaned, re.I)
    return m.start() if m else otherwise


def ordered(cleaned: str, found: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """(id, content) of the notes that have any, each id once, by the place of their markers."""
    out, seen = [], set()
    for mark, html, at in found:
        content, key = tidy(html), mark or f"#{at}"
        if content and key not in seen:
            seen.add(key)
            out.append((place(cleaned, mark, at), len(out), mark, content))
    return [(mark, content) for _, _, mark, content in sorted(out)]


_FOUND = "array<struct<id:string,html:string,at:int>>"


def _mapped(df: DataFrame, schema: str, f: Callable[[dict], dict]) -> DataFrame:
    """Rows by a function of single rows, in Arrow batches."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [f(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in made], target) if made else pa.RecordBatch.from_pylist([], target)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(run, schema)


def chapter_notes(docs: DataFrame, entries: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(book_id, entry, kept, notes) for ``docs(book_id, entry, body)``: the body without note blocks and its notes (id, content) in order.

    A chapter without notes keeps its body as it is.
    """
    def cut(r: dict) -> dict:
        cleaned, own, refs = split(r["body"] or "")
        return {"book_id": r["book_id"], "entry": r["entry"], "body": r["body"], "cleaned": cleaned, "own": [dict(zip(("id", "html", "at"), x, strict=True)) for x in own], "refs": [dict(zip(("file", "id", "at"), x, strict=True)) for x in refs]}

    first = stage(_mapped(docs.select("book_id", "entry", "body"), f"book_id string, entry string, body string, cleaned string, own {_FOUND}, refs array<struct<file:string,id:string,at:int>>", cut))
    refs = first.select("book_id", F.col("entry").alias("chapter"), F.explode("refs").alias("r"))
    refs = refs.select("book_id", "chapter", t.href_key(t.join_path(t.path_dir(F.col("chapter")), F.col("r.file"))).alias("path"), F.col("r.id").alias("id"), F.col("r.at").alias("at"))
    refs = stage(resolve(stage(refs), entries).where("entry is not null"))
    asked = refs.groupBy("book_id", F.col("entry").alias("name")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    pages = asked.join(entries.select("book_id", "name", "data"), ["book_id", "name"]).select("book_id", "name", "ids", t.decode_text(F.col("data")).alias("html"))
    read = _mapped(pages, "book_id string, name string, found map<string,string>", lambda r: {"book_id": r["book_id"], "name": r["name"], "found": {i: element(r["html"] or "", i) for i in r["ids"]}})
    found = read.select("book_id", F.col("name").alias("entry"), F.explode("found").alias("id", "html"))
    far = refs.join(found, ["book_id", "entry", "id"]).groupBy("book_id", F.col("chapter").alias("entry")).agg(F.array_sort(F.collect_list(F.struct("at", "id", "html"))).alias("far"))

    def number(r: dict) -> dict:
        pairs = ordered(r["cleaned"], [(x["id"], x["html"], x["at"]) for x in [*r["own"], *(r["far"] or [])]])
        return {"book_id": r["book_id"], "entry": r["entry"], "kept": r["cleaned"] if pairs else r["body"], "notes": [{"id": i, "content": c} for i, c in pairs]}

    both = first.drop("refs").join(far, ["book_id", "entry"], "left")
    return _mapped(both, "book_id string, entry string, kept string, notes array<struct<id:string,content:string>>", number)
