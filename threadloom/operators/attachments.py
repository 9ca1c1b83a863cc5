"""Attachments: extraction by type, a cache by content hash, and when a cached result stands."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import occurrence_id
from threadloom.sources.mail import html_text

#: Limits, the days for which a failure stands, and the parts of office files.
MAX_BYTES, MAX_UNZIPPED, MAX_CHARS, RETRY_DAYS = 25 << 20, 200 << 20, 200_000, 7
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: truncated: the text was longer than ``MAX_CHARS`` and has been cut to it.
EXTRACTED = "content_hash string, status string, extractor string, text string, error string, truncated boolean"


def plain_text(data: bytes) -> str:
    for encoding in ("utf-8", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _unzipped(data: bytes) -> zipfile.ZipFile:
    found = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in found.infolist()) > MAX_UNZIPPED:
        raise ValueError("archive is too large unpacked")
    return found


def docx_text(data: bytes) -> str:
    """Paragraphs of the body, then a line for each table row with its filled cells, then headers and footers."""
    out: list[str] = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t"))
    with _unzipped(data) as z:
        names = [n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)]
        for name in sorted(names, key=lambda n: (n != "word/document.xml", n)):
            root = ElementTree.fromstring(z.read(name))
            rows = list(root.iter(f"{_WORD}tr"))
            inside = {id(p) for row in rows for p in row.iter(f"{_WORD}p")}
            out += [text(p) for p in root.iter(f"{_WORD}p") if id(p) not in inside]
            out += [" ".join(filter(None, (text(c).strip() for c in row.iter(f"{_WORD}tc")))) for row in rows]
    return "\n\n".join(x for x in out if x.strip())


def _sheets(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """(name, file) of a workbook's sheets, by the relations that the workbook names."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        target = targets[sheet.get(f"{_REL}id")]
        yield sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def xlsx_text(data: bytes) -> str:
    with _unzipped(data) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        out = []
        for name, file in _sheets(z):
            rows = []
            for row in ElementTree.fromstring(z.read(file)).iter(f"{_SHEET}row"):
                cells = []
                for c in row.iter(f"{_SHEET}c"):
                    v = c.find(f"{_SHEET}v")
                    inline = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
                    cells.append(shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else inline)
                if any(cells):
                    rows.append("\t".join(x or "" for x in cells))
            if rows:
                out += [f"[Sheet: {name}]", *rows]
    return "\n".join(out)


#: Extractors by MIME type, and by file extension; PDF and images need libraries that are not here.
BY_TYPE: dict[str, str] = {
    "text/plain": "text", "text/csv": "text", "text/markdown": "text", "text/html": "html",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/pdf": "pdf",
}
BY_EXTENSION: dict[str, str] = {"txt": "text", "md": "text", "csv": "text", "log": "text", "html": "html", "htm": "html", "docx": "docx", "xlsx": "xlsx", "pdf": "pdf", **dict.fromkeys(("png", "jpg", "jpeg", "gif", "tif", "tiff", "bmp", "webp"), "image")}
#: Why an image has no text.
NO_OCR = "OCR disabled"
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"text": plain_text, "html": lambda b: html_text(plain_text(b)), "docx": docx_text, "xlsx": xlsx_text}


def extractor_of(content_type: str | None, filename: str | None) -> str | None:
    """By MIME type, then image/* of any kind, then by the file name's ending."""
    kind = (content_type or "").split(";")[0].strip().lower()
    return BY_TYPE.get(kind) or ("image" if kind.startswith("image/") else None) or BY_EXTENSION.get((filename or "").rpartition(".")[2].lower())


def extract_one(payload: bytes, content_type: str | None, filename: str | None) -> tuple[str, str | None, str, str | None, bool]:
    """(status, extractor, text, error, truncated) of one payload."""
    kind = extractor_of(content_type, filename)
    if len(payload) > MAX_BYTES:
        return "too_large", kind, "", None, False
    if kind not in EXTRACTORS:
        return "unsupported", kind, "", NO_OCR if kind == "image" else None, False
    try:
        text = EXTRACTORS[kind](payload)
    except Exception as e:  # noqa: BLE001  whatever is wrong with a file is its result
        return "failed", kind, "", str(e)[:500], False
    return ("success" if text.strip() else "empty"), kind, text[:MAX_CHARS], None, len(text) > MAX_CHARS


def extract(attachments: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Results of :data:`EXTRACTED` for each distinct content that ``cache`` (content_hash) has not."""
    todo = attachments.where("payload IS NOT NULL").dropDuplicates(["content_hash"])
    if cache is not None:
        todo = todo.join(cache.select("content_hash"), "content_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(h, *extract_one(bytes(p), t, f)) for h, p, t, f in zip(b["content_hash"], b["payload"], b["content_type"], b["filename"], strict=True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in EXTRACTED.split(", ")])

    return todo.select("content_hash", "payload", "content_type", "filename").mapInPandas(run, EXTRACTED)


def cache_stands(status: Column, extracted_at: Column, now: Column, text: Column | None = None, error: Column | None = None, ocr: bool = False) -> Column:
    """Whether a cached result is used: success with a text, a failure for seven days, lack of OCR only while OCR is off; an unknown time never."""
    young = F.coalesce(now < extracted_at + F.make_dt_interval(days=F.lit(RETRY_DAYS)), F.lit(False))
    filled = F.lit(True) if text is None else F.coalesce(F.length(text), F.lit(0)) > 0
    rerun = F.coalesce(error, F.lit("")).contains(NO_OCR) if error is not None and ocr else F.lit(False)
    found = F.when(status == "success", filled).when(status.isin("empty", "too_large"), True).when(status == "unsupported", ~rerun).when(status == "failed", young)
    return found.otherwise(False)


def attachment_chunk_key(message_id: Column, content_hash: Column) -> Column:
    """The key under which an attachment's chunks are numbered."""
    return F.concat_ws("::", message_id, content_hash)


def prepare(messages: DataFrame, cache: DataFrame, now: Column, ocr: bool = False) -> tuple[DataFrame, DataFrame]:
    """(occurrences, todo): a row for each attachment of each message, and the distinct contents whose cached result does not stand.

    ``messages`` has message_id, thread_id and attachments; ``cache`` the columns of :data:`EXTRACTED` and extracted_at.
    """
    rows = messages.select("message_id", "thread_id", F.posexplode("attachments").alias("slot", "a")).select("message_id", "thread_id", "slot", "a.*")
    rows = rows.withColumn("attachment_id", occurrence_id(F.col("message_id"), F.col("content_hash"), F.col("filename"), F.col("slot")))
    stands = cache_stands(F.col("status"), F.col("extracted_at"), now, F.col("text"), F.col("error"), ocr)
    kept = cache.where(stands).select("content_hash")
    todo = rows.where("payload IS NOT NULL").dropDuplicates(["content_hash"]).join(kept, "content_hash", "left_anti")
    return rows.drop("payload"), todo.select("content_hash", "payload", "content_type", "filename")


def apply(occurrences: DataFrame, cache: DataFrame, extracted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(attachments, cache) after extraction: each occurrence with its content's result, and the cache with fresh rows in place of old ones."""
    fresh = extracted.withColumn("extracted_at", now)
    merged = cache.join(extracted.select("content_hash"), "content_hash", "left_anti").unionByName(fresh.select(*cache.columns))
    return occurrences.join(merged.select("content_hash", "status", "extractor", "text", "error"), "content_hash", "left"), merged
