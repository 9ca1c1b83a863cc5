"""Maildir files to messages."""

from __future__ import annotations

import email
import email.header
import email.policy
import email.utils
import hashlib
import re
from collections.abc import Iterator
from datetime import timezone
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 << 20
#: Fixed value: the name of an attachment without one.
NAMELESS = "unnamed"
MESSAGE = (
    "message_id string, in_reply_to string, references array<string>, subject string, from_addr string, to_addrs array<string>, cc_addrs array<string>, "
    "date timestamp, date_fabricated boolean, body string, folder string, filepath string, has_attachments boolean, size long, modified timestamp, content_hash string, "
    "attachments array<struct<filename:string,content_type:string,size:long,payload:binary,content_hash:string>>, error string"
)
#: Lets Hadoop's local file system open names with a colon, as Maildir's flags have: no checksum files beside them.
COLONS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Elements whose text is not shown, and elements that end a line.
HIDDEN, BLOCKS = {"script", "style", "head", "title", "noscript", "template"}, set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre hr".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in HIDDEN))
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    """Shown text of a page, block elements on lines of their own; links and images are left out."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def html_column(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [html_text(x) for x in b[html]]})

    return df.select(key, html).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, text string")


def _header(value) -> str:
    parts = []
    for raw, charset in email.header.decode_header(str(value or "")):
        if isinstance(raw, bytes):
            try:
                raw = raw.decode(charset or "utf-8", "replace")
            except LookupError:
                raw = raw.decode("utf-8", "replace")
        parts.append(raw.strip())
    return " ".join(p for p in parts if p)


def _addresses(values) -> list[str]:
    pairs = email.utils.getaddresses([_header(v) for v in values or []])
    return [f"{n} <{a}>" if n else a for n, a in pairs if a]


def _id(value) -> str:
    return str(value or "").strip().strip("<>").strip()


def _decoded(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def folder_of(path: str, root: str | None = None) -> str:
    """Folder of a file below its archive's root, without new or cur; only its last part where the root is unknown."""
    found = re.search(r"^(.*)/(?:cur|new)/[^/]+$", path)
    if not found:
        return ""
    base = re.sub(r"^file:(//)?", "", found[1])
    if root is not None:
        top = re.sub(r"^file:(//)?", "", root).rstrip("/")
        if base == top:
            return ""
        if base.startswith(top + "/"):
            return base[len(top) + 1 :]
    return base.rpartition("/")[2]


def parse(path: str, data: bytes, root: str | None = None) -> dict | None:
    """A message, or None if it has no id.

    The body is the first text/plain part, or the first text/html part as text where that is empty.
    """
    mail = email.message_from_bytes(data, policy=email.policy.compat32)
    message_id = _id(mail["Message-ID"])
    if not message_id:
        return None
    texts: dict[str, str] = {}
    attachments = []
    for part in mail.walk():
        if part.is_multipart():
            continue
        name, kind = part.get_filename(), part.get_content_type()
        if name or "attachment" in str(part.get("Content-Disposition") or "").lower():
            body = part.get_payload(decode=True) or b""
            shown = (_header(name) if name else "") or NAMELESS
            attachments.append({"filename": shown, "content_type": kind, "size": len(body), "payload": body, "content_hash": hashlib.sha256(body).hexdigest()})
        elif kind in ("text/plain", "text/html") or not mail.is_multipart():
            texts.setdefault("text/html" if kind == "text/html" else "text/plain", _decoded(part))
    try:
        date = email.utils.parsedate_to_datetime(str(mail["Date"]))
        date = date.replace(tzinfo=timezone.utc) if date.tzinfo is None else date.astimezone(timezone.utc)
    except (TypeError, ValueError):
        date = None
    body = texts.get("text/plain", "").strip() or html_text(texts.get("text/html", ""))
    return {
        "message_id": message_id, "in_reply_to": _id(mail["In-Reply-To"]), "references": [r for r in map(_id, str(mail["References"] or "").split()) if r],
        "subject": _header(mail["Subject"]) or "(no subject)", "from_addr": next(iter(_addresses(mail.get_all("From"))), ""), "to_addrs": _addresses(mail.get_all("To")),
        "cc_addrs": _addresses(mail.get_all("Cc")), "date": date, "date_fabricated": date is None, "body": body.strip(),
        "folder": folder_of(path, root), "filepath": path, "has_attachments": bool(attachments), "size": len(data),
        "content_hash": hashlib.sha256(data).hexdigest(), "attachments": attachments,
    }


def read_maildir(spark: SparkSession, root: str) -> DataFrame:
    """Files below cur or new folders, at any depth: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").options(**COLONS).option("recursiveFileLookup", True).load(root).where(F.col("path").rlike(r"/(?:cur|new)/[^/]+$"))


def parse_mail(files: DataFrame, max_bytes: int = MAX_BYTES, root: str | None = None) -> DataFrame:
    """Rows of :data:`MESSAGE`; files that are too large or have no id are rows with an error only; a negative ``max_bytes`` is the default, 0 none.

    ``root``: the archive's top folder, below which folders are named.
    """
    max_bytes = MAX_BYTES if max_bytes < 0 else max_bytes
    names = [x.split()[0] for x in re.findall(r"(\w+ (?:array<struct<.*?>>|array<string>|\w+))(?:, |$)", MESSAGE)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content, modified in zip(b["path"], b["content"], b["modified"], strict=True):
                if content is None:
                    got = {"filepath": path, "error": "oversized"}
                else:
                    try:
                        got = parse(path, bytes(content), root) or {"filepath": path, "error": "no message id"}
                        got["modified"] = modified
                    except Exception as e:  # noqa: BLE001  one bad file is one bad row
                        got = {"filepath": path, "error": f"parse: {e}"[:300]}
                rows.append({n: got.get(n) for n in names})
            frame = pd.DataFrame(rows, columns=names)
            for c in ("date", "modified"):
                frame[c] = pd.to_datetime(frame[c], utc=True)
            yield frame

    content = F.when(F.lit(max_bytes == 0) | (F.col("length") <= max_bytes), F.col("content"))
    return files.select("path", content.alias("content"), F.col("modificationTime").alias("modified")).mapInPandas(run, MESSAGE)
