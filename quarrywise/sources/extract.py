"""Text of files by kind: plain text, HTML, CSV, XLSX, DOCX, PPTX, e-mail; PDF and images by plug-in tools."""

from __future__ import annotations

import csv
import email
import email.policy
import html.parser
import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from xml.etree import ElementTree

from quarrywise.functions import split as S

#: Rows of a sheet that are indexed.
SHEET_ROWS = 300


@dataclass
class Extracted:
    """What a file gave: raw pages, pages for topics if they differ, how, and what was odd."""

    doc_type: str
    pages: list[str] = field(default_factory=list)
    topic_pages: list[str] | None = None
    method: str = "text"
    warnings: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    ocr_confidence: float | None = None


class _Text(html.parser.HTMLParser):
    def __init__(self, blank: str | None = None):
        super().__init__()
        self.blank = blank
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip(self.blank):
            self.found.append(data)


def html_text(source: str, references: dict[str, str] | None = None) -> str:
    """Non-blank text nodes, a line each; those of script, style and title too.

    Where references are given, those alone are replaced, one after the other, in every node, and only nodes of ASCII white space are blank.
    """
    if references is None:
        parser = _Text()
        parser.feed(source)
        parser.close()
        return "\n".join(parser.found)
    mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in source)  # for the parser no reference begins
    parser = _Text(" \n\t\r")
    parser.feed(source.replace("&", mark))
    parser.close()
    text = "\n".join(parser.found).replace(mark, "&")
    for reference, character in references.items():
        text = text.replace(reference, character)
    return text


def plain_text(raw: bytes) -> str:
    """UTF-8, else UTF-16, else Latin-1; nothing if it looks binary."""
    head = raw[:4096]
    if b"\0" in head or head and sum(b < 32 and b not in (9, 10, 12, 13) for b in head) > 0.2 * len(head):
        return ""
    for encoding in ("utf-8", "utf-16"):
        try:
            return raw.decode(encoding)
        except UnicodeError:
            continue
    return raw.decode("latin-1")


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _nodes(root, name: str) -> list:
    return [n for n in root.iter() if _local(n) == name] if root is not None else []


def _xml_text(raw: bytes) -> str:
    words = []
    for node in ElementTree.fromstring(raw).iter():
        if _local(node) == "t" and node.text:
            words.append(node.text)
        elif _local(node) in ("p", "tr"):
            words.append("\n")
    return S.normalize(" ".join(words))


def docx(raw: bytes) -> Extracted:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if "word/document.xml" not in z.namelist():
            return Extracted("word_doc", [""], warnings=["no document part in the docx file"])
        return Extracted("word_doc", [_xml_text(z.read("word/document.xml"))], method="docx")


def pptx(raw: bytes) -> Extracted:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = sorted(n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml", n))
        slides = [(i, _xml_text(z.read(n))) for i, n in enumerate(names, 1)]
    return Extracted("presentation", ["\n\n".join(f"Slide {i}\n{t}" for i, t in slides if t.strip())], method="pptx")


def delimited(raw: bytes, name: str) -> Extracted:
    reader = csv.reader(io.StringIO(raw.decode("utf-8", errors="replace"), newline=""), delimiter="\t" if name.lower().endswith(".tsv") else ",")
    lines = [f"Row {i}: " + " | ".join(c.strip() for c in row) for i, row in enumerate(reader, 1)]
    return Extracted("spreadsheet", ["\n".join(lines)], method="csv", metadata={"sheet_names": PurePosixPath(name).stem})


def xlsx(raw: bytes) -> Extracted:
    """Sheets as ``Row n: A1: value | ...``; of a long sheet the first SHEET_ROWS rows, with a warning."""
    out = Extracted("spreadsheet", method="xlsx")
    lines, names = [], []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        parts = z.namelist()
        tree = lambda part: ElementTree.fromstring(z.read(part)) if part in parts else None
        strings = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _nodes(tree("xl/sharedStrings.xml"), "si")]
        book = tree("xl/workbook.xml")
        titles = [n.attrib["name"] for n in _nodes(book, "sheet") if n.attrib.get("name")]
        for i, part in enumerate(sorted(n for n in parts if re.match(r"xl/worksheets/sheet\d+\.xml", n))):
            names.append(titles[i] if i < len(titles) else f"Sheet{i + 1}")
            lines.append(f"Sheet: {names[-1]}")
            rows = _nodes(tree(part), "row")
            for k, row in enumerate(rows[:SHEET_ROWS], 1):
                cells = []
                for cell in (c for c in row if _local(c) == "c"):
                    value = next((v.text for v in cell if _local(v) == "v" and v.text is not None), "")
                    if cell.attrib.get("t") == "s" and value.isdigit() and int(value) < len(strings):
                        value = strings[int(value)]
                    if value:
                        cells.append(f"{cell.attrib.get('r', '')}: {value}")
                if cells:
                    lines.append(f"Row {int(float(row.attrib.get('r', k)))}: " + " | ".join(cells))
            if len(rows) > SHEET_ROWS:
                out.warnings.append(f"{names[-1]}: only the first {SHEET_ROWS} rows are indexed")
    out.pages, out.metadata = ["\n".join(lines)], {"sheet_names": ",".join(names)}
    return out


def mail(raw: bytes) -> Extracted:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    header = {k: str(message.get(k, "")) for k in ("from", "to", "cc", "subject", "message-id")}
    attached, bodies, warnings = [], [], []
    for part in message.walk() if message.is_multipart() else [message]:
        if message.is_multipart() and part.get_content_disposition() == "attachment":
            if part.get_filename():
                attached.append(part.get_filename())
        elif not message.is_multipart() or part.get_content_type() == "text/plain":
            try:
                bodies.append(str(part.get_content()))
            except (LookupError, KeyError, UnicodeError, AttributeError) as e:
                warnings.append(f"a body part could not be decoded: {e}")
    lines = [f"{k.capitalize()}: {header[k]}" for k in ("from", "to", "cc", "subject")] + [""]
    if attached:
        lines += ["Attachments: " + ", ".join(attached), ""]
    return Extracted("email", ["\n".join(lines + bodies)], method="email", warnings=warnings, metadata=header | {"attachments": ",".join(attached)})


def _run(command: list[str], seconds: int) -> bytes:
    return subprocess.run(command, capture_output=True, timeout=seconds, check=True).stdout


def pdf(raw: bytes) -> Extracted:
    """By pdftotext where it is installed; without text, pages are rendered and read as images."""
    if shutil.which("pdftotext") is None:
        return Extracted("pdf", [""], method="failed", warnings=["pdftotext is not installed"])
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(raw)
        f.flush()
        text = _run(["pdftotext", "-layout", f.name, "-"], 60).decode("utf-8", errors="replace")
        if text.strip():
            return Extracted("pdf", text.split("\f"), method="pdftotext", metadata={"pdf_backend": "pdftotext"})
        if shutil.which("pdftoppm") is None:
            return Extracted("pdf", [""], method="failed", warnings=["the pdf has no text and pdftoppm is not installed"])
        with tempfile.TemporaryDirectory() as folder:
            _run(["pdftoppm", "-r", "200", "-png", f.name, f"{folder}/page"], 180)
            from pathlib import Path

            read = [image(p.read_bytes()) for p in sorted(Path(folder).iterdir(), key=lambda p: int(re.sub(r"\D", "", p.stem) or 0))]
    known = [r.ocr_confidence for r in read if r.ocr_confidence is not None]
    return Extracted("pdf", [p for r in read for p in r.pages], method="ocr", warnings=[w for r in read for w in r.warnings], ocr_confidence=sum(known) / len(known) if known else None)


def image(raw: bytes) -> Extracted:
    """By tesseract where it is installed: its text, and the mean confidence of its words."""
    if shutil.which("tesseract") is None:
        return Extracted("image", [""], method="failed", warnings=["tesseract is not installed"])
    with tempfile.NamedTemporaryFile(suffix=".img") as f:
        f.write(raw)
        f.flush()
        text = _run(["tesseract", f.name, "stdout"], 120).decode("utf-8", errors="replace")
        rows = [r.split("\t") for r in _run(["tesseract", f.name, "stdout", "tsv"], 120).decode("utf-8", errors="replace").splitlines()[1:]]
    seen = [float(r[10]) for r in rows if len(r) > 11 and r[11].strip() and float(r[10]) >= 0]
    return Extracted("image", [text], method="ocr", ocr_confidence=min(1.0, max(0.0, sum(seen) / len(seen) / 100)) if seen else None)


#: Parsers by kind; a caller may put in others, for example another PDF reader.
PARSERS: dict[str, Callable[[bytes], Extracted]] = {"pdf": pdf, "image": image, "email": mail}


def _kind(name: str) -> str:
    suffix = PurePosixPath(name).suffix.lower()
    kinds = {"pdf": ".pdf", "email": ".eml .msg", "spreadsheet": ".csv .tsv .xls .xlsx", "word_doc": ".doc .docx .rtf", "presentation": ".ppt .pptx", "image": ".png .jpg .jpeg .gif .tif .tiff .bmp .webp", "html": ".html .htm", "text": ".txt .md .markdown .rst .json .jsonl .xml .yaml .yml .log"}
    return next((k for k, s in kinds.items() if suffix and suffix in s.split()), "unknown")


def extract(name: str, raw: bytes, parsers: dict[str, Callable[[bytes], Extracted]] | None = None) -> Extracted:
    """The text of one file.  A parser's failure is a warning on an empty result, never an end of the job."""
    kind, suffix = _kind(name), PurePosixPath(name).suffix.lower()
    try:
        if kind in (known := PARSERS | (parsers or {})):
            return known[kind](raw)
        if kind == "html":
            return Extracted(kind, [html_text(plain_text(raw))], method="html")
        if suffix in (".csv", ".tsv"):
            return delimited(raw, name)
        if suffix in (".xlsx", ".docx", ".pptx"):
            return {".xlsx": xlsx, ".docx": docx, ".pptx": pptx}[suffix](raw)
        if kind in ("spreadsheet", "word_doc", "presentation"):
            return Extracted(kind, [""], method="unsupported", warnings=[f"{suffix} files need an external converter"])
        return Extracted(kind, S.pages(plain_text(raw)))
    except Exception as e:  # one bad file must not stop a corpus
        return Extracted(kind, [""], method="failed", warnings=[f"{type(e).__name__}: {e}"])
