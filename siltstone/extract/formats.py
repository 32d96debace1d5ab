"""Extractors: bytes in, ``(line_number, content, anchor)`` rows and issues out."""

from __future__ import annotations

import io
import quopri
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from email.header import decode_header, make_header

from siltstone.extract.markup import from_html, from_xml, squeeze

Row = tuple[int, str, str]
#: Limits.
SNIFF, RTF_CHARS = 8192, 10 * 1024 * 1024
ENTRY_BYTES, TOTAL_BYTES, MOST_ENTRIES = 16 * 1024 * 1024, 64 * 1024 * 1024, 10_000
_BOMS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


class Issue(Exception):
    """Something that kept a file or member from being read in full."""

    def __init__(self, code: str, member: str = "", message: str = ""):
        super().__init__(code)
        self.code, self.member, self.message = code, member, message


def decode(data: bytes) -> str:
    """Text of bytes by their byte order mark, else UTF-8 with replacement."""
    for mark, name in _BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


def is_binary(data: bytes) -> bool:
    return not any(data.startswith(m) for m, _ in _BOMS) and b"\0" in data[:SNIFF]


def cut(text: str) -> list[str]:
    parts = re.split(r"\r\n|\r|\n", text)
    return parts[:-1] if parts and not parts[-1] else parts


def plain(data: bytes) -> Iterator[Row]:
    if not is_binary(data):
        for n, line in enumerate(cut(decode(data)), 1):
            yield n, line, ""


def _one(text: str) -> Iterator[Row]:
    if text:
        yield 1, text, ""


def html_doc(data: bytes) -> Iterator[Row]:
    return _one(from_html(decode(data)))


def xml_doc(data: bytes) -> Iterator[Row]:
    return _one(from_xml(decode(data)))


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict"}


def rtf(data: bytes) -> Iterator[Row]:
    text = data[:RTF_CHARS].decode("latin-1")
    out, stack, skip, opened = [], [], False, False
    for m in _RTF.finditer(text):
        hexed, uni, word, _, mark, brace, run = m.groups()
        if brace == "{":
            stack.append(skip)
            opened = True
            continue
        if brace == "}":
            skip = stack.pop() if stack else False
        elif mark == "*" and opened or word in _RTF_SKIP and opened:
            skip = True
        elif not skip:
            if hexed:
                out.append(bytes([int(hexed, 16)]).decode("cp1252", "replace"))
            elif uni:
                out.append(chr(int(uni) % 65536))
            elif word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif mark and mark in "{}\\":
                out.append(mark)
            elif run:
                out.append(run)
        opened = False
    for n, line in enumerate((x for x in (squeeze(x) for x in "".join(out).split("\n")) if x), 1):
        yield n, line, ""


def calendar(data: bytes) -> Iterator[Row]:
    """Calendar and contact files: continued lines joined, frame lines left out, escapes undone."""
    n = 0
    for line in cut(re.sub(r"\r?\n[ \t]", "", decode(data))):
        if line.strip() and not re.match(r"(BEGIN|END|VERSION|PRODID)\b", line, re.I):
            n += 1
            yield n, line.replace("\\n", " ").replace("\\N", " ").replace("\\,", ",").replace("\\;", ";").replace("\\\\", "\\"), ""


def eml(data: bytes) -> Iterator[Row]:
    """Subject, From, To and Cc, then the text parts; attachments are left out and base64 bodies stay as they are."""
    out: list[str] = []

    def part(raw: str, top: bool) -> None:
        head, _, body = raw.replace("\r\n", "\n").partition("\n\n")
        fields: dict[str, str] = {}
        for line in re.sub(r"\n[ \t]+", " ", head).split("\n"):
            k, sep, v = line.partition(":")
            if sep:
                fields.setdefault(k.strip().lower(), v.strip())
        if top:
            for k in ("subject", "from", "to", "cc"):
                if k in fields:
                    try:
                        value = str(make_header(decode_header(fields[k])))
                    except (LookupError, UnicodeError, ValueError):
                        value = fields[k]
                    out.append(f"{k.capitalize()}: {value}")
        kind = fields.get("content-type", "text/plain")
        bound = re.search(r'boundary="?([^";]+)"?', kind, re.I)
        if kind.lower().startswith("multipart/") and bound:
            for p in body.split("--" + bound[1])[1:]:
                if not p.startswith("--"):
                    part(p.lstrip("\n"), False)
            return
        if "attachment" in fields.get("content-disposition", "").lower() or not kind.lower().startswith("text/"):
            return
        if fields.get("content-transfer-encoding", "").lower() == "quoted-printable":
            charset = re.search(r'charset="?([^";\s]+)"?', kind, re.I)
            try:
                body = quopri.decodestring(body.encode("utf-8", "replace")).decode(charset[1] if charset else "utf-8", "replace")
            except LookupError:
                body = quopri.decodestring(body.encode("utf-8", "replace")).decode("utf-8", "replace")
        out.extend([from_html(body)] if "html" in kind.lower() else [x for x in cut(body) if x.strip()])

    part(decode(data), True)
    for n, line in enumerate(out, 1):
        yield n, line, ""


def _archive(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Issue("unreadable", message=str(e)) from e


def epub(data: bytes) -> Iterator[Row]:
    n = 0
    with _archive(data) as z:
        for name in z.namelist():
            if not name.startswith("META-INF/") and re.search(r"\.(x?html?|xml)$", name, re.I):
                text = from_html(decode(z.read(name)))
                if text:
                    n += 1
                    yield n, f"[{name}] {text}", name


def open_document(data: bytes) -> Iterator[Row]:
    with _archive(data) as z:
        if "content.xml" in z.namelist():
            yield from _one(from_xml(decode(z.read("content.xml"))))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def word(data: bytes) -> Iterator[Row]:
    n = 0
    with _archive(data) as z:
        for p in ET.fromstring(z.read("word/document.xml")).iter():
            if _local(p.tag) == "p":
                text = "".join("\t" if _local(t.tag) == "tab" else t.text or "" for t in p.iter() if _local(t.tag) in ("t", "tab"))
                if text.strip():
                    n += 1
                    yield n, text, f"paragraph {n}"


def _sheets(z: zipfile.ZipFile, names: list[str]) -> list[tuple[str, str]]:
    """``(part, name)`` of the sheets in the order of the book: by relationship, or by number where a book has no relationships."""
    book = [s for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    found = sorted((x for x in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.findall(r"\d+", x)[0]))
    if "xl/_rels/workbook.xml.rels" not in names:
        called = [s.get("name", "") for s in book]
        return list(zip(found, [*called, *found[len(called) :]], strict=False))
    target = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in book:
        to = target.get(next((v for k, v in s.attrib.items() if _local(k) == "id"), None))
        part = None if to is None else to.lstrip("/") if to.startswith("/") else f"xl/{to}"
        if part in names:
            out.append((part, s.get("name", "")))
    return out


def excel(data: bytes) -> Iterator[Row]:
    n = 0
    with _archive(data) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        sheets = _sheets(z, names)
        for sheet, name in sheets:
            for row in ET.fromstring(z.read(sheet)).iter():
                if _local(row.tag) != "row":
                    continue
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    if c.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                        v = shared[int(v)]
                    elif c.get("t") == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    cells.append(v)
                if any(cells):
                    n += 1
                    yield n, f"[{name}] " + "\t".join(cells), f"sheet {name} row {row.get('r', '')}"


def slides(data: bytes) -> Iterator[Row]:
    n = 0
    with _archive(data) as z:
        for kind, label in (("slides/slide", "Slide {}"), ("notesSlides/notesSlide", "Slide {} Notes")):
            own = [x for x in z.namelist() if re.fullmatch(rf"ppt/{kind}\d+\.xml", x)]
            for name in sorted(own, key=lambda x: int(re.findall(r"\d+", x)[0])):
                at = label.format(re.findall(r"\d+", name)[0])
                for t in ET.fromstring(z.read(name)).iter():
                    if _local(t.tag) == "t" and (t.text or "").strip():
                        n += 1
                        yield n, f"[{at}] {t.text}", at


def zipped(data: bytes, by_extension) -> Iterator[Row | Issue]:
    """Members after a header line each; the caps hold for the bytes really read."""
    n = total = 0
    with _archive(data) as z:
        for i, info in enumerate(z.infolist()):
            if info.is_dir():
                continue
            if i >= MOST_ENTRIES:
                yield Issue("archive_max_entries_exceeded")
                return
            ext = re.search(r"\.[^./]+$", info.filename.lower())
            ext = ext[0] if ext else ""
            reader = by_extension(ext)
            if info.flag_bits & 1:
                code = "archive_member_encrypted"
            elif info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                code = "archive_member_unsupported_compression"
            elif ext == ".zip":
                code = "archive_member_nested_archive_disabled"
            elif reader is None:
                code = "archive_member_unsupported_type"
            elif info.file_size > ENTRY_BYTES:
                code = "archive_member_too_large"
            else:
                code = ""
            if code:
                yield Issue(code, info.filename)
                continue
            try:
                with z.open(info) as h:
                    body = h.read(ENTRY_BYTES + 1)
                if len(body) > ENTRY_BYTES:
                    yield Issue("archive_member_too_large", info.filename)
                    continue
                total += len(body)
                if total > TOTAL_BYTES:
                    yield Issue("archive_total_bytes_exceeded")
                    return
                rows = list(reader(body))
            except (EOFError, zipfile.BadZipFile) as e:
                yield Issue("archive_member_truncated" if "truncated" in str(e).lower() or isinstance(e, EOFError) else "archive_member_unreadable", info.filename)
                continue
            except Exception:  # noqa: BLE001  (one member must not end the archive)
                yield Issue("archive_member_unreadable", info.filename)
                continue
            n += 1
            yield n, f"=== {info.filename} ===", info.filename
            for _, text, _a in rows:
                n += 1
                yield n, text, info.filename
