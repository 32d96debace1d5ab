"""Values of the field filters: sizes, dates, types, extensions; and their Columns."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.query.nodes import FileFilters

#: Aliases of ``type:`` and the extensions that make up the categories.
TYPE_ALIASES = {
    "pdf": (".pdf",),
    "word": (".doc", ".docx", ".rtf", ".odt"),
    "doc": (".doc", ".docx"),
    "docx": (".docx",),
    "powerpoint": (".ppt", ".pptx"),
    "presentation": (".ppt", ".pptx"),
    "ppt": (".ppt", ".pptx"),
    "excel": (".xls", ".xlsx", ".csv", ".tsv"),
    "spreadsheet": (".xls", ".xlsx", ".csv", ".tsv"),
    "xls": (".xls", ".xlsx"),
    "email": (".eml", ".msg"),
    "mail": (".eml", ".msg"),
    "epub": (".epub",),
    "text": (".txt", ".md", ".log"),
    "markdown": (".md", ".markdown"),
}
CATEGORY_EXTENSIONS = {
    "code": ".cs .fs .vb .js .jsx .ts .tsx .py .java .cpp .c .h .hpp .go .rs .php .rb .swift .kt .kts .sql .ps1 .sh .bat .cmd .json .xml .xaml .html .css .scss .yaml .yml".split(),
    "document": ".txt .md .rtf .pdf .doc .docx .odt .xls .xlsx .ppt .pptx .csv .tsv .epub .eml .ics .vcf".split(),
    "image": ".png .jpg .jpeg .gif .bmp .webp .tif .tiff .svg .ico".split(),
    "audio": ".mp3 .wav .flac .aac .ogg .m4a .wma".split(),
    "video": ".mp4 .mov .mkv .avi .wmv .webm .m4v".split(),
    "archive": ".zip .7z .rar .tar .gz .bz2 .xz".split(),
    "application": ".exe .dll .msi .appx".split(),
}
CATEGORIES = (*CATEGORY_EXTENSIONS, "other")
_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4}


def values(text: str) -> list[str]:
    """Parts of a multi-value, without blanks and without repetitions in another case."""
    out: dict[str, str] = {}
    for part in re.split("[,;]", text):
        if part.strip():
            out.setdefault(part.strip().lower(), part.strip())
    return list(out.values())


def extension(text: str) -> str:
    x = text.strip().lstrip("*").lower()
    return x if x.startswith(".") else f".{x}"


def size_bytes(text: str) -> int:
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([a-zA-Z]*)\s*", text)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"invalid size '{text}'")
    try:
        return int(Decimal(m[1]) * 1024 ** _UNITS[m[2].lower()])
    except InvalidOperation as e:
        raise ValueError(f"invalid size '{text}'") from e


def size_range(text: str) -> tuple[int | None, int | None]:
    """Inclusive bounds; ``>`` and ``<`` include their value."""
    t = text.strip()
    if not t:
        raise ValueError("a size filter requires a value")
    if ".." in t:
        lo, _, hi = t.partition("..")
        return (size_bytes(lo) if lo else None, size_bytes(hi) if hi else None)
    m = re.match("[<>]=?", t)
    if m:
        n = size_bytes(t[m.end() :])
        return (n, None) if t[0] == ">" else (None, n)
    n = size_bytes(t)
    return n, n


def _day(text: str) -> date:
    t = text.strip()
    if re.fullmatch(r"\d{4}", t):
        return date(int(t), 1, 1)
    return date.fromisoformat(t)


def _months_back(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 - n, 12)
    for day in range(d.day, 27, -1):
        try:
            return date(y, m + 1, day)
        except ValueError:
            continue
    return date(y, m + 1, min(d.day, 28))


def _season(word: str, today: date) -> tuple[date, date] | None:
    which, _, name = word.partition("-")
    year = today.year - (which == "last")
    first_last = {"spring": ((3, 1), (5, 31)), "summer": ((6, 1), (9, 30)), "autumn": ((9, 1), (11, 30)), "fall": ((9, 1), (11, 30))}
    if which not in ("last", "this"):
        return None
    if name == "winter":
        return date(year, 12, 1), date(year + 1, 2, 28)
    if name in first_last:
        a, b = first_last[name]
        return date(year, *a), date(year, *b)
    return None


def date_range(text: str, today: date) -> tuple[datetime | None, datetime | None]:
    """``[from, before)`` of a date filter in UTC; days count as a whole, so ``<D`` includes D and ``>D`` as well."""
    t = text.strip().lower()
    if not t:
        raise ValueError("a date filter requires a value")
    lo: date | None
    hi: date | None
    relative = {
        "today": (today, today),
        "yesterday": (today - timedelta(1), today - timedelta(1)),
        "this-week": (today - timedelta(today.weekday()), today),
        "last-week": (today - timedelta(7), today),
        "last-month": (_months_back(today, 1), today),
        "last-year": (_months_back(today, 12), today),
        "this-month": (today.replace(day=1), today),
        "this-year": (today.replace(month=1, day=1), today),
    }
    if ".." in t:
        a, _, b = t.partition("..")
        lo, hi = (_day(a) if a else None), (_day(b) if b else None)
    elif t[0] in "<>":
        d = _day(t.lstrip("<>="))
        lo, hi = (d, None) if t[0] == ">" else (None, d)
    elif t in relative:
        lo, hi = relative[t]
    elif season := _season(t, today):
        lo, hi = season
    elif re.fullmatch(r"\d{4}", t):
        lo, hi = date(int(t), 1, 1), date(int(t), 12, 31)
    else:
        lo = hi = _day(t)
    at = lambda d: datetime(d.year, d.month, d.day)
    return (at(lo) if lo else None, at(hi + timedelta(1)) if hi else None)


def narrow(f: FileFilters, name: str, value: str, today: date) -> None:
    """Adds one field filter; repeated ranges intersect."""
    later = lambda a, b: b if a is None else a if b is None else max(a, b)
    earlier = lambda a, b: b if a is None else a if b is None else min(a, b)
    if name in ("name", "path", "folder", "root", "status", "extractor"):
        have = getattr(f, name)
        have += [v for v in values(value) if v.lower() not in {x.lower() for x in have}]
    elif name == "ext":
        f.extensions += [e for e in map(extension, values(value)) if len(e) > 1 and e not in f.extensions]
    elif name == "type":
        for v in values(value):
            if v.lower() in TYPE_ALIASES:
                f.type_extensions += [e for e in TYPE_ALIASES[v.lower()] if e not in f.type_extensions]
            elif v.lower() in CATEGORIES:
                f.categories += [v.lower()] if v.lower() not in f.categories else []
            else:
                f.type_extensions += [extension(v)] if extension(v) not in f.type_extensions else []
    elif name == "size":
        lo, hi = size_range(value)
        f.size_min, f.size_max = later(f.size_min, lo), earlier(f.size_max, hi)
    elif name in ("modified", "created"):
        lo, hi = date_range(value, today)
        setattr(f, f"{name}_from", later(getattr(f, f"{name}_from"), lo))
        setattr(f, f"{name}_before", earlier(getattr(f, f"{name}_before"), hi))
    else:
        raise ValueError(f"unknown field '{name}'")


def category(ext: Column) -> Column:
    """The class of an extension (with its dot, in lower case)."""
    out = F.lit("other")
    for name, exts in reversed(CATEGORY_EXTENSIONS.items()):
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return out


def has(c: Column, term: str) -> Column:
    return F.contains(F.lower(c), F.lit(term.lower()))


def _all(c: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & has(c, t)
    return out


def _in_folder(term: str) -> Column:
    return F.exists(F.split(F.col("rel_dir"), "/"), lambda s: has(s, term)) | has(F.col("directory"), term)


def to_column(f: FileFilters) -> Column:
    """Over the columns of a files table: ``path, root, rel_path, rel_dir, directory, file_name, stem, ext, size_bytes, modified, created, status, extractor_id``.

    Null and unknown dates and sizes fail their filters.
    """
    c = F.col
    out = F.lit(True)
    if f.name:
        out = out & (_all(c("file_name"), f.name) | _all(c("stem"), f.name))
    if f.path:
        out = out & (_all(c("path"), f.path) | _all(c("rel_path"), f.path))
    for t in f.folder:
        out = out & _in_folder(t)
    if f.root:
        out = out & (_all(c("root"), f.root) | _all(F.substring_index("root", "/", -1), f.root))
    if f.extensions:
        out = out & F.lower(c("ext")).isin(*f.extensions)
    if f.type_extensions:
        out = out & F.lower(c("ext")).isin(*f.type_extensions)
    if f.categories:
        out = out & category(F.lower(c("ext"))).isin(*f.categories)
    if f.size_min is not None:
        out = out & (c("size_bytes") >= f.size_min)
    if f.size_max is not None:
        out = out & (c("size_bytes") <= f.size_max)
    for name in ("modified", "created"):
        lo, hi = getattr(f, f"{name}_from"), getattr(f, f"{name}_before")
        if lo is not None:
            out = out & (c(name) >= F.lit(lo))
        if hi is not None:
            out = out & (c(name) < F.lit(hi))
    return out & _all(c("status"), f.status) & _all(c("extractor_id"), f.extractor)
