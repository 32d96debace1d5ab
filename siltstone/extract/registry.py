"""Which extractor reads a file, and the operator that runs them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from siltstone.extract import formats as fm
from siltstone.runtime import spread

Extractor = Callable[[bytes], Iterable]
SCHEMA = "path string, status string, line_number int, content string, anchor string, issue string, member string, extractor_id string"


class Registry:
    """Extensions to extractors; the last registration of an extension holds, unknown and missing extensions are plain text."""

    def __init__(self) -> None:
        self._by_extension: dict[str, tuple[str, Extractor]] = {}
        self.fallback: tuple[str, Extractor] = ("plain-text", fm.plain)

    def register(self, name: str, extensions: Iterable[str], extractor: Extractor) -> Registry:
        for e in extensions:
            self._by_extension[e.lower()] = (name, extractor)
        return self

    def of(self, path: str) -> tuple[str, Extractor]:
        name = path.replace("\\", "/").rpartition("/")[2]
        ext = "." + name.rpartition(".")[2].lower() if "." in name else ""
        return self._by_extension.get(ext, self.fallback)

    def member(self, ext: str) -> Extractor | None:
        """The reader of an archive's member; binary kinds without an extractor have none."""
        if ext in self._by_extension:
            return self._by_extension[ext][1]
        return None if ext in (".exe", ".dll", ".png", ".jpg", ".jpeg", ".gif", ".bin", ".mp3", ".mp4") else self.fallback[1]


def default_registry() -> Registry:
    r = Registry()
    r.register("html", (".html", ".htm"), fm.html_doc).register("xml-text", (".svg", ".xaml", ".resx"), fm.xml_doc).register("rtf", (".rtf",), fm.rtf)
    r.register("calendar-contact", (".ics", ".vcf"), fm.calendar).register("email", (".eml",), fm.eml).register("epub", (".epub",), fm.epub)
    r.register("open-document", (".odt", ".ods", ".odp"), fm.open_document).register("openxml-word", (".docx",), fm.word)
    r.register("excel", (".xlsx",), fm.excel).register("openxml-slides", (".pptx",), fm.slides)
    return r.register("zip", (".zip",), lambda data: fm.zipped(data, r.member))


def extract_files(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Lines of files ``path, content`` (binary): one row per line, and one row per issue or file without lines.

    ``status`` is ``ok``, ``skipped`` (null or no lines) or ``error`` (the extractor failed; the plain text fallback found nothing
    either). A failing file ends neither the task nor the job.
    """
    reg = registry or default_registry()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for path, data in zip(f["path"], f["content"], strict=True):
                if data is None:
                    rows.append((path, "skipped", None, None, None, "missing", None, None))
                    continue
                name, reader = reg.of(path)
                own, failed = [], None
                try:
                    for x in reader(bytes(data)):
                        own.append((path, "ok", None, None, None, x.code, x.member, name) if isinstance(x, fm.Issue) else (path, "ok", *x, None, None, name))
                except Exception as e:  # noqa: BLE001
                    failed = getattr(e, "code", type(e).__name__)
                if not any(r[2] for r in own) and failed:
                    own += [(path, "ok", *x, None, None, reg.fallback[0]) for x in fm.plain(bytes(data))]
                    if not any(r[2] for r in own):
                        own.append((path, "error", None, None, None, failed, None, name))
                elif not own:
                    own.append((path, "skipped", None, None, None, "no_text", None, name))
                rows += own
            yield pd.DataFrame(rows, columns=["path", "status", "line_number", "content", "anchor", "issue", "member", "extractor_id"]).astype({"line_number": "Int32"})

    return spread(files.select("path", "content")).mapInPandas(run, SCHEMA)
