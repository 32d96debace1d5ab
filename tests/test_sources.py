"""Journals and sub-word tokens."""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np

from siltstone.functions.wordpiece import WordPiece, pool
from siltstone.sources import journal

T = datetime(2030, 1, 1, tzinfo=UTC)


def test_records():
    data = journal.build_record(281474976710696, 5, 100, T, 0x100, "à.txt") + journal.build_record(2**100, 7, 200, T, 0x200, "b", 3)
    a, b = journal.parse_records(data)
    assert a == ("281474976710696", "5", 100, T, 0x100, 32, "à.txt", 2)
    assert b[0] == (2**100).to_bytes(16, "little").hex().upper() and b[2] == 200 and journal.action(b[4]) == "delete"
    assert list(journal.parse_records(data[:-9])) == [a] and list(journal.parse_records(b"")) == []


def test_journal_stream(spark, tmp_path):
    spark.dataSource.register(journal.ChangeJournal)
    (tmp_path / "j").mkdir()
    for k in range(2):
        (tmp_path / f"j/{k}.usn").write_bytes(b"".join(journal.build_record(i, 1, i, T, 0x100, f"f{i}") for i in range(k * 10, k * 10 + 10)))
    seen: list[list[int]] = []
    q = (
        spark.readStream.format("change_journal").option("path", str(tmp_path / "j")).option("maxRecords", 8).load()
        .writeStream.foreachBatch(lambda df, n: seen.append(sorted(r.usn for r in df.collect())))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    )
    try:
        import time

        for _ in range(60):
            time.sleep(1)
            if sum(map(len, seen)) >= 20:
                break
    finally:
        q.stop()
    assert [x for b in seen for x in b] == list(range(20)) and max(map(len, seen)) <= 8


def test_word_pieces():
    wp = WordPiece(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", ",", "##s"], most_tokens=6)
    assert wp.encode("Unaffable, Cafés") == [2, 4, 5, 6, 8, 3]
    assert wp.encode("zzz") == [2, 1, 3] and wp.encode(None) == [2, 3]
    v = pool(np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert np.allclose(v, [[0.5**0.5, 0.5**0.5]]) and np.allclose(pool(np.ones((1, 2, 2)), np.ones((1, 2)), "cls"), [[0.5**0.5] * 2])


def test_journal_reads_only_the_files_it_needs(tmp_path, monkeypatch):
    from datetime import datetime, timezone

    from siltstone.sources import journal

    t = datetime(2030, 1, 1, tzinfo=timezone.utc)
    for k in range(5):
        body = b"".join(journal.build_record(7, 5, 100 * k + i, t, 1, f"n{i}") for i in range(1, 11))
        (tmp_path / f"j{k}.usn").write_bytes(body)
    r = journal._Reader({"path": str(tmp_path), "maxRecords": "15"})
    opened: list[int] = []
    real = journal.parse_records
    monkeypatch.setattr(journal, "parse_records", lambda data: (opened.append(len(data)), real(data))[1])
    rows, end = r.read({"usn": 205})
    got = [x[2] for x in rows]
    assert got == [*range(206, 211), *range(301, 311)] and end == {"usn": 310}
    assert len(opened) == 5 + 2 + (end["usn"] > 310)  # five heads, two files
    opened.clear()
    assert [x[2] for x in r.readBetweenOffsets({"usn": 109}, {"usn": 202})] == [110, 201, 202] and len(opened) == 2
    assert list(r.read({"usn": 410})[0]) == []


def test_sheets_are_named_by_their_relationships():
    import io
    import zipfile

    from siltstone.extract import formats

    sheet = lambda t: f'<w><sheetData><row r="1"><c t="inlineStr"><is><t>{t}</t></is></c></row></sheetData></w>'
    parts = {
        "xl/workbook.xml": '<w xmlns:r="rel"><sheets><sheet name="Second" r:id="rId2"/><sheet name="First" r:id="rId1"/><sheet name="Gone" r:id="rId9"/></sheets></w>',
        "xl/_rels/workbook.xml.rels": '<R><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/other.xml"/></R>',
        "xl/worksheets/sheet1.xml": sheet("one"), "xl/worksheets/other.xml": sheet("two"),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    assert [r[1] for r in formats.excel(out.getvalue())] == ["[Second] two", "[First] one"]
