"""Text garbled by a wrong character encoding: detection and restoration.

Best-first graph search. A state is a text; its edges encode it with the encoding
it was wrongly read in and decode the bytes with another, unescape character
references, or give characters up as lost. States are visited once (by hash), the cheapest first, where the cost
is how implausible the text's characters are in their places. The plausibility is
counted over all documents: how often a character outside ASCII stands between
its two neighbours, in bits. Control characters, the replacement character and a question mark
inside a word have a fixed high cost; a character given up has a lower one, so a text that can't be had in full ends
in a state with marks for what is lost, reached by the same search.

The work is shared out so that each piece is done once:

1. one scan collects the words with characters outside ASCII (or a lost one), counted per task
   and then over the corpus;
2. their character triples give the plausibility model: counts of all triples in a hashed table of fixed size;
3. every distinct word is searched once; words that another reading makes plainly more
   plausible go into a Bloom filter of fixed size;
4. a second scan takes the documents with such a word and decides passage by passage: all
   readings found for its words compete on the whole passage; unless one of them holds and leaves no suspicious word, the passage
   itself is searched as well. A passage is a line, or a sentence of a line that was garbled only in part.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import Scratch, spread

#: Cells of the hashed tables of triples, of pairs and of characters. All are counted; two that share a cell share its count.
TRIPLE_CELLS, PAIR_CELLS, CHARACTER_CELLS = 1 << 21, 1 << 19, 1 << 17
#: Bits of the filter of suspicious words (8 MB).
FILTER_BITS = 1 << 26
#: Cost in bits of characters that no plain text has.
BROKEN, UNSEEN = 22.0, 27.0
#: Cost of a character that stands nowhere in the corpus: dearer than one that is new in its place, since decoding several into one makes fewer of them.
FOREIGN = 40.0
#: What stands for a lost character, and its cost.
MARK, LOST = "\ue0ff", 8.0
#: Least gain in bits, and as a share of the cost, for a reading to hold: for one that ends in UTF-8 and for any other.
HOLDS_UTF8, HOLDS_OTHER = (4.0, 0.15), (9.0, 0.22)
#: Gain in bits from which a word makes its passage worth a search; it must also be the least share of the word's cost that lets a reading hold,
#: since a passage's gain can't be a greater share of its cost than that of each of its words.
SUSPECT = 3.0
#: Encodings that texts are wrongly read in, and encodings that they were written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp852", "iso8859-2", "koi8-r", "cp866", "cp1254", "iso8859-15", "gb18030", "cp932", "big5", "euc_kr", "euc_jp")
WRITTEN_IN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "mac_roman", "cp437", "cp850", "cp852", "cp1251", "koi8-r", "cp866", "cp932", "euc_jp", "gb18030")

_QUESTION = re.compile(r"(?:(?<=[^\W\d_])|(?<![^\s“\"(]))\?(?=[^\W\d_])")
_BROKEN = re.compile("[\ufffd\x80-\x9f]")
_ESCAPE = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+\d?);")
#: Words end at ASCII white space only: U+00A0 and U+0085 are halves of common garbles. The other white space that str.split() knows.
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r\x1c-\x1f]+")
_OTHER_SPACE = "\xa0\x85\u3000\u2028\u2029\u202f\u205f\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")


def _passthrough(name: str) -> tuple[str, dict]:
    """A single-byte table in which undefined bytes stand for the control characters of their number."""
    table = "".join(bytes([i]).decode(name, "replace") for i in range(256))
    table = "".join(chr(i) if c == "\ufffd" else c for i, c in enumerate(table))
    return table, codecs.charmap_build(table)


_TABLES = {n: _passthrough(n) for n in ("cp1252", "cp1250", "cp1251", "cp1254")}


def encode(text: str, name: str) -> bytes:
    if name in _TABLES:
        return codecs.charmap_encode(text, "strict", _TABLES[name][1])[0]
    return text.encode(name)


def decode(data: bytes, name: str) -> str:
    if name in _TABLES:
        return codecs.charmap_decode(data, "strict", _TABLES[name][0])[0]
    return data.decode(name)


def _class(c: str) -> str:
    if c.isdigit():
        return "0"
    if c.isascii() and not c.isalpha() or c in ("\ufffd", MARK) or "\x80" <= c <= "\x9f":
        return " "  # what is broken says nothing about its neighbours, before and after it is given up
    return c.lower()


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        self[code] = x = _class(chr(code))[:1]
        return x


_CLASSES = _Classes()
_HIGH = re.compile(r"[^\x00-\x7f]")


def triples(word: str) -> Iterator[str]:
    """The characters outside ASCII of a word, each between its neighbours."""
    w = f" {word} "
    near = w.translate(_CLASSES)
    for m in _HIGH.finditer(w):
        i = m.start()
        yield near[i - 1] + w[i] + near[i + 1]


def _lost(word: str) -> int:
    """Question marks of a word that stand where a letter should; those of addresses and of encoded header words are proper."""
    return 0 if "/" in word or word.startswith("=?") else len(_QUESTION.findall(word))


def give_up(text: str) -> str:
    """The text with a mark for each character that is lost."""
    text = _BROKEN.sub(MARK, text)
    return _WORD.sub(lambda m: _QUESTION.sub(MARK, m.group()) if _lost(m.group()) else m.group(), text) if "?" in text else text


def _whole(text: str) -> bool:
    return MARK not in text and not _BROKEN.search(text) and ("?" not in text or not any(map(_lost, _WORD.findall(text))))


def _cells(t: str) -> tuple[int, int, int, int]:
    """Where a triple, its left and right pair and its character are counted."""
    h = xxhash.xxh3_64_intdigest
    return h(t) % TRIPLE_CELLS, h("<" + t[:2]) % PAIR_CELLS, h(">" + t[1:]) % PAIR_CELLS, h(t[1]) % CHARACTER_CELLS


class Plausibility:
    """Costs in bits from counted triples, given as a dictionary or as the table of their cells."""

    def __init__(self, counts: dict[str, int] | tuple[np.ndarray, ...]):
        if isinstance(counts, dict):
            tables = tuple(np.zeros(n, dtype=np.int64) for n in (TRIPLE_CELLS, PAIR_CELLS, PAIR_CELLS, CHARACTER_CELLS))
            for t, n in counts.items():
                if len(t) == 3:
                    for table, cell in zip(tables, _cells(t), strict=True):
                        table[cell] += n
            counts = tables
        self.tables = counts
        self.total = int(counts[3].sum()) + 1
        self._of: dict[str, float] = {}

    def triple(self, t: str) -> float:
        got = self._of.get(t)
        if got is None:
            c = t[1]
            if c == MARK:
                got = LOST
            elif c == "\ufffd" or "\x80" <= c <= "\x9f":
                got = BROKEN
            else:
                own, left, right, m = (int(table[cell]) for table, cell in zip(self.tables, _cells(t), strict=True))
                n = own * 0.9 + left * right / m * 0.08 + m * 0.0005 if m else 0.0
                got = min(UNSEEN, float(np.log2(self.total / (n + self.total * 2.0**-UNSEEN)))) if m else FOREIGN
            if len(self._of) > 400_000:
                self._of.clear()
            self._of[t] = got
        return got

    def cost(self, text: str, most: float = 1e18) -> float:
        total = BROKEN * sum(map(_lost, _WORD.findall(text))) if "?" in text else 0.0
        if text.isascii():
            return total
        known, triple = self._of.get, self.triple
        for t in triples(text):
            c = known(t)
            total += triple(t) if c is None else c
            if total > most:
                return total
        return total


_WIDE = ("gb18030", "cp932", "big5", "euc_kr", "euc_jp")
_NARROW = tuple(e for e in READ_AS if e not in _WIDE)
#: Characters outside ASCII that each single-byte encoding has.
_HAS = {e: frozenset(c for c in decode(bytes(range(128, 256)), e)) if e in _TABLES else frozenset(bytes([i]).decode(e, "ignore") for i in range(128, 256)) for e in _NARROW}


def _bytes(text: str, high: set[str]) -> Iterator[tuple[str, bytes]]:
    tried: set[bytes] = set()
    for e in READ_AS:
        if e in _HAS and not high <= _HAS[e]:
            continue
        try:
            data = encode(text, e)
            if e in _WIDE and decode(data, e) != text:
                continue  # some wide encodings have no way back for some characters
        except (UnicodeError, LookupError):
            continue
        if data not in tried:
            tried.add(data)
            yield e, data


def _edges(text: str, seen: set[int], steps: tuple) -> Iterator[tuple[tuple[str, ...], str]]:
    """Readings one step away. A chain has one reading between two other encodings than UTF-8, its first: two of them
    are one table again, and rounds of wrong reading need bytes that any encoding accepts and UTF-8 gives back. Characters
    that such a reading breaks aren't lost but speak against it, so nothing is given up after one."""
    first = not any(len(s) == 2 for s in steps)
    if "&" in text and _ESCAPE.search(text):
        plain = html.unescape(text)
        if plain != text:
            yield ("unescape",), plain
    if ("?" in text or _BROKEN.search(text)) and all(s[-1] in ("utf-8", "unescape", "lost") for s in steps):
        marked = give_up(text)
        if marked != text:
            yield ("lost",), marked
    high = {c for c in text if c > "\x7f"}
    if not high:
        return
    mostly = 3 * sum(c > "\x7f" for c in text) >= len(text)
    for e, data in _bytes(text, high):
        for d in WRITTEN_IN if first else WRITTEN_IN[:1]:
            if d == e or d != "utf-8" and (e in _WIDE or d in _WIDE) and not mostly:
                continue
            try:
                out = decode(data, d)
            except (UnicodeError, LookupError):
                continue
            h = hash(out)
            if h not in seen:
                seen.add(h)
                yield (e, d), out


def search(text: str, model: Plausibility, accept: Callable[[tuple, float, float], bool] | None = None, known: float = 1e18) -> tuple[str, tuple[tuple[str, ...], ...], float, float]:
    """The cheapest reachable text: ``(text, steps, cost, cost of the input)``; no steps if the input is the cheapest.

    Every reading joins the queue, dearer ones as well, since a step may make a text worse before the next makes it better; the search ends once the
    cheapest state left costs over ``BROKEN`` more than the best. Chains end by themselves: decoding UTF-8, unescaping and giving up leave less to
    do. ``known`` is the cost of a reading that is at hand already: what isn't cheaper is no result. ``accept`` says of ``steps, cost, cost of the input`` whether a reading may be the result.
    """
    start = model.cost(text)
    best, least = (start, text, ()), min(start, known)
    seen = {hash(text)}
    front: list[tuple[float, int, str, tuple]] = [(start, 0, text, ())]
    while front:
        cost, _, now, steps = heapq.heappop(front)
        if steps and cost > least + BROKEN:
            break
        for step, out in _edges(now, seen, steps):
            c = model.cost(out, least + BROKEN)
            chain = (*steps, step)
            if c < least and (accept is None or accept(chain, c, start)):
                best, least = (c, out, chain), c
            if c <= least + BROKEN:
                heapq.heappush(front, (c, len(seen), out, chain))
    return best[1], best[2], best[0], start


def _only_unescaped(steps: tuple) -> bool:
    return bool(steps) and all(s == ("unescape",) for s in steps)


def holds(steps: tuple, cost: float, start: float) -> bool:
    """Whether the gain of a reading is beyond chance; unescaping alone restores no wrong encoding."""
    if ("lost",) in steps:
        return start - cost >= BROKEN - LOST
    if not any(len(s) == 2 for s in steps):
        return False
    least, share = HOLDS_UTF8 if any(s[-1] == "utf-8" for s in steps) else HOLDS_OTHER
    return start - cost >= least and start - cost >= share * start


def suspicious(steps: tuple, gain: float, start: float) -> bool:
    return bool(steps) and gain >= SUSPECT and (("lost",) in steps or gain >= min(HOLDS_UTF8[1], HOLDS_OTHER[1]) * start)


def apply(text: str, steps: tuple) -> str | None:
    for s in steps:
        try:
            text = html.unescape(text) if s[0] == "unescape" else give_up(text) if s[0] == "lost" else decode(encode(text, s[0]), s[1])
        except (UnicodeError, LookupError):
            return None
    return text


def words_of(text: str) -> list[str]:
    """Words that could be garbled: with a character outside ASCII, a lost one, or a reference to one."""
    own = _WORD.findall(text) if any(c in text for c in _OTHER_SPACE) else text.split()
    return [w for w in own if not w.isascii() or ("?" in w and _lost(w)) or ("&" in w and _ESCAPE.search(w))]


_COULD = r"[^\x00-\x7F]|\p{L}\?\p{L}|(?:^|[\s\x1c-\x1f])[(\x22]?\?\p{L}|&[#a-zA-Z0-9]+;"


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: in how many documents each word that could be garbled stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(set(words_of(t)))
            if len(counts) > 200_000:
                yield send()
                counts.clear()
        yield send()

    return spread(docs.where(F.col(text).rlike(_COULD)).select(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_cells(words: DataFrame) -> DataFrame:
    """``table, cell, n``: the counts of all triples of the words, of their pairs and their characters, as cells of the hashed tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def send() -> pd.DataFrame:
            cells: Counter[tuple[int, int]] = Counter()
            for t, n in counts.items():
                for i, c in enumerate(_cells(t)):
                    cells[i, c] += n
            return pd.DataFrame({"table": [k[0] for k in cells], "cell": [k[1] for k in cells], "n": list(cells.values())})

        for f in frames:
            for w, n in zip(f["word"], f["n"], strict=True):
                for t in triples(w):
                    counts[t] += n
            if len(counts) > 200_000:
                yield send()
                counts.clear()
        if counts:
            yield send()

    return words.mapInPandas(run, "table int, cell int, n long").groupBy("table", "cell").agg(F.sum("n").alias("n"))


def _bit(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % FILTER_BITS


def _judge(passage: str, model: Plausibility, known: dict[str, tuple]) -> list[tuple[str, str | None, str]]:
    """``(passage, restored, steps)`` for what is garbled in a passage; restored is None where it can't be had in full."""
    words = words_of(passage)
    if not words:
        return []

    def of(w: str) -> tuple[tuple, float]:
        if w not in known:
            if len(known) > 100_000:
                known.clear()
            _, steps, cost, start = search(w, model)
            known[w] = (steps, start - cost) if suspicious(steps, start - cost, start) else ((), 0.0)
        return known[w]

    def suspected(text: str) -> bool:
        return any(steps and not _only_unescaped(steps) for steps, _ in map(of, words_of(text)))

    if not suspected(passage):
        return []
    for_steps: dict[tuple, float] = {}
    most = 0.0
    for steps, gain in map(of, words):
        if steps:
            for_steps[steps] = for_steps.get(steps, 0.0) + gain
            most += gain
    start = model.cost(passage)
    # no reading of the whole gains more than each word's best, so where that is too little only its parts can be garbled
    hopeless = most < min(HOLDS_UTF8[1], HOLDS_OTHER[1]) * start and not any(("lost",) in steps for steps in for_steps)
    # unescaping alone may be the result: then the passage holds an escape and nothing garbled
    fits = lambda steps, c, s: _only_unescaped(steps) or holds(steps, c, s)
    best: tuple[float, tuple, str] | None = None
    for steps in sorted(for_steps, key=lambda s: -for_steps[s]) if not hopeless else ():
        out = apply(passage, steps)
        if out is not None and out != passage:
            cost = model.cost(out, best[0] if best else start)
            if fits(steps, cost, start) and cost < (best[0] if best else start):
                best = (cost, steps, out)
    if not hopeless and (not best or not _whole(best[2]) or suspected(best[2])):
        out, steps, cost, _ = search(passage, model, fits, best[0] if best else 1e18)
        if steps:
            best = (cost, steps, out)
    parts = _SENTENCE.split(passage)
    if best and not (("lost",) in best[1] and len(parts) > 1):
        return [] if _only_unescaped(best[1]) else [(passage, best[2] if _whole(best[2]) else None, " ".join(">".join(s) for s in best[1]))]
    if len(parts) > 1:
        return [x for p in parts for x in _judge(p, model, known)]
    # a sentence garbled in part: its words one by one
    for w in dict.fromkeys(words):
        (steps, gain), s = of(w), model.cost(w)
        if steps and holds(steps, s - gain, s) and gain >= 2 * HOLDS_OTHER[0]:
            return [(passage, None, " ".join(">".join(x) for x in steps))]
    return []


def garbled_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, passage_no, passage, restored, steps`` of every garbled passage; ``passage_no`` counts lines from 1.

    ``restored`` is null where characters were lost. Null, empty and pure ASCII texts without lost
    characters have no passages. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    words = scratch.keep(count_words(docs, text))
    tables = tuple(np.zeros(n, dtype=np.int64) for n in (TRIPLE_CELLS, PAIR_CELLS, PAIR_CELLS, CHARACTER_CELLS))
    cells = count_cells(words).toPandas()  # at most one row a cell
    for i, table in enumerate(tables):
        own = cells[cells.table == i]
        table[own.cell.to_numpy()] = own.n.to_numpy()
    model = spark.sparkContext.broadcast(tables)

    def suspects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs = Plausibility(model.value)
        for f in frames:
            hit = []
            for w in f["word"]:
                _, steps, cost, start = search(w, costs)
                if not _only_unescaped(steps) and suspicious(steps, start - cost, start):
                    hit.append(_bit(w))
            yield pd.DataFrame({"bit": np.array(hit, dtype=np.int64)})

    bits = words.repartition(max(8, spark.sparkContext.defaultParallelism)).select("word").mapInPandas(suspects, "bit long")
    # one byte-packed block per 2**13 bits: what reaches the driver is at most the filter itself
    blocks = bits.distinct().groupBy((F.col("bit") / 8192).cast("long").alias("block")).agg(F.collect_set((F.col("bit") % 8192).cast("int")).alias("own"))
    packed = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in blocks.toLocalIterator():
        at = r.block * 8192 + np.array(r.own, dtype=np.int64)
        np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
    scratch.drop(words)
    named = spark.sparkContext.broadcast(packed)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, known, packed = Plausibility(model.value), {}, named.value
        fine: dict[str, bool] = {}

        def clean(w: str) -> bool:
            if w not in fine:
                if len(fine) > 200_000:
                    fine.clear()
                at = _bit(w)
                fine[w] = not packed[at >> 3] >> (at & 7) & 1
            return fine[w]

        for b in batches:
            keys, nos, passages, restored, how = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if all(map(clean, words_of(t))):
                    continue
                for no, line in enumerate(t.split("\n"), 1):
                    for p, r, s in _judge(line, costs, known):
                        keys.append(k)
                        nos.append(no)
                        passages.append(p)
                        restored.append(r)
                        how.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(passages, pa.string()), pa.array(restored, pa.string()), pa.array(how, pa.string())], [key, "passage_no", "passage", "restored", "steps"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.where(F.col(text).rlike(_COULD)).select(key, text)).mapInArrow(judge, f"{key} {kind}, passage_no int, passage string, restored string, steps string")


def restored_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, passages, whole`` of every garbled document: each garbled passage that can be had is replaced by its original.

    ``whole`` says that all of them could. A key with several texts counts with the greatest.
    """
    found = garbled_passages(docs, key, text).dropDuplicates([key, "passage_no", "passage"])
    fixes = found.groupBy(key).agg(F.collect_list(F.struct("passage_no", "passage", "restored")).alias("_fixes"), F.count("*").alias("passages"), F.every(F.col("restored").isNotNull()).alias("whole"))
    own = docs.where(F.col(text).isNotNull()).join(fixes.select(key), key, "left_semi").groupBy(key).agg(F.max(text).alias(text))

    def line(x, i):
        return F.aggregate(
            F.filter("_fixes", lambda f: (f["passage_no"] == i + 1) & f["restored"].isNotNull()), x, lambda acc, f: F.replace(acc, f["passage"], f["restored"])
        )

    return own.join(fixes, key).select(key, F.array_join(F.transform(F.split(text, "\n"), line), "\n").alias(text), "passages", "whole")
