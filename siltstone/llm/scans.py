"""Noise in text from scanned pages: furniture, broken words, misread characters.

Two kinds of averaged perceptrons are trained at call time, without hand labels:

* the *furniture* model looks at the lines near the edges of a page: position from
  top and bottom, shape, how many pages of the file (and files of the corpus) carry the same text
  at the same edge, and whether the number in it runs with the pages. Lines that the repetition
  alone decides teach the shape and position features, which then decide the rest.
* the *editor* (:mod:`siltstone.llm.editor`) walks the characters of a word and keeps, replaces, deletes or inserts
  them, or joins at a line's end. What scanners confuse is learned from the words themselves.

Each distinct part of a word is edited once. Its hypotheses are looked up in the counts of all words by a join, in rounds of one
operation each, and the edits go back to the lines by another. Nothing that grows with the vocabulary is broadcast: models and tables of
fixed size are, and a filter of fixed size that tells which parts of a line are worth a join. All lines and words teach: in shards of at most
about ``SHARD_LINES`` lines or ``editor.SHARD_WORDS`` words, whose weights are averaged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import editor
from siltstone.llm.editor import HYPHENS, Perceptron, Step
from siltstone.runtime import Scratch, spread

SHARD_LINES = 12_000
SCANNERS = ("pdf-ocr", "image-ocr")
#: Most operations on one word, and how many hypotheses a next operation goes on from.
MOST_STEPS, BEAM = 3, 4
#: Bits of the filter of edited parts (4 MB).
FILTER_BITS = 1 << 25
_EDGE = 3
_CODE = re.compile(r"[_/\\<>=#&*%§°€£]|\d{3}|^[A-Z]{1,4}-|\.\w{2,4}$|^\W*[\d.,:]+\W*$|^https?:")
_OUTER = ".,;:!?\"“”„«»’‘'…–—)[]{}¿¡"
_TOKEN = re.compile(r"\S+")


# -------------------------------------------------------------- parts of words


def bare(token: str) -> str:
    return token.strip(_OUTER)


def line_parts(content: str) -> Iterator[tuple[re.Match, list[tuple[int, str]]]]:
    """The tokens of a line with their parts; the hyphen at the end is no part."""
    tokens = list(_TOKEN.finditer(content))
    closing = content.rfind(")")
    for k, m in enumerate(tokens):
        yield m, parts_of(m.group().rstrip(HYPHENS) if k == len(tokens) - 1 else m.group(), closing > m.start())


@lru_cache(maxsize=100_000)
def parts_of(token: str, closed: bool = False) -> list[tuple[int, str]]:
    """The parts of a token that are words, each with its place: without outer marks, cut at hyphens and apostrophes.

    Numbers, references, addresses and names of files have none. A bracket that is ``closed`` later in the line or stands alone is a mark; another may be a letter.
    """
    if _CODE.search(token):
        return []
    core = token.strip(_OUTER)
    if core.startswith("(") and (closed or ")" in token or len(core) == 1):
        core = core[1:]
    core = core.rstrip("(")
    if not core or sum(c.isalpha() for c in core) < max(1, sum(c.isdigit() for c in core)):
        return []
    out, off = [], token.index(core)
    for part in re.split(r"([-‐’'])", core):
        if part and part not in "-‐’'" and len(part) <= 60 and any(map(str.isalpha, part)):
            out.append((off, part))
        off += len(part)
    return out


def broken_parts(left: str, right: str) -> tuple[str, str, str] | None:
    """``(hyphen, end, beginning)`` of the word that a line's last token may go on with in the next line's first; None if neither is a word."""
    if not left or not right:
        return None
    hyphen = left[-1] if left[-1] in HYPHENS else ""
    a, b = (bare(left[:-1]) if hyphen else left), bare(right)
    if not a or not b or not (a[-1].isalpha() or a[-1] in "015@+($6") or not (b[0].isalnum() or b[0] in "@+($"):
        return None
    if not hyphen and (not right[0].islower() or not a[-1].isalpha()):
        return None
    a, b = re.split(r"[-‐’'“\"„«\[]", a)[-1].lstrip("("), re.split(r"[-‐’'.]", b)[0]
    if not a or not b or not hyphen and (len(a) < 2 or len(b) < 2 or not b.isalpha()):
        return None
    return hyphen, a, b


# ---------------------------------------------------------------- furniture


_NUMBER = re.compile(r"(?<![^\W_])[0-9lIoO|]*[0-9][0-9lIoO|]*(?![^\W_])")
_ROMAN = re.compile(r"(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_MARKS = " \t-\u2010\u2013\u2014[](){}.|\u00b7*~"
_AS_DIGITS = str.maketrans("lI|oO", "11100")
#: Applied to what single confusable characters have been made one in: i is l, e is c there.
_PAIRS = (("ll", "u"), ("rl", "n"), ("rn", "m"), ("vv", "w"), ("cl", "d"))
_ONE_SHAPE = str.maketrans("ie\u00e9(@f+hq$|01568", "lccc" + "at" + "t" + "b" + "gslolscb")


def roman(text: str) -> int | None:
    """The value of a small roman numeral; a scanner's 1 and | stand for i."""
    t = text.lower().replace("1", "i").replace("|", "i")
    m = _ROMAN.match(t)
    if not m:
        return None
    worth = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    v = [worth[c] for c in t]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))


def line_pattern(content: str) -> tuple[str, list[int]]:
    """``(pattern, numbers)``: the text with confusable characters made one and numbers as ``#``, and what its numbers may be."""
    core = content.strip(_MARKS)
    if core and len(core) <= 8:
        values = []
        if re.fullmatch(r"[0-9lIoO|]+", core):
            values.append(int(core.translate(_AS_DIGITS)))
        r = roman(core)
        if r is not None:
            values.append(r)
        if values:
            return "#", values
    found = [int(x[:15].translate(_AS_DIGITS)) for x in _NUMBER.findall(content)]
    x = re.sub(r"[^#\w]|_", "", _NUMBER.sub("#", content).lower().translate(_ONE_SHAPE))
    for seen, true in _PAIRS:
        x = x.replace(seen, true)
    return x, [found[0], found[-1]] if found else []


def edge_lines(lines: DataFrame) -> DataFrame:
    """Lines near a page's edge with what the furniture model looks at."""
    word = Window.partitionBy("unit").orderBy("line_number", "id")
    page = Window.partitionBy("unit")
    own = lines.withColumn("file_id", F.coalesce("file_id", -1 - F.col("unit")))  # a page without a file stands alone
    x = own.where(F.trim("content") != "").withColumn("top", F.row_number().over(word) - 1).withColumn("of", F.count("*").over(page)).withColumn("wide", F.max(F.length("content")).over(page)).withColumn("page", F.max("page").over(page))
    x = x.withColumn("bottom", F.col("of") - 1 - F.col("top")).where((F.col("top") < _EDGE) | (F.col("bottom") < _EDGE))
    @F.pandas_udf("text string, a bigint, b bigint, numbered boolean")
    def look(c: pd.Series) -> pd.DataFrame:
        rows = [line_pattern(t) for t in c]
        return pd.DataFrame({"text": [r[0] for r in rows], "a": pd.array([r[1][0] if r[1] else None for r in rows], "Int64"), "b": pd.array([r[1][-1] if r[1] else None for r in rows], "Int64"), "numbered": [bool(r[1]) for r in rows]})

    x = x.withColumn("l", look("content")).select("*", "l.text", "l.numbered").withColumn("place", F.coalesce("page", F.lit(0)))
    none = F.lit(-(10**9)).cast("bigint")
    x = x.withColumn("first", F.coalesce(F.col("l.a") - F.col("place"), none)).withColumn("last", F.coalesce(F.col("l.b") - F.col("place"), none)).drop("l")

    def pages(*keys: str) -> DataFrame:
        return x.groupBy("file_id", "text", *keys).agg(F.count_distinct("unit").alias("n"))

    by_first, by_last, plain = pages("first"), pages("last"), pages()
    files = x.groupBy("text").agg(F.approx_count_distinct("file_id").alias("files"))
    keys = ["file_id", "text"]
    x = x.join(by_first.withColumnRenamed("n", "n_first"), [*keys, "first"]).join(by_last.withColumnRenamed("n", "n_last"), [*keys, "last"])
    x = x.join(plain.withColumnRenamed("n", "n_text"), keys).join(files, "text")
    return x.select("id", "unit", "content", "top", "bottom", "of", "wide", "text", "numbered", F.greatest("n_first", "n_last").alias("n_run"), "n_text", "files")


def line_features(content: str, top: int, bottom: int, of: int, wide: int, text: str, numbered: bool, n_run: int, n_text: int, files: int, seen: bool = True) -> list[str]:
    s = content.strip()
    words = re.findall(r"[^\W\d_]+", s)
    low = sum(w[0].islower() for w in words)
    shape = "num" if not words else "code" if re.fullmatch(r"[A-Z]{2}-\d+\.?", s) else "up" if s.isupper() else "title" if not low else "cap" if words[0][0].isupper() else "low"
    end = "p" if s[-1:] in ".;:,!?…" else "h" if s[-1:] in HYPHENS else "n"
    at = f"t{top}" if top <= bottom else f"b{bottom}"
    run = ("r" + str(min(n_run, 3))) if numbered else ("w" + str(min(n_text, 3)))
    many = "m" if files >= 3 else "f"
    small = "s" if len(s) * 2 < wide else "l"
    caps = sum(w[0].isupper() for w in words) * 4 // len(words) if words else 0
    feats = [f"cs{caps}", f"cs{caps}{small}{end}", f"cs{caps}{min(len(words), 7)}", "b", at, f"sh{shape}", f"e{end}", f"{shape}{end}", f"{at}{shape}", f"{at}{small}{end}", f"sm{small}{shape}", f"nw{min(len(words), 6)}", f"{numbered}{shape}{at}", f"d{sum(w in ('of', 'page') for w in map(str.lower, words))}{numbered}"]
    if seen:
        feats += [run, f"{run}{at}", f"{run}{shape}", f"{many}{numbered}", f"{many}{run}{end}", f"{run}{small}{end}"]
    return feats


def _sure(r) -> bool | None:
    """What repetition alone decides: None where it doesn't."""
    if r.top >= _EDGE and r.bottom >= _EDGE:
        return False
    n = r.n_run if r.numbered else r.n_text
    s = r.content.strip()
    sentence = s[-1:] in ".;!?…" or s[-1:] in HYPHENS or len(s) * 4 > r.wide * 3
    if n >= 3 or n >= 2 and not sentence:
        return not (sentence and n < 3)
    words = re.findall(r"[^\W\d_]+", s)
    if sentence or s[:1].islower() or len(words) > 6 or sum(w[0].isupper() for w in words) * 5 < len(words) * 2:
        return False
    return None


def train_furniture(rows: list) -> dict[str, float]:
    """Weights from edge lines that their repetition decides; each teaches with and without the repetition features."""
    data = []
    for r in rows:
        y = _sure(r)
        if y is not None:
            args = (r.content, r.top, r.bottom, r.of, r.wide, r.text, r.numbered, r.n_run, r.n_text, r.files)
            data.append((line_features(*args), y))
            if y or not r.numbered:
                data.append((line_features(*args, seen=False), y))
        elif r.numbered and r.n_run < 2 or re.fullmatch(r"[A-Z]{2}-\d+", r.content.strip()):
            # a number that doesn't run with the pages, a bare reference
            data.append((line_features(r.content, r.top, r.bottom, r.of, r.wide, r.text, r.numbered, r.n_run, r.n_text, r.files), False))
    return Perceptron().train(data).w


# -------------------------------------------------------------------- words


def word_counts(units: DataFrame) -> DataFrame:
    """``w, a, s``: how often each whole word, and each part of a compound, stands in other texts and in scanned ones; all texts, in lower case."""
    whole = r"(?<![^\s“\"„«‘’'(\[])\p{L}+(?:[-’']\p{L}+)*(?![^\s.,;:!?…”\"»’')\]])"
    words = F.regexp_extract_all(F.lower("unit_text"), F.lit(whole), F.lit(0))
    x = spread(units.select(F.coalesce(F.col("extractor_id").isin(*SCANNERS), F.lit(False)).alias("scanned"), "unit_text")).select("scanned", F.explode(words).alias("w"))
    per = x.groupBy("w").agg(F.count_if(~F.col("scanned")).alias("a"), F.count_if("scanned").alias("s"))
    parts = F.when(F.col("w").rlike("[-’']"), F.concat(F.array("w"), F.split("w", "[-’']"))).otherwise(F.array("w"))
    return per.select(F.explode(parts).alias("w"), "a", "s").groupBy("w").agg(F.sum("a").alias("a"), F.sum("s").alias("s"))


def _holes(words: DataFrame) -> DataFrame:
    """Each ``w`` with ``i, h, key`` of every run of up to two characters cut out of it; the key is what remains on both sides."""
    cut = f"transform(sequence(0, length(w)), i -> transform(sequence(0, least({editor.MOST_CHARACTERS}, length(w) - i)), h -> struct(i, h, xxhash64(substring(w, 1, i), substring(w, i + h + 1)) as key)))"
    return words.select("w", F.explode(F.flatten(F.expr(cut))).alias("x")).select("w", "x.*")


def differences(words: DataFrame, others: DataFrame) -> DataFrame:
    """``seen, printed, n``: how the words ``w`` differ in one place from others, as :func:`editor.difference` tells it; each word counts as one, shared by its pairs."""
    left = _holes(words)
    right = _holes(others).select(F.col("w").alias("c"), F.col("i").alias("j"), F.col("h").alias("g"), "key")
    seen, printed = F.expr("substring(w, i + 1, h)"), F.expr("substring(c, i + 1, g)")
    # of the places where the same remains, the one with the longest beginning and then the longest end: every pair comes once
    first = (F.col("i") == F.least(F.length("w"), F.length("c"))) | (F.expr("substring(w, i + 1, 1)") != F.expr("substring(c, i + 1, 1)"))
    last = (F.col("h") == 0) | (F.col("g") == 0) | (F.right(seen, F.lit(1)) != F.right(printed, F.lit(1)))
    # a table of words is small, its holes are not: neither side is broadcast
    pairs = left.hint("merge").join(right.hint("merge"), "key").where((F.col("i") == F.col("j")) & (F.col("w") != F.col("c")) & first & last).select("w", seen.alias("seen"), printed.alias("printed"))
    shared = pairs.groupBy("w", "seen", "printed").agg(F.count("*").alias("k")).withColumn("of", F.sum("k").over(Window.partitionBy("w")))
    return shared.groupBy("seen", "printed").agg(F.round(F.sum(F.col("k") / F.col("of")), 6).alias("n"))


def channel_of(scanned_only: DataFrame, clean: DataFrame, scratch: Scratch) -> dict[tuple[str, str], float]:
    """:func:`editor.learn_channel` over all words: ``w`` that only scanned pages have, and ``w, a`` of other texts.

    Words that are as frequent as the middle one, or less, show how often words differ by chance.
    """
    of_word = (F.length("w") >= 3) & (F.length("w") <= 24) & ~F.col("w").rlike("[-’']")
    scanned_only, clean = scratch.keep(scanned_only.where(of_word)), scratch.keep(clean.where(of_word))
    by_count = sorted((r.a, r.n) for r in clean.groupBy("a").agg(F.count("*").alias("n")).collect())
    upto, middle, half = 0, 0, -(-sum(n for _, n in by_count) // 2)
    for a, n in by_count:
        if upto < half:
            upto, middle = upto + n, a
    found = scratch.keep(differences(scanned_only, clean.select("w")))
    chance = scratch.keep(differences(clean.where(F.col("a") <= middle).select("w"), clean.select("w")))
    op = ["seen", "printed"]
    whole = found.agg(F.sum("n")).first()[0] or 0.0
    once, new = chance.where("n <= 1").count(), found.join(chance, op, "left_anti").count()
    # each has a fixed share of the whole, so there are not many
    often = found.where(F.col("n") >= whole * editor.LEAST_SHARE).join(chance.withColumnRenamed("n", "m"), op, "left").collect()
    out = editor.confusions(sorted(((r.seen, r.printed), r.n, r.m or 0.0) for r in often), whole, once, new, scanned_only.count(), upto)
    scratch.drop(scanned_only, clean, found, chance)
    return out


def _averaged(weights: DataFrame, shards: int) -> dict[str, dict[str, float]]:
    """The mean weights of each ``kind`` of perceptron, of ``kind, f, x`` of the shards. Features are of a fixed number of forms."""
    out: dict[str, dict[str, float]] = {}
    for r in weights.groupBy("kind", "f").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r.kind, {})[r.f] = r.x / shards
    return out


def _weight_rows(**perceptrons: dict[str, float]) -> pd.DataFrame:
    return pd.DataFrame([(k, f, float(x)) for k, w in perceptrons.items() for f, x in w.items()], columns=["kind", "f", "x"])


def _taught(words: DataFrame, clean: DataFrame, model, scratch: Scratch) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the editor and of the join: shards of all words of other texts are taught each in a task, and averaged.

    A shard's lessons are made twice, which is cheaper than to move them: for the words whose counts they need, and to be taught.
    """
    count = clean.count()
    if not count:
        return editor.NO_WEIGHTS
    shards = -(-count // editor.SHARD_WORDS)
    own = scratch.keep(clean.select(F.pmod(F.xxhash64("w"), F.lit(shards)).cast("int").alias("shard"), "w", "a", "s"))
    apart = lambda df: df.repartition(2 * shards, "shard")  # noqa: E731  (a number given, shards aren't put together by their bytes)

    def made(f: pd.DataFrame) -> editor.Lessons | None:
        f = f.sort_values("w")
        return editor.lessons({w: (int(a), int(s)) for w, a, s in zip(f["w"], f["a"], f["s"], strict=True)}, model.value["channel"])

    def ask(f: pd.DataFrame) -> pd.DataFrame:
        x = made(f)
        return pd.DataFrame({"shard": f["shard"].iloc[0], "w": sorted(x.wanted()) if x else []})

    def teach(f: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        x, m = made(f) if len(f) else None, model.value
        if not x:
            return _weight_rows(join=editor.NO_WEIGHTS[1])
        lex = editor.Lexicon({w: (int(a), int(s)) for w, a, s in zip(known["w"], known["a"], known["s"], strict=True)}, m["totals"], m["triples"], m["types"])
        edit, join = x.train(lex)
        return _weight_rows(edit=edit, join=join)

    asked = apart(own).groupBy("shard").applyInPandas(ask, "shard int, w string").join(words, "w").select("shard", "w", "a", "s")
    w = _averaged(apart(own).groupBy("shard").cogroup(apart(asked).groupBy("shard")).applyInPandas(teach, "kind string, f string, x double"), shards)
    scratch.drop(own)
    return w.get("edit", {}), w.get("join", {})


def _triples(words: DataFrame) -> dict[int, int]:
    """How many words of other texts have each character triple, in the cells of a table of fixed size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells: Counter[int] = Counter()
        for f in frames:
            for w in f["w"]:
                cells.update(editor.triple_cells(w))
        if cells:
            yield pd.DataFrame({"cell": list(cells), "n": list(cells.values())})

    own = words.where("a > 0 and length(w) < 30").select("w").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r.cell: r.n for r in own.collect()}


# -------------------------------------------------------------------- edits

_STEPS = "array<struct<at:int,seen:string,printed:string>>"


def edited_parts(parts: DataFrame, words: DataFrame, model, scratch: Scratch) -> DataFrame:
    """``part, result, steps, a, s`` of the parts that the editor changes; ``a, s`` are the counts of the result.

    In round k every part at issue has its best hypotheses of k - 1 operations extended by one. A part leaves once the best hypothesis is a word
    that is known, or none scores better than before. Words that other texts have are offered one operation only.
    """
    counted = parts.join(words, F.lower("part") == F.col("w"), "left").select("part", F.coalesce("a", F.lit(0)).alias("a0"), F.coalesce("s", F.lit(0)).alias("s0"))

    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel = model.value["channel"]
        for f in frames:
            rows = []
            for part, a, s, beam in zip(f["part"], f["a0"], f["s0"], f["beam"], strict=True):
                done = set()
                for h in beam:
                    steps = [(x["at"], x["seen"], x["printed"]) for x in h["steps"]]
                    for i, seen, printed, out in editor.edits(h["out"], channel):
                        if out != part and out not in done:
                            done.add(out)
                            rows.append((part, a, s, out, out.lower(), [*steps, (i, seen, printed)]))
            if rows:
                yield pd.DataFrame(rows, columns=["part", "a0", "s0", "out", "w", "steps"])

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        p = Perceptron(m["edit"])
        for f in frames:
            rows = []
            for part, a0, s0, best, hyps in zip(f["part"], f["a0"], f["s0"], f["best"], f["hyps"], strict=True):
                scored = []
                for h in hyps:
                    steps = [(x["at"], x["seen"], x["printed"]) for x in h["steps"]]
                    lex = editor.Lexicon({part.lower(): (a0, s0), h["out"].lower(): (h["a"], h["s"])}, m["totals"], m["triples"], m["types"])
                    scored.append((p.score(editor.edit_features(lex, part, steps, h["out"])), h["out"], steps, h["a"], h["s"]))
                scored.sort(key=lambda x: (-x[0], x[1]))
                top = scored[0]
                wins = top[0] > best
                go_on = not a0 and not (wins and top[3])
                rows.append((part, a0, s0, max(top[0], best), *(top[1:] if wins else (None, None, None, None)), [{"out": x[1], "steps": x[2]} for x in scored[:BEAM]] if go_on else []))
            if rows:
                yield pd.DataFrame(rows, columns=["part", "a0", "s0", "best", "out", "steps", "a", "s", "beam"])

    beam = f"array<struct<out:string,steps:{_STEPS}>>"
    start = F.array(F.struct(F.col("part").alias("out"), F.array().cast(_STEPS).alias("steps")))
    front = counted.select("part", "a0", "s0", F.lit(0.0).alias("best"), start.alias("beam"))
    found: list[DataFrame] = []
    for k in range(MOST_STEPS):
        front = scratch.keep(front)
        hyps = front.select("part", "a0", "s0", "beam").mapInPandas(expand, f"part string, a0 long, s0 long, out string, w string, steps {_STEPS}")
        known = hyps.join(words, "w", "left").select("part", F.struct("out", "steps", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("s", F.lit(0)).alias("s")).alias("h"))
        # a part has some dozen hypotheses: its characters times what each can have come from
        grouped = known.groupBy("part").agg(F.collect_list("h").alias("hyps")).join(front.select("part", "a0", "s0", "best"), "part")
        judged = scratch.keep(grouped.select("part", "a0", "s0", "best", "hyps").mapInPandas(judge, f"part string, a0 long, s0 long, best double, out string, steps {_STEPS}, a long, s long, beam {beam}"))
        found.append(judged.where("out is not null").select("part", F.lit(k).alias("k"), "out", "steps", "a", "s"))
        front = judged.where("size(beam) > 0").select("part", "a0", "s0", "best", "beam")
    last = found[0]
    for f in found[1:]:
        last = last.unionByName(f)
    return last.groupBy("part").agg(F.max_by(F.struct("out", "steps", "a", "s"), "k").alias("b")).select("part", F.col("b.out").alias("result"), "b.steps", "b.a", "b.s")


def joined_lines(pairs: DataFrame, words: DataFrame, fixes: DataFrame, model) -> DataFrame:
    """``left, right, cut, steps`` of the pairs of tokens that are one broken word: where its end begins, and what is misread in it."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(x, y, h, a, b, (a + b).lower(), a + b) for x, y in zip(f["left"], f["right"], strict=True) for h, a, b in [broken_parts(x, y)]]
            if rows:
                yield pd.DataFrame(rows, columns=["left", "right", "hyphen", "a", "b", "low", "whole"])

    own = pairs.mapInPandas(ask, "left string, right string, hyphen string, a string, b string, low string, whole string")
    own = own.join(fixes.select(F.col("part").alias("whole"), F.col("result"), "steps"), "whole", "left")
    asked = F.array(F.lower("a"), F.lower("b"), F.col("low"), F.lower(F.concat("a", F.lit("-"), "b")), F.lower(F.coalesce("result", "low")))
    x = own.select("left", "right", "hyphen", "a", "b", "result", "steps", F.explode(F.array_distinct(asked)).alias("w")).join(words.select("w", F.col("a").alias("n"), F.col("s").alias("m")), "w", "left")
    per = x.groupBy("left", "right").agg(F.first("hyphen").alias("hyphen"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("result").alias("result"), F.first("steps").alias("steps"), F.collect_list(F.struct("w", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))).alias("counts"))

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        p = Perceptron(m["join"])
        for f in frames:
            rows = []
            for left, right, hyphen, a, b, result, steps, counts in zip(f["left"], f["right"], f["hyphen"], f["a"], f["b"], f["result"], f["steps"], f["counts"], strict=True):
                lex = editor.Lexicon({c["w"]: (c["n"], c["m"]) for c in counts}, m["totals"], m["triples"], m["types"])
                if p.score(editor.join_features(lex, a, b, hyphen, result)) > 0:
                    rows.append((left, right, len(a), list(steps) if steps is not None else []))
            if rows:
                yield pd.DataFrame(rows, columns=["left", "right", "cut", "steps"])

    return per.mapInPandas(judge, f"left string, right string, cut int, steps {_STEPS}")


def share(steps: list[Step], cut: int, want_head: bool) -> list[Step]:
    """The steps on a broken word that fall into one of its halves, with places in that half."""
    out = []
    for i, seen, printed in steps:
        inside = i < cut
        if inside:
            cut += len(printed) - len(seen)
        if inside == want_head:
            out.append((i if want_head else i - cut, seen, printed))
    return out


def repair_line(content: str, fixes: dict[str, list[Step]], goes_on: tuple[int, list[Step]] | None, came: tuple[int, list[Step]] | None) -> tuple[bool, str]:
    """``(misread, fixed)``. ``goes_on`` and ``came`` are the cut and steps of the words broken at the line's end and its beginning."""
    tokens = list(line_parts(content))
    misread, out, at = False, [], 0
    for k, (m, own) in enumerate(tokens):
        t, edits = m.group(), []
        for j, (off, part) in enumerate(own):
            if goes_on and k == len(tokens) - 1 and j == len(own) - 1:
                steps = share(goes_on[1], goes_on[0], True)
            elif came and k == 0 and j == 0:
                steps = share(came[1], came[0], False)
            else:
                steps = fixes.get(part, [])
            grown = sum(len(p) - len(s) for _, s, p in edits)
            edits += [(off + grown + i, s, p) for i, s, p in steps]
        if edits:
            misread = True
            out.append(content[at : m.start()] + editor.apply_steps(t, edits))
            at = m.end()
    return misread, "".join(out) + content[at:]


# ------------------------------------------------------------------ operator


def _teach(words: DataFrame, parts: DataFrame, scratch: Scratch) -> dict:
    """The models and the tables of fixed size they need."""
    seen = F.col("a") > 0
    totals = words.agg(F.sum("a"), F.sum("s"), F.count_if(seen)).first()
    clean = words.where(seen)
    low = parts.where(F.length("part") >= 3).select(F.lower("part").alias("w")).distinct().join(clean.select("w"), "w", "left_anti")
    m = {"channel": channel_of(low, clean.select("w", "a"), scratch), "totals": (totals[0] or 1, totals[1] or 1), "triples": _triples(words), "types": totals[2] or 0}
    given = words.sparkSession.sparkContext.broadcast(m)
    edit_w, join_w = _taught(words, clean, given, scratch)
    given.destroy()
    return m | {"edit": edit_w, "join": join_w}


def _cell(part: str) -> int:
    return xxhash.xxh3_64_intdigest(part) % FILTER_BITS


def repaired_lines(units: DataFrame, lines: DataFrame) -> DataFrame:
    """``id, file_id, unit, line_number, content, furniture, broken, misread, fixed`` of the lines of scanned pages.

    ``fixed`` is the line with its misread characters replaced; furniture and blank lines have none.
    A line is broken if the next line of text in its file, furniture and blank lines aside, goes on inside its last
    word. Repeated rows count once; lines with null content are left out; a null page counts as 0, a page without a file stands alone.
    """
    spark = units.sparkSession
    scratch = Scratch(spark)
    scanned = units.where(F.col("extractor_id").isin(*SCANNERS)).select(F.col("id").alias("unit")).distinct()
    own = lines.where(F.col("content").isNotNull() & F.col("id").isNotNull()).select("id", "file_id", F.col("content_unit_id").alias("unit"), "line_number", "page", "content")
    own = scratch.keep(own.join(scanned, "unit", "left_semi").select("id", "file_id", "unit", "line_number", "page", "content").dropDuplicates(["id"]))
    x = scratch.keep(_with_furniture(own, scratch))
    body = scratch.keep(_with_neighbours(x))
    words = scratch.keep(word_counts(units))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: Counter[str] = Counter()
        for f in frames:
            for content, after in zip(f["content"], f["after"], strict=True):
                last = ""
                for m, own in line_parts(content):
                    parts.update(p for _, p in own)
                    last = m.group()
                b = broken_parts(last, after or "")
                if b and b[0]:
                    parts[b[1] + b[2]] += 1
            if len(parts) > 100_000:
                yield pd.DataFrame({"part": list(parts), "n": list(parts.values())})
                parts.clear()
        if parts:
            yield pd.DataFrame({"part": list(parts), "n": list(parts.values())})

    parts = scratch.keep(body.select("content", "after").mapInPandas(look, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")))
    model = spark.sparkContext.broadcast(_teach(words, parts, scratch))
    fixes = scratch.keep(edited_parts(parts.select("part"), words, model, scratch))

    @F.pandas_udf("boolean")
    def could_join(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([broken_parts(a, b) is not None for a, b in zip(left, right, strict=True)], dtype=bool)

    pairs = body.where("after is not null").select(F.col("last").alias("left"), F.col("after").alias("right")).distinct().where(could_join("left", "right"))
    joins = scratch.keep(joined_lines(pairs, words, fixes, model))
    per_line = _edits_of_lines(body, fixes, spark)
    here = joins.select(F.col("left").alias("last"), F.col("right").alias("after"), F.struct("cut", "steps").alias("goes_on"))
    came = joins.select(F.col("left").alias("before"), F.col("right").alias("first"), F.struct("cut", "steps").alias("came"))
    ready = body.join(here, ["last", "after"], "left").join(came, ["before", "first"], "left").join(per_line, "id", "left")
    pair = f"struct<cut:int,steps:{_STEPS}>"

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain = lambda steps: [(int(s["at"]), s["seen"], s["printed"]) for s in steps]
        both = lambda p: None if p is None else (int(p["cut"]), plain(p["steps"]))
        for f in frames:
            rows = []
            for c, on, cm, ed in zip(f["content"], f["goes_on"], f["came"], f["edits"], strict=True):
                if ed is None and on is None and cm is None:
                    rows.append((False, c))
                    continue
                fix = {e["part"]: plain(e["steps"]) for e in ed} if ed is not None else {}
                rows.append(repair_line(c, fix, both(on), both(cm)))
            if rows:
                yield pd.DataFrame({"id": f["id"], "broken": [on is not None for on in f["goes_on"]], "misread": [r[0] for r in rows], "fixed": [r[1] for r in rows]})

    kind = lines.schema["id"].dataType.simpleString()
    judged = ready.select("id", "content", F.col("goes_on").cast(pair), F.col("came").cast(pair), "edits").mapInPandas(repair, f"id {kind}, broken boolean, misread boolean, fixed string")
    no = F.lit(False)
    return x.join(judged, "id", "left").select("id", "file_id", "unit", "line_number", "content", "furniture", F.coalesce("broken", no).alias("broken"), F.coalesce("misread", no).alias("misread"), "fixed")


def _with_furniture(own: DataFrame, scratch: Scratch) -> DataFrame:
    spark = own.sparkSession
    edges = scratch.keep(edge_lines(own))
    shards = max(1, -(-edges.count() // SHARD_LINES))

    def teach(f: pd.DataFrame) -> pd.DataFrame:
        return _weight_rows(furniture=train_furniture(list(f.sort_values("id").itertuples(index=False))))

    apart = edges.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).repartition(2 * shards, "shard")
    weights = spark.sparkContext.broadcast(_averaged(apart.groupBy("shard").applyInPandas(teach, "kind string, f string, x double"), shards).get("furniture", {}))
    cols = ["content", "top", "bottom", "of", "wide", "text", "numbered", "n_run", "n_text", "files"]

    @F.pandas_udf("boolean")
    def is_furniture(r: pd.DataFrame) -> pd.Series:
        p = Perceptron(weights.value)
        # a text without numbers that stands once in its file says nothing by that: headers alternate, and files may be short
        return pd.Series([p.score(line_features(*x, seen=bool(x.numbered) or x.n_text > 1)) > 0 for x in r[cols].itertuples(index=False)], dtype=bool)

    marked = edges.select("id", is_furniture(F.struct(*cols)).alias("furniture")).where("furniture")
    return own.join(marked, "id", "left").withColumn("furniture", F.coalesce("furniture", F.lit(False)))


def _with_neighbours(x: DataFrame) -> DataFrame:
    """``id, content, first, last, after, before``: lines of text with their first and last token and those of the lines around, over pages of a file."""
    body = x.where(~F.col("furniture") & (F.trim("content") != "")).withColumn("file_id", F.coalesce("file_id", -1 - F.col("unit")))
    tokens = F.split(F.trim("content"), r"\s+")
    body = body.withColumn("head", F.get(tokens, F.lit(0))).withColumn("tail", F.element_at(tokens, -1))
    in_page = Window.partitionBy("unit").orderBy("line_number", "id")
    body = body.withColumn("after", F.lead("head").over(in_page)).withColumn("before", F.lag("tail").over(in_page))
    # across pages: one row a page, so a file's pages and not its lines meet in a window
    pages = body.groupBy("file_id", "unit").agg(F.min("line_number").alias("at"), F.min_by("head", F.struct("line_number", "id")).alias("head"), F.max_by("tail", F.struct("line_number", "id")).alias("tail"))
    along = Window.partitionBy("file_id").orderBy("at", "unit")
    pages = pages.select("unit", F.lead("head").over(along).alias("next_page"), F.lag("tail").over(along).alias("last_page"))
    return body.join(pages, "unit").select("id", "content", F.col("head").alias("first"), F.col("tail").alias("last"), F.coalesce("after", "next_page").alias("after"), F.coalesce("before", "last_page").alias("before"))


def _edits_of_lines(body: DataFrame, fixes: DataFrame, spark) -> DataFrame:
    """``id, edits``: the edited parts that each line holds. A filter of fixed size spares the join all others."""

    def bits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"bit": np.fromiter(map(_cell, f["part"]), dtype=np.int64, count=len(f))})

    cells = fixes.select("part").mapInPandas(bits, "bit long").distinct()
    blocks = cells.groupBy((F.col("bit") / 8192).cast("long").alias("block")).agg(F.collect_set((F.col("bit") % 8192).cast("int")).alias("own"))
    packed = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in blocks.toLocalIterator():
        at = r.block * 8192 + np.array(r.own, dtype=np.int64)
        np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
    named = spark.sparkContext.broadcast(packed)

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled, known = named.value, {}

        def edited(part: str) -> bool:
            got = known.get(part)
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                c = _cell(part)
                got = known[part] = bool(filled[c >> 3] >> (c & 7) & 1)
            return got

        for f in frames:
            ids, parts = [], []
            for i, content in zip(f["id"], f["content"], strict=True):
                own = {p for _, ps in line_parts(content) for _, p in ps if edited(p)}
                ids += [i] * len(own)
                parts += own
            if ids:
                yield pd.DataFrame({"id": ids, "part": parts})

    kind = body.schema["id"].dataType.simpleString()
    found = body.select("id", "content").mapInPandas(hits, f"id {kind}, part string").join(fixes.select("part", "steps"), "part")
    return found.groupBy("id").agg(F.collect_list(F.struct("part", "steps")).alias("edits"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """``unit, paragraph_no, text``: the repaired text of each page, without furniture, words made whole, one row a paragraph.

    A paragraph begins after a blank line or with an indented line.
    """
    own = lines.where(~F.col("furniture"))
    w = Window.partitionBy("unit").orderBy("line_number", "id")
    blank = F.trim("content") == ""
    starts = F.coalesce(F.lag(blank).over(w), F.lit(True)) | F.col("content").rlike(r"^\s{2,}\S")
    x = own.withColumn("starts", (starts & ~blank).cast("int")).withColumn("paragraph_no", F.sum("starts").over(w)).where(~blank)
    text = F.trim(F.coalesce("fixed", "content"))
    piece = F.when(F.col("broken"), F.regexp_replace(text, r"[-‐¬\x{00AD}]\s*$", "")).otherwise(F.concat(text, F.when(text.rlike(r"\p{L}-$"), "").otherwise(" ")))
    parts = F.array_sort(F.collect_list(F.struct("line_number", "id", piece.alias("piece"))))
    return x.groupBy("unit", "paragraph_no").agg(parts.alias("p")).select("unit", F.col("paragraph_no").cast("int").alias("paragraph_no"), F.rtrim(F.array_join(F.transform("p", lambda s: s["piece"]), "")).alias("text"))
