"""Language of texts and of their sentences: multinomial naive Bayes over hashed character n-grams.

The log-probabilities are one matrix of fixed size (``BUCKETS`` x languages) that
is broadcast; a batch of sentences is hashed into one long vector of buckets and
scored by gathering rows and adding them up per sentence, all in numpy.

The classifier is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` a
language, drawn by hash from all rows). Labels may be wrong: sentences that a first fit
places elsewhere are left out of the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.binding import let
from siltstone.runtime import spread

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja")
#: Usual names and codes of the languages, in lower case.
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "inglés", "inglese", "inglês", "engels", "angielski"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "alemão", "duits", "niemiecki"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francese", "francês", "frans", "francuski"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "spagnolo", "espanhol", "spaans", "hiszpański"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portugués", "portoghese", "portugees", "portugalski"),
    "it": ("it", "ita", "italian", "italiano", "italienisch", "italien", "italiaans", "włoski"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "niederländisch", "néerlandais", "neerlandés", "olandese", "holandês", "holenderski", "flemish", "vlaams"),
    "pl": ("pl", "pol", "polish", "polski", "polnisch", "polonais", "polaco", "polacco", "polonês", "pools"),
    "ru": ("ru", "rus", "russian", "русский", "russisch", "russe", "ruso", "russo", "rosyjski"),
    "ja": ("ja", "jp", "jpn", "japanese", "日本語", "japanisch", "japonais", "japonés", "giapponese", "japonês", "japans", "japoński", "японский"),
}
BUCKETS, ORDERS = 1 << 16, (1, 2, 3, 4)
SAMPLE_ROWS, SMOOTHING = 300, 0.25
#: Letters of running text below which a unit has no language; letters and margin (nats) from which a sentence makes one.
LEAST_LETTERS, SENTENCE_LETTERS, SENTENCE_MARGIN = 40, 15, 6.0
#: Lines from the top and bottom of a unit that may be running headers, footers or headings.
EDGE_LINES = 3

#: Lines that are code, log or header lines by how they begin, and marks that code and tables are full of.
_BEGINS = re.compile(r"\s*(?:\d{4}-\d\d-\d\d[T ]|#|//|--|/\*|[A-Za-z-]+: )")
_MARK = re.compile(r"[{}<>=|\\\t]|\w\(|\)\s*[;{]|_\w+\s*;")
_MAYBE = re.compile(r"[{}<>=|\\\t;(]")
_PAGE_NO = re.compile(r"(?:^|[^\w.,])\d{1,4}\W*$")
_LONG = re.compile(r"\S{40}")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_JOIN = re.compile(r"(?<=[^\W\d_])[-\u2010\u00ad]\n\s*(?=[^\W\d_])")
_SPLIT = re.compile(r"(?<=[。！？])\s*|(?<=[.!?…])\s+|(?<=[.!?…][”\"’»)])\s+")
_ENDS = re.compile(r"[.!?…。！？;:][”\"’»)]*$")
_WORD = re.compile(r"[^\W\d_]+")
_NO_WORD = re.compile(r"[\d_@/\\]")
_STRIP = re.compile(r"[!-~]*[\d_@/\\][!-~]*|[\W\d_]+")


def label_code(label: Column) -> Column:
    """The language that a label names, null if none: codes with or without region and names, in any case."""
    names = F.str_to_map(F.lit(",".join(f"{n}:{code}" for code, own in NAMES.items() for n in own)), F.lit(","), F.lit(":"))
    clean = F.lower(F.regexp_replace(label, r"(?U)^[\s\W_]+|[\s\W_]+$", ""))
    return let(clean, lambda x: F.coalesce(F.try_element_at(names, x), F.try_element_at(names, F.regexp_replace(x, r"[-_. (,;/].*$", ""))))


def _is_code(line: str) -> bool:
    """Lines with a mark of code for every few words; a single mark in a line of text, as scanners make them, is none."""
    if _BEGINS.match(line) or line[-1:].isalnum() and _LONG.search(line) and not _CJK.search(line):
        return True
    return bool(_MAYBE.search(line)) and 5 * len(_MARK.findall(line)) > len(_WORD.findall(line))


def _headings(lines: list[str]) -> set[int]:
    """Lines at the edges of a page or unit that are short, end no sentence and begin in upper case or hold a page number: running headers, footers, headings."""
    wide, n = max(map(len, lines)), len(lines)
    edge = [i for i in range(n) if i < EDGE_LINES or n - 1 - i < EDGE_LINES]
    return {i for i in edge if 4 * len(lines[i]) < 3 * wide and not _ENDS.search(lines[i]) and lines[i][-1] not in "-\u2010\u00ad,;" and (not lines[i][0].islower() or _PAGE_NO.search(lines[i]))}


def sentences(text: str) -> list[str]:
    """Sentences of the running text: without code, log and table lines, headings, running headers and footers, address lines and bare references.

    Lines of one paragraph are joined, at a hyphen without a blank.
    """
    out: list[str] = []
    lines = [x.strip() for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    full = [i for i, x in enumerate(lines) if x]
    aside = {full[i] for i in _headings([lines[i] for i in full])} if len(full) > 1 else set()
    run: list[str] = []
    for i, x in enumerate([*lines, ""]):
        if x and i not in aside and _WORD.search(x) and not _is_code(x):
            run.append(x)
        elif run:
            for s in _SPLIT.split(" ".join(_JOIN.sub("", "\n".join(run)).split())):
                if s and _is_running(s):
                    out.append(s)
            run = []
    return out


def _is_running(s: str) -> bool:
    if _CJK.search(s):
        return len(_CJK.findall(s)) >= 6
    words = _WORD.findall(s)
    low = [w for w in words if w[0].islower()]
    if len(words) < 3 or len(low) < 2 and not s.isupper():
        return False
    return bool(_ENDS.search(s)) or len(words) >= 6


def letters_of(s: str) -> int:
    return sum(map(len, _WORD.findall(s)))


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(buckets, of)``: the bucket of every n-gram and the number of its text.

    Names of files, numbers and everything that is no letter are blanks; letters are in lower case.
    """
    clean = [f" {' '.join(_WORD.findall(t) if not _NO_WORD.search(t) else _STRIP.sub(' ', t).split()).lower()} " for t in texts]
    size = np.array([len(c) for c in clean], dtype=np.int64)
    codes = np.frombuffer("".join(clean).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), size)
    all_b, all_of = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):  # the hash of n characters goes on from that of n - 1
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            inside = of[: len(h)] == of[n - 1 :]
            all_b.append((h[inside] >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1))
            all_of.append(of[: len(h)][inside])
    return (np.concatenate(all_b), np.concatenate(all_of)) if all_b else (np.empty(0, np.int64), np.empty(0, np.int64))


def fit(texts: list[str], labels: list[str]) -> np.ndarray:
    """Log-probabilities, ``BUCKETS`` x languages, float32; labels that a first fit contradicts are left out of the second."""
    if not texts:
        return np.zeros((BUCKETS, len(LANGUAGES)), dtype=np.float32)
    b, of = hashed(texts)
    y = np.array([LANGUAGES.index(x) for x in labels])
    keep = np.ones(len(texts), dtype=bool)
    for _ in range(3):
        flat = (b * len(LANGUAGES) + y[of])[keep[of]]
        counts = np.bincount(flat, minlength=BUCKETS * len(LANGUAGES)).reshape(BUCKETS, -1) + SMOOTHING
        logp = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        # a language without any row is out of the question
        logp[:, np.bincount(y[keep], minlength=len(LANGUAGES)) == 0] = -40.0
        keep = np.asarray(score(b, of, len(texts), logp).argmax(axis=1)) == y
    return logp


def score(b: np.ndarray, of: np.ndarray, n: int, logp: np.ndarray) -> np.ndarray:
    """Sums of the buckets' rows per text; a text's n-grams of one order lie side by side, so runs are added up."""
    out = np.zeros((n, logp.shape[1]), dtype=np.float64)
    for lo in range(0, len(b), 1 << 19):
        own = of[lo : lo + (1 << 19)]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        np.add.at(out, own[starts], np.add.reduceat(logp[b[lo : lo + (1 << 19)]], starts, axis=0))
    return out


def classify(texts: list[str], logp: np.ndarray, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, margin to the second in nats, and a confidence in 0..1, of each text.

    N-grams of one text depend on each other, so their evidence counts like that of the root of their number; ``temperature`` scales
    it to what held-out sentences bear out.
    """
    b, of = hashed(texts)
    s = score(b, of, len(texts), logp)
    order = np.sort(s, axis=1)
    soft = np.exp((s - s.max(axis=1, keepdims=True)) / (temperature * np.sqrt(_grams(of, len(texts))))[:, None])
    return s.argmax(axis=1), order[:, -1] - order[:, -2], soft.max(axis=1) / soft.sum(axis=1)


def _grams(of: np.ndarray, n: int) -> np.ndarray:
    return np.maximum(np.bincount(of, minlength=n), 1)


#: Temperatures tried, coldest first.
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0)


def calibrate(texts: list[str], labels: list[str], parts: int = 5) -> float:
    """The temperature under which sentences that were held out are likeliest, a fifth of them at a time left out of the fit.

    Held-out sentences whose label the fit contradicts by a wide margin carry a wrong label and are left out, as in :func:`fit`.
    """
    if len(texts) < 50:
        return 1.0
    y = np.array([LANGUAGES.index(x) for x in labels])
    loss = np.zeros(len(TEMPERATURES))
    for held in range(parts):
        out = np.arange(len(texts)) % parts == held
        logp = fit([t for t, o in zip(texts, out, strict=True) if not o], [x for x, o in zip(labels, out, strict=True) if not o])
        b, of = hashed([t for t, o in zip(texts, out, strict=True) if o])
        n = int(out.sum())
        s = score(b, of, n, logp)
        own = s[np.arange(n), y[out]]
        fair = s.max(axis=1) - own < 4 * SENTENCE_MARGIN
        z = (s - s.max(axis=1, keepdims=True)) / np.sqrt(_grams(of, n))[:, None]
        for i, t in enumerate(TEMPERATURES):
            x = z[fair] / t
            loss[i] += (np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), y[out][fair]]).sum()
    return TEMPERATURES[int(loss.argmin())]


def labelled_sentences(units: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """Sentences and labels of at most ``rows`` rows of each language; the sample is drawn by hash of the key from all labelled rows."""
    own = units.select(F.col(key).alias("k"), label_code(F.col(label)).alias("lang"), F.col(text).alias("text")).where("lang is not null and length(text) >= 40")
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    u = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * rows / n))).otherwise(share)
    sample = own.where(u < share * (1 << 30)).limit(2 * rows * len(LANGUAGES)).collect()
    seen: dict[str, int] = {}
    texts, labels = [], []
    for r in sorted(sample, key=lambda r: (r.k, r.text)):
        seen[r.lang] = seen.get(r.lang, 0) + 1
        if seen[r.lang] <= rows:
            for s in sentences(r.text):
                texts.append(s)
                labels.append(r.lang)
    return texts, labels


def train(units: DataFrame, key: str, text: str, label: str, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Fits on the sentences of :func:`labelled_sentences`."""
    return fit(*labelled_sentences(units, key, text, label, rows))


def _runs(langs: list[str], enough: list[bool]) -> list[tuple[int, int, str]]:
    """``(first, end, language)`` of runs of successive sentences; a sentence too short to tell goes with the one before, or else after."""
    named = [x if e else None for x, e in zip(langs, enough, strict=True)]
    if not any(named):
        named = langs
    last = next(x for x in named if x)
    runs: list[tuple[int, int, str]] = []
    for i, x in enumerate(named):
        last = x or last
        if runs and runs[-1][2] == last:
            runs[-1] = (runs[-1][0], i + 1, last)
        else:
            runs.append((i, i + 1, last))
    return runs


def segments(units: DataFrame, logp: np.ndarray, key: str = "id", text: str = "unit_text", temperature: float = 1.0) -> DataFrame:
    """``key, segment_no, segment, lang, sentences, letters, margin, confidence``: the stretches of each unit's running text in one language.

    ``sentences`` counts those that are long and plain enough to make a language (15 letters, 5 of Japanese, and a margin of 6 nats), ``margin`` is that of
    the plainest, ``confidence`` the mean by letters. Null, blank and other units without running text have no segments.
    """
    shared = units.sparkSession.sparkContext.broadcast((logp, temperature))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                texts, bounds = [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = sentences(t)
                    if own:
                        bounds.append((k, len(texts), len(texts) + len(own)))
                        texts += own
                if not texts:
                    continue
                best, margin, sure = classify(texts, *shared.value)
                langs = [LANGUAGES[i] for i in best]
                letters = [letters_of(s) for s in texts]
                enough = [n >= (5 if x == "ja" else SENTENCE_LETTERS) and m >= SENTENCE_MARGIN for n, x, m in zip(letters, langs, margin.tolist(), strict=True)]
                rows = []
                for k, i, j in bounds:
                    for no, (f, e, lang) in enumerate(_runs(langs[i:j], enough[i:j]), 1):
                        f, e = i + f, i + e
                        n = sum(letters[f:e])
                        conf = sum(c * w for c, w, x in zip(sure[f:e].tolist(), letters[f:e], langs[f:e], strict=True) if x == lang)
                        told = sum(w for w, x in zip(letters[f:e], langs[f:e], strict=True) if x == lang)
                        rows.append((k, no, " ".join(texts[f:e]), lang, sum(enough[f:e]), n, float(margin[f:e].max()), conf / told if told else 0.0))
                cols = list(zip(*rows, strict=True))
                kinds = [b.schema.field(0).type, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, "segment_no", "segment", "lang", "sentences", "letters", "margin", "confidence"])

    kind = units.schema[key].dataType.simpleString()
    own = units.where(F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")).select(key, text)
    return spread(own).mapInArrow(run, f"{key} {kind}, segment_no int, segment string, lang string, sentences int, letters int, margin double, confidence double")


def units_by_language(parts: DataFrame, key: str = "id") -> DataFrame:
    """``key, lang, sentences, letters, confidence`` for each language that a whole sentence of a unit is in.

    Units with fewer than 40 letters of running text have none. ``confidence`` is how sure the language of those letters is.
    """
    per = parts.groupBy(key, "lang").agg(
        F.sum("sentences").alias("sentences"),
        F.sum("letters").alias("letters"),
        (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"),
    )
    whole = per.groupBy(key).agg(F.sum("letters").alias("_all"), F.collect_list(F.struct("lang", "sentences", "letters", "confidence")).alias("_l")).where(F.col("_all") >= LEAST_LETTERS)
    return whole.select(key, F.explode("_l").alias("l")).select(key, "l.*").where("sentences > 0")


def main_language(langs: DataFrame, key: str = "id") -> DataFrame:
    """``key, lang, confidence, languages``: the language with the most letters of each unit, how sure it is, and how many there are.

    The confidence is that of the language times its share of the letters, since in a mixed text it is only part of the answer.
    """
    best = langs.groupBy(key).agg(F.max(F.struct("letters", "lang", "confidence")).alias("b"), F.sum("letters").alias("all"), F.count("*").alias("languages"))
    return best.select(key, "b.lang", (F.col("b.confidence") * F.col("b.letters") / F.col("all")).alias("confidence"), "languages")


def relabelled(units: DataFrame, langs: DataFrame, key: str = "id", label: str = "unit_language") -> DataFrame:
    """``key, lang`` of the units whose label is missing, wrong or stands for one of several languages.

    A repeated row counts once; of labels that differ the greatest counts.
    """
    own = units.groupBy(key).agg(F.max(label_code(F.col(label))).alias("named"))
    per = langs.groupBy(key).agg(F.collect_set("lang").alias("langs")).join(own, key)
    wrong = (F.size("langs") > 1) | F.col("named").isNull() | ~F.array_contains("langs", F.coalesce("named", F.lit("")))
    return per.where(wrong).select(key, F.explode("langs").alias("lang"))
