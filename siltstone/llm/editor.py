"""A character editor for words from scanned pages: keep, replace, delete, insert, and join over a line's end.

What scanners confuse is not listed anywhere. It is learned from pairs of words that differ in one place: a word
of scanned pages that no other text has, and a word that other texts have. Such pairs also arise by chance and by
inflection, so the same pairs are drawn among the words of the other texts alone; an operation counts as a
confusion where the scanned words show it far more often (:func:`learn_channel` for lists in memory; :mod:`siltstone.llm.scans` counts the pairs of all words by joins).

The editor walks a word's characters. Where the characters at hand can have come from others, it proposes to replace,
delete or insert; a run of such operations is a hypothesis about the word. An averaged perceptron scores a hypothesis by its
operations, their surroundings, and how usual the word is before and after, in scanned and in other texts; keeping
every character scores 0. A second one decides whether a line's last word goes on in the next line. Both are taught with
clean words that are spoiled by the learned channel, or broken, with the pairs aligned character by character.

Words are counted over all texts. The editor never holds the whole count table: it asks for the counts of the words and hypotheses at
issue (a join). All counts enter as rates of the texts' words, so a larger corpus doesn't shift them.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import xxhash

HYPHENS = "-‐¬­"
#: Words that one task teaches the perceptrons, each once at least, and how many more it draws by frequency.
SHARD_WORDS, MORE_WORDS = 8_000, 3_000
#: Wrong hypotheses taught of each word.
WRONG = 6
#: Longest side of an operation, and how much more often than by chance scanned words must show it.
MOST_CHARACTERS, BEYOND_CHANCE = 2, 3.0
#: Least share of all operations that a confusion has.
LEAST_SHARE = 1 / 1000
#: Cells of the table of character triples.
TRIPLE_CELLS = 1 << 18

#: Of an editor without lessons, and of its join.
NO_WEIGHTS: tuple[dict[str, float], dict[str, float]] = ({}, {"b": 1.0})

Step = tuple[int, str, str]
Counts = dict[str, tuple[int, int]]


class Perceptron:
    """Binary averaged perceptron over named features."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w: dict[str, float] = weights or {}

    def score(self, feats: Iterable[str]) -> float:
        get = self.w.get
        return sum(get(f, 0.0) for f in feats)

    def train(self, rows: list[tuple[list[str], bool]], epochs: int = 5, seed: int = 3) -> Perceptron:
        w: dict[str, float] = defaultdict(float)
        acc: dict[str, float] = defaultdict(float)
        rng, t = random.Random(seed), 1
        rows = list(rows)
        for _ in range(epochs):
            rng.shuffle(rows)
            for feats, y in rows:
                s = sum(w[f] for f in feats)
                if (s > 0) != y:
                    d = 1.0 if y else -1.0
                    for f in feats:
                        w[f] += d
                        acc[f] += t * d
                t += 1
        self.w = {f: x - acc[f] / t for f, x in w.items() if x or acc[f]}
        return self


# ------------------------------------------------------------------- channel


def difference(seen: str, printed: str) -> Step:
    """Where two words differ: ``(position, characters seen, characters printed)``, as short as can be."""
    i = 0
    while i < min(len(seen), len(printed)) and seen[i] == printed[i]:
        i += 1
    j = 0
    while j < min(len(seen), len(printed)) - i and seen[-1 - j] == printed[-1 - j]:
        j += 1
    return i, seen[i : len(seen) - j], printed[i : len(printed) - j]


def _holes(word: str) -> Iterator[tuple[str, str]]:
    for i in range(len(word) + 1):
        for h in range(MOST_CHARACTERS + 1):
            if i + h <= len(word):
                yield word[:i], word[i + h :]


def aligned(words: Iterable[str], clean: Iterable[str]) -> Iterator[tuple[str, list[Step]]]:
    """Each word with the ways in which it differs in one place from a clean word."""
    at: dict[tuple[str, str], list[str]] = defaultdict(list)
    for c in clean:
        for k in _holes(c):
            at[k].append(c)
    for w in words:
        near = {c for k in _holes(w) for c in at.get(k, ()) if c != w}
        steps = [d for d in (difference(w, c) for c in sorted(near)) if len(d[1]) <= MOST_CHARACTERS and len(d[2]) <= MOST_CHARACTERS]
        if steps:
            yield w, steps


def learn_channel(scanned_only: list[str], clean: list[str]) -> dict[tuple[str, str], float]:
    """``(seen, printed)`` of what scanners confuse, with its rate among the words that only scanned pages have.

    ``clean`` is in order of frequency: its less frequent half shows how often words differ like that by chance.
    """

    def tally(words: list[str], others: list[str]) -> Counter[tuple[str, str]]:
        n: Counter[tuple[str, str]] = Counter()
        for _, steps in aligned(words, others):
            for _, seen, printed in steps:
                n[seen, printed] += 1 / len(steps)
        return n

    # words are cut at hyphens and apostrophes, so those are no characters of a word
    long = lambda ws: [w for w in ws if 3 <= len(w) <= 24 and not re.search("[-’']", w)]
    scanned_only, clean = long(scanned_only), long(clean)
    rare = clean[len(clean) // 2 :]
    found, chance = tally(scanned_only, clean), tally(rare, clean)
    once = sum(1 for n in chance.values() if n <= 1)
    return confusions([(op, n, chance[op]) for op, n in found.items()], sum(found.values()), once, len(found.keys() - chance.keys()), len(scanned_only), len(rare))


def confusions(found: Iterable[tuple[tuple[str, str], float, float]], whole: float, once: int, new: int, scanned: int, rare: int) -> dict[tuple[str, str], float]:
    """The operations of ``found`` (with how often scanned words and ``rare`` other ones show them) that are confusions, with their rates.

    ``once`` operations came about once at most by chance, ``new`` ones never.
    """
    # an operation not drawn among the clean words may still arise by chance: as often as those that were drawn once suggest (Good and Turing)
    unseen = once / max(1, new)
    out = {}
    for op, n, by_chance in found:
        rate = n / max(1, scanned)
        if n >= (whole or 1.0) * LEAST_SHARE and op[1].isalpha() and rate >= BEYOND_CHANCE * (by_chance + unseen) / max(1, rare):
            out[op] = rate
    return out


# --------------------------------------------------------------- hypotheses


def _cased(seen: str, printed: str, rest: str) -> str:
    if len(rest) > 1 and rest.isupper():
        return printed.upper()
    if seen.isupper() and any(map(str.isalpha, seen)):
        return printed.capitalize() if len(rest) else printed.upper()
    return printed.capitalize() if seen[:1].isupper() else printed


def edits(word: str, channel: Iterable[tuple[str, str]]) -> Iterator[tuple[int, str, str, str]]:
    """``(position, seen, printed, result)`` of every operation that could undo a confusion."""
    low = word.lower()
    if len(low) != len(word):
        return
    for seen, printed in channel:
        i = low.find(seen) if seen else 0
        while 0 <= i <= len(word):
            own = word[i : i + len(seen)]
            p = _cased(own, printed, word[:i] + word[i + len(seen) :])
            if p != own:
                yield i, own, p, word[:i] + p + word[i + len(seen) :]
            i = low.find(seen, i + 1) if seen else i + 1


def apply_steps(word: str, steps: Iterable[Step]) -> str:
    for i, seen, printed in steps:
        word = word[:i] + printed + word[i + len(seen) :]
    return word


def actions(steps: Iterable[Step]) -> list[str]:
    """The operations character by character: what is replaced, deleted and inserted."""
    out = []
    for _, seen, printed in steps:
        both = min(len(seen), len(printed))
        out += [f"replace {a} {b}" for a, b in zip(seen[len(seen) - both :], printed[len(printed) - both :], strict=True) if a != b]
        out += [f"delete {a}" for a in seen[: len(seen) - both]] + [f"insert {b}" for b in printed[: len(printed) - both]]
    return out


# ----------------------------------------------------------------- features


class Lexicon:
    """Counts of the words asked for, in other texts and in scanned ones, the totals of both, and how usual character triples are."""

    def __init__(self, counts: Counts, totals: tuple[int, int] | None = None, triples: dict[int, int] | None = None, types: int | None = None):
        self.counts = counts
        self.totals = totals or (sum(a for a, _ in counts.values()) or 1, sum(s for _, s in counts.values()) or 1)
        if triples is None:
            triples = Counter(c for w, (a, _) in counts.items() if a and len(w) < 30 for c in triple_cells(w))
            types = sum(1 for a, _ in counts.values() if a)
        self.triples, self.rare = triples, max(1.0, 2e-5 * (types or 0))

    def clean(self, w: str) -> int:
        return self.counts.get(w.lower(), (0, 0))[0]

    def scanned(self, w: str) -> int:
        return self.counts.get(w.lower(), (0, 0))[1]

    def rate(self, n: float, which: int) -> str:
        """A count as a rate in half orders of magnitude."""
        return "0" if n <= 0 else str(max(-2, min(7, math.floor(2 * math.log10(1e6 * n / self.totals[which])) // 2)))

    def unlikely(self, w: str) -> int:
        """Triples of the word that hardly any word of other texts has."""
        return sum(self.triples.get(c, 0) <= self.rare for c in triple_cells(w))


def triple_cells(word: str) -> list[int]:
    x = f"^{word.lower()}$"
    return [xxhash.xxh3_64_intdigest(x[i : i + 3]) % TRIPLE_CELLS for i in range(len(x) - 2)]


def _ratio(x: float) -> str:
    return "0" if x <= 0.03 else str(max(-3, min(6, math.floor(math.log2(x)))))


def edit_features(lex: Lexicon, word: str, steps: list[Step], out: str, hidden: bool = False) -> list[str]:
    """Features of a hypothesis. ``hidden`` is for teaching: as if other texts had neither word."""
    cw, sw, co, so = (0 if hidden else lex.clean(word)), lex.scanned(word), (0 if hidden else lex.clean(out)), lex.scanned(out)
    known = "n" if not co and not so else "s" if not co else "k"
    rw, ro, ru = lex.rate(cw, 0), lex.rate(co, 0), lex.rate(sw, 1)
    worse = max(-2, min(3, lex.unlikely(word) - lex.unlikely(out)))
    # how much more usual the result is: both texts together, in parts of their size
    share = lambda a, s: a / lex.totals[0] + s / lex.totals[1]
    floor = 0.5 / max(lex.totals)
    ratio = _ratio(share(co, so) / (share(cw, sw) + floor))
    n = f"{len(steps)}{known}"
    feats = [
        "b", n, f"c{rw}", f"C{ro}", f"s{ru}", f"S{lex.rate(so, 1)}", f"cC{rw}{ro}", f"r{ratio}{known}", f"rc{ratio}{cw > 0}{known}", f"n{n}{ratio}", f"u{worse}{known}", f"uc{worse}{cw > 0}", f"k{known}{cw > 0}", f"ks{known}{ru}{cw > 0}",
        f"l{min(len(word), 6)}{known}{cw > 0}", f"lC{len(word)}{ro}" if len(word) <= 3 else "long", f"cap{word[:1].isupper()}{known}", f"capc{word[:1].isupper()}{word[1:].isupper()}{known}{cw > 0}",
    ]
    now = word
    for i, seen, printed in steps:
        odd = not seen[:1].isalpha()
        near = (now[i - 1].isalpha() if i else False, i + len(seen) < len(now) and now[i + len(seen)].isalpha())
        rest = now[:i] + now[i + len(seen) :]
        kind = "del" if len(seen) > len(printed) else "ins" if len(printed) > len(seen) else "rep"
        low = f"{seen.lower()}>{printed.lower()}"
        feats += [f"o{low}", f"ok{low}{known}", f"or{low}{cw > 0}", f"K{kind}{known}", f"odd{odd}{near}", f"oddk{odd}{known}{cw > 0}", f"oddr{odd}{ratio}", f"m{len(rest) > 2 and rest.isupper()}{seen.islower() and seen.isalpha()}"]
        feats += [f"a{a}" for a in actions([(i, seen.lower(), printed.lower())])]
        now = now[:i] + printed + now[i + len(seen) :]
    return feats


def join_features(lex: Lexicon, left: str, right: str, hyphen: str, whole: str | None = None, hidden: bool = False) -> list[str]:
    """Features of a word broken into ``left`` and ``right``; ``whole`` is the joined word after its own edits."""
    both = lambda w: lex.clean(w) / lex.totals[0] + lex.scanned(w) / lex.totals[1]
    j, h = (0.0, 0.0) if hidden else (both(whole or left + right), both(f"{left}-{right}"))
    a, b = both(left), both(right)
    floor = 0.5 / max(lex.totals)
    rate = lambda x: "0" if x <= 0 else str(max(-2, min(7, math.floor(math.log10(1e6 * x)))))
    q, jh = _ratio(j / (min(a, b) + floor)), _ratio(j / (h + floor))
    g = "h" if hyphen else "n"
    mark = hyphen if hyphen else "n"
    digit = right[:2].isdigit() or right[:1].isdigit() and left.isupper()
    return [
        "b", f"h{mark}", f"j{rate(j)}{g}", f"H{rate(h)}{g}", f"jh{jh}{g}", f"jH{j > 0}{h > 0}{mark}", f"q{q}{g}", f"ab{a > 0}{b > 0}{g}", f"abj{a > 0}{b > 0}{j > 0}{h > 0}{g}", f"r{right[:1].islower()}{g}", f"low{right[:1].islower()}{j > 0}{h > 0}{g}",
        f"u{'_' in left or '_' in right}", f"d{digit}", f"len{min(len(left), 3)}{min(len(right), 3)}{g}", f"qj{q}{j > 0}{g}", f"un{max(-1, min(3, lex.unlikely(left) + lex.unlikely(right) - lex.unlikely(left + right)))}{j > 0}{g}",
    ]


# ----------------------------------------------------------------- teaching


def _spoil(word: str, channel: dict[tuple[str, str], float], rng: random.Random) -> tuple[Step, str] | None:
    """A word with one place misread as the channel does it: the step that undoes it, and the spoiled word."""
    low = word.lower()
    places = [(rate, i, seen, printed) for (seen, printed), rate in channel.items() if printed for i in range(len(word)) if low.startswith(printed, i)]
    if not places:
        return None
    # rare confusions are taught as well: by the root of their rate
    _, i, seen, printed = rng.choices(places, weights=[p[0] ** 0.5 for p in places])[0]
    own = word[i : i + len(printed)]
    return (i, seen, own), word[:i] + seen + word[i + len(printed) :]


class Lessons(NamedTuple):
    """``cases``: word, steps, result, hidden, right; ``breaks``: left, right, hyphen, hidden, right."""

    cases: list[tuple[str, list[Step], str, bool, bool]]
    breaks: list[tuple[str, str, str, bool, bool]]

    def wanted(self) -> set[str]:
        """The words whose counts the lessons need."""
        return {x.lower() for w, _, out, *_ in self.cases for x in (w, out)} | {x.lower() for a, b, *_ in self.breaks for x in (a, b, a + b, f"{a}-{b}")}

    def train(self, lex: Lexicon) -> tuple[dict[str, float], dict[str, float]]:
        """Weights of the editor and of the join."""
        # a spoiled word that other texts have is a word of its own
        rows = [(edit_features(lex, w, s, out, hidden), right) for w, s, out, hidden, right in self.cases if not (right and not hidden and lex.clean(w))]
        joins = [(join_features(lex, a, b, h, hidden=hidden), right) for a, b, h, hidden, right in self.breaks]
        return Perceptron().train(rows).w, Perceptron().train(joins).w


def lessons(words: Counts, channel: dict[tuple[str, str], float], drawn: int = MORE_WORDS, seed: int = 11) -> Lessons | None:
    """What ``words`` with their counts teach, each of them once at least and ``drawn`` more by frequency; None without words."""
    rng = random.Random(seed)
    pool = sorted(w for w, (a, _) in words.items() if a and "-" not in w and 2 <= len(w) <= 24)
    if not pool:
        return None

    def each(ws: list[str], least: int) -> list[str]:
        return ws + rng.choices(ws, k=max(0, least - len(ws))) if ws else []

    weight = [words[w][0] ** 0.5 for w in pool]
    brief = [w for w in pool if len(w) <= 3]
    cases: list[tuple[str, list[Step], str, bool, bool]] = []  # word, steps, result, hidden, right
    for w in rng.choices(pool, weights=weight, k=drawn) + (rng.choices(brief, weights=[words[w][0] ** 0.5 for w in brief], k=drawn // 5) if brief else []) + each(pool, drawn // 4):
        shape = rng.random()
        w = w.capitalize() if shape < 0.25 else w.upper() if shape < 0.33 else w
        hidden = rng.random() < 0.3
        own = list(edits(w, channel))
        cases += [(w, [e[:3]], e[3], hidden, False) for e in rng.sample(own, min(WRONG, len(own)))]
        for e in rng.sample(own, min(2, len(own))):  # two operations on a word that is right
            more = list(edits(e[3], channel))
            cases += [(w, [e[:3], x[:3]], x[3], hidden, False) for x in rng.sample(more, min(2, len(more))) if x[3] != w]
        spoiled = _spoil(w, channel, rng)
        if not spoiled:
            continue
        step, bad = spoiled
        second = _spoil(bad, channel, rng) if rng.random() < 0.2 and len(w) > 4 else None
        if second and second[1] != w:
            worse = second[1]
            one = list(edits(worse, channel))
            first = [e for e in one if e[3].lower() == bad.lower()]
            then = [x for e in first for x in edits(e[3], channel) if x[3].lower() == w.lower()]
            if first and then:
                cases.append((worse, [first[0][:3], then[0][:3]], then[0][3], hidden, True))
            for e in rng.sample(one, min(3, len(one))):
                more = list(edits(e[3], channel))
                cases += [(worse, [e[:3], x[:3]], x[3], hidden, x[3].lower() == w.lower()) for x in rng.sample(more, min(2, len(more)))]
        else:
            all_ = [(bad, [e[:3]], e[3], hidden, e[3].lower() == w.lower()) for e in edits(bad, channel)]
            wrong = [c for c in all_ if not c[4]]
            cases += [c for c in all_ if c[4]] + rng.sample(wrong, min(WRONG, len(wrong)))
    breaks: list[tuple[str, str, str, bool, bool]] = []
    long = [w for w in pool if len(w) >= 5]
    for w in each(long, drawn // 2):
        k = rng.randint(2, len(w) - 2)
        breaks.append((w[:k], w[k:], rng.choice(HYPHENS), rng.random() < 0.25, True))
    known = set(pool)
    for w in each(long, drawn // 2):  # broken without a hyphen, and words that merely follow each other
        k = rng.randint(2, len(w) - 2)
        breaks.append((w[:k], w[k:], "", False, not (w[:k] in known and w[k:] in known)))
        breaks.append((rng.choice(pool), rng.choice(pool), "", False, False))
    compounds = [w for w, (a, _) in words.items() if a and w.count("-") == 1]
    for w in each(compounds, drawn // 2):
        a, b = w.split("-")
        if a and b:
            breaks.append((a, b, "-", False, False))
    for w in rng.choices(pool, k=drawn // 20):  # names and references keep their own hyphen
        breaks += [(w[:2].upper(), str(rng.randint(10, 9999)), "-", False, False), (f"{w}_{w[:2]}", f"{rng.randint(1, 9999)}.{w[:3]}", "-", False, False)]
    return Lessons(cases, breaks)


def train_editor(words: Counts, channel: dict[tuple[str, str], float], look: Callable[[set[str]], Lexicon], drawn: int = MORE_WORDS, seed: int = 11) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of the editor and of the join, taught in one go; ``look`` gives the counts of other words."""
    own = lessons(words, channel, drawn, seed)
    return own.train(look(own.wanted())) if own else NO_WEIGHTS
