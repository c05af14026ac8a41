"""Benchmark decontamination by template windows.

Numbers, units and names become typed placeholders, so a question whose parameters were changed
keeps its template. Windows of canonical words are hash-joined with those of the benchmark; a
document's windows of an item must fill the item's slots consistently, and together make up at
least four fifths of its windows. Windows of literal words count as well, so a copy whose
capitals are gone, and with them its names, is found too.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, CONTAINED = 5, 0.8
#: Windows of the benchmark that a worker holds at once; a larger benchmark is matched in as many passes.
IN_MEMORY = 1_000_000
_EDGE = re.compile(r"^[^\w%$€£]+|[^\w%$€£]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*")
#: Spelled numbers and units of measure.
_SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_UNITS = frozenset("% percent kg g mg kilogram kilograms gram grams km m cm mm kilometer kilometers kilometre kilometres meter meters metre metres mile miles inch inches foot feet yard yards second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents pound pounds ounce ounces liter liters litre litres ml gallon gallons degree degrees lb lbs oz ft yd yds mph kph km/h ms sec secs min mins hr hrs ton tons tonne tonnes milligram milligrams millimeter millimeters millimetre millimetres centimeter centimeters centimetre centimetres milliliter milliliters millilitre millilitres quart quarts pint pints cup cups tsp tbsp teaspoon teaspoons tablespoon tablespoons acre acres hectare hectares decade decades celsius fahrenheit watt watts kw kwh".split())
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode())


_NAME = _hash("<name>")


def canonical(word: str) -> tuple[str, str, bool, bool]:
    """Literal form, template form, whether it could be a name, whether a sentence ends with it."""
    bare = _EDGE.sub("", word)
    low = bare.lower()
    number = _NUMBER.match(low)
    if low in _SPELLED:
        form = "<number>"
    elif low in _UNITS:
        form = "<unit>"
    elif number:
        rest = low[number.end() :]
        form = "<number>" + ("<unit>" if rest in _UNITS else rest)
    else:
        form = low
    return low, form, bare[:1].isupper() and not bare.isupper() and form == low, word[-1:] in ".!?:|"


class Words(dict):
    """Word -> number, and arrays of the words' properties. The first ``keep`` words stay; ``trim`` (between texts) drops later ones when there are ``most``."""

    def __init__(self, keep: int = 250_000, most: int = 400_000, room: int = 64_000_000):
        super().__init__()
        self.keep, self.most, self.room, self.names, self.held = keep, most, room, [], 0
        self.literal, self.form = np.zeros(most, np.uint64), np.zeros(most, np.uint64)
        self.slot, self.name, self.ends, self.bare = (np.zeros(most, bool) for _ in range(4))

    def _add(self, word: bytes) -> None:
        i = self[word] = len(self.names)
        self.names.append(word)
        self.held += len(word)
        if i >= len(self.literal):
            self.literal, self.form, self.slot, self.name, self.ends, self.bare = (np.concatenate((x, np.zeros_like(x))) for x in (self.literal, self.form, self.slot, self.name, self.ends, self.bare))
        low, form, self.name[i], self.ends[i] = canonical(word.decode())
        self.literal[i] = _hash(low)
        self.form[i] = self.literal[i] if form is low else _hash(form)
        self.slot[i], self.bare[i] = "<" in form, bool(low)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        missing = np.nonzero(found < 0)[0]
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            for word in new:
                if word not in self:
                    self._add(word)
            found[missing] = [self[word] for word in new]
        return found

    def trim(self) -> None:
        while len(self.names) > self.most or self.held > self.room and len(self.names) > 1:
            keep = self.keep if len(self.names) > self.most else (len(self.names) + 1) // 2
            for word in self.names[keep:]:
                del self[word]
                self.held -= len(word)
            del self.names[keep:]


@cache
def _words() -> Words:
    """One for each process: Python workers run many tasks."""
    return Words()


class Text:
    """A text's words without bare punctuation: hashes of their forms, and which are slots.

    ``form`` leaves sentences' first words as they are, ``open_form`` takes capitalised ones for names as well.
    """

    def __init__(self, text: str, words: Words):
        words.trim()
        raw = text.encode().split()
        n = words.numbers(raw)
        ends = np.concatenate(([True], words.ends[n[:-1]])) if len(n) else np.zeros(0, bool)
        keep = words.bare[n]
        self.words = raw if keep.all() else [w for w, k in zip(raw, keep, strict=True) if k]
        n, ends = n[keep], ends[keep]
        name = words.name[n] & ~ends
        self.literal, self.form, self.slot = words.literal[n], np.where(name, np.uint64(_NAME), words.form[n]), words.slot[n] | name
        self.open_form, self.open_slot = np.where(words.name[n], np.uint64(_NAME), words.form[n]), words.slot[n] | words.name[n]

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the literal and of the two kinds of template windows of ``size`` words."""
        return tuple(_roll(x, size) for x in (self.literal, self.form, self.open_form))

    def value(self, i: int) -> str:
        return _EDGE.sub("", self.words[i].decode()).lower()


def _places(literal: np.ndarray, form: np.ndarray, open_form: np.ndarray) -> dict[int, set[int]]:
    """Where a text has each window hash, of any kind."""
    out: dict[int, set[int]] = defaultdict(set)
    for h in (literal, form):
        for p, x in enumerate(h.tolist()):
            out[x].add(p)
    for p in np.nonzero(open_form != form)[0].tolist():
        out[int(open_form[p])].add(p)
    return out


def _roll(x: np.ndarray, size: int) -> np.ndarray:
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h += x[k : k + n] * _MULTIPLIERS[k]
    return h ^ (h >> np.uint64(29))


class Matcher:
    """Finds the benchmark items that a text has whole or nearly whole.

    A text with enough of an item's windows has one of its rarest few, so only those find it; windows that
    many items share, such as a closing instruction, are looked at for items that are found. An item of
    placeholders alone has no template to be known by; only its literal words find it.
    """

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, contained: float = CONTAINED):
        self.contained, self.words, self.names, self.items, self.total = contained, _words(), [], [], []
        #: Of each item, (window, kind, hash, size) of what is searched for; and what any row of numbers fits, which counts only beside that.
        self.own: list[list] = []
        self.blank: list[list] = []
        for name, text in items:
            t = Text(text, self.words)
            size = min(window, len(t.words))
            if not size:
                continue
            slots, open_slots = ([t.value(i) if s else None for i, s in enumerate(x.tolist())] for x in (t.slot, t.open_slot))
            literal, form, open_form = (w.tolist() for w in t.windows(size))
            own, blank = [], []
            for i, (a, b, c) in enumerate(zip(literal, form, open_form, strict=True)):
                own.append((i, 0, a, size))
                for kind, h, known, slot in ((1, b, a, t.slot), (2, c, b, t.open_slot)):
                    if h != known:
                        (blank if slot[i : i + size].all() else own).append((i, kind, h, size))
            self.names.append(name)
            self.items.append((slots, open_slots))
            self.total.append(len(literal))
            self.own.append(own)
            self.blank.append(blank)
        self._index()

    def _index(self) -> None:
        """Post each item under the rarest of its windows that any text with enough of them must have one of."""
        common = Counter(h for own in self.own for *_, h, _ in own)
        self.posts: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for k, (own, blank) in enumerate(zip(self.own, self.blank, strict=True)):
            seen: dict[int, int] = defaultdict(int)
            for i, _, h, _ in own:
                seen[i] = max(seen[i], common[h])
            anybody = {i for i, *_ in blank}
            sure = sorted((n, i) for i, n in seen.items() if i not in anybody)
            # Of the windows with words of their own so many are needed, if all the others are there.
            least = math.ceil(self.contained * self.total[k] - 1e-9) - len(anybody)
            anchors = {i for _, i in sure[: len(sure) - least + 1]} if least > 0 else set(seen)
            for i, _, h, size in own:
                if i in anchors:
                    self.posts[size][h].append(k)
        self.filters = {}
        for size, posts in self.posts.items():
            bits = np.zeros(1 << 22, bool)
            bits[(np.fromiter(posts, np.uint64, len(posts)) & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.filters[size] = bits

    def match(self, text: str | None) -> list[tuple[int, float]]:
        """(item, share of its windows) for the items of which at least ``contained`` is there."""
        if not text or not self.items:
            return []
        t = Text(text, self.words)
        forms, found = {}, set()
        for size, posts in self.posts.items():
            literal, form, open_form = forms[size] = t.windows(size)
            changed = np.nonzero(open_form != form)[0]
            for h in (literal, form, open_form[changed]):
                maybe = np.nonzero(self.filters[size][(h & np.uint64((1 << 22) - 1)).astype(np.int64)])[0]
                for x in set(h[maybe].tolist()):
                    found.update(posts.get(x, ()))
        out: dict[int, float] = {}
        places: dict[int, dict[int, set]] = {}
        for k in found:
            size = self.own[k][0][3]
            if size not in places:
                places[size] = _places(*forms[size])
            at = places[size]
            need = self.contained * self.total[k] - 1e-9
            there = {i for i, _, h, _ in self.own[k] if h in at}
            if not there or len(there | {i for i, *_ in self.blank[k]}) < need:
                continue
            hits = [(p, i, kind, size) for i, kind, h, _ in self.own[k] for p in at.get(h, ())]
            if self.blank[k]:
                for start in {p - i for p, i, *_ in hits}:
                    for i, kind, h, _ in self.blank[k]:
                        if 0 <= start + i < len(forms[size][kind]) and forms[size][kind][start + i] == h:
                            hits.append((start + i, i, kind, size))
            if len({h[1] for h in hits}) >= need and (best := self._best(k, sorted(set(hits)), t)) >= need:
                out[self.names[k]] = max(out.get(self.names[k], 0.0), best / self.total[k])
        return sorted(out.items())

    def _best(self, name: int, hits: list, t: Text) -> int:
        """The most windows of the item in one place of the text whose slots agree."""
        reach, groups = 2 * len(self.items[name][0]) + 8, []
        for h in hits:
            if not groups or h[0] - groups[-1][0][0] > reach:
                groups.append([])
            groups[-1].append(h)
        # A copy may straddle the border of two groups, so neighbours are looked at together as well.
        groups += [a + b for a, b in zip(groups, groups[1:], strict=False)]
        return max(self._agreeing(self.items[name], g, t) for g in groups + self._aligned(name, hits))

    def _aligned(self, name: int, hits: list) -> list[list]:
        """Hits that would begin the item at about the same word: copies beside each other are looked at apart."""
        slack, out, end = max(1, len(self.items[name][0]) // 4), [], 0
        need = self.contained * self.total[name] - 1e-9
        hits = sorted(hits, key=lambda h: h[0] - h[1])
        starts = [p - i for p, i, *_ in hits]
        for at, start in enumerate(starts):
            if at and start == starts[at - 1]:
                continue
            while end < len(hits) and starts[end] <= start + slack:
                end += 1
            if end - at >= need:
                out.append(hits[at:end])
        return out

    @staticmethod
    def _agreeing(slots: tuple[list, list], hits: list, t: Text) -> int:
        """Windows whose slots agree: each value of the item has one value in the text; two may have the same."""
        plain = {i for _, i, kind, _ in hits if not kind}
        filled = []
        for p, i, kind, size in hits:
            if kind and i not in plain:
                own = slots[kind - 1]
                filled.append((i, kind, [(own[i + k], t.value(p + k)) for k in range(size) if own[i + k] is not None]))
        best = len(plain)
        for most in (1, 2):  # without and with names that begin a sentence
            votes: dict[str, Counter] = defaultdict(Counter)
            for _, kind, pairs in filled:
                if kind <= most:
                    for a, b in pairs:
                        votes[a][b] += 1
            one = {a: max(v, key=lambda b: (v[b], b)) for a, v in votes.items()}
            fits = {i for i, kind, pairs in filled if kind <= most and all(one[a] == b for a, b in pairs)}
            best = max(best, len(plain | fits))
        return best


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int):
    """Lists of (item, text) with at most about ``most`` words each, streamed through the driver."""
    block, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t")).filter("t is not null and i is not null").orderBy("i", "t").toLocalIterator():
        block.append((r.i, r.t))
        held += r.t.count(" ") + 1
        if held >= most:
            yield block
            block, held = [], 0
    yield block


def with_matches(docs: DataFrame, benchmark: DataFrame, column: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, contained: float = CONTAINED, in_memory: int = IN_MEMORY) -> DataFrame:
    """``docs`` with an array of (item_id, containment) in ``column``.

    The benchmark goes to the workers in blocks of ``in_memory`` windows; all but very large ones
    are one block, and each further block is one more pass over the stored rows.
    """
    sc, out = docs.sparkSession.sparkContext, None
    for block in _blocks(benchmark, item_id, item_text, in_memory):
        sent = sc.broadcast(block)

        found = _finder(sent, window, contained)
        out = docs.withColumn(column, found(F.col(text_col))) if out is None else stored(out, "matches").withColumn(column, F.concat(F.col(column), found(F.col(text_col))))
    return out


def _finder(sent, window: int, contained: float):
    @F.pandas_udf("array<struct<item_id bigint, containment double>>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(sent.value, window, contained)
        for texts in parts:
            yield texts.map(lambda t: [{"item_id": i, "containment": c} for i, c in m.match(t)])

    return found


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined), containment (the highest) for each row.

    Cases: null and empty texts have nothing; null and empty items are skipped, an item of fewer
    words than a window is one window; repeated items with one id count once in n_items; repeated
    rows each give a row; whole texts are read; other columns are not.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    m = with_matches(rows, benchmark, "found", "text", **how)
    ids = F.array_sort(F.array_distinct(F.col("found.item_id")))
    return m.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size(ids).cast("bigint").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.coalesce(F.array_max("found.containment"), F.lit(0.0)).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; all columns stay.

    Cases: null and empty texts stay, as do all rows if the benchmark is empty; long texts are read whole;
    of repeated rows all stay or go; null ids are like any other; columns may have any names.
    """
    column = "found"
    while column in docs.columns:
        column += "_"
    return with_matches(docs, benchmark, column, text_col, **how).filter(F.size(column) == 0).drop(column)
