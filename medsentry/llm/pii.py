"""Personal data in whole texts, disguised forms included, with exact source offsets.

Plain identifiers are found in the text itself. Texts that show signs of a disguise go through
three transducers (look-alike characters, spelled digits, at/dot words); each keeps, for every
character it writes, the span of source characters it stands for. The same detectors run on the
normalised text, and their spans are mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
_RANK = {k: i for i, k in enumerate(KINDS)}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin inside a run of digits, as the run's start would have matched; so starts there are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of local part, @ and dotted domain, found from each @ leftward in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            out.append((start, m.end()))
        free = m.end() if m else max(free, at + 1)
        at = text.find("@", free)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the undisguised identifiers, ordered by start and kind."""
    out = [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], _RANK[s[1]]))


#: Letters of other scripts that look like Latin ones, and their Latin look-alikes.
_LOOKS = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοια", "ABESIJKMHOPCTXYaesijopcyxhdqwABEZHIKMNOPTYXoia", strict=True))
#: Characters that show nothing.
_HIDDEN = frozenset("­​‌‍‎‏⁠﻿")
#: Spoken digits of the corpus' languages.
_DIGITS = {
    w: str(i)
    for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve", "zero um dois três quatro cinco seis sete oito nove")
    for i, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2", "fuenf": "5", "ein": "1", "une": "1", "una": "1", "tres": "3"}
_TIMES = {"double": 2, "triple": 3, "doppel": 2, "doble": 2}
_PLUS = ("plus", "más", "mas", "mais")
_POINTS = {"dot", "point", "punkt", "punto", "ponto"}
_ODD = re.compile("[­Ͱ-ԯ​-‏‐-―․⁠−。﹒﹫﻿！-～٠-٩۰-۹⁰-₉\U0001d400-\U0001d7ff]")
_NUMERAL = "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in _DIGITS if w[0] == c), key=len, reverse=True))})" for c in sorted({w[0] for w in _DIGITS}))
_SPOKEN = re.compile(rf"(?i)\b(?:{_NUMERAL})(?:[ ,.-]{{1,2}}(?:{_NUMERAL}|{'|'.join(_TIMES)}|{'|'.join(_POINTS)}|dash|[0-9])){{5,}}\b")
_AT, _DOT = {"at", "arroba", "chez", "ät", "bei", "@"}, _POINTS | {"."}
_WORD = re.compile(rf"(?i)\s*[\[({{<]\s*({'|'.join(sorted(x for x in (_AT | _DOT) if x.isalpha()))}|@|\.)\s*[\])}}>]\s*")
#: Last parts of spoken or spaced addresses, so that "the at sign. Then" is none.
_LAST = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|app|dev|ai|xyz|online|site|shop|tv|eu|uk|us|ca|au|nz|in|de|at|ch|fr|es|it|nl|be|se|no|dk|fi|pl|cz|pt|br|mx|ar|cl|jp|cn|kr|ru|ie|gr|tr|za"
_SAY_DOT = "|".join(sorted(_POINTS))
_PART = r"(?!(?:a|an|the|this|that|one|each|der|die|das|le|la|les|un|une|el|los|las|uno|una)\b)[A-Za-z0-9-]+"
# Local part, at, parts of the domain; either the at or a dot is spoken or spaced.
_DOMAIN_SAID = (
    rf"{_PART}(?:(?: (?:{_SAY_DOT}) | \. |\.)[A-Za-z0-9-]+)*?(?P<dot> (?:{_SAY_DOT}) | \. |\.)(?:{_LAST})(?![A-Za-z0-9]|\.[A-Za-z0-9]| ?(?:{_SAY_DOT}) (?:{_LAST})\b)"
)
_LOOSE = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:(?: (?:{_SAY_DOT}) |\.)[A-Za-z0-9_%+-]+){{0,3}}(?P<at> ?@ ?| (?:at|arroba) ){_DOMAIN_SAID}")
# What shows that a transducer could change a text; the last two are for lower-case text.
_AFTER = re.compile(rf"(?i) ?{_DOMAIN_SAID}")
_BRACKET = re.compile(rf"[\[({{<]\s*(?:{'|'.join(sorted(x for x in (_AT | _POINTS) if x.isalpha()))}|@|\.)\s*[\])}}>]")
_COUNTING = re.compile(rf"\b(?:{_NUMERAL})[ ,.-]{{1,2}}(?:(?:{_NUMERAL}|{'|'.join(_TIMES)}|{'|'.join(_POINTS)}|dash|[0-9])[ ,.-]{{1,2}}){{2}}")
# "name at example.com" is ordinary speech; it is an address after such a word, or if the name looks like no word.
_CUE = re.compile(r"(?i)\b(?:e-?mail|mail|mailto|contact|contacto|contacter|kontakt|reach|write|écrire|escribir|schreib\w*|courriel|correo|address|adresse|reply)\b[^.!?]{0,40}$")
_UNWORDLY = re.compile(r"[0-9_%+.]|-")


class Mapped:
    """A text and the span of source characters behind each of its characters."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace non-overlapping spans, in order; each new character stands for its whole span."""
        text, first, last, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.first, self.last = first + self.first[at:], last + self.last[at:]


def _unlike(m: Mapped) -> None:
    edits = []
    for hit in _ODD.finditer(m.text):
        c = hit[0]
        n = "" if c in _HIDDEN else _LOOKS.get(c) or ("-" if "‐" <= c <= "―" or c == "−" else "." if c == "。" else unicodedata.normalize("NFKC", c))
        if n != c and n.isascii():
            edits.append((hit.start(), hit.end(), n))
    m.rewrite(edits)


def _spell(m: Mapped) -> None:
    edits = []
    for hit in _SPOKEN.finditer(m.text):
        out, many = [], 1
        for p in re.finditer(r"[^\W\d_]+|[0-9]", hit[0]):
            w = p[0].lower()
            if w in _TIMES:
                many = _TIMES[w]
            elif w in _POINTS:
                out.append((p.start(), p.end(), "."))
            elif w != "dash":
                out.append((p.start(), p.end(), _DIGITS.get(w, w) * many))
                many = 1
        at = hit.start()
        for i, (a, b, new) in enumerate(out):  # the gap after a digit goes with it, so digits join
            until = out[i + 1][0] if i + 1 < len(out) else b
            edits.append((at + a, at + until, new))
        before = m.text[max(0, at - 8) : at]
        sign = next((w for w in _PLUS if before.rstrip().lower().endswith(w)), None)
        if sign:
            p = at - len(before) + len(before.rstrip()) - len(sign)
            if not edits[: len(edits) - len(out)] or edits[len(edits) - len(out) - 1][1] <= p:
                edits.insert(len(edits) - len(out), (p, at, "+"))
    m.rewrite(edits)


def _join(m: Mapped) -> None:
    m.rewrite([(h.start(), h.end(), "@" if h[1].lower() in _AT else ".") for h in _WORD.finditer(m.text)])
    edits = []
    for h in _LOOSE.finditer(m.text):
        said_at, said_dot = h["at"].strip() != "@", any(x in _POINTS for x in h[0].lower().split())
        if said_at and not said_dot:
            name = h[0][: h.start("at") - h.start()]
            if not _UNWORDLY.search(name) and not _CUE.search(m.text[max(0, h.start() - 60) : h.start()]):
                continue
        for w in re.finditer(rf"(?i) (?:{_SAY_DOT}|at|arroba) | ?@ ?| ?\. ?", h[0]):
            edits.append((h.start() + w.start(), h.start() + w.end(), "@" if w[0].strip().lower() in _AT else "."))
    m.rewrite(edits)


def disguised(text: str) -> bool:
    """Whether a transducer could change the text."""
    low = text.lower()
    if (not text.isascii() and _ODD.search(text)) or _BRACKET.search(low) or _COUNTING.search(low):
        return True
    for sign in ("@", " at ", " arroba "):
        # Lower-casing can move places, so such texts are looked through as a whole.
        if sign in low and (len(low) != len(text) or any(_AFTER.match(text, m.end()) for m in re.finditer(sign, low))):
            return True
    return False


def spans(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The plain spans, and all spans: the plain ones and those only the normalised text shows.

    An added span doesn't overlap a plain one of its kind.
    """
    text = text or ""
    base = plain_spans(text)
    if not disguised(text):
        return base, base
    m = Mapped(text)
    for step in (_unlike, _spell, _join):
        step(m)
    more = []
    for a, kind, b in plain_spans(m.text):
        s = (m.first[a], kind, m.last[b - 1])
        if not any(k == kind and x < s[2] and s[0] < y for x, k, y in base):
            more.append(s)
    return base, sorted({*base, *more}, key=lambda s: (s[0], _RANK[s[1]], s[2]))


def listed(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of plain spans of each kind, base_sha256, spans, n_added for each row.

    Offsets count code points, ends are exclusive. Disguises are look-alike and hidden characters, digits
    spelled in English, German, French, Spanish or Portuguese, and addresses whose at or dot is
    bracketed, spoken or spaced. Cases: a null or empty text has no spans;
    repeated rows each give a row; very long texts are read whole in linear time; other columns
    are not read.
    """

    def make():
        def each(batch):
            out = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")}
            for text in batch.column(1):
                base, every = spans(text.as_py())
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out["spans"].append(listed(every))
                out["n_added"].append(len(every) - len(base))
            yield out | {"doc_id": batch.column(0).to_pylist()}

        return each

    fields = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), make, pa.schema(fields), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for a, kind, b in spans(text)[1]:
        if a >= at:
            out += (text[at:a], f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data masked and the length column, if there is one, set anew; null texts stay null.

    Cases: empty texts and texts without a span stay as they are; long texts are masked whole; repeated
    rows and null ids are like any other; columns may have any names.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else masked(t))

    out = docs.withColumn(text_col, mask(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out
