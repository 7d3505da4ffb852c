"""Problem 2: personal information in free text, by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs however spelled, schemes, cues of
identity numbers, starts of telephone numbers, street words and the names of a roster. From each
anchor a deterministic local parser expands to the whole value and validates its boundaries. Texts
are scanned once, where they are read; nothing is shuffled.

The roster is the one side table; it is sent to the tasks and may have at most ``MAX_NAMES`` rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NAMES = 1_000_000

# Spellings of the at-sign, cues and street words
AT_SIGNS = ["@", "%40", "(at)", "[at]", "{at}", "<at>", " at ", "&#64;"]
IDENTITY_CUES = {
    "ssn": "social", "social security": "social", "social insurance": "social",
    "tax id": "tax", "tax-id": "tax", "tax no": "tax", "taxpayer": "tax", "steuer-id": "tax", "steuer id": "tax", "steuernummer": "tax", "steueridentifikationsnummer": "tax", "itin": "tax",
    "dni": "national", "documento": "national", "nif": "national", "nie": "national", "national id": "national", "identity card": "national", "id card": "national", "personalausweis": "national", "carte d'identité": "national",
    "passport": "passport", "reisepass": "passport", "passeport": "passport", "pasaporte": "passport",
}
PHONE_CUES = ["tel", "phone", "call ", "cell", "mobile", "ring ", "number", "fax", "handy", "móvil", "dial "]
PHONE_STARTS = ["+", "(", "00", "01", "02", "03", "04", "05", "06", "07", "08", "09"]
STREET_WORDS = ["street", "st.", "road", "rd.", "avenue", "ave.", "lane", "ln.", "blvd", "boulevard", "drive", "court", "terrace"]
OTHER_STREETS = ["straße", "strasse", "weg", "gasse", "platz", "allee", "str.", "rue ", "avenue ", "boulevard ", "chemin ", "calle ", "avda", "avenida ", "plaza ", "paseo ", "camino "]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity": "[ID]", "street": "[ADDRESS]", "person": "[PERSON]"}

_LOCAL = re.compile(r"[^\W_](?:[\w.+\-']*[^\W_])?$")
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_DOT = r"(?:\.|\s+dot\s+|\s*[\[({]dot[\])}]\s*)"
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.IGNORECASE)
_NUMBER_FORMS = {
    "social": re.compile(r"[^\d\n]{0,24}?(?<!\d)(\d{3}([- .]?)\d{2}\2\d{4})(?![\w])"),
    "tax": re.compile(r"[^\d\n]{0,24}?(?<![\d.])(\d{2} \d{3} \d{3} \d{3}|\d{2}-\d{7}|\d{3}-\d{2}-\d{4}|\d{9,11})(?!\w)"),
    "national": re.compile(r"[^\d\n]{0,24}?(?<![\w])([XYZ]?\d{7,8}[- ]?[A-Z])(?!\w)", re.IGNORECASE),
    "passport": re.compile(r"[^\d\n]{0,24}?(?<![\w])([A-Z]{1,2}\d{6,9})(?!\w)", re.IGNORECASE),
}
# The same numbers where they stand before their cue; the gap ends where the cue begins and holds no end of a sentence
_NUMBERS_BEFORE = {
    "social": re.compile(r"(?<![\w./+-])(\d{3}([- .]?)\d{2}\2\d{4})(?!\w)(?P<gap>[^\d\n.;!?]{0,24})\Z"),
    "tax": re.compile(r"(?<![\w./+-])(\d{2} \d{3} \d{3} \d{3}|\d{2}-\d{7}|\d{3}-\d{2}-\d{4}|\d{9,11})(?!\w)(?P<gap>[^\d\n.;!?]{0,24})\Z"),
    "national": re.compile(r"(?<![\w./+-])([XYZ]?\d{7,8}[- ]?[A-Z])(?!\w)(?P<gap>[^\d\n.;!?]{0,24})\Z", re.IGNORECASE),
    "passport": re.compile(r"(?<![\w./+-])([A-Z]{1,2}\d{6,9})(?!\w)(?P<gap>[^\d\n.;!?]{0,24})\Z", re.IGNORECASE),
}
# What stands between a cue and a number of something else: the end of a clause or another cue
_PARTED = re.compile(r"(?<!\bno)(?<!\bnr)[.,;!?](?=\s)|(?<!\w)(?:" + "|".join(map(re.escape, IDENTITY_CUES)) + r")(?!\w)", re.IGNORECASE)
_PHONE_FORMS = [
    re.compile(r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"),
    re.compile(r"\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,5}(?:[ .\-/]?\d{2,8}){1,5}(?![\d])"),
    re.compile(r"\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"),
    re.compile(r"\(0\d{1,4}\)[ ]?\d{3,8}(?:[ -]\d{2,6})?(?!\d)"),
    re.compile(r"00[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}[ .-]\d{3,9}(?:[ .-]\d{2,8}){0,3}(?!\d)"),
    re.compile(r"0[1-9]([. ])\d{2}(?:\1\d{2}){3}(?!\d)"),
    re.compile(r"0\d{2,4}/\d{4,9}(?:-\d{1,5})?(?!\d)"),
    re.compile(r"0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?!\d)"),
]
_US_PHONE = re.compile(r"(?<![\w.+#/-])\d{3}([-. ])\d{3}\1\d{4}(?![\w-]|\.\d)")
_CUED = re.compile(r"[^\d\n+(]{0,20}?((?<![\w.])[+(]?\d[\d ()./-]{5,18}\d)(?!\w)")
_CAPITAL = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_FLAT = r"(?:,? (?:[Aa]pt|APT|[Aa]partment|[Ff]lat|[Uu]nit|[Ss]uite|[Ss]te|#)\.? ?\w+)?"
_ENGLISH = re.compile(
    rf"(?<![\w.])\d{{1,5}}[a-zA-Z]?,? (?:(?:N|S|E|W)\.? )?(?:{_CAPITAL} ){{1,3}}?"
    r"(?:Street|STREET|street|St\.?|ST\.|Road|ROAD|Rd\.|Avenue|AVENUE|Ave\.|Lane|LANE|Ln\.|Boulevard|BOULEVARD|Drive|DRIVE|Dr\.|Court|COURT|Ct\.|Terrace|TERRACE|Blvd|BLVD)(?!\w)" + _FLAT
)
_GERMAN = re.compile(rf"(?<![\w-]){_CAPITAL}(?:straße|strasse|STRASSE|STRAßE|weg|WEG|gasse|GASSE|platz|PLATZ|allee|ALLEE|str\.| Allee| ALLEE| Straße| Strasse| STRASSE| Weg| WEG| Platz| PLATZ| Gasse) \d{{1,4}} ?[a-z]?(?!\w)")
_FRENCH = re.compile(rf"(?<![\w.])\d{{1,4}}(?: ?bis| ?ter)?,? (?:rue|avenue|boulevard|chemin|place|RUE|AVENUE)(?: (?:de la|de l'|du|des|de|d'|DE))? {_CAPITAL}(?: {_CAPITAL})?")
_SPANISH = re.compile(rf"(?<!\w)(?:Calle|CALLE|Avda\.?|AVDA\.?|Avenida|AVENIDA|Plaza|PLAZA|Paseo|PASEO|Camino|C/)(?: (?:de la|de los|del|de|DE))? {_CAPITAL}(?: {_CAPITAL})?,? (?:n\.?º? ?)?\d{{1,4}} ?[a-z]?(?!\w)")
_INITIAL_BEFORE = re.compile(r"(?<![\w.'’-])[^\W\d_]\. ?$")
_MIDDLE = re.compile(r" [^\W\d_]\.? $")
_INITIAL_AFTER = re.compile(r", [^\W\d_]\.")


def _same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _plain(text: str) -> str:
    """The text with the escapes of JSON blanked, if it is JSON, at the same length."""
    if text[:1] in "[{" and "\\" in text:
        return re.sub(r"\\[nrt\"/]", "  ", text)
    return text


class Scanner:
    """Finds the items of one text at a time; ``names`` are (given, family) rows."""

    def __init__(self, names: list[tuple[str | None, str | None]]):
        self.given = {_same_length_lower(g.strip()) for g, _ in names if g and g.strip()}
        self.family = {_same_length_lower(f.strip()) for _, f in names if f and f.strip()}
        kinds: dict[str, set[str]] = {}
        for word in AT_SIGNS:
            kinds.setdefault(word, set()).add("at")
        for word in IDENTITY_CUES:
            kinds.setdefault(word, set()).add("identity")
        for word in PHONE_STARTS:
            kinds.setdefault(word, set()).add("phone")
        for word in PHONE_CUES:
            kinds.setdefault(word, set()).add("call")
        for word in STREET_WORDS + OTHER_STREETS:
            kinds.setdefault(word, set()).add("street")
        for word in self.given | self.family:
            kinds.setdefault(word, set()).add("name")
        self.automaton = ahocorasick.Automaton()
        for word, what in kinds.items():
            self.automaton.add_word(word, (word, frozenset(what)))
        self.automaton.make_automaton()

    def find(self, original: str) -> list[tuple[int, int, str]]:
        """Non-overlapping (start, end, type) in order of place; e-mail and street addresses go before the rest."""
        text = _plain(original)
        low = _same_length_lower(text)
        emails, streets, identities, phones, names = [], [], [], [], []
        for last, (word, what) in self.automaton.iter(low):
            start, end = last + 1 - len(word), last + 1
            if "at" in what and (span := _email(text, low, start, end, word)):
                emails.append(span)
            if "street" in what:
                streets += _street(text, start, end)
            if "identity" in what:
                identities += _identity(text, low, start, end, word)
            if "phone" in what and (span := _phone(text, start)):
                phones.append(span)
            if "call" in what and (span := _cued_phone(text, end)):
                phones.append(span)
            if "name" in what and _whole_name(text, start, end):
                names.append((start, end))
        phones += [m.span() for m in _US_PHONE.finditer(text)]
        taken: list[tuple[int, int, str]] = []
        for kind, spans in (("email", emails), ("street", streets), ("identity", identities), ("phone", phones)):
            # of overlapping values the longer one, then the first
            for s, e in sorted(set(spans), key=lambda x: (x[0] - x[1], x)):
                if all(e <= a or s >= b for a, b, _ in taken):
                    taken.append((s, e, kind))
        taken += [(s, e, "person") for s, e in self._persons(text, low, [n for n in names if all(n[1] <= a or n[0] >= b for a, b, _ in taken)])]
        return sorted(taken)

    def _persons(self, text: str, low: str, names: list[tuple[int, int]]) -> list[tuple[int, int]]:
        # of names at overlapping places only the longest stands
        words: list[tuple[int, int]] = []
        for s, e in sorted(set(names), key=lambda x: (x[0], -x[1])):
            if not words or s >= words[-1][1]:
                words.append((s, e))
        out: list[tuple[int, int]] = []
        i = 0
        while i < len(words):
            s, e = words[i]
            is_given, is_family = low[s:e] in self.given, low[s:e] in self.family
            if i + 1 < len(words):
                s2, e2 = words[i + 1]
                gap = text[e:s2]
                given2, family2 = low[s2:e2] in self.given, low[s2:e2] in self.family
                together = re.fullmatch(r"\s{1,2}", gap) and ((is_given and family2) or (is_family and given2))
                if together or (is_given and family2 and _MIDDLE.fullmatch(gap)) or (is_family and given2 and re.fullmatch(r",\s{1,2}", gap)):
                    if is_family and given2 and gap.startswith(",") and (m := re.match(r" [^\W\d_]\.(?!\w)", text[e2 : e2 + 3])):
                        e2 += m.end()
                    out.append((s, e2))
                    i += 2
                    continue
            if is_family:
                if m := _INITIAL_BEFORE.search(text, max(0, s - 4), s):
                    # a middle initial after another initial
                    first = _INITIAL_BEFORE.search(text, max(0, m.start() - 4), m.start())
                    out.append(((first or m).start(), e))
                elif m := _INITIAL_AFTER.match(text, e):
                    out.append((s, m.end()))
            i += 1
        return out


def _email(text: str, low: str, start: int, end: int, word: str) -> tuple[int, int] | None:
    left, right = start, end
    if word not in ("@", "%40", " at "):
        while left and text[left - 1] == " ":
            left -= 1
        while right < len(text) and text[right] == " ":
            right += 1
    elif word == "@":
        if text[left - 1 : left] == " " and text[right : right + 1] == " ":
            left, right = left - 1, right + 1
    if not (m := _LOCAL.search(text, max(0, left - 64), left)):
        return None
    if not (d := _DOMAIN.match(text, right)):
        return None
    domain = d.group()
    labels = re.split(_DOT, domain, flags=re.IGNORECASE)
    stop = d.end()
    if word == " at " and not re.search(r"\sdot\s|[\[({]dot[\])}]", domain, re.IGNORECASE):
        return None
    if not re.fullmatch(r"[^\W\d_]{2,}", labels[-1]):
        return None
    if text[stop : stop + 1] == ":" and re.match(r":[\w~./-]", text[stop : stop + 2]) and m.group().lower() in ("git", "hg", "svn"):
        return None
    if m.start() and text[m.start() - 1] in "@/" and text[m.start() - 2 : m.start()] != "//":
        return None
    return m.start(), stop


def _identity(text: str, low: str, start: int, end: int, word: str) -> list[tuple[int, int]]:
    """The number after the cue; also the one before it if none follows, or if it is the nearer one of the same sentence."""
    if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
        return []
    kind = IDENTITY_CUES[word]
    if end < len(low) and low[end].isalpha() and word not in ("social security", "taxpayer", "tax no"):
        return []
    after = _NUMBER_FORMS[kind].match(text, end)
    out = [after.span(1)] if after else []
    if before := _NUMBERS_BEFORE[kind].search(text, max(0, start - 40), start):
        gap, other = before["gap"], text[end : after.start(1)] if after else ""
        if not after or ("," not in gap and (len(gap) < len(other) or _PARTED.search(other))):
            out.append(before.span(1))
    return out


def _phone(text: str, start: int) -> tuple[int, int] | None:
    if start and (text[start - 1].isalnum() or text[start - 1] in "_.#/+-" or (text[start - 1] == "(" and text[start] != "+" and text[start] != "0")):
        return None
    for form in _PHONE_FORMS:
        if m := form.match(text, start):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 16 and not re.match(r"[\w]|[:.]\d", text[m.end() : m.end() + 2]):
                return m.span()
    return None


def _cued_phone(text: str, end: int) -> tuple[int, int] | None:
    if not (m := _CUED.match(text, end)):
        return None
    value = m.group(1)
    digits = sum(c.isdigit() for c in value)
    # a cue alone doesn't make a plain run of digits a telephone number
    if 9 <= digits <= 15 and re.search(r"\d[ ()./-]+\d", value) and re.fullmatch(r"[+(]?\d+(?:[ ()./-]{1,2}\d{2,})+", value) and not re.search(r"\d{4}-\d\d-\d\d", value):
        return m.span(1)
    return None


def _street(text: str, start: int, end: int) -> list[tuple[int, int]]:
    low, high = max(0, start - 70), min(len(text), end + 60)
    out = []
    for form in (_ENGLISH, _GERMAN, _FRENCH, _SPANISH):
        # the value has to hold the anchor
        for m in form.finditer(text, low, high):
            if m.start() <= start and m.end() >= min(end, m.end()) and m.end() > start:
                out.append((m.start(), len(m.group().rstrip()) + m.start()))
    return out


def _whole_name(text: str, start: int, end: int) -> bool:
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    if before.isalnum() or before in "_@#/\\-'’" or after.isalnum() or after in "_@/\\":
        return False
    return not (after == "-" and text[end + 1 : end + 2].isalnum()) and not (after in ".'’" and after == "." and text[end + 1 : end + 2].isalnum())


def roster(names: DataFrame) -> list[tuple[str | None, str | None]]:
    rows = names.select("given_name", "family_name").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"a roster may have at most {MAX_NAMES} names")
    return [tuple(r) for r in rows]


@lru_cache(maxsize=4)
def _scanner(names: tuple[tuple[str | None, str | None], ...]) -> Scanner:
    return Scanner(list(names))


def scan(texts: DataFrame, names: list[tuple[str | None, str | None]]) -> DataFrame:
    """(tbl, rec_key, start, end, pii_type, found) for every item in (tbl, rec_key, text).

    Null and empty texts have none. Offsets count characters of the stored text.
    """
    shared = texts.sparkSession.sparkContext.broadcast(tuple(names))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _scanner(shared.value).find
        for b in batches:
            rows = [(t, k, s, e, kind, x[s:e]) for t, k, x in zip(b["tbl"], b["rec_key"], b["text"]) for s, e, kind in find(x)]
            yield pd.DataFrame(rows, columns=["tbl", "rec_key", "start", "end", "pii_type", "found"])

    full = texts.filter(F.length("text") > 0).select("tbl", "rec_key", "text")
    return full.mapInPandas(work, "tbl string, rec_key string, start int, end int, pii_type string, found string")


def redact(texts: DataFrame, names: list[tuple[str | None, str | None]]) -> DataFrame:
    """Adds ``redacted`` to (tbl, rec_key, text): the text with every item replaced by the placeholder of its type.

    Null stays null; what is no item stays as it is.
    """
    shared = texts.sparkSession.sparkContext.broadcast(tuple(names))

    def clean(text: str | None, find) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for s, e, kind in find(text):
            out += [text[at:s], PLACEHOLDERS[kind]]
            at = e
        return "".join([*out, text[at:]]) if out else text

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _scanner(shared.value).find
        for b in batches:
            yield b.assign(redacted=[clean(t, find) for t in b["text"]])

    return texts.select("tbl", "rec_key", "text").mapInPandas(work, "tbl string, rec_key string, text string, redacted string")


def stored_texts(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """(tbl, rec_key, text) of facts.content and of session_lines.message.content."""
    of_facts = facts.select(F.lit("facts").alias("tbl"), F.col("id").alias("rec_key"), F.col("content").alias("text"))
    of_lines = lines.select(F.lit("session_lines").alias("tbl"), F.col("line_id").cast("string").alias("rec_key"), F.col("message.content").alias("text"))
    return of_facts.unionAll(of_lines)


def found_items(facts: DataFrame, lines: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (tbl, rec_key, pii_type, found); rows without key drop."""
    texts = stored_texts(facts, lines).filter(F.col("rec_key").isNotNull())
    return scan(texts, roster(names)).select("tbl", "rec_key", "pii_type", "found").distinct()
