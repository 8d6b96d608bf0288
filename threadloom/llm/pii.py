"""Personal data in free text, found by a skip-chain conditional random field.

Spans that could be personal data at all (a lattice of patterns, far wider than what is
kept) are the only places where a token may carry a label other than O. A linear chain
over the tokens of such spans scores labels from words, shapes, endings, span kinds and
the words around the span. Every other mention of a word of a possible name has nodes
too, also a bare one; skip edges join equal and similar words all over the document, so
that an unclear mention follows a clear one. Loopy message passing alternates exact
passes along the chains with messages over the skip edges until these settle.

The weights are fitted once per driver process to a bounded sample of the rows. Its
labels come from labelling rules (phrases around a span, the forms of numbers); spans on
which the rules are silent stay hidden variables, so the field learns words and endings
from clear cases and applies them to unclear ones. What a skip edge is worth is learned
from documents made of two texts of the sample in which the second mentions the name (or
what only looks like one) of the first, the words and surroundings of one mention hidden.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.spread import spread

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = ("[EMAIL]", "[PHONE]", "[ID_NUMBER]", "[ADDRESS]", "[NAME]")
LABELS = 1 + len(TYPES)
BUCKETS = 1 << 17
#: Texts with a possible span that the field is fitted to at most: those with the least hash.
FIT_TEXTS = 4000
#: Distinct texts among which these are looked for.
FIT_ROWS = 40_000
#: Documents of two texts that the skip edges are fitted to at most, for names and for what isn't one.
FIT_TWINS = 300
#: Rounds of messages over skip edges at most; they end when no message moves by more than ``SETTLED``.
ROUNDS, SETTLED = 30, 1e-3
#: Given names kept from the clear names of all texts at most; a name rarer than one in as many is left out.
GIVEN_NAMES = 200_000

#: Street words; those that are also everyday words only with a capital.
_STREET = r"(?:(?i:street|road|rd|avenue|ave|lane|ln|boulevard|blvd|terrace|crescent|drive|mews)|(?:St|Dr|Close|Court|Ct|Place|Pl|Square|Sq|Way|Row|Hill|Gardens|Grove|CLOSE|COURT|PLACE|SQUARE|WAY|ROW|HILL|GARDENS|GROVE))"
_THING = r"(?:playlist|mixtape|album|song|podcast|band|shop|store|station|mix|compilation|record|single|remix|soundtrack)"
_TOWN = r"(?:\s*[,\n]\s*(?:\d{4,6}\s+)?[^\W\d_][\w'’-]*(?:[ ][A-ZÀ-Þ][\w'’-]*)?)?(?:[ ]\d{4,6}\b)?"
#: A town after an address in one case, without a comma.
_BARE_TOWN = r"(?:[ ](?!" + _THING + r"\b)[^\W\d_]{3,}(?:[ ][^\W\d_]{3,})?(?=\s*(?:[.!?,\n]|$)))?"
_NAME = r"[^\W\d_][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_CAP = r"[A-ZÀ-Þ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_VAN = r"(?:(?:van|von|de|der|den|di|da|la|le|bin|al|VAN|VON|DE)[ ])*"
_TITLE = r"(?:mr|mrs|ms|miss|mx|dr|prof|sir|herr|frau)\b\.?"
_CUE = r"(?:name is|name of|name:|ask for|asked for|booking under|account holder:?|card says|signed for by(?: some)?|spoke to|spoke with|regards,?|cheers,|sincerely,?|cc|attn:?)"
#: Words that say less: what follows the two words must confirm them, or they have capitals and are another form.
_WEAK = r"(?:this is|it was|i am|i'm|hi|hello|dear|thank you|thanks,?|contact:?)"
_CONFIRM = r"(?:,? thanks|,? we\b|,? by the way|,? who )"
_OPEN = r"(?:^|[.!?\n…-]\s+|@\w+\s+)"

#: (type, kind, pattern). The kinds only name the form; whether a span is kept is the field's choice.
_FORMS: list[tuple[int, str, str]] = [
    (1, "mail", r"[\w.+%-]*\w\s?(?:@|＠|\(@\)|\[@\]|&#64;|\(at\)|\[at\]|\{at\})\s?\w[\w-]*(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)\w[\w-]*)+"),
    (1, "mail_words", r"(?i:[\w.+%-]*\w\sat\s\w[\w-]*(?:\sdot\s\w[\w-]*)+)"),
    (2, "plus", r"(?<![\w])\+\d{1,3}[\s./-]?(?:\(\d\))?(?:[\s./–-]?\(?\d{2,6}\)?){2,5}(?!\w)"),
    (2, "brackets", r"(?<!\w)(?:\+?1[\s-]?)?\(\d{2,5}\)\s?\d{3,4}[\s.–-]?\d{3,4}(?!\w)"),
    (2, "groups", r"(?<![\w.–-])(?:1[\s.–-])?\d{3}[\s.–-]\d{3}[\s.–-]?\d{4}(?![\w–-]|\.\d)"),
    (2, "zero", r"(?<![\w.–-])0\d{2,5}[\s./–-]?\d{3,4}[\s./–-]?\d{3,4}(?![\w–-]|\.\d)"),
    (2, "double_zero", r"(?<!\w)00\d{2}[\s./-]?(?:\d{2,5}[\s./-]?){2,4}\d(?!\w)"),
    (2, "spaced", r"(?<!\w)\d(?:[ ]\d){7,14}(?!\w)"),
    (2, "plain", r"(?<![\w.,#-])\d{10,11}(?![\w-])"),
    (3, "three_two_four", r"(?<![\w-])\d{3}([ -])\d{2}\1\d{4}(?![\w-])"),
    (3, "nine", r"(?<![\w#.-])\d{9}(?![\w-])"),
    (3, "letters_pairs", r"(?<!\w)[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-Z](?!\w)"),
    (3, "letter_eight", r"(?<!\w)[A-Z]\d{8}(?!\w)"),
    (3, "letters_seven", r"(?<!\w)[A-Z]{2}\d{7}(?!\w)"),
    (3, "prefixed", r"(?<!\w)[A-Z]{2}-\d{4}-\d{4}-[A-Z0-9](?!\w)"),
    (3, "licence", r"(?<!\w)[A-Z9]{5}\d{6}[A-Z0-9]{5}(?!\w)"),
    (3, "dotted", r"(?<![\w.])\d{2}\.\d{2}\.\d{2}-\d{3}\.\d{2}(?![\w.])"),
    (3, "mixed", r"(?<![\w#@/-])(?=[A-Z0-9-]*[A-Z])(?=(?:[A-Z-]*\d){5})[A-Z0-9][A-Z0-9-]{6,19}(?![\w-])"),
    (4, "number_street", rf"(?<![\w.])\d{{1,5}}[A-Za-z]?\s+(?:[NSEWnsew]\.?\s+)?(?:{_NAME}\s+){{1,2}}?{_STREET}\b\.?(?i:,?\s*(?:apt|flat|unit|suite|ste)\.?\s*\w+)?{_TOWN}"),
    (4, "one_case", rf"(?<![\w.])\d{{1,5}}[a-z]?\s+(?:[a-zß-ÿ-]+\s+){{1,2}}?(?:street|road|rd|avenue|ave|lane|ln|boulevard|blvd|terrace|crescent|drive|mews|close|court|place|way){_BARE_TOWN}(?!\w)"),
    (4, "one_case", rf"(?<![\w.])\d{{1,5}}[A-Z]?\s+(?:[A-ZÀ-Þ-]+\s+){{1,2}}?(?:STREET|ROAD|RD|AVENUE|AVE|LANE|LN|BOULEVARD|BLVD|TERRACE|CRESCENT|DRIVE|MEWS|CLOSE|COURT|PLACE|WAY){_BARE_TOWN}(?!\w)"),
    (4, "flat_street", rf"(?<!\w)(?i:flat|unit|apt|apartment|suite|studio)\.?\s*\d+\w?,?\s*\d{{1,5}}\w?\s+(?:{_NAME}\s+){{1,2}}?{_STREET}\b\.?{_TOWN}"),
    (4, "street_end", rf"(?<!\w)(?i:{_NAME}(?:weg|straße|strasse|gasse|allee|platz|str\.))\s\d{{1,4}}\w?\b{_TOWN}"),
    (4, "street_first", rf"(?<!\w)(?i:calle|rue|via|rua|avenida|plaza|paseo|viale|corso)\s{_NAME}(?:\s{_NAME})?,?\s\d{{1,4}}\w?\b{_TOWN}"),
    (4, "house_street", rf"(?<!\w)(?i:the)\s{_NAME}\s{_NAME},\s{_NAME}\s{_STREET}\b{_TOWN}"),
    (4, "street", rf"(?<!\w){_CAP}\s(?:Street|Road|Avenue|Lane|Drive|Close|Boulevard|Court|Square|Terrace|Crescent)\b{_TOWN}"),
    (5, "title", rf"(?<![\w@]){'(?i:' + _TITLE + ')'}\s?(?:[A-Z]\.?\s)?{_VAN}{_NAME}(?:\s{_CAP})?"),
    (5, "initial", rf"(?<![\w@.])(?:[A-Z]\.\s?){{1,3}}{_VAN}{_CAP}"),
    (5, "pair", rf"(?<![\w@#/.-]){_CAP}\s(?:[A-Z]\.?\s)?{_VAN}{_CAP}"),
    (5, "reversed", rf"(?<![\w@#/.-])(?<!, )(?<!and ){_CAP},[ ]{_CAP}(?:\s[A-Z]\.)?(?!\w|,|\s(?:and|or|plus|but|in\s[A-Z]|stay|remain|run|\d))"),
    (5, "told", rf"(?i)(?<!\w){_CUE}\s+(?P<span>{_NAME},?\s(?:[a-z]\.?\s)?{_VAN}{_NAME})"),
    (5, "told", rf"(?i)(?<!\w){_WEAK}\s+(?P<span>{_NAME},?\s(?:[a-z]\.?\s)?{_VAN}{_NAME})(?={_CONFIRM})"),
    (5, "here", rf"{_OPEN}(?P<span>{_NAME},?\s(?:\w\.?\s)?{_VAN}{_NAME})(?=\shere\b)"),
]
#: With the gate of each form: its kind, but that names after weak phrases have their own.
_COMPILED = [(t, k, "told_weakly" if _WEAK in p else k, re.compile(p)) for t, k, p in _FORMS]
#: What a text must hold at least for the forms of a type (or one form) to be tried.
_GATES = {
    "mail": re.compile(r"[@＠]\)?\]?\s?\w[\w-]*(?:\.\w|\s?[(\[{]dot)|[(\[{]at[)\]}]|&#64;"),
    "mail_words": re.compile(r"(?i)\sat\s\w[\w-]*\sdot\s"),
    "street_end": re.compile(r"(?i)(?:weg|stra(?:ß|ss)e|gasse|allee|platz|str\.)\s\d"),
    "street_first": re.compile(r"(?i)\b(?:calle|rue|via|rua|avenida|plaza|paseo|viale|corso)\b"),
    "here": re.compile(r"\shere\b"),
    2: re.compile(r"\d(?:[\s./()–-]{0,2}\d){6}"),
    3: re.compile(r"\d(?:[\s.-]?\d){4}"),
    "mixed": re.compile(r"\d(?:[A-Z-]*\d){4}"),
    4: re.compile(rf"\b{_STREET}\b|\b(?:close|court|place|way)\b"),
    "one_case": re.compile(rf"\d[A-Za-z]?\s+[^\W\d_]+(?:\s[^\W\d_]+)?\s(?i:{_STREET})"),
}
#: Common words that begin sentences, never a name by themselves.
_PLAIN = frozenset(
    """a about after again all already also an and any anyone are as ask at be because been before between but by call can cancel check could did do does don't each even every for from
    get give go good great had half happy has have hello her here hey hi his how i if in is it its just keep last let like look lol love me meanwhile more most my need no not now of off oh ok on
    once one only or our out over pick please put reset same say see seriously set she should since so some someone somewhere steps still stop such take tell thank thanks that the their them then
    there these they this three to tried try two type under until up us use very was we well went were what when where which while who why will with would yes you your
    regards cheers sincerely dear attn much many lot bit way other another new old second third time times something nothing anything store chat team page plan mode note number account""".split()
)

#: White space of Java that Python's \s has too.
_WS = r"[\s  -   　]"
_UP, _LET = r"[A-ZÀ-Þ]", r"[A-Za-zÀ-ɏ\p{L}\p{Nl}\p{No}]"
#: That the letter before begins a word; tested after the letter, which few positions have. Versions of Java differ on what \b is beside other letters than a to z.
_FIRST = r"(?<![\p{L}\p{N}_].)"
_PLAIN_ENDS = {c: sorted(w[1:] for w in _PLAIN if w[0] == c and len(w) > 1) for c in sorted({w[0] for w in _PLAIN if len(w) > 1})}
#: A capital that begins no common word; a pair of words with one is never a name. By its first letter, so that few words are tried.
_UP_NAME = rf"(?=[A-ZÀ-Þ])(?:{'|'.join(f"{c.upper()}(?!(?:{'|'.join(x)})(?!{_LET}|['’]{_LET}))" for c, x in _PLAIN_ENDS.items())}|[{''.join(c for c in 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' if c.lower() not in _PLAIN_ENDS)}À-Þ])"
#: Cheap tests in Java's syntax; a text with a possible span passes one of them.
_SIGNS = (
    rf"{_UP_NAME}{_FIRST}{_LET}+(?:[-'’]{_LET}+)*{_WS}(?:{_UP}\.?{_WS})?(?:(?:van|von|de|der|den|di|da|la|le|bin|al|VAN|VON|DE){_WS})*{_UP_NAME}{_LET}",
    rf"\b{_UP}\.{_WS}?(?:(?:van|von|de|der|den|di|da|la|le|bin|al|VAN|VON|DE){_WS})*{_UP}",
    rf"{_UP}{_FIRST}(?<!, .)(?<!and .){_LET}+(?:[-'’]{_LET}+)*,[ ]{_UP}{_LET}+(?:[-'’]{_LET}+)*(?:{_WS}{_UP}\.)?(?![\w\p{{L}}\p{{N}}]|,|{_WS}(?:and|or|plus|but|in{_WS}{_UP}|stay|remain|run|\d))",
)
#: The same for texts that hold a digit.
_DIGIT_SIGNS = (
    rf"\d(?:(?:{_WS}|[./()–-]){{0,2}}\d){{6}}|[A-Z]{{2}}[ -]?\d\d|[A-Z]\d{{5}}|[A-Z9]{{5}}\d{{6}}",
    r"(?=[A-Z0-9-])(?<![\w#@/-])(?=[A-Z0-9-]{7})(?=[0-9-]*[A-Z])(?:[A-Z-]*\d){5}",
)
_NUMBERED = r"(?:street|road|rd|avenue|ave|lane|ln|boulevard|blvd|terrace|crescent|drive|mews|close|court|place|way|st|dr|ct|pl|square|sq|row|hill|gardens|grove)"
_DIGIT_SIGNS += tuple(
    x.replace(r"\s", _WS)
    for x in (
        rf"\d\w?\s+(?:\S+\s+){{1,3}}(?i:{_NUMBERED})\b",
        r"(?=[wsgapWSGAP])(?i:weg|stra(?:ß|ss)e|gasse|allee|platz|str\.)\s\d",
        r"(?=[crvapCRVAP])\b(?i:calle|rue|via|rua|avenida|plaza|paseo|viale|corso)\s\S+(?:\s\S+)?\s\d",
    )
)
# first the letters that a phrase may begin with, then whether a word begins there
_SIGNS += tuple(
    x.replace(r"\s", _WS)
    for x in (
        r"(?i:\sat\s\S+\sdot\s)",
        rf",\s\S+\s(?i:{_NUMBERED})\b",
        rf"(?=[mdpshfMDPSHF])(?i:\b{_TITLE}\s?{_LET})",
        rf"(?=[nabcsrNABCSR])(?i:\b{_CUE}\s)",
        rf"(?=[tihdcTIHDC])(?i:\b{_WEAK}\s\S+\s\S+(?:\s\S+){{0,3}}{_CONFIRM})",
    )
)
_HERE = rf"(?m){_OPEN}\S+\s\S+(?:\s\S+){{0,2}}\shere\b".replace(r"\s", _WS)
_MAIL = r"[@＠]\)?\]?\s?\w[\w-]*(?:\.\w|\s?[\(\[{]dot)|[\(\[{]at[\)\]}]|&#64;".replace(r"\s", _WS)
_MAIL_PARTS = ("@", "＠", "at)", "at]", "at}", "&#64;")
_STREETS = ("Street", "Road", "Avenue", "Lane", "Drive", "Close", "Boulevard", "Court", "Square", "Terrace", "Crescent")


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def possible(text: Column, given: frozenset[str] = frozenset()) -> Column:
    """Whether a text may hold a span: searches in the JVM, so that most texts never reach Python.

    A text may also hold one of the ``given`` names without a phrase or capitals; its words are looked up in a set.
    """
    # cheap searches for a fixed part go before the patterns that need it
    test = _any(text.rlike(x) for x in _SIGNS)
    test = test | (_any(text.contains(x) for x in _MAIL_PARTS) & text.rlike(_MAIL)) | _any(text.contains(x) for x in _STREETS)
    test = test | (text.rlike(rf"{_WS}here\b") & text.rlike(_HERE)) | (text.rlike("[0-9]") & _any(text.rlike(x) for x in _DIGIT_SIGNS))
    firsts = sorted(_firsts(given))
    if firsts:
        words = F.split(F.lower(text), r"[^\p{L}\p{Nl}\p{No}]+")
        test = test | F.exists(words, lambda w: w.isin(firsts))
    return F.coalesce(test, F.lit(False))


_DIGIT = re.compile(r"\d")
#: Gates that only a text with a digit can pass.
_DIGIT_GATES = ("street_end", "street_first", 2, 3, "mixed", "one_case")
#: Lower-case parts of the phrases before a name, one of which a text with such a phrase holds.
_CUE_SIGNS = ("name is", "name of", "name:", "ask for", "asked for", "booking under", "account holder", "card says", "signed for by", "spoke to", "spoke with", "regards", "cheers", "sincerely", "cc", "attn")
_CONFIRM_SIGNS = (" thanks", " we", " by the way", " who ", ", ")
_TITLE_SIGNS = ("mr", "ms", "mx", "miss", "dr", "prof", "sir", "herr", "frau")

_TOKEN = re.compile(r"\w+|[^\w\s]")
_AROUND = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|\d+|[#:@/.,!?()\[\]\n-]")
@dataclass
class Lattice:
    """Possible spans of one text: tokens, allowed labels, feature buckets, chains."""

    at: list[tuple[int, int]] = field(default_factory=list)  # token positions
    word: list[str] = field(default_factory=list)
    allowed: list[int] = field(default_factory=list)  # bit set of labels
    feats: list[list[int]] = field(default_factory=list)
    breaks: list[int] = field(default_factory=list)  # first token of each chain
    spans: list[tuple[int, int, int, str, int, int]] = field(default_factory=list)  # type, kind, first and last token


def _shape(w: str) -> str:
    s = "".join("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in w[:12])
    return re.sub(r"(.)\1+", r"\1+", s)


@lru_cache(maxsize=1 << 17)
def _h(x: str) -> int:
    return crc32(x.encode()) % BUCKETS


@lru_cache(maxsize=1 << 16)
def _word_features(w: str, known: bool) -> list[int]:
    """Features of a word by itself. The list is shared: copy it to change it."""
    low, digits = w.lower(), w.isdigit()
    base = ["w=" + (f"#{len(w)}" if digits else low), "s=" + _shape(w)]
    if not digits and len(w) > 2:
        base += ["x3=" + low[-3:], "x4=" + low[-4:], "x5=" + low[-5:], "p3=" + low[:3], "g=1" if known else "g=0"]
    return [_h(x) for x in base]


_LETTERS = re.compile(r"[^\W\d_]+")


def _firsts(given: frozenset[str]) -> set[str]:
    """The first parts of names like jean-luc."""
    return {_LETTERS.search(w).group() for w in given}


class _Given:
    """Given names before or after another word, in any case; a text takes the same time however many names there are."""

    _PAIR = re.compile(rf"(?i)(?<![\w@#/.+-])(?:(?P<first>{_NAME})\s(?:[a-z]\.?\s)?{_VAN}{_NAME}|{_NAME},\s(?P<last>{_NAME})\b)")

    def __init__(self, given: frozenset[str]):
        self.given, self.firsts = given, _firsts(given)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if self.firsts.isdisjoint(_LETTERS.findall(text.lower())):
            return
        at = 0
        while m := self._PAIR.search(text, at):
            end = m.end() if m["first"] and m["first"].lower() in self.given else self._last(m) if m["last"] else None
            if end is None:
                at = m.start() + 1
            else:
                yield m.start(), end
                at = end

    def _last(self, m: re.Match) -> int | None:
        """End of the given name after the comma: the word, or its first parts."""
        for part in _LETTERS.finditer(m["last"]):
            if m["last"][: part.end()].lower() in self.given:
                return m.start("last") + part.end()
        return None


def _given_form(given: frozenset[str]) -> _Given | None:
    return _Given(given) if given else None


def spans_of(text: str, given_form: _Given | None = None) -> list[tuple[int, int, int, str]]:
    """``(start, end, type, kind)`` of everything that could be personal data."""
    out, mails = [], []
    digit, low = _DIGIT.search(text) is not None, text.lower().replace("ſ", "s")
    open_ = {k: (digit or k not in _DIGIT_GATES) and rx.search(text) is not None for k, rx in _GATES.items()}
    open_["title"] = any(x in low for x in _TITLE_SIGNS)
    open_["told"] = any(x in low for x in _CUE_SIGNS)
    open_["told_weakly"] = any(x in low for x in _CONFIRM_SIGNS)
    for t, kind, gate, rx in _COMPILED:
        if not open_.get(gate, open_.get(t, True)):
            continue
        for m in rx.finditer(text):
            s, e = m.span("span") if kind in ("told", "here") else m.span()
            if t == 1:
                mails.append((s, e))
            elif any(s < y and x < e for x, y in mails):
                continue
            if t == 5 and _never_name(text[s:e], kind):
                continue
            if t == 4:
                e = s + len(text[s:e].rstrip(" ,.\n"))
            last = re.search(r"[ ]([^\W\d_]+)$", text[s:e])
            if last and last[1].lower() in _PLAIN:
                e = s + last.start()
            out.append((s, e, t, kind))
    if given_form is not None:
        for s, e in given_form.spans(text):
            if not any(s < y and x < e for x, y in mails) and not _never_name(text[s:e], "given"):
                out.append((s, e, 5, "given"))
    return out


def _never_name(span: str, kind: str) -> bool:
    words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", span.lower())
    if kind == "title":
        return len(words) > 1 and words[1] in _PLAIN
    return any(w in _PLAIN for w in words)


def _stem(word: str) -> str:
    """Words with the same stem are equal or similar."""
    return word[:5]


def _telling(word: str) -> bool:
    return len(word) > 3 and not word.isdigit() and word not in _PLAIN


def mentions(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Where words of possible names stand outside of these: two in a row (``again``), or one (``bare``)."""
    names = sorted((s, e) for s, e, t, _ in spans if t == 5)
    if not names:
        return []
    stems: Counter = Counter()
    end = 0
    for s, e in names:  # overlapping names count once
        stems.update(_stem(w) for m in _LETTERS.finditer(text, max(s, end), e) if _telling(w := m.group().lower()))
        end = max(end, e)
    low = text.lower()
    if all(low.count(x) <= n for x, n in stems.items()):
        return []
    taken = sorted((s, e) for s, e, t, _ in spans if t in (1, 5))
    out: list[tuple[int, int, int, str]] = []
    k = 0
    for m in _LETTERS.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if any(x < e and s < y for x, y in taken[k : k + 2]) or not _telling(w := m.group().lower()) or _stem(w) not in stems:
            continue
        if out and out[-1][3] == "bare" and text[out[-1][1] : s] in (" ", ", "):
            out[-1] = (out[-1][0], e, 5, "again")
        else:
            out.append((s, e, 5, "bare"))
    return out


def lattice(text: str, given: frozenset[str] = frozenset(), given_form: _Given | None = None) -> Lattice | None:
    spans = spans_of(text, given_form)
    if not spans:
        return None
    spans += mentions(text, spans)
    spans.sort()
    out = Lattice()
    # spans that overlap or touch are one chain
    groups: list[list[tuple[int, int, int, str]]] = []
    end = -1
    for x in spans:
        if groups and x[0] < end:
            groups[-1].append(x)
        else:
            groups.append([x])
        end = max(end, x[1])
    for group in groups:
        first, lo, hi = len(out.at), min(x[0] for x in group), max(x[1] for x in group)
        out.breaks.append(first)
        for m in _TOKEN.finditer(text, lo, hi):
            w = m.group()
            low = w.lower()
            out.at.append(m.span())
            out.word.append(low)
            out.allowed.append(1)
            out.feats.append(_word_features(w, low in given))
        for s, e, t, kind in group:
            own = [i for i in range(first, len(out.at)) if s <= out.at[i][0] < e]
            if not own:
                continue
            left = [x.lower() for x in _AROUND.findall(text[max(0, s - 40) : s])][-4:]
            right = [x.lower() for x in _AROUND.findall(text[e : e + 30])][:3]
            left = ["<s>"] * (4 - len(left)) + left
            right = right + ["</s>"] * (3 - len(right))
            near = [f"k={kind}", f"k={kind}|l={left[3]}", f"k={kind}|l2={left[2]}_{left[3]}", f"k={kind}|l3={left[1]}_{left[2]}", f"k={kind}|r={right[0]}", f"k={kind}|r2={right[0]}_{right[1]}", f"t={t}|l={left[3]}", f"t={t}|l2={left[2]}_{left[3]}", f"t={t}|r={right[0]}"]
            near += [f"t={t}|c={x}" for x in left if len(x) > 2]
            if t == 5:
                case = "low" if text[s:e].islower() else "up" if text[s:e].isupper() else "mixed"
                near += [f"k={kind}|case={case}", f"n|known={any(out.word[i] in given for i in own)}|{kind}"]
            hashed = [_h(x) for x in near]
            for i in own:
                out.allowed[i] |= 1 << t
                out.feats[i] = out.feats[i] + hashed
            out.spans.append((s, e, t, kind, own[0], own[-1]))
    return out


# -- labelling rules ---------------------------------------------------------------------------------------------

_NAMED = re.compile(r"(?i)(?:my name is|name of|name:|ask for|booking under|account holder:?|card says|signed for by(?: some)?|spoke to|spoke with|regards,?|sincerely,?|\bcc)\s*$")
_GREETED = re.compile(r"(?i)(?:^|[^\w])(?:hi|hello|dear|thank you|this is|it was)\s*$")
_GREETED_AFTER = re.compile(r"(?i)^(?:,? thanks|, we|,? by the way|,? who )")
_PRODUCT = re.compile(r"(?i)^['’s]*\s(?:playlist|mixtape|album|song|podcast|band|shop|store|station|plan|package|page|service|team|weekend|migration|update|mode|app|counter|crew|guide|credit|trial|balance|cable|switch|banner|desk|\d)")
_IDENTITY = re.compile(r"(?i)\b(?:social(?: is| security)?|tax id|passport|licen[cs]e|insurance|identity|id|document|verification|post|ssn|nino|national)\b[^.!?\n\d]{0,22}$")
_OTHER_NUMBER = re.compile(r"(?i)\b(?:order|ticket|serial|tracking|ref|reference|flight|build|version|code|invoice|says|lat|lon|case|number|codes|parcel|booking|item|sku|model|form|queue|batch|score|paid)\b[\s:#no.]*$|[#$£€]\s*$")
_CALLED = re.compile(r"(?i)\b(?:call|ring|text|mobile|tel|phone|reach\w*|sms|number's|back on|number is|whatsapp|fax)\b[^.!?\n]{0,12}$")


def rule(text: str, s: int, e: int, t: int, kind: str, given: frozenset[str]) -> int | None:
    """1 personal, 0 not, None: the rules are silent."""
    if kind in ("again", "bare"):
        return None
    left, right = text[max(0, s - 40) : s], text[e : e + 30]
    if t == 1:
        return 1
    if t == 2:
        if _OTHER_NUMBER.search(left) or (kind not in ("plus", "brackets") and _IDENTITY.search(left) and not _CALLED.search(left)):
            return 0
        if kind in ("plus", "brackets", "double_zero", "spaced"):
            return 1
        return 1 if kind != "plain" or _CALLED.search(left) else 0
    if t == 3:
        if _OTHER_NUMBER.search(left) and not _IDENTITY.search(left):
            return 0
        if _IDENTITY.search(left) and not _CALLED.search(left):
            return 1
        return 0 if kind == "mixed" else None
    if t == 4:
        if _PRODUCT.search(right):
            return 0
        return None if kind == "street" else 1
    if _PRODUCT.search(right):
        return 0
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text[s:e])]
    known = any(w in given for w in words)
    if kind == "title" or re.match(rf"(?i){_TITLE}\s", text[s:e]):
        return 1
    if _NAMED.search(left) and (known or not text[s:e].islower()):
        return 1
    if _GREETED.search(left) and (known or _GREETED_AFTER.search(right)):
        return 1
    if re.match(r"\shere\b", right) and known:
        return 1
    if kind == "initial" or known:
        return None
    return 0


#: A text with neither one of these nor a word that begins with cc has no clear name.
_NAMED_SIGNS = ("my name is", "name of", "name:", "ask for", "booking under", "account holder", "card says", "signed for by", "spoke to", "spoke with", "regards", "sincerely")


def clear_given(text: str) -> set[str]:
    """Words that stand first in the clear names of mixed case."""
    out = set()
    for s, e, t, kind in spans_of(text):
        if t == 5 and kind in ("pair", "told", "reversed", "here") and _NAMED.search(text[max(0, s - 40) : s]) and not _PRODUCT.search(text[e : e + 30]):
            words = re.findall(rf"{_CAP}", text[s:e])
            if len(words) >= 2 and not text[s:e].isupper():
                out.add((words[-1] if "," in text[s:e] else words[0]).lower())
    return {w for w in out if w not in _PLAIN and not re.fullmatch(r"(?:mr|mrs|ms|miss|dr|prof|sir|herr|frau)", w)}


def _common(counts: list[tuple[str, int]]) -> frozenset[str]:
    least = max(2, sum(n for _, n in counts) / GIVEN_NAMES)
    return frozenset(w for w, n in counts if n >= least)


def given_names(texts: list[str]) -> frozenset[str]:
    """The given names of clear names of at least two distinct texts."""
    return _common(Counter(w for text in dict.fromkeys(texts) for w in clear_given(text)).most_common(GIVEN_NAMES))


def all_given_names(texts: DataFrame) -> frozenset[str]:
    """``given_names`` of every distinct text of ``texts(text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, h) for h, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in clear_given(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64()), strict=True)], ["name", "h"])

    def cue(low: Column) -> Column:
        test = low.contains("cc") & low.rlike(r"(?<![a-z0-9_])cc")
        for sign in _NAMED_SIGNS:
            test = test | low.contains(sign)
        return test

    cued = texts.where(F.exists(F.array(F.lower("text")), cue))  # a filter would lower the text for each sign
    cued = cued.select(F.xxhash64("text").alias("h"), "text")
    counts = cued.mapInArrow(run, "name string, h bigint").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return _common([tuple(r) for r in counts.where("n > 1").orderBy(F.desc("n"), "name").limit(GIVEN_NAMES).collect()])


# -- the field ---------------------------------------------------------------------------------------------------


@dataclass
class Field:
    weights: np.ndarray  # buckets x labels
    step: np.ndarray  # label to label along a chain
    skip: np.ndarray  # agreement over a skip edge, by kind (equal or similar words) and label
    given: frozenset[str]


class Batch:
    """Chains of many texts as padded arrays, and the skip edges between their tokens."""

    def __init__(self, items: list[Lattice], rules: list[list[int]] | None = None):
        rows: list[tuple[int, int, int]] = []  # text, first, after last
        for x, lat in enumerate(items):
            ends = lat.breaks[1:] + [len(lat.at)]
            rows += [(x, a, b) for a, b in zip(lat.breaks, ends, strict=True) if b > a]
        self.rows, self.n, self.len = rows, len(rows), max((b - a for _, a, b in rows), default=0)
        wide = max((len(f) for lat in items for f in lat.feats), default=1)
        self.mask = np.zeros((self.n, self.len), bool)
        self.feats = np.full((self.n, self.len, wide), BUCKETS, np.int32)
        self.allowed = np.zeros((self.n, self.len, LABELS), bool)
        self.clamped = None if rules is None else np.zeros((self.n, self.len, LABELS), bool)
        bits = np.arange(LABELS)
        edges: list[tuple[int, int, int, int, int]] = []
        where: dict[tuple[int, str], list[tuple[int, int, str]]] = defaultdict(list)
        for r, (x, a, b) in enumerate(rows):
            lat = items[x]
            self.mask[r, : b - a] = True
            for i in range(a, b):
                f = lat.feats[i]
                self.feats[r, i - a, : len(f)] = f
            self.allowed[r, : b - a] = (np.array(lat.allowed[a:b])[:, None] >> bits & 1).astype(bool)
            if rules is not None:
                self.clamped[r, : b - a] = (np.array(rules[x][a:b])[:, None] >> bits & 1).astype(bool)
            for i in range(a, b):
                w = lat.word[i]
                if _telling(w):
                    where[x, _stem(w)].append((r, i - a, w))
        for same in where.values():
            edges += [(*p[:2], *q[:2], int(p[2] != q[2])) for p, q in zip(same, same[1:], strict=False) if p[0] != q[0]]  # neighbours only: a chain of mentions
        self.edges = np.array(edges, np.int64).reshape(-1, 5)
        last = np.maximum(self.mask.sum(1) - 1, 0)
        self.last = last


def _norm(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return x - top - np.log(np.exp(x - top).sum(-1, keepdims=True))


def _chains(u: np.ndarray, step: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of nodes, and of neighbouring pairs, by a forward and a backward pass."""
    n, length, k = u.shape
    fwd, bwd = np.zeros_like(u), np.zeros_like(u)
    if not length:
        return u, np.zeros((n, 0, k, k))
    fwd[:, 0] = u[:, 0]
    es = np.exp(step)
    for i in range(1, length):
        m = fwd[:, i - 1].max(1, keepdims=True)
        fwd[:, i] = np.where(mask[:, i, None], u[:, i] + m + np.log(np.exp(fwd[:, i - 1] - m) @ es + 1e-300), fwd[:, i - 1])
    for i in range(length - 2, -1, -1):
        y = u[:, i + 1] + bwd[:, i + 1]
        m = y.max(1, keepdims=True)
        bwd[:, i] = np.where(mask[:, i + 1, None], m + np.log(np.exp(y - m) @ es.T + 1e-300), 0)
    node = _norm(fwd + bwd)
    pair = fwd[:, :-1, :, None] + step + (u[:, 1:] + bwd[:, 1:])[:, :, None, :]
    pair = _norm(pair.reshape(n, length - 1, k * k)).reshape(n, length - 1, k, k)
    return node, pair


def beliefs(f: Field, b: Batch, allowed: np.ndarray, rounds: int = ROUNDS, local: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, pair and skip-edge marginals by loopy message passing; messages are damped once they are slow to settle."""
    u = np.where(allowed, f.weights[b.feats].sum(2) if local is None else local, -1e4)
    e = b.edges
    there, back = np.zeros((len(e), LABELS)), np.zeros((len(e), LABELS))
    agree = np.zeros((len(f.skip), LABELS, LABELS))
    agree[:, range(LABELS), range(LABELS)] = f.skip
    agree = agree[e[:, 4]]
    node, pair = _chains(u, f.step, b.mask)
    both = np.zeros((len(e), LABELS, LABELS))
    if len(e):
        touched = np.unique(np.concatenate([e[:, 0], e[:, 2]]))
        slot = np.full(b.n, -1)
        slot[touched] = np.arange(len(touched))
        for k in range(rounds):
            p = node[e[:, 0], e[:, 1]] - back
            q = node[e[:, 2], e[:, 3]] - there
            keep = 0.0 if k < 5 else 0.5
            new = [(1 - keep) * _norm(np.logaddexp.reduce(m[:, :, None] + agree, axis=1)) + keep * old for m, old in ((p, there), (q, back))]
            moved = max(np.abs(new[0] - there).max(), np.abs(new[1] - back).max())
            there, back = new
            extra = np.zeros((len(touched), *u.shape[1:]))
            np.add.at(extra, (slot[e[:, 2]], e[:, 3]), there)
            np.add.at(extra, (slot[e[:, 0]], e[:, 1]), back)
            node[touched], pair[touched] = _chains(u[touched] + extra, f.step, b.mask[touched])
            if moved < SETTLED:
                break
        p, q = node[e[:, 0], e[:, 1]] - back, node[e[:, 2], e[:, 3]] - there
        both = _norm((p[:, :, None] + q[:, None, :] + agree).reshape(len(e), -1)).reshape(len(e), LABELS, LABELS)
    return node, pair, both


def _marked(text: str, lat: Lattice, given: frozenset[str]) -> list[int]:
    """Bit set of the labels that the rules leave to each token."""
    yes, no, any_ = [0] * len(lat.at), [0] * len(lat.at), [0] * len(lat.at)
    for s, e, t, kind, a, z in lat.spans:
        said = rule(text, s, e, t, kind, given)
        for i in range(a, z + 1):
            (any_ if said is None else yes if said else no)[i] |= 1 << t
    # a clear type wins; unclear types stay open beside O; what the rules deny is O
    return [y if y else (1 | o) for y, o in zip(yes, any_, strict=True)]


def twins(texts: list[str], given: frozenset[str], form: _Given | None = None, most: int = FIT_TWINS) -> list[tuple[Lattice, list[int]]]:
    """Documents of two texts, the second with the name (or denied pair of words) of the first in the place of its own.

    Of one mention, in turn the first and the second, only the kind of span is left as evidence.
    """
    clear: dict[int, list[tuple[str, int, int]]] = {0: [], 1: []}
    for text in texts:
        for s, e, t, kind in spans_of(text, form):
            if t == 5 and kind in ("pair", "told", "here", "given") and len(text) < 600 and (said := rule(text, s, e, t, kind, given)) is not None and len(clear[said]) <= most:
                clear[said].append((text, s, e))
                break
    out = []
    for said, cases in clear.items():
        for k, ((a, s, e), (b, x, y)) in enumerate(zip(cases, cases[1:], strict=False)):
            name = a[s:e]
            text = f"{a}\n{b[:x]}{name}{b[y:]}"
            lat = lattice(text, given, form)
            marks = _marked(text, lat, given)
            own = [[i for i, (p, _) in enumerate(lat.at) if at <= p < at + len(name)] for at in (s, len(a) + 1 + x)]
            wanted = 1 << 5 if said else 1
            if not all(o and all(marks[i] == wanted for i in o) for o in own):
                continue
            for i in own[k % 2]:
                lat.feats[i] = [_h("hidden")]
            out.append((lat, marks))
    return out


def fit(texts: list[str], epochs: int = 8, rate: float = 0.15, ridge: float = 1e-4, chunk: int = 400, given: frozenset[str] | None = None) -> Field:
    """Weights that make the labels of the rules likely; silent spans are summed out. Adagrad on the texts in their order.

    ``given`` are the given names of the corpus; without them, those of ``texts``.
    """
    given = given_names(texts) if given is None else given
    form = _given_form(given)
    pairs = [(lat, _marked(text, lat, given)) for text in texts if (lat := lattice(text, given, form)) is not None]
    pairs += twins(texts, given, form)
    items, marks = [x for x, _ in pairs], [y for _, y in pairs]
    f = Field(np.zeros((BUCKETS + 1, LABELS), np.float32), np.zeros((LABELS, LABELS)), np.array([[0.0, *[0.5] * len(TYPES)]] * 2), given)
    f.step += np.eye(LABELS) * 0.5
    batches = [Batch(items[i : i + chunk], marks[i : i + chunk]) for i in range(0, len(items), chunk)]
    sums = [np.full_like(x, 1e-8) for x in (f.weights, f.step, f.skip)]
    for _ in range(epochs):
        for b in batches:
            if not b.n:
                continue
            local = f.weights[b.feats].sum(2)
            held, free = (beliefs(f, b, x, local=local) for x in (b.clamped & b.allowed, b.allowed))
            gap = (np.exp(held[0]) - np.exp(free[0])) * b.mask[:, :, None]
            flat = b.feats.reshape(-1, b.feats.shape[2])
            rows = gap.reshape(-1, LABELS)
            live = np.abs(rows).max(1) > 1e-4
            at = flat[live].ravel()
            g = np.stack([np.bincount(at, np.repeat(rows[live, k], flat.shape[1]), BUCKETS + 1) for k in range(LABELS)], 1).astype(np.float32)
            inside = b.mask[:, 1:, None, None]
            gs = ((np.exp(held[1]) - np.exp(free[1])) * inside).sum((0, 1))
            gk = np.zeros_like(f.skip)
            np.add.at(gk, b.edges[:, 4], np.einsum("ekk->ek", np.exp(held[2]) - np.exp(free[2])))
            for x, gx, sx in zip((f.weights, f.step, f.skip), (g, gs, gk), sums, strict=True):
                gx = gx / b.n - ridge * x
                sx += gx * gx
                x += rate * gx / np.sqrt(sx)
            f.skip[:] = np.clip(f.skip, 0, 3)
            f.skip[:, 0] = 0  # an unclear mention follows a clear one, but takes nothing from it
            f.weights[BUCKETS] = 0  # padding
    return f


def labels(f: Field, items: list[Lattice]) -> list[list[int]]:
    """The likeliest label of each token."""
    out = [[0] * len(lat.at) for lat in items]
    b = Batch(items)
    if b.n:
        best = beliefs(f, b, b.allowed)[0].argmax(2)
        for r, (x, a, z) in enumerate(b.rows):
            out[x][a:z] = best[r, : z - a].tolist()
    return out


def entities(lat: Lattice, tags: list[int]) -> list[tuple[int, int, int]]:
    """``(start, end, type)`` of the runs of one label in a chain."""
    out: list[list[int]] = []
    starts = set(lat.breaks)
    for i, (t, (s, e)) in enumerate(zip(tags, lat.at, strict=True)):
        if not t:
            continue
        if out and i not in starts and i and tags[i - 1] == t and out[-1][2] == t:
            out[-1][1] = e
        else:
            out.append([s, e, t])
    return [(s, e, t) for s, e, t in out if t != 5 or _whole_name(lat, s, e)]


def _whole_name(lat: Lattice, s: int, e: int) -> bool:
    """A name needs two words (a given name alone is none)."""
    return sum(s <= a < e and w.isalpha() for w, (a, _) in zip(lat.word, lat.at, strict=True)) >= 2


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    for s, e, t in sorted(found, reverse=True):
        text = text[:s] + PLACEHOLDERS[t - 1] + text[e:]
    return text


class Tagger:
    def __init__(self, f: Field):
        self.field, self.form = f, _given_form(f.given)

    def __call__(self, texts: list[str], chunk: int = 512) -> list[list[tuple[int, int, int]]]:
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        held: list[tuple[int, Lattice]] = []

        def flush() -> None:
            for (i, lat), tags in zip(held, labels(self.field, [x for _, x in held]), strict=True):
                out[i] = entities(lat, tags)
            held.clear()

        for i, text in enumerate(texts):
            lat = lattice(text, self.field.given, self.form)
            if lat is not None:
                held.append((i, lat))
                if len(held) == chunk:
                    flush()
        if held:
            flush()
        return out


# -- over tables -------------------------------------------------------------------------------------------------

_FIELDS: dict[tuple, Field] = {}


def learn(texts: DataFrame, fit_rows: int = FIT_ROWS, fit_texts: int = FIT_TEXTS) -> Field:
    """The field fitted to at most ``fit_rows`` distinct texts of ``texts(text)``, those with the least hash (all, where there are fewer).

    Only its weights rest on these; the given names are those of all texts.
    """
    texts = texts.select("text").where("text is not null")
    given = all_given_names(texts)
    # only about as many texts as are wanted leave their partitions, copies of one as one; the least hashes are among them
    h = F.xxhash64("text")
    share = min(1.0, 2 * fit_rows / max(1, texts.agg(F.approx_count_distinct(h, 0.02)).first()[0]))
    near = texts.where(F.pmod(h, F.lit(1 << 20)) <= int(share * (1 << 20))).distinct()
    rows = near.orderBy(F.pmod(h, F.lit(1 << 20)), h, "text").limit(fit_rows).where(possible(F.col("text"), given)).collect()
    held, form = [], _given_form(given)
    for r in rows:
        if len(held) < fit_texts and spans_of(r["text"], form):
            held.append(r["text"])
    key = (len(held), crc32("\n".join(held).encode()), crc32("\n".join(sorted(given)).encode()))
    if key not in _FIELDS:
        _FIELDS.clear()
        _FIELDS[key] = fit(held, given=given)
    return _FIELDS[key]


def save(model: Field, spark: SparkSession, path: str) -> None:
    """Write a field as one row, so that later runs label alike whatever rows were added."""
    rows = [(model.weights.tobytes(), model.step.tobytes(), model.skip.tobytes(), sorted(model.given))]
    spark.createDataFrame(rows, "weights binary, step binary, skip binary, given array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Field:
    """A field that ``save`` wrote."""
    r = spark.read.parquet(path).first()
    weights, step, skip = (np.frombuffer(bytes(x), t) for x, t in ((r["weights"], np.float32), (r["step"], np.float64), (r["skip"], np.float64)))
    return Field(weights.reshape(BUCKETS + 1, LABELS).copy(), step.reshape(LABELS, LABELS).copy(), skip.reshape(-1, LABELS).copy(), frozenset(r["given"]))


def _tag(source: DataFrame, model: Field) -> DataFrame:
    """``field_name, record_id, pii_type`` of each text, its types once."""
    shared = source.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x labels, and a bounded list of names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            names, ids, texts = (c.to_pylist() for c in b.columns)
            rows = [(n, i, TYPES[t - 1]) for n, i, f in zip(names, ids, tagger(texts), strict=True) for t in sorted({x[2] for x in f})]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["field_name", "record_id", "pii_type"])

    return source.mapInArrow(run, "field_name string, record_id string, pii_type string")


def _mask(source: DataFrame, model: Field) -> DataFrame:
    """``source`` without its last column ``asked``, which marks the texts that may hold something; the others pass as they are."""
    shared = source.sparkSession.sparkContext.broadcast(model)  # as above

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in batches:
            asked = b.column(3)
            texts = b.column(2).filter(asked).to_pylist()
            done = pa.array([redact(t, f) for t, f in zip(texts, tagger(texts), strict=True)], b.column(2).type)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.replace_with_mask(b.column(2), asked, done)], ["field_name", "record_id", "text"])

    return source.mapInArrow(run, "field_name string, record_id string, text string")


def find(texts: DataFrame, model: Field | None = None) -> DataFrame:
    """Distinct ``field_name, record_id, pii_type`` of ``texts(field_name, record_id, text)``.

    Texts are read whole. Null and empty texts hold nothing; rows with a null id are left
    out, since they can't be named; repeated rows count once; no rows, no result.
    """
    model = model or learn(texts)
    held = texts.select("field_name", "record_id", "text").where(F.col("record_id").isNotNull() & possible(F.col("text"), model.given))
    return _tag(spread(held), model).distinct()


def redact_texts(texts: DataFrame, model: Field | None = None) -> DataFrame:
    """Every row of ``texts`` with its personal data replaced by placeholders; all else is unchanged."""
    model = model or learn(texts)
    return _mask(spread(texts.select("field_name", "record_id", "text", possible(F.col("text"), model.given).alias("asked"))), model)
