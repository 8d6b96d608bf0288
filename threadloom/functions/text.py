"""Text expressions: normal form, tokens, markers, amounts, commitments. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and marker lists that results depend on.
URL = r"(?i)https?://\S+|\bwww\.\S+"
MENTION = r"@[\p{L}\p{N}_]+"
SIGIL_END = r"[\^~*/][A-Z]{1,3}\s*$"
SIGILS_END = r"(?:[\^~*/][A-Z]{1,3}\s*)+$"
PART = r"^\s*(\d+)/(\d+)\b"
TOKEN = r"[a-z0-9#]+"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.]+"
ORDER = r"\b\d{3}-\d{7}-\d{7}\b"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
PHONE = r"(?:\+?\d[\d\s().-]{7,}\d)"
MONEY = r"[$£€]\s?\d[\d,]*(?:\.\d{2})?"
DURATION = r"(?i)\b\d+\s*(?:business\s+)?(?:hour|day|week|month)s?\b"
NUMBER = r"\b\d[\d,]*(?:\.\d+)?\b"
DATE = r"(?i)\b(?:\d{1,2}[/-]\d{1,2}(?:[/-]\d{2,4})?|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2})\b"
LINK = r"(?i)https?://[^\s)]+|\b(?:www\.)[^\s)]+"
REFUND = r"\brefund(?:ed|ing)?\b"
NO_REFUND = r"\b(?:can(?:no|')t|cannot|unable to|no)\s+refund"
WINDOW = r"\bwithin\s+(\d+)\s*(?:business\s+)?(day|week|month)s?\b"
ENTITLED = r"(?i)\byou(?:'re| are)\s+entitled\s+to\s+([^.!?]{1,60})"
PASSED_ON = r"(?i)\b(?:we(?:'ll| will)|I(?:'ll| will))\s+(?:escalate|pass this (?:on|to)|have (?:a|our) (?:specialist|manager|team)[^.!?]{0,40})"
INJECTION = ["ignore previous instructions", "ignore all previous", "system prompt", "you are now", "disregard the above", "new instructions"]
SELF_HARM = [
    "kill myself", "killing myself", "end my life", "ending my life", "want to die", "wanna die", "better off dead", "suicidal", "suicide", "self harm", "self-harm", "hurt myself",
    "hurting myself", "no reason to live", "don't want to be here anymore",
]
THREAT = [
    "i'll kill you", "ill kill you", "kill you", "hunt you down", "find you and", "burn down", "shoot up", "bomb", "come to your office", "you're dead", "watch your back", "i will hurt", "make you pay",
]
ABUSE = (
    r"(?i)\b(?:fuck|screw)\s+(?:you|off|yourself)\b|\byou(?:'re|\s+are|\s+r)\s+(?:a\s+)?(?:fucking\s+)?(?:idiot|moron|useless|retard|scum|trash|garbage|worthless)\b"
    r"|\b(?:stupid|useless|incompetent)\s+(?:fucking\s+)?(?:bitch|bastard|idiots?)\b"
)
LEGAL = ["lawyer", "sue", "solicitor", "gdpr", "chargeback", "ombudsman", "small claims", "legal action"]
SECURITY = ["hacked", "unauthorized charge", "unauthorised charge", "someone else", "stolen", "fraud"]
RESOLUTION = ["try", "go to", "head to", "tap", "click", "reinstall", "log out", "sign out", "settings", "we've", "we have", "refunded", "issued", "updated", "reset"]
CONFIRMATION = r"(?i)\b(?:thank(?:s| you)|thx|that worked|it works|works now|sorted|fixed|perfect|great,? thanks|cheers)\b"
COMMITMENT = ["we will", "we'll", "you're entitled", "you are entitled", "guaranteed", "guarantee", "we can refund", "we will refund"]
DM = r"(?i)\b(?:dm|direct message|message) us\b|\bsend us a (?:dm|direct message)\b"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
PLAIN_NUMBERS = ["24", "7", "100", "1", "2", "3"]


def any_of(words: list[str]) -> str:
    return "(?i)" + "|".join(words)


def any_word(words: list[str]) -> str:
    return r"(?i)\b(?:" + "|".join(words) + r")\b"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def matches(c: Column, pattern: str) -> Column:
    return text(c).rlike(pattern)


def normalise(c: Column) -> Column:
    """Links and handles become tokens, a leading part number and trailing agent marks go, blanks collapse; null is empty."""
    t = F.regexp_replace(text(c), URL, "[URL]")
    t = F.regexp_replace(t, MENTION, "@user")
    t = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"^\d+/\d+\b\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+$", ""), SIGILS_END, "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^ | $", "")


def part(c: Column, which: int = 1) -> Column:
    return F.regexp_extract(text(c), PART, which).try_cast("int")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))


#: Name, pattern and placeholder, in the order of use: each sees what the former left.
MASKS = [("email", EMAIL, "<EMAIL>"), ("order_number", ORDER, "<ORDER>"), ("card_like", CARD, "<CARD>"), ("phone", PHONE, "<PHONE>")]


def masked(c: Column) -> tuple[Column, Column]:
    """The text with plain patterns masked, and the names of those found in order."""
    t, found = text(c), []
    for name, pattern, to in MASKS:
        found.append(F.when(t.rlike(pattern), F.lit(name)))
        t = F.regexp_replace(t, pattern, to)
    return t, F.filter(F.array(*found), lambda x: x.isNotNull())


def amounts(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(text(c), F.lit(MONEY), F.lit(0)), lambda m: F.regexp_replace(m, r"[^0-9.]", "").try_cast("double"))


def resolves(reply: Column, follow_up: Column | None = None) -> Column:
    """A step rather than a question; with a follow-up (also an empty one), only if that confirms it."""
    low = F.lower(text(reply))
    step = low.rlike("|".join(RESOLUTION)) & low.rlike(r"\S")
    return step if follow_up is None else step & F.when(follow_up.isNull(), True).otherwise(follow_up.rlike(CONFIRMATION))


def first(c: Column, pattern: str, group: int = 0) -> Column:
    x = F.regexp_extract(text(c), pattern, group)
    return F.when(x != "", F.regexp_replace(x, r"^\s+|\s+$", ""))


#: Names and expressions of what a draft commits to.
def commitments(c: Column) -> dict[str, Column]:
    low = F.lower(text(c))
    unit = F.regexp_extract(low, WINDOW, 2)
    days = F.regexp_extract(low, WINDOW, 1).try_cast("int") * F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30)
    return {
        "refund_offered": low.rlike(REFUND) & ~low.rlike(NO_REFUND),
        "refund_window_days": days,
        "compensation_amount": F.get(amounts(c), F.lit(0)),
        "promised_timeline": first(c, DURATION),
        "entitlement_claimed": first(c, ENTITLED, 1),
        "escalation_promise": first(c, PASSED_ON),
    }


def risky_spans(c: Column) -> Column:
    """Distinct lower-case spans that could bind: amounts, durations, promises, dates, in this order."""
    found = F.concat(*(F.regexp_extract_all(text(c), F.lit(p), F.lit(0)) for p in (MONEY, DURATION, any_of(COMMITMENT), DATE)))
    return F.array_distinct(F.transform(found, F.lower))


def evidence_text(replies: Column) -> Column:
    """Lower-case corpus of an array of replies with blanks collapsed."""
    return F.lower(F.regexp_replace(F.array_join(replies, " "), r"\s+", " "))
