"""Whether a draft's commitments, numbers, dates, links and phone numbers stand in its evidence.

Everything is an expression over one row: the draft and the array of replies that it was
written from. Reasons are short strings, ``kind`` or ``kind:what``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as X


def _tagged(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(kind + ":"), x))


def _one(kind: str, broken: Column, what: Column | None = None) -> Column:
    said = F.lit(kind) if what is None else F.concat(F.lit(kind + ":"), what)
    return F.when(F.coalesce(broken, F.lit(False)), said)


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(X.text(c), F.lit(pattern), F.lit(0))


def amount_forms(amount: Column) -> list[Column]:
    """An amount as it may be written: two decimals, with separators too, and as short as it goes."""
    whole = amount == F.floor(amount)
    return [F.format_string("%.2f", amount), F.format_string("%,.2f", amount), F.when(whole, amount.cast("bigint").cast("string")).otherwise(amount.cast("string"))]


def slot_reasons(slots: dict[str, Column], corpus: Column) -> Column:
    """Slots that the corpus (lower case, blanks collapsed) doesn't support; an empty slot needs no support."""
    amount = slots["compensation_amount"]
    written = F.lit(False)
    for form in amount_forms(amount):
        written = written | F.contains(corpus, form)
    line = F.lower(F.regexp_replace(slots["promised_timeline"], r"\s+", " "))
    days = slots["refund_window_days"].cast("string")
    found = F.array(
        _one("refund", slots["refund_offered"] & ~corpus.rlike(r"\brefund")),
        _one("window", ~F.contains(corpus, days), days),
        _one("amount", amount.isNotNull() & ~written, F.format_string("%.2f", amount)),
        _one("timeline", ~F.contains(corpus, line), line),
        _one("entitlement", slots["entitlement_claimed"].isNotNull() & ~corpus.rlike(r"\bentitle")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def _bare_link(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[/.,]+$", "")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def draft_reasons(draft: Column, replies: Column) -> Column:
    """Why a draft can't be sent: unsupported slots, numbers, dates, links and phone numbers, and an agent's mark at its end.

    ``replies`` is an array of texts, null members left out; a customer's own words are
    no evidence. A null or empty draft has no reasons.
    """
    raw = F.coalesce(F.array_join(replies, "\n"), F.lit(""))
    corpus = X.evidence_text(F.coalesce(replies, F.array().cast("array<string>")))
    plain = F.array(*(F.lit(x) for x in X.PLAIN_NUMBERS))
    links = F.transform(_all(raw, X.LINK), _bare_link)
    phones = F.transform(_all(raw, X.PHONE), _digits)
    reasons = F.concat(
        slot_reasons(X.commitments(draft), corpus),
        _tagged("number", F.filter(_all(draft, X.NUMBER), lambda x: ~F.array_contains(plain, F.regexp_replace(x, ",", "")) & ~F.contains(corpus, F.lower(x)))),
        _tagged("date", F.filter(_all(draft, X.DATE), lambda x: ~F.contains(corpus, F.lower(x)))),
        _tagged("link", F.filter(_all(draft, X.LINK), lambda x: ~F.array_contains(links, _bare_link(x)))),
        _tagged("phone", F.filter(_all(draft, X.PHONE), lambda x: ~F.array_contains(phones, _digits(x)))),
        F.filter(F.array(_one("mark", draft.rlike(X.SIGIL_END))), lambda x: x.isNotNull()),
    )
    return F.when(X.text(draft) == "", F.array().cast("array<string>")).otherwise(reasons)


def exemplar_lines(evidence: Column) -> Column:
    """Evidence as numbered lines of a prompt: ``1. [id] customer | reply``; null texts are empty, no evidence is an empty text."""
    line = lambda e, i: F.concat((i + 1).cast("string"), F.lit(". ["), X.text(e["evidence_id"]), F.lit("] "), X.text(e["customer_text"]), F.lit(" | "), X.text(e["brand_reply"]))
    return F.array_join(F.transform(F.coalesce(evidence, F.expr("array()")), line), "\n")


def strict_schema(schema: dict) -> dict:
    """A JSON schema with every property required and none beside them, at every depth."""
    if not isinstance(schema, dict):
        return [strict_schema(x) for x in schema] if isinstance(schema, list) else schema
    out = {k: strict_schema(v) for k, v in schema.items()}
    if isinstance(out.get("properties"), dict):
        out["required"], out["additionalProperties"] = list(out["properties"]), False
    return out
