"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Everything runs as column expressions over one scan, without an exchange. A kind's pattern cuts the text
into matches and the gaps between them, so a running sum of their lengths gives each match's place in code
points, and the end of the gap before a match is its context. The running sum takes log n passes over the lengths, so
a text with n matches costs n log n steps.

The patterns are written with possessive repeats and guarded starts: they find what the plain forms find, but
a run of n characters costs n steps, where the plain forms may take n * n or overflow the expression engine's stack.

Defined cases: a null text counts as empty and has no spans; a null doc_id is passed through; rows are judged
one by one, so repeated rows give repeated results; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.columns import let

BASE_KINDS = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
THRESHOLD = 0.5

# Value 0-255 with leading zeros, and the words that speak for a kind when they stand before a match.
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
CARD_WORDS = r"(?i)(?:card|visa|master|amex|credit|debit)"
PHONE_WORDS = r"(?i)(?:phone|mobile|call|fax|whatsapp|tel[.:]|telef)"
MAIL_WORDS = r"(?i)(?:mail|contact|write to)"
IP_WORDS = r"(?i)(?:address|server|host|client)"
IBAN_WORDS = r"(?i)(?:iban|account|konto|compte|cuenta)"
SSN_WORDS = r"(?i)(?:ssn|social security|soc\. sec)"
SECRET_WORDS = r"(?i)(?:token|secret|passw|api[ _-]?key|access[ _-]?key|private[ _-]?key)"
INTERNATIONAL = r"\+[0-9 ().-]*$"


@dataclass(frozen=True)
class Kind:
    """``score`` is what a confirmed match has by itself; ``context`` words before it add ``boost``."""

    name: str
    pattern: str
    confirm: Callable[[Column, Column], Column]
    score: float
    context: str
    boost: float = 0.4
    needs: str = "digit"

    @property
    def base(self) -> bool:
        return self.name in BASE_KINDS


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn checksum; every second digit from the right counts double, less 9 beyond 9."""
    doubled = F.translate(F.reverse(digits), "0123456789", "0246813579")
    plain = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 0, F.substring(doubled, i, F.lit(1))).otherwise(F.substring(plain, i, F.lit(1))).try_cast("int"),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account number with its first four characters moved to the end is 1 modulo 97; letters count 10 to 35."""
    compact = F.regexp_replace(code, " ", "")
    turned = F.split(F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4)), "")
    rest = F.aggregate(
        F.filter(turned, lambda c: c != ""),
        F.lit(0),
        lambda acc, c: F.when(F.ascii(c) >= 65, (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97),
    )
    return F.length(compact).between(15, 34) & (rest == 1)


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m, before: F.lit(True), 0.9, MAIL_WORDS, needs="at"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda m, before: m.rlike(IP_PARTS), 0.6, IP_WORDS),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda m, before: F.when(F.length(digits_of(m)).between(13, 19), luhn(digits_of(m))).otherwise(False), 0.7, CARD_WORDS),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m, before: F.length(digits_of(m)).between(9, 15), 0.6, PHONE_WORDS),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", lambda m, before: mod97(m), 0.6, IBAN_WORDS),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m, before: ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), 0.3, SSN_WORDS),
    Kind("localphone", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}", lambda m, before: ~before.rlike(INTERNATIONAL), 0.3, PHONE_WORDS),
    Kind("secret", r"[A-Za-z0-9_-]{20,}+", lambda m, before: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.3, SECRET_WORDS, needs="secret"),
)


def running(lengths: Column) -> Column:
    """Inclusive running sums of an array: pass k adds what stands 2 ** k places before."""

    def add(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))

    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths))).cast("int") - 1)
    return F.when(F.size(lengths) > 1, F.aggregate(passes, lengths, add)).otherwise(lengths)


def _spans(kind: Kind, pieces: Column) -> Column:
    """Spans (start, end, score) of one kind from its pieces: an array of (gap, match), the last match null."""

    def judged(piece: Column, end: Column) -> Column:
        before = F.right(piece["gap"], F.lit(CONTEXT_CHARS))
        score = F.lit(kind.score) + F.when(before.rlike(kind.context), kind.boost).otherwise(0.0)
        confirmed = F.when(piece["match"].isNull(), False).otherwise(kind.confirm(piece["match"], before))
        taken = confirmed if kind.base else F.when(confirmed, score >= THRESHOLD).otherwise(False)
        return F.when(taken, F.struct((end - F.length(piece["match"])).alias("start"), end.alias("end"), score.alias("score")))

    lengths = F.transform(pieces, lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0)))
    return let(lengths, lambda own: F.filter(F.zip_with(pieces, running(own), judged), lambda span: span.isNotNull()))


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``keep`` columns and one column per kind, an array of (start, end, score) by start.

    Base kinds keep every confirmed match; other kinds need a score of ``THRESHOLD``.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has = {"at": F.contains(t, F.lit("@")), "digit": t.rlike("[0-9]"), "secret": t.rlike(SECRET_WORDS)}
    none = F.array().cast("array<string>")
    cut = docs.select(*keep, t.alias("_text"), *[v.alias(f"_{k}") for k, v in has.items()]).select(
        *keep,
        *[F.when(F.col(f"_{k.needs}"), F.regexp_extract_all("_text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"_m_{k.name}") for k in kinds],
        "_text",
    )
    cut = cut.select(
        *keep,
        *[
            F.when(
                F.size(f"_m_{k.name}") > 0,
                F.zip_with(F.split("_text", k.pattern, -1), F.col(f"_m_{k.name}"), lambda g, m: F.struct(g.alias("gap"), m.alias("match"))),
            )
            .otherwise(F.array().cast("array<struct<gap:string,match:string>>"))
            .alias(f"_p_{k.name}")
            for k in kinds
        ],
    )
    return cut.select(*keep, *[_spans(k, F.col(f"_p_{k.name}")).alias(k.name) for k in kinds])


def digest(found: DataFrame) -> DataFrame:
    """Counts, span list and checksum of ``find_pii``'s result: one row per document."""

    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    def listed(names: tuple[str, ...]) -> Column:
        return F.array_join(F.concat(*map(named, names)), ",")

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(BASE_KINDS), 256).alias("base_sha256"),
        listed(tuple(k.name for k in KINDS)).alias("spans"),
    )
