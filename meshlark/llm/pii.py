"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and range checks confirm them,
and words near a span raise its score. Besides personal data, keys of well-known form and
secrets given to a name are found. A text is cut once at a pattern's matches; the
lengths of the pieces give the positions, so the work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans with a lower score are left out. Kinds of the base set always reach it.
MIN_SCORE = 0.6
#: Code points looked at on either side of a span.
NEAR = 40
_BLOCK = 256


def _digits(text: Column) -> Column:
    return F.translate(text, " -", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` (at most 19, blanks and hyphens aside) pass Luhn's check."""
    back = F.reverse(_digits(text))

    def weight(i: Column) -> Column:
        digit = F.substr(back, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), weight), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number in international form leaves 1 when divided by 97."""
    plain = F.translate(text, " ", "")
    turned = F.concat(F.substring(plain, 5, 60), F.substring(plain, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    """A kind of span: what proposes it, what confirms it, and its score."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    hint: str = ""  # without this string a text has no match
    raised: float = 0.2


def _any(_: Column) -> Column:
    return F.lit(True)


def _secret(text: Column) -> Column:
    """A value that reads like no word: it has a digit, or the name says password."""
    return text.rlike("[0-9]") | F.lower(F.left(text, F.lit(5))).rlike("^(?:passw|pwd)")


def _phone(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "0123456789", ""))).between(9, 15)


# The patterns find the leftmost non-overlapping matches of, in this order,
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+  with 12 to 19 digits
#   \+[0-9][\x20().0-9-]+[0-9]
# A match can only begin where its run begins, or where the last match ended (\G), and a
# run is never given back, so no text makes them go back and forth. Repeats without a bound
# are of single characters or possessive: both are loops, which no length makes recursive.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _any, 0.8, "e-?mails?|mails?|contact|write", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda m: m.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$"), 0.6, "address|addresses|hosts?|servers?|ips?", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", luhn, 0.7, "cards?|visa|credit|debit|pay|paid|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.7, "phones?|telephone|tel|calls?|fax|mobile", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", mod97, 0.8, "iban|accounts?|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _any, 0.3, "ssn|social security", "-", 0.5),
    Kind("key", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{9,}[A-Za-z0-9]|sk-[A-Za-z0-9_-]{19,}[A-Za-z0-9_])(?![A-Za-z0-9_])|-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----", _any, 0.8, "aws|keys?|secrets?|tokens?"),
    Kind("secret", r"(?<![A-Za-z0-9_])(?:[Aa][Pp][Ii][ _-]?[Kk][Ee][Yy]|[Aa]ccess[ _-]?[Kk]ey|ACCESS_KEY|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Pp]assw(?:or)?d|PASSWORD|[Pp]wd)[\"']?[ \t]*[:=][ \t]*[\"']?[^\x00-\x20\"'<>,;#]{8,}+", _secret, 0.7, "keys?|secrets?|credentials?|login"),
)
BASE = ("email", "ip", "card", "phone")


def running_sums(lengths: Column) -> Column:
    """For each entry of an int array the sum of those before it, in blocks so that long arrays stay cheap."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    before = F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v)), F.array(F.lit(0)), add)
    within = F.transform(blocks, lambda x, b: F.slice(F.aggregate(x, F.array(F.get(before, b)), add), F.lit(1), F.size(x)))
    return F.flatten(within)


def _found(kind: Kind, order: int) -> Column:
    """The confirmed spans of one kind from the columns m_<kind>, p_<kind> and o_<kind>."""
    m, p, o = F.col(f"m_{kind.name}"), F.col(f"p_{kind.name}"), F.col(f"o_{kind.name}")

    def span(match: Column, i: Column) -> Column:
        piece, after = F.get(p, i), F.get(p, i + 1)
        start = F.get(o, i) + F.length(piece)
        near = F.lower(F.concat_ws(" ", F.right(piece, F.lit(NEAR)), F.left(after, F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(near.rlike(f"(?<![a-z0-9_])(?:{kind.context})(?![a-z0-9_])"), kind.raised).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(order).alias("kind_order"), (start + F.length(match)).alias("end"), F.lit(kind.name).alias("kind"), match.alias("text"), F.round(F.least(score, F.lit(1.0)), 3).alias("score"))

    ok = F.filter(F.transform(m, span), lambda s: kind.valid(s["text"]) & (s["score"] >= MIN_SCORE))
    return F.when(F.size(m) > 0, ok)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Spans of personal data in every text.

    Returns ``id_col`` and ``spans``: an array, ordered by start and then kind, of
    (start, end, kind, text, score); positions in code points, ends exclusive. One row for
    each row of ``docs``; null and empty texts have no spans. Other columns are not read.
    """
    none = F.array().cast("array<string>")
    out = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    matches = {f"m_{k.name}": F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)) for k in kinds}
    out = out.select(id_col, "_text", *(F.when(F.contains(text, F.lit(k.hint)), matches[f"m_{k.name}"]).otherwise(none).alias(f"m_{k.name}") if k.hint else matches[f"m_{k.name}"].alias(f"m_{k.name}") for k in kinds))
    out = out.select(id_col, *(f"m_{k.name}" for k in kinds), *(F.when(F.size(f"m_{k.name}") > 0, F.split(text, k.pattern)).alias(f"p_{k.name}") for k in kinds))
    both = {k.name: F.zip_with(F.slice(f"p_{k.name}", F.lit(1), F.size(f"m_{k.name}")), F.col(f"m_{k.name}"), lambda a, b: F.length(a) + F.length(b)) for k in kinds}
    out = out.select("*", *(F.when(F.size(f"m_{k.name}") > 0, both[k.name]).alias(f"l_{k.name}") for k in kinds))
    out = out.select("*", *(F.when(F.size(f"m_{k.name}") > 0, running_sums(F.col(f"l_{k.name}"))).alias(f"o_{k.name}") for k in kinds))
    out = out.select(id_col, F.array_compact(F.array(*(_found(k, i) for i, k in enumerate(kinds)))).alias("_found"))
    return out.select(id_col, F.transform(F.array_sort(F.flatten("_found")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text"), s["score"].alias("score"))).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
