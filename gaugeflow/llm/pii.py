"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is one projection of built-in column functions: no shuffle, no
Python. Positions are code points of the whole text, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from gaugeflow.llm.common import ascii_lower, bound

#: Prefix sums run inside pieces of this many matches and once over the pieces, so that a text with n matches costs n * PIECE.
PIECE = 256
#: Code points on each side of a span that are searched for context words.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``pattern`` proposes spans, leftmost and without overlaps; ``hint`` is a
    cheap test that a text can hold any; ``valid`` confirms a span's text; a
    span scores ``score``, plus ``bonus`` next to ``words``. Spans under the
    finder's least score go unless ``always`` is set.
    """

    name: str
    pattern: str
    hint: str
    valid: callable
    score: float
    words: str
    bonus: float = 0.1
    always: bool = False


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """12 to 19 digits whose Luhn sum is a multiple of ten."""
    d = digits(x)
    return F.length(d).between(12, 19) & F.call_function("luhn_check", d)


def octets(x: Column) -> Column:
    return F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def mod97(x: Column) -> Column:
    """ISO 7064: the first four characters go to the end, letters count from 10, the number leaves 1 modulo 97."""
    s = F.replace(x, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(rest, c):
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


# The four base patterns never give back what a repetition has taken, and a
# match may only begin where a run of its characters begins or the previous
# match ended. This finds the same matches as the plain patterns in time that
# is linear in the text.
EMAIL = Kind(
    "email",
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "@",
    lambda x: F.lit(True),
    0.9,
    "mail|contact|write",
    always=True,
)
IP = Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", octets, 0.6, "ip|address|host|server", 0.3, True)
CARD = Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "", luhn, 0.8, "card|visa|credit|payment", 0.2, True)
PHONE = Kind(
    "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda x: F.length(digits(x)).between(9, 15), 0.7, "phone|call|tel|mobile", 0.3, True
)
# Length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_pattern() -> str:
    """Account numbers of exactly their country's length, blanks between characters allowed."""
    lengths = sorted(set(IBAN_LENGTHS.values()))
    return "|".join(f"(?:{'|'.join(c for c, n in IBAN_LENGTHS.items() if n == m)})[0-9]{{2}}(?: ?[A-Z0-9]){{{m - 4}}}" for m in lengths)


def ipv6(x: Column) -> Column:
    """Eight groups, or fewer around one ``::``; at least three colons and a digit, so that names and times are none."""
    group = "[0-9A-Fa-f]{1,4}"
    few = f"({group}(:{group})*)?"
    colons = F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit("")))
    return x.rlike("[0-9]") & (x.rlike(f"^({group}:){{7}}{group}$") | (x.rlike(f"^{few}::{few}$") & colons.between(3, 7)))


IBAN = Kind("iban", f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{iban_pattern()})", "", mod97, 0.9, "iban|account|bank")
SSN = Kind("ssn", r"[0-9]+-[0-9]+-[0-9]+", "-", lambda x: x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 0.3, "ssn|social security|taxpayer", 0.6)
IPV6 = Kind("ipv6", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]*+:[0-9A-Fa-f:]{3,}+", ":", ipv6, 0.6, "ip|address|host|server", 0.3)
KEY = Kind("key", r"A[KS]IA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[0-9]+-[A-Za-z0-9-]{10,}", "", lambda x: F.lit(True), 0.9, "key|token|secret")
# Long runs of letters and digits are secrets only beside a word that says so.
SECRET = Kind(
    "secret",
    r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+",
    "",
    lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]"),
    0.3,
    "token|secret|password|passwd|apikey|key|credential|credentials",
    0.6,
)

BASE = (EMAIL, IP, CARD, PHONE)
KINDS = (*BASE, IBAN, SSN, IPV6, KEY, SECRET)


def _starts(steps: Column) -> Column:
    """Running sums of an array, in pieces so that no long array is copied for every element."""

    def run(piece, first):
        return F.aggregate(piece, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def cut(steps):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / PIECE).cast("int")), lambda b: F.slice(steps, b * PIECE + 1, PIECE))

    def offsets(pieces):
        sums = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        return F.slice(run(sums, F.lit(0)), F.lit(1), F.size(pieces))

    def starts(pieces):
        with_first = F.arrays_zip(pieces.alias("p"), offsets(pieces).alias("o"))
        return F.flatten(F.transform(with_first, lambda z: F.slice(run(z["p"], z["o"]), 2, PIECE)))

    return bound(steps, lambda s: bound(cut(s), starts))


def _spans(text: Column, kind: Kind, order: int) -> Column:
    """Confirmed spans of one kind: what lies between the matches gives their positions."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found")
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g)).alias("gaps")

    def placed(z):
        before = F.transform(z["found"], lambda m, i: F.get(z["gaps"], i) + F.when(i > 0, F.length(F.get(z["found"], i - 1))).otherwise(0))
        return F.arrays_zip(_starts(before).alias("start"), z["found"].alias("text"))

    confirmed = F.filter(bound(F.struct(found, gaps), placed), lambda s: kind.valid(s["text"]))

    def scored(s):
        end = s["start"] + F.length(s["text"])
        left = F.greatest(s["start"] - CONTEXT, F.lit(0))
        around = F.concat(F.substr(text, left + 1, s["start"] - left), F.lit(" "), F.substr(text, end + 1, F.lit(CONTEXT)))
        near = ascii_lower(around).rlike(f"(^|[^a-z0-9])({kind.words})([^a-z0-9]|$)")
        score = F.lit(kind.score) + F.when(near, kind.bonus).otherwise(0.0)
        return F.struct(
            s["start"].cast("long").alias("start"),
            F.lit(order).alias("order"),
            end.cast("long").alias("end"),
            F.lit(kind.name).alias("kind"),
            F.round(score, 2).alias("score"),
            s["text"].alias("text"),
        )

    possible = text.rlike(kind.pattern) if not kind.hint else text.contains(kind.hint) & text.rlike(kind.pattern)
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string,score:double,text:string>>")
    return F.when(possible, F.transform(confirmed, scored)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS, least: float = 0.5, into: str = "pii") -> DataFrame:
    """``docs`` with an array column ``into`` of spans (start, order, end, kind, score, text), by start and then kind.

    NULL and empty texts give an empty array. Rows, repeated ones too, and all
    other columns stay as they are; a column that is already named ``into`` is
    replaced. Kinds overlap freely; spans of one kind never do.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = [_spans(body, k, i) if k.always else F.filter(_spans(body, k, i), lambda s: s["score"] >= least) for i, k in enumerate(kinds)]
    return docs.withColumn(into, F.array_sort(F.concat(*found)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = find_pii(docs.select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    base = F.filter("pii", lambda s: s["order"] < len(BASE))
    scores = F.concat_ws(",", F.transform("pii", lambda s: F.round(s["score"] * 100).cast("int").cast("string")))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        scores.alias("scores"),
    )
