"""Operator 10: personal data, by regular expressions, checksums and context, in Spark SQL functions only.

A pattern proposes spans; a validator (part sizes, digit counts, Luhn, mod-97) confirms them; words just before a span
raise its score, and spans of weak kinds count only with them. Positions are code points, ends exclusive. A span's
place follows from the lengths of the matches and of the text between them; these are added up within groups of
MATCHES_AT_ONCE matches and then over the groups, so that the work follows the length of the text.

Patterns with repeated groups are applied to a text of equal length in which the separators inside a run are replaced
by a private-use character; so each is a plain run of characters, which takes linear time and no deep recursion.

Defined results: null text is empty text and has no spans; an empty table gives no rows; repeated rows each get their
own; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds: account numbers by mod-97; numbers and keys only where words before them say so.
MORE_KINDS = ("iban", "ssn", "secret")
KINDS = BASE_KINDS + MORE_KINDS
CONTEXT_CHARS = 40
KEEP_FROM = 0.5
MATCHES_AT_ONCE = 256
_INNER, _OTHER = "\ue000", "\ue001"
_LOCAL = rf"[A-Za-z0-9._%+{_INNER}-]"
#: Characters of an account number by country.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in _IBAN_LENGTHS.items())
#: pattern, prior score, pattern of context words before the span
_RULES = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++{_INNER}[A-Za-z0-9{_INNER}-]++", 0.9, "(?i)mail|contact|write"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.7, "(?i)\\bip\\b|address|host|server"),
    "card": (rf"(?<![0-9{_INNER}])[0-9{_INNER}]{{14,37}}(?![0-9{_INNER}])", 0.8, "(?i)card|visa|credit|payment"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, "(?i)phone|tel|call|mobile|fax"),
    "iban": (rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", 0.9, "(?i)iban|account|bank"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "(?i)ssn|social|security"),
    "secret": (r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}(?![A-Za-z0-9_])", 0.3, "(?i)(?:token|key|secret|passw(?:or)?d)[\"'\\s]*[:=]\\s*[\"']?$"),
}
#: Cheap tests that every match of the kind passes.
_MAY_HAVE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "secret": r"(?i)token|key|secret|passw"}
_OCTETS = r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\z"


def _luhn(digits: Column) -> Column:
    def add(total: Column, place: Column) -> Column:
        d = F.substring(digits, -place, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(place % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(number: Column) -> Column:
    turned = F.concat(F.substring(number, F.lit(5), F.length(number)), F.substring(number, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), add) == 1


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return found.rlike(_OCTETS)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return _mod97(F.replace(found, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~found.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def _prepared(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.regexp_replace(F.translate(text, _INNER, _OTHER), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _INNER)
    if kind == "card":
        return F.regexp_replace(F.translate(text, _INNER, _OTHER), r"(?<=[0-9])[\x20-](?=[0-9])", _INNER)
    return text


_SPAN = "array<struct<start:int,end:int,kind:string,score:double>>"
_STATE = f"struct<at:int,context:string,out:{_SPAN}>"


def _spans(kind: str, text: Column, prepared: Column) -> Column:
    pattern, prior, words = _RULES[kind]
    matches = F.regexp_extract_all(prepared, F.lit(pattern), F.lit(0))
    both = F.zip_with(matches, F.split(prepared, pattern, -1), lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    both = F.filter(both, lambda x: x["m"].isNotNull())
    end_of = lambda t: F.right(t, F.lit(CONTEXT_CHARS))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end, before = begin + F.length(x["m"]), end_of(F.concat(state["context"], end_of(x["gap"])))
        score = F.lit(prior) + F.when(before.rlike(words), F.lit(1 - prior) / 2).otherwise(F.lit(0.0))
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        keep = _valid(kind, x["m"]) & (score >= KEEP_FROM)
        out = F.when(keep, F.concat(state["out"], F.array(span))).otherwise(state["out"]).cast(_SPAN)
        return F.struct(end.alias("at"), end_of(F.concat(before, x["m"])).alias("context"), out.alias("out"))

    def group(all_: Column, i: Column) -> Column:
        """The spans of one group of matches, as if the text began behind the match before it."""
        last = F.get(all_, i - 1)
        before = F.coalesce(end_of(F.concat(last["gap"], last["m"])), F.lit(""))
        begin = F.struct(F.lit(0).alias("at"), before.alias("context"), F.array().cast(_SPAN).alias("out")).cast(_STATE)
        return F.aggregate(F.slice(all_, i + 1, F.lit(MATCHES_AT_ONCE)), begin, add)

    def shifted(state: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["kind"].alias("kind"), s["score"].alias("score")))
        return F.struct((state["at"] + part["at"]).alias("at"), F.concat(state["groups"], F.array(moved)).cast(f"array<{_SPAN}>").alias("groups"))

    def whole(all_: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(MATCHES_AT_ONCE)), lambda i: group(all_, i))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("groups"))
        return F.aggregate(groups, begin, shifted, lambda state: F.flatten(state["groups"]))

    found = F.get(F.transform(F.array(both), whole), F.lit(0))  # a lambda's variable is computed once, however often it is read
    return F.when(text.rlike(_MAY_HAVE[kind]), found).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and one array of (start, end, kind, score) for each kind, named after it."""
    df = texts_of(docs)
    df = df.select("*", *(_prepared(k, F.col("text")).alias(f"{k}_text") for k in ("email", "card")))
    return df.select("doc_id", *(_spans(k, F.col("text"), F.col(f"{k}_text" if k in ("email", "card") else "text")).alias(k) for k in KINDS))


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans of the kinds, by start and then by the order of ``kinds``."""

    def ranked(rank: int, kind: str) -> Column:  # a lambda with a second parameter would get the element's index there
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*(ranked(i, k) for i, k in enumerate(kinds)))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def pii_report(docs: DataFrame) -> DataFrame:
    found = find_pii(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"), joined(KINDS).alias("spans"), sum(map(F.size, KINDS)).cast("long").alias("n_spans"))
