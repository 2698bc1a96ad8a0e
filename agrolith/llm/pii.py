"""Personal data in texts, found with SQL expressions alone.

Regular expressions propose spans of six kinds; validators confirm them (parts of an address at most 255, Luhn for
cards, digit counts for phones, mod-97 for account numbers); words before a span raise its score or lower it. A match that
fails its validator is dropped and not tried again. Positions are code points, the end exclusive.

The score decides: spans of the kinds beyond the first four are kept from ``KEEP_SCORE`` on, so a long hexadecimal number is a
secret where a word before it says so; and only spans from ``REDACT_SCORE`` on are redacted, so ``version 1.2.3.4`` stays in a
text, though its span is found.

Time grows with the text's length: a pattern's repetitions never give back, and it begins where a run of its characters
begins or the last match ended, never inside a run. Patterns with repeated groups are matched on a copy of the text of the same
length, in which separators that cannot belong to a match are replaced, so no text is too long for the regular expression
engine's stack. Running positions come from two levels of sums, so many matches in a text are no matter either.

Defined results: a null or empty text has no spans; repeated rows keep a row each; spans of different kinds may
overlap, spans of one kind do not; an empty table gives no rows. A column named ``spans`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import fresh

#: Kinds in the order that breaks ties; the first four are kept whatever their score.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE_KINDS = 4
#: Score of a confirmed span, before context.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "secret": 0.3}
#: Words that raise the score when they stand in the 40 code points before a span (since the last match of its pattern).
CONTEXT = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank", "secret": "token|secret|key|password|passwd|auth"}
CONTEXT_WIDTH = 40
CONTEXT_GAIN = {"email": 0.1, "ip": 0.1, "card": 0.1, "phone": 0.1, "iban": 0.05, "secret": 0.5}
#: Words that lower the score when they stand right before a span.
AGAINST = {"ip": "version|release|build|section", "card": "isbn|serial|order|tracking", "phone": "isbn|serial|order|tracking"}
AGAINST_LOSS = 0.35
KEEP_SCORE, REDACT_SCORE = 0.5, 0.5

_EMAIL_DOTS = r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])"
#: Stands for a dot that is not between two characters of a domain; where a text has it, another takes its place.
_DOT, _OTHER = "\ue000", "\ue001"
_LOCAL = f"[A-Za-z0-9._%+{_DOT}-]"
_EMAIL = f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\\.[A-Za-z0-9.-]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
_OCTET = "0*+(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2}|)"
_CARD_GAPS = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
#: Runs too short for twelve digits are left out at once.
_CARD = r"(?<![0-9\x20-])[0-9\x20-]{12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}\x20[A-Z0-9]{4}\x20[A-Z0-9]{4}(\x20[A-Z0-9]{4})?(\x20[A-Z0-9]{4})?(\x20[A-Z0-9]{4})?(\x20[A-Z0-9]{4})?(\x20[A-Z0-9]{4})?(\x20[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SECRET = r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's checksum."""

    def worth(i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind in ("email", "secret"):
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(False)
    digits = _digits(match)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


@dataclass(frozen=True)
class _Scan:
    """A fold over an array column: ``out(item, before, base, local)`` of all items, where ``before`` joins what the items before it own, from 0 on."""

    items: str
    own: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    out: Callable[[Column, Column, Column, Column], Column]
    kind: str
    #: A text column, of which an item gets the part between ``base`` and what its run owns.
    text: str | None = None


def _scanned(df: DataFrame, scans: dict[str, _Scan]) -> DataFrame:
    """All columns of the input and one for each scan.

    Items are cut into about as many runs as a run has items; each run is folded from ``base``, what the runs before it own. So
    the arrays that a fold builds stay short, and ``local`` spares items from seeking in a whole text. Steps are separate
    projections: what is used more than once is then computed once for each row.
    """
    kept, no = df.columns, range(len(scans))
    runs, totals, cells = ([fresh(df, f"_{x}{i}")[0] for i in no] for x in ("runs", "totals", "cells"))
    each = list(scans.values())
    fold = lambda s, run, at: F.aggregate(run, at, lambda a, x: s.join(a, s.own(x)))

    def cut(s: _Scan) -> Column:
        items = F.col(s.items)
        width = F.ceil(F.sqrt(F.size(items))).cast("int")
        return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(1), F.size(items), width), lambda i: F.slice(items, i, width)))

    def cell(s: _Scan, run: Column, at: Column) -> Column:
        local = F.lit("") if s.text is None else F.substring(F.col(s.text), at + 1, fold(s, run, at) - at)
        return F.struct(run.alias("run"), at.alias("base"), local.alias("local"))

    def laid(s: _Scan, r: Column) -> Column:
        start = F.struct(r["base"].alias("at"), F.array().cast(f"array<{s.kind}>").alias("out"))
        lay = lambda acc, x: F.struct(s.join(acc["at"], s.own(x)).alias("at"), F.concat(acc["out"], F.array(s.out(x, acc["at"], r["base"], r["local"]))).alias("out"))
        return F.aggregate(r["run"], start, lay)["out"]

    df = df.select(*kept, *[cut(s).alias(runs[i]) for i, s in enumerate(each)])

    def total(i: int) -> Column:
        return F.transform(runs[i], lambda run: fold(each[i], run, F.lit(0))).alias(totals[i])

    def based(i: int) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(totals[i]) - 1), lambda n: F.aggregate(F.slice(totals[i], F.lit(1), n), F.lit(0), each[i].join))
        return F.zip_with(runs[i], before, lambda run, at: cell(each[i], run, at)).alias(cells[i])

    def done(i: int) -> Column:
        return F.coalesce(F.flatten(F.transform(cells[i], lambda r: laid(each[i], r))), F.array().cast(f"array<{each[i].kind}>"))

    df = df.select(*kept, *runs, *map(total, no)).select(*kept, *map(based, no))
    return df.select(*[c for c in kept if c not in scans], *[done(i).alias(name) for i, name in enumerate(scans)])


_PLACED = "struct<start:int,before:string,match:string>"


def _pairs(searched: Column, pattern: str, gate: Column) -> Column:
    """What a pattern splits off and what it matches, in turn: laid end to end they give the positions."""
    gaps, matches = F.split(searched, pattern, -1), F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda x: x["match"].isNotNull())
    return F.when(gate, pairs).otherwise(F.array().cast("array<struct<gap:string,match:string>>"))


def _placed(x: Column, at: Column, *_: Column) -> Column:
    return F.struct((at + F.length(x["gap"])).alias("start"), F.right(x["gap"], F.lit(CONTEXT_WIDTH)).alias("before"), x["match"].alias("match"))


def _spans(kind: str, placed: Column) -> Column:
    def span(x: Column) -> Column:
        before = F.lower(x["before"])
        score = BASE_SCORE[kind] + F.when(before.rlike(rf"(^|[^a-z])({CONTEXT[kind]})"), CONTEXT_GAIN[kind]).otherwise(0.0)
        if kind in AGAINST:
            score = score - F.when(before.rlike(rf"(^|[^a-z])({AGAINST[kind]})[^a-z0-9]{{0,3}}$"), AGAINST_LOSS).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    spans = F.transform(F.filter(placed, lambda x: _valid(kind, x["match"])), span)
    return spans if KINDS.index(kind) < BASE_KINDS else F.filter(spans, lambda x: x["score"] >= KEEP_SCORE)


def find(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of the input, and ``spans``: an array of (start, kind_no, kind, end, score), by start and then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.regexp_replace(F.translate(text, _DOT, _OTHER), _EMAIL_DOTS, _DOT)
    pairs = {
        "email": _pairs(marked, _EMAIL, text.contains("@")),
        "ip": _pairs(text, _IP, text.rlike(r"[0-9]\.[0-9]")),
        "card": _pairs(F.regexp_replace(text, _CARD_GAPS, "_"), _CARD, text.rlike(r"[0-9][0-9\x20-]{10}")),
        "phone": _pairs(text, _PHONE, text.contains("+")),
        "iban": _pairs(text, _IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}")),
        "secret": _pairs(text, _SECRET, text.rlike("[A-Fa-f0-9]{32}")),
    }
    kept = [c for c in df.columns if c != "spans"]
    names = dict(zip(KINDS, fresh(df, *[f"_{k}" for k in KINDS]), strict=True))
    found = df.select(*kept, *[pairs[k].alias(names[k]) for k in KINDS])
    found = _scanned(found, {names[k]: _Scan(names[k], lambda x: F.length(x["gap"]) + F.length(x["match"]), lambda a, b: a + b, _placed, _PLACED) for k in KINDS})
    return found.select(*kept, F.sort_array(F.concat(*[_spans(k, F.col(names[k])) for k in KINDS])).alias("spans"))


def described(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, name: str, text_col: str = "text", spans_col: str = "spans", least_score: float = REDACT_SCORE) -> DataFrame:
    """The input with column ``name``: the text with every span of the score or more replaced by its kind in angle brackets.

    Overlapping spans become one, named for the first. A null text stays null.
    """
    few, pieces = fresh(df, "_few", "_pieces")

    def piece(s: Column, at: Column, base: Column, local: Column) -> Column:
        own = F.concat(F.substring(local, at - base + 1, s["start"] - at), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] >= at, own).otherwise("")

    found = df.withColumn(few, F.filter(spans_col, lambda s: s["score"] >= least_score))
    found = _scanned(found, {pieces: _Scan(few, lambda s: s["end"], lambda a, b: F.greatest(a, b), piece, "string", text_col)})
    last, text = F.array_max(F.transform(few, lambda s: s["end"])), F.col(text_col)
    clean = F.when(text.isNull() | (F.size(few) == 0), text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text))))
    return found.withColumn(name, clean).drop(few, pieces)
