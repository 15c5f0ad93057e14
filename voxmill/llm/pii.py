"""Op 7, personal data and secrets. DataFrame functions only.

Regular expressions propose spans; checksums (Luhn, mod-97) and ranges confirm them; words near a span raise or lower
its score. Places are code points, ends exclusive.

The expressions are possessive and begin at the start of a run, so that long runs of one character class cost linear
time and no deep recursion; their leftmost matches are those of the plain forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.session import read_table

#: Characters before and after a span in which context words count; a neighbouring match of the same kind ends them.
CONTEXT = 40

#: The lengths of account numbers and the countries that have them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())
_LOCAL = r"A-Za-z0-9._%+-"
_SECRET = r"A-Za-z0-9_+/="
#: kind: expression; another one that every text with a match meets; words near by that raise and that lower its score; score
#: without them. Keys have a known form; secrets are long mixed strings, which only their context tells from other names.
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|e-mail|contact|write", "example|noreply|no-reply", 0.9),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", "ip|host|server|address|login", "version|release|section|chapter|v", 0.7),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", "card|visa|credit|payment|mastercard", "order|invoice|serial|isbn|tracking", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone|call|tel|mobile|fax", "order|invoice|serial|score", 0.8),
    "iban": (rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", "iban|account|bank|konto", "serial|order|sample", 0.7),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]", "ssn|social|security", "serial|order|model|part", 0.4),
    "key": (r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9])", "AKIA|gh[pousr]_|xox[abprs]-|eyJ", "key|token|secret|access", "example|sample|placeholder", 0.8),
    "secret": (rf"(?<![{_SECRET}-])[{_SECRET}-]{{20,}}+", rf"[{_SECRET}-]{{20}}", "token|secret|key|password|passwd|bearer|credential|api", "commit|sha|checksum|digest|revision|hash", 0.3),
}
#: The kinds whose spans hold whatever the score; the others need ``LEAST``.
BASE = ("email", "ip", "card", "phone")
LEAST, STEP = 0.5, 0.3


def _digits(x: Column) -> Column:
    """The digits of a string as integers, last first."""
    return F.transform(F.split(F.reverse(F.regexp_replace(x, "[^0-9]", "")), "", -1), lambda d: d.cast("int"))


def luhn(x: Column) -> Column:
    """Whether the digits of ``x`` pass the Luhn checksum."""
    twice = lambda d: F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
    weighed = F.transform(F.filter(_digits(x), lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether ``x``, country code and check digits moved to its end and letters counted from 10, leaves 1 modulo 97."""
    plain = F.regexp_replace(x, " ", "")
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c == "", a).otherwise((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.aggregate(F.split(moved, "", -1), F.lit(0), step) == 1


def _confirmed(kind: str, found: Column) -> Column:
    n = F.length(F.regexp_replace(found, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(found)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(found)
    if kind == "secret":  # neither a word nor a number
        return found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    return F.lit(True)


def _running(values: Column, join) -> Column:
    """Running sums, or whatever ``join`` makes, of an array: by doubling steps, so n values cost n log n."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda p: p < F.size(values))
    return F.aggregate(steps, values, lambda held, p: F.transform(held, lambda x, i: join(x, F.get(held, i - p))))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _located(text: Column, kind: str) -> Column:
    """Every confirmed match with its place and what is beside it: matches and the pieces between them give the places."""
    pattern, sign = KINDS[kind][:2]

    def places(matches: Column, gaps: Column) -> Column:
        lengths = F.transform(matches, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        ends = _running(lengths, lambda x, y: x + F.coalesce(y, F.lit(0)))
        row = lambda m, i, e: F.struct(m.alias("m"), (F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"))
        return _bound(ends, lambda e: F.filter(F.transform(matches, lambda m, i: row(m, i, e)), lambda x: _confirmed(kind, x["m"])))

    found = _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ms: _bound(F.split(text, pattern, -1), lambda gs: places(ms, gs)))
    return F.when(text.rlike(sign), found)


def _scored(kind: str, found: Column) -> Column:
    """``(kind, start, end, score)``: a context word near by adds or takes away ``STEP``."""
    raising, lowering, score = KINDS[kind][2:]

    def one(x: Column) -> Column:
        around = F.lower(F.concat(x["before"], F.lit("\n"), x["after"]))
        near = lambda words, by: F.when(around.rlike(rf"\b(?:{words})\b"), by).otherwise(0.0)
        value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(score) + near(raising, STEP) - near(lowering, STEP))), 1)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), value.alias("score"))

    rows = F.coalesce(F.transform(found, one), F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))
    return rows if kind in BASE else F.filter(rows, lambda s: s["score"] >= LEAST)


def add_spans(df: DataFrame, text_col: str = "text", to: str = "spans") -> DataFrame:
    """Adds ``spans``: array of (kind, start, end, score), by kind as in ``KINDS``, then start.

    Every whole text is read, in time about linear in its length and its matches; a null or empty one has no spans. Spans
    of different kinds may overlap; those of one kind don't. Other columns stay; one named like the new column is
    replaced. Repeated rows are treated alike; an empty table gives an empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = {kind: f"__pii_{kind}" for kind in KINDS}
    df = df.withColumns({names[kind]: _located(text, kind) for kind in KINDS})
    return df.withColumn(to, F.concat(*[_scored(kind, F.col(names[kind])) for kind in KINDS])).drop(*names.values())


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets.

    Pieces are taken from a form with four bytes a character, where any place is found at once.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def pieces(wide: Column, rows: Column, reach: Column) -> Column:
        part = lambda a, n: F.decode(F.substring(wide, 4 * a + 1, 4 * n), "UTF-32")
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        piece = lambda s, i: F.when(s["start"] >= before(i), F.concat(part(before(i), s["start"] - before(i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        last = before(F.size(reach))
        return F.concat(F.array_join(F.transform(rows, piece), ""), part(last, F.length(text) - last))

    reached = lambda rows: _running(F.transform(rows, lambda s: -s["less"]), lambda x, y: F.greatest(x, y))
    return _bound(F.encode(text, "UTF-32"), lambda wide: _bound(ordered, lambda rows: _bound(reached(rows), lambda reach: pieces(wide, rows, reach))))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every whole text of ``documents``, their counts and scores; null and empty texts have none, repeated rows stay."""
    found = add_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), scores.alias("scores"))
