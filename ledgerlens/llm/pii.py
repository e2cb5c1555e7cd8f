"""Personal data: patterns propose spans, checksums confirm them, words before a span move its score.

Everything is a Column over one row: per kind, the matches of its pattern and the pieces between
them (their lengths give the positions), a validator per match, and a score out of a prior, the
validator and context words in the characters before the match.  Nothing is shuffled, so neither a
hot source nor copies matter, and cost follows the text.  Patterns use possessive loops where
a greedy one would give the same match, so long runs are scanned once and never recursed into.

Base kinds (email, ip, card, phone) are kept whenever they validate, whatever their score; the
further kinds (iban, ssn, local phone) only from ``THRESHOLD`` on.

Defined cases: null text counts as empty: no spans, hash of the empty string.  Equal texts give equal
rows.  Positions are code points, ends exclusive.  Extra columns are ignored by ``spans`` and kept by
``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, table

CONTEXT_CHARS = 40
THRESHOLD = 0.6
BLOCK = 128


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def doubled(total: Column, i: Column) -> Column:
        v = F.substr(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + v - F.when(v > 9, F.lit(9)).otherwise(F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), doubled) % 10 == 0


def mod97(iban: Column) -> Column:
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def rest(total: Column, i: Column) -> Column:
        code = F.ascii(F.substr(moved, i, F.lit(1)))
        return F.when(code >= 65, (total * 100 + code - 55) % 97).otherwise((total * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), rest) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]+", "")


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))


def _ip(match: Column) -> Column:
    # leading zeros do not count; four significant digits are above 255 anyway
    return F.forall(F.split(match, "\\."), lambda p: F.when(
        F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False)))
        .otherwise(F.lit(False)))


def _ssn(match: Column) -> Column:
    return ~(match.startswith("000") | match.startswith("666") | match.startswith("9")
             | match.contains("-00-") | match.endswith("-0000"))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a text without this string or pattern has no match
    valid: Callable[[Column], Column] | None
    prior: float
    if_valid: float
    context: str
    if_context: float
    base: bool


# Fixed by the contract: the base kinds and their order.  Starts inside a run that failed cannot
# match either, so a run is tried once: at its beginning, or where the last match ended (\G).
KINDS = (
    Kind("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "@", None,
         0.9, 0.0, "mail|contact|write", 0.1, True),
    Kind("ip", "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", ".", _ip,
         0.4, 0.3, "ip|host|server|address|login", 0.2, True),
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", "", _card, 0.2, 0.5, "card|visa|credit|karte|carte|tarjeta", 0.3, True),
    Kind("phone", "\\+[0-9][\\x20().0-9-]+[0-9]", "+", lambda m: F.length(_digits(m)).between(9, 15),
         0.4, 0.3, "tel|phone|call|fon|mobil", 0.3, True),
    Kind("iban", "[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?", "",
         lambda m: mod97(F.regexp_replace(m, "\\x20", "")), 0.2, 0.5, "iban|account|konto|compte|cuenta|bank", 0.2, False),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", _ssn, 0.2, 0.2, "ssn|social security|tax id", 0.4, False),
    Kind("local", "\\(?[0-9]{3}\\)?[\\x20-][0-9]{3}-[0-9]{4}", "-", None, 0.3, 0.0, "tel|phone|call|fon|mobil", 0.4, False),
)


IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """By the length that a country's IBANs have, so that a group after one is not taken in; other codes by the general form."""
    def groups(length: int) -> str:
        return f"[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{(length - 4) // 4}}}" + (f"\\x20?[A-Z0-9]{{{length % 4}}}" if length % 4 else "")

    fixed = "|".join(f"(?:{codes.replace(' ', '|')}){groups(length)}" for length, codes in IBAN_LENGTHS.items())
    return f"(?:{fixed}|[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{2,7}}(?:\\x20?[A-Z0-9]{{1,3}})?)"


# The kinds as redaction takes them.
WHOLE_KINDS = tuple(replace(k, pattern=_iban_pattern()) if k.name == "iban" else k for k in KINDS)


def running(steps: Column) -> Column:
    """Running sums of an array, in blocks so that a long array is not copied once per element."""
    def grown(acc: Column, v: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v))

    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, BLOCK), none, grown))
    offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: grown(acc, F.element_at(x, -1)))
    summed = F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda x, o: F.transform(x, lambda v: v + o)))
    return F.when(F.size(steps) == 0, none).otherwise(summed)


def _later(texts: Column, by: int) -> Column:
    """An array of texts moved back by some places, as long as before, empty texts in front."""
    return F.slice(F.concat(F.array_repeat(F.lit(""), by), texts), F.lit(1), F.size(texts))


def _found(text: Column, kind: Kind) -> Column:
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(text.contains(kind.gate), matches).otherwise(none) if kind.gate else matches


def with_candidates(df: DataFrame, text: str, kind: Kind, whole: bool = False) -> DataFrame:
    """Adds ``_<kind>``: array of (start, end, ok, score) in order of position.

    Context is looked for in the last characters before a match: since the match before it, as in the SQL, or with ``whole`` whatever they are.
    """
    k = f"_{kind.name}"
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{k}_m", _found(F.col(text), kind))
    df = df.withColumn(f"{k}_p", F.when(F.size(f"{k}_m") > 0, F.split(text, kind.pattern, -1)).otherwise(none))
    df = df.withColumn(f"{k}_e", running(F.zip_with(f"{k}_m", F.slice(f"{k}_p", F.lit(1), F.size(f"{k}_m")),
                                                    lambda m, p: F.length(m) + F.length(p))))

    pieces, before, reach = F.slice(f"{k}_p", F.lit(1), F.size(f"{k}_m")), f"{k}_b", 1
    if not whole:
        df = df.withColumn(before, F.transform(pieces, lambda p: F.right(p, F.lit(CONTEXT_CHARS))))
    else:  # each piece after the match before it, then twice as many of them a step, until they hold CONTEXT_CHARS
        df = df.withColumn(before, F.zip_with(_later(F.col(f"{k}_m"), 1), pieces, lambda m, p: F.right(F.concat(m, p), F.lit(CONTEXT_CHARS))))
    while whole and reach * 2 < CONTEXT_CHARS + 2:  # no match is shorter than two characters
        df = df.withColumn(f"{k}_b{reach}", F.zip_with(_later(F.col(before), reach), before, lambda x, y: F.right(F.concat(x, y), F.lit(CONTEXT_CHARS))))
        before, reach = f"{k}_b{reach}", 2 * reach

    def judged(m: Column, at: Column) -> Column:
        ok = kind.valid(m) if kind.valid else F.lit(True)
        score = (F.lit(kind.prior) + F.when(ok, F.lit(kind.if_valid)).otherwise(F.lit(0.0))
                 + F.when(at.before.rlike(f"(^|[^a-z])({kind.context})"), F.lit(kind.if_context)).otherwise(F.lit(0.0)))
        return F.struct((at.end - F.length(m)).alias("start"), at.end.alias("end"), ok.alias("ok"), F.least(F.round(score, 2), F.lit(1.0)).alias("score"))

    # Arrays enter as arguments, never inside a lambda: an expression that is pulled in there would run per match.
    around = F.zip_with(before, f"{k}_e", lambda b, e: F.struct(lower_ascii(b).alias("before"), e.alias("end")))
    return df.withColumn(k, F.zip_with(f"{k}_m", around, judged))


def _kept(kind: Kind) -> Column:
    return F.filter(f"_{kind.name}", lambda s: s.ok & (F.lit(kind.base) | (s.score >= THRESHOLD)))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """``key`` and ``spans``: array of (start, rank, end, kind, score) by start, then kind in the order of ``KINDS``.

    As the SQL of op3_pii has them, or with ``whole`` as ``redact`` takes them.
    """
    df = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kinds = WHOLE_KINDS if whole else KINDS
    for kind in kinds:
        df = with_candidates(df, "_text", kind, whole)

    def ranked(rank: int, kind: Kind) -> Column:
        return F.transform(_kept(kind), lambda s: F.struct(
            s.start.alias("start"), F.lit(rank).alias("rank"), s.end.alias("end"), F.lit(kind.name).alias("kind"), s.score.alias("score")))

    each = [ranked(r, kind) for r, kind in enumerate(kinds)]
    return df.select(F.col("_key").alias(key), F.sort_array(F.concat(*each)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of every kind replaced by ``[KIND]``; a null text stays null.

    Kind by kind, on what the kinds before have left, by putting pieces and replaced matches together.
    """
    df = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind in sorted(WHOLE_KINDS, key=lambda k: ("email", "iban", "card", "phone", "ip", "ssn", "local").index(k.name)):
        k = f"_{kind.name}"
        df = with_candidates(df, "_text", kind, True)
        shown = F.zip_with(f"{k}_m", k, lambda m, s: F.when(
            s.ok & (F.lit(kind.base) | (s.score >= THRESHOLD)), F.lit(f"[{kind.name.upper()}]")).otherwise(m))
        whole = F.array_join(F.zip_with(f"{k}_p", shown, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        df = df.withColumn("_text", F.when(F.exists(_kept(kind), lambda s: F.lit(True)), whole).otherwise(F.col("_text")))
    row = F.col("_row")
    return df.select(*[F.when(row[c].isNotNull(), F.col("_text")).alias(c) if c == text else row[c].alias(c) for c in docs.columns])


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _counted(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    found = spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_counted(n).alias(f"n_{n}") for n in base],
        F.sha2(joined(F.filter("spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_spans(rank: int, kind: str, pattern: str, test: str) -> str:
    return f"""
SELECT id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
  SELECT id, m, before, sum(length(before) + length(m)) OVER (PARTITION BY id ORDER BY i) - length(m) AS s FROM (
    SELECT id, unnest(found) AS m, unnest(pieces[1:len(found)]) AS before, unnest(range(len(found))) AS i FROM (
      SELECT id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS pieces FROM docs)))
WHERE {test}"""


_CTX = "regexp_matches(translate(right(before, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z])(%s)')"
_D = "regexp_replace(m, '[^0-9]+', '', 'g')"
ORACLE = "WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents), found AS (" + " UNION ALL ".join((
    _sql_spans(0, "email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    _sql_spans(1, "ip", "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+",
               "len(list_filter(string_split(m, '.'), lambda p: try_cast(p AS HUGEINT) IS NULL OR try_cast(p AS HUGEINT) > 255)) = 0"),
    _sql_spans(2, "card", "[0-9](?:[ -]?[0-9])+",
               f"length({_D}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_D}) + 1), lambda i: "
               f"CASE WHEN i % 2 = 1 THEN substr(reverse({_D}), i, 1)::INT "
               f"ELSE (substr(reverse({_D}), i, 1)::INT * 2) // 10 + (substr(reverse({_D}), i, 1)::INT * 2) % 10 END)) % 10 = 0"),
    _sql_spans(3, "phone", "\\+[0-9][ ().0-9-]+[0-9]", f"length({_D}) BETWEEN 9 AND 15"),
    _sql_spans(4, "iban", "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
               "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), "
               "lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END::HUGEINT)), "
               "lambda a, v: CASE WHEN v >= 10 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"),
    _sql_spans(5, "ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
               "NOT (starts_with(m, '000') OR starts_with(m, '666') OR starts_with(m, '9') OR contains(m, '-00-') OR ends_with(m, '-0000')) AND "
               + _CTX % "ssn|social security|tax id"),
    _sql_spans(6, "local", "\\(?[0-9]{3}\\)?[ -][0-9]{3}-[0-9]{4}", _CTX % "tel|phone|call|fon|mobil"),
)) + """),
per AS (SELECT id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
               count(*) FILTER (kind = 'phone') AS n_phone,
               string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
               string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
        FROM found GROUP BY id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (id)
"""
