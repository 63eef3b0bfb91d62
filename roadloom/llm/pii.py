"""Format-preserving pseudonyms for personal data, in Spark SQL expressions only.

Values are found by one pattern in one pass, validated (Luhn sum, octets, calendar, number plan) and permuted
within their format by a keyed Feistel network, so that equal values get equal pseudonyms in every document and
different ones different pseudonyms. Each network permutes the valid values of its kind among themselves, so no
pseudonym meets a value that is left alone:
  cards     decimal halves of all but the check digit, ten rounds of modular addition; the check digit is made anew
  phones    likewise, all digits but those of the country code, in whatever way the number is written
  addresses two halves of 16 bits
  dates     the day within its 400 years: 146,097 = 189 x 773 days, a network over these two radices
  social security numbers  898 areas x (99 groups x 9,999 serials), likewise
Names before @ and secrets have no numeric format; they get a keyed digest, of 64 bits at least for names.
The round function is the SHA-256 of key, kind, round and half. Expressions run in the JVM, on matches only. The key is
the value of a one-row subquery, so that no plan, explained or logged, has it.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 10
#: The setting that holds the key.
KEY_SETTING = "spark.roadloom.pii.secret"
_drawn: dict[str, str] = {}

_PARTS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++",
    "secret": r"(?=[AaPpSsTt])(?i:token|secret|password|passwd|api_key|apikey|access_key)[ \t]*+[:=][ \t]*+[\"']?[A-Za-z0-9_/+=.-]{8,}+",
    "address": r"(?<![0-9.])(?:[0-9]{1,3}[.]){3}[0-9]{1,3}(?![0-9]|[.][0-9])",
    "date": r"(?<![0-9-])[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(?![0-9-])|(?<![0-9./])[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}(?![0-9])",
    "phone": r"[+][0-9]{1,3}[ -]?[(]?[0-9]{2,4}[)]?[ -]?[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9])|(?<![0-9])[(][0-9]{3}[)] ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# a whole run of groups of digits, up to a group that starts another value; two groups of 13 digits are two runs
_OTHER = "|".join([*(_PARTS[k] for k in ("email", "address", "date", "ssn")), r"(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])", r"(?<=[0-9]{13}[ -])[0-9]{13}"])
_PARTS["card"] = rf"(?<![0-9])[0-9](?:(?:[ -](?!{_OTHER}))?[0-9]){{12,}}+(?![0-9])"
PATTERN = "|".join(_PARTS.values())


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _round(key: str, kind: str, number: str, half: str, size: str = "0") -> str:
    """A keyed number below 2^52; key: SQL of the key."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', cast({size} as string), cast({number} as string), cast({half} as string)), 256), 1, 13), 16, 10) as bigint)"


def permuted_digits(digits: str, key: str, kind: str) -> str:
    """SQL: the string of 2 to 30 digits, permuted among the strings of its length."""
    n, power = f"length({digits})", lambda k: f"cast(pow(10, {k}) as bigint)"
    u, v = f"(length({digits}) div 2)", f"(length({digits}) - length({digits}) div 2)"
    step = f"pmod(s.a + {_round(key, kind, 'i', 's.b', n)}, if(i % 2 = 0, {power(u)}, {power(v)}))"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast(substr({digits}, 1, {u}) as bigint), 'b', cast(substr({digits}, {u} + 1) as bigint)), "
        f"(s, i) -> named_struct('a', s.b, 'b', {step}), s -> concat(lpad(cast(s.a as string), {u}, '0'), lpad(cast(s.b as string), {v}, '0')))"
    )


def luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits; a valid number's is divisible by 10."""
    d = f"cast(substr({digits}, length({digits}) - p, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, p) -> t + if(p % 2 = 0, {d}, {d} * 2 - if({d} > 4, 9, 0)))"


def _refill(value: str, digits: str) -> str:
    """SQL: `value` with its digits replaced one by one by those of `digits`."""
    c = f"substr({value}, p, 1)"
    return (
        f"aggregate(sequence(1, length({value})), named_struct('out', '', 'k', 0), (s, p) -> if({c} between '0' and '9', "
        f"named_struct('out', concat(s.out, substr({digits}, s.k + 1, 1)), 'k', s.k + 1), named_struct('out', concat(s.out, {c}), 'k', s.k)), s -> s.out)"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL: `body` with the column `name` standing for `value`, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"


#: How cards are written: their groups' numbers of digits.
_WRITTEN = "^(1[3-9]|4-4-4-4(-3)?|4-6-[45]|4-4-4-1)$"


def _card(key: str) -> str:
    """The whole run if it is a card; else, from left to right, those of its groups that make up one. Groups
    written as cards come before other ones, then longer stretches."""
    anew = _let(permuted_digits("substr(d, 1, length(d) - 1)", key, "card"), "q", f"concat(q, cast(pmod(10 - {luhn("concat(q, '0')")} % 10, 10) as string))")
    valid = f"length(d) between 13 and 19 and {luhn('d')} % 10 = 0"
    shape = "array_join(transform(slice(gs, ga, gk), y -> cast(length(regexp_replace(y, '[^0-9]', '')) as string)), '-')"
    card = _let("regexp_replace(array_join(slice(gs, ga, gk), ''), '[^0-9]', '')", "d", f"if({valid}, named_struct('written', {shape} rlike '{_WRITTEN}', 'k', gk), null)")
    best = f"transform(sequence(1, size(gs)), ga -> array_max(transform(sequence(1, least(19, size(gs) - ga + 1)), gk -> {card})))"
    later = "gb.k > 1 and not gb.written and exists(slice(bs, gi + 1, gb.k - 1), z -> coalesce(z.written, false))"
    put = _let("array_join(slice(gs, gi, gb.k), '')", "v", _let("regexp_replace(v, '[^0-9]', '')", "d", _let(anew, "w", _refill("v", "w"))))
    here = f"if(gb is null or ({later}), named_struct('next', gi + 1, 'out', concat(st.out, gs[gi - 1])), named_struct('next', gi + gb.k, 'out', concat(st.out, {put})))"
    parts = _let("regexp_extract_all(m, '[0-9]+[ -]?', 0)", "gs", _let(best, "bs", f"aggregate(sequence(1, size(gs)), named_struct('next', 1, 'out', ''), (st, gi) -> if(gi < st.next, st, {_let('bs[gi - 1]', 'gb', here)}), st -> st.out)"))
    return _let(_DIGITS, "d", f"if({valid}, {_let(anew, 'w', _refill('m', 'w'))}, if(m rlike '[ -]', {parts}, m))")


#: Country codes of one and two digits (fixed values of the public numbering plan); all others have three.
_CODES = "^([17]|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _phone(key: str) -> str:
    """All digits permuted but those of the country code, which is told by its digits, not by the way of writing."""
    code = f"if(m like '+%', coalesce(nullif(length(regexp_extract(d, '{_CODES}', 1)), 0), 3), 0)"
    anew = f"concat(substr(d, 1, c), {_let('substr(d, c + 1)', 'r', permuted_digits('r', key, 'phone'))})"
    return _let(_DIGITS, "d", _let(code, "c", _let(anew, "w", _refill("m", "w"))))


def _two_radices(key: str, kind: str, a: str, b: str, first: int, second: int, finish: str) -> str:
    """SQL: `finish` with s.a and s.b for the numbers a and b, permuted among first x second pairs."""
    step = (
        f"if(i % 2 = 0, named_struct('a', pmod(s.a + {_round(key, kind, 'i', 's.b')}, {first}), 'b', s.b), "
        f"named_struct('a', s.a, 'b', pmod(s.b + {_round(key, kind, 'i', 's.a')}, {second})))"
    )
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> {step}, s -> {finish})"


def _ssn(key: str) -> str:
    """Areas 001 to 899 without 666, groups and serials without zero; other numbers are left alone."""
    pad = lambda n, k: f"lpad(cast({n} as string), {k}, '0')"
    area = "if(s.a < 665, s.a + 1, s.a + 2)"
    finish = f"concat({pad(area, 3)}, '-', {pad('s.b div 9999 + 1', 2)}, '-', {pad('s.b % 9999 + 1', 4)})"
    body = _two_radices(key, "ssn", "if(n[0] < 666, n[0] - 1, n[0] - 2)", "(n[1] - 1) * 9999 + n[2] - 1", 898, 99 * 9999, finish)
    return _let("transform(split(m, '-'), x -> cast(x as int))", "n", f"if(n[0] in (0, 666) or n[0] > 899 or n[1] = 0 or n[2] = 0, m, {body})")


def _address(key: str) -> str:
    step = f"named_struct('a', s.b, 'b', (s.a ^ ({_round(key, 'address', 'i', 's.b')} & 65535)))"
    two = "concat(cast(shiftright({0}, 8) as string), '.', cast({0} & 255 as string))"
    body = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', o[0] * 256 + o[1], 'b', o[2] * 256 + o[3]), (s, i) -> {step}, s -> concat({two.format('s.a')}, '.', {two.format('s.b')}))"
    )
    return _let("transform(split(m, '[.]'), x -> cast(x as bigint))", "o", f"if(array_max(o) <= 255, {body}, m)")


def _date(key: str) -> str:
    """Year first, or day (else month) first with the year last; other dates are left alone."""
    leap = "((y % 4 = 0 and y % 100 <> 0) or y % 400 = 0)"
    valid = f"y >= 1 and mo between 1 and 12 and da between 1 and element_at(array(31, if({leap}, 29, 28), 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), greatest(1, least(12, mo)))"
    day = "datediff(make_date(y, mo, da), make_date(e, 1, 1))"
    moved = _two_radices(key, "date", f"{day} div 773", f"{day} % 773", 189, 773, "date_add(make_date(e, 1, 1), cast(s.a * 773 + s.b as int))")
    era = "if(y < 200, 1, 200 + 400 * ((y - 200) div 400))"  # 200, 600, ... 1800: 400 years each

    def using(year: str, month: str, dayno: str, shape: str, otherwise: str) -> str:
        fill = f"date_format(t, {shape})"
        body = f"if({valid} and y >= 200, {_let(era, 'e', _let(moved, 't', fill))}, {otherwise})"
        return _let(f"cast({year} as int)", "y", _let(f"cast({month} as int)", "mo", _let(f"cast({dayno} as int)", "da", body)))

    two = lambda k, c: f"if(length(ps[{k}]) = 1, '{c}', '{c}{c}')"
    sep = (_lit("substr(m, length(ps[0]) + 1, 1)"), _lit("substr(m, length(m) - length(ps[2]), 1)"))
    first = using("ps[0]", "ps[1]", "ps[2]", f"concat('yyyy', {sep[0]}, {two(1, 'M')}, {sep[1]}, {two(2, 'd')})", "m")
    month_first = using("ps[2]", "ps[0]", "ps[1]", f"concat({two(0, 'M')}, {sep[0]}, {two(1, 'd')}, {sep[1]}, 'yyyy')", "m")
    day_first = using("ps[2]", "ps[1]", "ps[0]", f"concat({two(0, 'd')}, {sep[0]}, {two(1, 'M')}, {sep[1]}, 'yyyy')", month_first)
    return _let("split(m, '[-/.]')", "ps", f"if(m rlike '^[0-9]{{4}}', {first}, {day_first})")


def _lit(c: str) -> str:
    return f"concat(\"'\", {c}, \"'\")"


def _keyed(key: str, kind: str, value: str) -> str:
    """SQL: a keyed lower-case hexadecimal digest as long as `value`, 8 to 64 digits."""
    return f"substr(sha2(concat_ws('|', {key}, '{kind}', {value}), 256), 1, least(64, greatest(8, length({value}))))"


def _value(key: str) -> str:
    """SQL: the pseudonym of the match m."""
    email = f"concat(substr(sha2(concat_ws('|', {key}, 'email', lower(m)), 256), 1, least(64, greatest(16, instr(m, '@') - 1))), substr(m, instr(m, '@')))"
    head = "regexp_extract(m, '^[A-Za-z_]+[ \\\\t]*[:=][ \\\\t]*[\"\\']?', 0)"
    secret = _let(head, "h", _let("substr(m, length(h) + 1)", "r", f"concat(h, {_keyed(key, 'secret', 'r')})"))
    return (
        f"case when m like '%@%' then {email} "
        f"when m rlike '^[A-Za-z]' then {secret} "
        f"when m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then {_address(key)} "
        f"when m rlike '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}[./][0-9]{{1,2}}[./][0-9]{{4}})$' then {_date(key)} "
        f"when m rlike '^[+(]|^[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}$' then {_phone(key)} "
        f"when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {_ssn(key)} "
        f"else {_card(key)} end"
    )


#: Stands around the matches in a marked text; texts that have it themselves are cut by the pattern twice.
_MARK = "\x01"


def parts(text: str) -> str:
    """SQL: the text cut into ordinary stretches, at even places, and matches at odd ones."""
    p = _quote(PATTERN)
    between = f"concat(transform(regexp_extract_all({text}, {p}, 0), m -> array(m)), array(cast(array() as array<string>)))"
    twice = f"flatten(zip_with(split({text}, {p}, -1), {between}, (x, y) -> concat(array(x), y)))"
    return f"if(contains({text}, '{_MARK}'), {twice}, split(regexp_replace({text}, {p}, '{_MARK}$0{_MARK}'), '{_MARK}', -1))"


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting; without one each application draws its own, and pseudonyms of
    different applications aren't linked."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """`docs` with the text's values replaced; all other columns and rows are as they were.

    count_col: the name of a new column for the number of values found, if wanted. Null texts stay null,
    empty ones empty. Invalid numbers, addresses and dates are left alone. Rows are independent, so
    repeated rows and ties have no special case; an empty table gives an empty one. Very long texts are cut and
    joined whole, in the memory of their row. Columns of `docs` may
    have any names, but for count_col.
    """
    if count_col and count_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column {count_col} already")
    cut, held = fresh(docs, "parts", "pii_key")
    secret = docs.sparkSession.createDataFrame([(key,)], "value string").scalar()
    out = docs.withColumn(held, secret).withColumn(cut, F.expr(parts(f"`{text_col}`")))
    out = out.withColumn(text_col, F.expr(f"array_join(transform(`{cut}`, (m, at) -> if(at % 2 = 1, {_value(f'`{held}`')}, m)), '')"))
    if count_col:
        out = out.withColumn(count_col, F.coalesce((F.size(cut) - 1) / 2, F.lit(0)).cast("long") * F.when(F.col(text_col).isNull(), 0).otherwise(1))
    return out.drop(cut, held)
