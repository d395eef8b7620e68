"""Format-preserving pseudonyms for personal data, in SQL expressions only.

Found: e-mail addresses, hexadecimal secrets, IPv4 addresses, telephone numbers, social security numbers, payment card
numbers and dates. A candidate is replaced only if it is valid: octets up to 255, a card number whose check digit is
right, a social security number that can be issued, a date that exists. Anything else stays as it is.

A value is read as symbols, each with its own radix (digits 10, letters 26, hexadecimal digits 16, octets 256, a social
security number's parts 898 x 99 x 9999), and permuted by a keyed Feistel network: in each of ``ROUNDS`` rounds the
symbols of one half are shifted, each modulo its radix, by SHA-256 of the key, the kind and the other half. This is a
permutation of the values of a format, so different values stay different, and equal ones get equal pseudonyms in every
document, however they are punctuated or capitalised. A card number's check digit is made anew. A date from 1611-02-11
to 2328-11-11, written year first or day first, has its day number permuted within its 65,536-day window (1970-01-01 to
2149-06-06, and so on). A date that can only be read month first (1600 to 2399) is permuted among such dates, so that no
two written values get the same pseudonym; it isn't linked to the same day in another order. A secret of both cases is
permuted over 22 symbols; hexadecimal runs of digits alone or of letters alone stay.

The key is a row of its own that the plan reads as a scalar subquery: plans, event logs and the UI don't show it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lontar.llm.shared import free_name

ROUNDS = 8

#: What a match is, by the first of these that it matches as a whole.
_SHAPES = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}",
    "secret": r"[0-9a-fA-F]{32,128}",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": r"[0-9]{4}([\-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([\-/.])[0-9]{2}\2[0-9]{4}",
    "card": r"[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\3[0-9]{4}\3[0-9]{1,7}|[0-9]{4}([ \-])[0-9]{6}\4[0-9]{5}",
    "phone": r"\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{2,4}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}[.\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}",
}


def _alone(shape: str) -> str:
    """``shape`` with its back references counted from 1."""
    first = min((int(shape[i + 1]) for i in range(len(shape) - 1) if shape[i] == "\\" and shape[i + 1].isdigit()), default=1)
    for n in range(first, first + 9):
        shape = shape.replace(f"\\{n}", f"\\{n - first + 1}")
    return shape


ANY = (
    rf"(?<![A-Za-z0-9._%+\-]){_SHAPES['email']}(?![A-Za-z0-9\-])"
    rf"|(?<![A-Za-z0-9])(?:{_SHAPES['secret']})(?![A-Za-z0-9])"
    rf"|(?<![0-9.]){_SHAPES['ip']}(?!\.?[0-9])"
    rf"|(?<![0-9A-Za-z\-/.])(?:{_SHAPES['ssn']}|{_SHAPES['date']})(?![0-9A-Za-z]|[\-/.][0-9])"
    rf"|(?<![0-9A-Za-z+])(?:{_SHAPES['card']})(?![0-9A-Za-z])"
    rf"|(?<![0-9A-Za-z])(?:{_SHAPES['phone']})(?![0-9A-Za-z])"
)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(values: str, radices: str, kind: str, key: str) -> str:
    """SQL for the permuted array<bigint> ``values`` under ``radices``; these and ``key`` name columns or lambda variables."""

    def shifted(side: str, other: str, after: str) -> str:
        digest = f"sha2(concat_ws('|', {key}, '{kind}', n, i, array_join(transform(s.{other}, y -> cast(y as string)), ',')), 256)"
        shift = f"cast(conv(substring({digest}, 1, 13), 16, 10) as bigint)"
        return f"transform(s.{side}, (x, i) -> pmod(x + {shift}, {radices}[{after} + i]))"

    half = f"(size({values}) div 2)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', slice({values}, 1, {half}), 'r', slice({values}, {half} + 1, size({values}) - {half})),"
        f" (s, n) -> if(n % 2 = 1, named_struct('l', {shifted('l', 'r', '0')}, 'r', s.r), named_struct('l', s.l, 'r', {shifted('r', 'l', half)})), s -> concat(s.l, s.r))"
    )


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chars(s: str) -> str:
    return f"transform(sequence(1, length({s})), k -> substring({s}, k, 1))"


def _numbers(s: str) -> str:
    return f"transform({_chars(s)}, c -> cast(c as bigint))"


def _same(values: str, radix: int) -> str:
    return f"transform({values}, c -> {radix}L)"


def _refilled(shape: str, symbols: str, kind: str) -> str:
    """``shape`` with its characters of class ``kind`` replaced by ``symbols``, in order."""
    place = f"length(regexp_replace(substring({shape}, 1, k), '[^{kind}]', ''))"
    return f"array_join(transform(sequence(1, length({shape})), k -> if(substring({shape}, k, 1) rlike '[{kind}]', element_at({symbols}, {place}), substring({shape}, k, 1))), '')"


def _texts(values: str) -> str:
    return f"transform({values}, v -> cast(v as string))"


def _luhn(digits: str, doubled: int) -> str:
    """Sum of ``digits`` from the right, with each second one doubled, from the last (1) or the one before it (0)."""
    return f"aggregate(reverse({digits}), named_struct('t', 0L, 'k', {doubled}), (a, x) -> named_struct('t', a.t + if(a.k % 2 = 1, if(x > 4, 2 * x - 9, 2 * x), x), 'k', a.k + 1), a -> a.t)"


def _digits(m: str) -> str:
    return _numbers(f"regexp_replace({m}, '[^0-9]', '')")


def _email(key: str) -> str:
    head, tail = "regexp_extract(m, '^(.*)[.][^.]*$', 1)", "regexp_extract(m, '([.][^.]*)$', 1)"
    symbols = "regexp_replace(lower(h), '[^a-z0-9]', '')"
    values = f"transform({_chars('w')}, c -> if(c rlike '[0-9]', cast(c as bigint), cast(ascii(c) - 97 as bigint)))"
    radices = f"transform({_chars('w')}, c -> if(c rlike '[0-9]', 10L, 26L))"
    fresh = _let("vs", values, _let("rs", radices, f"transform({feistel('vs', 'rs', 'email', key)}, (v, k) -> if(rs[k] = 10L, cast(v as string), char(v + 97)))"))
    place = "length(regexp_replace(substring(h, 1, k), '[^A-Za-z0-9]', ''))"
    refilled = f"array_join(transform(sequence(1, length(h)), k -> case when substring(h, k, 1) rlike '[a-z0-9]' then element_at(f, {place}) when substring(h, k, 1) rlike '[A-Z]' then upper(element_at(f, {place})) else substring(h, k, 1) end), '')"
    return f"concat({_let('h', head, _let('w', symbols, _let('f', fresh, refilled)))}, {tail})"


def _secret(key: str) -> str:
    """Of one case over 16 symbols, of both over 22."""
    signs = "if(m rlike '[a-f]' and m rlike '[A-F]', '0123456789abcdefABCDEF', if(m rlike '[A-F]', '0123456789ABCDEF', '0123456789abcdef'))"
    values = f"transform({_chars('m')}, c -> cast(locate(c, a) - 1 as bigint))"
    radices = "transform(vs, c -> cast(length(a) as bigint))"
    fresh = _let("vs", values, _let("rs", radices, f"array_join(transform({feistel('vs', 'rs', 'secret', key)}, v -> substring(a, cast(v as int) + 1, 1)), '')"))
    return f"if(m rlike '[0-9]' and m rlike '[A-Fa-f]', {_let('a', signs, fresh)}, m)"


def _ip(key: str) -> str:
    values = "transform(split(m, '[.]'), c -> cast(c as bigint))"
    return _let("vs", values, _let("rs", _same("vs", 256), f"if(array_max(vs) > 255, m, array_join({_texts(feistel('vs', 'rs', 'ip', key))}, '.'))"))


def _ssn(key: str) -> str:
    parts = "transform(split(m, '-'), c -> cast(c as bigint))"
    values = "array(p[0] - if(p[0] > 666, 2, 1), p[1] - 1, p[2] - 1)"
    back = "concat_ws('-', lpad(cast(f[0] + if(f[0] >= 665, 2, 1) as string), 3, '0'), lpad(cast(f[1] + 1 as string), 2, '0'), lpad(cast(f[2] + 1 as string), 4, '0'))"
    fresh = _let("vs", values, _let("rs", "array(898L, 99L, 9999L)", _let("f", feistel("vs", "rs", "ssn", key), back)))
    return _let("p", parts, f"if(p[0] between 1 and 899 and p[0] <> 666 and p[1] > 0 and p[2] > 0, {fresh}, m)")


def _date(key: str) -> str:
    """Year first, or year last with the day first unless only the month can be."""
    iso = "m rlike '^[0-9]{4}'"
    iso_day = "try_to_date(regexp_replace(m, '[/.]', '-'), 'yyyy-MM-dd')"
    last_day = "try_to_date(regexp_replace(m, '[/.]', '-'), 'dd-MM-yyyy')"
    number = "datediff(d, date'1970-01-01')"
    values = f"array(cast(pmod({number}, 65536) div 256 as bigint), cast(pmod({number}, 256) as bigint))"
    fresh = f"date_add(date'1970-01-01', cast({number} - pmod({number}, 65536) + f[0] * 256 + f[1] as int))"
    written = f"if({iso}, concat_ws(substring(m, 5, 1), date_format(e, 'yyyy'), date_format(e, 'MM'), date_format(e, 'dd')), concat_ws(substring(m, 3, 1), date_format(e, 'dd'), date_format(e, 'MM'), date_format(e, 'yyyy')))"
    permuted = _let("vs", values, _let("rs", "array(256L, 256L)", _let("f", feistel("vs", "rs", "date", key), _let("e", fresh, written))))
    by_day = _let("d", f"if({iso}, {iso_day}, {last_day})", f"if(d is null or not {number} between -131072 and 131071, m, {permuted})")
    month_first = f"not {iso} and cast(substring(m, 1, 2) as int) <= 12 and cast(substring(m, 4, 2) as int) > 12"
    return f"if({month_first}, {_month_first(key)}, {by_day})"


def _month_first(key: str) -> str:
    """A month-first date with a day over 12. The 13th to 28th of any month are permuted with month and year; the 29 later
    days that each year has, with the year; a leap day among leap years, those of full centuries by themselves."""
    d = "try_to_date(regexp_replace(m, '[/.]', '-'), 'MM-dd-yyyy')"
    year = "cast(year(d) - 1600 as bigint)"
    # 29th and 30th of all months but February, 31st of seven: numbered in order of month and day.
    late = "array(" + ", ".join(f"{m * 100 + x}L" for m, n in zip(range(1, 13), (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31), strict=True) for x in range(29, n + 1)) + ")"
    parts = {
        "day(d) < 29": (f"array({year}, cast(month(d) - 1 as bigint), cast(day(d) - 13 as bigint))", "array(800L, 12L, 16L)", "f[0] + 1600", "(f[1] + 1) * 100 + f[2] + 13"),
        "month(d) <> 2": (f"array({year}, cast(array_position({late}, cast(month(d) * 100 + day(d) as bigint)) - 1 as bigint))", "array(800L, 29L)", "f[0] + 1600", f"{late}[f[1]]"),
        "year(d) % 400 <> 0": (f"array({year} div 100, cast(year(d) % 100 div 4 - 1 as bigint))", "array(8L, 24L)", "1600 + 100 * f[0] + 4 * (f[1] + 1)", "229"),
        "true": (f"array({year} div 400)", "array(2L)", "1600 + 400 * f[0]", "229"),
    }

    def made(k: int, values: str, radices: str, year: str, month_day: str) -> str:
        both = f"lpad(cast({month_day} as string), 4, '0')"
        written = _let("w", both, f"concat_ws(substring(m, 3, 1), substring(w, 1, 2), substring(w, 3, 2), lpad(cast({year} as string), 4, '0'))")
        return _let("vs", values, _let("rs", radices, _let("f", feistel("vs", "rs", f"month{k}", key), written)))

    cases = " ".join(f"when {test} then {made(k, *x)}" for k, (test, x) in enumerate(parts.items()))
    return _let("d", d, f"case when d is null or not year(d) between 1600 and 2399 then m {cases} end")


def _card(key: str) -> str:
    payload = "slice(ds, 1, size(ds) - 1)"
    check = f"pmod(-{_luhn('f', 1)}, 10)"
    fresh = _let("vs", payload, _let("rs", _same("vs", 10), _let("f", feistel("vs", "rs", "card", key), f"array_append(f, {check})")))
    return _let("ds", _digits("m"), f"if({_luhn('ds', 0)} % 10 = 0 and array_max(ds) > 0, {_let('g', _texts(fresh), _refilled('m', 'g', '0-9'))}, m)")


def _phone(key: str) -> str:
    """Digits behind a leading +1 are permuted, so is a number without one; other countries' as a whole."""
    own = "if(m like '+1%', slice(ds, 2, size(ds) - 1), ds)"
    fresh = _let("vs", own, _let("rs", _same("vs", 10), _texts(feistel("vs", "rs", "phone", key))))
    whole = f"if(m like '+1%', concat(array('1'), {fresh}), {fresh})"
    return _let("ds", _digits("m"), f"if(size(ds) between 8 and 15, {_let('g', whole, _refilled('m', 'g', '0-9'))}, m)")


_MADE = {"email": _email, "secret": _secret, "ip": _ip, "ssn": _ssn, "date": _date, "card": _card, "phone": _phone}


def pseudonym(key: str) -> str:
    """SQL for the pseudonym of the match ``m``, which is ``m`` itself if it isn't valid; ``key`` names a column."""
    cases = " ".join(f"when m rlike {_quoted(f'^(?:{_alone(_SHAPES[kind])})$')} then {make(key)}" for kind, make in _MADE.items())
    return f"case {cases} else m end"


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``count_col`` (long), if named, counts replaced values.

    A null text stays null (count 0), an empty one empty. Other columns stay, whatever their names. Rows don't depend on
    each other: null, repeated and tied ids are rows like any other, and an empty table gives an empty one.
    """
    private, secret = free_name(docs, "_private"), free_name(docs, "_key")
    text = f"`{text_col}`"
    found = f"regexp_extract_all({text}, {_quoted(ANY)}, 0)"
    paired = f"transform({found}, m -> named_struct('was', m, 'is', {pseudonym(f'`{secret}`')}))"
    some = F.col(f"`{text_col}`").rlike("[0-9@]")  # each kind holds a digit or, as an address may, only an @
    keyed = docs.withColumn(secret, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    out = keyed.withColumn(private, F.when(some, F.expr(paired))).drop(secret)
    merged = F.expr(f"array_join(transform(split({text}, {_quoted(ANY)}, -1), (p, i) -> concat(p, coalesce(get({private}, i).is, ''))), '')")
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.expr(f"size(filter({private}, x -> x.was <> x.is))"), F.lit(0)).cast("long"))
    changed: Column = F.size(private) > 0
    return out.withColumn(text_col, F.when(changed, merged).otherwise(F.col(f"`{text_col}`"))).drop(private)
