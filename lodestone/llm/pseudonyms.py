"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Each value found is checked (card numbers by Luhn, account numbers by modulo 97,
dates by the calendar, addresses and social numbers by their ranges) and goes
through a keyed Feistel network. Numbers become pairs in a finite domain whose
two sides are added to modulo their own sizes; mail names and account numbers
are halved, and letters are added to modulo 26, digits modulo 10, where they
stand. Both permute the values of a format: equal values have equal pseudonyms
in every document, different values have different ones, the result is valid in
the same format, and who has the key can invert it.

A text is split once at mail addresses, and what is between at every place where
another value may begin. Each such place is tried with every shape, longest
first, until one holds; what holds for none is left alone, and the next place in
it is tried. No document's row meets another, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Countries by the length of their account numbers, so that a word behind a number is not taken for its last group.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_GROUP = " ?[A-Z0-9]"
_END = "(?![A-Za-z0-9])"
_ACCOUNTS = "|".join(f"(?:{c})[0-9]{{2}}(?:{_GROUP}{{4}}){{{(n - 4) // 4}}}" + (f"{_GROUP}{{{n % 4}}}" if n % 4 else "") + _END for n, c in LENGTHS.items())
_KNOWN = "|".join(LENGTHS.values())
#: A mail address: a name of up to 64 characters and a domain.
MAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"
#: Where any other value may begin.
START = "(?<![0-9A-Za-z])(?=[+(]?[0-9]|[A-Z]{2}[0-9]{2})"
#: What may stand there: kind, shape, and characters that may not be before it.
SHAPES = [
    ("iban", f"(?:{_ACCOUNTS})", ""),
    ("iban", f"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:{_GROUP}{{4}}){{2,7}}(?:{_GROUP}{{1,3}})?{_END}", ""),
    ("ip", f"{_OCTET}(?:\\.{_OCTET}){{3}}(?![0-9A-Za-z]|\\.[0-9])", "."),
    ("date", "(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9]))", ""),
    ("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
    ("phone", f"(?:\\+1[ .-]?)?(?:\\([0-9]{{3}}\\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[.-][0-9]{{4}}{_END}", ""),
    ("card", f"[0-9]{{13,19}}{_END}", ""),
    *(("card", f"[0-9]{{4}}([ -])[0-9]{{4}}(?:\\1[0-9]{{4}}){{{n}}}{tail}{_END}", "") for n, tail in ((2, "\\1[0-9]{1,3}"), (2, ""), (1, "\\1[0-9]{1,3}"))),
    ("card", f"[0-9]{{4}}([ -])[0-9]{{6}}\\1[0-9]{{5}}{_END}", ""),
]
KINDS = ["email", "iban", "ip", "date", "ssn", "phone", "card"]
#: Places a value may reach over, and its characters at most.
REACH, LONGEST = 10, 64
#: Places of a text whose overlaps are settled at a time.
BLOCK = 64
#: Days of 400 Gregorian years from here on are 189 times 773.
ERA, WEEKS, DAYS = "DATE'1700-01-01'", 189, 773


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(x: str) -> str:
    """The sum whose remainder modulo 10 is 0 for a valid number of digits ``x``."""
    return f"aggregate(sequence(1, length({x})), 0L, (s, i) -> s + CASE WHEN i % 2 = 0 THEN bigint(2 * int(substr({x}, length({x}) - i + 1, 1))) % 10 + (2 * int(substr({x}, length({x}) - i + 1, 1))) div 10 ELSE bigint(substr({x}, length({x}) - i + 1, 1)) END)"


def _mod97(x: str) -> str:
    """The remainder of a country-last account number, letters as 10 to 35."""
    return f"aggregate(split({x}, ''), 0, (s, c) -> CASE WHEN c = '' THEN s WHEN c BETWEEN '0' AND '9' THEN (s * 10 + int(c)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END)"


def _date(m: str) -> str:
    """The date of a value, null if the calendar has none in the 400 years."""
    d = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN try_cast(concat(substr({m}, 1, 4), '-', substr({m}, 6, 2), '-', substr({m}, 9, 2)) AS DATE) WHEN substr({m}, 3, 1) = '.' THEN try_cast(concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) AS DATE) ELSE try_cast(concat(substr({m}, 7, 4), '-', substr({m}, 1, 2), '-', substr({m}, 4, 2)) AS DATE) END"
    return f"(CASE WHEN ({d}) BETWEEN {ERA} AND DATE'2099-12-31' THEN ({d}) END)"


def _at(r: str, before: str) -> str:
    """The first valid value (m, kind) that the text ``r`` begins with, or null."""
    account = "replace(m, ' ', '')"
    valid = {
        "iban": f"length({account}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substr({account}, 5), substr({account}, 1, 4))')} = 1",
        "ip": "true",
        "date": f"{_date('m')} IS NOT NULL",
        "ssn": "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) != '9' AND substr(m, 5, 2) != '00' AND substr(m, 8, 4) != '0000'",
        "phone": "true",
        "card": f"length({_digits('m')}) BETWEEN 13 AND 19 AND {_luhn(_digits('m'))} % 10 = 0",
    }
    tries = []
    for kind, shape, never in SHAPES:
        found = f"element_at(transform(array(regexp_extract({r}, r'^(?:{shape})', 0)), m -> CASE WHEN m != '' AND {valid[kind]} THEN named_struct('m', m, 'kind', '{kind}') END), 1)"
        tries.append(f"CASE WHEN {before} != '{never}' THEN {found} END" if never else found)
    return f"CASE WHEN {r} RLIKE '^(?:[+(]?[0-9]|[A-Z]{{2}}[0-9]{{2}})' THEN coalesce({', '.join(tries)}) END"


def _found(ps: str) -> str:
    """Of the pieces ``ps`` of a text, which valid value begins at each."""
    near = f"left(array_join(transform(slice({ps}, k + 1, {REACH}), y -> left(y, {LONGEST})), ''), {LONGEST})"
    before = f"CASE WHEN k > 0 THEN right({ps}[k - 1], 1) ELSE '' END"
    at = _at("w.r", "w.b")
    return f"transform(sequence(0, size({ps}) - 1), k -> element_at(transform(array(named_struct('r', {near}, 'b', {before})), w -> {at}), 1))"


def _covered(ps: str, fs: str) -> str:
    """How many characters at the head of each piece belong to a value that began earlier; values are taken from the left.

    A fold in two levels, blocks and pieces of a block, as a list that grows is copied at every step.
    """
    sizes = f"zip_with({ps}, {fs}, (y, f) -> named_struct('n', length(y), 'v', coalesce(length(f.m), 0)))"
    step = "named_struct('left', greatest(0, (CASE WHEN s.left > 0 THEN s.left ELSE y.v END) - y.n), 'out', concat(s.out, array(s.left)))"
    inner = f"aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}), named_struct('left', S.left, 'out', cast(array() AS array<int>)), (s, y) -> {step})"
    outer = f"aggregate(sequence(0, (size(z) - 1) div {BLOCK}), named_struct('left', 0, 'out', cast(array() AS array<array<int>>)), (S, b) -> element_at(transform(array({inner}), o -> named_struct('left', o.left, 'out', concat(S.out, array(o.out)))), 1), S -> flatten(S.out))"
    return f"element_at(transform(array({sizes}), z -> {outer}), 1)"


def _body(x: str) -> str:
    """The characters of a value that are permuted, by kind."""
    m = f"{x}.m"
    return f"""CASE {x}.kind WHEN 'card' THEN substr({_digits(m)}, 1, length({_digits(m)}) - 1)
        WHEN 'phone' THEN right({_digits(m)}, 10)
        WHEN 'iban' THEN replace(substr({m}, 5), ' ', '')
        WHEN 'email' THEN regexp_replace(substring_index({m}, '@', 1), '[^A-Za-z0-9]', '') ELSE '' END"""


def _sides(x: str) -> str:
    """A value as numbers a below p and b below q."""
    m, base = f"{x}.m", "10"
    octet = [f"int(split({m}, '[.]')[{k}])" for k in range(4)]
    area = f"int(substr({m}, 1, 3))"
    days = f"datediff({_date(m)}, {ERA})"
    cut = f"(length({x}.body) div 2)"

    def number(part: str) -> str:
        return f"coalesce(bigint(conv(nullif({part}, ''), {base}, 10)), 0L)"

    def named(a: str, b: str, p: str, q: str) -> str:
        return f"named_struct('m', {m}, 'kind', {x}.kind, 'body', {x}.body, 'a', bigint({a}), 'b', bigint({b}), 'p', bigint({p}), 'q', bigint({q}))"

    return f"""CASE WHEN {x}.kind IN ('email', 'iban') THEN {named('0', '0', '1', '1')} ELSE CASE {x}.kind
        WHEN 'ip' THEN {named(f'{octet[0]} * 256 + {octet[1]}', f'{octet[2]} * 256 + {octet[3]}', '65536', '65536')}
        WHEN 'date' THEN {named(f'{days} div {DAYS}', f'{days} % {DAYS}', str(WEEKS), str(DAYS))}
        WHEN 'ssn' THEN {named(f'({area} - CASE WHEN {area} > 666 THEN 2 ELSE 1 END) * 99 + int(substr({m}, 5, 2)) - 1', f'int(substr({m}, 8, 4)) - 1', str(898 * 99), '9999')}
        ELSE {named(number(f'left({x}.body, {cut})'), number(f'substr({x}.body, {cut} + 1)'), f'power({base}, {cut})', f'power({base}, length({x}.body) - {cut})')} END END"""


def _feistel(x: str, inverse: bool) -> str:
    """Rounds that add a keyed hash of one side to the other, or take it off again in reverse."""
    def keyed(side: str) -> str:
        return f"bigint(conv(substr(sha2(concat_ws('|', s.key, i, {x}.kind, length({x}.body), {side}), 256), 1, 15), 16, 10))"

    sign = "-" if inverse else "+"
    rounds = f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"
    step = f"CASE WHEN i % 2 = 0 THEN named_struct('key', s.key, 'a', pmod(s.a {sign} {keyed('s.b')} % {x}.p, {x}.p), 'b', s.b) ELSE named_struct('key', s.key, 'a', s.a, 'b', pmod(s.b {sign} {keyed('s.a')} % {x}.q, {x}.q)) END"
    numbers = f"aggregate({rounds}, named_struct('key', `_key`, 'a', {x}.a, 'b', {x}.b), (s, i) -> {step})"

    def moved(side: str, other: str) -> str:
        k = f"bigint(conv(substr(sha2(concat_ws('|', s.key, i, {x}.kind, length({x}.body), j, lower({other})), 256), 1, 15), 16, 10))"
        c = f"substr({side}, j, 1)"
        return f"CASE WHEN {side} = '' THEN '' ELSE array_join(transform(sequence(1, length({side})), j -> CASE WHEN {c} BETWEEN '0' AND '9' THEN string(pmod(ascii({c}) - 48 {sign} {k}, 10L)) WHEN {c} BETWEEN 'a' AND 'z' THEN chr(97 + pmod(ascii({c}) - 97 {sign} {k}, 26L)) ELSE chr(65 + pmod(ascii({c}) - 65 {sign} {k}, 26L)) END), '') END"

    half = f"(length({x}.body) div 2)"
    step = f"CASE WHEN i % 2 = 0 THEN named_struct('key', s.key, 'a', {moved('s.a', 's.b')}, 'b', s.b) ELSE named_struct('key', s.key, 'a', s.a, 'b', {moved('s.b', 's.a')}) END"
    signs = f"aggregate({rounds}, named_struct('key', `_key`, 'a', left({x}.body, {half}), 'b', substr({x}.body, {half} + 1)), (s, i) -> {step}, s -> concat(s.a, s.b))"
    return f"CASE WHEN {x}.kind IS NOT NULL THEN named_struct('m', {x}.m, 'kind', {x}.kind, 'body', {x}.body, 'r', {numbers}, 'w', CASE WHEN {x}.kind IN ('email', 'iban') THEN {signs} END) END"


def _masked(m: str, new: str, sign: str, skip: str) -> str:
    """``m`` with its characters of class ``sign`` replaced by those of ``new``, but for the first ``skip``."""
    nth = f"length(regexp_replace(substr({m}, 1, i), '[^{sign}]', '')) - ({skip})"
    return f"concat_ws('', transform(sequence(1, length({m})), i -> CASE WHEN substr({m}, i, 1) RLIKE '[{sign}]' AND {nth} > 0 THEN substr({new}, {nth}, 1) ELSE substr({m}, i, 1) END))"


def _written(x: str) -> str:
    """A permuted value in the format of the old one."""
    m, a, b = f"{x}.m", f"{x}.r.a", f"{x}.r.b"
    cut = f"(length({x}.body) div 2)"

    text = f"concat(CASE WHEN {cut} > 0 THEN lpad(string({a}), {cut}, '0') ELSE '' END, lpad(string({b}), length({x}.body) - {cut}, '0'))"

    check = f"string((10 - {_luhn(f'concat({text}, chr(48))')} % 10) % 10)"
    day = f"date_add({ERA}, int({a} * {DAYS} + {b}))"
    shape = f"CASE WHEN {m} RLIKE '^[0-9]{{4}}-' THEN 'yyyy-MM-dd' WHEN {m} RLIKE '^[0-9]{{4}}/' THEN 'yyyy/MM/dd' WHEN substr({m}, 3, 1) = '.' THEN 'dd.MM.yyyy' ELSE 'MM/dd/yyyy' END"
    area = f"({a} div 99)"
    local, rest = f"substring_index({m}, '@', 1)", f"substr({m}, instr({m}, '@'))"
    account = _masked(m, f"{x}.w", "A-Za-z0-9", "4")
    plain = f"replace({account}, ' ', '')"
    proof = f"lpad(98 - {_mod97(f'concat(substr({plain}, 5), substr({plain}, 1, 2), chr(48), chr(48))')}, 2, '0')"
    return f"""CASE {x}.kind
        WHEN 'card' THEN {_masked(m, f'concat({text}, {check})', '0-9', '0')}
        WHEN 'phone' THEN {_masked(m, text, '0-9', f'length({_digits(m)}) - 10')}
        WHEN 'iban' THEN concat(substr({m}, 1, 2), {proof}, substr({account}, 5))
        WHEN 'email' THEN concat({_masked(local, f'{x}.w', 'A-Za-z0-9', '0')}, {rest})
        WHEN 'ip' THEN concat_ws('.', {a} div 256, {a} % 256, {b} div 256, {b} % 256)
        WHEN 'date' THEN date_format({day}, {shape})
        WHEN 'ssn' THEN concat_ws('-', lpad({area} + CASE WHEN {area} >= 665 THEN 2 ELSE 1 END, 3, '0'), lpad({a} % 99 + 1, 2, '0'), lpad({b} + 1, 4, '0'))
        ELSE {m} END"""


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_values, values (kind, value, pseudonym), text with pseudonyms.

    Who has ``key`` can undo the result: with ``inverse`` and the same key,
    pseudonyms become the values again. Null text stays null with no values;
    empty and very long texts, repeated rows and null ids are like any other; of
    values that overlap the leftmost counts; an empty table gives an empty
    result; other columns are ignored.
    """
    if not key:
        raise ValueError("a key is needed")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("_key", F.lit(key))
    has = F.col("text").rlike("[0-9]|@")
    value = "array<struct<kind:string,value:string,pseudonym:string>>"

    def steps(name: str) -> list[tuple[str, str]]:
        each = lambda sql: f"transform({name}, fs -> transform(fs, x -> CASE WHEN x.kind IS NOT NULL THEN {sql} END))"
        return [
            (name, each(f"named_struct('m', x.m, 'kind', x.kind, 'body', {_body('x')})")),
            (name, each(_sides("x"))),
            (name, each(_feistel("x", inverse))),
            (name, each(f"named_struct('kind', x.kind, 'value', x.m, 'pseudonym', {_written('x')})")),
        ]

    out = f"zip_with(pieces[g], zip_with(found[g], covered[g], (x, c) -> named_struct('x', x, 'c', c)), (y, f) -> CASE WHEN f.c > 0 THEN substr(y, f.c + 1) WHEN f.x.kind IS NOT NULL THEN concat(f.x.pseudonym, substr(y, length(f.x.value) + 1)) ELSE y END)"
    taken = "filter(zip_with(found[g], covered[g], (x, c) -> CASE WHEN c = 0 THEN x END), x -> x.kind IS NOT NULL)"
    order = [
        ("mails", f"array(transform(regexp_extract_all(text, r'{MAIL}', 0), m -> named_struct('m', m, 'kind', 'email')))"),
        ("pieces", f"transform(split(text, r'{MAIL}', -1), y -> split(y, r'{START}', -1))"),
        ("found", f"transform(pieces, ps -> {_found('ps')})"),
        ("covered", f"zip_with(pieces, found, (ps, fs) -> {_covered('ps', 'fs')})"),
        *steps("mails"),
        *steps("found"),
        ("result", "array_join(flatten(transform(sequence(0, size(pieces) - 1), g -> array(" + f"array_join({out}, '')" + ", coalesce(get(mails[0], g).pseudonym, '')))), '')"),
        ("values", f"flatten(transform(sequence(0, size(pieces) - 1), g -> concat({taken}, CASE WHEN g < size(mails[0]) THEN array(mails[0][g]) ELSE cast(array() AS {value}) END)))"),
    ]
    for name, sql in order:
        rows = rows.withColumn(name, F.when(has, F.expr(sql)))
    values = F.coalesce("values", F.array().cast(value))
    return rows.select("doc_id", F.size(values).alias("n_values"), values.alias("values"), F.coalesce("result", "text").alias("text"))


def kinds(values: Column) -> Column:
    """How many values of each kind, as a map."""
    return F.map_from_entries(F.transform(F.array(*map(F.lit, KINDS)), lambda k: F.struct(k, F.size(F.filter(values, lambda v: v["kind"] == k)))))
