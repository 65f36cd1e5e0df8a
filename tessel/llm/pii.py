"""Pseudonyms for personal data by keyed permutations that keep the format.

One pattern finds candidates, of which no two kinds share a form; each is validated (octets,
calendar, IBAN check digits, number plans) and what is valid is mapped by a Feistel network within the values of its
format, check digits anew. Cards are looked for in what lies between: of a run of digit groups the longest stretch with a
right check digit counts. The map is a permutation that depends on the key and the kind only, so equal values get equal
pseudonyms in all documents and different ones stay different. Everything is a SQL expression over one scan: no shuffle,
no Python on the executors.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import REST, read, rest

#: The session's setting that holds the key of the permutations.
KEY_CONF = "spark.tessel.pii.key"
ROUNDS = 10

# Characters of an IBAN by country, from the public registry of ISO 13616.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """Exactly a country's number of characters, with or without spaces in between, so that no word behind is taken along."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    each = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items()))
    return rf"\b(?=[A-Z]{{2}}[0-9]{{2}})(?:{each})(?![A-Za-z0-9])"


# Formats.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"\bAKIA[A-Z0-9]{16}\b|(?<=password=)[A-Za-z0-9]{8,64}(?![A-Za-z0-9])|(?<=[\"'])[0-9a-f]{40}(?=[\"'])",
    "iban": _iban_pattern(),
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9]|[-.][0-9])",
    "date": r"(?<![0-9A-Za-z/.-])[12][0-9]{3}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|[/.-][0-9])|(?<![0-9A-Za-z/.-])[0-9]{2}([/.])[0-9]{2}\1[12][0-9]{3}(?![0-9A-Za-z]|[/.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
}
KINDS = tuple(PATTERNS)


def _text(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pair(key: str, kind: str, l: str, r: str, ml: str, mr: str) -> str:
    """A struct (l, r) permuted in [0, ml) x [0, mr): one half changes a round, by a hash of the other."""
    h = lambda x: f"cast(conv(substr(sha2(concat({_text(key + '|' + kind + '|')}, k, '|', {x}), 256), 1, 14), 16, 10) AS bigint)"
    step = f"named_struct('l', if(k % 2 = 1, pmod(s.l + {h('s.r')}, {ml}), s.l), 'r', if(k % 2 = 0, pmod(s.r + {h('s.l')}, {mr}), s.r))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({l} AS bigint), 'r', cast({r} AS bigint)), (s, k) -> {step})"


def _digits(key: str, kind: str, d: str) -> str:
    """A string of 2 to 18 digits permuted among those of its length."""
    half = f"(length({d}) DIV 2)"
    ten = lambda n: f"cast(power(10, {n}) AS bigint)"
    rest_ = f"(length({d}) - {half})"
    done = _pair(key, kind, f"substr({d}, 1, {half})", f"substr({d}, {half} + 1)", ten(half), ten(rest_))
    return _let("pq", done, f"concat(lpad(cast(pq.l AS string), {half}, '0'), lpad(cast(pq.r AS string), {rest_}, '0'))")


def _chars(key: str, kind: str, a: str) -> str:
    """A string of ASCII letters and digits permuted among those with the same classes at the same places."""
    turn = "CASE WHEN c >= '0' AND c <= '9' THEN char(48 + pmod(ascii(c) - 48 + v, 10)) WHEN c >= 'a' THEN char(97 + pmod(ascii(c) - 97 + v, 26)) ELSE char(65 + pmod(ascii(c) - 65 + v, 26)) END"
    hex_ = "cast(conv(substr(h, 1 + 4 * ((i - 1) % 32), 4), 16, 10) AS int)"
    each = _let("v", hex_, _let("c", "substr(x, i, 1)", turn))
    moved = f"if(x = '', '', array_join(transform(sequence(1, length(x)), i -> {each}), ''))"
    shift = lambda x, other: _let("h", f"sha2(concat({_text(key + '|' + kind + '|')}, k, '|', {other}), 512)", _let("x", x, moved))
    step = f"named_struct('l', if(k % 2 = 1, {shift('s.l', 's.r')}, s.l), 'r', if(k % 2 = 0, {shift('s.r', 's.l')}, s.r))"
    start = f"named_struct('l', substr({a}, 1, length({a}) DIV 2), 'r', substr({a}, length({a}) DIV 2 + 1))"
    return _let("lr", f"aggregate(sequence(1, {ROUNDS}), {start}, (s, k) -> {step})", "concat(lr.l, lr.r)")


def _refill(m: str, new: str, cls: str) -> str:
    """m with its characters of a class replaced in turn by those of new."""
    step = f"if(substr({m}, j, 1) RLIKE '{cls}', named_struct('o', concat(f.o, substr({new}, f.p, 1)), 'p', f.p + 1), named_struct('o', concat(f.o, substr({m}, j, 1)), 'p', f.p))"
    return f"aggregate(sequence(1, length({m})), named_struct('o', '', 'p', 1), (f, j) -> {step}, f -> f.o)"


def _luhn(p: str) -> str:
    """The check digit of a payload of digits."""
    v = _let("dg", f"cast(substr({p}, i, 1) AS int)", f"if((length({p}) - i) % 2 = 0, 2 * dg - if(dg > 4, 9, 0), dg)")
    return f"cast(pmod(10 - aggregate(sequence(1, length({p})), 0, (t, i) -> t + {v}) % 10, 10) AS string)"


def _mod97(s: str) -> str:
    v = _let("ch", f"substr({s}, i, 1)", "if(ch >= 'A', t * 100 + ascii(ch) - 55, t * 10 + ascii(ch) - 48)")
    return f"aggregate(sequence(1, length({s})), 0, (t, i) -> cast({v} AS int) % 97)"


def _only(m: str, cls: str) -> str:
    return f"regexp_replace({m}, '[^{cls}]', '')"


def _email(key: str) -> str:
    head, tld = r"regexp_extract(m, '^(.*)(\\.[A-Za-z]+)$', 1)", r"regexp_extract(m, '^(.*)(\\.[A-Za-z]+)$', 2)"
    new = _let("al", _only("hd", "A-Za-z0-9"), _let("nw", _chars(key, "email", "al"), _refill("hd", "nw", "[A-Za-z0-9]")))
    return _let("hd", head, f"concat({new}, {tld})")


def _secret(key: str) -> str:
    return f"if(m LIKE 'AKIA%' AND length(m) = 20, concat('AKIA', {_let('al', 'substr(m, 5)', _chars(key, 'secret', 'al'))}), {_chars(key, 'secret', 'm')})"


def _iban(key: str) -> str:
    bban = _let("bb", "substr(an, 5)", _let("nb", _chars(key, "iban", "bb"), _let("ck", f"98 - {_let('z', "concat(nb, substr(an, 1, 2), '00')", _mod97('z'))}", "concat(substr(an, 1, 2), lpad(cast(ck AS string), 2, '0'), nb)")))
    valid = _let("z", "concat(substr(an, 5), substr(an, 1, 4))", _mod97("z"))
    return _let("an", "replace(m, ' ', '')", f"if({valid} = 1, {_let('nw', bban, _refill('m', 'nw', '[A-Za-z0-9]'))}, NULL)")


def _phone(key: str) -> str:
    """The country code stays; ten digits of the North American plan stay within it, others within their length."""
    plan = _pair(key, "phone", "cast(substr(dg, 1, 3) AS int) - 200", "(cast(substr(dg, 4, 3) AS int) - 200) * 10000 + cast(substr(dg, 7, 4) AS int)", "800", "8000000")
    plan = _let("pq", plan, "concat(cast(pq.l + 200 AS string), cast(pq.r DIV 10000 + 200 AS string), lpad(cast(pq.r % 10000 AS string), 4, '0'))")
    new = f"if(length(dg) = 10 AND dg RLIKE '^[2-9]..[2-9]', {plan}, {_digits(key, 'phone', 'dg')})"
    code = r"regexp_extract(m, '^([+]1(?=[^0-9]|[0-9]{10}$)|[+][0-9]{1,3}(?=[^0-9])|[+][0-9]{2})', 1)"
    tail = _let("tl", "substr(m, length(cc) + 1)", _let("dg", _only("tl", "0-9"), f"if(length(dg) + length(cc) BETWEEN 8 AND 16, {_let('nw', new, 'concat(cc, ' + _refill('tl', 'nw', '[0-9]') + ')')}, NULL)"))
    return _let("cc", code, tail)


def _date(key: str) -> str:
    """A day permuted within its 400-year cycle from 1600 (146097 = 189 x 773 days); day and month first as written."""
    iso = "m LIKE '____-__-__'"
    new = _let("dy", f"date_diff(coalesce(d1, d2), DATE'1600-01-01')", _let("pq", _pair(key, "date", "(dy % 146097) DIV 773", "(dy % 146097) % 773", "189", "773"), "date_add(DATE'1600-01-01', cast(dy - dy % 146097 + pq.l * 773 + pq.r AS int))"))
    shown = f"CASE WHEN {iso} THEN date_format(nd, 'yyyy-MM-dd') WHEN d1 IS NOT NULL THEN date_format(nd, concat('MM', sp, 'dd', sp, 'yyyy')) ELSE date_format(nd, concat('dd', sp, 'MM', sp, 'yyyy')) END"
    d1 = f"if({iso}, try_to_date(m, 'yyyy-MM-dd'), if(substr(m, 3, 1) = '/', try_to_date(concat(substr(m, 7, 4), '-', substr(m, 1, 2), '-', substr(m, 4, 2)), 'yyyy-MM-dd'), NULL))"
    d2 = f"if({iso}, NULL, try_to_date(concat(substr(m, 7, 4), '-', substr(m, 4, 2), '-', substr(m, 1, 2)), 'yyyy-MM-dd'))"
    body = f"if(coalesce(d1, d2) >= DATE'1600-01-01', {_let('nd', new, shown)}, NULL)"
    return _let("sp", "substr(m, 3, 1)", _let("d1", d1, _let("d2", d2, body)))


def _ssn(key: str) -> str:
    area = "cast(substr(m, 1, 3) AS int)"
    left = f"{area} - if({area} > 666, 2, 1)"
    right = "(cast(substr(m, 5, 2) AS int) - 1) * 9999 + cast(substr(m, 8, 4) AS int) - 1"
    shown = "concat(lpad(cast(pq.l + if(pq.l >= 665, 2, 1) AS string), 3, '0'), '-', lpad(cast(pq.r DIV 9999 + 1 AS string), 2, '0'), '-', lpad(cast(pq.r % 9999 + 1 AS string), 4, '0'))"
    return _let("pq", _pair(key, "ssn", left, right, "898", "989901"), shown)


def _ip(key: str) -> str:
    o = [f"cast(element_at(oc, {i}) AS int)" for i in range(1, 5)]
    shown = "concat_ws('.', pq.l DIV 256, pq.l % 256, pq.r DIV 256, pq.r % 256)"
    return _let("oc", "split(m, '[.]')", _let("pq", _pair(key, "ip", f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536", "65536"), shown))


def _card(key: str) -> str:
    """A struct (text, pseudonym) for a run of digit groups: that of the longest stretch of whole groups that is a card.

    Of equally long ones the first counts. The first digit stays, the check digit follows from the others. Both are the
    run and null where no stretch is a card.
    """
    body = _let("bd", "substr(dg, 2, length(dg) - 2)", _let("pl", f"concat(substr(dg, 1, 1), {_digits(key, 'card', 'bd')})", f"concat(pl, {_luhn('pl')})"))
    starts = "filter(sequence(1, length(m)), i -> i = 1 OR substr(m, i - 1, 1) IN (' ', '-'))"
    ends = "filter(sequence(1, length(m)), i -> i = length(m) OR substr(m, i + 1, 1) IN (' ', '-'))"
    spans = f"flatten(transform({starts}, b -> transform(filter({ends}, e -> e > b), e -> named_struct('b', b, 'e', e, 'dg', {_only('substr(m, b, e - b + 1)', '0-9')}))))"
    good = f"filter({spans}, s -> length(s.dg) BETWEEN 13 AND 19 AND luhn_check(s.dg) AND s.dg RLIKE '[1-9]')"
    best = f"array_sort({good}, (x, y) -> CASE WHEN length(x.dg) <> length(y.dg) THEN length(y.dg) - length(x.dg) ELSE x.b - y.b END)"
    new = _let("dg", "sp.dg", _let("mm", "substr(m, sp.b, sp.e - sp.b + 1)", _let("nw", body, _refill("mm", "nw", "[0-9]"))))
    told = _let("pn", new, "named_struct('text', concat(substr(m, 1, sp.b - 1), pn, substr(m, sp.e + 1)), 'pseudonym', pn)")
    return _let("bs", best, f"if(size(bs) = 0, named_struct('text', m, 'pseudonym', CAST(NULL AS string)), {_let('sp', 'element_at(bs, 1)', told)})")


_MAPS = {"email": _email, "iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip}


#: What tells the kinds but credentials apart in a match: no two patterns share a form. Credentials have a group of their own.
FORMS = {
    "email": "@", "date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}$", "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "ip": "^[0-9]{1,3}([.][0-9]{1,3}){3}$", "iban": "^[A-Z]{2}", "phone": "",
}


def _grouped() -> str:
    """All kinds but cards as one pattern; its first group is a credential."""
    kinds = ["secret", *FORMS]
    return "|".join(f"({PATTERNS[k]})" if k == "secret" else PATTERNS[k].replace(r"\1", r"\2") for k in kinds)


def _cards(key: str, text: str) -> str:
    """A struct (text, found) for a stretch of text: its cards in pseudonyms."""
    card = _text(PATTERNS["card"])
    done = f"transform(regexp_extract_all(p, {card}, 0), m -> {_card(key)})"
    joined = f"array_join(zip_with(split(p, {card}, -1), concat(cs.text, array('')), (a, b) -> concat(a, b)), '')"
    found = "transform(filter(cs, c -> c.pseudonym IS NOT NULL), c -> named_struct('kind', 'card', 'pseudonym', c.pseudonym))"
    some = _let("cs", done, f"named_struct('text', {joined}, 'found', {found})")
    none = "named_struct('text', p, 'found', CAST(array() AS array<struct<kind:string,pseudonym:string>>))"
    return _let("p", text, f"if(p RLIKE '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]', {some}, {none})")


def _mapped(key: str) -> str:
    """A struct (text, found) for the match m, a credential where secret says so; where validation fails, its cards only."""
    cases = " ".join(f"WHEN m RLIKE '{form}' THEN named_struct('kind', '{k}', 'pn', {_MAPS[k](key)})" for k, form in FORMS.items())
    told = f"CASE WHEN secret THEN named_struct('kind', 'secret', 'pn', {_secret(key)}) {cases} END"
    valid = "named_struct('text', r.pn, 'found', array(named_struct('kind', r.kind, 'pseudonym', r.pn)))"
    return _let("r", told, f"if(r.pn IS NOT NULL, {valid}, {_cards(key, 'm')})")


def session_key(spark: SparkSession) -> str:
    """The key of KEY_CONF; where that is unset, one drawn at random for this session, which links its pseudonyms only."""
    found = spark.conf.get(KEY_CONF, None)
    if not found:
        found = secrets.token_hex(16)
        spark.conf.set(KEY_CONF, found)
    return found


def pseudonymize(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, safe_text, found (array of kind and pseudonym, in order) and the other columns as the struct _rest, a row per input row.

    safe_text is the whole text with every valid value in place of its pseudonym and nothing else changed. Kinds: see
    PATTERNS; credentials are treated like personal data, and what stands where one kind is found is of no other kind
    unless it fails validation and holds a card. Null texts stay null, with none found; null and repeated ids pass
    through. No rows give no rows. An empty key is refused. The key ends up in the plan: keep plans as secret as the key.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    pattern, few = _text(_grouped()), _text("[0-9@]|AKIA|password=|[\"'][a-f]{40}")  # each kind has one of these few
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), rest(docs, id_col, text_col))
    rows = rows.withColumn("matches", F.expr(f"if(text RLIKE {few}, regexp_extract_all(text, {pattern}, 0), NULL)"))
    rows = rows.withColumn("secrets", F.expr(f"if(size(matches) > 0, transform(regexp_extract_all(text, {pattern}, 1), x -> x <> ''), array())"))
    rows = rows.withColumn("mapped", F.expr(f"zip_with(matches, secrets, (m, secret) -> {_mapped(key)})"))
    rows = rows.withColumn("between", F.expr(f"if(matches IS NULL, NULL, transform(if(size(matches) > 0, split(text, {pattern}, -1), array(text)), q -> {_cards(key, 'q')}))"))
    end = "array(named_struct('text', '', 'found', CAST(array() AS array<struct<kind:string,pseudonym:string>>)))"
    rows = rows.withColumn("parts", F.expr(f"flatten(zip_with(between, concat(mapped, {end}), (a, b) -> array(a, b)))"))
    rows = rows.withColumn("found", F.expr("coalesce(flatten(parts.found), array())"))
    return rows.select("id", F.expr("if(size(found) > 0, array_join(parts.text, ''), text)").alias("safe_text"), "found", REST)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every whole text of documents with personal data in pseudonyms, and how many of each kind it had."""
    out = pseudonymize(read(spark, sf_dir, "documents"), session_key(spark))
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("id").alias("doc_id"), F.col("safe_text").alias("text"), F.size("found").cast("long").alias("n_found"), *counts)
