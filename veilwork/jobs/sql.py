"""SQL for DuckDB that gives the same rows as the registered queries, put together from the tables of the schema."""

from __future__ import annotations

from .. import schema as S
from ..sources.units import FIRST, LAST


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def one_of(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def by_type(column: str, which: int, default) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(t)} THEN {q(r[which]) if isinstance(r[which], str) else r[which]}" for t, r in S.TYPES.items()) + f" ELSE {default} END"


def pick(words, key: str) -> str:
    return "([" + ", ".join(q(str(w)) for w in words) + f"])[1 + ({key}) % {len(words)}]"


DOC_UNITS = r"""units AS (SELECT doc_id, CAST(i AS INT) AS unit_ord, 'body-para-' || i AS unit_id, p AS text FROM
  (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(p, '[^\t-\r ]'))"""


def template_units() -> str:
    first, last = pick(FIRST, "k"), pick(LAST, "k")
    num = lambda n, w: f"lpad(CAST(k % {n} AS VARCHAR), {w}, '0')"
    parts = {
        0: [("'Contact Person: Mr. '", None), (f"{first} || ' ' || {last}", "PERSON"), ("', Company Secretary'", None)],
        1: [("'DOB: '", None), ("lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST(k % 60 + 1940 AS VARCHAR)", "DATE_OF_BIRTH")],
        2: [("'SSN: '", None), (f"{num(900, 3)} || '-' || {num(90, 2)} || '-' || {num(9973, 4)}", "US_SSN")],
        3: [("''", None), ("'Registered Office: Plot No. ' || CAST(k % 300 + 1 AS VARCHAR) || ', MG Road, Pune ' || CAST(k % 50 + 411001 AS VARCHAR)", "ADDRESS")],
        4: [("'Audited by '", None), (f"{last} || ' & Associates LLP'", "ORGANIZATION"), ("'.'", None)],
        5: [("'Tel: '", None), (f"'+91 20 ' || {num(9967, 4)} || ' ' || {num(9949, 4)}", "PHONE_NUMBER")],
        6: [("'the Company has filed the prospectus.'", None)],
        7: [("'FY 2024-25 revenue grew 18%. See Page '", None), ("CAST(k % 300 + 1 AS VARCHAR)", None), ("' for details.'", None)],
        8: [("'Reference number: '", None), ("'1' || lpad(CAST(k % 99999989 AS VARCHAR), 8, '0')", None)],
        9: [("'Card: '", None), ("'4111 1111 1111 1111'", "CREDIT_CARD")],
        10: [("'Director: '", None), (f"{first} || ' ' || {last}", "PERSON"), ("', email: '", None), (f"{first} || '.' || {last} || '@example.com'", "EMAIL_ADDRESS"), ("', phone '", None), ("'020 4509 4400'", "PHONE_NUMBER")],
        11: [("'Server IP: '", None), ("'192.168.1.' || CAST(k % 256 AS VARCHAR)", "IP_ADDRESS")],
    }
    texts, truths = ["WHEN k % 12 = 9 AND (k // 12) % 2 = 1 THEN 'Card: 4111 1111 1111 1112'"], []
    for turn, row in parts.items():
        texts.append(f"WHEN k % 12 = {turn} THEN " + " || ".join(f"({e})" for e, _ in row))
        at = "0"
        for e, kind in row:
            if kind:
                valid = " AND (k // 12) % 2 = 0" if turn == 9 else ""
                truths.append(f"SELECT k, {q(kind)} AS entity_type, CAST({at} AS INT) AS st, CAST({at} + length({e}) AS INT) AS en FROM keys WHERE k % 12 = {turn}{valid}")
            at += f" + length({e})"
    return f"""keys AS (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer),
units AS (SELECT k // 10 AS doc_id, CAST(k % 10 AS INT) AS unit_ord, 'body-para-' || (k % 10) AS unit_id, CASE {' '.join(texts)} END AS text FROM keys),
truth AS (SELECT k // 10 AS doc_id, CAST(k % 10 AS INT) AS unit_ord, 'body-para-' || (k % 10) AS unit_id, entity_type, st, en FROM ({' UNION ALL '.join(truths)}))"""


TEMPLATE_UNITS = template_units()


def _places(name: str, pattern: str, source: str = "units", group: str = "") -> str:
    """CTEs: `name`(doc_id, unit_ord, unit_id, text, st, en) of a pattern's matches."""
    p = q(pattern)
    start = "CAST(st_ + length(m[i]) - length(h[i]) AS INT)" if group else "CAST(st_ AS INT)"
    return f"""{name}_m AS (SELECT *, regexp_extract_all(text, {p}) AS m, {f'regexp_extract_all(text, {p}, 1)' if group else 'NULL'} AS h, string_split_regex(text, {p}) AS g FROM {source} WHERE regexp_matches(text, {p})),
{name} AS (SELECT doc_id, unit_ord, unit_id, text, {start} AS st, CAST(st_ + length(m[i]) AS INT) AS en FROM
  (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS st_
   FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m)))"""


def _rows(name: str, kind: str, score, recognizer: str, where: str = "true") -> str:
    return f"SELECT doc_id, unit_ord, unit_id, text, {q(kind)} AS entity_type, st, en, CAST({score} AS DOUBLE) AS score, {q(recognizer)} AS recognizer FROM {name} WHERE {where}"


SAID = "substring(text, st + 1, en - st)"
EDGE = "^[{0}]+|[{0}]+$".format(r"\s‘’“”" + "\"'()")
BARE = f"regexp_replace({SAID}, {q(EDGE)}, '', 'g')"
LUHN = f"""(SELECT sum(CASE WHEN i % 2 = 1 THEN d WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END) % 10 = 0 FROM
  (SELECT unnest(list_transform(list_reverse(string_split(regexp_replace({SAID}, '[ -]', '', 'g'), '')), lambda c: CAST(c AS INT))) AS d, unnest(range(1, 1 + length(regexp_replace({SAID}, '[ -]', '', 'g')))) AS i))"""


def generic_company(bare: str) -> str:
    return f"(regexp_matches({bare}, {q(S.GENERIC_COMPANY)}) OR regexp_matches({bare}, {q(S.BARE_SUFFIX)}))"


def org_fp(bare: str) -> str:
    ends = f"regexp_matches({bare}, {q(S.ORG_SUFFIX_END)})"
    return f"""((regexp_matches({bare}, {q(S.ORG_GENERIC_START)}) AND NOT regexp_matches({bare}, {q(S.ORG_GENUINE)}))
  OR (regexp_matches({bare}, {q(S.ORG_ACRONYM)}) AND regexp_replace({bare}, '[.]$', '') IN {one_of(S.ORG_ACRONYMS)})
  OR regexp_matches({bare}, {q(S.ORG_EXACT)}) OR regexp_matches({bare}, {q(S.ORG_PHRASE)}) OR ({ends} AND regexp_matches({bare}, '^[a-z]'))
  OR (NOT {ends} AND list_has_any(regexp_extract_all({bare}, {q(chr(92) + 'b[a-z]+' + chr(92) + 'b')}), [{', '.join(map(q, S.ORG_VERBS))}])))"""


def person_fp(bare: str) -> str:
    known = ", ".join(map(q, [*S.PERSON_PLACES, *S.PERSON_WORDS]))
    tokens = rf"list_filter(string_split_regex(lower({bare}), '[\s\-]+'), lambda t: t <> '')"
    return rf"""(lower({bare}) IN {one_of(S.PERSON_WORDS)} OR (len({tokens}) > 0 AND len(list_filter({tokens}, lambda t: NOT list_contains([{known}], t))) = 0)
  OR (regexp_matches({bare}, '^[A-Z]{{2,8}}(\s+[A-Z]{{2,8}})*$') AND ({bare} IN {one_of(S.PERSON_ACRONYMS)} OR len(list_filter(string_split_regex({bare}, '\s+'), lambda w: length(w) > 4)) = 0)))"""


STRIPPED = rf"regexp_replace({SAID}, '^\s+|\s+$', '', 'g')"


def _address() -> str:
    m = lambda t, p: f"regexp_matches({t}, {q(p)})"
    around = "substring(text, lo + 1, hi - lo)"
    return f"""{_places('pin', S.PIN)}, {_places('lab', S.ADDRESS_LABEL)},
pin2 AS (SELECT *, greatest(st - 200, 0) AS lo, least(en + 200, length(text)) AS hi FROM pin),
pin3 AS (SELECT *, {m(around, S.ADDRESS_WORD)} AS w, {m(around, S.PLACE)} AS p, {m('substring(text, greatest(st - 120, 0) + 1, st - greatest(st - 120, 0))', S.ADDRESS_LABEL)} AS c,
  strpos(reverse(substring(text, lo + 1, st - lo)), chr(10)) AS nl, strpos(substring(text, en + 1, hi - en), chr(10) || chr(10)) AS bl FROM pin2),
lab2 AS (SELECT *, least(en + 300, length(text)) AS hi FROM lab),
lab3 AS (SELECT *, substring(text, en + 1, hi - en) AS ahead FROM lab2),
adr AS (SELECT doc_id, unit_ord, unit_id, text, CASE WHEN nl > 0 THEN st - nl + 1 ELSE lo END AS st, CASE WHEN bl > 0 THEN en + bl - 1 ELSE hi END AS en,
  least(0.50::DOUBLE + CASE WHEN w THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN p THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.20::DOUBLE ELSE 0 END, 0.95::DOUBLE) AS score, 'address_pin' AS recognizer, 0 AS o, st AS o2 FROM pin3 WHERE w OR p OR c
  UNION ALL SELECT doc_id, unit_ord, unit_id, text, st, CASE WHEN strpos(ahead, chr(10) || chr(10)) > 0 THEN en + strpos(ahead, chr(10) || chr(10)) - 1 ELSE hi END, 0.70::DOUBLE, 'address_label', 1, st
  FROM lab3 WHERE {m('ahead', S.ADDRESS_WORD)} OR {m('ahead', S.PLACE)} OR {m('ahead', S.PIN)}),
adr_l AS (SELECT doc_id, unit_ord, unit_id, text, list_sort(list({{'q': -score, 'o': o, 'o2': o2, 'a': st, 'e': en, 's': score, 'r': recognizer}})) AS l FROM adr GROUP BY ALL),
adr_k AS (SELECT *, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.a <= x.a AND k.e >= x.e)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0])) AS x FROM adr_l)"""


RECOGNIZERS = {
    "email": (_places("em", S.EMAIL), _rows("em", "EMAIL_ADDRESS", 1.0, "email")),
    "indian_phone": (_places("ip", S.INDIAN_PHONE), _rows("ip", "PHONE_NUMBER", 0.75, "indian_phone")),
    "intl_phone": (_places("np", S.INTL_PHONE), _rows("np", "PHONE_NUMBER", 0.60, "intl_phone")),
    "ssn": (_places("ss", S.SSN), _rows("ss", "US_SSN", 0.85, "ssn")),
    "company": (_places("co", "(?i)" + S.COMPANY), _rows("co", "ORGANIZATION", 0.85, "company_suffix", f"NOT {generic_company(BARE)}")),
    "person": (_places("pe", S.PERSON, group="1"), _rows("pe", "PERSON", 0.90, "person_context")),
    "dob": (", ".join(_places(f"da{i}", p) for i, p in enumerate(S.DATES)),
            " UNION ALL ".join(_rows(f"da{i}", "DATE_OF_BIRTH", 0.90, "dob", f"regexp_matches(substring(text, greatest(st - 60, 0) + 1, st - greatest(st - 60, 0)), {q(S.BIRTH)})") for i in range(len(S.DATES)))),
    "address": (_address(), "SELECT doc_id, unit_ord, unit_id, text, 'ADDRESS' AS entity_type, CAST(x.a AS INT) AS st, CAST(x.e AS INT) AS en, x.s AS score, x.r AS recognizer FROM adr_k"),
    "card": (_places("ca", S.CARD), _rows("ca", "CREDIT_CARD", 1.0, "card", LUHN)),
    "ipv4": (_places("v4", S.IPV4), _rows("v4", "IP_ADDRESS", 0.60, "ipv4")),
}


def found(units: str, names=None, extra: str = "") -> str:
    """CTEs up to found(doc_id, unit_ord, unit_id, text, entity_type, st, en, score, recognizer)."""
    chosen = [RECOGNIZERS[n] for n in (names or RECOGNIZERS)]
    return f"{units}, {', '.join(c for c, _ in chosen)}, found AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(r for _, r in chosen)}{extra}))"


FILTERED = f"""filtered AS (SELECT * FROM found WHERE entity_type IN {one_of(S.TYPES)} AND NOT (entity_type = 'ORGANIZATION' AND {org_fp(BARE)})
  AND NOT (entity_type = 'PERSON' AND {person_fp(STRIPPED)}) AND score >= {by_type('entity_type', 1, S.DEFAULT_THRESHOLD)})"""


def resolved(source: str, name: str = "kept") -> str:
    return f"""{name}_l AS (SELECT doc_id, unit_ord, unit_id, text, list_sort(list({{'p': {by_type('entity_type', 2, S.DEFAULT_PRIORITY)}, 'l': st - en, 'q': -score, 'a': st, 't': entity_type, 'e': en, 's': score, 'r': recognizer}})) AS l FROM {source} GROUP BY ALL),
{name} AS (SELECT doc_id, unit_ord, unit_id, text, x.t AS entity_type, x.a AS st, x.e AS en, x.s AS score, x.r AS recognizer FROM
  (SELECT *, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.a < x.e AND x.a < k.e)) > 0 THEN acc ELSE list_append(acc, x) END, l[1:0])) AS x FROM {name}_l))"""


def analysed(units: str, names=None) -> str:
    return f"{found(units, names)}, {FILTERED}, {resolved('filtered')}"


def redacted(value: str, source: str = "kept") -> str:
    """CTE red(doc_id, unit_ord, unit_id, text, redacted): texts with `value` (of a row of source) for the spans."""
    return f"""bits AS (SELECT doc_id, unit_ord, st, en, {value} AS v, lag(en, 1, 0) OVER (PARTITION BY doc_id, unit_ord ORDER BY st) AS prev FROM {source}),
glue AS (SELECT b.doc_id, b.unit_ord, string_agg(substring(u.text, prev + 1, st - prev) || v, '' ORDER BY st) AS head, max(en) AS upto FROM bits b JOIN units u USING (doc_id, unit_ord) GROUP BY ALL),
red AS (SELECT u.doc_id, u.unit_ord, u.unit_id, u.text, coalesce(head, '') || substring(u.text, coalesce(upto, 0) + 1) AS redacted FROM units u LEFT JOIN glue USING (doc_id, unit_ord))"""


LABEL = by_type("entity_type", 0, "'[REDACTED: ' || entity_type || ']'")
SPAN_COLUMNS = 'doc_id, unit_ord, unit_id, entity_type, st AS "start", en AS "end", score, recognizer'


def fake(kind: str, idx: str, original: str) -> str:
    i = f"({idx})"
    digits = ["4"] + [f"(({i} * {k + 3} + 7) % 10)" for k in range(1, 15)]
    total = " + ".join(f"(CASE WHEN 2 * {d} > 9 THEN 2 * {d} - 9 ELSE 2 * {d} END)" if p % 2 == 0 else d for p, d in enumerate(digits))
    card = " || ".join([f"{d}::VARCHAR" + (" || ' '" if p in (3, 7, 11) else "") for p, d in enumerate(digits)] + [f"((10 - ({total}) % 10) % 10)::VARCHAR"])
    phone = f"lpad(((9000000000 + {i} * 13337777) % 10000000000)::VARCHAR, 10, '0')"
    ssn = f"lpad(((100000000 + {i} * 123456789) % 1000000000)::VARCHAR, 9, '0')"
    low = f"lower({original})"
    b = chr(92) + "b"
    year = q(f"{b}(?:19|20)[0-9][0-9]{b}")
    return f"""CASE {kind} WHEN 'PERSON' THEN {pick(S.FAKE_PERSONS, i)} || CASE WHEN {i} >= 30 THEN ' ' || ({i} // 30 + 1) ELSE '' END
  WHEN 'EMAIL_ADDRESS' THEN replace(lower({pick(S.FAKE_PERSONS, i)}), ' ', '.') || '@' || {pick(S.FAKE_DOMAINS, i)}
  WHEN 'PHONE_NUMBER' THEN '+91 9' || substring({phone}, 2, 4) || ' ' || substring({phone}, 6, 5)
  WHEN 'ORGANIZATION' THEN {pick(S.FAKE_WORDS, i)} || ' ' || {pick(S.FAKE_CATEGORIES, i)} || ' ' || CASE WHEN regexp_matches({low}, '{b}llp{b}') THEN 'LLP'
    WHEN regexp_matches({low}, '{b}(pvt[.]?{chr(92)}s*ltd[.]?|private{chr(92)}s+limited){b}') THEN 'Private Limited' WHEN regexp_matches({low}, '{b}limited{b}') THEN 'Limited'
    WHEN regexp_matches({low}, '{b}inc[.]?{b}') THEN 'Inc.' WHEN regexp_matches({low}, '{b}corp[.]?{b}') THEN 'Corp.' ELSE 'Private Limited' END
  WHEN 'ADDRESS' THEN {pick(S.FAKE_STREETS, i)} || ', ' || {pick(S.FAKE_CITIES, i)} || ' – ' || {pick(S.FAKE_PINS, i)} || ', Maharashtra, India'
  WHEN 'IP_ADDRESS' THEN '203.0.113.' || (1 + {i} % 99)
  WHEN 'US_SSN' THEN substring({ssn}, 1, 3) || '-' || substring({ssn}, 4, 2) || '-' || substring({ssn}, 6, 4)
  WHEN 'CREDIT_CARD' THEN {card}
  WHEN 'DATE_OF_BIRTH' THEN CASE WHEN regexp_matches({original}, {year}) THEN array_to_string(list_transform(list_zip(string_split_regex({original}, {year}), regexp_extract_all({original}, {year})),
    lambda z: z[1] || coalesce(CAST(CAST(z[2] AS INT) - 10 AS VARCHAR), '')), '') ELSE '01/01/1980' END
  ELSE '[' || {kind} || '_' || ({i} + 1) || ']' END"""


MAPPED = f"""firsts AS (SELECT doc_id, entity_type, {STRIPPED} AS original, min({{'u': unit_ord, 's': st}}) AS f FROM kept GROUP BY ALL),
ids AS (SELECT doc_id, entity_type, original, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY f, original) - 1 AS idx FROM firsts),
mapped AS (SELECT *, {fake('entity_type', 'idx', 'original')} AS replacement FROM ids)"""
