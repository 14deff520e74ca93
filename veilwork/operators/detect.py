"""Recognizers as column expressions: each gives an array of spans for a text column, so detection never shuffles."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.matching import chunks, greedily, groups, let, matches, piece, piece_in, spans_of, strip_chars
from ..functions.stored import stored

STRIP = "\\s‘’“”\"'()"


def _none() -> Column:
    return F.array().cast(S.SPANS)


def _guard(condition: Column, spans: Column) -> Column:
    """Spans only where a cheap test says there may be some."""
    return F.when(condition, spans).otherwise(_none())


def emails(text: Column) -> Column:
    return _guard(text.contains("@"), spans_of(matches(text, S.EMAIL), "EMAIL_ADDRESS", 1.0, "email"))


def indian_phones(text: Column) -> Column:
    return _guard(text.rlike(r"\d{4}"), spans_of(matches(text, S.INDIAN_PHONE), "PHONE_NUMBER", 0.75, "indian_phone"))


def intl_phones(text: Column) -> Column:
    return _guard(text.contains("+"), spans_of(matches(text, S.INTL_PHONE), "PHONE_NUMBER", 0.60, "intl_phone"))


def ssns(text: Column) -> Column:
    return _guard(text.rlike(r"\d-\d\d-\d"), spans_of(matches(text, S.SSN), "US_SSN", 0.85, "ssn"))


def is_generic_company(candidate: Column) -> Column:
    """a reference such as "the Company", or a legal suffix alone."""
    bare = strip_chars(candidate, STRIP)
    return bare.rlike(S.GENERIC_COMPANY) | bare.rlike(S.BARE_SUFFIX)


def companies(text: Column, ignore_case: bool = True) -> Column:
    flag = "(?i)" if ignore_case else ""
    found = let(chunks(text), lambda cut: F.filter(matches(text, flag + S.COMPANY), lambda p: ~is_generic_company(piece_in(cut, p["start"], p["end"]))))
    return _guard(text.rlike(rf"{flag}\s(?:{S.SUFFIXES})\b"), spans_of(found, "ORGANIZATION", 0.85, "company_suffix"))


def may_name_person(text: Column) -> Column:
    """Whether there is an honorific, or a label's last word and a colon or hyphen, without which there is no person."""
    has = lambda words: reduce(or_, [text.contains(w) for w in words])
    return has(S.HONORIFICS) | ((text.contains(":") | text.contains("-")) & has(S.PERSON_LABELS))


def persons(text: Column) -> Column:
    return _guard(may_name_person(text), spans_of(groups(text, S.PERSON), "PERSON", 0.90, "person_context"))


def births(text: Column) -> Column:
    """Three date shapes, kept when a birth phrase stands in the 60 characters before."""
    shapes = F.concat(*[matches(text, p) for p in S.DATES])
    told = let(chunks(text), lambda cut: F.filter(shapes, lambda p: piece_in(cut, F.greatest(p["start"] - 60, F.lit(0)), p["start"]).rlike(S.BIRTH)))
    return _guard(text.rlike(S.BIRTH), spans_of(told, "DATE_OF_BIRTH", 0.90, "dob"))


def addresses(text: Column, window: int = 200) -> Column:
    """PIN codes with a keyword, place or label nearby, and labels with an address after them; spans inside a better one go."""

    def by_pin(cut: Column, size: Column, p: Column) -> Column:
        low, high = F.greatest(p["start"] - window, F.lit(0)), F.least(p["end"] + window, size)
        around = piece_in(cut, low, high)
        label = piece_in(cut, F.greatest(p["start"] - 120, F.lit(0)), p["start"]).rlike(S.ADDRESS_LABEL)
        line = F.locate("\n", F.reverse(piece_in(cut, low, p["start"])))
        blank = F.locate("\n\n", piece_in(cut, p["end"], high))
        found = F.struct(low.alias("low"), high.alias("high"), around.rlike(S.ADDRESS_WORD).alias("word"), around.rlike(S.PLACE).alias("place"), label.alias("label"), line.alias("line"), blank.alias("blank"))

        def span(x: Column) -> Column:
            start = F.when(x["line"] > 0, p["start"] - x["line"] + 1).otherwise(x["low"])
            end = F.when(x["blank"] > 0, p["end"] + x["blank"] - 1).otherwise(x["high"])
            score = F.lit(0.50) + F.when(x["word"], 0.15).otherwise(0.0) + F.when(x["place"], 0.10).otherwise(0.0) + F.when(x["label"], 0.20).otherwise(0.0)
            told = x["word"] | x["place"] | x["label"]
            return F.struct(F.lit("ADDRESS").alias("entity_type"), start.alias("start"), end.alias("end"), F.when(told, F.least(score, F.lit(0.95))).alias("score"), F.lit("address_pin").alias("recognizer"))

        return let(found, span)

    def by_label(cut: Column, size: Column, p: Column) -> Column:
        high = F.least(p["end"] + 300, size)

        def span(ahead: Column) -> Column:
            blank = F.locate("\n\n", ahead)
            end = F.when(blank > 0, p["end"] + blank - 1).otherwise(high)
            told = ahead.rlike(S.ADDRESS_WORD) | ahead.rlike(S.PLACE) | ahead.rlike(S.PIN)
            return F.struct(F.lit("ADDRESS").alias("entity_type"), p["start"].alias("start"), end.alias("end"), F.when(told, 0.70).alias("score"), F.lit("address_label").alias("recognizer"))

        return let(piece_in(cut, p["end"], high), span)

    def both(known: Column) -> Column:
        each = lambda pattern, f: F.transform(matches(text, pattern), lambda p: f(known["cut"], known["size"], p)).cast(S.SPANS)
        return F.concat(each(S.PIN, by_pin), each(S.ADDRESS_LABEL, by_label))

    found = let(F.struct(chunks(text).alias("cut"), F.length(text).alias("size")), both)
    return _guard(text.rlike(S.PIN) | text.rlike(S.ADDRESS_LABEL), drop_contained(F.filter(found, lambda s: s["score"].isNotNull())))


def drop_contained(spans: Column) -> Column:
    """By score, best first (ties in the order given); a span wholly inside one kept before goes. The result is by score again."""
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("o"), i.alias("i"), s.alias("s"))))
    kept = greedily(F.transform(ranked, lambda x: x["s"]), "k.s.start <= x.s.start AND k.s.end >= x.s.end")
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct((-s["score"]).alias("o"), s["recognizer"].alias("r"), s["start"].alias("a"), s.alias("s")))), lambda x: x["s"])


def cards(text: Column) -> Column:
    found = let(chunks(text), lambda cut: F.filter(matches(text, S.CARD), lambda p: F.call_function("luhn_check", F.regexp_replace(piece_in(cut, p["start"], p["end"]), "[ -]", ""))))
    return _guard(text.rlike(r"\d{4}[ -]?\d"), spans_of(found, "CREDIT_CARD", 1.0, "card"))


def ipv4s(text: Column) -> Column:
    return _guard(text.rlike(r"\d\.\d"), spans_of(matches(text, S.IPV4), "IP_ADDRESS", 0.60, "ipv4"))


RECOGNIZERS: dict[str, Callable[[Column], Column]] = {
    "email": emails, "indian_phone": indian_phones, "intl_phone": intl_phones, "ssn": ssns, "company": companies, "person": persons,
    "dob": births, "address": addresses, "card": cards, "ipv4": ipv4s,
}


#: A bit a recognizer, in this order.
BITS = {name: 1 << i for i, name in enumerate(RECOGNIZERS)}


def triggers(text: Column) -> Column:
    """Bits of the recognizers that may find something, from one lower-casing, one look for a digit and plain searches for pieces that their patterns cannot do without."""

    def bits(known: Column) -> Column:
        digit, low = known["digit"], known["low"]
        has = lambda words: reduce(or_, [low.contains(w) for w in words])
        may = {
            "email": text.contains("@"), "indian_phone": digit, "intl_phone": digit & text.contains("+"), "ssn": digit & text.contains("-"), "company": has(S.SUFFIX_PARTS),
            "person": may_name_person(text), "dob": digit & has(S.BIRTH_PARTS), "address": digit | has(S.LABEL_PARTS), "card": digit, "ipv4": digit & text.contains("."),
        }
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(may[name], bit).otherwise(0) for name, bit in BITS.items()])

    return F.when(text.isNull(), 0).otherwise(let(F.struct(F.lower(text).alias("low"), text.rlike("[0-9]").alias("digit")), bits))


def has_cue(text: Column) -> Column:
    """at least three characters once stripped, and an @, a digit or a cue word."""
    return (text.rlike("[@0-9]") | let(F.lower(text), lambda low: reduce(or_, [low.contains(w) for w in S.CUES]))) & text.rlike(r"\S[\s\S]+\S")


def boost_by_context(spans: Column, text: Column, by: float = 0.35, words: int = 5, most: float = 1.0, terms=None) -> Column:
    """A higher score where a context term of the span's type stands in the words just before it."""
    listed = terms or S.CONTEXT

    def boosted(s: Column) -> Column:
        before = F.split(strip_chars(F.lower(piece(text, F.lit(0), s["start"]))), r"\s+")
        near = let(before, lambda b: F.array_join(F.slice(b, F.greatest(F.size(b) - words + 1, F.lit(1)), words), " "))
        told = let(near, lambda n: reduce(or_, [(s["entity_type"] == kind) & n.contains(term) for kind, those in listed.items() for term in those]))
        return F.when(s["entity_type"].isin(*listed), s.withField("score", F.when(told, F.least(s["score"] + by, F.lit(most))).otherwise(s["score"]))).otherwise(s)

    return F.transform(spans, boosted)


@lru_cache(maxsize=64)
def _found(text_col: str, names: tuple[str, ...], boost: bool, jvm: object) -> Column:
    """What the recognizers find under their bits. Kept, since it takes some thousand calls into the JVM (the last argument) to build."""
    text = F.col(text_col)
    found = F.concat(*[_guard(F.col("__triggers").bitwiseAND(BITS[n]) != 0, RECOGNIZERS[n](text)) for n in names])
    return boost_by_context(found, text) if boost else found


#: Sorted, each span once; array_distinct() compares structs in pairs.
_DISTINCT = "s -> filter(s, (x, i) -> i = 0 OR NOT (x <=> s[i - 1]))"


def detect(units: DataFrame, names: Sequence[str] | None = None, text_col: str = "text", extra: dict[str, Callable[[Column], Column]] | None = None, prefilter: bool = False,
           boost: bool = False) -> DataFrame:
    """Units with a column spans: what the named recognizers find (all of them by default), joined to spans already there.

    A column of bits, computed once, says which recognizers may hit; each runs under its bit. prefilter (F1 as a switch): units without a cue, and without spans found
    elsewhere, come back with the spans they have, that is none; every unit comes back. boost (D13): scores raised by context words, before any threshold. extra holds the
    caller's own recognizers (U1), which run on every unit that the switch lets through. Null and blank texts give no spans."""
    text = F.col(text_col)
    extra = extra or {}
    known = RECOGNIZERS | extra
    here = F.coalesce("spans", _none()) if "spans" in units.columns else None
    open_ = text.rlike(r"\S")
    if prefilter:
        open_ &= has_cue(text) if here is None else has_cue(text) | ((F.size(here) > 0) & text.rlike(r"\S[\s\S]+\S"))
    every = 1 << len(BITS)  # the bit of the caller's own
    units = units.withColumn("__triggers", F.when(open_, triggers(text) + every).otherwise(0))
    parts = [] if here is None else [here]
    if own := tuple(n for n in (names or known) if n not in extra):
        parts.append(_found(text_col, own, boost, units.sparkSession._jvm))
    for n in (names or known):
        if n in extra:
            found = _guard(F.col("__triggers") != 0, extra[n](text))
            parts.append(boost_by_context(found, text) if boost else found)
    spans = F.element_at(F.call_function("transform", F.array(F.array_sort(F.concat(*parts))), F.expr(_DISTINCT)), 1)
    return units.withColumn("spans", spans).drop("__triggers")


def detect_distinct(units: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """D14 with every distinct text analysed once (H9): for corpora whose headers, footers and stock paragraphs recur.

    Units that no recognizer can hit by their triggers, most of a corpus, are told in a narrow scan, keep their place and are never shuffled; the others are written. Their
    dictionary of texts, keyed by hash and text, is counted down before the shuffle; only texts that have spans are written, and they are joined back by both keys, which adaptive
    execution splits where one text is very frequent. The caller's own recognizers (extra) may hit any text, so that with them every text is in the dictionary. Repeated units
    stay, null texts have no spans."""
    text, key = F.col(text_col), F.xxhash64(F.col(text_col))
    own = bool(options.get("extra"))
    may = F.coalesce(text.rlike(r"\S") & (F.lit(True) if own else triggers(text) != 0), F.lit(False))
    some = units.where(may) if own else stored(units.where(may))
    words = some.select(key.alias("__hash"), text.alias("__text")).groupBy("__hash", "__text").agg(F.count("*").alias("__n"))
    hits = stored(detect(words, text_col="__text", **options).where(F.size("spans") > 0).select("__hash", "__text", "spans"))
    found = some.join(hits, (key == F.col("__hash")) & (text == F.col("__text")), "left")
    found = found.withColumn("spans", F.coalesce("spans", _none())).drop("__hash", "__text")
    return found.unionByName(units.where(~may).withColumn("spans", _none()))


def regex_recognizer(kind: str, pattern: str, score: float, name: str = "custom") -> Callable[[Column], Column]:
    """A recognizer from a pattern that does not match empty."""
    return lambda text: spans_of(matches(text, pattern), kind, score, name)


def function_recognizer(find: Callable[[str], list[tuple[str, int, int, float]]], name: str = "custom") -> Callable[[Column], Column]:
    """A recognizer from a Python function text -> [(type, start, end, score)], run on Arrow batches."""
    import pandas as pd

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"entity_type": k, "start": a, "end": b, "score": float(s), "recognizer": name} for k, a, b, s in find(t)])

    return F.pandas_udf(run, S.SPANS, F.PandasUDFType.SCALAR)


def add_external_spans(units: DataFrame, found: DataFrame, keys: Sequence[str] = ("doc_id", "unit_ord")) -> DataFrame:
    """Units with the spans that a table (keys, entity_type, start, end, score, recognizer) holds for them."""
    span = F.struct("entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"), "recognizer")
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("__found"))  # a unit's own spans
    known = F.coalesce("spans", _none()) if "spans" in units.columns else _none()
    return units.join(per, list(keys), "left").withColumn("spans", F.concat(known, F.coalesce("__found", _none()))).drop("__found")


class Custom:
    """The caller's own recognizers together with their types' labels, thresholds and priorities.

    detect(units, extra=custom.recognizers), then analyze_units, redact_labels and explode_detections with types=custom.types."""

    def __init__(self) -> None:
        self.recognizers: dict[str, Callable[[Column], Column]] = {}
        self.types: dict[str, tuple[str, float, int]] = {}

    def register(self, name: str, entity_type: str, regex: str | None = None, fn: Callable | None = None, score: float = 0.85, label: str | None = None,
                 threshold: float = S.DEFAULT_THRESHOLD, priority: int = S.DEFAULT_PRIORITY) -> Custom:
        """A recognizer by pattern or by function. A type of the schema keeps its own row unless a label is given."""
        if (regex is None) == (fn is None):
            raise ValueError("give either regex or fn")
        self.recognizers[name] = regex_recognizer(entity_type, regex, score, name) if regex else function_recognizer(fn, name)
        if entity_type not in S.TYPES or label:
            self.types[entity_type] = (label or f"[REDACTED: {entity_type}]", float(threshold), int(priority))
        return self
