"""Regular-expression matches with code-point offsets, and pieces of texts, as column expressions that stay in proportion on very long texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SPANS

PLACES = "array<struct<start:int,end:int>>"
BLOCK, CHUNK_BITS = 64, 10


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once; a column used several times inside a lambda would be computed for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def chunks(text: Column) -> Column:
    """text cut into pieces of 1,024 code points, for piece_in()."""
    size = 1 << CHUNK_BITS
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def piece_in(cut: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points from chunks(text). substring() counts from the text's begin, which for n pieces of a long text is n times its length."""
    low = F.shiftright(start, CHUNK_BITS)
    high = F.shiftright(F.greatest(end - 1, start), CHUNK_BITS)
    return F.substring(F.array_join(F.slice(cut, low + 1, high - low + 1), ""), start - F.shiftleft(low, CHUNK_BITS) + 1, end - start)


# A lambda as text: built call by call, it would cost a hundred calls into the JVM for each pattern. v.t: the text, v.p: the pattern. Running sums are taken inside blocks
# of 64 matches and over the blocks, since an array that grows by one is copied each time.
_MATCHES = f"""v -> element_at(transform(array(regexp_extract_all(v.t, v.p, 0)), m -> if(size(m) > 0, flatten(aggregate(
  transform(array(slice(transform(arrays_zip(split(v.t, v.p, -1), m), z -> struct(length(z['0']) AS g, length(z.m) AS m)), 1, size(m))), w ->
    transform(sequence(0, shiftright(size(w) - 1, 6)), b -> aggregate(slice(w, b * {BLOCK} + 1, {BLOCK}), named_struct('at', 0, 'out', cast(array() AS {PLACES})),
      (acc, x) -> named_struct('at', acc.at + x.g + x.m, 'out', concat(acc.out, array(named_struct('start', acc.at + x.g, 'end', acc.at + x.g + x.m)))))))[0],
  named_struct('at', 0, 'out', cast(array() AS array<{PLACES}>)),
  (acc, x) -> named_struct('at', acc.at + x.at, 'out', concat(acc.out, array(transform(x.out, p -> named_struct('start', p.start + acc.at, 'end', p.end + acc.at))))), acc -> acc.out)),
  cast(array() AS {PLACES}))), 1)"""


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches, end exclusive. The pattern must not match empty.

    A match's start is the length of what stands between matches before it plus that of the matches before it; lengths
    count code points, where regexp_instr() would count UTF-16 units. Null text gives an empty array.
    """
    given = F.array(F.struct(text.alias("t"), F.lit(pattern).alias("p")))
    return F.coalesce(F.element_at(F.call_function("transform", given, F.expr(_MATCHES)), 1), F.array().cast(PLACES))


def groups(text: Column, pattern: str) -> Column:
    """As matches(), of group 1, which must end where the match ends."""
    whole = matches(text, pattern)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(F.arrays_zip(whole.alias("w"), inner.alias("i")), lambda x: F.struct((x["w"]["end"] - F.length(x["i"])).alias("start"), x["w"]["end"].alias("end")))


def piece(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points."""
    return F.substring(text, start + 1, end - start)


def spans_of(places: Column, kind: str, score: float | Column, recognizer: str) -> Column:
    """array of spans from array<struct<start, end>>."""
    score = F.lit(float(score)) if isinstance(score, (int, float)) else score
    return F.transform(places, lambda p: F.struct(F.lit(kind).alias("entity_type"), p["start"].alias("start"), p["end"].alias("end"), score.alias("score"), F.lit(recognizer).alias("recognizer"))).cast(SPANS)


def strip_chars(text: Column, chars: str = "\\s") -> Column:
    """Without leading and trailing characters of a class."""
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


# Lambdas as text, as above. v: spans, best first. Sorted by start they are dealt to blocks of `every`; b: the blocks' first starts; r: a span's rank; low and high: the blocks
# that it touches. The fold's step is no transform(), which would copy the whole state.
_GREEDILY = """v -> if(size(v) < 2, v, transform(array(greatest(8, cast(ceil(sqrt(size(v)) / 2) AS int))), every -> transform(array(
    transform(array_sort(transform(v, (s, i) -> named_struct('a', s.start, 'r', i, 's', s))), (z, j) -> named_struct('r', z.r, 'low', cast(j div every AS int), 's', z.s))), w ->
  transform(array(transform(sequence(0, size(v) - 1, every), i -> w[i].s.start)), b ->
    flatten(transform(aggregate(
      array_sort(transform(w, z -> named_struct('r', z.r, 'low', z.low, 'high', if(coalesce(z.s.end <= get(b, z.low + 1), true), z.low, size(filter(b, q -> q < z.s.end)) - 1), 's', z.s))),
      array_repeat(cast(array() AS array<struct<first:int,s:{span}>>), size(b)),
      (acc, x) -> if(exists(slice(acc, x.low + 1, x.high - x.low + 1), block -> exists(block, k -> {clash})), acc, concat(slice(acc, 1, x.low),
        transform(slice(acc, x.low + 1, x.high - x.low + 1), block -> concat(block, array(named_struct('first', x.low, 's', x.s)))), slice(acc, x.high + 2, size(acc))))),
      (block, i) -> transform(filter(block, k -> k.first = i), k -> k.s))))[0])[0])[0])"""


def greedily(ranked: Column, clash: str) -> Column:
    """The spans of ranked (array of spans, best first) that clash with none kept before them; clash is SQL on k.s (kept) and x.s, true of overlapping spans only. Unsorted.

    A kept span is entered in every block from that of its start to that of its end, so a span is compared within the blocks that it touches and work stays near to n spans
    times the size of a block, where comparing with all kept spans grows as n squared."""
    return F.element_at(F.call_function("transform", F.array(ranked), F.expr(_GREEDILY.replace("{span}", SPANS[6:-1]).replace("{clash}", clash))), 1)
