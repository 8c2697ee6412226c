"""Personal data: patterns, and terms that would give protected values away.

Values found by pattern (email, IP address, card, phone) are protected entities. How much
a term tells about an entity is estimated from co-occurrence over the corpus: with p(e) the
share of documents that hold the entity and p(e|t) that among documents with the term,
the disclosure of term t is its pointwise mutual information with e over the information of
e, log(p(e|t) / p(e)) / log(1 / p(e)): 1 if only documents with e have the term, 0
if the term tells nothing. In a document that holds e every occurrence of a term above a threshold is a span
of its own, to be generalised, or removed above a second one.

Terms are all words with a letter that do not touch a value, wherever they stand. A pair needs
``SUPPORT`` different texts, so a value or a text that occurs once gives nothing to estimate. Entities, and likewise
terms, that stand in the same texts have the same counts with anything else; they are counted as one class, so
a text with very many values has few pairs. A term too frequent for its disclosure of an entity to reach the
threshold in any case is not paired with it.

Only column expressions and joins are used. Texts are not shuffled but by ``sanitized``,
which has to bring texts and spans together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.llm.common import fresh, hex_sha256, query, small_side, table, written

#: The kinds in the order of reports, and the pattern of each. A pattern starts only
#: where a run of its characters starts or the previous match ended, so long runs are
#: read once; elsewhere a match would have begun before.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_VALUE = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Kind of the spans that co-occurrence adds.
TERM = "term"

#: Matches that are put together at a time; longer lists are lists of such lists until the end.
RUN = 64

SUPPORT = 2
GENERALISE = 0.6
REMOVE = 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes_luhn(value: Column) -> Column:
    """The usual checksum: from the right, every second digit counts twice, nines cast out."""
    reverse = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(reverse))

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(reverse, place, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP_VALUE)
    if kind == "card":
        return _passes_luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed_matches(text: Column, pattern: str) -> Column:
    """``start, end, value`` of each match in order, in code points: matches and what is between add up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def add_run(state: Column, run: Column) -> Column:
        zero = F.struct(state["at"].alias("at"), none.alias("out"))
        return _let(F.aggregate(run, zero, add), lambda done: F.struct(
            done["at"].alias("at"), F.concat(state["out"], F.array(done["out"])).alias("out")))

    def placed(pairs: Column) -> Column:
        # A list that grows by one is copied each time, so short runs are grown and then put together.
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(RUN))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string>>>").alias("out"))
        return F.flatten(F.aggregate(F.transform(starts, lambda s: F.slice(pairs, s, RUN)), zero, add_run)["out"])

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return _let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(_let(pairs, placed)))


def pattern_spans(text: Column) -> Column:
    """``kind, start, end, value`` of all valid matches, by kind as listed, then by start."""
    parts = []
    for kind in KINDS:
        spans = F.filter(placed_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        parts.append(F.transform(spans, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")
        )))
    return F.concat(*parts)


def _entity(kind: Column, value: Column) -> Column:
    """A value in one spelling: emails in lower case, cards and phones as digits."""
    plain = F.when(kind == "email", F.lower(value)).when(kind == "ip", value).otherwise(_digits(value))
    return F.concat(kind, F.lit(":"), plain)


def _free_words(texts: DataFrame) -> DataFrame:
    """``hash, start, end, term`` of all words with a letter that no value touches; ``texts`` has each text once."""
    words = texts.select("hash", F.explode("words").alias("w")).select("hash", "w.start", "w.end", F.lower("w.value").alias("term"))
    values = texts.select("hash", F.explode("spans").alias("s")).select("hash", "s.start", "s.end", F.lit(None).cast("string").alias("term"))
    of_text = Window.partitionBy("hash")
    value = F.col("term").isNull()
    # Values come before words that start with them, and after them in the other direction.
    earlier = of_text.orderBy("start", F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = of_text.orderBy(F.col("start").desc(), F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = words.unionByName(values).withColumn("reached", F.max(F.when(value, F.col("end"))).over(earlier))
    placed = placed.withColumn("next", F.min(F.when(value, F.col("start"))).over(later))
    free = ~value & (F.coalesce(F.col("reached"), F.lit(-1)) < F.col("start")) & F.coalesce(F.col("next") > F.col("end"), F.lit(True))
    return placed.where(free & F.col("term").rlike(r"\p{L}")).select("hash", "start", "end", "term")


def _classes(rows: DataFrame, name: str) -> DataFrame:
    """Entities or terms that stand in the same texts, and in at least ``SUPPORT``, as one class: its name is what
    they have in common, a count of texts and two sums over their hashes."""
    mixed = F.xxhash64("hash", F.lit(name))
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("documents"),
                                  F.struct(F.count(F.lit(1)), F.sum(mixed.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(mixed))).alias("texts_of")
                                  ).where(F.col("texts") >= SUPPORT)


def disclosures(texts: DataFrame, words: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``hash, term, disclosure``: in each of ``texts`` (``hash, copies, spans``), the terms that disclose one of its
    values, with the most they tell; counts are over all of ``docs``, ``words`` are those of ``texts``."""
    copies = texts.select("hash", "copies")
    entity_rows = written(texts.select("hash", "copies", F.explode(F.array_distinct(
        F.transform("spans", lambda s: _entity(s["kind"], s["value"])))).alias("entity")), "entities")
    term_rows = written(words.select("hash", "term").distinct().join(small_side(written(copies, "value-texts")), "hash"), "terms")
    entities = _classes(entity_rows, "entity")
    terms = written(_classes(term_rows, "term"), "term-classes")

    distinct = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_WORD), F.lit(0)))
    every = docs.select(F.explode(distinct).alias("term")).join(small_side(terms.select("term")), "term", "left_semi")
    with_term = written(every.groupBy("term").agg(F.count(F.lit(1)).alias("with_term")), "term-counts")
    total = docs.count()
    counted = terms.join(with_term, "term").withColumn("t", F.xxhash64("texts_of", "with_term"))
    counted = written(counted.select("term", "t", "with_term"), "counted-terms")
    named = written(entities.select("entity", F.xxhash64("texts_of").alias("e"), F.col("documents").alias("with_entity")), "counted-entities")

    of_text = entity_rows.join(small_side(named), "entity").select("hash", "copies", "e", "with_entity").distinct()
    in_text = term_rows.join(small_side(counted), "term").select("hash", "t", "with_term").distinct()
    # The most a pair can have in common is all of the entity.
    reachable = F.col("with_term") <= F.pow("with_entity", F.lit(GENERALISE)) * F.pow(F.lit(float(total)), F.lit(1 - GENERALISE)) * 1.000001
    pairs = written(of_text.join(in_text, "hash").where(reachable).select("hash", "copies", "e", "t", "with_entity", "with_term"), "class-pairs")
    joint = pairs.groupBy("e", "t", "with_entity", "with_term").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("support"))
    share = F.log2(F.col("both") * F.lit(total) / (F.col("with_entity") * F.col("with_term")))
    known = F.log2(F.lit(total) / F.col("with_entity"))
    told = joint.where(F.col("support") >= SUPPORT).select("e", "t", F.when(known > 0, share / known).otherwise(F.lit(0.0)).alias("disclosure"))
    told = written(told.where(F.col("disclosure") >= GENERALISE), "disclosing-classes")
    most = pairs.join(small_side(told), ["e", "t"]).groupBy("hash", "t").agg(F.max("disclosure").alias("disclosure"))
    shown = term_rows.select("hash", "term").join(small_side(counted.select("term", "t")), "term").join(most, ["hash", "t"])
    return shown.select("hash", "term", "disclosure")


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``id, hash, spans, added``.

    ``spans`` are the pattern spans (kind, start, end, value), ``added`` the terms (start, end,
    action: generalise or remove) by start. A term that discloses several entities of the text gets the stronger
    action. Null and empty texts have none; rows that share identifier and text have one
    result; without documents there is nothing. Other columns are not read. An email of
    any length, a run of digits of any length and texts of any length are read whole.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(doc_id).alias("id"), F.xxhash64(content).alias("hash"), content.alias("text"))
    spotted = given.select("id", "hash", "text", pattern_spans(F.col("text")).alias("spans"))
    words = F.when(F.size("spans") > 0, placed_matches(F.col("text"), _WORD))
    found = written(spotted.select("id", "hash", "spans", words.alias("words")), "found-values")

    texts = found.where(F.size("spans") > 0).groupBy("hash").agg(
        F.count(F.lit(1)).alias("copies"), F.first("spans").alias("spans"), F.first("words").alias("words"))
    texts = written(texts, "texts-with-values")
    free = written(_free_words(texts), "free-words")
    told = written(disclosures(texts.select("hash", "copies", "spans"), free, given, "text"), "disclosing-terms")
    marked = free.join(told, ["hash", "term"])
    action = F.when(F.col("disclosure") >= REMOVE, F.lit("remove")).otherwise(F.lit("generalise"))
    marked = marked.select("hash", F.struct("start", "end", action.alias("action")).alias("span"))
    # At most the words of one text.
    added = written(marked.groupBy("hash").agg(F.array_sort(F.collect_list("span")).alias("added")), "added-terms")
    out = found.select("id", "hash", "spans").join(added, "hash", "left")
    empty = F.array().cast("array<struct<start:int,end:int,action:string>>")
    return out.select("id", "hash", "spans", F.coalesce("added", empty).alias("added"))


def sanitized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the text rewritten: values become ``[KIND]``, generalised terms ``[TERM]``, removed ones nothing.

    Of overlapping spans the one that starts first (then the longer) is replaced and the
    others within it go with it. Texts without spans, and null texts, stay as they are.
    """
    mark, spot = fresh(docs.columns, "text_hash", "replacements")
    base = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("order"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    more = F.transform("added", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("order"), F.when(s["action"] == "remove", F.lit("")).otherwise(F.lit("[TERM]")).alias("put")))
    found = personal_data(docs, text, doc_id).where((F.size("spans") > 0) | (F.size("added") > 0))
    found = found.select(F.col("hash").alias(mark), F.array_sort(F.concat(base, more)).alias(spot)).dropDuplicates([mark])
    joined = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit("")))).join(
        small_side(written(found, "replacements")), mark, "left"
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(state: Column, s: Column) -> Column:
        kept = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        moved = F.struct((-s["order"]).alias("at"), F.concat(state["parts"], F.array(kept, s["put"])).alias("parts"))
        covered = F.struct(F.greatest(state["at"], -s["order"]).alias("at"), state["parts"].alias("parts"))
        return F.when(s["start"] >= state["at"], moved).otherwise(covered)

    rewritten = F.aggregate(spot, zero, add, lambda state: F.concat(
        F.array_join(state["parts"], ""), F.substring(F.col(text), state["at"] + 1, F.length(text))))
    return joined.withColumn(text, F.coalesce(rewritten, F.col(text))).drop(mark, spot).select(*docs.columns)


def _listed(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    terms = F.transform("added", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(
        F.col("id").alias("doc_id"), *counts, hex_sha256(F.array_join(_listed(F.col("spans")), ",")).alias("base_sha256"),
        F.array_join(F.concat(_listed(F.col("spans")), _listed(terms)), ",").alias("spans"),
    )
