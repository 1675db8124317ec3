"""Personal data: patterns and information-theoretic sanitisation (operator 5).

Two kinds of spans are found, both with DataFrame functions only.

Patterns find e-mail and IP addresses, card and phone numbers. A text is split at
a pattern; the lengths of what lies between the matches and of the matches give
their places in code points. Matches that fail their check (digits, range, Luhn)
are dropped.

What a pattern has found is protected. Single values hardly repeat, so entities come in three
sizes: the value, what several values share (an address's domain, a network, an issuer of cards, a
dialling code) and the kind. Other words may reveal an entity: those that hardly occur without it, be they
names beside it or pieces of a value that stand alone. The corpus says how strongly: for a term t that
stands in or within ``CONTEXT`` characters of mentions of the entity e, in ``joint`` of
``N`` documents, the information that t gives about e is
log(N * joint / (df(t) * df(e))), and all there is to know is log(N / df(e)).
Their ratio is the disclosure of e by t: 1 if t never occurs without e. Terms
with a disclosure of ``GENERALISE`` or more are generalised to their kind, those with
``REMOVE`` or more removed, wherever they occur in the corpus outside of base spans. They need ``SUPPORT``
pieces of evidence, so that copies of one text prove nothing: for a value these are mentions with
different surroundings, be they in one document or in several; for what values share and for kinds, different values.

Document frequencies cover all words of all documents. Pairs of a term and an entity with enough evidence are few; words are
reduced to their terms before they are shuffled, by a broadcast while they are at most ``BROADCAST_TERMS``, and
beyond that after they are summed up. No join is on an entity until those terms are left whose disclosure can be
reached at all (joint / df(t) is at least (joint / N) to the power of 1 - disclosure), and the join on
terms deals out a term's entities over ``SALTS`` tasks.

Edge cases: a null text counts as empty, and has no spans; repeated rows give
equal rows; rows with the same id and other texts, or a null id, are kept apart;
an empty table gives an empty table; in sanitised text overlapping spans are
replaced as one, by what stands for the first; columns of the input keep their names and values, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundweave.llm.common import saved

#: Patterns by kind, in the order of the kinds. They match what the plain forms
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` (of 14 to 19 digits) and ``\+[0-9][\x20().0-9-]+[0-9]`` match,
#: but don't start again within a run of characters, so that time is in proportion to the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PATTERNS, "term"]
CONTEXT = 80
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
BROADCAST_TERMS = 200_000
#: Parts that the entities of a term are dealt out to.
SALTS = 16
#: A term is a word of letters and digits with at least three characters.
TERM = r"[\p{L}\p{N}]{3,}"
WORD = r"[\p{L}\p{N}]*"


def _luhn(number: Column) -> Column:
    digits = F.reverse(F.regexp_replace(number, "[^0-9]", ""))
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    """Whether a match is what it looks like."""
    if kind == "ip":
        # a part is at most 255: without leading zeros it has up to three digits, and is no more than that
        small = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(small, lambda p: F.when(F.length(p) > 3, False).otherwise(p.cast("int") <= 255))
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


SPAN = "struct<start:int,kind:int,end:int,value:string,context:string>"


def _spans(kind: str, text: Column) -> Column:
    """Spans of one kind in a text, in order, as SPAN."""
    pattern, no = PATTERNS[kind], KINDS.index(kind)
    none = F.array().cast(f"array<{SPAN}>")
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.length(x["match"])
        # what stands before and after, over neighbouring matches, without words that are cut
        behind = F.concat(acc["tail"], x["before"])
        ahead = F.concat(F.substring(x["after"], 1, CONTEXT + 1), F.coalesce(x["next"], F.lit("")), F.substring(F.coalesce(x["beyond"], F.lit("")), 1, CONTEXT + 1))
        left = F.when(F.length(behind) > CONTEXT, F.regexp_replace(F.right(behind, F.lit(CONTEXT + 1)), rf"^{WORD}", "")).otherwise(behind)
        right = F.when(F.length(ahead) > CONTEXT, F.regexp_replace(F.substring(ahead, 1, CONTEXT + 1), rf"{WORD}$", "")).otherwise(ahead)
        span = F.struct(begin.alias("start"), F.lit(no).alias("kind"), end.alias("end"), x["match"].alias("value"), F.concat(left, F.lit(" \n "), right).alias("context"))
        spans = F.when(_passes(kind, x["match"]), F.array_append(acc["spans"], span.cast(SPAN))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), F.right(F.concat(behind, x["match"]), F.lit(CONTEXT + 1)).alias("tail"), spans.alias("spans"))

    n = F.size(matches)
    parts = F.arrays_zip(
        F.slice(between, F.lit(1), n).alias("before"), matches.alias("match"), F.slice(between, F.lit(2), n).alias("after"),
        F.slice(matches, F.lit(2), n).alias("next"), F.slice(between, F.lit(3), n).alias("beyond"),
    )
    found = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    there = F.rlike(text, F.lit(pattern))
    if HINTS[kind]:
        there = F.contains(text, F.lit(HINTS[kind])) & there
    return F.when(there, found).otherwise(none)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_hash and text (null as empty) of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.xxhash64(body).alias("text_hash"), body.alias("text"))


def pattern_spans(rows: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans`` of keyed rows: base spans in order."""
    found = rows.select("doc_id", "text_hash", *(_spans(kind, F.col("text")).alias(kind) for kind in PATTERNS))
    return found.select("doc_id", "text_hash", F.sort_array(F.concat(*PATTERNS)).alias("spans"))


def _terms(text: Column) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def _shared(kind: Column, value: Column) -> Column:
    """What a value of a kind has in common with others: domain, network, issuer or dialling code."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = [F.substring_index(value, "@", -1), F.substring_index(value, ".", 2), F.substring(digits, 1, 6), F.substring(digits, 1, 4)]
    return F.element_at(F.array(*parts), kind + 1)


def mentions_of(spans: DataFrame) -> DataFrame:
    """``doc_id, text_hash, entity, evidence, terms``: a row for each entity, small and large, of every base span.

    ``evidence`` tells apart what counts as support for a term.
    """
    s = spans.filter(F.size("spans") > 0).select("doc_id", "text_hash", F.explode("spans").alias("s"))
    s = s.select("doc_id", "text_hash", F.col("s.kind").alias("kind"), F.lower("s.value").alias("value"), F.col("s.context").alias("context"))
    of_value = F.xxhash64("value")
    entity = lambda size, name, evidence: F.struct(F.concat_ws(":", F.lit(size), F.col("kind"), name).alias("entity"), evidence.alias("evidence"))
    entities = F.array(entity("value", F.col("value"), F.xxhash64("context")), entity("shared", _shared(F.col("kind"), F.col("value")), of_value), entity("kind", F.lit(""), of_value))
    terms = _terms(F.concat_ws(" ", "context", "value"))
    return s.select("doc_id", "text_hash", terms.alias("terms"), F.explode(entities).alias("e")).select("doc_id", "text_hash", "e.entity", "e.evidence", "terms")


def disclosing_terms(rows: DataFrame, spans: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """``term, disclosure``: terms that reveal an entity, with the most they reveal.

    ``rows`` are keyed, ``spans`` are their pattern spans.
    """
    mentions = mentions_of(spans)
    doc = F.struct("doc_id", "text_hash")
    near = mentions.withColumn("term", F.explode("terms"))
    pairs = near.groupBy("entity", "term").agg(F.count_distinct(doc).alias("joint"), F.count_distinct("evidence").alias("support")).filter(F.col("support") >= support)
    pairs = saved(pairs.select("entity", "term", "joint"), "pairs")
    n = rows.count()
    words = rows.select(F.explode(_terms(F.col("text"))).alias("term"))
    count = F.count(F.lit(1)).alias("df_term")
    if pairs.count() <= BROADCAST_TERMS:
        counts = words.join(F.broadcast(pairs.select("term")), "term", "left_semi").groupBy("term").agg(count)
    else:
        counts = words.groupBy("term").agg(count).join(pairs.select("term"), "term", "left_semi")
    salt = F.pmod(F.xxhash64("entity"), F.lit(SALTS)).cast("int")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = pairs.withColumn("salt", salt).join(salted, ["term", "salt"])
    # joint is at most the entity's document frequency, so no other pair can reach the least disclosure
    told = told.filter(F.col("joint") / F.col("df_term") >= F.pow(F.col("joint") / F.lit(float(max(n, 1))), F.lit(1 - least)) * (1 - 1e-9))
    of_entity = mentions.select("entity", "doc_id", "text_hash").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    told = told.join(of_entity, "entity")
    known = F.log(F.lit(float(n)) / F.col("df_entity"))
    given = F.log(F.lit(float(n)) * F.col("joint") / (F.col("df_term") * F.col("df_entity")))
    told = told.withColumn("disclosure", F.when(known > 0, given / known))
    return told.filter(F.col("disclosure") >= least).groupBy("term").agg(F.max("disclosure").alias("disclosure"))


def _small(terms: DataFrame) -> DataFrame:
    """Broadcast if there are few; else the join is a shuffle."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, text_hash, terms``: spans of the given terms in the keyed rows that hold any.

    A span's value says what becomes of the term: ``remove`` or ``generalise``.
    """
    held = rows.select("doc_id", "text_hash", F.explode(_terms(F.col("text"))).alias("term")).join(_small(terms), "term")
    held = held.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("term", "disclosure")))).alias("held"))
    held = held.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    texts = rows.join(held, rows["doc_id"].eqNullSafe(held["__id"]) & (rows["text_hash"] == held["__hash"])).select("doc_id", "text_hash", "text", "held")
    none = F.array().cast(f"array<{SPAN}>")
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    parts = F.arrays_zip(F.split("text", TERM, -1).alias("before"), words.alias("word"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.coalesce(F.length(x["word"]), F.lit(0))
        told = F.element_at("held", F.lower(F.coalesce(x["word"], F.lit(""))))
        what = F.when(told >= REMOVE, "remove").otherwise("generalise")
        span = F.struct(begin.alias("start"), F.lit(KINDS.index("term")).alias("kind"), end.alias("end"), what.alias("value"), F.lit("").alias("context"))
        return F.struct(end.alias("at"), F.when(told.isNotNull(), F.array_append(acc["spans"], span.cast(SPAN))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return texts.select("doc_id", "text_hash", found.alias("terms")).dropDuplicates(["doc_id", "text_hash"])


def all_spans(docs: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """``doc_id, text_hash, base, spans`` of every row: base spans, and all spans in order."""
    rows = keyed(docs, text)
    base = saved(pattern_spans(rows), "spans")
    terms = saved(disclosing_terms(rows, base, support), "terms")
    more = term_spans(rows, terms)
    both = base.join(more, base["doc_id"].eqNullSafe(more["doc_id"]) & (base["text_hash"] == more["text_hash"]), "left")
    added = F.filter(F.coalesce("terms", F.array().cast(f"array<{SPAN}>")), lambda t: ~F.exists("spans", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return both.select(base["doc_id"], base["text_hash"], base["spans"].alias("base"), F.sort_array(F.concat("spans", added)).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """``doc_id``, counts by kind, the digest of the base spans, and all spans, of every row."""
    found = all_spans(docs, text, support)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    *counts, terms = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), terms)


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """``docs`` with all spans of the text replaced; ``n_chars``, if there, follows the text."""
    found = all_spans(docs, text, support).filter(F.size("spans") > 0).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "spans").dropDuplicates(["found_id", "found_hash"])
    # the row goes along as one column, so none of its names can clash with those of spans
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    both = rows.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("hash") == F.col("found_hash")), "left")
    stand_in = F.array(*(F.lit(f"<{kind.upper()}>") for kind in KINDS))
    body = F.col("row").getField(text)

    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["value"] == "remove", "").otherwise(F.element_at(stand_in, s["kind"] + 1))
        put = F.when(s["kind"] == KINDS.index("term"), put).otherwise(F.element_at(stand_in, s["kind"] + 1))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), put)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    made = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    both = both.withColumn("made", F.when(F.col("spans").isNotNull(), made))
    put = {c: F.col("row").getField(c) for c in docs.columns}
    put[text] = F.coalesce("made", put[text])
    if "n_chars" in put:
        put["n_chars"] = F.coalesce(F.length("made").cast(docs.schema["n_chars"].dataType), put["n_chars"])
    return both.select(*(column.alias(c) for c, column in put.items()))
