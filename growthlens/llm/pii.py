"""Personal data: base patterns, and terms whose co-occurrence reveals a protected entity.

DataFrame operations only.  The base patterns find e-mail addresses, IP
addresses, card and phone numbers; each distinct value is a protected entity.
A term (a word in lower case without surrounding punctuation) discloses an
entity e if, over all documents, the share P(e | term) of its occurrences that
lie in lines with e is at least ``GENERALISE``, and that share, shrunk by
``PRIOR`` occurrences without e, at least ``BITS`` bits more than the entity's
own share of words says.  Such terms are personal data of kind ``term`` wherever
they occur: if the shrunk share reaches ``REMOVE`` they are removed, below it
generalised to their kind.

No number of lines is asked for: a name beside one address in its only line is
generalised.  Copies of a line add to the entity's share of words, which lowers
the bits.

Defined cases: null text counts as empty; repeated rows are treated row by
row; null ids are passed on; an empty table gives no rows; a term inside a base
span is part of that span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.llm import common

#: Kinds in their order of listing, and patterns.  A match starts where the last one ended or at the
#: start of a run, and runs are taken whole, which finds the same leftmost matches in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the kind.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-][0-9]", "phone": r"\+[0-9]"}
#: Edges of a word that do not belong to the term.
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
#: Occurrences without the entity that every term is taken to have besides its own.
PRIOR = 1
GENERALISE, REMOVE, BITS = 0.5, 0.9, 8.0
SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the matches in code points, end exclusive."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, v: F.struct(F.char_length(b).alias("skip"), v.alias("value")))
    walk = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda s, m: F.struct(
            (s["at"] + m["skip"] + F.char_length(m["value"])).alias("at"),
            F.concat(s["out"], F.array(F.struct((s["at"] + m["skip"]).alias("start"),
                                               (s["at"] + m["skip"] + F.char_length(m["value"])).alias("end"), m["value"].alias("value")))).alias("out")))
    return walk["out"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    def weighed(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (i % 2 + 1)
        return F.when(twice > 9, twice - 9).otherwise(twice)
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), weighed)
    return F.aggregate(each, F.lit(0), lambda x, y: x + y) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(F.char_length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind; failing matches are dropped without another try."""
    return F.when(text.rlike(HINTS[kind]), F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))).otherwise(
        F.array().cast(SPAN))


def _term(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, EDGES, ""))


def _terms(line: Column) -> Column:
    """Terms of a line, in order; words without letters or digits, or with an @, are none."""
    words = F.filter(F.split(line, r"[ \t\r\x0B\f]+"), lambda w: ~w.contains("@"))
    return F.filter(F.transform(words, _term), lambda t: t.rlike(r"^\p{L}"))


def find_base(docs: DataFrame) -> DataFrame:
    """Settled (row, doc_id, email, ip, card, phone) of ``docs(doc_id, text)``; row names a text within the job."""
    text = F.coalesce("text", F.lit(""))
    return common.written(docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", *(base_spans(text, k).alias(k) for k in KINDS)))


def disclosing_terms(docs: DataFrame, base: DataFrame) -> DataFrame:
    """Settled (term, share, bits; share is shrunk) of the terms that reveal some entity; ``base`` is ``find_base(docs)``."""
    some = F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0
    rows = common.settle(base.where(some).select("row").distinct())
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").join(common.small(rows), "row", "left_semi")
    # entities never span lines, so a line on its own shows the same ones
    def named(kind: str) -> Column:
        return F.transform(base_spans(F.col("line"), kind), lambda m: F.concat(F.lit(f"{kind}:"), m["value"]))
    values = F.array_distinct(F.flatten(F.array(*map(named, KINDS))))
    contexts = (
        texts.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike("|".join(HINTS.values())))
        .withColumn("entities", values).where(F.size("entities") > 0)
        .select(F.xxhash64("line").alias("line"), "entities", _terms(F.col("line")).alias("terms"))
    )
    # equal lines first, so that a line with thousands of copies is one row
    lines = common.settle(contexts.groupBy("line", "entities", "terms").agg(F.count("*").alias("n")))
    by_entity = lines.select("line", "n", F.explode("entities").alias("entity"), "terms")
    met = (
        by_entity.select("line", "n", "entity", F.explode("terms").alias("term"))
        .groupBy("entity", "term", "line").agg(F.sum("n").alias("n"))
        .groupBy("entity", "term").agg(F.sum("n").alias("together"))
    )
    met = common.settle(met.join(by_entity.groupBy("entity").agg(F.sum(F.col("n") * F.size("terms")).alias("entity_words")), "entity"))
    candidates = common.settle(met.select("term").distinct())
    words = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.explode(_terms(F.col("line"))).alias("term"))
    totals = docs.select(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()[0] or 1
    counted = words.join(common.small(candidates), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    shrunk = F.col("together") / (F.col("n") + PRIOR)
    scored = met.join(counted, "term").select("term", (F.col("together") / F.col("n")).alias("plain"), shrunk.alias("share"),
                                              F.log2(shrunk * totals / F.col("entity_words")).alias("bits"))
    return common.settle(
        scored.where((F.col("plain") >= GENERALISE) & (F.col("bits") >= BITS)).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits")))


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Settled (row, term array<struct<start, end, value, share>>) of the places of disclosing terms in all documents."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    few = common.small(terms.select("term", "share"))
    lines = keyed.select("row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hit = common.settle(lines.select("row", "line_no", F.explode(_terms(F.col("line"))).alias("term")).join(few, "term")
                        .groupBy("row").agg(F.collect_set("line_no").alias("hit")))
    at = (
        keyed.join(common.small(hit), "row")
        .withColumn("lines", F.split("text", "\n"))
        .withColumn("starts", F.aggregate(
            F.transform("lines", F.char_length), F.array(F.lit(0)),
            lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n + 1))))
        .select("row", F.explode("hit").alias("line_no"), "lines", "starts")
        .select("row", F.element_at("starts", F.col("line_no") + 1).alias("begin"), F.element_at("lines", F.col("line_no") + 1).alias("line"))
        .select("row", "begin", F.explode(matches(F.col("line"), r"[^ \t\r\x0B\f]+")).alias("w"))
        .where(~F.col("w.value").contains("@"))
        .withColumn("term", _term(F.col("w.value"))).join(few, "term")
        .withColumn("lead", F.char_length(F.regexp_extract("w.value", r"^[^\p{L}\p{N}]*", 0)))
        .select("row", F.struct((F.col("begin") + F.col("w.start") + F.col("lead")).alias("start"),
                                (F.col("begin") + F.col("w.start") + F.col("lead") + F.char_length("term")).alias("end"),
                                F.col("term").alias("value"), "share").alias("span"))
    )
    return common.settle(at.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("term")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(row, doc_id, email, ip, card, phone, term) of each document: spans of every kind."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = find_base(texts)
    terms = disclosing_terms(texts, base)
    spans = term_spans(texts, terms)
    none = F.array().cast("array<struct<start:int,end:int,value:string,share:double>>")
    found = base.join(common.small(spans), "row", "left")
    outside = F.filter("term", lambda t: ~F.exists(
        F.concat(*KINDS), lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return found.withColumn("term", F.coalesce(outside, none))


def _listed(kinds: tuple[str, ...]) -> Column:
    def part(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.concat_ws(":", F.lit(kind), m["start"].cast("string"), m["end"].cast("string")))
    return F.array_join(F.concat(*map(part, kinds)), ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of each document."""
    found = find_personal_data(docs)
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_listed(KINDS), 256).alias("base_sha256"),
        _listed((*KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with base spans and disclosing terms replaced by their kind, or removed; null text stays."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    found = find_personal_data(docs).drop("doc_id").dropDuplicates(["row"])

    def swap(kind: str) -> Column:
        return F.transform(F.col(kind), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("put")))
    swaps = [swap(k) for k in KINDS]
    swaps.append(F.transform("term", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"),
                                                         F.when(m["share"] >= REMOVE, "").otherwise("[TERM]").alias("put"))))
    walked = F.aggregate(
        F.array_sort(F.concat(*swaps)), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, m: F.when(m["start"] < s["at"], F.struct(F.greatest(s["at"], m["end"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(m["end"].alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, m["start"] - s["at"]), m["put"]).alias("out"))))
    joined = texts.join(found, "row", "left").withColumn("walked", walked)
    return joined.select("doc_id", F.when(
        F.col("text").isNotNull(), F.concat("walked.out", F.substring(F.col("text"), F.col("walked.at") + 1, F.char_length("text")))).alias("text"))
