"""Personal data: four patterns, and the terms that give a protected value away.

Everything is a DataFrame expression. Spans are code-point ranges, end exclusive.

The patterns are leftmost and non-overlapping per kind. They are written with possessive quantifiers
and tied to the beginning of a run (or the end of the last match), which finds the same matches without
backtracking over long runs. A match that fails its check is dropped and not tried again.

The information-theoretic part follows the idea that a term t discloses a value c as far as its pointwise
mutual information with c reaches the information content of c:

    disclosure(t, c) = PMI(t; c) / IC(c),  PMI = log2(n(t,c) N / ((n(t) + 1) n(c))),  IC = log2(N / n(c))

with n counted in documents over the whole corpus. The one added to n(t) stands for a document that holds
the term without the value and has not been seen: it costs a term of two documents 0.58 bits and one of
many nearly nothing, so a rare term must give a value of more information. Candidates are all words of
the documents that hold a value, wherever they stand. A term must stand with the value in ``SUPPORT``
different texts, so that copies of one text are one piece of evidence: in a single text every word that
is new to the corpus would count as giving its values away. Terms at or above ``THRESHOLD`` are added as
spans of kind ``term`` wherever they stand in documents that hold the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import GAP, whole_text
from tidemark.session import written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this cannot match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
BYTE = r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
SUPPORT, THRESHOLD = 2, 0.9
#: Up to so many terms, or texts and places of terms, go to every task (some 10 MB).
FEW_TERMS = 100_000
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        parts = F.split(match, r"\.")
        return F.forall(parts, lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "").rlike(BYTE))
    if kind == "card":
        turned = F.split(F.reverse(digits), "")
        luhn = F.aggregate(F.transform(turned, lambda digit, at: F.when(at % 2 == 0, digit.cast("int")).otherwise(
            digit.cast("int") * 2 - F.when(digit.cast("int") > 4, 9).otherwise(0))), F.lit(0), lambda a, b: a + b)
        return F.when(F.length(digits).between(16, 19), luhn % 10 == 0).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def passing(kind: str):
    return lambda span: passes(kind, span["value"])


def of_kind(code: int):
    return lambda span: span["kind"] == code


def places(text: Column, pattern: Column, code: int) -> Column:
    """All matches with their places: lengths of matches and of what lies between them, summed up."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.aggregate(
        F.arrays_zip(matches.alias("value"), F.slice(between, 1, F.size(matches)).alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found")),
        lambda done, one: F.struct(
            (done["at"] + one["gap"] + F.char_length(one["value"])).alias("at"),
            F.concat(done["found"], F.array(F.struct(
                F.lit(code).alias("kind"), (done["at"] + one["gap"]).alias("start"),
                (done["at"] + one["gap"] + F.char_length(one["value"])).alias("end"), one["value"].alias("value"),
            ))).alias("found")),
        lambda done: done["found"])
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """The spans of the four kinds in order of kind, then start."""
    kinds = []
    for code, kind in enumerate(KINDS):
        found = places(text, F.lit(PATTERNS[kind]), code)
        kinds.append(F.when(text.rlike(NEEDS[kind]), F.filter(found, passing(kind)))
                     .otherwise(F.array().cast(SPAN)))
    return F.concat(*kinds)


def digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(
        ":", F.element_at(names, span["kind"] + 1), span["start"].cast("string"), span["end"].cast("string"))), ",")


def disclosing_terms(texts: DataFrame, told: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``kind, value, term, disclosure``: one row per disclosing pair.

    ``told`` (text, spans) are the rows of ``texts`` (text) that hold a value.
    """
    values = F.array_distinct(F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))
    words = F.array_distinct(F.filter(F.split("text", GAP), lambda word: (F.char_length(word) > 1) & ~word.rlike(r"[@0-9]")))
    n = texts.count()
    # a row per different text; copies count as documents, not as evidence
    hits = written(told.select(F.md5("text").alias("key"), values.alias("values"), words.alias("terms"))
                   .groupBy("key").agg(F.count("*").alias("copies"), F.first("values").alias("values"), F.first("terms").alias("terms")), "pii-hits")
    held = hits.select("key", "copies", F.explode("values").alias("v")).select("key", "copies", "v.*")
    # A term stands in as many documents at least as it stands with values in. Where that alone keeps its
    # disclosure below the threshold, even if every document of the value held it, it need not be counted.
    most = F.col("n_value") * F.pow(F.lit(float(n)) / F.col("n_value"), F.lit(1 - threshold)) * (1 + 1e-9)
    counted = written(held.groupBy("kind", "value").agg(F.sum("copies").alias("n_value"), F.count("*").alias("n_texts"))
                      .where(F.col("n_texts") >= support).select("kind", "value", "n_value", most.alias("most")), "pii-values")
    if counted.isEmpty():
        return counted.select("kind", "value", F.lit("").alias("term"), F.lit(1.0).alias("disclosure")).where("false")
    known = held.select("key", "kind", "value").join(counted, ["kind", "value"])
    limit = known.groupBy("key").agg(F.max("most").alias("limit"))
    standing = hits.join(limit, "key").select("key", "copies", "limit", F.explode("terms").alias("term"))
    beside = (standing.groupBy("term").agg(F.sum("copies").alias("n_near"), F.count("*").alias("n_texts"), F.max("limit").alias("limit"))
              .where((F.col("n_texts") >= support) & (F.col("n_near") <= F.col("limit"))).select("term", "n_near"))
    open_ = standing.join(beside, "term").where("n_near <= limit").select("key", "copies", "term", "n_near")

    def disclosure(n_term: str) -> Column:
        pmi = F.log2(F.col("n_both") * F.lit(float(n)) / ((F.col(n_term) + 1) * F.col("n_value")))
        content = F.log2(F.lit(float(n)) / F.col("n_value"))  # zero where every document holds the value: nothing to disclose
        return F.try_divide(pmi, content)

    together = (open_.join(known, "key").where("n_near <= most").groupBy("kind", "value", "term")
                .agg(F.count("*").alias("texts"), F.sum("copies").alias("n_both"), F.first("n_value").alias("n_value"), F.first("n_near").alias("n_near")))
    candidates = written(together.where((F.col("texts") >= support) & (disclosure("n_near") >= threshold - 1e-9))
                         .select("kind", "value", "term", "n_both", "n_value"), "pii-candidates")
    terms = written(candidates.select("term").distinct(), "pii-terms")
    count = terms.count()
    if not count:
        return candidates.select("kind", "value", "term", F.lit(1.0).alias("disclosure")).where("false")
    # documents (rows, copies included) with a term; both ways add up in each task before anything is exchanged
    standing = texts.select(F.explode(F.array_distinct(F.split("text", GAP))).alias("term"))
    if count <= FEW_TERMS:
        n_term = standing.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n_term"))
    else:
        n_term = standing.groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term")
    scored = candidates.join(n_term, "term").withColumn("disclosure", disclosure("n_term"))
    return written(scored.where(F.col("disclosure") >= threshold).select("kind", "value", "term", "disclosure"), "pii-disclosing")


def term_spans(told: DataFrame, disclosing: DataFrame) -> DataFrame:
    """``_key, _terms``: the places of disclosing terms, per different text that holds their value."""
    edge = "\\x20\\x09-\\x0D"
    held = told.select(F.md5("text").alias("_key"), "text", "spans")
    given = (held.select("_key", F.explode("spans").alias("span")).select("_key", "span.kind", "span.value")
             .join(disclosing, ["kind", "value"]).groupBy("_key").agg(F.collect_set("term").alias("terms")))
    hits = held.select("_key", "text").join(given, "_key").dropDuplicates(["_key"])

    def pattern(term: Column) -> Column:
        return F.concat(F.lit(f"(?<![^{edge}])"), F.lit("\\Q"), term, F.lit("\\E"), F.lit(f"(?![^{edge}])"))

    found = F.transform("terms", lambda term: places(F.col("text"), pattern(term), len(KINDS)))
    return hits.select("_key", F.array_sort(F.flatten(found)).alias("_terms"))


def find(docs: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``spans``, an array of (kind, start, end, value): the base spans, then the terms'.

    Null text counts as empty and has no span, as has any text without a match. Repeated rows get equal
    spans and count as documents each. An empty table gives an empty one. A column named
    ``spans`` is replaced, names that begin with an underscore are reserved, others pass through.

    Only rows that hold a value are written and examined for terms. Where few texts have terms they are sent to
    all tasks; otherwise only rows that hold a value are exchanged, by text.
    """
    texts = docs.drop("spans").withColumn("spans", base_spans(whole_text()))
    told = written(docs.select(whole_text().alias("text")).withColumn("spans", base_spans(F.col("text")))
                   .where(F.size("spans") > 0), "pii-told")
    plain = docs.select(whole_text().alias("text"))
    disclosing = disclosing_terms(plain, told, support, threshold)
    if disclosing.isEmpty():
        return texts
    added = written(term_spans(told, disclosing), "pii-terms-placed")
    size = added.agg(F.count("*").alias("texts"), F.sum(F.size("_terms")).alias("spans")).first()
    key = F.md5(whole_text())
    whole = F.concat("spans", F.coalesce("_terms", F.array().cast(SPAN)))
    if size["texts"] + (size["spans"] or 0) <= FEW_TERMS:
        joined = texts.withColumn("_key", key).join(F.broadcast(added), "_key", "left")
        return joined.withColumn("spans", whole).drop("_key", "_terms")
    holding = texts.where(F.size("spans") > 0).withColumn("_key", key).join(added, "_key", "left")
    return holding.withColumn("spans", whole).drop("_key", "_terms").unionByName(texts.where(F.size("spans") == 0))


def sanitise(found: DataFrame) -> DataFrame:
    """``find``'s rows with every span of ``text`` replaced by its kind in brackets; ``spans`` is dropped.

    Overlapping spans count as one, under the name of the first. Terms are generalised to ``[term]``.
    """
    names = F.array(*[F.lit(f"[{kind}]") for kind in (*KINDS, "term")])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    built = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, s: F.when(s["start"] >= done["at"], F.struct(
            s["end"].alias("at"),
            F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"]), F.element_at(names, s["kind"] + 1)).alias("out")))
        .otherwise(F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))),
        lambda done: F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.lit(2**31 - 1))))
    return found.withColumn("text", F.when(F.size("spans") > 0, built).otherwise(F.col("text"))).drop("spans")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per row of ``find``."""
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    counts = [F.size(F.filter("spans", of_kind(code))).cast("long").alias(f"n_{kind}")
              for code, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
