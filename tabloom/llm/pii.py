r"""Personal data and what gives it away, by information theory; DataFrame functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone
numbers, and secrets (passwords, keys and tokens that are named so). The corpus then tells which other words disclose them. For a term t and
an entity e, with D documents in the corpus,

    p(e)   = documents with e / D
    p(e|t) = (documents with t and e + PRIOR p(e)) / (documents with t + PRIOR)
    IC(e)  = -log p(e)
    disclosure(t, e) = 1 + log p(e|t) / IC(e)

which is the share of the entity's information that the term reveals (their
pointwise mutual information over IC(e)). PRIOR documents as the corpus has them
stand against chance, so a term of one document counts for half. An entity is a
value, and also a kind, with the documents of all its values: values hardly ever come
twice, and their kind has the support that they lack. A term whose disclosure is
DISCLOSURE at least is sanitised wherever it stands in the documents with the entity.

Terms are counted once for each document. Two exact steps keep the pairs few: a
document has a term with a value only if it has it with the value's kind, so terms
that can't reach the threshold for any value of a kind go first; and values that
the same documents hold have the same counts, so they are one set of documents.

``sanitise`` puts placeholders for both. Texts are scanned for mentions, for the
counts of words, and those with mentions again for their words and the places of
the terms; the counts are partial sums before they are shuffled.

The patterns equal the plain ones that they stand for, but can't run in squares of
a text's length or need deep stacks: possessive quantifiers, and looks behind that
stop attempts inside a run that was tried from its start.

Defined cases: NULL texts are empty; ids are keys, and repeated rows count as
further documents in the sums; rows with NULL ids have their own entities
but no terms; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.minhash import small
from tabloom.sources.files import materialise

DISCLOSURE = 0.9
PRIOR = 1.0
TERM = r"[\p{L}\p{N}]+"

# The base kinds in their order, and their patterns.
BASE = ("email", "ip", "card", "phone")
#: And what is a secret: something named as one, an equals sign or colon, and a run of letters, digits and signs.
KINDS = (*BASE, "secret")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?i)(?<![\p{L}\p{N}])(?:token|secret|password|passwd|(?:api|access|private)[_-]?key)[\"']?[ ]?[=:][ ]?[\"']?[A-Za-z0-9+/_.~-]{12,}+[=\"']*+",
}
#: Without one of these in it a text can't match.
SIGNS = {"email": "@", "ip": ".", "card": "", "phone": "+", "secret": "=:"}
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int")
        return F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z")
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


_SPAN = "struct<start: int, end: int, value: string>"


def located(text: Column, pattern: str) -> Column:
    """The matches of a pattern as an array of (start, end, value): what lies between matches and what
    matches alternate, so lengths add up to places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps"))
    # a transform of one element names a value, so that it is computed once
    return F.element_at(F.transform(F.array(both), lambda b: _placed(b["found"], b["gaps"])), 1)


#: Elements of a run whose sums are worked out one by one.
RUN = 256


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _summed(numbers: Column) -> Column:
    """struct(at, out): the sum of a short array and, for each element, the sum of those before."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(numbers, empty, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))


def _before(numbers: Column) -> Column:
    """For each element of an array (not an empty one) the sum of those before: run by run, then the runs' own sums."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / RUN).cast("int")), lambda i: _summed(F.slice(numbers, i * RUN + 1, F.lit(RUN))))

    def joined(each: Column) -> Column:
        starts = _summed(F.transform(each, lambda r: r["at"]))["out"]
        return F.flatten(F.zip_with(each, starts, lambda r, s: F.transform(r["out"], lambda x: x + s)))

    return _named(runs, joined)


def _placed(found: Column, gaps: Column) -> Column:
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda f, g: F.struct(f.alias("value"), F.length(g).alias("gap")))

    def spans(each: Column) -> Column:
        starts = _named(F.transform(each, lambda p: p["gap"] + F.length(p["value"])), _before)
        return F.zip_with(each, starts, lambda p, s: F.struct((s + p["gap"]).alias("start"), (s + p["gap"] + F.length(p["value"])).alias("end"), p["value"].alias("value")))

    return F.when(F.size(found) > 0, _named(pairs, spans))


def entities(text: Column, kind: str) -> Column:
    """The valid mentions of a kind as ``located`` gives them; a failing match isn't tried again."""
    signs = [F.contains(text, F.lit(c)) for c in SIGNS[kind]]
    may = reduce(or_, signs) if signs else text.rlike("[0-9](?:[ -]?[0-9]){15}")
    spans = F.when(may, located(text, PATTERNS[kind]))
    return F.coalesce(F.filter(spans, lambda s: _valid(kind, s["value"])), F.array().cast(f"array<{_SPAN}>"))


def find_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, secret): the mentions of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *(entities(text, k).alias(k) for k in KINDS))


def _entity(kind: str, span: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(span["value"]))


def _entity_names(kind: str) -> Column:
    return F.transform(kind, lambda s: _entity(kind, s))


def _terms(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): the documents of each term."""
    return docs.select(F.explode(_terms("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _document_sets(found: DataFrame) -> DataFrame:
    """(doc_id, kind, held, f1, f2): the sets of documents, of ``held`` rows, that values of the kind are in; f1 and f2 name a set."""
    def named(kind: str) -> Column:
        return F.transform(F.array_distinct(_entity_names(kind)), lambda e: F.struct(F.lit(kind).alias("kind"), e.alias("entity")))

    names = [named(k) for k in KINDS]
    rows = materialise(found.where("doc_id is not null").select("doc_id", F.explode(F.concat(*names)).alias("e")).select("doc_id", "e.*"), "values")
    name = [F.sum(F.xxhash64(F.lit(i), "doc_id").cast("decimal(38,0)")).alias(f"f{i}") for i in (1, 2)]
    sets = rows.groupBy("entity").agg(F.count("*").alias("held"), *name)
    return rows.join(sets, "entity").select("doc_id", "kind", "held", "f1", "f2").distinct()


def disclosing_terms(docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """(doc_id, term): the terms of each document that give one of its values or kinds away."""
    kinds = F.filter(F.array(*(F.when(F.size(k) > 0, F.lit(k)) for k in KINDS)), lambda k: k.isNotNull())
    some = found.where(F.col("doc_id").isNotNull() & (F.size(F.concat(*KINDS)) > 0)).select("doc_id", kinds.alias("kinds"))
    total = float(max(1, found.count()))
    of_kind = some.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("held"))
    held = some.distinct().groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    texts = docs.select("doc_id", "text").join(small(materialise(held, "holders")), "doc_id")
    words = materialise(texts.select("doc_id", "kinds", F.explode(_terms("text")).alias("term")).select("doc_id", F.explode("kinds").alias("kind"), "term"), "words")

    def given(both: str, p: Column) -> Column:
        return F.least((F.col(both) + prior * p) / (F.col("n") + prior), F.lit(1.0))

    def told(both: str) -> Column:
        p = F.col("held") / total
        return F.lit(1.0) + F.try_divide(F.ln(given(both, p)), -F.ln(p)) >= disclosure

    known = words.groupBy("kind", "term").agg(F.count("*").alias("in_kind")).join(term_counts(docs), "term")
    # p(e) is 1 / D at least and 1 at most
    may = known.where(given("in_kind", F.lit(1.0)) >= F.lit(total ** (disclosure - 1) * (1 - 1e-9)))
    may = may.join(F.broadcast(of_kind), "kind").select("kind", "term", "n", told("in_kind").alias("by_kind"))
    near = materialise(words.join(materialise(may, "may"), ["kind", "term"]), "near")
    name = ["held", "f1", "f2"]
    pairs = near.join(_document_sets(found), ["doc_id", "kind"]).select("doc_id", "term", "n", *name)
    # a set of values of two kinds is one; rows of a repeated id count each
    both = near.groupBy("doc_id", "term").agg((F.count("*") / F.count_distinct("kind")).alias("rows"))
    pairs = materialise(pairs.distinct().join(both, ["doc_id", "term"]), "pairs")
    by_set = pairs.groupBy("term", *name).agg(F.sum("rows").alias("both"), F.first("n").alias("n")).where(told("both"))
    by_set = pairs.join(by_set.select("term", *name), ["term", *name], "left_semi")
    return near.where("by_kind").select("doc_id", "term").union(by_set.select("doc_id", "term")).distinct()


def _places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, start, end): all places of each document's terms, but those of words that reach into mentions.

    Words and what lies between them alternate, so lengths add up to places. In the
    order of places, a word is apart from all mentions if none that starts before its
    end ends after its start.
    """
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).join(small(terms.select("doc_id").distinct()), "doc_id", "left_semi")
    pieces = rows.select("doc_id", "row", F.posexplode(F.regexp_extract_all("text", F.lit(rf"{TERM}|[^\p{{L}}\p{{N}}]+"), F.lit(0))).alias("at", "piece"))
    end = F.sum(F.length("piece")).over(Window.partitionBy("row").orderBy("at")).cast("int")
    pieces = pieces.select("doc_id", "row", F.lower("piece").alias("term"), (end - F.length("piece")).alias("start"), end.alias("end"))
    words = pieces.join(terms, ["doc_id", "term"], "left_semi").select("doc_id", "row", "start", "end", F.col("end").alias("place"), F.lit(0).alias("mention"))
    mentions = rows.select("doc_id", "row", F.explode(F.concat(*(F.transform(entities(F.col("text"), k), lambda s: F.struct(s["start"], s["end"])) for k in KINDS))).alias("s"))
    mentions = mentions.select("doc_id", "row", "s.start", "s.end", F.col("s.start").alias("place"), F.lit(1).alias("mention"))
    reached = F.max(F.when(F.col("mention") == 1, F.col("end"))).over(Window.partitionBy("row").orderBy("place", "mention").rowsBetween(Window.unboundedPreceding, -1))
    every = words.union(mentions).withColumn("reached", reached)
    return every.where("mention = 0 and coalesce(reached, 0) <= start").select("doc_id", "start", "end")


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, secret, term) with arrays of (start, end, ...), each in the order of starts."""
    found = materialise(find_entities(docs), "entities")
    terms = _places(docs, materialise(disclosing_terms(docs, found), "terms"))
    terms = terms.groupBy(F.col("doc_id").alias("_id")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("term"))
    out = found.join(terms, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    return out.withColumn("term", F.coalesce("term", F.array().cast("array<struct<start: int, end: int>>")))


def span_digest(docs: DataFrame) -> DataFrame:
    """For each document the numbers of mentions, a hash of the base kinds' spans, all spans, and numbers of secrets, terms and spans."""
    found = find_spans(docs)
    base = F.array_join(F.concat(*(_listed(F.col(k), k) for k in BASE)), ",")
    spans = F.array_join(F.concat(*(_listed(F.col(k), k) for k in (*KINDS, "term"))), ",")
    sizes = {k: F.size(k).cast("long") for k in (*KINDS, "term")}
    return found.select(
        "doc_id",
        *(sizes[k].alias(f"n_{k}") for k in BASE),
        F.sha2(base, 256).alias("base_sha256"),
        spans.alias("spans"),
        *(sizes[k].alias(f"n_{k}") for k in ("secret", "term")),
        reduce(add, sizes.values()).alias("n_spans"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with placeholders for mentions ([EMAIL], ...) and for terms that give them away ([TERM])."""
    found = find_spans(docs)

    def marked(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    every = F.concat(*(marked(k) for k in (*KINDS, "term")))
    some = found.select(F.col("doc_id").alias("_id"), F.array_sort(every).alias("_spans")).where(F.size("_spans") > 0)
    some = some.dropDuplicates(["_id"])
    text = F.col("text")

    def put(acc: Column, s: Column) -> Column:
        # of spans that overlap, the first stands for all
        ahead = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["mark"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate("_spans", start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = docs.join(some, F.col("doc_id") == F.col("_id"), "left").withColumn("text", F.when(F.col("_spans").isNull(), text).otherwise(done))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(docs.columns)
