r"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

A line is normalised to its words (runs of letters) in lower case, a space between
them. Its SimHash has 126 bits, two longs of 63: each bit is set if more than half of
the hashes of its words of LONG letters or more have it (of all its words if it has no
such). Two lines are linked if their edit similarity (1 - Levenshtein distance / the
longer length) is SIMILARITY at least and at most DISTANCE bits differ. Edits are
counted in letters for lines of IN_LETTERS characters at most, in words for longer
ones, where words stand for each other if they share one of CODES codes; there IN_WORDS
is the similarity asked for.

Blocks: each of KEYS keys takes BITS neighbouring bits of one of the longs and a cell of
the lengths (lines of like length; the cells of different keys are shifted against
each other). Lines that agree on a key are candidates. Neither number depends on the
table, so whether two lines are linked depends on these two alone; chance mates of a
key grow with the lines, and their sketches are compared. By the
pigeonhole principle pairs that differ in fewer bits than there are keys apart are
found for certain. Of each connected group of lines the first occurrence, by document
id and line number, stays.

Equal lines are one class from the start, by two 64-bit hashes. Lines whose buckets
hold no line with a like sketch (the other long) leave before any more is
known of them; parities of groups of words bound from below how many words two lines
differ in, so that lines that share a passage only aren't compared; buckets are worked off as in graph.bucket_components, without making
all pairs. All is done with DataFrame functions; texts are read for the SimHashes, and
again for the lines that are compared.

The bits of a line's words are added up STEP words at a time, all bits of a long at
once, and summed by a grouped aggregate, PER counters of 16 bits to a long.

Defined cases: lines without letters stay as they are; NULL texts have no lines, empty
ones have one; ids are keys, and rows that repeat one with its text keep the same
lines; rows without id stay as they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.graph import bucket_components
from tabloom.llm.minhash import small
from tabloom.sources.files import materialise, shuffles_deleted

SIMILARITY = (9, 10)
#: In words, as one changed letter changes a word.
IN_WORDS = (88, 100)
DISTANCE = 32
#: How many bits of the other long may differ.
SKETCH = 18
#: Bits of a key, and keys of a line, for tables of any size.
BITS = 18
KEYS = 26
#: Lengths of a cell differ by this factor at most.
CELL = 1.6

SIDE = 63
_LANE = 16
#: Counters of a long; bit j + k * _LANE is counted in the lane k of the sum j.
PER = 4
_LANES = sum(1 << (_LANE * k) for k in range(PER))
#: As in graph.bucket_components: pairs of lines cost more than bounds, so stars go on for longer.
DENSE = 60
#: Edits are counted in letters where the longer line has so many characters at most, else in words.
IN_LETTERS = 128
CODES = 20_000
#: Letters of the words that count; shorter ones are too common to tell lines apart, and count in lines that have no others.
LONG = 4
#: Words whose bits are summed in one row: what a counter can hold with its carry.
TURN = 16_000
#: Words whose bits are added up before they reach the counters: what three binary digits can tell.
STEP = 7


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{M}]+"), "")


def normalised(line: Column) -> Column:
    return F.array_join(words_of(line), " ")


def coded(words: Column) -> Column:
    """A text of one character for each word, one of CODES by its hash."""
    code = lambda w: F.hex(F.lit(0x4E00) + F.pmod(F.xxhash64(w), F.lit(CODES)))
    return F.decode(F.unhex(F.array_join(F.transform(words, code), "")), "UTF-16BE")


def _exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of each line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _any_bits(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _signs(side: int) -> Column:
    """The bits of one long from the counters of a line of TURN words at most: a counter above half carries."""
    over = [F.shiftrightunsigned(F.col(f"l{side}_{j}") + F.col("halves"), _LANE - 2).bitwiseAND(F.lit(_LANES)) for j in range(_LANE)]
    return _any_bits([F.shiftleft(c, j) for j, c in enumerate(over)]).bitwiseAND(F.lit((1 << SIDE) - 1))


def _written(df: DataFrame, name: str) -> DataFrame:
    """Materialised, and the files of its shuffles deleted at once."""
    with shuffles_deleted(df.sparkSession):
        return materialise(df, name)


def _planes(words: list[Column]) -> list[Column]:
    """The three binary digits of how many of STEP longs have a bit, for all bits at once."""
    adder = lambda a, b, c: (a.bitwiseXOR(b).bitwiseXOR(c), a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b))))
    one, two = adder(*words[:3])
    one, two_ = adder(one, *words[3:5])
    one, two__ = adder(one, *words[5:])
    two, four = adder(two, two_, two__)
    return [one, two, four]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, h1, h2, n, size, s0, s1, p0, p1): a row for each line with letters of the documents with ids; size is
    its number of words, p0 and p1 tell which of 128 groups of its long words are odd in number."""
    rows = _exploded(docs.where("doc_id is not null")).select("doc_id", "line_no", words_of(F.col("line")).alias("words"))
    rows = rows.select("doc_id", "line_no", "words", F.array_join("words", " ").alias("norm"), F.monotonically_increasing_id().alias("row"))
    facts = ["line_no", "h1", "h2", "n", "size"]
    # all that is said of a line comes before its words are dealt out, else it would be worked out for each of them
    rows = rows.select("doc_id", "row", "line_no", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), F.length("norm").alias("n"), F.size("words").alias("size"), F.rlike("norm", F.lit(f"[^ ]{{{LONG}}}")).alias("long"), "words")
    # STEP words to a row of the sums; what stands for a word that doesn't count has no bits
    steps = rows.where("size > 0").select("doc_id", "row", *facts, "long", "words", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(STEP))).alias("at"))
    steps = steps.select("doc_id", "row", *facts, "long", F.expr(f"at div {TURN}").alias("turn"), *(F.get("words", F.col("at") + i).alias(f"word{i}") for i in range(STEP)))
    counts = [F.col(f"word{i}").isNotNull() & (~F.col("long") | (F.length(f"word{i}") >= LONG)) for i in range(STEP)]
    steps = steps.select("doc_id", "row", *facts, "long", "turn", *(f"word{i}" for i in range(STEP)), *(c.alias(f"c{i}") for i, c in enumerate(counts)))
    none = F.lit(0).cast("long")
    hashed = [F.when(F.col(f"c{i}"), h).otherwise(none).alias(f"w{s}_{i}") for i in range(STEP) for s, h in enumerate((F.xxhash64(f"word{i}"), F.xxhash64(F.lit(1), f"word{i}")))]
    steps = steps.select("doc_id", "row", *facts, "long", "turn", *(f"c{i}" for i in range(STEP)), *hashed)
    # a bit for each of 128 groups of long words: is their number odd
    own = lambda s, i: F.col("long") & F.col(f"c{i}") & (F.shiftrightunsigned(f"w0_{i}", 6).bitwiseAND(F.lit(1)) == s)
    group = lambda s, i: F.when(own(s, i), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"w0_{i}").bitwiseAND(F.lit(63)).cast("int"))).otherwise(none)
    odd = [reduce(lambda a, b: a.bitwiseXOR(b), (group(s, i) for i in range(STEP))).alias(f"o{s}") for s in (0, 1)]
    used = sum((F.col(f"c{i}").cast("int") for i in range(STEP)), F.lit(0))
    planes = [c.alias(f"b{s}_{d}") for s in (0, 1) for d, c in enumerate(_planes([F.col(f"w{s}_{i}") for i in range(STEP)]))]
    steps = steps.select("doc_id", "row", *facts, "turn", used.alias("used"), *odd, *planes)
    lane = lambda s, j: _any_bits([F.shiftleft(F.shiftrightunsigned(f"b{s}_{d}", j).bitwiseAND(F.lit(_LANES)), d) for d in range(3)])
    sums = [F.sum(lane(s, j)).alias(f"l{s}_{j}") for s in (0, 1) for j in range(_LANE)]
    # few and narrow keys; what is known of a line is the same in all its rows
    counters = steps.groupBy("doc_id", "row", "turn").agg(*(F.max(c).alias(c) for c in facts), F.sum("used").alias("used"), *sums, *(F.bit_xor(f"o{s}").alias(f"p{s}") for s in (0, 1)))
    # counters are kept of longer lines only
    short = F.col("size") <= TURN
    lanes = F.array(*(F.col(f"l{s}_{j}") for s in (0, 1) for j in range(_LANE)))
    # the filter, which all rows pass, keeps what follows out of the aggregate's own code: the JVM compiles no method beyond 8,000 bytes
    counters = counters.where("used > 0").withColumn("halves", (F.lit((1 << (_LANE - 2)) - 1) - F.expr("used div 2")) * F.lit(_LANES))
    table = _written(counters.select("doc_id", "row", *facts, "used", "p0", "p1", *(F.when(short, _signs(s)).alias(f"s{s}") for s in (0, 1)), F.when(~short, lanes).alias("lanes")), "lines")
    named = ["doc_id", *facts, "p0", "p1"]
    out = table.where(short).select(*named, "s0", "s1")
    if not table.where(~short).head(1):
        return out
    # longer lines: their turns' counters, a row for each bit, and the bits put together
    bits = F.flatten(F.transform("lanes", lambda x: F.transform(F.sequence(F.lit(0), F.lit(PER - 1)), lambda t: F.call_function("shiftrightunsigned", x, (t * _LANE).cast("int")).bitwiseAND(F.lit((1 << _LANE) - 1)))))
    long = table.where(~short)
    known = long.groupBy("doc_id", "row", *facts).agg(F.sum("used").alias("used"), *(F.bit_xor(p).alias(p) for p in ("p0", "p1")))
    sums = long.select("row", F.posexplode(bits).alias("at", "count")).groupBy("row", "at").agg(F.sum("count").alias("count"))
    own = sums.join(known.select("row", "used"), "row").where(F.col("count") * 2 > F.col("used"))
    side, bit = F.expr(f"at div {PER * _LANE}"), F.expr(f"(at div {PER}) % {_LANE} + at % {PER} * {_LANE}").cast("int")
    set_ = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    own = own.where(bit < SIDE).groupBy("row").agg(*(F.bit_or(F.when(side == s, set_).otherwise(none)).alias(f"s{s}") for s in (0, 1)))
    own = known.join(own, "row", "left").select(*named, *(F.coalesce(f"s{s}", none).alias(f"s{s}") for s in (0, 1)))
    return out.union(materialise(own, "long"))


def line_keys(classes: DataFrame, bits: int, keys: int) -> DataFrame:
    """(id, key, sketch) of classes (id, n, s0, s1): a row for each key."""
    each = classes.select("id", "n", "s0", "s1", F.explode(F.sequence(F.lit(0), F.lit(keys - 1))).alias("k"))
    first = F.col("k") % 2 == 0
    from_, other = F.when(first, F.col("s0")).otherwise(F.col("s1")), F.when(first, F.col("s1")).otherwise(F.col("s0"))
    at = F.expr(f"k * {SIDE} div {keys}")
    # the bits from ``at`` on, in a circle
    turned = F.call_function("shiftrightunsigned", from_, at).bitwiseOR(F.call_function("shiftleft", from_, F.lit(SIDE) - at))
    block = turned.bitwiseAND(F.lit((1 << bits) - 1))
    cell = F.floor(F.ln("n") / math.log(CELL) + F.expr("(k div 2) % 2") / 2)
    # small numbers, as hashes wouldn't compress
    return each.select("id", ((F.col("k") * 256 + cell) * F.lit(1 << bits) + block).alias("key"), other.alias("sketch"))


def fuzzy_lines(docs: DataFrame, distance: int = DISTANCE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, line_no, first_doc, first_line): each line that shares its group with others, and the occurrence that stays."""
    num, den = similarity
    rows = line_table(docs)
    known = ["n", "size", "s0", "s1", "p0", "p1"]
    classes = rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), *(F.min(c).alias(c) for c in known))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    each = line_keys(classes, BITS, KEYS)
    alike = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) <= SKETCH
    # most lines share keys by chance only: those with a like one in the bucket go on, each once
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & alike
    some = _written(each.alias("a").join(each.alias("b").hint("shuffle_hash"), same, "left_semi").select("id", "key"), "near")
    ids = materialise(some.select("id").distinct().join(classes.select("id", "h1", "h2", *known), "id"), "members")
    size = some.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = some.join(size, "key").join(ids.select("id", *(F.col(c).alias("words" if c == "size" else c) for c in known)), "id").withColumnRenamed("id", "rep")

    def near() -> Column:
        apart, odd = (sum(F.bit_count(F.col(f"{c}{s}").bitwiseXOR(F.col(f"x_{c}{s}"))) for s in (0, 1)) for c in "sp")
        # an edited word changes two bits of the 128 parities at most
        may = (F.greatest("n", "x_n") <= IN_LETTERS) | (odd * IN_WORDS[1] <= F.greatest("words", "x_words") * 2 * (IN_WORDS[1] - IN_WORDS[0]))
        return (apart <= distance) & may & (F.least("n", "x_n") * den >= F.greatest("n", "x_n") * num)

    norms = None

    def confirm(pairs: DataFrame) -> DataFrame:
        nonlocal norms
        if norms is None:
            norms = materialise(_norms(docs, rows, ids, num, den), "norms")
        a, b = (norms.select(*(F.col(c).alias(f"{side}_{c}") for c in norms.columns)) for side in "ab")
        joined = pairs.join(a, F.col("u") == F.col("a_id")).join(b, F.col("v") == F.col("b_id")).drop("a_id", "b_id")
        letters = F.greatest("a_n", "b_n") <= IN_LETTERS
        joined = joined.select("u", "v", letters.alias("letters"), *(F.when(letters, F.col(f"{s}_norm")).otherwise(F.col(f"{s}_codes")).alias(s) for s in "ab"))
        # the pairs are few rows but much work: dealt out evenly, which only a condition that isn't deterministic waits for (one on rand() alone would be optimised away)
        joined = joined.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        # a share of the longer may change; tight bounds come first, as they cost less
        share = F.when(F.col("letters"), F.lit(den - num) / F.lit(den)).otherwise(F.lit(IN_WORDS[1] - IN_WORDS[0]) / F.lit(IN_WORDS[1]))
        most = F.floor(F.greatest(F.length("a"), F.length("b")) * share + 1e-9)
        bounds = [f"most > {2**k} and levenshtein(a, b, {2**k}) >= 0" for k in (3, 6, 9)] + ["levenshtein(a, b, most) >= 0", "monotonically_increasing_id() < 0"]
        return joined.withColumn("most", most.cast("int")).where(" or ".join(bounds)).select("u", "v")

    parts = bucket_components(members, near, confirm, dense=DENSE)
    own = classes.where("copies > 1").select("h1", "h2", F.col("id").alias("group"))
    if parts is not None:
        linked = materialise(parts.union(parts.select("component", "component")).distinct(), "linked")
        own = classes.join(linked, F.col("id") == F.col("node"), "left").where("copies > 1 or node is not null")
        own = own.select("h1", "h2", F.coalesce("component", "id").alias("group"))
    grouped = materialise(rows.select("doc_id", "line_no", "h1", "h2").join(own, ["h1", "h2"]).select("doc_id", "line_no", "group"), "grouped")
    first = grouped.groupBy("group").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    return grouped.join(first, "group").select("doc_id", "line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def _norms(docs: DataFrame, rows: DataFrame, ids: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n, norm, codes) of classes, from one of the lines of each; norm only of those short enough, codes only of the others."""
    places = rows.select("doc_id", "line_no", "h1", "h2").join(ids.select("h1", "h2", "id"), ["h1", "h2"]).dropDuplicates(["id"]).select("doc_id", "line_no", "id")
    places = materialise(places, "places")
    texts = docs.select("doc_id", "text").join(small(places.select("doc_id").distinct()), "doc_id", "left_semi")
    lines = _exploded(texts).join(places, ["doc_id", "line_no"])
    lines = lines.select("id", words_of(F.col("line")).alias("words")).select("id", "words", F.array_join("words", " ").alias("norm"))
    short = F.col("n") <= IN_LETTERS * den / num
    long = F.col("n") > IN_LETTERS * num / den
    out = lines.select("id", "words", "norm", F.length("norm").alias("n")).select("id", "n", F.when(short, F.col("norm")).alias("norm"), F.when(long, coded(F.col("words"))).alias("codes"))
    return out.dropDuplicates(["id"])


def _dropped(found: DataFrame) -> DataFrame:
    """(doc_id, dropped): the numbers of the lines that go, by document."""
    gone = found.where((F.col("doc_id") != F.col("first_doc")) | (F.col("line_no") != F.col("first_line")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that are repeated, n_chars kept true."""
    gone = _dropped(fuzzy_lines(docs)).withColumnRenamed("doc_id", "_id").withColumnRenamed("dropped", "_gone")
    out = docs.join(gone, F.col("doc_id") == F.col("_id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("_gone", i), F.lit(False))), "\n")
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(docs.columns)


def line_digest(docs: DataFrame) -> DataFrame:
    """For each document: its number of lines, how many go, and which."""
    gone = _dropped(fuzzy_lines(docs)).withColumnRenamed("doc_id", "_id")
    # line breaks and one more; no text leaves the scan
    n = F.coalesce(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    out = docs.select("doc_id", n.alias("n_lines")).join(gone, F.col("doc_id") == F.col("_id"), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return out.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.array_join(dropped.cast("array<string>"), ",").alias("dropped_lines"))
