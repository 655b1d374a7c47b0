import hashlib
import math
import random
import re
import time

from tabloom.llm import pii

# The plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


SECRET = r"""(?i)(?<![^\W_])(?:token|secret|password|passwd|(?:api|access|private)[_-]?key)["']?[ ]?[=:][ ]?["']?[A-Za-z0-9+/_.~-]{12,}[="']*"""


def valid(kind, s):
    d = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def plain_spans(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PLAIN.items()}


def check(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for r in pii.span_digest(df).collect():
        want = plain_spans(texts[r["doc_id"]])
        base = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
        assert {k: r[f"n_{k}"] for k in pii.BASE} == {k: len(v) for k, v in want.items()}, (texts[r["doc_id"]], r)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == base or r["spans"].startswith(base)
        assert r["n_spans"] == len([x for x in r["spans"].split(",") if x]) == sum(r[f"n_{k}"] for k in (*pii.KINDS, "term"))


def test_random_texts(spark):
    r = random.Random(1)
    parts = ["a@b.co", "x.y", "@", ".", "-", " ", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "4111111111111111", "0.0.0.0", "_", "%", "é", "(", ")", "+1 (555) 123-4567", "\n", "c@d", "999", "5500-0000-0000-0004"]
    check(spark, {i: "".join(r.choice(parts) for _ in range(r.randint(1, 25))) for i in range(1500)})


def all_spans(texts):
    """The spans of mentions and terms by the formulas of the docstring, over all pairs."""
    mentions = {d: plain_spans(t) | {"secret": [m.span() for m in re.finditer(SECRET, t or "")]} for d, t in texts.items()}
    words = {d: set(re.findall(r"[^\W_]+", (t or "").lower())) for d, t in texts.items()}
    holders = {}
    for d, found in mentions.items():
        for k, spans in found.items():
            for a, b in spans:
                holders.setdefault(k, set()).add(d)
                holders.setdefault((k, texts[d][a:b].lower()), set()).add(d)
    n = len(texts)
    having = {}
    for d, own in words.items():
        for w in own:
            having.setdefault(w, set()).add(d)
    terms = {d: set() for d in texts}
    for docs in {frozenset(x) for x in holders.values()}:
        p = len(docs) / n
        for w in set().union(*(words[d] for d in docs)):
            given = min(1.0, (len(having[w] & docs) + pii.PRIOR * p) / (len(having[w]) + pii.PRIOR))
            if p < 1 and 1 + math.log(given) / -math.log(p) >= pii.DISCLOSURE:
                for d in docs & having[w]:
                    terms[d].add(w)
    out = {}
    for d, t in texts.items():
        inside = [s for spans in mentions[d].values() for s in spans]
        own = [m.span() for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in terms[d] and not any(a < m.end() and m.start() < b for a, b in inside)]
        out[d] = ",".join(f"{k}:{a}:{b}" for k in (*pii.KINDS, "term") for a, b in (own if k == "term" else mentions[d][k]))
    return out


def test_against_all_pairs(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in pii.span_digest(df).collect()}
    want = all_spans(texts)
    assert got == want and sum("term" in x for x in want.values()) > 1 and any("secret" in x for x in want.values())


def test_secrets(spark):
    texts = {0: 'so token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" it', 1: "API_KEY: abcdefghijkl1234 x", 2: "a token of thanks: we", 3: "mytoken=abcdefghijkl1234", 4: "password=short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: [texts[x["doc_id"]][int(a) : int(b)] for k, a, b in (s.split(":") for s in x["spans"].split(",") if s) if k == "secret"] for x in pii.span_digest(df).collect()}
    assert got == {0: ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'], 1: ["API_KEY: abcdefghijkl1234"], 2: [], 3: [], 4: []}


def test_many_mentions_in_one_text(spark):
    """Eight times the addresses take about eight times the time."""
    took = []
    for n in (4_000, 4_000, 32_000):
        df = spark.createDataFrame([(1, " ".join(f"word{i} a{i}@b.org" for i in range(n))), (2, "word1 x")], "doc_id long, text string")
        start = time.time()
        rows = {r["doc_id"]: r for r in pii.span_digest(df).collect()}
        took.append(time.time() - start)
        assert rows[1]["n_email"] == n
    assert took[2] < 12 * took[1] + 5


def test_table(spark, sf):
    check(spark, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_terms(spark):
    """A code word that only stands near an address discloses it; common words and words with other company don't."""
    r = random.Random(2)
    filler = [f"common{i}" for i in range(30)]
    some = lambda n: " ".join(r.choice(filler) for _ in range(n))
    texts = {i: some(40) for i in range(60)}
    for i in range(0, 20, 4):
        texts[i] = f"{some(20)} Zanzibar writes jo@home.example.org often {some(20)}"
    texts[50] = f"{some(5)} often {some(5)} often {some(5)} often {some(5)} often"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["spans"] for x in pii.span_digest(df).collect()}
    for i in range(0, 20, 4):
        named = [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].split(",")) if k == "term"]
        assert named == ["Zanzibar", "writes"] or named[:2] == ["Zanzibar", "writes"] and "common" not in "".join(named)
    assert all(not got[i] for i in range(60) if i % 4 or i >= 20)
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(df).collect()}
    assert "[TERM] [TERM] [EMAIL]" in clean[0] and "Zanzibar" not in clean[0] and clean[1] == texts[1]


def test_terms_of_rare_values(spark):
    """Each address is in one document only: the name near it discloses it, and the word near all of them discloses their kind."""
    r = random.Random(3)
    some = lambda n: " ".join(f"common{r.randrange(30)}" for _ in range(n))
    texts = {i: some(10) for i in range(1500)}
    for i in range(0, 360, 30):
        texts[i] = f"{some(5)} Kontakt Name{i}x a{i}@b{i}.org {some(5)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(df).collect()}
    assert all("Kontakt" not in clean[i] and "Name" not in clean[i] for i in range(0, 360, 30))
    assert all(clean[i].count("common") == 10 for i in texts)


def test_terms_far_away(spark):
    """A name that comes with one address only, far from it in the text, goes at all its places; elsewhere nothing goes."""
    r = random.Random(5)
    some = lambda n: " ".join(f"common{r.randrange(30)}" for _ in range(n))
    texts = {i: some(10) for i in range(600)}
    for i in range(0, 80, 8):
        texts[i] = f"{some(5)} jo@home.example.org {some(40)} Zanzibar {some(40)} zanzibar {some(3)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    clean = {x["doc_id"]: x["text"] for x in pii.sanitise(df).collect()}
    for i, x in texts.items():
        assert clean[i] == re.sub("(?i)zanzibar", "[TERM]", x).replace("jo@home.example.org", "[EMAIL]")


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "9" * 30_000, 4: "a." * 40_000, 5: "1.2.3.4 " * 3_000, 6: "+1" + "-" * 50_000, 7: "x@y.z", 8: "1 " * 30_000}
    check(spark, texts)
    df = spark.createDataFrame([(None, "mail a@b.cd", 1), (7, "mail a@b.cd", 2), (7, "mail a@b.cd", 2)], "doc_id long, text string, term int")
    assert [x["n_email"] for x in pii.span_digest(df).collect()] == [1, 1, 1]
    assert pii.sanitise(df).columns == df.columns and {x["text"] for x in pii.sanitise(df.where("doc_id = 7")).collect()} == {"mail [EMAIL]"}
    assert pii.span_digest(df.limit(0)).count() == 0
