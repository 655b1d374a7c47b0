import hashlib
import random
import re

import pytest

from tabloom.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    doc, hit, found = words(text), set(), set()
    for name, item in items:
        item = words(item)
        n = min(window, len(item))
        own = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1):
            if n and tuple(doc[i : i + n]) in own:
                hit |= set(range(i, i + n))
                found.add(name)
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(str(i), some(r.randint(0, 12))) for i in range(r.randint(0, 6))]
    window = r.choice([2, 3, 4, 5])
    a = decontam.Automaton([(n, decontam.words_of(t)) for n, t in items], window)
    for _ in range(20):
        text = some(r.randint(0, 40)) + r.choice(["", " zz ", "!"]) + some(r.randint(0, 10))
        spans, found = a.match(decontam.words_of(text))
        assert (sum(e - s for s, e in spans), sorted(found)) == brute(text, items, window)[1:]


def test_digest(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r["doc_id"]: r for r in decontam.decontamination_digest(docs, items).collect()}
    own = [(str(r["item_id"]), r["text"]) for r in items.collect()]
    hits = 0
    for r in docs.collect():
        n, hit, found = brute(r["text"], own, 10)
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (n, hit, len(found), hit > 0)
        assert g["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
        hits += hit > 0
    assert hits


def test_blocks_and_long_items(spark, monkeypatch):
    r = random.Random(5)
    some = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    items = [(str(i), some(n)) for i, n in enumerate([90, 3, 0, 25, 1, 60])]
    texts = [some(200) for _ in range(10)] + [items[0][1][20:80]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(decontam, "item_blocks", lambda b, w, f=decontam.item_blocks: f(b, w, 17))
    for row in decontam.find_hits(df, bench, 4).collect():
        n, hit, found = brute(texts[row["doc_id"]], items, 4)
        assert (row["hit_words"], sum(e - s for s, e in row["hit_spans"]), row["hit_items"]) == (n, hit, found)


def test_ten_blocks(spark, monkeypatch):
    """Ten blocks: one automaton in a process at a time, one pass in the plan, cuts as with one block; long texts, repeated rows."""
    r = random.Random(6)
    some = lambda n: " ".join(r.choice("abcdefghijkl") * 3 for _ in range(n))
    items = [(i, some(40)) for i in range(10)]
    texts = [some(30) + " " + t + " " + some(30) for _, t in items] + [some(50), None, "", some(60_000) + " " + items[3][1]]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in [*enumerate(texts), (2, texts[2])]], "doc_id long, text string, hit_row int, row string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(decontam.decontaminate(df, bench, 5, 0.9).collect(), key=str)
    monkeypatch.setattr(decontam, "item_blocks", lambda b, w, f=decontam.item_blocks: f(b, w, 40))
    assert len(list(decontam.item_blocks(bench, 5))) == 10
    many = decontam.decontaminate(df, bench, 5, 0.9)
    assert sorted(many.collect(), key=str) == one and len(one) == len(texts) + 1 and many.columns == df.columns
    assert many._jdf.queryExecution().executedPlan().toString().count("+- MapInArrow") <= 2


def test_one_automaton_at_a_time():
    class Block:
        value = [("a", [b"x", b"y"])]

    for name in "pqr":
        assert decontam._matcher(Block, name, 2)() is decontam._matcher(Block, name, 2)()
        assert list(decontam._BUILT) == [name]


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "Nothing to see here, one two three at most."
    docs = [(1, clean, len(clean), "k"), (2, f"Before it: {item.upper()}! After " + "it goes on and on. " * 5, 0, "k"), (3, item, 0, "k"), (4, None, None, "k"), (5, "", 0, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, hit_items string").drop("x")
    bench = spark.createDataFrame([(7, item), (8, None), (None, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.decontaminate(df, bench).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1]["text"] == clean and got[4]["text"] is None
    assert got[2]["text"].startswith("Before it: ! After it goes".replace(": !", ": !")) or "ONE" not in got[2]["text"]
    assert got[2]["n_chars"] == len(got[2]["text"])
    assert decontam.decontaminate(df.limit(0), bench).columns == df.columns
    assert decontam.decontamination_digest(df, bench.limit(0)).where("contaminated").count() == 0
