import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.llm import lines


def norm(line):
    return " ".join(re.findall(r"[^\W\d_]+", line.lower()))


def similar_pairs(every):
    """All pairs of lines with edit similarity 0.9 in letters; pairs whose letter counts are too far apart can't have it."""
    every = sorted(every, key=len)
    letters = {c: i for i, c in enumerate(sorted(set("".join(every))))}
    counts = np.zeros((len(every), len(letters)), np.int16)
    for i, s in enumerate(every):
        for c, n in Counter(s).items():
            counts[i, letters[c]] = n
    size = np.array([len(s) for s in every])
    found = []
    for i in range(len(every)):
        j = np.searchsorted(size, size[i] / 0.9 + 1e-9, "right")
        far = np.abs(counts[i + 1 : j] - counts[i]).sum(1)
        found += [(every[i], every[i + 1 + k]) for k in np.flatnonzero(far <= 2 * (size[i + 1 : j] // 10))]
    candidates = pd.DataFrame(found, columns=["a", "b"])  # noqa: F841  read by the query
    return duckdb.sql("select a, b from candidates where 10 * levenshtein(a, b) <= greatest(length(a), length(b))").fetchall() if found else []


def groups(texts, pairs):
    """The first place of each line's group, by links of normalised lines."""
    first, up = {}, {}
    for k, t in sorted(texts.items()):
        for i, line in enumerate(t.split("\n") if t is not None else []):
            if norm(line):
                first.setdefault(norm(line), (k, i))
    up = {x: x for x in first}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y, key=first.get)] = min(x, y, key=first.get)
    return {x: first[find(x)] for x in first}


def dropped(texts, first):
    out = defaultdict(list)
    for k, t in texts.items():
        for i, line in enumerate(t.split("\n") if t is not None else []):
            if norm(line) and first[norm(line)] != (k, i):
                out[k].append(i)
    return dict(out)


@pytest.mark.parametrize("turn", [lines.TURN, 7])
def test_simhash(spark, monkeypatch, turn):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    texts = ["\n".join(" ".join(word() for _ in range(r.choice([1, 2, 5, 40, 255, 256, 300, 700]))) for _ in range(4)) for _ in range(12)] + ["a bb ccc\n" + "ab " * 600]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    words = {w for t in texts for w in norm(t).split()}
    hashes = {x["w"]: (x["a"], x["b"]) for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(1), "w").alias("b")).collect()}
    monkeypatch.setattr(lines, "TURN", turn)
    got = lines.line_table(df).collect()
    assert len(got) == sum(len(t.split("\n")) for t in [*texts, texts[3]])
    for x in got:
        own = norm(texts[x["doc_id"]].split("\n")[x["line_no"]]).split()
        own = [w for w in own if len(w) >= lines.LONG] or own
        for s in (0, 1):
            want = sum(1 << b for b in range(lines.SIDE) if 2 * sum(hashes[w][s] >> b & 1 for w in own) > len(own))
            assert x[f"s{s}"] == want


def test_recall(spark, sf):
    """The share of all pairs of edit similarity 0.9 that end up in one group, however far their SimHashes are apart."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    every = {norm(x) for t in texts.values() for x in t.split("\n")} - {""}
    pairs = similar_pairs(every)
    place = {}
    for k, t in sorted(texts.items()):
        for i, line in enumerate(t.split("\n")):
            place.setdefault(norm(line), (k, i))
    found = {(x["doc_id"], x["line_no"]): (x["first_doc"], x["first_line"]) for x in lines.fuzzy_lines(docs).collect()}
    caught = sum(found.get(place[a], 0) == found.get(place[b], 1) for a, b in pairs)
    print("pairs", len(pairs), "caught", caught)
    assert len(pairs) > 20 and caught >= 0.9 * len(pairs)


def test_against_all_pairs(spark):
    r = random.Random(4)
    base = [" ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(r.randint(12, 40))) for _ in range(25)]
    texts = {}
    for k in range(60):
        own = []
        for _ in range(r.randint(0, 5)):
            words = r.choice(base).split()
            for _ in range(r.choice([0, 0, 1])):
                words[r.randrange(len(words))] += r.choice(["s", "", "ed"])
            own.append(r.choice([str.upper, str, str.title])(" ".join(words)) + r.choice(["", ".", " 12!", "  "]))
        texts[k] = "\n".join(own + r.choice([[], ["---"], ["", ""], ["1 2 3"]]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    every = {norm(x) for t in texts.values() for x in t.split("\n")} - {""}
    want = dropped(texts, groups(texts, similar_pairs(every)))
    got = {x["doc_id"]: x for x in lines.line_digest(df).collect()}
    assert {k: [int(i) for i in x["dropped_lines"].split(",")] for k, x in got.items() if x["n_dropped"]} == want and want
    assert all(x["n_lines"] == len(texts[k].split("\n")) for k, x in got.items())
    kept = {x["doc_id"]: x["text"] for x in lines.dedup_lines(df).collect()}
    assert kept == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(k, ())) for k, t in texts.items()}


def test_codes(spark):
    got = spark.sql("select 'one two  two drei' as x").select(lines.coded(lines.words_of(F.col("x"))).alias("c")).first()["c"]
    assert len(got) == 4 and got[1] == got[2] and len(set(got)) == 3


def test_odd_rows(spark):
    line = "The same line of text here"
    rows = [(1, None), (2, ""), (3, f"{line}\n\n{line}!\n"), (None, line), (5, "x" * 200_000 + "\n" + line), (5, "x" * 200_000 + "\n" + line), (6, "\n\n")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, line_no int, dropped int")
    got = sorted(((x["doc_id"] or 0, x["n_lines"], x["dropped_lines"]) for x in lines.line_digest(df).collect()))
    assert got == [(0, 1, ""), (1, 0, ""), (2, 1, ""), (3, 4, "2"), (5, 2, "1"), (5, 2, "1"), (6, 3, "")]
    assert lines.dedup_lines(df).columns == df.columns
    assert lines.line_digest(df.limit(0)).count() == 0


def test_links_do_not_depend_on_the_size(spark):
    """What is found among some lines is found among many others too, and no more."""
    r = random.Random(8)
    line = lambda: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(5, 9))) for _ in range(20))
    pairs = []
    for k in range(80):
        words = line().split()
        other = [w + "s" if i in (3, 11)[: 1 + k % 2] else w for i, w in enumerate(words)]
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    found = []
    for rest in (0, 4000):
        df = spark.createDataFrame(pairs + [(1000 + i, line()) for i in range(rest)], "doc_id long, text string")
        found.append(sorted((x["doc_id"], x["first_doc"]) for x in lines.fuzzy_lines(df).collect()))
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("n", [12, 16])
def test_parities_let_one_changed_word_pass(spark, n):
    """Lines beyond IN_LETTERS that differ in one word of few and long ones; the word changes two bits of either parities."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(20))
    rows = []
    for k in range(40):
        words = [word() for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:-1], word()]))]
    got = lines.fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert got >= 0.9 * len(rows)


def test_planes(spark):
    """Three binary digits of how many of STEP longs have a bit."""
    r = random.Random(3)
    rows = [[r.getrandbits(63) for _ in range(lines.STEP)] for _ in range(50)]
    df = spark.createDataFrame(rows, [f"w{i}" for i in range(lines.STEP)])
    for x, own in zip(df.select(*(c.alias(f"d{d}") for d, c in enumerate(lines._planes([F.col(c) for c in df.columns])))).collect(), rows, strict=True):
        assert all(sum((x[d] >> b & 1) << d for d in range(3)) == sum(w >> b & 1 for w in own) for b in range(63))
