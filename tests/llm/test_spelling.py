"""Spelling variants against a plain version: every word of one edit of a word, looked up."""

import random
import re
import zlib
from collections import Counter

import pytest

from larkspur.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, least_length, least_count, one_in):
    counts = Counter()
    for i, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 5 * n else None, len(near), n)
    forms = {w: x[0] for w, x in out.items()}
    for w, (form, near, n) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (form, root, n, near, words[form] if form else None)
    return out


def groups(spark, words):
    got = spelling.group(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)).collect()
    assert len(got) == len(words)
    return {r["word"]: tuple(r)[1:] for r in got}


def made(rnd, many, letters, sizes):
    return {"".join(rnd.choice(letters) for _ in range(rnd.choice(sizes))): rnd.choice([1, 5, 5, 25, 30, 125, 700]) for _ in range(many)}


@pytest.mark.parametrize("tile", [1024, 4])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    rnd = random.Random(5)
    words = made(rnd, 250, "abé", [1, 2, 3, 5, 6, 7, 8]) | made(rnd, 60, "xyλ😀", [4, 5])
    stem = "counterproductive"
    words |= {stem: 9000, **{stem[:k] + stem[k + 1 :]: 900 for k in range(len(stem))}, **{stem[:k] + "z" + stem[k:]: 5 for k in range(len(stem) + 1)}}
    words |= {"inter" * 60 + rnd.choice("abc") * rnd.randint(1, 9): 7 for _ in range(20)}
    assert groups(spark, words) == plain_groups(words)


def test_paths_of_forms_lead_to_their_ends(spark):
    words = {"a" * k + "b" * (12 - k): 5 ** (k + 1) for k in range(13)}
    got = groups(spark, words)
    assert got == plain_groups(words) and all(x[1] == "a" * 12 for x in got.values())


def test_counts_lower_only_latin_capitals_and_drop_letters(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["Straße", "ÉCLAIR", "éclair", "Planet's", "x2planet", "longerword", "ß", "a×b÷cdef"]) for _ in range(80))) for i in range(60)]
    rows += [(None, "planets planets planets éclair"), (7, None), (8, ""), (9, "12 λόγος"), (10, rows[0][1]), (10, rows[0][1])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string")
    for one_in in (0, 3, 199):
        got = {r["word"]: r["n"] for r in spelling.word_counts(df, drop_one_in=one_in).collect()}
        assert got == plain_counts(rows, 6, 5, one_in)
    assert plain_counts(rows, 6, 5, 3) != plain_counts(rows, 6, 5, 0)
    words = spelling.word_counts(df, 4, 1, 3)
    assert {r["word"]: tuple(r)[1:] for r in spelling.group(words).collect()} == plain_groups(plain_counts(rows, 4, 1, 3))


def test_counts_that_leave_a_task_early_add_up(spark, monkeypatch):
    rows = [(i, f"wordone wordtwo word{chr(97 + i % 26)}same") for i in range(200)]
    want = plain_counts(rows, 6, 5, 0)
    monkeypatch.setattr(spelling, "COUNTED", 2)
    assert {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(spelling.word_counts(empty)).count() == 0
    alone = spark.createDataFrame([("single", 9)], "word string, n long")
    assert [tuple(r) for r in spelling.group(alone).collect()] == [("single", None, "single", 9, 0, None)]


def test_misspelt_words_are_told_with_their_documents(spark):
    rows = [(i, "the Planet planet") for i in range(20)] + [(50, "a plamet, PLAMET"), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.corrected(df, spelling.group(spelling.word_counts(df, 5, 1))).collect()
    assert [tuple(r) for r in got] == [(50, "plamet", "planet", 2)]
