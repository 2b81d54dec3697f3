"""Each text operator against a plain version of its rules, with odd rows: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib

import pytest

from larkspur.llm import bpe, fingerprints, jaccard_join, language_id, mixing, pii, quality_rules, secret_scan, suffix_dedup, token_counts

TOKENIZERS = "/opt/tokenizers"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "doc_id long, text string, lang string, source string, n_chars long, words string, `h` int, node string, kept boolean"


def prose(rnd, n, words=("ash", "birch", "cedar", "Elm", "fir", "oak", "pine", "yew", "été", "straße")):
    return " ".join(rnd.choice(words) + rnd.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    base = [prose(rnd, 120) for _ in range(4)]
    out = [None, "", "   \n\t ", "one", "one two three", "One Two THREE", "😀 \x00 <|endoftext|> 'll", "a" * 3000, "ha " * 400, prose(rnd, 6000)]
    for b in base:
        w = b.split(" ")
        out += [b, b, b + " tail", " ".join(w[:60] + ["other"] + w[61:]), " ".join(w[30:]), b.upper()]
    out += ["home | about | help | login\n" + base[0] + ".\nAll rights reserved.", "mail a@b.example or +49 (30) 123-4567, 10.0.0.1, 4111 1111 1111 1111", 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"']
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "a")[i % 4], len(t or ""), "w", 1, "n", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, NAMES).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


def by_id(df):
    got = {}
    for r in df.collect():
        assert r["doc_id"] not in got
        got[r["doc_id"]] = r
    return got


needs_tokenizers = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no vocabulary files")


@needs_tokenizers
def test_token_counts_are_greedy(docs, texts, empty):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    pieces = set(token_counts.pieces_of(bpe.read_vocabulary(path)))

    def greedy(word):
        at = n = 0
        while at < len(word):
            at += next(k for k in range(min(70, len(word) - at), 0, -1) if word[at : at + k] in pieces)
            n += 1
        return n

    got = by_id(token_counts.count(docs, path))
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        assert (got[i]["n_words"], got[i]["n_tokens"], got[i]["n_unknown"]) == (len(words), sum(greedy(b" " + w.encode()) for w in words), 0)
    assert token_counts.count(empty, path).count() == 0


def test_longest_match_fails_back_and_knows_unknown_words():
    a = token_counts.LongestMatch([b" a", b" ab", b"b", b"bc", b"c", b"cde", b"x", b"abcd"])
    assert [a.pieces(w) for w in (b" ab", b" abc", b" ax", b" axc", b" abcde", b" abcd", b" q", b"abcdx")] == [1, 2, 2, 3, 0 or a.pieces(b" abcde"), 0, 0, 2]
    assert a.pieces(b" abcde") == 2  # " ab" then "cde"


def test_language_is_learned_from_the_fold_and_letterless_texts_have_none(spark, empty):
    rnd = random.Random(1)
    en, de = ["the", "and", "with", "thing"], ["der", "und", "nicht", "schön"]
    rows = [(i, prose(rnd, 30, en if i % 2 else de), "en" if i % 2 else "de") for i in range(200)] + [(900, None, "en"), (901, " 12 .", "en"), (902, "the thing and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.identify(df))
    for i, t, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if t and i < 900:
            assert got[i]["lang_pred"] == lang and 0.5 < got[i]["score"] <= 1
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "en"
    assert language_id.identify(empty).count() == 0


def plain_pii(x):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, p) in enumerate(kinds.items()):
        for m in re.finditer(p, x):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(q) <= 255 for q in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}")] * ok
    return [x[2] for x in sorted(out)]


def test_personal_data_is_that_of_the_patterns(docs, texts, empty):
    rnd = random.Random(2)
    finder = pii.Finder()
    for _ in range(5000):
        x = "".join(rnd.choice("aB1234567890..@@++  --()") for _ in range(rnd.randint(0, 60)))
        assert [pii.shown([s]) for s in finder.spans(x) if s[1] in pii.BASE] == plain_pii(x)
    got = by_id(pii.find(docs))
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(plain_pii(t or "")).encode()).hexdigest()
    masked = by_id(pii.mask(docs))
    assert masked[len(texts) - 2]["text"] == "mail <EMAIL> or <PHONE>, <IP>, <CARD>" and masked[0]["text"] is None
    assert pii.mask(docs).columns == docs.columns and masked[len(texts) - 2]["n_chars"] == len("mail <EMAIL> or <PHONE>, <IP>, <CARD>")
    assert pii.find(empty).count() == 0
    spans = pii.Finder().spans("see https://x.example/a. IBAN: DE89 3704 0044 0532 0130 00 ssn 123-45-6789")
    assert [k for _, k, _ in spans] == ["url", "iban", "id"]


@needs_tokenizers
def test_secrets_are_found_and_cards_are_not(spark, docs, texts, empty):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        h = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f'{prose(rnd, 5)} token = "{h}" {prose(rnd, 5)}' if i % 2 else f"{prose(rnd, 5)} 4111111111111111 {prose(rnd, 3)}"))
    got = by_id(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), path))
    assert all(got[i]["n_secrets"] == i % 2 and got[i]["n_candidates"] == 1 for i, _ in rows)
    s, e = map(int, got[1]["spans"].split(":"))
    assert re.fullmatch("[0-9a-f]{40}", rows[1][1][s:e])
    assert len(by_id(secret_scan.scan(docs, path))) == len(texts) and secret_scan.scan(empty, path).count() == 0


@needs_tokenizers
def test_secrets_with_given_labels_and_on_rows_without_them(spark):
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    rnd = random.Random(13)
    rows, labels = [], []
    for i in range(400):
        secret = i % 2 == 1
        s = rnd.choice(["AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), "".join(rnd.choice("0123456789abcdef") for _ in range(40))]) if secret else rnd.choice([f"20{rnd.randint(10, 99)}-{rnd.randint(10, 99)}-report-of-the-house", f"/usr/share/local{rnd.randint(1, 9)}/people/things", f"4{rnd.randint(10**14, 10**15 - 1)}"])
        text = prose(rnd, 6, ("the", "house", "people", "with", "things")) + " "
        rows.append((i, text + s + " and the people"))
        if i < 200:
            labels += [(i, len(text), len(text) + len(s), float(secret))] * 2
    got = by_id(secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), path, spark.createDataFrame(labels, "doc_id long, start long, end long, label double")))
    held = [i for i in range(200, 400) if got[i]["n_candidates"]]
    true = sum(got[i]["n_secrets"] > 0 for i in held if i % 2)
    assert true / 100 >= 0.95 and true / max(1, sum(got[i]["n_secrets"] > 0 for i in held)) >= 0.95
    weak = by_id(secret_scan.scan(spark.createDataFrame(rows + [(500, 'password = "hunter22x" name = "room12"')], "doc_id long, text string"), path))
    assert sum(weak[i]["n_secrets"] > 0 for i in range(1, 400, 2)) >= 95 and weak[500]["n_candidates"] == 2


@needs_tokenizers
def test_null_ids_repeated_rows_and_long_digit_runs(spark):
    rows = [(None, "0" * 5000 + ".1.2.3"), (1, "9" * 5000 + ".1.2.3"), (1, "9" * 5000 + ".1.2.3"), (2, "x 10.0.0.1 http://a.example/b tel:030 123-4567")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find(df).collect()
    assert sorted((str(r["doc_id"]), r["n_ip"]) for r in got) == [("1", 0), ("1", 0), ("2", 1), ("None", 1)]
    assert {r["text"] for r in pii.mask(df).collect()} == {"<IP>", "9" * 5000 + ".1.2.3", "x <IP> http://a.example/b tel:<TEL>"}
    assert secret_scan.scan(df, f"{TOKENIZERS}/byte_bpe_50k.json").count() == 4


def test_language_scores_are_those_of_plain_counts(spark):
    import math as m

    rnd = random.Random(9)
    langs = {"en": ("the", "and", "house"), "fr": ("été", "les", "maison"), "de": ("der", "Straße", "und")}
    rows = [(i, prose(rnd, 12, langs[x]), x) for i, x in enumerate(rnd.choice(list(langs)) for _ in range(90))]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    counts = {x: {} for x in langs}
    for i, t, x in rows:
        for g in language_id.grams([t])[0].tolist() if not held[i] else []:
            counts[x][g] = counts[x].get(g, 0) + 1
    n = {x: sum(not held[i] and y == x for i, _, y in rows) for x in langs}
    right = 0
    for i, t, x in rows:
        score = {y: m.log(n[y] / sum(n.values())) + sum(m.log((counts[y].get(g, 0) + 0.5) / (sum(counts[y].values()) + 0.5 * language_id.BUCKETS)) for g in language_id.grams([t])[0].tolist()) for y in langs}
        best = max(sorted(langs), key=score.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(m.exp(v - score[best]) for v in score.values())) < 1e-3
        right += held[i] and best == x
    assert right >= 0.95 * sum(held.values())


def test_pivoting_keeps_sums_and_means():
    rnd = random.Random(10)
    sizes, start = [7, 3, 5, 9, 2, 4], [0.3, 0.5, 0.7, 0.2, 0.9, 0.4]
    means, runs = [0.0] * 6, 4000
    for _ in range(runs):
        parts, held = mixing.pivot(sizes, start, rnd.random)
        assert all(p in (0.0, 1.0) for k, p in enumerate(parts) if k != held)
        assert abs(sum(p * s for p, s in zip(parts, sizes)) - sum(p * s for p, s in zip(start, sizes))) < 1e-6
        means = [m + p / runs for m, p in zip(means, parts)]
    assert all(abs(m - p) < 0.04 for m, p in zip(means, start))


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def plain_components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [(len(a), top(i)) for i, a in enumerate(sets)]


def test_near_duplicates_are_those_of_all_pairs(spark, docs, texts, empty):
    rnd = random.Random(5)
    more = list(texts)
    for _ in range(6):
        w = prose(rnd, 60).split(" ")
        for _ in range(12):
            v = [x if rnd.random() > 0.03 else "new" + str(rnd.randint(0, 9)) for x in w]
            more.append(" ".join(v[rnd.randint(0, 6) :]))
    df = spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").repartition(3)
    want = plain_components(more)
    got = by_id(jaccard_join.join(df))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(more))] == want
    kept = {r["doc_id"] for r in jaccard_join.dedupe(docs).collect()}
    assert kept == {i for i, (n, c) in enumerate(plain_components(texts)) if c == i or not n}
    twice = jaccard_join.dedupe(docs.unionAll(docs))
    full = sorted(r["doc_id"] for r in twice.collect() if shingles(r["text"]))
    assert twice.columns == docs.columns and full == sorted(i for i in kept if shingles(texts[i]))
    assert jaccard_join.join(empty).count() == 0


def test_divide_skip_finds_what_counting_finds():
    import numpy as np

    rnd = random.Random(6)
    for _ in range(200):
        q = np.array(sorted(rnd.sample(range(80), rnd.randint(1, 40))), np.uint64)
        c = [np.array(sorted(rnd.sample(range(80), rnd.randint(1, 40)) if rnd.random() < 0.5 else set(q.tolist()) - {rnd.choice(q.tolist())} or {1}), np.uint64) for _ in range(rnd.randint(1, 12))]
        want = [k for k, x in enumerate(c) if 9 * len(set(q.tolist()) & set(x.tolist())) >= 4 * (len(q) + len(x))]
        for mu in (0.01, 1.0):
            assert sorted(jaccard_join.Lists(c).search(q, mu)) == want


def thue_morse(n, a, b):
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join((a, b)[x] for x in out)


def test_words_that_polynomial_hashes_confuse_are_kept_apart(spark):
    rows = [(k, thue_morse(n, *ab)) for k, (n, ab) in enumerate([(n, ab) for n in (64, 1024, 2048, 4096) for ab in ("ab", "ba")])]
    rows += [(100, "a\x00"), (101, "a"), (102, "\x00a"), (103, "12345678"), (104, "123456789"), (105, "123456780")]
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i]["component_id"] == i for i, _ in rows)


def test_lists_in_parts_hubs_and_blocks_give_the_same_components(spark, monkeypatch):
    rnd = random.Random(8)
    base = prose(rnd, 80).split(" ")
    more = [" ".join(x if rnd.random() > 0.015 else f"new{rnd.randint(0, 99)}" for x in base) for _ in range(60)] + [" ".join(base)] * 40 + [prose(rnd, 30) + " " + " ".join(base[:20]) for _ in range(30)]
    for name, value in (("HOT", 5), ("BLOCK", 300), ("HUB", 3), ("MOST_HUBS", 20), ("WANTED_BITS", 64)):
        monkeypatch.setattr(jaccard_join, name, value)
    got = by_id(jaccard_join.join(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string").repartition(3)))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(more))] == plain_components(more)


def test_null_repeated_and_text_ids_of_near_duplicates(spark, texts):
    t = texts[-5]
    rows = [(None, t), ("b", t), ("b", t), ("a", t + " tail"), (None, None), (None, ""), ("z", "lone words of some other text")]
    got = sorted(map(tuple, jaccard_join.join(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(None, "a"), ("b", "a"), ("b", "a"), ("a", "a"), (None, None), (None, None), ("z", "z")], key=str)
    kept = jaccard_join.dedupe(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[3], rows[4], rows[5], rows[6]], key=str)
    kept = jaccard_join.dedupe(spark.createDataFrame([(1, t), (1, t), (1, t + " tail")], "doc_id long, text string")).collect()
    assert len(kept) == 1


def test_quality_counts(docs, texts, empty):
    got = by_id(quality_rules.quality(docs))
    for i, t in enumerate(texts):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeated = {p + k for v in seen.values() if len(v) > 1 for p in v for k in range(5)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    clean = by_id(quality_rules.clean(docs))
    page = clean[len(texts) - 3]
    assert "|" not in page["text"] and "rights" not in page["text"] and page["n_chars"] == len(page["text"])
    assert quality_rules.clean(docs).columns == docs.columns and quality_rules.quality(empty).count() == 0


def test_mix_meets_targets(spark, docs, empty):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["x", "x", "x", "y", "z", None])) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df).collect()
    assert sorted(got) == sorted(mixing.mix(df.repartition(5)).collect()) and len(got) == len(rows)
    source, total = {i: s for i, _, s in rows}, sum(r["size"] for r in got)
    for s in ("x", "y", "z", None):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 20 and all(r["taken"] <= 3 * r["size"] for r in own)
    assert math.isclose(sum({(source[r["doc_id"]], r["target"]) for r in got} and [t for _, t in {(source[r["doc_id"]], r["target"]) for r in got}]), total)
    assert mixing.targets({"a": 10, "b": 10, "c": 980}) == {"a": 30.0, "b": 30.0, "c": 940.0}
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in got if r["size"]}
    sample = mixing.sample(df)
    assert sample.columns == df.columns and 0.9 * total < sum(len(r["text"].split()) for r in sample.collect()) < 1.1 * total and max(taken.values()) <= 3
    assert mixing.sample(docs).columns == docs.columns and mixing.mix(empty).count() == 0


@needs_tokenizers
def test_bpe_is_that_of_the_library(docs, texts, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    t = tokenizers.Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    got = by_id(bpe.encode(docs, path, ids=True))
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    encoder = bpe.encoder(bpe.read_vocabulary(path))
    word = "zqxjzqxjkvqz".encode()
    assert encoder.cuts(word) and all(not encoder.inside[word[i - 1] << 8 | word[i]] for i in encoder.cuts(word))
    assert bpe.encode(empty, path).count() == 0


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_strings_are_sorted_and_compared_like_plain_ones():
    import numpy as np

    rnd = random.Random(11)
    strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.choice([0, 3, 8, 9, 16, 30, 70]))) for _ in range(400)] + [b"abababab" * 5] * 70
    flat, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])
    begin = np.cumsum(size) - size
    order = suffix_dedup.multikey_quicksort(flat, begin, size)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    assert suffix_dedup.common_lengths(flat, begin, size, order).tolist() == [len(os.path.commonprefix(x)) for x in zip(got, got[1:])]


def test_words_made_to_collide_under_a_known_start_stay_apart(spark):
    """The pairs have equal hashes if the chain of steps starts at the word's length alone."""
    solved = [("abcdefghijklmnop", 'gimfmmw9kq"(=>d7')]
    rows = []
    for a, b in solved:
        rows += [(len(rows) + k, t) for k, t in enumerate([a, b, f"one two three four {a}", f"one two three four {b}", f"{a} {a}", f"{a} {b}"])]
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i]["component_id"] == i and got[i]["n_shingles"] == 1 for i, _ in rows)


def test_one_byte_texts_null_and_text_ids_lose_repeats(spark, texts):
    rows = [(1, "a" * 4_000_000), (2, "ab" * 1000), (3, None)]
    got = by_id(suffix_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string"), False))
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) for i in (1, 2, 3)] == [(4_000_000, 3_999_999, 1), (2000, 1998, 1), (0, 0, 0)]
    t = texts[-6]
    got = by_id(suffix_dedup.dedupe(spark.createDataFrame([("b", t), ("a", t), (None, t)], "doc_id string, text string")))
    assert [got[i]["n_removed"] for i in ("a", "b", None)] == [0, len(t.encode()), len(t.encode())]


@pytest.mark.parametrize("sorted_rows", [250_000, 50])
def test_repeats_are_those_of_all_windows(spark, texts, empty, monkeypatch, sorted_rows):
    monkeypatch.setattr(suffix_dedup, "SORTED", sorted_rows)
    more = [*texts, "a" * 500, "ab" * 300, "abcdefg" * 90, ("z" * 50 + "q") * 20, "\0" * 300, texts[-4][40:300]]
    rows = list(enumerate(more))
    got = by_id(suffix_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    want = plain_repeats(rows)
    for i, _ in rows:
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == want[i]
    assert suffix_dedup.dedupe(empty).count() == 0


def plain_anchors(text):
    """Spark's xxhash64 of a string or of numbers, chained by seeds, from 42."""
    import struct

    import xxhash

    def chained(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
            seed = seed - (1 << 64) if seed >> 63 else seed
            seed &= (1 << 64) - 1
        return seed - (1 << 64) if seed >> 63 else seed

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in WORD.findall(text or "")]
    inner = [chained(h[i : i + 2]) for i in range(len(h) - 1)]
    out = []
    for i in range(len(h) - 7):
        x = inner[i : i + 7]
        if min(x) in (x[0], x[6]):
            out.append(chained(x[::2]) & 0x7FFFFFFF)
    return out or ([chained(h) & 0x7FFFFFFF] if h else [])


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


@pytest.mark.parametrize("bucket", [7, 1024])
def test_fingerprints_are_those_of_plain_syncmers(spark, docs, texts, empty, monkeypatch, bucket):
    monkeypatch.setattr(fingerprints, "BUCKET", bucket)
    got = by_id(fingerprints.fingerprint(docs))
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, other, then = plain_anchors(t), plain_anchors(edited), plain_anchors(nxt)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == ".".join(map(str, own)) and r["edited_fingerprint"] == ".".join(map(str, other))
        assert math.isclose(r["near_edited"], jaccard(own, other)) and math.isclose(r["near_next"], jaccard(own, then))
    assert fingerprints.fingerprint(empty).count() == 0
    assert [r["anchor"] for r in fingerprints.anchors(docs).where("doc_id = 10").orderBy("position").collect()] == plain_anchors(texts[10])


def test_fingerprints_of_null_equal_and_text_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET", 1)
    t = [" ".join(f"w{i}{j}" for j in range(20)) for i in range(5)]
    rows = [(None, t[0]), (None, t[1]), ("a", t[2]), ("a", t[2]), ("b", t[3]), ("b", None), (None, None)]
    got = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert sum(r["near_next"] == 1.0 for r in got) == 1  # one of the equal rows comes before the other
    one = fingerprints.fingerprint(spark.createDataFrame([(1, t[0])], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0
