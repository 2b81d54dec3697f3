import random

from larkspur.llm import bpe
from larkspur.llm.queries import vocabulary


class Counted(dict):
    asked = 0

    def get(self, *a):
        Counted.asked += 1
        return super().get(*a)


def plain(ranks, made, ids):
    """Merge by merge over all pairs, as the rules say it."""
    ids, merges = list(ids), 0
    while found := [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]:
        rank, i = min(found)
        ids[i : i + 2] = [made[rank]]
        merges += 1
    return ids, merges


def test_a_merge_asks_for_its_neighbours_only():
    encoder = bpe.ForcedBoundaryBpe(bpe.read_vocabulary(vocabulary("word_bpe_49k.json")))
    ranks, encoder.ranks = encoder.ranks, Counted(encoder.ranks)
    draw = random.Random(7)
    for size in (1, 2, 3, 8, 23, 24, 70):
        for _ in range(20):
            ids = [encoder.inner[ord(draw.choice("aeinorst"))] for _ in range(size)]
            want, merges = plain(ranks, encoder.made, ids)
            Counted.asked = 0
            assert encoder.merged(list(ids)) == want
            if size < 24:  # longer ones also ask when they leave the heap
                assert Counted.asked <= size - 1 + 2 * merges


def test_plain_runs_fall_into_the_patterns_words():
    encoder = bpe.ForcedBoundaryBpe(bpe.read_vocabulary(vocabulary("word_bpe_49k.json")))
    assert encoder.regex == bpe.WORDS
    for code in range(0x250):
        if len(chunk := "".join(encoder.normal("x" + chr(code) + "y.,"))) > 3 and (found := encoder.plain(chunk)):
            assert [w for w in found.groups() if w] == encoder.pattern.findall(chunk)
    assert encoder.plain("don't") is None and encoder.plain("x2") is None and encoder.plain("word?!").groups() == ("word", "?!")


def test_runs_that_no_table_has_are_encoded_together():
    """Texts that come together get what each one gets alone, with tables that fill up, special tokens, long runs and runs without ids."""
    spec = bpe.read_vocabulary(vocabulary("word_bpe_49k.json"))
    alone, draw = bpe.ForcedBoundaryBpe(spec), random.Random(11)
    together = bpe.ForcedBoundaryBpe(spec, 200)
    letters = "abcdefghijkzqxé'ßöø×ɏΣς.,!`~{}\x1c　 12½日é" + "st're'll"
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice((1, 2, 5, 13, 30, 300)))) for _ in range(900)]
    texts += [None, "", " ", "<|endoftext|> a", "<|EndOfText|> b", "aaaa" * 90, "the the"]
    for k in range(0, len(texts), 100):
        assert together.digests(texts[k : k + 100]) == [alone.digest(x) for x in texts[k : k + 100]]
    assert together.digests([]) == [] and len(together.chunks) <= 200
