import random

import pytest

from marginalia.llm import packing, pieces
from marginalia.llm.tokens import token_counts, tokens

ALPHABET = "abcXYZäöüß 019 .,;!?\n\n\t-–_'#²½日本語é\u00a0\u001c\u0301µ"


def texts(n=150):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 300))) for _ in range(n)]


def test_counts_are_the_tokenizers():
    t = tokens()
    for x in [*texts(), "don't we'll I'm", "a" * 5000, " " * 300 + "x", "\n" * 50]:
        assert t.count(x) == len(t.encoding.encode_ordinary(x)), repr(x)


def test_counts_of_a_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (3, "")], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n_tokens")
    assert sorted(tuple(r) for r in token_counts(df, "doc_id", "text").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]


def sentence_text(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    return "".join(" ".join(word() for _ in range(rng.randint(4, 12))).capitalize() + rng.choice([". ", ".\n", "!\n\n", ", "]) for _ in range(n))


@pytest.mark.parametrize("text", [sentence_text(150), "x" * 9000, "wort " * 3000, "\n\n".join(["# Head\n" + sentence_text(3, i) for i in range(40)]), "日本語の文章" * 800, "ab-" * 3000])
def test_pieces(text):
    t, limit, overlap = tokens(), 128, 16
    got = pieces.pieces(text, limit, overlap, t)
    assert got[0][0] == got[0][1] == 0 and got[-1][2] == len(text)
    for (s, core, e, n), (s2, core2, _, _) in zip(got, got[1:]):
        assert e == core2 and s2 <= core2
        assert t.count(text[s2:core2]) <= overlap + 1
    for s, core, e, n in got:
        assert e > core and n == len(t.encoding.encode_ordinary(text[s:e])) <= limit


def test_cuts_fall_on_boundaries():
    text = sentence_text(300)
    got = pieces.pieces(text, 128, 0, tokens())
    good = sum(text[:c].rstrip()[-1] in ".!," for _, c, _, _ in got[1:])
    assert good >= 0.95 * (len(got) - 1)


UNLIKE = {"digits": "4711 0815 " * 400, "japanese": "吾輩は猫である。名前はまだ無い。" * 120, "symbols": "%%%///" * 300, "words": "Quite another sentence, of some length. ", "none": "x" * 3000, "lines": "\n\n# h\n\n" * 60}


@pytest.mark.parametrize("kind", UNLIKE)
@pytest.mark.parametrize("overlap", [0, 16])
def test_an_edit_alters_only_its_neighbours(kind, overlap):
    """Appended, prepended, inserted, deleted: of the untouched part at most two pieces on each side of the edit change."""
    text, t, new = sentence_text(600), tokens(), UNLIKE[kind]
    cores = lambda x: [(c, e) for _, c, e, _ in pieces.pieces(x, 128, overlap, t)]
    before = cores(text)
    rng = random.Random(1)
    spots = [0, len(text), *(rng.randrange(len(text)) for _ in range(4))]
    for at in spots:
        after = set(cores(text[:at] + new + text[at:]))
        left = [p for p in before if p[1] <= at and p not in after]
        right = [p for p in before if p[0] >= at and (p[0] + len(new), p[1] + len(new)) not in after]
        assert len(left) <= 2 and len(right) <= 2, (at, left, right)
        cut = text[:at] + text[at + 500 :]
        after = set(cores(cut))
        left = [p for p in before if p[1] <= at and p not in after]
        right = [p for p in before if p[0] >= at + 500 and (p[0] - 500, p[1] - 500) not in after]
        assert len(left) <= 2 and len(right) <= 2, (at, left, right)


def test_split_table(spark):
    long = sentence_text(200)
    df = spark.createDataFrame([(1, long), (1, long), (2, "short"), (3, None), (4, "")], "doc_id long, text string").selectExpr("*", "7 AS piece", "8 AS id")
    out = pieces.split_long(df, 128, 16).collect()
    assert {r.doc_id for r in out} == {1} and all(r.n_tokens <= 128 for r in out)
    once = sorted({(r.piece, r.core_start, r.char_end) for r in out})
    assert "".join(long[c:e] for _, c, e in once) == long and len(out) == 2 * len(once)
    kept = pieces.split_long(df, 128, 16, keep_short=True)
    assert {r.doc_id for r in kept.collect()} == {1, 2}
    assert pieces.split_long(df.limit(0), 128, 16).count() == 0
    with pytest.raises(ValueError):
        pieces.split_long(df, 100, 60)


def test_patterns():
    rng = random.Random(5)
    for capacity in (1, 10, 64):
        histogram = {}
        for _ in range(2000):
            n = rng.choice([capacity, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 3))])
            histogram[n] = histogram.get(n, 0) + 1
        found = packing.patterns(histogram, capacity)
        back = {}
        for times, pack in found:
            assert times > 0 and sum(k * v for k, v in pack.items()) <= capacity
            for k, v in pack.items():
                back[k] = back.get(k, 0) + times * v
        assert back == histogram
        used, need = sum(t for t, _ in found), sum(k * v for k, v in histogram.items())
        assert used <= need / capacity * 1.25 + 1
    assert packing.patterns({}, 5) == [] and packing.patterns({3: 7}, 10) == [(2, {3: 3}), (1, {3: 1})]


def test_pack(spark):
    rows = [(i, "word " * (i % 37)) for i in range(300)] + [(900, "word " * 500), (901, None), (902, ""), (5, "word " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS rank", "3 AS container_id")
    out = packing.pack(df, 64)
    got = out.collect()
    size = {}
    for r in got:
        if r.container_id is not None:
            size[r.container_id] = size.get(r.container_id, 0) + r.n_tokens
    assert max(size.values()) <= 64 and set(size) == set(range(len(size)))
    want = token_counts(df, "doc_id", "text").groupBy().sum("n_tokens").first()[0]
    assert sum(size.values()) == want
    assert sorted(r.piece for r in got if r.doc_id == 900) == list(range(-(-sum(r.n_tokens for r in got if r.doc_id == 900) // 64)))
    assert {r.doc_id for r in got if r.container_id is None} >= {0, 901, 902}
    assert all(r.piece == 0 for r in got if r.doc_id < 300)
    summary = packing.fill(out, 64).first()
    assert summary.tokens == want and summary.fill > 0.9 and summary.containers == len(size)
    assert packing.pack(df.limit(0), 64).count() == 0 and packing.fill(packing.pack(df.limit(0), 64), 64).first().containers == 0
