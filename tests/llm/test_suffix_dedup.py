"""op2 against brute force over all shared runs of words."""

import random

from folioscope.llm.suffix_dedup import minimisers, repeated_passages
from folioscope.llm.common import Words

SCHEMA = "doc_id long, text string, pos int, key string"


def brute(rows, block, least):
    """Words of each document that lie in a run of ``block`` words another document has too, joined where they meet or touch."""
    words = [(d, (t or "").encode().lower().split()) for d, t in rows if d is not None]
    where = {}
    for d, w in words:
        for k in range(len(w) - block + 1):
            where.setdefault(tuple(w[k : k + block]), set()).add(d)
    out = set()
    for d, w in words:
        cover = [0] * (len(w) + 1)
        for k in range(len(w) - block + 1):
            if len(where[tuple(w[k : k + block])]) > 1:
                cover[k : k + block] = [1] * block
        k = 0
        while k < len(w):
            if cover[k]:
                e = k
                while cover[e]:
                    e += 1
                if e - k >= least:
                    out.add((d, k, e))
                k = e
            k += 1
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(21)
    voc = [f"W{i}" for i in range(800)]
    passages = [rng.choices(voc, k=k) for k in (49, 50, 51, 60, 90, 300)]
    rows = []
    for d in range(150):
        w = rng.choices(voc, k=rng.choice([0, 10, 100, 400]))
        for p in rng.sample(passages, rng.choice([0, 0, 1, 1, 2])):
            at = rng.randint(0, len(w))
            w = w[:at] + p + w[at:]
        rows.append((d, "  ".join(w)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (300, None), (301, ""), (302, "the " * 5000), (303, "the " * 200), (None, rows[7][1]), (304, " ".join(rng.choices(voc, k=30000)))]
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA).repartition(5)
    got = repeated_passages(docs).collect()
    text = {d: t for d, t in rows}
    spans = set()
    for r in got:
        piece = text[r.doc_id][r.start : r.end]
        k = len(text[r.doc_id][: r.start].split())
        spans.add((r.doc_id, k, k + r.n_words))
        assert len(piece.split()) == r.n_words >= 50 and r.other_doc_id != r.doc_id
    assert spans == brute(rows, 50, 50)


def test_passages_of_the_table_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    text, spans = dict(rows), set()
    for r in repeated_passages(docs).collect():
        k = len(text[r.doc_id][: r.start].encode().split())
        spans.add((r.doc_id, k, k + r.n_words))
    assert spans and spans == brute(rows, 50, 50)


def test_rows_that_share_an_id_keep_their_own_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a), (1, b + " " + b), (2, "x " + a), (3, c), (3, c), (4, c + " end")]
    got = repeated_passages(spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.n_words, r.other_doc_id) for r in got) == [(1, 0, len(a), 100, 2), (2, 2, 2 + len(a), 100, 1), (3, 0, len(c), 100, 4), (4, 0, len(c), 100, 3)]


def test_windows_of_repeated_words(spark):
    """A passage that begins or ends inside a word's repeats, at another place of them in each document."""
    rng = random.Random(6)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    rows = []
    for k in range(40):
        tail, front = fresh(15 + k % 30), fresh(15 + k % 30)
        for n in (60, 47, 83):
            rows += [[*fresh(9), *["the"] * (n + rng.randrange(20)), *tail, *fresh(9)], [*fresh(9), *front, *["a", "b"] * (n // 2 + rng.randrange(9)), *fresh(9)]]
    rows = [(d, " ".join(w)) for d, w in enumerate(rows)]
    text, spans = dict(rows), set()
    for r in repeated_passages(spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA).repartition(3)).collect():
        k = len(text[r.doc_id][: r.start].split())
        spans.add((r.doc_id, k, k + r.n_words))
    assert spans == brute(rows, 50, 50)


def test_passages_around_hot_blocks(spark):
    """Blocks under 50 words stand in many documents; pairs of documents share more words before, after or on both sides."""
    rng = random.Random(31)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    rows = []
    for size in (30, 36, 45, 49):
        for _ in range(6):
            hot = fresh(size)
            texts = [[*fresh(25), *hot, *fresh(25)] for _ in range(60)]
            for before, after in ((0, 10), (10, 0), (0, 50 - size), (50 - size, 0), (10, 10), (12, 9)):
                a, b = fresh(before), fresh(after)
                texts += [[*fresh(20), *a, *hot, *b, *fresh(20)] for _ in range(2)]
                texts += [[*fresh(20), *a, *hot, *fresh(25)] for _ in range(5)] + [[*fresh(25), *hot, *b, *fresh(20)] for _ in range(5)]
            rows += texts
    rng.shuffle(rows)
    text = {d: "é🙂 " + " ".join(w) for d, w in enumerate(rows)}
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in text.items()], SCHEMA).repartition(3)
    spans = set()
    for r in repeated_passages(docs).collect():
        k = len(text[r.doc_id][: r.start].split())
        assert len(text[r.doc_id][r.start : r.end].split()) == r.n_words and r.other_doc_id != r.doc_id
        spans.add((r.doc_id, k, k + r.n_words))
    want = brute(list(text.items()), 50, 50)
    assert want and spans == want


def test_empty(spark):
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_window_keeps_a_position():
    rng = random.Random(2)
    h = Words([" ".join(rng.choices("abcdefg", k=400)).encode()]).h
    p = minimisers(h, 16)
    assert all(((p >= s) & (p < s + 16)).any() for s in range(len(h) - 6 - 15 + 1))
