"""op9: round trips, gapless cover, padding, and the segment tree against a plain search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from folioscope.llm import packing
from folioscope.llm.packing import Rooms, WordTokenizer, arrange, best_fit, pack, padding
from folioscope.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, length int, offset string"


def plain_best_fit(lengths, size):
    windows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [(room[w], w) for w in range(len(windows)) if room[w] >= lengths[i]]
        if fits:
            least = min(fits)[0]
            w = next(w for r, w in fits if r == least)
        else:
            windows.append([]), room.append(size)
            w = len(windows) - 1
        windows[w].append(i)
        room[w] -= lengths[i]
    return windows, room


def test_best_fit_needs_as_many_windows_as_a_plain_search():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([1, 7, 64, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 80))]
        got = best_fit(lengths, size)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in w) <= size for w in got)
        want, room = plain_best_fit(lengths, size)
        assert sorted(size - sum(lengths[i] for i in w) for w in got) == sorted(room)


def test_rooms_finds_the_tightest():
    rng = random.Random(8)
    r, held = Rooms(50), []
    for k in range(300):
        room = rng.randint(0, 50)
        r.add(k, room), held.append(room)
        length = rng.randint(0, 50)
        want = min((h for h in held if h >= length), default=None)
        assert r.tightest(length) == want
        if want is not None and rng.random() < 0.5:
            r.take(want), held.remove(want)


def test_arrange_leaves_little_to_fill():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [rng.randint(1, 2048) for _ in range(rng.randint(0, 300))]
        windows = arrange(lengths, 2048, 64)
        seen = defaultdict(list)
        for w in windows:
            assert sum(n for _, _, n in w) <= 2048
            assert padding(sum(n for _, _, n in w), 2048) <= 64
            for i, s, n in w:
                seen[i].append((s, n))
        for i, n in enumerate(lengths):
            at = 0
            for s, k in sorted(seen[i]):
                assert s == at and k > 0
                at += k
            assert at == n


TEXTS = ["", None, "Hello, World! it's 3.14", "été Œuvre ИДИ ſtraße İstanbul ΟΔΟΣ é x y z", "a<|endoftext|>b \x1c c", "word " * 9000, "\n\t ", "same", "same", "Ａ１ ﬁ 你好 🙂🙂"]


def test_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in enumerate(TEXTS)}
    docs = spark.createDataFrame([(i, x, 1, "x") for i, x in enumerate(TEXTS)], SCHEMA).repartition(3)
    rows = pack(docs, tokenizer_path()).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
        by[r.doc_id].append((r.start, r.length)), sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == sorted(ids)
    for group in [*by.values(), *sequences.values()]:
        at = 0
        for s, n in sorted(group):
            assert s == at
            at += n
    assert all(sum(n for _, n in g) <= 2048 for g in sequences.values())


@pytest.mark.parametrize("rows", [[], [(None, "a", 1, "x")]])
def test_edges(spark, rows):
    assert len(pack(spark.createDataFrame(rows, SCHEMA), tokenizer_path()).collect()) == len(rows)


def test_rows_that_share_an_id_are_packed_each_for_itself(spark):
    rows = [(1, "one two three", 0, ""), (1, "four five " * 900, 0, ""), (1, None, 0, ""), (1, "one two three", 0, "")]
    got = pack(spark.createDataFrame(rows, SCHEMA).coalesce(1), tokenizer_path(), 64, 1).collect()
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in sorted(v)) <= 64 and all(o == sum(n for p, n in v if p < o) for o, _ in v) for v in by.values())
    small = [r for r in got if r.doc_tokens < 64]
    assert sum(r.length for r in small) == sum({r.doc_tokens for r in small}) + max(r.doc_tokens for r in small)  # the null text once, the short one twice
    assert sum(r.length for r in got if r.doc_tokens >= 64) == next(r.doc_tokens for r in got if r.doc_tokens >= 64)


def whole(texts):
    """Ids of the tokenizer itself."""
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_every_character_is_cut_as_the_tokenizer_cuts_it():
    texts = [f"ab{c}Cd {c} {c}'s9{c}{c}.{c}" for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000, 7), *range(0x1F300, 0x1F700)])]
    got = list(WordTokenizer(tokenizer_path()).encode(texts))
    assert [t for t, g, w in zip(texts, got, whole(texts)) if g != w] == []


def test_random_texts_in_small_chunks_with_a_small_table(monkeypatch):
    for name, value in (("CHUNK", 300), ("HELD", 40), ("PASSING", 20)):
        monkeypatch.setattr(packing, name, value)
    rng = random.Random(3)
    signs = [*"abcXYZéÉßİıȺɐ'’“́ \t\n\xa0\x85\u2003\u200b.,-_9²<|>\x1c🙂Ω", "'s", "'re", "'ll", "n't", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["x" * 500, ""]
    tok = WordTokenizer(tokenizer_path())
    assert list(tok.encode([None, *texts])) == [b"", *whole(texts)]
    assert len(tok.held) == len(tok.at) - 1 < 40 + 20 + 400 and tok.at[-1] == len(tok.ids)


def test_new_words_of_many_texts_are_merged_in_one_call_and_signs_apart():
    tok, calls = WordTokenizer(tokenizer_path()), []

    class Counted:
        def __init__(self, t):
            self.t = t

        def __getattr__(self, name):
            calls.append(name) if name.startswith("encode") else None
            return getattr(self.t, name)

    for name in [k for k, v in vars(tok).items() if hasattr(v, "encode_batch_fast")]:
        setattr(tok, name, Counted(getattr(tok, name)))
    words = ["".join("qxzv"[i >> 2 * k & 3] for k in range(4)) for i in range(200)]
    texts = [f"{w} {w}, {w.upper()}. ({w})" for w in words]
    assert list(tok.encode(texts)) == whole(texts)
    assert len(calls) == 1
    assert sorted(tok.held) == sorted([*words, "(", ")", ",", "."])


def test_a_call_merges_a_bounded_number_of_pieces():
    tok, sizes = WordTokenizer(tokenizer_path()), []
    merges = tok.merges

    class Sized:
        def encode_batch_fast(self, texts, **kw):
            sizes.extend(len(x.split()) for x in texts)
            return merges.encode_batch_fast(texts, **kw)

    tok.merges = Sized()
    words = ["".join("qxzvjkwy"[i >> 3 * k & 7] for k in range(5)) for i in range(10_000)]
    texts = [" ".join(words[i : i + 700]) for i in range(0, len(words), 700)]
    assert list(tok.encode(texts)) == whole(texts)
    assert sum(sizes) == len(words) and max(sizes) <= 4096
