"""op7 against brute force over all pairs, on made tables with copies, ties, nulls and long texts."""

import random
import re

from folioscope.llm.jaccard_join import drop_near_copies, jaccard_components, needed, shared_at_least

SCHEMA = "doc_id long, text string, label string, component_id int"


def brute(rows, words=4, percent=85):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((d if d is not None else -1, len(s), find(d) if d is not None else -1) for (d, _), s in zip(rows, sets))


def table():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 40, 200]))) for _ in range(40)]
    rows = []
    for i in range(400):
        w = rng.choice(base[:12] if i % 2 else base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):  # chains of near copies, above and below the limit
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i + 1, " ".join(w).capitalize() if i % 5 == 0 else "\t".join(w)))
    rows += [(901, None), (902, ""), (903, " \n "), (904, "one"), (905, "ONE"), (906, "one two three"), (907, "the " * 3000), (908, "the " * 900), (None, base[0]), (909, " ".join(rng.choices(vocabulary, k=30000)))]
    return rows


def test_components_equal_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA).repartition(3)
    for words, percent in ((4, 85), (5, 80)):
        got = jaccard_components(docs, words, percent).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == brute(rows, words, percent)


def test_one_of_each_group_stays(spark):
    rows = table()
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA)
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for d, _, c in brute(rows) if d >= 0})
    assert kept.where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_keep_their_count(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "", 0)] * 3 + [(2, "a b c d e", "", 0)], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(docs).collect()) == [(1, 1)] * 3 + [(2, 1)]


def test_needed_shared_tokens_bound():
    for n in range(1, 400):
        for m in range(-(-85 * n // 100), n + 1):
            assert min(needed(n, 85), needed(m, 85)) >= 1 + n * 85 * 2 // 10000 - 0 or needed(m, 85) >= 1 + n * 85 * 2 // 10000


def test_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, a), (3, c), (None, a), (None, a)]
    kept = drop_near_copies(spark.createDataFrame([(d, t, "", 0) for d, t in rows], SCHEMA))
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(1, a), (1, b), (3, c), (0, a), (0, a)])


def test_families_with_many_unlike_edits(spark):
    """Edits of one text below and above the limit, some of which share their edits: only these are compared, and no link is lost."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(420):
        w = list(rows[rng.randrange(len(rows))][1].split() if i % 7 == 6 else base)
        for _ in range(rng.choice([1, 2]) if i % 7 == 6 else rng.choice([1, 2, 3, 4, 6, 9, 12, 25])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[f"x{rng.randrange(10**6)}"], [], ["plus", "one"]])
        rows.append((i * 13 % 421, " ".join(w)))
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA).repartition(3)
    for words, percent in ((4, 85), (5, 80)):
        want = brute(rows, words, percent)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, words, percent).collect()) == want
        assert 100 < len({c for _, _, c in want}) < 400


def test_shared_difference_bound():
    """Every linking pair of sets, one of which does not link to the leader, shares as much of its difference as the bound asks for."""
    rng = random.Random(5)
    for percent in (80, 85):
        c = 0
        for _ in range(30000):
            leader = set(range(rng.randint(3, 60)))
            a = set(rng.sample(range(70), rng.randint(1, 60))) if rng.random() < 0.2 else {x for x in leader if rng.random() < 0.9} | set(rng.sample(range(100, 120), rng.randint(0, 9)))
            b = {x for x in a if rng.random() < 0.95} | {rng.randrange(130)}
            links = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
            if a and links(a, b) and not (links(a, leader) and links(b, leader)):
                both = len((a ^ leader) & (b ^ leader))
                assert all(both >= shared_at_least(len(x), len(leader), len(x ^ leader), links(x, leader), percent) for x in (a, b))
                c += 1
        assert c > 1000
