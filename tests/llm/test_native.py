"""op5, op6, op8: against SQL, planted passages and brute force; no Python on the executors."""

import hashlib
import random
import re
import textwrap

import duckdb
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, fingerprints, license_scan
from folioscope.llm.registry import op5_license_scan

SCHEMA = "doc_id long, text string, item_id string, words int"


def native(df):
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_license_sql(spark, sf):
    df = op5_license_scan(spark, sf)
    native(df)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_sentences, sentence_ids, licenses, license FROM ({license_scan.sql()})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert sum(bool(r[3]) for r in want) > 3


def test_license_rules(spark):
    s = license_scan.SENTENCES
    mit = ". ".join(s[k][0].capitalize() for k in ("mit-title", "mit-grant", "mit-condition", "as-is"))
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "Intro text.\n" + mit + ".\nAll rights reserved.", "", 0), (4, "Licensed under the Apache License, Version 2.0.", "", 0), (4, "This is not the MIT licensed thing", "", 0), (None, "Released under the MIT License.", "", 0), (5, "licence " * 50000 + "\nLicensed under CC BY-NC 4.0.", "", 0)]
    got = {(r.doc_id, r.n_sentences, r.licenses) for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0, ""), (2, 0, ""), (3, 5, "MIT,all-rights-reserved"), (4, 1, "Apache-2.0"), (4, 0, ""), (None, 1, "MIT"), (5, 1, "CC-BY-NC-4.0")}
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_license_sentences_over_lines(spark):
    s = license_scan.SENTENCES
    wrap = lambda lead, *keys: "\n".join(lead + x for k in keys for x in [*textwrap.wrap(s[k][0].capitalize() + ".", 72), ""])
    mit, gpl = ("mit-grant", "mit-condition", "as-is"), ("gpl-free", "gpl-hope")
    grant = s["mit-grant"][0]
    texts = [
        wrap("", *mit), wrap(" * ", *mit), wrap("// ", *gpl).replace("software you", "software: you"), wrap("# ", "bsd-grant").replace("\n", "\r\n"),
        grant.replace(" ", "  ,  ") + "\n" + s["mit-condition"][0],  # over 600 characters
        "Intro\nof a text. " + wrap("", *gpl), "The MIT License (MIT)\nCopyright (c) 2020 A\n\n" + wrap("", *mit),
        wrap("", "gpl-free").replace("\n", "\n\n"), "not " + wrap("", "gpl-free"), "\n" * 50000 + wrap("", "bsd-grant"),
    ]
    df = license_scan.scan(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA))
    native(df)
    got = {r.doc_id: r.sentence_ids for r in df.collect()}
    title = "mit-title," + ",".join(mit)
    want = [",".join(mit), ",".join(mit), ",".join(gpl), "bsd-grant", ",".join(mit[:2]), ",".join(gpl), title, "", "", "bsd-grant"]
    assert got == dict(enumerate(want))
    # the SQL reads lines, blocks and pieces alike
    rng = random.Random(2)
    every = [x for v in s.values() for x in v]
    mixed = [". ".join(rng.choice(["", "Some text", "\n", "\n\n", "all rights"]) + "\n".join(textwrap.wrap(rng.choice(every).upper(), rng.choice([20, 60, 400]))) for _ in range(4)) for _ in range(150)]
    rows = [*enumerate([*texts, "This work is dedicated to the public-domain.", "The MIT License\n(MIT)\nMIT License", "MIT License\n"]), *enumerate(mixed, 100), (300, None), (301, "")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(f"SELECT doc_id, n_sentences, sentence_ids, licenses, license FROM ({license_scan.sql()})").fetchall()
    got = license_scan.scan(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(r[1] for r in want) > 200
    assert all(re.search(license_scan.TELLING, x) for v in s.values() for x in v)


def test_overlaps_catch_substitutions_and_leave_clean_texts(spark):
    rng = random.Random(12)
    voc = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(voc, k=rng.choice([8, 15, 30, 60]))), "x", 1) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        w = rng.choices(voc, k=rng.choice([0, 5, 80, 400]))
        if d % 3 == 0:
            i, t, _, _ = rng.choice(items)
            p = t.split()
            for k in rng.sample(range(len(p)), len(p) // 12):
                p[k] = "changed"
            at = rng.randint(0, len(w))
            w = w[:at] + p + w[at:]
            want.add((d, i))
        docs.append((d, ", ".join(w).upper() if d % 2 else " ".join(w), "z", 2))
    docs += [(900, None, "", 0), (901, "", "", 0), (None, items[0][1], "", 0), (903, " ".join(rng.choices(voc, k=40000)), "", 0)]
    d = spark.createDataFrame(docs, SCHEMA)
    b = spark.createDataFrame([(i, t, 1) for i, t, *_ in items] + [(77, None, 1), (78, "", 1), (None, "v1 v2 v3 v4 v5 v6 v7 v8", 1)], "item_id long, text string, doc_id int")
    df = decontaminate.overlaps(d, b)
    native(df)
    got = {(r.doc_id, r.item_id) for r in df.collect()}
    assert got >= want and len(got - want) <= 2
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {x[0] for x in docs} - {x for x, _ in got}
    assert decontaminate.overlaps(d, b.limit(0)).collect() == [] and decontaminate.overlaps(d.limit(0), b).collect() == []


def test_overlaps_find_all_that_the_rule_accepts(spark):
    """Short items inside texts, and scattered replacements up to the rule's limit, against every shift of every pair."""
    rng = random.Random(41)
    voc = [f"v{i}" for i in range(3000)]
    items = [(i, rng.choices(voc, k=1 + i % 40)) for i in range(120)]
    docs = []
    for d in range(360):
        p = list(items[d % 120][1])
        for k in rng.sample(range(len(p)), int(len(p) * (0, 0.2, 0.3)[d // 120])):
            p[k] = "changed"
        cut = rng.choice([0, 0, len(p) // 10])
        docs.append((d, [*rng.choices(voc, k=rng.choice([0, 9, 40])), *p[cut:], *rng.choices(voc, k=rng.choice([0, 9]))]))

    def accepted(item, words):
        for shift in range(-len(item) + 1, len(words)):
            same = [item[i] == words[i + shift] for i in range(len(item)) if 0 <= i + shift < len(words)]
            run = score = 0
            for eq in same:
                run = max(0, run + (1 if eq else -2))
                score = max(score, run)
            if score >= 12 or (sum(same) * 10 >= len(item) * 7 and sum(same) >= min(len(item), 8)):
                return True
        return False

    want = {(d, i) for d, w in docs for i, t in items if accepted(t, w)}
    assert len({i for _, i in want if len(items[i][1]) < 8}) > 15
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    got = decontaminate.overlaps(spark.createDataFrame([(d, " ".join(w), "", 0) for d, w in docs], SCHEMA), b)
    native(got)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(d, " ".join(w)) for d, w in docs])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [(i, " ".join(t)) for i, t in items])
    rows = con.sql(f"SELECT doc_id, item_id, matched, overlap, score FROM ({decontaminate.sql()})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)


def test_fingerprints_follow_the_definition(spark):
    rng = random.Random(3)
    voc = [f"w{i}é" for i in range(900)]
    rows = [(i * 3 % 101, " ".join(rng.choices(voc, k=rng.choice([0, 1, 3, 30, 300]))), "x", 1) for i in range(101)]
    rows += [(500, None, "", 0), (501, "", "", 0), (501, "tie a", "", 0), (502, "🙂 odd number", "", 0), (503, "long " * 40000, "", 0)]
    for n in (1, 7, 40):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        t = fingerprints.with_next(docs, n)
        order = sorted(((d, x or "") for d, x, *_ in rows), key=lambda r: (-r[0], r[1]))
        want = {(d, x, order[(i + 1) % len(order)][1]) for i, (d, x) in enumerate(order)}
        assert {tuple(r) for r in t.collect()} == want
    df = fingerprints.fingerprints(docs)
    native(df)
    got = {(r.doc_id, r.n_chars): r for r in df.collect()}
    marks = marks_of(spark, {z for _, x, y in want for z in (x, x[: len(x) - len(x) // 2] + y[: len(x) // 2])})
    for d, x, y in want:
        r = got[(d, len(x))]
        k = len(x) // 2
        e = x[: len(x) - k] + y[:k]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == tuple(".".join([f"{w % 2**64:X}", *(f"{v % 2**64:X}" for v in sorted(m))]) for m, w in (marks[x], marks[e]))
        assert abs(r.near_edited - alike(marks[x], marks[e])) < 1e-9 and abs(r.near_next - alike(marks[x], marks[y])) < 1e-9
        if len(x) > 1500 and d != 503 and len(y) > 1500:
            assert 0.25 < r.near_edited < 0.75 and r.near_next < 0.2


def marks_of(spark, texts):
    """By text: the shingle hashes under a quarter of the range, and the hash of all words, from the words alone."""
    words = {t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if w] for t in texts}
    runs = {t: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [] for t, w in words.items()}
    rows = [list(x) for x in {r for v in runs.values() for r in v} | {tuple(w) for w in words.values() if w}]
    hashed = spark.createDataFrame([(r,) for r in rows], "w array<string>").select("w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    long = hashed.select("w", F.xxhash64("h").alias("whole"), F.when(F.size("h") == 5, F.xxhash64(*[F.get("h", F.lit(i)) for i in range(5)])).otherwise(F.xxhash64("h")).alias("one")).collect()
    whole, one = {tuple(r.w): r.whole for r in long}, {tuple(r.w): r.one for r in long}
    return {t: ({one[r] for r in runs[t] if one[r] < 2**62 - 2**63}, whole[tuple(words[t])] if words[t] else 0) for t in texts}


def alike(a, b):
    if a[1] == b[1]:
        return 1.0
    return len(a[0] & b[0]) / min(len(a[0]), len(b[0])) if a[0] and b[0] else 0.0


def test_sketch_containment(spark):
    rng = random.Random(9)
    big = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    df = spark.createDataFrame([(" ".join(big[1000:1400]), " ".join(big), " ".join(big[:2000]), " ".join(big[1996:]))], "a string, b string, c string, d string")
    a, b, c, d = (fingerprints.sketch(F.col(x)) for x in "abcd")
    small, jac, same = df.select(fingerprints.containment(a, b), fingerprints.containment(b, a), fingerprints.merge(F.array(c, d)) == b).first()
    assert small == 1.0 and 0.05 < jac < 0.16 and same


def test_sketches_of_short_texts(spark):
    """Six words inside 3,000: never less than contained. Parts that overlap by four words merge to the sketch of the whole, at any split."""
    rng = random.Random(10)
    rows = []
    for i in range(200):
        w = [f"w{rng.randrange(10**6)}" for _ in range(12 if i % 2 else 3000)]
        k = rng.randint(5, len(w) - 5)
        rows.append((" ".join(w[k - 4 : k + 2]), " ".join(w), " ".join(w[: k + 4]), " ".join(w[k:])))
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(4)
    a, b, c, d = (fingerprints.sketch(F.col(x)) for x in "abcd")
    got = df.select(fingerprints.containment(a, b).alias("in"), (fingerprints.merge(F.array(c, d)) == b).alias("same"), F.size(a).alias("n"))
    native(got)
    got = got.collect()
    assert all(r["in"] in (None, 1.0) and r.same for r in got)
    assert 0.3 < sum(r.n for r in got) / 200 < 0.7  # two shingles each, a quarter kept


def test_fingerprints_edges(spark):
    assert fingerprints.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fingerprints.fingerprints(spark.createDataFrame([(None, "a b c", "", 0)], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
