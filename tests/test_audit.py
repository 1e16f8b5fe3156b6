"""Audit, repair, wrappers, replies, formats: literal cases."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import replies as R
from folioscope.functions import text as T
from folioscope.operators import audit as A
from folioscope.operators import wrappers as W
from folioscope.sources import formats
from folioscope.sources.tables import segments

SCHEMA = "doc_id long, lang string, pg int, ord int, source string, target string, x0 double, y0 double, x1 double, y1 double, oy double, scanned boolean"


def block(k, source, target, x0=50.0, y0=60.0, oy=None, pg=0, scanned=False, doc=1):
    return (doc, "en", pg, k, source, target, x0, y0, x0 + 100, y0 + 12, y0 if oy is None else oy, scanned)


def kinds(spark, *rows, figures=()):
    blocks = spark.createDataFrame(list(rows), SCHEMA)
    figs = spark.createDataFrame(list(figures), "doc_id long, pg int, ord int, x0 double, y0 double, x1 double, y1 double")
    return sorted((r.kind, r.ord) for r in A.findings(blocks, figs, F.col("written")).collect())


def test_clean_blocks_have_no_finding(spark):
    assert kinds(spark, block(0, "a plain line of words", "EINE ZEILE"), block(1, "see 12", "SIEHE 12", y0=90.0)) == []


def test_each_kind(spark):
    prose = "a plain line of words"
    assert kinds(spark, block(0, prose, prose)) == [("L2", 0)]
    assert kinds(spark, block(0, prose, "")) == [("L1", None), ("L2", 0)]
    assert kinds(spark, block(0, prose, "die Frau und der Mann mit dem Hund")) == [("D1", 0), ("L2", 0)]
    assert kinds(spark, block(0, "see 12", "SIEHE")) == [("L6", 0)]
    assert kinds(spark, block(0, "word", "wоrd")) == [("L9", 0)]
    assert kinds(spark, block(0, "two words", "two words")) == [("D2", 0)]
    assert kinds(spark, block(0, "word", "WORT", y0=335.0)) == [("L4", 0)]
    assert kinds(spark, block(0, "word", "<b>W</b>")) == [("L5", 0)] and kinds(spark, block(0, "<b>w</b>", "<B>W</B>")) == []
    assert kinds(spark, block(0, "one", "EINS"), block(1, "two", "ZWEI", x0=60.0)) == [("L7", 0)]
    assert kinds(spark, block(0, "one", "EINS"), block(1, "two", "ZWEI", y0=62.0)) == [("D3", 0)]
    assert kinds(spark, block(0, "kept", "kept", oy=90.0)) == [("L8", 0)]


def test_words_missing_from_the_page(spark):
    blocks = spark.createDataFrame([block(0, "w", "A B C D"), block(0, "w", "A B C D", doc=2, scanned=True), block(0, "w", "A B", doc=3)], SCHEMA)
    assert [r.doc_id for r in A.dropped_text(blocks, F.substring("written", 1, 3)).collect()] == [1]


def test_words_over_figures(spark):
    figure, page = (1, 0, 0, 40.0, 50.0, 200.0, 100.0), (1, 0, 0, 0.0, 0.0, 600.0, 340.0)
    assert kinds(spark, block(0, "word", "WORT"), figures=[figure]) == [("L10", 0)]
    assert kinds(spark, block(0, "word", "word"), figures=[figure]) == []  # the source drew it there
    assert kinds(spark, block(0, "word", "WORT"), figures=[page]) == []  # a scanned page


def test_repair_takes_what_has_no_loss(spark):
    tr = spark.createDataFrame([(1, "en", k, "see 12 of these", t) for k, t in enumerate(["SIEHE", "SIEHE", "SIEHE 12"])], "doc_id long, lang string, ord int, source string, target string")
    out, history = A.verify_and_repair(tr, lambda rows, k: rows.withColumn("target", F.when(F.col("ord") == k, "SIEHE 12!").otherwise("X")), 2)
    assert [h.count() for h in history] == [2, 1, 1]
    assert {r.ord: r.target for r in out.collect()} == {0: "SIEHE", 1: "SIEHE 12!", 2: "SIEHE 12"}


def test_repair_reads_replies_and_asks_once(spark):
    read, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(total, text):
        total.add(1)
        return text

    tr = spark.createDataFrame([(1, "en", k, "see 12 of these", "SIEHE" if k % 2 else "SIEHE 12") for k in range(10)], "doc_id long, lang string, ord int, source string, target string")
    seen = F.udf(lambda t: counted(read, t)).asNondeterministic()
    told = F.udf(lambda t: counted(asked, t)).asNondeterministic()
    out, history = A.verify_and_repair(tr.withColumn("target", seen("target")), lambda rows, k: rows.withColumn("target", told(F.when(F.col("ord") < 5, "SIEHE 12!").otherwise("X"))), 2)
    assert [h.count() for h in history] == [5, 3, 3] and out.where("target = 'SIEHE 12!'").count() == 2
    assert (read.value, asked.value) == (20, 8)  # judged, and for the result; five in the first round, three in the second


def test_wrappers_share_and_restore(spark):
    rows = [(1, 0, "en", "total of v1.2.3 today"), (1, 1, "en", "total of v9.9.9 today"), (1, 2, "en", "123"), (2, 0, "en", "see a.b@c.org now please")]
    requests = spark.createDataFrame(rows, "doc_id long, ord int, lang string, source string")
    seen = []

    def base(r):
        seen.append(sorted(x.source for x in r.collect()))
        return r.withColumn("target", F.upper("source"))

    memory = spark.createDataFrame([], "key string, target string")
    got = {(r.doc_id, r.ord): (r.target, r.lost) for r in W.wrapped(base, memory)(requests).collect()}
    assert got == {(1, 0): ("TOTAL OF v1.2.3 TODAY", 0), (1, 1): ("TOTAL OF v9.9.9 TODAY", 0), (1, 2): ("123", 0), (2, 0): ("SEE a.b@c.org NOW PLEASE", 0)}
    assert len(seen[0]) == 2


def value(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("v")).first().v


def test_contract_counts_answers_of_several_parts(spark, tmp_path):
    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "'en' AS lang", "'a\\nb\\nc\\nd' AS text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    requests = segments(spark, str(tmp_path))
    got = requests.where("(doc_id + ord) % 4 > 0")
    replies = got.union(got.where("(doc_id + ord) % 4 = 3")).union(requests.where("ord = 0").withColumn("ord", F.lit(-1)))
    assert tuple(W.contract(requests, replies).first()) == (40, 40, 40)


@pytest.mark.parametrize("reply,words", [('["a", " b ", ""]', ["a", "b"]), ('```json\n["a"]\n```', ["a"]), ('Sure: ["a", "b", "c", "d"] ok', ["a", "b", "c"]), ('["a", "b', []), ("none", []), ("", [])])
def test_keyword_replies(spark, reply, words):
    assert value(spark, R.keywords(F.col("t"), 3), reply) == words


@pytest.mark.parametrize("reply,pairs", [('{"a": "x", "b": " "}', [("a", "x")]), ('```\n{"a": "x"}\n```', [("a", "x")]), ('{"a": "x", "a": "y", "b": "z", "c": "br', [("a", "x"), ("b", "z")]), ("no object", [])])
def test_glossary_replies(spark, reply, pairs):
    assert [(p.term, p.value) for p in value(spark, R.glossary_reply(F.col("t")), reply)] == pairs


def test_verdict_replies(spark):
    reply = 'x [{"n": 1, "label": "text", "size": "huge"}, {"n": "q", "label": "text"}, {"n": 2, "label": "odd"}, {"n": 1, "label": "table", "size": "large"}] y'
    assert [tuple(v) for v in value(spark, R.verdicts(F.col("t"), ["text", "table"], ["large", "same"]), reply)] == [(1, "table", "large")]
    assert value(spark, R.verdicts(F.col("t"), ["text"], ["same"]), "nothing") == []


def test_why_unreadable():
    said = R.unreadable('[{"id": 1, "text": "' + "a" * 100 + '"} {"id": 2}]')
    assert "at 123" in said and len(said) < 160
    assert R.unreadable('{"a": 1}').startswith("a dict, no list") and R.unreadable("[1]").startswith("an item without id")


@pytest.mark.parametrize("text,pairs", [
    ('{"a": "x", "b": "y"}', {"a": "x", "b": "y"}), ("source,target\na,x\na,z", {"a": "z"}), ("a, b\tx; y\nc\tz", {"a, b": "x; y", "c": "z"}), ("a;x\n\nbad line\nb;y", {"a": "x", "b": "y"}), ('"a b",x', {"a b": "x"}), ("", {}),
])
def test_glossary_files(spark, text, pairs):
    assert value(spark, R.glossary_pairs(F.col("t")), text) == pairs


def test_addresses(spark):
    clean = lambda t: value(spark, R.sanitised(F.col("t")), t)
    assert clean("https://u:p@h.org/v1?api_key=1&x=2&TOKEN=3#f") == "https://h.org/v1?x=2"
    assert clean("http://h.org/a") == "http://h.org/a" and clean("localhost:1?key=2") == "localhost:1?key=2"


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", "1")], "k string, v string")
    for name in ("t.csv", "t.tsv", "t.json", "t.parquet"):
        formats.write_any(df, str(tmp_path / name))
        assert [tuple(r) for r in formats.read_any(spark, str(tmp_path / name)).select("k", "v").collect()] == [("a", "1")]
    with pytest.raises(ValueError):
        formats.read_any(spark, "x.unknown")
    with pytest.raises(NotImplementedError):
        formats.write_any(df, "x.pdf")


def test_measures(spark):
    assert value(spark, R.points(F.col("t")), "1.5em") == 18.0 and value(spark, R.points(F.col("t")), "16px") == 12.0 and value(spark, R.points(F.col("t")), "thick") is None
    m = spark.range(1).select(R.two_means(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 9.0)]), 8).alias("m")).first().m
    assert (round(m.paper, 6), m.ink, m.n_ink) == (0.1, 9.0, 1)


def test_marked_text(spark):
    from folioscope.operators.sequential import parse_marked

    rows = [(1, "a <0>b</0> c"), (2, "<0>a<1>b</1></0>"), (3, "<0>a</1>"), (4, "<0>open"), (5, "plain"), (6, "")]
    got = {}
    for r in parse_marked(spark.createDataFrame(rows, "k0 int, m string"), "m").collect():
        got.setdefault(r.k0, []).append((r.k, r.style, r.text))
    assert got == {1: [(0, -1, "a "), (1, 0, "b"), (2, -1, " c")], 2: [(0, 0, "a"), (1, 1, "b")], 5: [(0, -1, "plain")]}


def test_checked_text(spark):
    assert value(spark, T.is_checked(F.col("t")), "words") and not value(spark, T.is_checked(F.col("t")), "12 %")
