"""What models and files answer: lenient readers as expressions, units, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*(?:```.*)?$"


def unfenced(reply: Column) -> Column:
    """What stands between fences, else the whole reply."""
    return F.when(F.startswith(F.ltrim(reply), F.lit("```")), F.regexp_extract(reply, FENCE, 1)).otherwise(reply)


def keywords(reply: Column, most: int) -> Column:
    """A3: the strings of a list, from the first bracket to the last, ``most`` at most, blank ones out; an unreadable reply gives none."""
    found = F.from_json(F.regexp_extract(unfenced(reply), r"(?s)(\[.*\])", 1), "array<string>")
    return F.coalesce(F.filter(F.transform(F.slice(found, 1, most), lambda w: F.trim(w)), lambda w: w != ""), F.array().cast("array<string>"))


PAIR = r'"((?:[^"\\]|\\.)*)"\s*:\s*"((?:[^"\\]|\\.)*)"'
ENTRIES = "array<struct<term:string,value:string>>"


def _first_wins(pairs: Column) -> Column:
    keys = F.transform(pairs, lambda p: p["term"])
    return F.filter(pairs, lambda p, i: F.array_position(keys, p["term"]) == i + 1)


def glossary_reply(reply: Column) -> Column:
    """A4: (term, value) pairs of an object, trimmed, blank ones out; of an object that breaks off those that are whole, the first of each term."""
    body = F.regexp_extract(unfenced(reply), r"(?s)(\{.*)", 1)

    def read(b):
        whole = F.map_entries(F.from_json(F.regexp_extract(b, r"(?s)(\{.*\})", 1), "map<string,string>"))
        whole = F.transform(whole, lambda e: F.struct(e["key"].alias("term"), e["value"].alias("value")))
        some = F.zip_with(F.regexp_extract_all(b, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(b, F.lit(PAIR), F.lit(2)), lambda k, v: F.struct(k.alias("term"), v.alias("value")))
        return F.coalesce(F.when(F.contains(b, F.lit("}")), whole), _first_wins(some)).cast(ENTRIES)

    trimmed = F.transform(let(body, read), lambda p: F.struct(F.trim(p["term"]).alias("term"), F.trim(p["value"]).alias("value")))
    return F.filter(trimmed, lambda p: (p["term"] != "") & (p["value"] != ""))


def verdicts(reply: Column, labels: list[str], sizes: list[str]) -> Column:
    """A5: (n, label, size) from the first bracket to the last; items without a whole number or a known label out, unknown sizes ``same``, of equal
    numbers the last."""
    # numbers are read as text first: an item with another kind of number must not spoil the rest
    items = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<n:string,label:string,size:string>>")
    good = F.filter(items, lambda x: x["n"].rlike("^-?[0-9]+$") & x["label"].isin(*labels))
    read = F.transform(good, lambda x: F.struct(x["n"].cast("int").alias("n"), x["label"].alias("label"), F.when(x["size"].isin(*sizes), x["size"]).otherwise("same").alias("size")))

    def last(r):
        numbers = F.transform(r, lambda x: x["n"])
        return F.filter(r, lambda x, i: ~F.exists(F.slice(numbers, i + 2, F.greatest(F.lit(0), F.size(numbers) - i - 1)), lambda n: n == x["n"]))

    return F.coalesce(let(read, last), F.array().cast("array<struct<n:int,label:string,size:string>>"))


def unreadable(reply: str) -> str:
    """A2: what keeps a reply from being read, with 40 characters before and after the place; never the whole reply."""
    import json

    try:
        data = json.loads(reply)
    except json.JSONDecodeError as e:
        return f"{e.msg} at {e.pos}: {reply[max(0, e.pos - 40) : e.pos + 40]!r}"
    return f"{'an item without id and text' if isinstance(data, list) else f'a {type(data).__name__}, no list'}: {reply[:80]!r}"


HEADERS = ["source", "term", "target", "translation"]


def glossary_pairs(text: Column) -> Column:
    """A glossary file's text as a map: a JSON object, or two columns parted by tab, semicolon or comma (as in the first line, the header if there is
    one); a header and lines without two cells are left out, later pairs win."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.trim(x) != "")

    def read(rows):
        first = F.get(rows, F.lit(0))
        sep = F.when(F.contains(first, F.lit("\t")), "\t").when(F.contains(first, F.lit(";")), ";").otherwise(",")
        cells = F.transform(rows, lambda r: F.transform(F.split(r, sep), lambda c: F.trim(F.regexp_replace(c, '^ *"(.*)" *$', "$1"))))
        pairs = F.filter(cells, lambda c, i: (F.size(c) >= 2) & (F.get(c, F.lit(0)) != "") & ~((i == 0) & F.lower(F.get(c, F.lit(0))).isin(*HEADERS)))
        return F.transform(pairs, lambda c: F.struct(F.get(c, F.lit(0)).alias("key"), F.get(c, F.lit(1)).alias("value")))

    json = F.startswith(F.ltrim(text), F.lit("{"))
    whole = F.zip_with(F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2)), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    pairs = F.when(json, whole).otherwise(let(lines, read))

    def last(p):
        keys = F.reverse(F.transform(p, lambda x: x["key"]))
        n = F.size(keys)
        return F.filter(p, lambda x, i: F.array_position(keys, x["key"]) == n - i)

    return F.map_from_entries(let(pairs, last))


def points(size: Column) -> Column:
    """A CSS length in points: em, rem and % of 12 points, a pixel is 0.75; null for anything else."""
    v = F.regexp_extract(size, "^([0-9.]+)", 1).try_cast("double")
    return F.when(size.endswith("pt"), v).when(size.endswith("px"), v * 0.75).when(size.endswith("%"), v * 0.12).when(size.endswith("em"), v * 12)


def px_to_pt(x: Column, dpi: float) -> Column:
    """A7."""
    return x * 72 / dpi


def emu_to_pt(x: Column) -> Column:
    """A7."""
    return x / 12700


#: Names of parameters that carry a key.
SECRET = "(?i)key|token|secret|passw|auth|signature"


def sanitised(url: Column) -> Column:
    """An address without userinfo, fragment and key-like parameters; what is no address stays."""
    bare = F.substring_index(url, "#", 1)
    where, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(SECRET)), "&")
    plain = F.regexp_replace(where, r"^([a-z]+://)[^/]*@", "$1")
    return F.when(~F.contains(url, F.lit("://")), url).otherwise(let(kept, lambda k: F.concat(plain, F.when(k != "", F.concat(F.lit("?"), k)).otherwise(""))))


def two_means(v: Column, rounds: int) -> Column:
    """2-means of an array of numbers from its extremes: the means of the larger class (paper) and the smaller one (ink), and the ink's size."""
    mean = lambda x, other: F.when(F.size(x) == 0, other).otherwise(F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x))
    near = lambda c: F.filter(v, lambda x: F.abs(x - c["a"]) <= F.abs(x - c["b"]))
    far = lambda c: F.filter(v, lambda x: F.abs(x - c["a"]) > F.abs(x - c["b"]))
    start = F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda c, _: F.struct(mean(near(c), c["a"]).alias("a"), mean(far(c), c["b"]).alias("b")))

    def classes(c):
        n, m = F.size(near(c)), F.size(far(c))
        return F.struct(F.when(n >= m, c["a"]).otherwise(c["b"]).alias("paper"), F.when(n >= m, c["b"]).otherwise(c["a"]).alias("ink"), F.least(n, m).alias("n_ink"))

    return let(end, classes)
