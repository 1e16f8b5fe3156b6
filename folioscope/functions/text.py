"""Text expressions: pure Column -> Column, JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\r\n]+"

#: Function words by language, from general knowledge of each language.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "with", "this", "are", "by", "be", "from", "or", "an", "at", "not"],
    "fr": ["le", "la", "les", "et", "des", "une", "est", "que", "pour", "dans", "qui", "par", "sur", "pas", "au", "avec", "du", "ce", "il", "plus"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"],
    "es": ["el", "los", "las", "y", "del", "se", "por", "un", "con", "no", "una", "su", "para", "como", "al", "lo", "pero", "sus", "ya", "que"],
}
#: The names of 0 to 20, of the tens from 30 to 90, and of 1st to 10th in each language; other spellings follow with their values.
CARDINALS = {
    "en": "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf vingt",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte",
    "tr": "sıfır bir iki üç dört beş altı yedi sekiz dokuz on - - - - - - - - - yirmi",
}
TENS = {
    "en": "thirty forty fifty sixty seventy eighty ninety", "de": "dreißig vierzig fünfzig sechzig siebzig achtzig neunzig", "fr": "trente quarante cinquante soixante - - -",
    "es": "treinta cuarenta cincuenta sesenta setenta ochenta noventa", "tr": "otuz kırk elli altmış yetmiş seksen doksan",
}
ORDINALS = {
    "en": "first second third fourth fifth sixth seventh eighth ninth tenth", "de": "erste zweite dritte vierte fünfte sechste siebte achte neunte zehnte",
    "fr": "premier deuxième troisième quatrième cinquième sixième septième huitième neuvième dixième", "es": "primero segundo tercero cuarto quinto sexto séptimo octavo noveno décimo",
    "tr": "birinci ikinci üçüncü dördüncü beşinci altıncı yedinci sekizinci dokuzuncu onuncu",
}
OTHERS = {
    "en": {"hundred": 100, "thousand": 1000}, "de": {"ein": 1, "eine": 1, "ersten": 1, "erstes": 1, "hundert": 100, "tausend": 1000},
    "fr": {"une": 1, "première": 1, "cent": 100, "mille": 1000}, "es": {"un": 1, "una": 1, "primera": 1, "segunda": 2, "tercera": 3, "cien": 100, "ciento": 100, "mil": 1000},
    "tr": {"yüz": 100, "bin": 1000},
}
#: The digits that a fraction glyph stands for.
FRACTIONS = {"½": "12", "⅓": "13", "⅔": "23", "¼": "14", "¾": "34", "⅕": "15", "⅖": "25", "⅗": "35", "⅘": "45", "⅙": "16", "⅚": "56", "⅛": "18", "⅜": "38", "⅝": "58", "⅞": "78"}


def number_words(lang: str) -> dict[str, int]:
    """Number words of a language; German joins units to hundreds, thousands and tens by rule, Spanish units to twenty."""
    if lang not in CARDINALS:
        return {}
    units, tens, ordinals = CARDINALS[lang].split(), TENS[lang].split(), ORDINALS[lang].split()
    out = {w: n for n, w in enumerate(units)} | {w: 10 * n for n, w in enumerate(tens, 3)} | {w: n for n, w in enumerate(ordinals, 1)} | OTHERS[lang]
    if lang == "de":
        ones = ["ein", *units[2:10]]
        out |= {w + big: n * value for big, value in (("hundert", 100), ("tausend", 1000)) for n, w in enumerate(ones, 1)} | {"zehntausend": 10000, "hunderttausend": 100000}
        out |= {f"{w}und{t}": n + 10 * k for k, t in enumerate(["zwanzig", *tens], 2) for n, w in enumerate(ones, 1)}
    if lang == "es":
        out |= {f"veinti{w}": 20 + n for n, w in enumerate(["uno", "dós", "trés", "cuatro", "cinco", "séis", "siete", "ocho", "nueve"], 1)}
    return {w: n for w, n in out.items() if w.isalpha()}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for each row and use it several times: a lambda's variable is never computed anew."""
    return F.transform(F.array(value), body)[0]


def strip_markers(t: Column) -> Column:
    """without ``<n>`` and ``</n>``."""
    return F.regexp_replace(t, "</?[0-9]+>", "")


def collapse(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, SPACE, " "))


def normalised(t: Column) -> Column:
    """markers off, white space collapsed, lower case."""
    return F.lower(collapse(strip_markers(t)))


def content_words(t: Column) -> Column:
    """distinct lower-cased runs of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"\p{L}{3,}"), F.lit(0)))


def ordinary_words(t: Column) -> Column:
    """words of lower-case letters alone, once quoted spans and address-like tokens are gone and spaced separators are joined."""
    plain = F.regexp_replace(F.regexp_replace(t, r'"[^"]*"', " "), r" *([/:.]) *", "$1")
    words = F.split(F.regexp_replace(plain, r"[^ ]*[@/][^ ]*", " "), " +")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), lambda w: (w != "") & (w == F.lower(w)) & (w != F.upper(w)))


def identical(a: Column, b: Column) -> Column:
    """F5."""
    return let(F.struct(normalised(a).alias("a"), normalised(b).alias("b")), lambda n: (n["a"] != "") & (n["a"] == n["b"]))


def _words_of_both(a: Column, b: Column) -> Column:
    return F.struct(ordinary_words(a).alias("a"), F.array_distinct(ordinary_words(b)).alias("b"))


def _share(w: Column) -> Column:
    return let(F.array_distinct(w["a"]), lambda x: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, w["b"])) / F.size(x)))


def shared_share(a: Column, b: Column) -> Column:
    """Share of a's distinct ordinary words that b has."""
    return let(_words_of_both(a, b), _share)


def is_copy(a: Column, b: Column) -> Column:
    """four ordinary words at least, and identical or more than half of them shared."""
    return let(_words_of_both(a, b), lambda w: (F.size(w["a"]) >= 4) & ((_share(w) > 0.5) | identical(a, b)))


#: A stretch of digits and separators that ends in a digit, and such a stretch when it is one number grouped in thousands.
NUMBER = r"[.,]*[0-9](?:[0-9.,]*[0-9])?"
GROUPED = r"^[0-9]{1,3}([.,][0-9]{3})+$"


def _without_separators(run: Column) -> Column:
    return F.when(run.rlike(GROUPED), F.regexp_replace(run, "[.,]", "")).otherwise(run)


def joined_thousands(t: Column) -> Column:
    """F8: separators dropped inside well-formed groups of three digits; decimals and section numbers stay."""
    parts, runs = F.split(t, NUMBER, -1), F.regexp_extract_all(t, F.lit(f"({NUMBER})"), F.lit(1))
    return F.array_join(F.zip_with(parts, runs, lambda p, r: F.concat(p, F.coalesce(_without_separators(r), F.lit("")))), "")


def digit_groups(t: Column) -> Column:
    """all digit runs in order, markers off; fraction glyphs count as their digits."""
    t = strip_markers(t)
    for glyph, digits in FRACTIONS.items():
        t = F.replace(t, F.lit(glyph), F.lit(f" {digits[0]} {digits[1]} "))
    return F.regexp_extract_all(t, F.lit("([0-9]+)"), F.lit(1))


def spelled_numbers(t: Column, lang: Column) -> Column:
    """values that a text writes in the words of a language (``de``, ``de-AT``, ...), in order: units add, hundreds multiply, thousands
    flush into the total, any other word ends a number. A language without words here gives none."""
    words = F.regexp_extract_all(F.lower(strip_markers(t)), F.lit(r"(\p{L}+)"), F.lit(1))
    base = lang_code(lang)
    out = F.array().cast("array<bigint>")
    for code in CARDINALS:
        out = F.when(base == code, _folded(words, number_words(code))).otherwise(out)
    return out


def _folded(words: Column, values: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for w, n in values.items() for x in (w, n)])
    state = "struct<total:bigint,current:bigint,seen:boolean,out:array<bigint>>"

    def put(total, current, seen, out):
        return F.struct(total.cast("bigint").alias("total"), current.cast("bigint").alias("current"), F.lit(seen).alias("seen"), out.alias("out")).cast(state)

    def flushed(a):
        return F.when(a["seen"], F.concat(a["out"], F.array(a["total"] + a["current"]))).otherwise(a["out"])

    zero = F.lit(0)

    def step(a, v):
        many = F.when(a["current"] == 0, F.lit(1)).otherwise(a["current"])
        return (
            F.when(v.isNull(), put(zero, zero, False, flushed(a))).when(v == 100, put(a["total"], many * 100, True, a["out"]))
            .when(v == 1000, put(a["total"] + many * 1000, zero, True, a["out"])).otherwise(put(a["total"], a["current"] + v, True, a["out"]))
        )

    found = F.transform(words, lambda w: F.try_element_at(table, w))
    return F.when(F.exists(found, lambda v: v.isNotNull()), F.aggregate(found, put(zero, zero, False, F.array().cast("array<bigint>")), step, flushed)).otherwise(F.array().cast("array<bigint>"))


def numbers_needed(source: Column) -> Column:
    return digit_groups(joined_thousands(source))


def numbers_had(target: Column, lang: Column | None = None) -> Column:
    """Digit groups of a reply, and what it spells out in its language."""
    own = digit_groups(joined_thousands(target))
    return own if lang is None else F.concat(own, F.transform(spelled_numbers(target, lang), lambda n: n.cast("string")))


def lacks(need: Column, have: Column) -> Column:
    """Some element stands in ``have`` less often than in ``need``."""
    return let(F.struct(need.alias("s"), have.alias("t")), lambda d: F.exists(F.array_distinct(d["s"]), lambda g: F.size(F.filter(d["s"], lambda x: x == g)) > F.size(F.filter(d["t"], lambda x: x == g))))


def drops_numbers(source: Column, target: Column, lang: Column | None = None) -> Column:
    """A number of the source is missing from the target: thousands joined, fractions as digits, spelled values of the target's
    language counted as had."""
    return source.rlike("[0-9½-¾⅓-⅞]") & lacks(numbers_needed(source), numbers_had(target, lang))


def function_words_in(t: Column) -> Column:
    """The words of a text that are a function word of any language, in order with repeats: few, so that languages are told from these alone."""
    every = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
    return F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w.isin(*every))


def hits_of(found: Column, lang: str) -> Column:
    """How many of the function words found are of the language."""
    return F.size(F.filter(found, lambda w: w.isin(*FUNCTION_WORDS[lang])))


def foreign_hits(found: Column, lang: Column) -> Column:
    """The most words that one other language has among those found and the own one lacks, where two of them differ; null without any."""
    out = []
    for own, own_words in FUNCTION_WORDS.items():
        for other, words in FUNCTION_WORDS.items():
            if own != other:
                only = [w for w in words if w not in own_words]
                hits = F.filter(found, lambda w: w.isin(*only))  # noqa: B023
                out.append(F.when((lang == own) & (F.size(F.array_distinct(hits)) >= 2), F.size(hits)))
    return F.greatest(*out)


def wrong_language(t: Column, lang: Column) -> Column:
    """six words or more, two distinct function words or more of another language that the own one lacks, their share at least
    0.12 and above the own share. Unknown languages are never judged."""
    n = F.size(F.filter(F.split(F.lower(t), r"[^\p{L}]+"), lambda w: w != ""))
    own = F.coalesce(*[F.when(lang == lg, F.lit(lg)) for lg in FUNCTION_WORDS])

    def judge(x):
        mine = F.coalesce(*[F.when(lang == lg, hits_of(x["f"], lg)) for lg in FUNCTION_WORDS])
        foreign = foreign_hits(x["f"], lang)
        return F.coalesce((foreign / x["n"] >= 0.12) & (foreign > mine), F.lit(False))

    both = F.struct(function_words_in(t).alias("f"), n.alias("n"))
    return own.isNotNull() & let(both, lambda x: (x["n"] >= 6) & (F.size(x["f"]) >= 2) & judge(x))


def scripts(w: Column) -> Column:
    """Scripts that a word's letters belong to."""
    named = {"latin": "IsLatin", "cyrillic": "IsCyrillic", "greek": "IsGreek"}
    return F.array_compact(F.array(*[F.when(w.rlike(rf"\p{{{p}}}"), F.lit(n)) for n, p in named.items()]))


def garbled_words(source: Column, target: Column) -> Column:
    """words of the target that mix scripts, one of them absent from the source."""
    mixed = F.filter(F.split(target, SPACE), lambda w: F.size(scripts(w)) >= 2)
    # two of three scripts need a letter of the latter two
    return F.when(~target.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), F.array().cast("array<string>")).otherwise(let(F.struct(mixed.alias("w"), scripts(source).alias("own")), lambda m: F.filter(m["w"], lambda w: F.size(F.array_except(scripts(w), m["own"])) > 0)))


def is_data_only(t: Column) -> Column:
    """Not blank, and no letter."""
    return (F.trim(t) != "") & ~t.rlike(r"\p{L}")


def letter_share(t: Column) -> Column:
    return F.when(F.length(t) == 0, 0.0).otherwise(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.length(t))


def is_checked(t: Column) -> Column:
    """P5."""
    return (F.trim(t) != "") & ~is_data_only(t) & (letter_share(t) >= 0.3)


#: Headings of source lists in the four languages of the tables.
HEADINGS = ["sources", "references", "works cited", "further reading", "bibliography", "sources citées", "références", "bibliographie", "quellen", "quellenverzeichnis", "literatur", "literaturverzeichnis", "fuentes", "referencias", "obras citadas", "bibliografía"]


def is_bibliography_heading(t: Column) -> Column:
    """A known heading once numbering in front and ``:`` or ``.`` at the end are off."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"^[0-9ivx.]+[ )]+", ""), "[:.]+$", "")).isin(*HEADINGS)


def is_citation(t: Column) -> Column:
    """Long enough, and a label in front or two features of scholarly references."""
    features = [r"\([12][0-9]{3}[a-z]?\)|, [12][0-9]{3}", "(?i)doi|arxiv|isbn|https?:", "(?i)pp?\\. ?[0-9]+|vol\\.|no\\.", r"[A-Z][a-z]+, [A-Z]\.", "(?i)et al|press|journal|proceedings"]
    count = sum((t.rlike(p).cast("int") for p in features[1:]), t.rlike(features[0]).cast("int"))
    return (F.length(t) >= 15) & (t.rlike(r"^\[[0-9]+\]|^[0-9]+\. [A-Z][a-z]+, [A-Z]\.") | (count >= 2))


def symbol_share(t: Column) -> Column:
    return F.when(F.length(t) == 0, 0.0).otherwise(F.length(F.regexp_replace(t, r"[\p{L}\p{N} ]", "")) / F.length(t))


def is_code_like(t: Column) -> Column:
    """P13."""
    words = F.size(F.filter(F.split(t, " +"), lambda w: w.rlike(r"^\p{L}+[,.]?$")))
    return (F.length(t) <= 300) & ~t.rlike("[.!?]$") & (words < 10) & t.rlike(r"[A-Za-z_]+\(|[a-z]+_[a-z]+|[{};]|=|#|\$|%") & (symbol_share(t) >= 0.08)


def is_formula_like(t: Column) -> Column:
    """At most eight words, an operator, no sentence end."""
    return (F.size(F.split(F.trim(t), " +")) <= 8) & t.rlike("[=+*/<>^|]") & ~t.rlike("[.!?]$")


def is_prose_label(t: Column) -> Column:
    """Two words at least, not code, and not all short capitals."""
    words = F.split(F.trim(t), " +")
    return (F.size(words) >= 2) & ~is_code_like(t) & ~F.forall(words, lambda w: (F.length(w) <= 4) & (w == F.upper(w)))


def pieces(t: Column) -> Column:
    """cut after ``.!?;:`` and a space; fewer than 2 or more than 12 pieces, or a piece of one word: none."""
    p = F.split(t, r"(?<=[.!?;:]) +")
    ok = F.size(p).between(2, 12) & F.forall(p, lambda x: F.size(F.split(F.trim(x), " +")) >= 2)
    return F.when(ok, p).otherwise(F.array().cast("array<string>"))


def even_leaders(t: Column, length: Column) -> Column:
    """the dot leader (three dots or more) resized so that the line gets ``length`` characters, three dots at least."""
    head, tail = F.regexp_extract(t, r"^(.*?)\.{3,}(.*)$", 1), F.regexp_extract(t, r"^(.*?)\.{3,}(.*)$", 2)
    return F.when(t.rlike(r"\.{3,}"), F.concat(head, F.repeat(F.lit("."), F.greatest(F.lit(3), length - F.length(head) - F.length(tail)).cast("int")), tail)).otherwise(t)


def with_leading_label(source: Column, reply: Column) -> Column:
    """a list label at the start of the source that the reply lost is put back."""
    label = F.regexp_extract(source, r"^(\(?[0-9a-z]{1,3}[.)]|[-*•]) ", 1)
    return F.when((label != "") & ~F.startswith(reply, label), F.concat(label, F.lit(" "), reply)).otherwise(reply)


def clean_reply(t: Column) -> Column:
    """HTML breaks to spaces, formatting tags off, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(t, r"(?i)<br */?>", " "), r"(?i)</?(b|i|u|em|strong|span|p)( [^>]*)?>", ""))


def xml_safe(t: Column) -> Column:
    """control characters out, entities escaped."""
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def preview(t: Column) -> Column:
    """one line of 97 characters and an ellipsis at most."""
    one = F.regexp_replace(t, "\n", " ")
    return F.when(F.length(one) > 100, F.concat(F.substring(one, 1, 97), F.lit("..."))).otherwise(one)


def share_key(t: Column) -> Column:
    """Collapsed and lower-cased; null under three words."""
    key = F.lower(collapse(t))
    return F.when(F.size(F.split(key, " ")) >= 3, key)


def font_class(name: Column) -> Column:
    """class of a font by its name, a subset tag dropped."""
    n = F.lower(F.regexp_replace(name, r"^([A-Z]{6}\+)+", ""))
    return (
        F.when(n.rlike("mono|courier|consol|typewriter"), "monospace").when(n.rlike("script|hand|brush"), "script")
        .when(n.rlike("sans|arial|helvet|verdana|calibri"), "sans").when(n.rlike("serif|times|roman|georgia|garamond"), "serif").otherwise("unknown")
    )


def lang_code(code: Column) -> Column:
    """base code in lower case; ``auto`` and nothing give an empty string."""
    base = F.lower(F.substring_index(F.regexp_replace(code, "_", "-"), "-", 1))
    return F.when(code.isNull() | base.isin("auto", ""), "").otherwise(base)


#: Kinds of literal in the order in which they are tried.
LITERALS = (
    ("url", r"https?://[^ \n<>]+"),
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("marker", r"</?[0-9]+>"),
    ("placeholder", r"\{[A-Za-z0-9_.]+\}|%[sd]"),
    ("path", r"(?:[A-Za-z]:\\|~/|\./)[A-Za-z0-9_./\\-]+"),
    ("version", r"v?[0-9]+\.[0-9]+\.[0-9]+(?:\.[0-9]+)*"),
    ("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"),
    ("time", r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"),
    ("money", r"[$€£][0-9][0-9.,]*[0-9]|[$€£][0-9]"),
    ("percent", r"[0-9]+(?:[.,][0-9]+)?%"),
    ("identifier", r"[A-Za-z]+_[A-Za-z0-9_]+"),
    ("hex", r"0x[0-9A-Fa-f]+"),
)
_ALL = "|".join(f"(?:{p})" for _, p in LITERALS)
OPEN, CLOSE = "\ue000", "\ue001"


def literals(t: Column) -> Column:
    """the literals of a text in order, as (idx, kind, literal)."""
    found = F.regexp_extract_all(t, F.lit(f"({_ALL})"), F.lit(0))
    kind = lambda x: F.coalesce(*[F.when(x.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in LITERALS])
    return F.transform(found, lambda x, i: F.struct(i.alias("idx"), kind(x).alias("kind"), x.alias("literal")))


def protect(t: Column) -> Column:
    """the text with each literal replaced by its numbered token."""
    parts = F.split(F.regexp_replace(t, f"({_ALL})", OPEN), OPEN, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), p))), "")


def restore(t: Column, found: Column) -> Column:
    """tokens back to literals."""
    return F.aggregate(found, t, lambda s, x: F.replace(s, F.concat(F.lit(OPEN), x["idx"].cast("string"), F.lit(CLOSE)), x["literal"]))


def lost_tokens(t: Column, found: Column) -> Column:
    """how many literals have no token left."""
    return F.size(F.filter(found, lambda x: ~F.contains(t, F.concat(F.lit(OPEN), x["idx"].cast("string"), F.lit(CLOSE)))))
