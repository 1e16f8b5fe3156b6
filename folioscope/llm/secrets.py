"""Secret scans: plain patterns, and spans whose characters a model of random strings explains better than one of identifiers.

Two character Markov models (first order over character classes of the ASCII alphabet, with start and end) are
trained from labelled samples. A candidate is a run of ``[A-Za-z0-9+/_=-]``; its log-likelihood ratio decides.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, claim, ship

ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # maximal runs, so the length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")
#: A candidate for the models: long enough, and not plain words alone.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "random")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns: leftmost non-overlapping for each kind, then failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class SecretModel:
    ratio: np.ndarray  # 129 x 129: log P(next | random) - log P(next | ordinary); 128 is the edge
    limit: float  # least mean ratio a character

    def score(self, token: str) -> float:
        x = np.frombuffer(token.encode("ascii"), np.uint8)
        return float(self.ratio[128, x[0]] + self.ratio[x[:-1], x[1:]].sum() + self.ratio[x[-1], 128]) / (len(x) + 1)


def _transitions(samples: list[str], smoothing: float) -> np.ndarray:
    n = np.zeros((129, 129))
    for s in samples:
        x = np.frombuffer(s.encode("ascii"), np.uint8)
        np.add.at(n, (np.concatenate([[128], x]), np.concatenate([x, [128]])), 1)
    used = np.zeros(129, bool)
    used[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-"] + [128]] = True
    n[np.ix_(used, used)] += smoothing
    return np.log(np.maximum(n, 1e-9) / np.maximum(n.sum(1, keepdims=True), 1e-9))


def random_strings(count: int = 6000, seed: int = 17) -> list[str]:
    """Labelled sample: strings drawn evenly from the alphabets that keys use."""
    rng = random.Random(seed)
    kinds = ["0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"]
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 64))) for i in range(count)]


#: Words that any text may hold, for their letter pairs: few or repetitive documents alone would make unseen words look random.
COMMON = """
about above account action administration again although analysis answer anything application architecture available background beautiful because before
behaviour between business calculation category certificate change character children circumstances classification collection communication company
configuration connection consequence contribution country customer database decision democracy department description development dictionary different
direction document education electricity emergency environment everything everybody examination experience expression extraordinary february following
foreign framework frequently function generation government happiness identification implementation important independent individual industry information
initialization institution international investigation january jewellery journal judgement kitchen knowledge language laboratory management manufacturer
maximum measurement mechanism message minimum mountain national neighbourhood network nothing november observation occasionally operation opportunity
organization original particular performance permission philosophy photograph physical population possibility president previous probability problem
production property psychology public quality quantity question recognize recommendation register relationship representation requirement research
responsibility restaurant rhythm schedule scientific september sequence shipping significant specification statistics straightforward structure subject
sufficient synchronize system technology telephone temperature therefore thousand through together tomorrow transportation understanding university
validation vegetable version vocabulary weather website wednesday whatever without yesterday zero
aber abschnitt allgemeine anwendung arbeit ausschuss bedeutung beispiel bevor bundesregierung damit deutsch donau durchschnitt einfach entscheidung
entwicklung ergebnis fahrzeug forschung freiheit gegenwart geschichte gesellschaft gesundheit grundlage jahrhundert kommunikation krankenhaus landschaft
leistung menschen mitglied nachricht nicht politik rechnung schifffahrt schule schwierigkeit selbst sprache strasse tochter unternehmen verantwortung
versicherung vielleicht wahrscheinlich wirtschaft wissenschaft zeitung zukunft zusammen zwischen
ainsi alors aujourd avec beaucoup cependant chaque chose connaissance depuis deux eau enfant entreprise environnement fonction gouvernement heureux jamais
jusque langue lorsque maintenant monde nouveau ouvrage parce pendant personne peut pourquoi presque quelque question recherche semaine toujours travail
ahora algunos aunque ayuda cada conocimiento cualquier desarrollo despues ejemplo empresa entonces equipo espacio estado general gobierno hacia historia
izquierda lengua llamar mejor mientras mucho mundo naturaleza nunca palabra pregunta pueblo quien siempre sociedad tambien trabajo usted verdad viaje
""".split()


def ordinary_strings(words: list[str], count: int = 6000, seed: int = 19) -> list[str]:
    """Labelled sample: identifiers, paths, numbers and plain long words made of the given words."""
    rng = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value"]
    out = []
    for i in range(count):
        w = rng.choices(words, k=rng.randint(2, 5))
        kind = i % 8
        if kind == 0:
            out.append("_".join(w).lower())
        elif kind == 1:
            out.append("".join(x.capitalize() for x in w))
        elif kind == 2:
            out.append("-".join(w).lower() + "-" + str(rng.randint(0, 9999)))
        elif kind == 3:
            out.append("/".join(w).lower())
        elif kind == 4:
            out.append(str(rng.randint(10**11, 10**19)))
        elif kind == 5:
            out.append(f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}")
        elif kind == 6:
            out.append("_".join(w).upper())
        else:
            out.append("".join(w).lower())
    return out


def fit(positive: list[str], negative: list[str], kept: float = 0.999) -> SecretModel:
    """Both models and the limit: under it falls the share ``kept`` of ordinary samples of candidate length.

    The eight kinds of ordinary samples take turns, so eight in a row go to the model and the next eight to the limit.
    """
    ratio = _transitions(positive[::2], 0.5) - _transitions([s for i, s in enumerate(negative) if i // 8 % 2 == 0], 0.5)
    model = SecretModel(ratio, 0.0)
    scores = [model.score(s) for i, s in enumerate(negative) if i // 8 % 2 and len(s) >= 16]
    model.limit = max(0.5, float(np.quantile(scores, kept)) if scores else 0.5)
    return model


def train(docs: DataFrame, max_rows: int = 400, max_bytes: int = 4_000_000) -> SecretModel:
    """Ordinary words come from at most ``max_rows`` documents and ``max_bytes`` of text, base spans cut out; as many are common words."""
    words: list[str] = []
    for r in bounded_sample(docs, ["text"], max_rows, max_bytes):
        words += re.findall(r"[A-Za-z]{2,}", re.sub(TOKEN, " ", r.text))
    return fit(random_strings(), ordinary_strings(words + COMMON * (1 + len(words) // len(COMMON))))


_ALNUM = re.compile(r"[A-Za-z0-9]")


def all_spans(text: str, model: SecretModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): candidates that meet no base span and pass the limit are added as ``random``."""
    base = base_spans(text)
    added = []
    for m in TOKEN.finditer(text):
        t = m.group()
        # signs alone are a ruled line: the alphabets with most signs give 16 of them once in 2^80
        if not _ALNUM.search(t):
            continue
        a, b = m.span()
        if any(s < b and a < e for s, _, e in base):
            continue
        if model.score(t) >= model.limit:
            added.append((a, 3, b))
    return base, sorted(base + added)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans for every row, from its whole text (null: empty, no span).

    A span is kind:start:end in code points, end exclusive, ordered by start then kind and joined with commas.
    Repeated rows are scanned each for itself; a null doc_id is kept.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        claim("secrets")
        m = held.value
        for batch in batches:
            n, bases, spans = np.zeros((4, batch.num_rows), np.int64), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                base, every = all_spans(text or "", m)
                for _, k, _e in every:
                    n[k, i] += 1
                bases.append(_written(base))
                spans.append(_written(every))
            yield pa.record_batch([batch.column(0), *(pa.array(x) for x in n), pa.array(bases, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: SecretModel) -> DataFrame:
    """The same rows and columns with secrets masked in text; n_chars, if there, counts the new text. Null text stays null."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        claim("secrets")
        m = held.value
        for batch in batches:
            texts = [masked(t, all_spans(t, m)[1]) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
