"""Toxicity by a weighted lexicon: folded texts, Aho-Corasick matching, exception phrases, scores normalised by length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minmax import shingle_hashes, signature
from .store import schema_of, slices, written
from .words import SOLID, batch_words

SAMPLE = 20_000  # labelled rows that a lexicon is learned from, at most about so many
STEMS = range(3, 9)  # letters of a word's beginning that may become a term
LEAST_DOCS, LEAST_SHARE = 6, 0.004  # toxic texts of the sample that must hold a term
LEAST_WEIGHT = 2.5  # log odds ratio of a term

# Letters of other scripts that look like Latin ones, and digits and signs used in place of letters.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
              "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "ι": "i",
              "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ӏ": "l"}
HOMOGLYPHS |= {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a term is no insult.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "clown fish", "pond scum", "sore loser board game")

_LOOKALIKE = re.compile(f"[{''.join(HOMOGLYPHS)}]")
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_DISGUISED = re.compile(r"[^\W_]*[0-9@$][^\W_@$]*(?:[@$]+[^\W_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")


def _undisguise(m: re.Match) -> str:
    return m[0].translate(_SUBSTITUTE) if _LETTER.search(m[0]) else m[0]


def fold(text: str) -> str:
    """Lower-cased words between single spaces, with a space at either end; homoglyphs and substitutes are Latin letters."""
    text = text.lower()
    if not text.isascii():
        text = _LOOKALIKE.sub(lambda m: HOMOGLYPHS[m[0]], text)
    text = _GAP.sub(" ", _DISGUISED.sub(_undisguise, text))
    return f" {text.strip()} " if text.strip() else " "


def terms(folded: str) -> set[str]:
    """Candidate terms of a folded text: whole words (' word ') and beginnings of words (' wor')."""
    words = set(folded.split())
    return {f" {w} " for w in words if len(w) >= STEMS[0]}.union(f" {w[:n]}" for w in words for n in STEMS if n <= len(w))


@dataclass(frozen=True)
class Lexicon:
    """Terms with weights, exception phrases, and the coefficients that turn weight per length into a probability."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-4.0, 2.0, 0.0)
    _machine: list = field(default_factory=list, repr=False, compare=False)

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.coefficients)

    def machine(self) -> ahocorasick.Automaton:
        if not self._machine:
            a = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                a.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                a.add_word(fold(phrase), (len(fold(phrase)), None))
            if len(a):
                a.make_automaton()
            self._machine.append(a)
        return self._machine[0]

    def total(self, folded: str) -> float:
        """Summed weights of the matches outside exception phrases. Of the terms that begin at one place the heaviest
        counts; a term met n times counts 1 + log(n) times, so that a repeated line is not n lines."""
        machine = self.machine()
        if not len(machine):
            return 0.0
        hits, excused, free = {}, [], 0
        for end, (length, weight) in machine.iter(folded):
            at = end - length + 1
            if weight is None:
                excused.append((at, end))
            else:
                hits[at] = max(hits.get(at, (0.0, "")), (weight, folded[at:end + 1]))
        met: Counter = Counter()
        for at in sorted(hits):  # exception phrases come by their ends, so both lists are walked once
            while free < len(excused) and excused[free][1] <= at:
                free += 1
            if free == len(excused) or at < excused[free][0]:
                met[hits[at]] += 1
        return sum(weight * (1 + math.log(n)) for (weight, _), n in met.items())

    def features(self, text: str | None) -> tuple[float, float]:
        """log(1 + total weight), and the weight per hundred words up to a bound."""
        folded = fold(text or "")
        total = self.total(folded)
        return float(np.log1p(total)), min(20.0, 100 * total / (folded.count(" ") or 1))

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-(a + b * x + c * y))))


def held_out(id_col: str) -> Column:
    """Rows that labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of the distinct texts of about ``sample`` labelled rows that are not held out, chosen by a hash of the
    id. The label side is bounded by the sample, so it may be broadcast; other texts are not shuffled."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out("doc_id")) \
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * sample / n)))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(usable), "doc_id")
    return written(met.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("key", F.xxhash64("text")), "labelled")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, _, _, rows = batch_words(batch.column(0), SOLID)
        sets = [shingle_hashes(words[rows[i]:rows[i + 1]], 3) for i in range(batch.num_rows)]
        sketches = [signature(s, 24).astype(np.uint8).tobytes() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sketches, pa.binary())], names=["key", "sketch"])


def _families(rows: DataFrame) -> dict[int, int]:
    """The toxic texts of the sample (by hash) and the family of each: texts that share a third of their signature with the
    family's first. Copies of one text would otherwise make all its words look toxic."""
    table = rows.where("toxic = 1").select("text", "key").mapInArrow(_sketched, "key bigint, sketch binary").where(
        "sketch IS NOT NULL").orderBy("key").toPandas()
    if not len(table):
        return {}
    sketch = np.frombuffer(b"".join(table["sketch"]), np.uint8).reshape(len(table), -1)
    family = np.full(len(table), -1)
    for i in range(len(table)):
        if family[i] < 0:
            like = np.flatnonzero((family < 0) & ((sketch == sketch[i]).mean(1) >= 1 / 3))
            family[like] = i
    return dict(zip(table["key"].tolist(), family.tolist(), strict=True))


def _proposed(families: dict[int, int]):
    """(term, family) of the toxic texts, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in slices(batches):
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                met.update((term, families.get(key, -1)) for term in terms(fold(text)))
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in met], t) for i, t in ((0, pa.string()), (1, pa.int64()))],
                                         names=["term", "family"])
    return run


def _met(known: set[str]):
    """In how many clean texts of the task each known term occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(terms(fold(text)) & known)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         names=["term", "c"])
    return run


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [lexicon.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.float64()), pa.array([r[1] for r in x], pa.float64()),
                                              batch.column(1)], names=["x", "y", "toxic"])
    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Coefficients by Newton steps with a small ridge."""
    x, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def chosen_terms(candidates: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of the terms whose odds are high enough. Of beginnings that one word accounts for (' mo', ' moro', ' moron')
    the longest is kept; where many words share a beginning, that beginning is kept and its continuations add nothing."""
    weight = {term: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for term, t, c in candidates}
    count, good = {term: t for term, t, _ in candidates}, {t for t, w in weight.items() if w >= LEAST_WEIGHT}
    out, stems = {}, set()
    longer: dict[str, list[str]] = {}
    for term in good:
        if not term.endswith(" "):
            for n in STEMS:
                if n < len(term) - 1:
                    longer.setdefault(term[:n + 1], []).append(term)
    for term in sorted(good, key=lambda t: (len(t.strip()), t.endswith(" "), t)):
        word = term.strip()
        if any(f" {word[:n]}" in stems for n in STEMS if n <= len(word)):
            continue
        if not term.endswith(" "):
            stems.add(term)
            term = max((x for x in longer.get(term, []) if count[x] >= 0.95 * count[term]), key=lambda x: (len(x), x), default=term)
        out[term] = round(weight[term], 4)
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most about ``sample`` labelled documents that are not held out.

    The toxic texts propose terms (words and beginnings of words), counted once per family of near copies; the clean texts
    weigh them by log odds, and two coefficients are fitted to the features. What the driver holds is bounded by the sample. Without toxic or without
    clean rows the lexicon is empty and every score is the same low one.
    """
    rows = _sampled(docs, labels, sample)
    size = {bool(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(True) or not size.get(False):
        return Lexicon({}, exceptions)
    families = _families(rows)
    toxic, clean = max(1, len(set(families.values()))), size[False]
    proposed = (rows.where("toxic = 1").select("text", "key").mapInArrow(_proposed(families), "term string, family bigint")
                .groupBy("term").agg(F.count_distinct("family").alias("t")).where(F.col("t") >= max(LEAST_DOCS, LEAST_SHARE * toxic)))
    count = {r["term"]: r["t"] for r in proposed.toLocalIterator()}
    met = rows.where("toxic = 0").select("text").mapInArrow(_met(set(count)), "term string, c bigint").groupBy("term").agg(F.sum("c").alias("c"))
    clear = {r["term"]: r["c"] for r in met.toLocalIterator()}
    lexicon = Lexicon(chosen_terms([(term, t, clear.get(term, 0)) for term, t in count.items()], toxic, clean), exceptions)
    if not lexicon.weights:
        return lexicon
    fit = rows.select("text", "toxic").mapInArrow(_measured(lexicon), "x double, y double, toxic int").toPandas()
    return Lexicon(lexicon.weights, exceptions, _logistic(fit[["x", "y"]].to_numpy(), fit["toxic"].to_numpy(float)))


def _scored(lexicon: Lexicon, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at):
            scores = pa.array([lexicon.score(t) for t in batch.column(text_at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])
    return run


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, score`` per input row; only the text is an input of the score.

    Whole texts are folded and matched by an automaton in one pass, without a shuffle. Null and empty texts have the
    score of a text without matches. Repeated rows get equal scores, null ids are kept, further columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scored(lexicon, 1), schema_of(docs, id_col, "text string, score double"))
