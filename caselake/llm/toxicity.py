"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes common disguises: letters that look like others (of other scripts, full width,
accented), digits that stand for letters, and characters without width. Lower case, and
everything but letters and digits parts words.

The lexicon is learned from labelled documents: whole words and beginnings of words that
toxic documents hold far more often, weighted by log odds. A document's hits are summed and
also taken in proportion to its length, and a logistic curve fitted on the same documents
turns both into a score. A hit inside an exception phrase does not count.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, random_key, unused

#: Characters of other scripts that look like Latin letters.
HOMOGLYPHS = dict(zip("авсԁеһіјкӏмոпорԛгѕтуѵшхуαβγεηικνορτυχωı", "abcdehijklmnnopqrstyvwxyabyenikvoptuxwi", strict=True))
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown")
#: Labelled documents that the lexicon is learned from, at most, by label.
LEARN_TOXIC, LEARN_CLEAN = 2500, 4000
#: A term needs this likelihood ratio (G squared), log odds and share of the toxic documents (else
#: a few copies of one document make terms of its words); the lexicon has so many terms at most.
LEAST_G2, LEAST_WEIGHT, LEAST_SHARE, MOST_TERMS = 27.0, 3.0, 0.01, 3000
PREFIXES = range(4, 9)


class _Fold(dict):
    """By code point: what it is folded to."""

    def __missing__(self, code: int) -> str:
        out = ""
        for ch in unicodedata.normalize("NFKD", chr(code)).lower():
            ch = DIGITS.get(ch, HOMOGLYPHS.get(ch, ch))
            if unicodedata.category(ch) in ("Mn", "Cf"):
                continue
            out += ("i" if ch == "l" else ch) if ch.isalnum() else " "
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> list[str]:
    """The folded words. The letters i and l are one, as the digit 1 stands for either."""
    return (text or "").translate(_FOLD).split()


def terms_of(words: Sequence[str]) -> set[str]:
    """The distinct words (' word ') and word beginnings (' wor') that may become terms."""
    out = set()
    for w in set(words):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, toxic, clean): documents of each label that hold the term, summed over parts of the task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pd.DataFrame:
        keys = list(counts[0].keys() | counts[1].keys())
        out = pd.DataFrame({"term": keys, "toxic": [counts[1][k] for k in keys], "clean": [counts[0][k] for k in keys]})
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            counts[int(label)].update(terms_of(fold(text)))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield flush()
    yield flush()


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms and weights from `sample` (text, toxic 0/1)."""
    size = sample.agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).first()
    nt, nc = size["t"], size["c"]
    if not nt or not nc:
        return {}
    seen = sample.select(F.coalesce("text", F.lit("")).alias("text"), "toxic").mapInPandas(_counts, "term string, toxic long, clean long")
    seen = seen.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share = F.lit(nt / (nt + nc))
    weight = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    both = F.col("t") + F.col("c")
    g2 = 2 * (part(F.col("t"), both * share) + part(F.col("c"), both * (1 - share)))
    found = seen.select("term", "t", weight.alias("weight"), g2.alias("g2")).filter((F.col("t") >= LEAST_SHARE * nt) & (F.col("weight") >= LEAST_WEIGHT) & (F.col("g2") >= LEAST_G2))
    rows = found.orderBy(F.desc("g2"), "term").limit(MOST_TERMS).collect()
    lexicon: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):
        term = r["term"]
        if not any(lexicon.get(term[:n], -9) >= r["weight"] - 0.7 for n in range(2, len(term))):
            lexicon[term] = r["weight"]
    return lexicon


class Matcher:
    """An Aho-Corasick automaton over terms and exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.automaton.add_word(term, (len(term), weight))
        for phrase in exceptions:
            folded = f" {' '.join(fold(phrase))} "
            if folded.strip():
                self.automaton.add_word(folded, (len(folded), None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def measure(self, text: str | None) -> tuple[float, int]:
        """(sum of the weights of words that match, the strongest term of each; number of words)."""
        words = fold(text)
        if not words or not len(self.automaton):
            return 0.0, len(words)
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, weight) in self.automaton.iter(f" {' '.join(words)} "):
            if weight is None:
                free.append((end - n + 1, end))
            else:
                best[end - n + 1] = max(weight, best.get(end - n + 1, 0.0))
        if free:
            covered = {i for a, b in free for i in range(a, b)}
            return sum(w for at, w in best.items() if at not in covered), len(words)
        return sum(best.values()), len(words)


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Columns: 1, the log of the weighted hits, the log of the weighted hits per 100 words."""
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> list[float]:
    """Logistic regression by Newton's method, with a penalty on all but the constant."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-3, *[penalty] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, toxic) of labelled documents outside the held-out fifth, so many of each label at most, by hash of the id; equal texts once."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    keyed = known.withColumn("_key", random_key(F.lit("learn"), F.col("_id")))
    some = lambda label, n: keyed.filter(F.col("toxic") == label).orderBy("_key", "_id").limit(n)
    chosen = some(1, LEARN_TOXIC).unionByName(some(0, LEARN_CLEAN)).select("_id", "toxic")
    found = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return found.groupBy("text").agg(F.max("toxic").alias("toxic"))


def held_out(id_col: str):
    """True for the fifth of ids whose label is never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], list[float]]:
    """(lexicon, curve) from labelled documents. Without both labels: an empty lexicon, and score 0 everywhere."""
    sample = cut(learning_sample(docs, labels, id_col, text_col))
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return {}, [-30.0, 0.0, 0.0]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for batch in batches:
            out = [matcher.measure(t) for t in batch["text"]]
            yield pd.DataFrame({"total": [a for a, _ in out], "words": [b for _, b in out], "toxic": batch["toxic"]})

    rows = sample.mapInPandas(measured, "total double, words long, toxic int").toPandas().sort_values(["toxic", "total", "words"])
    return lexicon, fit(features(rows["total"].to_numpy(), rows["words"].to_numpy()), rows["toxic"].to_numpy(dtype=float))


def score(docs: DataFrame, lexicon: dict[str, float], curve: list[float], text_col: str = "text", out: str = "score", exceptions: Sequence[str] = EXCEPTIONS) -> DataFrame:
    """Add `out` (0 to 1, higher: more likely toxic). Null and empty texts have no hits and get the curve's lowest value."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(lexicon, exceptions)
        for texts in batches:
            found = [matcher.measure(t) for t in texts]
            x = features(np.array([a for a, _ in found], dtype=float), np.array([b for _, b in found], dtype=float)) if found else np.zeros((0, 3))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(curve), -30, 30))))

    return docs.withColumn(out, of(F.col(text_col)))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted. Rows that repeat an id are scored each by its text."""
    lexicon, curve = learn(docs, labels, id_col, text_col)
    scored = score(docs.select(F.col(id_col), F.col(text_col).alias("_text")), lexicon, curve, "_text")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without those that score `threshold` or more."""
    lexicon, curve = learn(docs, labels, id_col, text_col)
    own = unused(docs, "_toxicity")
    return score(docs, lexicon, curve, text_col, own).filter(F.col(own) < threshold).drop(own)
