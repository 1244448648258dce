"""Quality rules under weak supervision: rules vote or abstain, EM estimates how often each is right, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import fresh, map_batches

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = b"#*$%&|<>"
#: What isn't the first byte of a character of a word: white space, and the later bytes of longer characters.
NOT_CHARS = b" \t\n\x0b\x0c\r" + bytes(range(128, 192))
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_letters", "n_marks", "n_closed"]


def _among(raw: bytes, kinds: bytes) -> int:
    return len(raw) - len(raw.translate(None, kinds))


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that are found twice or more, the first included."""
    if len(words) <= n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(w), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for i in range(n):
        covered[i : i + len(w)] |= again
    return int(covered.sum())


def counts(raw: bytes | None) -> tuple[int, ...]:
    """COUNTS and EXTRA of one whole text in UTF-8; null counts as empty."""
    raw = raw or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    closed = sum(x.rstrip()[-1:] in b".!?:\"" for x in lines)
    return (len(words), len(raw.translate(None, NOT_CHARS)), _among(raw, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), _among(raw, UPPER), _among(raw, LETTERS), raw.count(b"!"), closed)


INF = float("inf")
Bound = tuple[str, str, float, float]


@dataclass(frozen=True)
class Rule:
    """Votes bad (-1) if a ratio of ``fair`` is out of bounds, good (+1) if all of ``good`` are within, else abstains (0).

    A bound is (top, under, low, high) on top / under. A rule that looks for one defect has no ``good``: that it finds none says
    nothing about the others. A good vote takes several signs at once, so that no rule votes on nearly every text.
    """

    name: str
    fair: tuple[Bound, ...] = ()
    good: tuple[Bound, ...] = ()

    def vote(self, f: pd.DataFrame) -> np.ndarray:
        def ratio(top: str, under: str) -> np.ndarray:
            d = f[under].to_numpy(float)
            return np.divide(f[top].to_numpy(float), d, out=np.full(len(f), np.nan), where=d > 0)

        good, bad = np.full(len(f), bool(self.good)), np.zeros(len(f), bool)
        for top, under, low, high in self.good:
            good &= (ratio(top, under) >= low) & (ratio(top, under) <= high)
        for top, under, low, high in self.fair:
            bad |= (ratio(top, under) < low) | (ratio(top, under) > high)
        return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


#: Each defect has two views where it can, so that a rule that is right is seldom alone.
RULES = (
    Rule("prose", good=(("word_chars", "n_words", 3.0, 8.5), ("n_symbols", "n_words", 0.0, 0.02), ("n_upper", "n_letters", 0.0, 0.2),
                        ("n_marks", "n_words", 0.0, 0.05), ("n_dup_lines", "n_lines", 0.0, 0.5), ("n_repeat_words", "n_words", 0.0, 0.4))),
    Rule("word_length", (("word_chars", "n_words", 2.0, 12.0),)),
    Rule("symbols_a_word", (("n_symbols", "n_words", 0.0, 0.1),)),
    Rule("symbols_a_char", (("n_symbols", "word_chars", 0.0, 0.025),)),
    Rule("repeated_lines", (("n_dup_lines", "n_lines", 0.0, 0.5),)),
    Rule("repeated_words", (("n_repeat_words", "n_words", 0.0, 0.4),)),
    Rule("capitals", (("n_upper", "n_letters", 0.0, 0.4),)),
    Rule("exclamations", (("n_marks", "n_words", 0.0, 0.2),)),
    Rule("closed_lines", (("n_closed", "n_lines", 0.2, INF),)),
    Rule("words_a_line", (("n_words", "n_lines", 1.5, INF),)),
)


@dataclass(frozen=True)
class LabelModel:
    """P(good) and, per rule, how often its vote is right. An abstention says nothing."""

    prior: float
    accuracy: tuple[float, ...]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        a = np.array(self.accuracy)
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + votes @ np.log(a / (1 - a)))))


def fit_label_model(votes: np.ndarray, n: np.ndarray, steps: int = 100, weight: float = 20.0) -> LabelModel:
    """EM over distinct vote patterns and how many texts have each: at most 3 ** rules rows, whatever the corpus.

    Starts from P(good) 0.8 and accuracy 0.85; ``weight`` pseudo-votes hold a rule there while it has few votes of its own.
    Accuracies stay within (0.55, 0.995): a rule is taken to be better than chance, so the classes can't swap.
    """
    start = 0.85
    model = LabelModel(0.8, (start,) * votes.shape[1])
    for _ in range(steps if n.sum() else 0):
        good = model.posterior(votes)
        right = (((votes > 0) * good[:, None] + (votes < 0) * (1 - good[:, None])) * n[:, None]).sum(0)
        cast = ((votes != 0) * n[:, None]).sum(0)
        prior = ((good * n).sum() + 0.8 * weight) / (n.sum() + weight)
        model = LabelModel(float(np.clip(prior, 0.01, 0.99)), tuple(map(float, np.clip((right + start * weight) / (cast + weight), 0.55, 0.995))))
    return model


def _features(texts: Iterable[bytes | None]) -> pd.DataFrame:
    return pd.DataFrame([counts(t) for t in texts], columns=COUNTS + EXTRA, dtype="int64")


def _votes(f: pd.DataFrame, rules: tuple[Rule, ...]) -> np.ndarray:
    return np.stack([r.vote(f) for r in rules], axis=1) if len(f) else np.zeros((0, len(rules)), np.int8)


def learn_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """Vote patterns of all texts, counted where they are read; the driver gets a row per pattern and runs EM."""

    def patterns(texts: list[bytes | None]) -> list[list[str]]:
        return ["".join("-0+"[x + 1] for x in v) for v in _votes(_features(texts), rules)],

    raw = docs.select(F.col(text).cast("binary").alias("text"))
    found = map_batches(raw, patterns, {"pattern": "string"}).groupBy("pattern").count().collect()
    votes = np.array([["-0+".index(c) - 1 for c in r.pattern] for r in found], dtype=float).reshape(len(found), len(rules))
    order = np.lexsort(votes.T)
    return fit_label_model(votes[order], np.array([r["count"] for r in found], dtype=float)[order])


def judge(f: pd.DataFrame, model: LabelModel, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> pd.DataFrame:
    """Adds base_failed, quality (posterior probability) and kept."""
    f["base_failed"] = (f.n_words < 50) | (100 * f.n_repeat_words > 50 * f.n_words)
    f["quality"] = model.posterior(_votes(f, rules).astype(float))
    f["kept"] = ~f.base_failed & (f.quality >= least)
    return f


def score_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, the counts, base_failed, kept and quality of every row of ``docs``.

    Null and empty texts have no words: base_failed. Repeated rows each get the same row. An empty table gives an empty result.
    Two passes over the text; only vote patterns are shuffled, counted first where they are read.
    """
    model = learn_rules(docs, text, rules)
    kinds = dict.fromkeys(COUNTS, "long") | {"base_failed": "boolean", "kept": "boolean", "quality": "double"}

    def score(texts: list[bytes | None]) -> list[np.ndarray]:
        f = judge(_features(texts), model, rules)
        return [f[c].to_numpy() for c in kinds]

    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")), score, kinds)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Null and empty texts have no words and fail the base rules. Ids are not read; equal texts are judged alike and count as often as they
    stand there when the rules are learned. An empty table stays empty.
    """
    model = learn_rules(docs, text, rules)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return judge(_features(texts), model, rules)["kept"]

    verdict = fresh(docs, "_kept")
    return docs.withColumn(verdict, good(F.col(text).cast("binary"))).where(F.col(verdict)).drop(verdict)
