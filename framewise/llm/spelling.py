"""Spelling variants: words one edit apart, found in a reduced alphabet and verified as they are written.

Letters are hashed to a few symbols. The whole neighbourhood of a reduced word (each deletion, replacement and insertion of one symbol) is
joined with the reduced vocabulary. An edit leaves three of the four parts of a word untouched, so a key holds, beside the neighbour, these
three parts in their real letters: candidates stay few, however many words of a large vocabulary share a reduced form. The words themselves
decide.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import stage
from framewise.scale import bind

#: Letters of a run (fixed by the contract), as a class of a regular expression and as code points.
LETTER = "A-Za-zÀ-ÿ"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
SYMBOLS = "012"
#: Parts of a word, all but one of which an edit spares.
PARTS = 4
#: Words whose neighbours one task makes: about 1.5 million keys.
WORDS_A_TASK = 20_000


def lowered(word: Column) -> Column:
    """A-Z in lower case, all other letters of a run as they are. Only runs with capitals beyond ASCII need the slow way."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(word.rlike("[À-Þ]"), F.translate(word, upper, upper.lower())).otherwise(F.lower(word))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 7, least_n: int = 2, slip: int = 31) -> DataFrame:
    """``word, n`` of the whole texts of ``docs``: words of at least ``least_chars`` letters that occur ``least_n`` times or more.

    A run whose hash with its id is divisible by ``slip`` loses the letter the hash points at. Words are counted where they are read
    before they are sent, so a very common one costs no more than a rare one. A null id is hashed as the empty string.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTER}]{{{least_chars},}}"), F.lit(0))
    said = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    said = said.select("id", lowered(F.col("run")).alias("run"))
    said = said.select("run", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run"))).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.length("run")))
    words = said.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def reduced(word: Column) -> Column:
    return F.translate(word, LETTERS, "".join(SYMBOLS[zlib.crc32(c.encode()) % len(SYMBOLS)] for c in LETTERS))


def _cuts(size: Column) -> list[Column]:
    """Where the parts of a word of ``size`` letters begin, but for the first, and where the last one ends."""
    return [F.floor(size * k / PARTS).cast("int") for k in range(1, PARTS + 1)]


def _first(word: Column, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def _spared(word: Column, size: Column) -> list[Column]:
    """Hashes of the letters outside each part, for a word of ``size`` letters that differs from ``word`` in that part alone."""
    cuts = [F.lit(0), *_cuts(size)]
    last = lambda n: F.substring(word, F.length(word) - n + 1, n)
    return [F.xxhash64(F.lit(k), _first(word, cuts[k]), last(size - cuts[k + 1])) for k in range(PARTS)]


def _part(before: list[Column], part: list[Column]) -> Column:
    """The first of ``part`` whose test in ``before`` holds, else the last: one test for each part but the last."""
    found = part[-1]
    for test, value in reversed(list(zip(before, part, strict=False))):
        found = F.when(test, value).otherwise(found)
    return found


#: Kinds of edits: change of length, letters dropped after the place, symbols put there.
EDITS = {"less": (-1, 2, False), "other": (0, 2, True), "more": (1, 1, True)}


def neighbour_keys(words: DataFrame) -> DataFrame:
    """``id, key``: keys of all one-edit neighbours of every reduced word; a replacement by the same symbol is the reduced word itself."""
    word, form, size = F.col("word"), F.col("form"), F.length("word")
    bound = {"form": reduced(word), "size": size}
    for kind, (change, _, _) in EDITS.items():
        bound |= {f"{kind}_{k}": c for k, c in enumerate([*_spared(word, size + change), *_cuts(size + change)])}
    ready = bind(words.select("id", "word"), **bound)

    def keys(kind: str) -> Column:
        _, after, puts = EDITS[kind]
        spared, cuts = ([F.col(f"{kind}_{k}") for k in r] for r in (range(PARTS), range(PARTS, 2 * PARTS - 1)))

        def at(i: Column) -> Column:
            head, tail = _first(form, i), F.substring(form, i + after, F.col("size"))
            part = _part([i < c for c in cuts], spared)
            return F.array(*[F.xxhash64(F.concat(head, F.lit(s), tail), part) for s in (SYMBOLS if puts else ("",))])

        places = F.sequence(F.lit(0), F.col("size") if kind == "more" else F.col("size") - 1)
        return F.flatten(F.transform(places, at))

    return ready.select("id", F.explode(F.array_distinct(F.concat(*[keys(kind) for kind in EDITS]))).alias("key"))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, best`` of every row of ``words`` (``word, n``, words distinct and not empty): how many words differ from it by exactly one
    letter, and the commonest of them as (-n, word).

    Both sides of the join are dealt by 64-bit keys. A pair is taken from the key that spares the part with its first difference, so it comes
    once from either end.
    """
    words = stage(words.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    spread = words.repartition(1 + words.count() // WORDS_A_TASK, "id")
    shown = F.array(*[F.struct(F.lit(k).alias("part"), c.alias("spared")) for k, c in enumerate(_spared(F.col("word"), F.length("word")))])
    own = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"), reduced(F.col("word")).alias("form"), F.inline(shown))
    own = own.select("other", "other_n", "part", F.xxhash64("form", "spared").alias("key"))
    found = neighbour_keys(spread).join(own, "key").select(F.col("id").alias("found_id"), "other", "other_n", "part")
    differ = lambda n: _first(F.col("word"), n) != _first(F.col("other"), n)
    first = _part([differ(c) for c in _cuts(F.length("other"))[:-1]], [F.lit(k) for k in range(PARTS)])
    near = (F.levenshtein("word", "other", 1) == 1) & (first == F.col("part"))
    return (words.join(found, (F.col("id") == F.col("found_id")) & near, "left").groupBy("id", "word", "n")
            .agg(F.count("other").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")).drop("id"))


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", factor: int = 10, **limits: int) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (see :func:`vocabulary` for ``limits``).

    The form of a word is its commonest near word (of equally common ones the first in code-point order) if that occurs ``factor`` times as often
    or more, else null. The root is the last word of the chain of forms. Along a chain n grows ``factor``-fold, so its length is at
    most log(n) and each round of joins doubles the reach. Null and empty texts have no words; repeated rows count
    as often as they stand there; a table without words gives an empty result.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more: chains of forms must end")
    near = near_words(vocabulary(docs, doc_id, text, **limits))
    taken = -F.col("best.n") >= factor * F.col("n")
    formed = stage(near.select("word", F.when(taken, F.col("best.word")).alias("form"), "n", "n_near", F.when(taken, -F.col("best.n")).alias("form_n")), "forms")
    most = formed.agg(F.max("n")).first()[0] or 0
    steps = 0  # the longest chain that counts allow
    while factor ** (steps + 1) <= most:
        steps += 1
    chain, reach = formed.where("form is not null").select("word", F.col("form").alias("root")), 1
    while reach < steps:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chain, reach = stage(chain.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots"), 2 * reach
    return formed.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
