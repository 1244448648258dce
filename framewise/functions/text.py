"""Text, name and URL expressions."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewise import constants as C


def ci(pattern: str) -> str:
    return "(?iu)" + pattern


def normal_name(name: Column) -> Column:
    plain = F.replace(F.replace(F.lower(name), F.lit("mixamorig:"), F.lit("")), F.lit("bip001"), F.lit(""))
    return F.translate(plain, ".- ", "___")


def bone_name_score(name: Column, tokens: list[str], normalised: bool = False) -> Column:
    """Best evidence of a name for a token list: exact 0.70, affix 0.64, contained 0.56."""
    n = name if normalised else normal_name(name)
    plain = [t.lower().replace("mixamorig:", "").replace("bip001", "").translate(str.maketrans(".- ", "___")) for t in tokens]
    affix = F.lit(False)
    inside = F.lit(False)
    for t in plain:
        affix = affix | n.endswith("_" + t) | n.startswith(t + "_")
        inside = inside | n.contains(t)
    return F.when(n.isin(plain), 0.70).when(affix, 0.64).when(inside, 0.56).otherwise(F.lit(0.0))


def contains_any(name: Column, tokens: list[str]) -> Column:
    return normal_name(name).rlike("|".join(tokens))


def aux_bone_class(name: Column) -> dict[str, Column]:
    n = normal_name(name)
    # Spellings that mark the left side.
    left = ("left|^l_|_l$|riglarm|riglleg|_larm|_lleg|flleg|blleg|lfrontleg|lbackleg|llegfront|llegback")
    return {"is_twist": contains_any(name, C.TWIST_TOKENS), "is_finger": contains_any(name, C.FINGER_TOKENS),
            "is_face": contains_any(name, C.FACE_TOKENS), "is_left": n.rlike(left)}


#: The connectives, tried only at characters that one can begin with.
SPLIT = ci("(?=(?-iu:[-→⇒,，;TtFfAa가-힣]))(?:" + C.SPLIT_PATTERN + ")")


def split_clauses(text: Column) -> Column:
    """Ordered non-empty clauses of a written request."""
    parts = F.transform(F.split(text, SPLIT), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def first_label(text: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike(ci(p)), F.lit(v)) for p, v in patterns])


def needles(pattern: str) -> list[str]:
    """Lower-case strings of which every match of ``pattern`` has one: the longest literal of each alternative. Empty if one has none."""
    found = []
    for alternative in re.split(r"\|(?![^(]*\))", pattern):
        literals = re.split(r"\(\?<!.\)|\([^()]*\)[*+?]?|\[[^]]*\][*+?]?|\\.[*+?]?|.[*?]", alternative)
        longest = max(literals, key=lambda x: len(x.encode()))
        if not longest or re.search(r"[][(){}^$.*+?\\]", longest):
            return []
        found.append(longest.lower())
    return found


def first_text(text: Column, patterns: list[tuple[str, str]], lower: Column, odd: Column, hangul: Column) -> Column:
    """The words that gave the label. A pattern is tried where ``lower``, the text in lower case, holds one of its :func:`needles`, or where
    the text is ``odd`` (:func:`folds_to_ascii`); ``hangul`` says whether there are syllables, which most needles need."""
    found = []
    for p, _ in patterns:
        words = F.nullif(F.regexp_extract(text, ci("(" + p + ")"), 1), F.lit(""))
        any_of = lambda xs: functools.reduce(Column.__or__, [lower.contains(x) for x in xs], F.lit(False))
        korean = [x for x in needles(p) if re.search("[가-힣]", x)]
        may = odd | any_of([x for x in needles(p) if x not in korean]) | (hangul & any_of(korean))
        found.append(F.when(may, words) if needles(p) else words)
    return F.coalesce(*found)


def folds_to_ascii(text: Column) -> Column:
    """Holds a letter beyond ASCII that patterns without case take for i, k or s, and that lower case does not give."""
    return text.contains("\u0130") | text.contains("\u0131") | text.contains("\u017f") | text.contains("\u212a")


def request_of(clause: Column) -> dict[str, Column]:
    """Labels asked for by one clause; an over-the-shoulder request means one person, medium by default."""
    people = first_label(clause, C.PEOPLE_PATTERNS)
    ots = F.coalesce(people == "ots", F.lit(False))
    return {
        "size": F.coalesce(first_label(clause, C.SIZE_PATTERNS), F.when(ots, F.lit("medium"))),
        "angle": first_label(clause, C.ANGLE_PATTERNS),
        "motion": first_label(clause, C.MOTION_PATTERNS),
        "people": F.when(ots, F.lit(1)).otherwise(people.try_cast("int")),
        "ots": ots,
    }


def understood_phrases(text: Column) -> Column:
    """Phrases of all clauses that were turned into labels."""
    tables = (C.SIZE_PATTERNS, C.ANGLE_PATTERNS, C.MOTION_PATTERNS, C.PEOPLE_PATTERNS)
    clauses = F.transform(split_clauses(text), lambda c: F.struct(c.alias("text"), F.lower(c).alias("lower"), folds_to_ascii(c).alias("odd"),
                                                               c.rlike("[가-힣]").alias("hangul")))
    return F.flatten(F.transform(clauses, lambda c: F.array_compact(
        F.array(*[first_text(c["text"], t, c["lower"], c["odd"], c["hangul"]) for t in tables]))))


def residual_keywords(text: Column, used: Column) -> Column:
    """Words left after the understood phrases and connectives are taken out."""
    rest = F.aggregate(used, text, lambda left, phrase: F.replace(left, phrase, F.lit(" ")))
    words = F.regexp_extract_all(F.lower(F.regexp_replace(rest, SPLIT, " ")),
                                 F.lit(r"([0-9A-Za-z가-힣]{2,})"), 1)
    bare = F.transform(words, lambda x: F.when(x.rlike("[가-힣]"), F.regexp_replace(x, C.PARTICLES, "")).otherwise(x))
    stop = F.array(*[F.lit(s) for s in C.STOPWORDS])
    return F.filter(bare, lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x))


def parse_clock(text: Column) -> Column:
    """``h:m:s`` / ``m:s`` / ``s`` to seconds; null when it is not a clock."""
    parts = F.split(F.trim(text), ":")
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^\s*\d*\.?\d+\s*$|^\s*\d+\.\s*$"), p.try_cast("double")))
    fine = (F.size(parts) <= 3) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(fine, F.aggregate(numbers, F.lit(0.0), lambda a, x: a * 60.0 + x))


def parse_section(text: Column) -> dict[str, Column]:
    """``a-b`` to seconds with the reason when it is refused; empty text is a whole video."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    shape = r"^([\d:.]+)\s*-\s*([\d:.]+)$"
    start, end = parse_clock(F.regexp_extract(plain, shape, 1)), parse_clock(F.regexp_extract(plain, shape, 2))
    error = (F.when(plain == "", F.lit(None).cast("string")).when(~plain.rlike(shape), "format")
             .when(start.isNull() | end.isNull(), "time").when(end <= start, "order"))
    good = (plain != "") & error.isNull()
    return {"section_start": F.when(good, start), "section_end": F.when(good, end), "error": error}


def safe_title(title: Column, default: str = "LinkReference") -> Column:
    clean = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}_-]", "_")
    clean = F.regexp_replace(F.regexp_replace(clean, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(clean, 1, 60), F.lit("")), F.lit(default))


def fingerprint(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def url_host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def url_class(url: Column, domains: list[str] | None = None) -> dict[str, Column]:
    domains = C.ALLOWED_DOMAINS if domains is None else domains
    host = url_host(url)
    allowed = F.lit(False)
    for d in domains:
        allowed = allowed | (host == d) | host.endswith("." + d)
    local = F.lower(url).startswith("http://localhost") | url.startswith("http://127.0.0.1")
    return {"well_formed": url.rlike(r"^https?://") & ~url.rlike(r"\s"), "download_allowed": allowed,
            "is_local": local, "endpoint_allowed": F.lower(url).startswith("https://") | local}


def extract_json_answer(text: Column) -> Column:
    """Text from the first ``{`` to the last ``}`` after the last thinking block."""
    tail = F.regexp_replace(text, r"(?is)^.*</think>", "")
    body = F.regexp_extract(tail, r"(?s)(\{.*\})", 1)
    return F.when(body == "", F.trim(tail)).otherwise(body)
