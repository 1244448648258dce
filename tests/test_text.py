import random
import re

import pytest
from pyspark.sql import functions as F

from framewise import constants as C
from framewise.functions import text as T
from framewise.operators import validation as VA


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "v string").select(*cols).first()


@pytest.mark.parametrize("raw, want", [
    ('{"angle":"high","size":"wide","motion":"pan"}', {"angle": "high", "size": "wide", "motion": "pan"}),
    ('{"motion":"  TILT"}', {"motion": "tilt"}), ('{"angle":"sideways","size":"full"}', {"size": "full"}), ('{"size":3}', {}),
    ('{"people":2,"size":"medium"}', {"people": 2, "size": "medium"}), ('{"people":0}', {}), ('{"people":"two"}', {}),
    ('{"lens":85,"motion":"orbit"}', {"motion": "orbit"}), ('"wide"', {}), ("not json", {})])
def test_untrusted_requests(spark, raw, want):
    row = one(spark, raw, *[c.alias(n) for n, c in VA.clean_request(F.col("v")).items()]).asDict()
    assert {k: v for k, v in row.items() if v is not None and v is not False} == want


@pytest.mark.parametrize("url, want", [
    ("https://player.pexels.com/clips/44.mp4", True), ("http://pixabay.com/videos/sea-9/", True), ("https://ia800.us.archive.org/3/items/z.mp4", True),
    ("https://commons.wikimedia.org/wiki/File:B.webm", True), ("https://video.example.net/pexels.com", False), ("https://archive.org.example.net/a", False),
    ("ftp-archive", False)])
def test_download_hosts(spark, url, want):
    assert one(spark, url, T.url_class(F.col("v"))["download_allowed"].alias("a"))["a"] is want


@pytest.mark.parametrize("text, want", [
    ("0:07 - 0:09.25", (7.0, 9.25, None)), ("1:01:01-1:01:02", (3661.0, 3662.0, None)), (" ", (None, None, None)), ("33-33", (None, None, "order")),
    ("5:4:3:2 - 9", (None, None, "time")), ("from 3 to 4", (None, None, "format")), ("12-", (None, None, "format"))])
def test_sections(spark, text, want):
    row = one(spark, text, *[c.alias(n) for n, c in T.parse_section(F.col("v")).items()])
    assert tuple(row) == want


def test_titles_and_answers(spark):
    assert one(spark, "A  b/c__d!", T.safe_title(F.col("v")).alias("t"))["t"] == "A_b_c_d"
    assert one(spark, "!!!", T.safe_title(F.col("v")).alias("t"))["t"] == "LinkReference"
    said = "<think>{no}</think> here:\n{\"a\": {\"b\": 1}} done"
    assert one(spark, said, T.extract_json_answer(F.col("v")).alias("t"))["t"] == '{"a": {"b": 1}}'


def test_bone_names(spark):
    def score(name, tokens):
        return one(spark, name, T.bone_name_score(F.col("v"), tokens).alias("s"))["s"]
    assert score("mixamorig:Hips", ["hips"]) == 0.70
    assert score("Bip001 Pelvis", ["pelvis"]) == 0.64
    assert score("spine_01", ["spine"]) == 0.64 and score("myspine1", ["spine"]) == 0.56 and score("leg", ["arm"]) == 0.0


def test_phrases_equal_plain_patterns(spark):
    """Clauses are searched only where a needle is; the phrases are those of all patterns on every clause, and clauses those of the plain split."""
    tables = (C.SIZE_PATTERNS, C.ANGLE_PATTERNS, C.MOTION_PATTERNS, C.PEOPLE_PATTERNS)
    rng = random.Random(5)
    parts = [a for t in [*tables, [(C.SPLIT_PATTERN, "")]] for p, _ in t for a in re.split(r"\|(?![^(]*\))", p)]
    shown = [re.sub(r"\\b|\(\?<!.\)|[()?]", "", re.sub(r"\\s[*+]|\[[^]]*\]\*", " ", re.sub(r"\((?:\?:)?([^|)]*)[^)]*\)", r"\1", a))) for a in parts]
    odd = str.maketrans({"i": "\u0130", "k": "\u212a", "s": "\u017f"})
    forms = [str, str.upper, str.title, lambda x: x.translate(odd), lambda x: x.replace("i", "\u0131"), lambda x: x.replace(" ", "-"), lambda x: x[1:]]
    texts = ["".join(rng.choice(forms)(rng.choice(shown)) + rng.choice(["", " ", ", ", "  x", "\n", "마"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += [f(x) for x in shown for f in forms] + [None, ""]
    clauses = F.filter(F.transform(F.split("v", T.ci(C.SPLIT_PATTERN)), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    plain = lambda c, t: F.coalesce(*[F.nullif(F.regexp_extract(c, T.ci(f"({p})"), 1), F.lit("")) for p, _ in t])
    want = F.flatten(F.transform(clauses, lambda c: F.array_compact(F.array(*[plain(c, t) for t in tables]))))
    rows = spark.createDataFrame([(x,) for x in texts], "v string").select("v", T.understood_phrases(F.col("v")).alias("got"), want.alias("want"), T.split_clauses(F.col("v")).alias("c"), clauses.alias("d")).collect()
    assert [r for r in rows if r.got != r.want or r.c != r.d] == []
    assert len({x for r in rows for x in r.got or []}) > 150
    letters = spark.range(128, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("v"))
    assert letters.where(F.col("v").rlike(T.ci("[a-z]")) & ~T.folds_to_ascii(F.col("v"))).count() == 0


def test_needles():
    assert T.needles(r"bird'?s?[\s-]*eye|(?<!마)무리|full[\s-]*(shot|body)") == ["bird", "무리", "full"]
    assert T.needles(r"wide|\d+") == T.needles("a.c") == T.needles("ab{0,1}") == []
