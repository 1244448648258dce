"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import fresh, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Check of an international account number: country and check digits go last, letters count from 10."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Length of an account number by country. A number cut out of a longer match must have its country's; others are only checked.
LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in cs.split()}

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """From each @ leftwards over the local part and rightwards over the domain: the leftmost matches, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        else:
            done = at + 1
        at = text.find("@", done)


def ips(text: str) -> Iterator[Span]:
    """Runs of dotted numbers, four numbers at a time from the left; numbers over 255 drop the four."""
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, start = run.split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield "ip", start, end
            start = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """The four base kinds in the order of BASE_KINDS, each leftmost and without overlaps; matches that fail a check are dropped."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    if _DIGIT.search(text):
        found += ips(text)
        found += cards(text)
    if "+" in text:
        found += phones(text)
    return found


_DIGIT = re.compile("[0-9]")


@dataclass(frozen=True)
class Proposal:
    """A further kind: what its pattern matches, or the start of that which ``starts`` finds (0: nothing), scores ``prior``, plus ``checked`` if the validator agrees (else it is dropped, where
    there is one), plus ``context`` if one of its words stands within ``reach`` characters before it or half as many after it,
    less ``against`` if a word that speaks against it does."""

    kind: str
    pattern: str
    prior: float
    needs: str = ""
    valid: Callable[[str], bool] | None = None
    checked: float = 0.0
    words: tuple[str, ...] = ()
    context: float = 0.0
    against: tuple[str, ...] = ()
    penalty: float = 0.0
    reach: int = 40
    starts: Callable[[str], int] | None = None
    compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern))

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end of what is proposed and valid. After a start that ``starts`` refuses, the next one in the match is tried."""
        at = 0
        while m := self.compiled.search(text, at):
            a, b = m.span()
            n = b - a if self.starts is None else self.starts(m.group())
            at = a + (n or 1)
            if n and (self.valid is None or self.valid(text[a : a + n])):
                yield a, a + n


def _iban(s: str) -> int:
    """Length of the account number that ``s`` starts with, as written: the longest that ends where a group ends and holds the check,
    since the pattern also takes capital words that follow. 0 if there is none."""
    for end in [len(s), *(i for i in range(len(s) - 1, 0, -1) if s[i] in " -")]:
        code = s[:end].replace(" ", "").replace("-", "")
        if 15 <= len(code) <= 34 and (end == len(s) or len(code) == LENGTHS.get(code[:2], len(code))) and mod97(code):
            return end
    return 0


def _short_card(s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    return 13 <= len(digits) <= 15 and luhn(digits)


def _national(s: str) -> bool:
    return 8 <= sum(c.isdigit() for c in s) <= 15


def _ssn(s: str) -> bool:
    area, group, serial = s[:3], s[4:6], s[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


PROPOSALS = (
    Proposal("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.2, starts=_iban, checked=0.6,
             words=("iban", "account", "konto", "compte", "cuenta", "bank"), context=0.2),
    Proposal("card", r"(?<![0-9A-Za-z.])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9A-Za-z])", 0.1, valid=_short_card, checked=0.2,
             words=("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"), context=0.4,
             against=("order", "invoice", "isbn", "id"), penalty=0.2),
    Proposal("phone", r"(?<![0-9A-Za-z+.(-])\(?[0-9]{2,4}\)?(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9A-Za-z])", 0.2, valid=_national, checked=0.1,
             words=("phone", "tel", "telephone", "mobile", "call", "fax", "telefon", "téléphone", "teléfono", "móvil"), context=0.4,
             against=("version", "isbn", "date"), penalty=0.3),
    Proposal("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, valid=_ssn, checked=0.3, words=("ssn", "social", "security", "taxpayer"),
             context=0.3),
    Proposal("secret", r"(?<![A-Za-z0-9_])[A-Za-z0-9_/+=-]{32,64}(?![A-Za-z0-9_/+=-])", 0.1, needs="=:",
             valid=lambda s: any(c.isdigit() for c in s) and sum(c.isdigit() for c in s) >= 6 and any(c.isalpha() for c in s), checked=0.1,
             words=("token", "secret", "password", "passwd", "api_key", "apikey", "key"), context=0.5),
)


def _nearby(words: tuple[str, ...], before: str, after: str) -> bool:
    near = re.findall(r"\w+", f"{before} {after}".lower())
    return any(w in near for w in words)


def proposed_spans(text: str, proposals: tuple[Proposal, ...] = PROPOSALS, least: float = 0.6) -> list[tuple[str, int, int, float]]:
    """Spans of the further kinds with a score of ``least`` or more."""
    out = []
    for p in proposals:
        if p.needs and not any(c in text for c in p.needs):
            continue
        for a, b in p.found(text):
            score = p.prior + p.checked * (p.valid is not None or p.starts is not None)
            before, after = text[max(0, a - p.reach) : a], text[b : b + p.reach // 2]
            score += p.context * _nearby(p.words, before, after) - p.penalty * _nearby(p.against, before, after)
            if score >= least:
                out.append((p.kind, a, b, round(score, 3)))
    return out


def all_spans(text: str, proposals: tuple[Proposal, ...] = PROPOSALS, least: float = 0.6) -> tuple[list[Span], list[Span]]:
    """(base spans, base and further spans). A further span that overlaps a base one, or a further one of higher score, is left out."""
    base = base_spans(text)
    if not _DIGIT.search(text):
        return base, base
    taken, more = sorted((a, b) for _, a, b in base), []
    for kind, a, b, _ in sorted(proposed_spans(text, proposals, least), key=lambda s: -s[3]):
        i = bisect.bisect_left(taken, (b, -1))
        if all(y <= a for _, y in taken[max(0, i - len(BASE_KINDS)) : i]):
            bisect.insort(taken, (a, b))
            more.append((kind, a, b))
    order = {k: i for i, k in enumerate([*BASE_KINDS, *dict.fromkeys(p.kind for p in proposals if p.kind not in BASE_KINDS)])}
    return base, sorted({*base, *more}, key=lambda s: (order[s[0]], s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.6) -> DataFrame:
    """``doc_id``, counts of the base kinds, ``base`` and ``spans`` (kind:start:end, comma-joined) of every row of ``docs``.

    Null and empty texts have no spans and empty strings. Positions are code points, ends exclusive. Base spans are always there;
    further ones come from PROPOSALS. Every pattern takes time in proportion to the text. Repeated rows get the same row.
    """

    def scan(texts: list[str | None]) -> tuple:
        found = [all_spans(t or "", least=least) for t in texts]
        counts = [[sum(k == kind for k, _, _ in base) for base, _ in found] for kind in BASE_KINDS]
        return [*counts, [joined(base) for base, _ in found], [joined(every) for _, every in found]]

    kinds = {f"n_{k}": "long" for k in BASE_KINDS} | {"base": "string", "spans": "string"}
    return map_batches(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), scan, kinds)


def redact(text: str, least: float = 0.6) -> str:
    """Each maximal run of overlapping spans becomes the name of its first kind in angle brackets."""
    out, done, until, kind = [], 0, -1, ""
    for k, a, b in sorted(all_spans(text, least=least)[1], key=lambda s: (s[1], -s[2])):
        if a >= until:
            if until >= 0:
                out.append(f"<{kind.upper()}>")
                done = until
            out.append(text[done:a])
            kind, until = k, b
        else:
            until = max(until, b)
    if until >= 0:
        out.append(f"<{kind.upper()}>")
        done = until
    out.append(text[done:])
    return "".join(out)


def redact_documents(docs: DataFrame, text: str = "text", least: float = 0.6) -> DataFrame:
    """``docs`` with all rows and columns and the personal data in ``text`` replaced.

    A null text stays null, an empty one empty; ids are not read, so null and repeated ones pass; equal texts are changed alike. A run of
    overlapping spans takes the name of its first kind. An empty table stays empty.
    """

    def clean(texts: list[str | None]) -> tuple:
        return pa.array([None if t is None else redact(t, least) for t in texts], pa.string()),

    new = fresh(docs, "_clean")
    names = docs.columns
    copied = docs.withColumn(fresh(docs, "_raw"), F.col(text))
    done = map_batches(copied, clean, {new: "string"}, reads=(fresh(docs, "_raw"),))
    return done.select(*[F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in names])
