"""Fill-in-middle: texts cut at unit borders found by word-wide byte arithmetic, and put back together in another order.

A unit is a word with the white space before it, or the white space at the end of a text. Texts are read as rows of uint64, eight
UTF-8 bytes each. Arithmetic on a whole uint64 sets the top bit of every byte that ends a unit; bits are counted per uint64, a search in
the running counts finds the one that holds the unit asked for, and the bit inside it is found by clearing the bits before it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import map_batches
from framewise.llm.words import chunks

#: Marks in front of prefix, suffix and middle (fixed by the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Later bytes of characters of several bytes.
_LATER = bytes(range(128, 192))


def _every(byte: int) -> np.uint64:
    return np.uint64(byte * 0x0101010101010101)


_TOP, _LOW, _BLANK = _every(0x80), _every(0x7F), _every(0x20)
_PADS = [b" " * (8 - k) for k in range(8)]


def space_bits(x: np.ndarray) -> np.ndarray:
    """Top bit of every byte that is ASCII white space (0x20, 0x09 to 0x0D). No sum passes from one byte to the next: both
    summands of a byte are below 0x80."""
    low = x & _LOW
    blank = ~(((x ^ _BLANK) & _LOW) + _LOW | (x ^ _BLANK))
    control = (low + _every(0x80 - 0x09)) & ~(low + _every(0x80 - 0x0E)) & ~x
    return (blank | control) & _TOP


@dataclass
class Units:
    """Ends of the units of many texts: a bit per end, the running count of bits, and the first uint64 of each text."""

    ends: np.ndarray
    total: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(texts: list[bytes]) -> Units:
        """Every text is filled up with one to eight blanks, so that a word at its end is followed by white space as any other."""
        x = np.frombuffer(b"".join([y for t in texts for y in (t, _PADS[len(t) & 7])]), "<u8")
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(size // 8 + 1)])
        space = space_bits(x)
        after = space >> np.uint64(8)
        after[:-1] |= space[1:] << np.uint64(56)
        ends = ~space & after & _TOP
        some = size > 0
        last = size[some] - 1
        at = first[:-1][some] + last // 8
        ends[at] |= space[at] & (np.uint64(0x80) << (8 * (last % 8)).astype(np.uint64))
        return Units(ends, np.concatenate([[0], np.cumsum(np.bitwise_count(ends).astype(np.int64))]), first)

    def counts(self) -> np.ndarray:
        return np.diff(self.total[self.first])

    def byte_after(self, k: np.ndarray) -> np.ndarray:
        """Per text, how many bytes its first ``k`` units take."""
        rank = self.total[self.first[:-1]] + k
        word = np.searchsorted(self.total, rank) - 1  # total[word] < rank <= total[word + 1]
        word = np.where(k > 0, word, 0)
        inside = rank - self.total[word]
        bits = self.ends[word]
        for j in range(1, 8):
            bits = np.where(inside > j, bits & (bits - np.uint64(1)), bits)
        byte = np.bitwise_count((bits & (~bits + np.uint64(1))) - np.uint64(1)) >> 3
        return np.where(k > 0, 8 * (word - self.first[:-1]) + byte.astype(np.int64) + 1, 0)


def _chars(piece: bytes) -> int:
    return len(piece.translate(None, _LATER))


def rearrange(texts: list[bytes | None], h1: list[int], h2: list[int], moved: list[str]) -> tuple[list, ...]:
    """``n, form, prefix_chars, middle_chars, output`` of every text; ``moved`` is the form of texts that can be moved."""
    n, form, before, between, output = [], [], [], [], []
    for begin, run in chunks(texts):
        units = Units.of(run)
        count = units.counts()
        at = slice(begin, begin + len(run))
        cuts = np.array([h1[at], h2[at]], np.int64) % (count + 1)
        a, b = (units.byte_after(k).tolist() for k in (cuts.min(0), cuts.max(0)))
        n += count.tolist()
        for t, how, i, j in zip(run, moved[at], a, b, strict=True):
            if not t or any(m in t for m in _MARKS):
                how = "plain"
            p, m, s = t[:i], t[i:j], t[j:]
            plain = how == "plain"
            form.append(how)
            before.append(None if plain else _chars(p))
            between.append(None if plain else _chars(m))
            output.append(t if plain else b"".join((_MARKS[0], p, _MARKS[1], s, _MARKS[2], m) if how == "psm" else (_MARKS[1], s, _MARKS[0], p, _MARKS[2], m)))
    return n, form, before, between, output


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row: whole texts as prefix, middle and suffix.

    Four numbers from the hash of ``seed`` and id draw the two cuts, whether a text is moved (``percent`` of them) and how: suffix first
    (spm, ``spm_percent`` of the moved) or prefix first (psm). Empty and null texts and texts that hold a mark stay plain; null counts as
    empty. A null id is drawn for as the empty string. Rows of one id have the same draws, repeated rows the same result. Cuts may be
    equal or lie at an end: pieces can be empty. An empty table gives an empty result. :func:`restored` undoes it.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]
    moved = F.when(draw[2] % 100 >= percent, "plain").when(draw[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), draw[0].alias("h1"), draw[1].alias("h2"), moved.alias("moved"))
    made = map_batches(rows, rearrange, {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "binary"}, reads=("text", "h1", "h2", "moved"))
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. No piece holds a mark, and none can arise where a piece meets one, so the first of each is the real one."""
    piece = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.element_at(piece, k)
    return F.when(form == "psm", F.concat(part(2), part(4), part(3))).when(form == "spm", F.concat(part(3), part(4), part(2))).otherwise(output)


FIM_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
         sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
drawn as (
  select *, len(units) as n,
         cast('0x' || substr(h, 1, 8) as bigint) % (len(units) + 1) as k1,
         cast('0x' || substr(h, 9, 8) as bigint) % (len(units) + 1) as k2,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 50 then 'plain'
              when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 80 then 'spm' else 'psm' end as form
  from cut),
pieces as (
  select *, coalesce(array_to_string(units[1:least(k1, k2)], ''), '') as p,
         coalesce(array_to_string(units[least(k1, k2) + 1:greatest(k1, k2)], ''), '') as m,
         coalesce(array_to_string(units[greatest(k1, k2) + 1:n], ''), '') as s
  from drawn)
select doc_id, n, form,
       case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from pieces"""
