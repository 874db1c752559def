"""Problem 1: one consistent form for text that looks the same.

A transducer over grapheme clusters is compiled once per process: single code points go through a
flat table, clusters of several code points through a trie of canonical compositions, longest match
first. Both are precomputed from the Unicode character database plus a list of look-alikes and are
checked for conflicts before use. Batches run as code point arrays, so only clusters with combining
marks, each memoised, are touched one by one.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that are drawn like another one, mostly a Latin letter of the same case, beside that letter.
LOOK_ALIKES = {
    drawn: plain
    for letters, meant in (
        ("АВСЕНІЈКМОРЅТХУҮԚԜѴӀӘӨӔӠ", "ABCEHIJKMOPSTXYYQWVIƏƟÆƷ"),  # Cyrillic
        ("асԁеһіјӏорԛѕѵԝхуүәөӕӡ", "acdehijlopqsvwxyyəɵæʒ"),
        ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek
        ("αορυνϲϳκ", "aopuvcjĸ"),
        ("ՕՍԼՏ", "OULS"),  # Armenian
        ("օսհոյ", "ouhnj"),
        ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎽ", "ABCDEGHJKLMPRSTVWZY"),  # Cherokee
        ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
        ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬ", "ABEHIKMNOPCTX"),  # Coptic
        ("ⲟⲣⲥ", "opc"),
        ("ɑɡ", "ag"),  # Latin letters of phonetic script
    )
    for drawn, plain in zip(letters, meant, strict=True)
}

#: Compatibility mappings that leave the look of a letter or sign as it is; superscripts, fractions, circled and squared forms look different.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Code points without ink besides general category Cf: variation selectors, fillers, grapheme joiner.
NO_INK = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
SPACES = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}

MARK, JAMO = 1, 2


def _spelled_hangul(o: int) -> str:
    """The joining letters of a Korean syllable."""
    rest, last = divmod(o - 0xAC00, 28)
    return chr(0x1100 + rest // 21) + chr(0x1161 + rest % 21) + (chr(0x11A7 + last) if last else "")


def _marks_in_order(text: str) -> list[str]:
    """The code points, each run of marks by their combining classes."""
    out: list[str] = []
    run: list[str] = []
    for c in text:
        if unicodedata.combining(c):
            run.append(c)
        else:
            out += sorted(run, key=unicodedata.combining)
            out.append(c)
            run = []
    return out + sorted(run, key=unicodedata.combining)


class Transducer:
    """Compiled mapping of grapheme clusters to their consistent form."""

    def __init__(self) -> None:
        n = sys.maxunicode + 1
        #: kind 1: joins the cluster before it; length and offset of a code point's output in the pool.
        self.joins = np.zeros(n, np.bool_)
        self.length = np.ones(n, np.int8)
        self.offset = np.arange(n, dtype=np.int64)
        #: Identity outputs come first; longer and changed outputs are appended.
        pool: list[int] = []
        self.decomposed: dict[str, str] = {}
        self.trie: dict = {}
        for o in range(n):
            if 0xAC00 <= o < 0xD7A4 or 0xD800 <= o < 0xE000 or 0xE000 <= o < 0xF900 or 0x20000 <= o < 0x2F800 or 0x4E00 <= o < 0xA000 or o > 0xE01FF:
                continue  # whole letters without a mapping
            c = chr(o)
            category = unicodedata.category(c)
            if category == "Cn":
                continue
            if category in ("Mn", "Mc", "Me") or 0x1160 <= o < 0x1200 or o in (0xFF9E, 0xFF9F):
                self.joins[o] = True
            parts = self._parts(c)
            whole = unicodedata.normalize("NFC", parts)
            self.decomposed[c] = parts
            if len(parts) > 1 and len(whole) == 1:
                self._insert(parts, whole)
            if whole != c:
                self.length[o], self.offset[o] = len(whole), n + len(pool)
                pool += map(ord, whole)
        self.pool = np.concatenate([np.arange(n, dtype=np.uint32), np.array(pool, np.uint32)])
        for o in range(0xAC00, 0xD7A4):
            self._insert(_spelled_hangul(o), chr(o))
        self.memo: dict[str, str] = {}
        self._check()

    def _parts(self, c: str) -> str:
        """A code point as base characters and marks of the consistent form."""
        o = ord(c)
        if o in SPACES or unicodedata.category(c) == "Zs":
            return " "
        if (unicodedata.category(c) in ("Cf", "Cc") and o > 0x7F) or o in NO_INK or o < 0x20 or o == 0x7F:
            return ""
        if c in LOOK_ALIKES:
            return self._parts(LOOK_ALIKES[c])
        if 0x3131 <= o < 0x318F:
            return c  # a Korean letter that stands alone, unlike the ones that join
        mapping = unicodedata.decomposition(c)
        if not mapping:
            return c
        head, *rest = mapping.split()
        if head[0] == "<":
            if head not in SAME_LOOK:
                return c
            codes = rest
            if codes[0] == "0020" and len(codes) > 1:
                return c  # a spacing accent is a sign of its own
        else:
            codes = [head, *rest]
        return "".join(self._parts(chr(int(x, 16))) for x in codes)

    def _insert(self, parts: str, whole: str) -> None:
        node = self.trie
        for c in parts:
            node = node.setdefault(c, {})
        node[""] = whole

    def _check(self) -> None:
        """Refuse a mapping with conflicts: ASCII maps to itself, outputs map to themselves, and letter case is kept."""
        for o in range(0x20, 0x7F):
            if self.length[o] != 1 or self.offset[o] != o:
                raise ValueError(f"printable ASCII {chr(o)!r} is mapped")
        for c, d in self.decomposed.items():
            out = unicodedata.normalize("NFC", d)
            if out != c and any(self.decomposed.get(x, x) not in (x, unicodedata.normalize("NFD", x)) for x in out):
                raise ValueError(f"{c!r} maps to {out!r}, which is mapped again")
        for a, b in LOOK_ALIKES.items():
            if (a.isupper(), a.islower()) != (b.isupper(), b.islower()) and a.lower() != a.upper():
                raise ValueError(f"{a!r} and {b!r} differ in case")

    def cluster(self, text: str) -> str:
        """Output of a cluster of several code points: spell it out, order the marks, then compose by longest match."""
        found = self.memo.get(text)
        if found is None:
            spelled = "".join(_spelled_hangul(ord(c)) if "\uac00" <= c <= "\ud7a3" else self.decomposed.get(c, c) for c in text)
            found = self._compose(_marks_in_order(spelled))
            if len(self.memo) < 1_000_000:  # a memo only: beyond that, clusters are composed anew
                self.memo[text] = found
        return found

    def _compose(self, parts: list[str]) -> str:
        """The longest compositions of the trie. A mark that does not join stays behind and bars later ones of its class or lower."""
        out: list[str] = []
        at = 0
        while at < len(parts):
            node, best, left = self.trie.get(parts[at], {}), parts[at], []
            at += 1
            while at < len(parts):
                c = parts[at]
                weight = unicodedata.combining(c)
                if not weight and (left or c not in node or "" not in node[c]):
                    break
                if (not left or unicodedata.combining(left[-1]) < weight) and "" in node.get(c, {}):
                    node = node[c]
                    best = node[""]
                else:
                    left.append(c)
                at += 1
            out += [best, *left]
        return "".join(out)

    def __call__(self, texts: list[str]) -> list[str]:
        """The consistent form of each text; one pass over the batch's code points."""
        if not texts:
            return []
        joined = "".join(texts)
        if joined.isascii() and joined.isprintable():
            return list(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        length, offset, pool = self.length[codes].astype(np.int64), self.offset[codes], self.pool

        extra: list[int] = []
        joins = self.joins[codes]
        if joins.any():
            # A cluster: a code point with ink, then marks, with code points without ink in between.
            empty = length == 0
            first = np.zeros(len(codes) + 1, np.bool_)
            first[ends - sizes] = True
            head = ~(joins | empty)
            head[np.flatnonzero(first[:-1])] = True
            starts = np.flatnonzero(head)
            stops = np.append(starts[1:], len(codes))
            marked = np.add.reduceat(joins, starts) > 0
            for a, b in zip(starts[marked].tolist(), stops[marked].tolist()):
                whole = self.cluster(joined[a:b])
                length[a:b] = 0
                length[a], offset[a] = len(whole), len(pool) + len(extra)
                extra += map(ord, whole)

        out_ends = np.cumsum(length)
        total = int(out_ends[-1]) if len(out_ends) else 0
        at = np.arange(total) - np.repeat(out_ends - length - offset, length)
        codes = pool[np.minimum(at, len(pool) - 1)]
        if extra:
            of_cluster = at >= len(pool)
            codes[of_cluster] = np.array(extra, np.uint32)[at[of_cluster] - len(pool)]
        made = codes.tobytes().decode("utf-32-le", "surrogatepass")
        stops = np.append(0, out_ends)[ends].tolist()
        begins = [0, *stops[:-1]]
        return [made[a:b] for a, b in zip(begins, stops)]


@functools.cache
def transducer() -> Transducer:
    return Transducer()


def canonical_series(texts: pd.Series) -> pd.Series:
    """The consistent form of each text; null stays null, empty stays empty."""
    there = texts.notna()
    out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
    out[there] = transducer()(texts[there].tolist())
    return out


def canonical_text(text: Column | str) -> Column:
    """Column form of canonical_series; for whole texts of any length."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield canonical_series(batch)

    return run(text)


def same_look(values: DataFrame, left: str, right: str) -> DataFrame:
    """Rows where two texts differ as code points but look the same; all columns are kept.

    Null on either side is no case. Two texts of printable ASCII that differ always differ visibly, so
    they never reach Python; this is exact, not a sample.
    """
    plain = r"\A[ -~]*\z"
    may = values.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)) & ~(F.col(left).rlike(plain) & F.col(right).rlike(plain)))

    @F.pandas_udf("boolean")
    def equal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = transducer()
        for a, b in batches:
            made = run([*a.tolist(), *b.tolist()])
            yield pd.Series([x == y for x, y in zip(made[: len(a)], made[len(a) :])], dtype=bool)

    return may.where(equal(left, right))
