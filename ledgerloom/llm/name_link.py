"""Problem 2: variant spellings of names typed by people, linked to a register.

Candidates come from a symmetric-delete index: a register entry's anchor (surname, leading word of an
organisation, core of a Chinese name, a Chinese name in Latin letters as a whole) and the words of a typed
name meet where deleting at most two characters of each gives the same text. The index holds distinct
anchors and is asked for distinct words, so no word is looked up twice; the joins are ordinary equi-joins
of hashes and words, salted where a word is frequent, so register and names may be of any size. Each
candidate pair is then decided by an optimal assignment of tokens that permits typos, initials, short forms
and abbreviations.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import salted_lookup
from ledgerloom.session import written

# Given names and their customary short forms.
SHORT_FORMS = {
    "alexander": "alex alec sandy xander", "alexandra": "alex sandra lexi", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate cat",
    "charles": "charlie chuck", "christine": "chris chrissy tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby", "dorothy": "dot dotty",
    "edward": "ed eddie ted ned teddy", "elizabeth": "liz lizzie beth betty eliza lisa libby", "eleanor": "ellie nell nora", "franz": "franzl", "frederick": "fred freddy freddie", "friedrich": "fritz fried friedel", "gabriel": "gabe",
    "gerald": "gerry jerry", "gregory": "greg", "heinrich": "heinz heiner", "henry": "harry hank hal", "isabella": "bella izzy", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn",
    "johannes": "hans johann jo hannes", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "josephine": "jo josie josy", "joshua": "josh", "katherine": "kate kathy katie kat kathie kitty",
    "kenneth": "ken kenny", "lawrence": "larry laurie lars", "leonard": "leo len lenny", "margaret": "maggie meg peggy marge greta madge", "matthew": "matt", "maximilian": "max", "michael": "mike mick mickey micky",
    "nathaniel": "nate nat", "nicholas": "nick nicky nico", "pamela": "pam", "patricia": "pat patty trish tricia patsy", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "raymond": "ray",
    "rebecca": "becky becca", "richard": "rick rich dick ricky richie", "robert": "rob bob bobby robbie bert", "ronald": "ron ronnie", "samantha": "sam", "samuel": "sam sammy", "sebastian": "seb bastian", "stephen": "steve stevie",
    "steven": "steve", "susan": "sue suzie susie suzy", "theodore": "ted theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky vicki tori vic", "vincent": "vince",
    "walter": "walt wally", "wilhelm": "willi willy", "william": "will bill billy willie liam", "zachariah": "zach",
}
# Forms of address, legal forms, and Chinese family names in Latin letters.
TITLES = frozenset("dr prof mr mrs ms miss herr frau mme sir ing dipl".split())
LEGAL = frozenset("limited ltd company co incorporated inc brothers bros ag gmbh sa plc llc corporation corp kg ohg sarl bv nv".split())
LEGAL_BY_LENGTH = sorted((f for f in LEGAL if len(f) > 1), key=lambda f: (-len(f), f))
CHINESE_LEGAL = ("有限责任公司", "股份有限公司", "有限公司", "集团", "公司")
FAMILY_NAMES = frozenset(
    "bai cai cao chang chen cheng chu cui dai deng ding dong du duan fan fang feng fu gao ge gong gu guo han hao he hong hou hu huang jia jiang jin kang kong lai lei li liang liao lin liu long lu luo ma mao meng mo niu pan peng qian qiao qin qiu ren shao shen shi song su sun tan tang tao tian wan wang wei wen wu xia xiang xiao xie xiong xu xue yan yang yao ye yi yin yu yuan zeng zhan zhang zhao zheng zhong zhou zhu zou".split()
)

#: A typed name as long as this may be cut off inside its last word.
CUT_LENGTH = 16
#: An organisation may be called by the initials of so many words or more.
ACRONYM_LENGTH = 3
# The finals of Mandarin syllables in Latin letters, by groups of initials.
_SYLLABLE = (
    "(?:[bpmf](?:ai?|ang?|ao|ei|eng?|e|iang?|ian|iao|ie|ing?|iu|i|ou?|u)"
    "|[dtnl](?:ai?|ang?|ao|ei|eng?|e|iang?|iao|ian|ia|ie|ing?|iu|i|ong|ou|uan|ue|ui|un|uo|u)"
    "|[gkh](?:ai?|ang?|ao|ei|eng?|e|ong|ou|uai|uang?|ua|ui|un|uo|u)"
    "|[jqx](?:iang?|iao|ian|ia|ie|ing?|iong|iu|i|uan|ue|un|u)"
    "|(?:[zcs]h?|r)(?:ai?|ang?|ao|ei|eng?|e|i|ong|ou|uai|uang?|ua|ui|un|uo|u)"
    "|y(?:ang?|ao|a|e|ing?|i|ong|ou|o|uan|ue|un|u)"
    "|w(?:ai?|ang?|ei|eng?|o|u)"
    "|ang?|ai|ao|a|er|eng?|e|ou)"
)
_CJK = re.compile("[㐀-鿿]")


def fold(name: str) -> str:
    """Compatibility form, case-folded, umlauts spelled out, other accents dropped."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", name).casefold())
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("å", "aa"), ("ø", "oe"), ("æ", "ae")):
        text = text.replace(a, b)
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


@lru_cache(200_000)
def tokens(name: str) -> tuple[str, ...]:
    """Words of a folded name; a dot before a word's last letter is a slip."""
    return tuple(re.findall(r"[^\W_]+", re.sub(r"([^\W_]{2,})\.([^\W_])(?![^\W_.])", r"\1\2", fold(name).replace("'", ""))))


@lru_cache(200_000)
def company_words(name: str) -> tuple[str, ...]:
    """Words of an organisation's name; a legal form spelled with dots or spaces is one word."""
    words, out = [x for w in tokens(name) for x in (("co", "ltd") if w == "coltd" else (w,))], []
    while words:  # from the end, where a legal form stands
        form = next((f for f in LEGAL_BY_LENGTH if len(words) > len(f) and tuple(words[-len(f) :]) == tuple(f)), None)
        out.append(form or words[-1])
        del words[-(len(form) if form else 1) :]
    return tuple(reversed(out))


_GIVEN = re.compile(f"{_SYLLABLE}{{1,2}}")


def is_chinese_latin(family: str, given: str) -> bool:
    """A Chinese name in Latin letters: a family name and one or two syllables."""
    return family in FAMILY_NAMES and _GIVEN.fullmatch(given) is not None


@lru_cache(200_000)
def reads_as_chinese(whole: str) -> bool:
    """Whether letters without spaces are a family name and one or two syllables, in either order."""
    return any(is_chinese_latin(whole[:k], whole[k:]) or is_chinese_latin(whole[-k:], whole[:-k]) for k in range(2, min(6, len(whole))))


def turns(words: tuple[str, ...]) -> list[str]:
    """The words written together from each of them on, the ones before it at the end."""
    return ["".join((*words[k:], *words[:k])) for k in range(len(words))]


def acronym(words: tuple[str, ...]) -> str:
    """Initials of the words of an organisation that are no legal form; empty where they are too few."""
    initials = "".join(w[0] for w in words if w not in LEGAL)
    return initials if len(initials) >= ACRONYM_LENGTH else ""


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 where there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def within_two_deletions(word: str) -> set[str]:
    """The word and all texts left by deleting one or two of its characters (one in words of up to five)."""
    n, out = len(word), {word}
    out |= {word[:i] + word[i + 1 :] for i in range(n)}
    if n > 5:
        out |= {word[:i] + word[i + 1 : j] + word[j + 1 :] for i, j in combinations(range(n), 2)}
    return out


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(kind + text) - (1 << 63)


class Chinese:
    """Parts of Chinese names: place, core, trade and legal form, by the register's own places and trades."""

    def __init__(self, places: list[str], trades: list[str]) -> None:
        self.places, self.trades = frozenset(places), frozenset(trades)
        #: Abbreviations that a trade may be written by are parts of it, cut the same way from the end of a name.
        self.short = frozenset("".join(c) for t in trades if len(t) > 2 for k in range(2, len(t)) for c in combinations(t, k)) - self.trades
        self.longest = max(map(len, self.places), default=0)

    def parts(self, name: str) -> tuple[str, str, str, str]:
        """(place, core, trade, legal form); what is missing is empty."""
        text = re.sub(r"\s", "", unicodedata.normalize("NFKC", name))
        place = ""
        if m := re.search(r"\((.+?)\)", text):
            if m[1] in self.places:
                place = m[1]
            text = text[: m.start()] + text[m.end() :]
        legal = next((x for x in CHINESE_LEGAL if text.endswith(x)), "")
        text = text[: len(text) - len(legal)]
        if not place and (lead := next((text[:n] for n in range(min(self.longest, len(text) - 2), 0, -1) if text[:n] in self.places), "")):
            place, text = lead, text[len(lead) :]
        tails = [text[k:] for k in range(2, len(text))]  # the longest first; a core has two letters at least
        trade = next((t for known in (self.trades, self.short) for t in tails if t in known), "")
        return place, text[: len(text) - len(trade)], trade, legal


def _subsequence(short: str, full: str) -> bool:
    rest = iter(full)
    return all(c in rest for c in short)


NEVER = 99.0


@lru_cache(500_000)
def word_cost(typed: str, meant: str, given: bool, cut: bool) -> float:
    """What it costs that a typed word stands for a word of the register; NEVER where it cannot."""
    if typed == meant:
        return 0.0
    forms = SHORT_FORMS.get(meant, "").split() if given else []
    if typed in forms:
        return 0.3
    if len(typed) == 1:
        return 0.6 if typed == meant[0] else 0.7 if any(f[0] == typed for f in forms) else NEVER
    if cut and meant.startswith(typed):
        return 0.4
    if given and typed in SHORT_FORMS:
        return NEVER  # another given name
    if not given and typed[0] == meant[0] and len(typed) < len(meant) and _subsequence(typed, meant):
        return 0.5
    most = (1 if len(meant) < 7 else 2) if given else (1 if len(meant) < 5 else 2 if len(meant) < 8 else 3)
    most = most if len(meant) >= 4 else 0
    if most and (d := distance(typed, meant, most)) <= most:
        return 0.5 + 0.5 * d
    if any(len(f) >= 4 and distance(typed, f, 1) <= 1 for f in forms):
        return 1.3
    if not given and len(typed) >= 4:  # a mistyped abbreviation or cut-off word
        heads = [meant[:k] for k in (len(typed) - 1, len(typed), len(typed) + 1) if k < len(meant)]
        if any(distance(typed, h, 1) <= 1 for h in heads) or any(_subsequence(typed[:i] + typed[i + 1 :], meant) for i in range(1, len(typed))):
            return 1.4
    return NEVER


def anchor_cost(typed: str, anchor: str, cut: bool) -> float:
    """word_cost of a surname or an organisation's leading word, which is never abbreviated."""
    most = 2 if len(anchor) >= 6 else 1
    d = distance(typed, anchor, most)
    if d <= most and len(typed) >= 3 or d == 0:
        return 0.5 + 0.5 * d if d else 0.0
    return 0.4 if cut and len(typed) >= 4 and anchor.startswith(typed) else NEVER


def assign(costs: list[list[float]], skip: list[float]) -> float:
    """Least total of giving each typed word its own word of the register, or for skip[k] none; NEVER at most where impossible.

    Shortest augmenting paths with potentials, cubic in the number of words: every row has a column of
    its own for going without.
    """
    n = len(costs)
    if not n:
        return 0.0
    width = len(costs[0])
    if n == 1:
        return min([skip[0], *costs[0]])
    wide = width + n
    price = [[*row, *[NEVER] * k, skip[k], *[NEVER] * (n - 1 - k)] for k, row in enumerate(costs)]
    by_row, by_column, owner = [0.0] * n, [0.0] * (wide + 1), [-1] * (wide + 1)
    for start in range(n):
        owner[wide], at = start, wide
        dearest, came, done = [float("inf")] * wide, [wide] * wide, [False] * (wide + 1)
        while owner[at] >= 0:
            done[at], row, step, best = True, owner[at], float("inf"), -1
            for j in range(wide):
                if not done[j]:
                    reduced = price[row][j] - by_row[row] - by_column[j]
                    if reduced < dearest[j]:
                        dearest[j], came[j] = reduced, at
                    if dearest[j] < step:
                        step, best = dearest[j], j
            for j in range(wide + 1):
                if done[j]:
                    by_row[owner[j]] += step
                    by_column[j] -= step
                elif j < wide:
                    dearest[j] -= step
            at = best
        while at != wide:
            owner[at], at = owner[came[at]], came[at]
        owner[wide] = -1
    total = sum(price[owner[j]][j] for j in range(wide) if owner[j] >= 0)
    return min(total, NEVER)


def without_titles(words: tuple[str, ...], meant: tuple[str, ...]) -> tuple[str, ...]:
    """Words of a person's typed name that are no titles; the last ones that are names in the entry itself stay."""
    spare, kept = list(meant), []
    for w in reversed(words):
        if w not in TITLES or w in spare:
            kept.append(w)
            if w in spare:
                spare.remove(w)
    return tuple(reversed(kept))


def whole_cost(words: tuple[str, ...], meant: str) -> float:
    """Cost of typed words for a Chinese name in Latin letters, written together: one slip, unless what is typed is a name itself."""
    ways = turns(words)
    if meant in ways:
        return 0.1
    return 1.0 if any(distance(w, meant, 1) <= 1 and not reads_as_chinese(w) for w in ways) else NEVER


def link_cost(typed: str, registered: str, kind: str, chinese: Chinese, core_letters: frozenset[str]) -> float:
    """Cost of a typed name standing for a register entry, NEVER where it does not."""
    if _CJK.search(registered):
        if not _CJK.search(typed):
            return NEVER
        (place, core, trade, legal), (place_r, core_r, trade_r, legal_r) = chinese.parts(typed), chinese.parts(registered)
        if place and place != place_r or trade and trade != trade_r and not _subsequence(trade, trade_r):
            return NEVER
        cost = 0.2 * (place != place_r) + 0.2 * (trade != trade_r) + 0.1 * (legal != legal_r)
        if core == core_r:
            return cost
        # A character typed by its sound: one that no core of the register has, else it is another name.
        off = [a for a, b in zip(core, core_r) if a != b]
        return cost + 1 if len(core) == len(core_r) and len(off) == 1 and off[0] not in core_letters and trade else NEVER
    if _CJK.search(typed):
        return NEVER
    words, meant = tokens(typed), tokens(registered)
    cut = len(typed) >= CUT_LENGTH
    if kind == "person":
        words = without_titles(words, meant)
        if not words:
            return NEVER
        if len(meant) == 2 and is_chinese_latin(*meant):
            return whole_cost(words, meant[0] + meant[1])
        if len(words) < 2 or len(words) > len(meant):
            return NEVER
        best = NEVER
        for at, word in enumerate(words):  # the typed word that is the surname
            last = cut and at == len(words) - 1
            surname = anchor_cost(word, meant[-1], last)
            if surname >= NEVER:
                continue
            rest = [w for k, w in enumerate(words) if k != at]
            for first, w in enumerate(rest):
                cost = word_cost(w, meant[0], True, cut and at != len(words) - 1 and first == len(rest) - 1)
                others = [x for k, x in enumerate(rest) if k != first]
                total = cost + 0.2 * (first > 0) + assign([[word_cost(x, m, True, False) for m in meant[1:-1]] for x in others], [NEVER] * len(others)) + 0.2 * (len(meant) - 2 - len(others))
                if cost < NEVER and not (surname > 1.2 and (cost > 0.5)):
                    best = min(best, surname + total)
        return best
    words, meant = company_words(typed), company_words(registered)
    if not words or not meant:
        return NEVER
    best = 1.4 if words[0] == acronym(meant) and all(w in LEGAL and w in meant for w in words[1:]) else NEVER
    for at, word in enumerate(words):
        last = cut and at == len(words) - 1
        head = anchor_cost(word, meant[0], last)
        if head >= NEVER:
            continue
        rest = [w for k, w in enumerate(words) if k != at]
        costs = [[word_cost(w, m, False, cut and k == len(rest) - 1 and at != len(words) - 1) for m in meant[1:]] for k, w in enumerate(rest)]
        skip = [1.0 if w in LEGAL else NEVER for w in rest]
        if head > 0 and not rest:
            continue
        # The leading word alone fits all entries that share it equally.
        best = min(best, head + assign(costs, skip) + (0.3 * max(0, len(meant) - 1 - len(rest)) if rest else 0.9))
    return best


#: Kinds of index words: a word of a name, a Chinese core, a whole Chinese name in Latin letters, a word cut off, an acronym.
WORD, CORE, WHOLE, CUT, ACRONYM = "wzpca"


def typed_words(name: str, chinese: Chinese, longest: int) -> set[tuple[str, str]]:
    """(kind, word) pairs that a typed name is looked up by; longest bounds the whole Chinese names of the register."""
    if _CJK.search(name):
        return {(CORE, chinese.parts(name)[1])}
    all_words = tokens(name)
    words = tuple(w for w in all_words if w not in TITLES)
    found = {(WORD, w) for w in (*all_words, *company_words(name))}
    found |= {(WHOLE, t) for ws in {words, all_words} if sum(map(len, ws)) <= longest + 1 for t in turns(ws)}
    if len(name) >= CUT_LENGTH and words and len(words[-1]) > 3:
        found.add((CUT, words[-1]))
    if len(company := company_words(name)) and len(company[0]) >= ACRONYM_LENGTH and all(w in LEGAL for w in company[1:]):
        found.add((ACRONYM, company[0]))
    return found


def anchors(name: str, kind: str, chinese: Chinese) -> set[tuple[str, str]]:
    """(kind, word) pairs that a register entry is found by."""
    if _CJK.search(name):
        return {(CORE, chinese.parts(name)[1])}
    words = tokens(name)
    if not words:
        return set()
    if kind == "person":
        if len(words) == 2 and is_chinese_latin(*words):
            return {(WHOLE, words[0] + words[1]), (WHOLE, words[1] + words[0])}
        return {(WORD, words[-1])}
    company = company_words(name)
    return {(WORD, words[0]), (WORD, company[0])} | ({(ACRONYM, a)} if (a := acronym(company)) else set())


def _one_less(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) > 1}


def word_keys(kind: str, word: str) -> set[int]:
    """Keys of the index that a typed word is looked up by."""
    if kind == WORD:
        return {_hash("w", v) for v in within_two_deletions(word)} if len(word) > 2 else {_hash("e", word)}  # shorter ones stand only for themselves
    if kind == WHOLE and reads_as_chinese(word):
        return {_hash(WHOLE, word)}
    return {_hash(kind, v) for v in _one_less(word)} if kind in (CORE, WHOLE) else {_hash(kind, word)}


def anchor_keys(kind: str, word: str) -> set[int]:
    """Keys of the index that an anchor is found by."""
    if kind == WORD:
        own = {_hash("e", word)} if len(word) < 3 else set()
        return own | {_hash("w", v) for v in within_two_deletions(word)} | {_hash(CUT, word[:k]) for k in range(4, len(word))}
    return {_hash(kind, v) for v in _one_less(word)} if kind in (CORE, WHOLE) else {_hash(kind, word)}


def near(kind: str, typed: str, anchor: str) -> bool:
    """Whether a typed word may stand for an anchor; keys that meet by chance or by too many edits are sorted out."""
    if kind == WORD:
        return anchor_cost(typed, anchor, False) < NEVER
    if kind == CUT:
        return anchor.startswith(typed)
    if kind == CORE:
        return len(typed) == len(anchor) and sum(a != b for a, b in zip(typed, anchor)) <= 1
    return distance(typed, anchor, 1) <= 1 if kind == WHOLE else typed == anchor


Batches = Iterator[pa.RecordBatch]


def _beside(batch: pa.RecordBatch, sizes: list[int], made: dict[str, pa.Array]) -> pa.RecordBatch:
    """Columns of batch, row k as often as sizes[k], beside made columns of so many rows."""
    kept = batch.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    return pa.RecordBatch.from_arrays([*made.values(), *kept.columns], names=[*made, *batch.schema.names])


def _texts(rows: list[tuple[str, ...]], names: list[str]) -> dict[str, pa.Array]:
    return {n: pa.array([r[k] for r in rows], pa.string()) for k, n in enumerate(names)}


def _vocabulary(register: DataFrame) -> tuple[Chinese, frozenset[str], int]:
    """Places and trades of the register, the letters of its cores, and the longest whole Chinese name in Latin letters; whole vocabularies."""

    def pieces(batches: Batches) -> Batches:
        for b in batches:
            out: list[tuple[str, str]] = []
            for name, kind in zip(b.column("registered_name").to_pylist(), b.column("kind").to_pylist()):
                if _CJK.search(name):
                    text = re.sub(r"\s", "", name.translate(str.maketrans("（）", "()")))
                    place = re.search(r"\((.+?)\)", text)
                    bare = re.sub(f"({'|'.join(CHINESE_LEGAL)})$", "", re.sub(r"\(.+?\)", "", text))
                    out += [("place", place[1])] if place else []
                    out += [("tail", bare[-k:]) for k in (2, 3, 4, 5, 6) if len(bare) > k]
                elif kind == "person" and len(w := tokens(name)) == 2 and is_chinese_latin(*w):
                    out.append(("length", str(len(w[0] + w[1]))))
            yield pa.RecordBatch.from_pydict(_texts(out, ["what", "text"]))

    counts = register.mapInArrow(pieces, "what string, text string").groupBy("what", "text").count()
    found: dict[str, dict[str, int]] = {"place": {}, "tail": {}, "length": {}}
    for what, text, n in counts.where("what = 'length' or what = 'place' and count >= 2 or what = 'tail' and count >= 5").collect():
        found[what][text] = n
    tails = found["tail"]
    longer: dict[str, int] = {}
    for t, n in tails.items():
        longer[t[1:]] = max(longer.get(t[1:], 0), n)
    # A trade ends cores of many letters: no longer ending holds a quarter of its names, and it holds a quarter of the next shorter one's.
    trades = [t for t, n in tails.items() if longer.get(t, 0) * 4 < n and n * 4 >= tails.get(t[1:], 0)]
    model = Chinese(list(found["place"]), trades)

    def letters(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"c": pa.array(sorted({c for n in b.column("registered_name").to_pylist() for c in model.parts(n)[1]}), pa.string())})

    chinese = register.where(F.col("registered_name").rlike("[㐀-鿿]"))
    return model, frozenset(r[0] for r in chinese.mapInArrow(letters, "c string").distinct().collect()), max(map(int, found["length"]), default=0)


def link_names(names: DataFrame, register: DataFrame) -> DataFrame:
    """(name, n, counterparty_id, exact) of distinct typed names that mean exactly one register entry.

    names has a column name, distinct, and n, how often it occurs; register has counterparty_id,
    registered_name and kind. Null and blank names mean nobody, and so does a name whose best two entries
    fit equally well. A name equal to a registered one means that entry. Register rows without id or name
    are nobody. Runs jobs while the plan is built: names are split once, and what is small is known to be.
    """
    register = register.where("counterparty_id is not null and registered_name is not null").select("counterparty_id", "registered_name", "kind")
    chinese, letters, longest = _vocabulary(register)
    id_type = register.schema["counterparty_id"].dataType.simpleString()

    def split(batches: Batches) -> Batches:
        for b in batches:
            found = [[*typed_words(n, chinese, longest)] for n in b.column("name").to_pylist()]
            flat = _texts(list(chain.from_iterable(found)), ["kind", "word"])
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            words = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(flat.values()), list(flat)))
            yield pa.RecordBatch.from_arrays([*b.columns, words], names=[*b.schema.names, "words"])

    def entries(batches: Batches) -> Batches:
        for b in batches:
            found = [[*anchors(n, k, chinese)] for n, k in zip(b.column("registered_name").to_pylist(), b.column("entry_kind").to_pylist())]
            yield _beside(b, [len(f) for f in found], _texts(list(chain.from_iterable(found)), ["anchor_kind", "anchor"]))

    def keyed(keys: Callable[[str, str], set[int]]) -> Callable[[Batches], Batches]:
        def run(batches: Batches) -> Batches:
            for b in batches:
                found = [keys(k, w) for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                sizes = [len(f) for f in found]
                yield _beside(b, sizes, {"key": pa.array(np.fromiter(chain.from_iterable(found), np.int64, sum(sizes)))})

        return run

    def sort_out(batches: Batches) -> Batches:
        for b in batches:
            yield b.filter(pa.array([near(k, w, a) for k, w, a in zip(*(b.column(c).to_pylist() for c in ("kind", "word", "anchor")))], pa.bool_()))

    def decide(batches: Batches) -> Batches:
        for b in batches:
            names, ids, meant, kinds = (b.column(c).to_pylist() for c in ("name", "counterparty_id", "registered_name", "entry_kind"))
            pairs: dict[tuple, float] = {}  # a pair may meet by several words
            cost = [pairs[n, i] if (n, i) in pairs else pairs.setdefault((n, i), link_cost(n, r, k, chinese, letters)) for n, i, r, k in zip(names, ids, meant, kinds)]
            fits = pa.array(cost, pa.float64())
            made = pa.RecordBatch.from_arrays([b.column("name"), b.column("n"), b.column("counterparty_id"), fits], names=["name", "n", "counterparty_id", "cost"])
            yield made.filter(pa.array([c < NEVER for c in cost], pa.bool_()))

    # Names are few bytes and much work: as many tasks as a shuffle has, however small they are.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = names.where("trim(name) <> ''").select("name", "n").repartition(tasks, F.xxhash64("name"))
    names = written(names.mapInArrow(split, "name string, n bigint, words array<struct<kind:string,word:string>>"))
    words = names.select("name", "n", F.inline("words"))
    index = written(register.withColumnRenamed("kind", "entry_kind").mapInArrow(entries, f"anchor_kind string, anchor string, counterparty_id {id_type}, registered_name string, entry_kind string"))
    asked = words.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("asked"))
    asked_keys = asked.mapInArrow(keyed(word_keys), "key bigint, kind string, word string, asked bigint")
    index_keys = index.select("anchor_kind", "anchor").distinct().mapInArrow(keyed(anchor_keys), "key bigint, anchor_kind string, anchor string")
    met = asked_keys.join(index_keys, "key").select("kind", "word", "asked", "anchor_kind", "anchor").distinct()
    met = written(met.mapInArrow(sort_out, "kind string, word string, asked bigint, anchor_kind string, anchor string"))
    wanted = salted_lookup(words, met, ["kind", "word"], "name", "asked").select("name", "n", "anchor_kind", "anchor")
    # How many names ask for an anchor, at most, decides whether its entries are repeated.
    asking = met.groupBy("anchor_kind", "anchor").agg(F.sum("asked").alias("asked"))
    full = salted_lookup(wanted, index.join(asking, ["anchor_kind", "anchor"]), ["anchor_kind", "anchor"], "name", "asked")
    costs = full.select("name", "n", "counterparty_id", "registered_name", "entry_kind").mapInArrow(decide, f"name string, n bigint, counterparty_id {id_type}, cost double")
    # A name written exactly like an entry means it, whatever its words are.
    same = names.join(register, names["name"] == register["registered_name"]).select("name", "n", "counterparty_id", F.lit(-1.0).alias("cost"))
    cost = F.round("cost", 6)
    # The smallest and the largest entry of least cost: they differ where several fit equally well.
    ends = costs.unionByName(same).groupBy("name", "n").agg(F.min(F.struct(cost.alias("cost"), "counterparty_id")).alias("a"), F.max(F.struct((-cost).alias("cost"), "counterparty_id")).alias("b"))
    best = ends.where("a.counterparty_id = b.counterparty_id")
    return best.select("name", "n", F.col("a.counterparty_id").alias("counterparty_id"), (F.col("a.cost") < 0).alias("exact"))


def link_records(records: DataFrame, register: DataFrame, key: str = "record_id", name: str = "counterparty_name", exact_too: bool = False) -> DataFrame:
    """(key, counterparty_id) of every record whose typed name means a register entry but, unless ``exact_too``, is not written exactly like it.

    Names are decided once each; a name that a large share of all records bears is spread over partitions
    on the way back. Null, blank and unknown names give no row, repeated records a row each; columns other
    than key and name are not read. An empty table or register gives no rows.
    """
    names = records.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    linked = link_names(names, register.dropDuplicates(["counterparty_id"]))
    if not exact_too:
        linked = linked.where("not exact")
    linked = written(linked.drop("exact"))  # names are decided once
    rows = records.select(F.col(key), F.col(name).alias("name"))
    return salted_lookup(rows, linked, ["name"], key).select(key, "counterparty_id")
