"""Problem 6: the corpus as token ids of a public byte-level BPE tokenizer.

Pre-tokenisation finds the boundaries of a whole batch at once on code point arrays, without regular
expressions: each code point has a class, each class is a transition function of a small automaton, and the
functions are composed by an associative scan, block by block, over the table of their products. Slices are
then cut further where no vocabulary entry spans a pair of bytes, so that no merge can cross the cut, and
merged through a memo. Byte offsets of the tokens may be kept, and ids decode to the exact text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Slices held by a process's memo; beyond it the memo starts anew, which changes no result.
MEMO_SLICES = 500_000
#: Text of one pass, in bytes; a longer document is a pass of its own.
PASS_BYTES = 4 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points that the tokenizer's pattern counts as white space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Endings that the pattern splits off after an apostrophe.
ONE_LETTER_ENDINGS, TWO_LETTER_ENDINGS = "stmd", ("re", "ve", "ll")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _classes() -> np.ndarray:
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000:
            continue
        head = unicodedata.category(chr(o))[0]
        table[o] = LETTER if head == "L" else NUMBER if head == "N" else OTHER
    table[WHITE_SPACE] = SPACE
    return table


# States of the splitting automaton: nothing open, a run of one class open, a plain space that leads the next run, white space open, one or two more letters of a contraction to come.
IDLE, RUN, JOINED, BLANKS, ONE_MORE, TWO_MORE, N_STATES = 0, (1, 2, 3), 4, 5, 6, 7, 8
# Symbols: a code point of a run (by class), an apostrophe before a contraction's one or two letters, white space before white space or the end, before a run (plain, other).
SHORT_QUOTE, LONG_QUOTE, BLANK, JOINING, LONE, N_SYMBOLS = 3, 4, 5, 6, 7, 8
#: Code points whose functions are composed one after the other; blocks run side by side.
BLOCK = 64


def _step(state: int, symbol: int) -> tuple[bool, int]:
    """Whether a pre-token starts at a symbol read in a state, and the state after it."""
    if state == TWO_MORE:
        return False, ONE_MORE
    if state == ONE_MORE:
        return False, IDLE
    if symbol in (JOINING, LONE):
        return True, JOINED if symbol == JOINING else IDLE
    if symbol == BLANK:
        return state != BLANKS, BLANKS
    run = RUN[symbol] if symbol < SHORT_QUOTE else RUN[OTHER]
    if state in (JOINED, run):
        return False, run
    return True, {SHORT_QUOTE: ONE_MORE, LONG_QUOTE: TWO_MORE}.get(symbol, run)


class Automaton:
    """Transition functions of all symbols, closed under composition, with the table of their products.

    A symbol from N_SYMBOLS on is the first of a text: whatever the state, it is read with nothing open.
    """

    def __init__(self) -> None:
        steps = [[_step(q if a < N_SYMBOLS else IDLE, a % N_SYMBOLS) for q in range(N_STATES)] for a in range(2 * N_SYMBOLS)]
        self.starts = np.array([[s for s, _ in row] for row in steps]).T.copy()  # by state before, symbol
        generators = [tuple(q for _, q in row) for row in steps]
        known = {f: k for k, f in enumerate(dict.fromkeys(generators))}
        found = list(known)
        for f in found:  # grows while new products turn up
            for g in generators:
                if (h := tuple(g[q] for q in f)) not in known:
                    known[h] = len(found)
                    found.append(h)
        self.of_symbol = np.array([known[g] for g in generators], np.uint16)
        self.after = np.array(found, np.uint8)  # by function, state before
        self.product = np.array([[known[tuple(g[q] for q in f)] for g in found] for f in found], np.uint16)

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """The state before each of some functions that run one after the other, from nothing open."""
        n, size = len(functions), len(self.product)
        if n <= BLOCK:
            state, out = IDLE, np.empty(n, np.uint8)
            for k, f in enumerate(functions.tolist()):
                out[k] = state
                state = self.after[f, state]
            return out
        blocks = -(-n // BLOCK)
        grid = np.zeros(blocks * BLOCK, np.uint16)
        grid[:n] = functions
        grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
        product = self.product.ravel()
        for k in range(1, BLOCK):
            grid[k] = product[grid[k - 1].astype(np.uint32) * size + grid[k]]
        entry = self.scan(grid[-1])
        out = np.empty((BLOCK, blocks), np.uint8)
        out[0] = entry
        out[1:] = self.after.ravel()[grid[:-1].astype(np.uint32) * N_STATES + entry]
        return out.T.ravel()[:n]


@functools.cache
def automaton() -> Automaton:
    return Automaton()


def symbols(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Symbols of the code points of many texts; all look-ahead of the splitting is in them."""
    n = len(codes)
    classes = _classes()[codes]
    out = classes.copy()
    follows = np.append(~first[1:], False)  # another code point of the same text
    blank = classes == SPACE
    leads = blank & follows & ~np.append(blank[1:], False)
    out[blank] = BLANK
    out[leads] = np.where(codes[leads] == 0x20, JOINING, LONE)
    quote = np.flatnonzero((codes == 0x27) & follows)
    if len(quote):
        one = codes[quote + 1]
        two = np.where(follows[quote + 1], codes[np.minimum(quote + 2, n - 1)], 0)
        out[quote[np.isin(one, [ord(c) for c in ONE_LETTER_ENDINGS])]] = SHORT_QUOTE
        for a, b in TWO_LETTER_ENDINGS:
            out[quote[(one == ord(a)) & (two == ord(b))]] = LONG_QUOTE
    out[first] += N_SYMBOLS
    return out


def token_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, as a mask over the code points of many texts; first marks each text's first code point."""
    machine, read = automaton(), symbols(codes, first)
    return machine.starts[machine.scan(machine.of_symbol[read]), read]


class Encoder:
    """A byte-level BPE vocabulary with its memo of merged slices."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = np.zeros(max(self.tokens, default=0) + 1, np.int32)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        #: Pairs of adjacent bytes inside any vocabulary entry: merges never cross another pair.
        self.joinable = np.zeros((256, 256), np.bool_)
        for token in self.ranks:
            for a, b in zip(token, token[1:]):
                self.joinable[a, b] = True
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of a slice: again and again the pair of lowest rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        stop = list(range(1, n + 1))  # part k is piece[k:stop[k]]; before[] links back
        before = list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, k, end = heapq.heappop(heap)
            middle = stop[k]
            if not alive[k] or middle >= n or stop[middle] != end:
                continue
            stop[k], alive[middle] = end, False
            if end < n:
                before[end] = k
                if (r := ranks.get(piece[k : stop[end]])) is not None:
                    heapq.heappush(heap, (r, k, stop[end]))
            back = before[k]
            if back >= 0 and (r := ranks.get(piece[back:end])) is not None:
                heapq.heappush(heap, (r, back, end))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : stop[k]]])
            k = stop[k]
        return tuple(out)

    def encode(self, data: bytes, sizes: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """Ids of each slice of the joined UTF-8 texts, and the index of each text's first slice (one more at the end)."""
        text_starts = np.concatenate([[0], np.cumsum(sizes)])
        if not len(data):
            return [], np.zeros(len(text_starts), np.int64)
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        codes = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        first_byte = np.zeros(len(raw) + 1, np.bool_)
        first_byte[text_starts] = True
        starts = token_starts(codes, first_byte[lead])
        cut = np.zeros(len(raw), np.bool_)
        cut[lead] = starts
        cut[1:] |= ~self.joinable[raw[:-1], raw[1:]]
        at = np.flatnonzero(cut)
        begins = at.tolist()
        memo, merge = self.memo, self.merge
        if len(memo) > MEMO_SLICES:
            memo.clear()
        pieces = [data[a:b] for a, b in zip(begins, [*begins[1:], len(data)])]
        for piece in set(pieces).difference(memo):
            memo[piece] = merge(piece)
        return [memo[p] for p in pieces], np.searchsorted(at, text_starts)

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        parts = [(t or "").encode() for t in texts]
        ids, bounds = self.encode(b"".join(parts), np.array([len(p) for p in parts], np.int64))
        return [list(chain.from_iterable(ids[a:b])) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset where each token begins in its text."""
        ends = np.cumsum(self.sizes[ids]) if ids else np.zeros(0, int)
        return [0, *ends.tolist()][:-1] if ids else []

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; the exact inverse of encoding a whole text."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def passes(texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
    """Joined UTF-8 and byte lengths of a column's texts, some megabytes at a time; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PASS_BYTES, "right")) - 1)
        b = min(b, len(texts))
        yield bytes(view[offsets[a] : offsets[b]]), np.diff(offsets[a : b + 1])
        a = b


def _per_batch(vocabulary: str, finish: Callable[[Encoder, list[tuple[int, ...]], np.ndarray], list[pa.Array]], names: list[str], keep: list[str], text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            at = 0
            for data, sizes in passes(batch.column(text)):
                made = finish(bpe, *bpe.encode(data, sizes))
                rows = batch.slice(at, len(sizes))
                at += len(sizes)
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in keep], *made], names=[*keep, *names])

    return run


def _flat(ids: list[tuple[int, ...]], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and where each text's begin (one more at the end)."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), ends[bounds]


def _id_lists(_: Encoder, ids: list[tuple[int, ...]], bounds: np.ndarray) -> list[pa.Array]:
    flat, begins = _flat(ids, bounds)
    return [pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(flat))]


def _ids_and_offsets(bpe: Encoder, ids: list[tuple[int, ...]], bounds: np.ndarray) -> list[pa.Array]:
    flat, begins = _flat(ids, bounds)
    ends = np.concatenate([[0], np.cumsum(bpe.sizes[flat], dtype=np.int64)])
    offsets = ends[:-1] - np.repeat(ends[begins[:-1]], np.diff(begins))
    at = pa.array(begins.astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(offsets.astype(np.int32)))]


def _counts(_: Encoder, ids: list[tuple[int, ...]], bounds: np.ndarray) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
    return [pa.array(np.diff(ends[bounds]).astype(np.int32))]


def _encoded(documents: DataFrame, vocabulary: str | None, key: str, text: str, finish: Callable, columns: dict[str, str]) -> DataFrame:
    rows = documents.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_per_batch(vocabulary or default_vocabulary(), finish, list(columns), [key], text), f"`{key}` {kind}, " + ", ".join(f"{n} {t}" for n, t in columns.items()))


def encode_documents(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>) of every row, one scan and no shuffle; null and empty texts give an empty array.

    ids are those of the vocabulary without special tokens, whose strings are ordinary text. Repeated rows
    stay repeated; other columns are not read. With ``offsets`` there is a column offsets ARRAY<INT> too: the
    byte of the text's UTF-8 where each token begins.
    """
    if offsets:
        return _encoded(documents, vocabulary, key, text, _ids_and_offsets, {"ids": "array<int>", "offsets": "array<int>"})
    return _encoded(documents, vocabulary, key, text, _id_lists, {"ids": "array<int>"})


def count_tokens(documents: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens INT) of every row; null and empty texts have 0."""
    return _encoded(documents, vocabulary, key, text, _counts, {"n_tokens": "int"})


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, text) of every row of ids, and the columns to keep; the inverse of encode_documents but that a null text comes back empty.

    Null ids give a null text; ids outside the vocabulary are refused.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, *keep)], pa.array(texts, pa.string())], names=[key, *keep, "text"])

    rows = encoded.select(key, "ids", *keep)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep)) + ", text string")
