"""Consistent text form and corpus token ids."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import canonical_text, tokenize


@pytest.fixture(scope="module")
def canon():
    return canonical_text.transducer()


PAIRS = [
    ("ＡＢＣ１２", "ABC12"), ("Café", "Café"), ("ｶﾞ", "ガ"), ("ガ", "ガ"), ("a​b­c﻿", "abc"), ("a b　c", "a b c"), ("ﬁne", "fine"), ("⼯行", "工行"),
    ("рау", "pay"), ("KÅ", "KÅ"), ("ộ", "ộ"), ("ộ", "ộ"), ("e‍́", "é"), ("ё", "ë"), ("老", "老"), ("한", "한"), ("", ""),
]
APART = [("a", "A"), ("0", "O"), ("rn", "m"), ("e", "é"), ("x²", "x2"), ("a  b", "a b"), ("①", "1"), ("a.", "a"), ("l", "1"), ("½", "1/2"), ("シ", "ジ"), ("a b", "ab")]


def test_pairs(canon):
    for a, b in PAIRS:
        assert canon([a]) == canon([b]) == [b], (a, b)
    for a, b in APART:
        assert canon([a]) != canon([b]), (a, b)


def plain(canon, text):
    """One code point after the other, without the batch arrays or the trie."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(canon.decomposed.get(c, c) for c in text)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs", "Cn", "Co"]), st.sampled_from("aeợ゙́​カ ")), max_size=12), max_size=6))
def test_batches_match_plain_form(texts):
    canon = canonical_text.transducer()
    once = canon(texts)
    assert once == [plain(canon, t) for t in texts]
    assert canon(once) == once


def test_case_and_ascii_are_kept(canon):
    printable = "".join(map(chr, range(0x20, 0x7F)))
    assert canon([printable]) == [printable]
    assert all(a.isupper() == b.isupper() for a, b in canonical_text.LOOK_ALIKES.items() if a.lower() != a.upper())


def test_trie_is_canonical_composition(canon):
    """Without any mapping, the trie alone composes as the standard form does."""
    rng = random.Random(8)
    marks = [chr(o) for o in range(0x110000) if unicodedata.combining(chr(o))]
    letters = [chr(o) for o in [*range(0x41, 0x250), *range(0x370, 0x5D0), *range(0x904, 0xE00), *range(0x1100, 0x1200), *range(0x1E00, 0x2000), *range(0x3041, 0x3100), *range(0xAC00, 0xAE00)]]
    same = [c for c in letters if unicodedata.normalize("NFD", c) == canon.decomposed.get(c, unicodedata.normalize("NFD", c))]
    for _ in range(30_000):
        text = rng.choice(same) + "".join(rng.choice(marks if rng.random() < 0.5 else marks[:60]) for _ in range(rng.randint(0, 4))) + "".join(rng.choice(same) for _ in range(rng.randint(0, 2)))
        spelled = "".join(unicodedata.normalize("NFD", c) for c in text)
        assert canon._compose(canonical_text._marks_in_order(spelled)) == unicodedata.normalize("NFC", text), ascii(text)


def test_same_look(spark):
    rows = [(1, "ＡＢ", "AB"), (2, "AB", "AB"), (3, "a​b", "ab"), (4, "a", "A"), (5, None, "x"), (6, "x", None), (7, "", "​"), (8, "Ω" * 60_000, "Ω" * 60_000 + "­"), (1, "ＡＢ", "AB"), (9, "a\tb", "a b"), (10, "a\n", "a "), (11, "a\n", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "field_id bigint, raw_text string, suggested_text string, value string")
    assert sorted(r["field_id"] for r in canonical_text.same_look(df, "raw_text", "suggested_text").collect()) == [1, 1, 3, 7, 8, 9, 10]
    assert canonical_text.same_look(df.limit(0), "raw_text", "suggested_text").count() == 0
    shown = {r[0]: r[1] for r in df.select("field_id", canonical_text.canonical_text("raw_text")).collect()}
    assert shown[1] == "AB" and shown[5] is None and shown[7] == ""


@pytest.fixture(scope="module")
def bpe():
    return tokenize.encoder(tokenize.default_vocabulary())


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_match_reference(bpe, reference):
    rng = random.Random(3)
    parts = ["'", "'s", "'re", " ", "  ", "\n", "\t", "a", "ve", "ll", "1", "é", "你好", "。", "　", "\xa0", "!!", "t", "d", "=", "１", "ß", "ガ", "́", "😀", "don't", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    assert bpe.encode_texts(texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=5))
def test_round_trip(texts):
    bpe = tokenize.encoder(tokenize.default_vocabulary())
    for text, ids in zip(texts, bpe.encode_texts(texts)):
        assert bpe.decode(ids) == text
        data, at = text.encode(), bpe.offsets(ids)
        assert [bpe.tokens[i] for i in ids] == [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]


def test_scan_is_the_automaton(monkeypatch):
    import numpy as np

    machine, rng = tokenize.automaton(), np.random.default_rng(4)
    assert len(machine.product) < 1000
    for block in (2, 3, 64):
        monkeypatch.setattr(tokenize, "BLOCK", block)
        for n in (0, 1, 2, 5, 64, 65, 1000, 4097):
            read = rng.integers(0, 2 * tokenize.N_SYMBOLS, n)
            state, expected = tokenize.IDLE, []
            for a in read.tolist():
                expected.append(state)
                state = tokenize._step(tokenize.IDLE if a >= tokenize.N_SYMBOLS else state, a % tokenize.N_SYMBOLS)[1]
            assert machine.scan(machine.of_symbol[read]).tolist() == expected


def test_offsets_and_decoding(spark, bpe):
    rows = [(1, "Hello world's end\n\n你好"), (2, None), (3, ""), (None, "x"), (4, "word " * 9000), (4, "word " * 9000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    encoded = tokenize.encode_documents(df, offsets=True)
    for r in encoded.collect():
        assert r["offsets"] == bpe.offsets(r["ids"])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(map(tuple, tokenize.decode_documents(encoded).collect()), key=key) == sorted(((d, t or "") for d, t in rows), key=key)


def test_long_runs(bpe, reference):
    for t in ("a" * 3000, "=" * 5000, "你" * 2000, " " * 3000, "ab" * 2000 + "\n"):
        assert bpe.encode_texts([t, ""]) == [reference.encode_ordinary(t), []]


def test_documents(spark, bpe):
    rows = [(1, "Hello world's end\n\n你好", "a"), (2, None, "b"), (3, "", None), (None, "x", "c"), (1, "Hello world's end\n\n你好", "a"), (4, "word " * 20_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], list(r["ids"])) for r in tokenize.encode_documents(df).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(got, key=key) == sorted(((d, bpe.encode_texts([t])[0]) for d, t, _ in rows), key=key)
    assert {r["doc_id"]: r["n_tokens"] for r in tokenize.count_tokens(df).where("doc_id is not null").collect()} == {d: len(i) for d, i in got if d is not None}
    assert tokenize.encode_documents(df.limit(0)).count() == 0


def test_passes_split_batches(bpe, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokenize, "PASS_BYTES", 7)
    texts = ["abc", None, "", "defghijklmnop", "你好吗", "x"]
    for column in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        seen = [(data, sizes.tolist()) for data, sizes in tokenize.passes(column)]
        assert b"".join(d for d, _ in seen) == "".join(t or "" for t in texts).encode()
        assert sum((s for _, s in seen), []) == [len((t or "").encode()) for t in texts]
