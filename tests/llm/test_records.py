"""Name linking, dress-blind dedup, packing and reading levels."""

import random
import re
import unicodedata

import numpy as np
import pytest

from ledgerloom.llm import dress_dedup, name_link, packing, reading_level
from ledgerloom.operators import skew

REGISTER = [
    (1, "Danlatkep Tool Manufacturing GmbH", "organisation"), (2, "Danlatkep International Dental Supplies S.A.", "organisation"), (3, "Timothy Samuel Ashpaquist", "person"), (4, "Johannes Kernjakamp", "person"),
    (5, "Susan Kernjakamp", "person"), (6, "Xu Dongdong", "person"), (7, "Deborah Whitvoström", "person"), (8, "安浦翎岚铭机械股份有限公司", "organisation"), (9, "禾茂旻医疗器械(东岭)有限责任公司", "organisation"),
    *[(100 + k, f"{a}{b}{c}机械({p})有限公司", "organisation") for k, (a, b, c, p) in enumerate([("垣", "祺", "川", "安浦"), ("朗", "淳", "煦", "东岭"), ("樾", "祺", "琛", "安浦"), ("铭", "朗", "朗", "东岭"), ("桐", "禾", "湛", "安浦"), ("岳", "瑾", "曦", "东岭")])],
    *[(200 + k, f"{a}{b}{c}医疗器械有限公司", "organisation") for k, (a, b, c) in enumerate([("垣", "川", "川"), ("朗", "煦", "煦"), ("樾", "琛", "琛"), ("铭", "岳", "朗"), ("桐", "湛", "湛"), ("瑾", "曦", "瑾")])],
]
MEANT = {
    "danlatkep tool mfg": 1, "Tool Manufacturing GmbH (Danlatkep)": 1, "DANLATKPE T. M. GMBH": 1, "Danlatkep Tool Manufacturing G.m.b.H.": 1, "Dental Supplies, Danlatkep SA": 2, "Danlatkep Intl Dental": 2, "Danlatkep Tool Man": 1,
    "Tim Ashpaquist": 3, "Ashpaquist, T. Samuel": 3, "Dr. Timothy S. Ashpaquits": 3, "Hans Kernjakamp": 4, "Sue Kernjakamp": 5, "S Kernjakamp": 5, "Dong Dong Xu": 6, "Xudongdong": 6, "Xu Dong-dong": 6, "Deborah Whitvostrom": 7, "WHITVOSTROEM, DEB": 7,
    "翎岚铭机械 （安浦） 股份公司": None, "翎岚铭 （安浦）机械 公司": 8, "翎兰铭机械股份有限公司": 8, "禾茂旻医械有限责任公司": 9, "东岭禾茂旻医疗器械": 9,
    "Danlatkep": None, "Danlatkep Bakery Products GmbH": None, "Zelda Ashpaquist": None, "Kernjakamp": None, "Xavier Kernjakamp": None, "Xu Dongling": None, "宁州翎岚铭食品有限公司": None, "翎川铭机械股份有限公司": None, "": None, "  ": None, None: None, "-": None,
    "Danlatkep Tool Manufacturing GmbH": None,
}


@pytest.fixture(scope="module")
def register(spark):
    return spark.createDataFrame(REGISTER, "counterparty_id bigint, registered_name string, kind string")


def test_links(spark, register):
    names = [n for n in MEANT if n != "翎岚铭机械 （安浦） 股份公司"]
    rows = [(k, n, "x", 1) for k, n in enumerate(names)] + [(1000, "Tim Ashpaquist", "x", 1)]
    records = spark.createDataFrame(rows, "record_id bigint, counterparty_name string, name string, n int")
    got = {r["record_id"]: r["counterparty_id"] for r in name_link.link_records(records, register).collect()}
    assert got.pop(1000) == 3
    assert {n: got.get(k) for k, n in enumerate(names)} == {n: MEANT[n] for n in names}
    assert name_link.link_records(records.limit(0), register).count() == 0
    assert name_link.link_records(records, register.limit(0)).count() == 0


def test_short_and_class_words_are_looked_up(spark):
    entries = [(1, "Anna Lee", "person"), (2, "BMW Bakery Products GmbH", "organisation"), (3, "J. Smith Ltd", "organisation"), (4, "Maria Herr", "person"), (5, "Limited Brands Trading AG", "organisation"), (6, "Wu", "organisation")]
    names = {"Lee, Anna": 1, "bmw bakery products": 2, "Smith J Ltd": 3, "Herr Maria": 4, "Limited Brands Trading": 5, "Wu": 6, "Frau Maria Herr": 4, "Tom Lee": None}
    records = spark.createDataFrame(list(enumerate(names)), "record_id bigint, counterparty_name string")
    register = spark.createDataFrame(entries, "counterparty_id bigint, registered_name string, kind string")
    got = {r["record_id"]: r["counterparty_id"] for r in name_link.link_records(records, register, exact_too=True).collect()}
    assert {n: got.get(k) for k, n in enumerate(names)} == names


def test_shared_word_may_be_a_misspelt_anchor(spark):
    entries = [(1, "Deborah Martins", "person"), *[(10 + k, f"Martin Q{a}", "person") for k, a in enumerate(("uibblex", "orfandel", "ezzomir", "wyrstan", "ubbelin", "ylgaard"))]]
    records = spark.createDataFrame([(1, "Deborah Martin"), (2, "Debbie Martin")], "record_id bigint, counterparty_name string")
    register = spark.createDataFrame(entries, "counterparty_id bigint, registered_name string, kind string")
    assert sorted(map(tuple, name_link.link_records(records, register).collect())) == [(1, 1), (2, 1)]


def test_vocabularies_are_whole(spark):
    n = 10_005
    place = lambda k: "".join(chr(0x4E00 + 200 * j + k // 22**j % 22) for j in range(3))
    rows = [(k, f"翎岚铭机械({place(k % n)})有限公司", "organisation") for k in range(2 * n)]
    register = spark.createDataFrame(rows, "counterparty_id bigint, registered_name string, kind string")
    assert len({place(k) for k in range(n)}) == n and len(name_link._vocabulary(register)[0].places) == n


def test_index_finds_all_near_words():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(6, 9)))
    words = [word() for _ in range(60)]
    near = lambda a, b: bool(name_link.within_two_deletions(a) & name_link.within_two_deletions(b))
    for a in words:
        for b in words:
            if name_link.distance(a, b, 2) <= 2:
                assert near(a, b), (a, b)


def test_assignment_is_optimal():
    from itertools import permutations

    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        costs = [[rng.choice([0.0, 0.5, 1.0, 2.5, name_link.NEVER]) for _ in range(m)] for _ in range(n)]
        best = min((sum(costs[i][j] for i, j in enumerate(p)) for p in permutations(range(m), n)), default=0)
        got = name_link.assign(costs, [name_link.NEVER] * n)
        assert got == (best if best < name_link.NEVER else name_link.NEVER)


def test_assignment_with_rows_left_out_and_many_words():
    from itertools import product

    rng = random.Random(2)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(0, 4)
        costs = [[rng.choice([0.0, 0.5, 1.25, 2.5, name_link.NEVER]) for _ in range(m)] for _ in range(n)]
        skip = [rng.choice([0.25, 1.0, name_link.NEVER]) for _ in range(n)]
        ways = [w for w in product(range(m + 1), repeat=n) if len({j for j in w if j < m}) == sum(j < m for j in w)]
        best = min(sum(skip[i] if j == m else costs[i][j] for i, j in enumerate(w)) for w in ways)
        assert name_link.assign(costs, skip) == min(best, name_link.NEVER)
    assert name_link.assign([[1.0 + abs(i - j) for j in range(60)] for i in range(60)], [name_link.NEVER] * 60) == 60


NEAR_REGISTER = [
    (1, "Zhang Wei", "person"), (2, "Zhang Xiaoming", "person"), (3, "Robert Lee", "person"), (4, "Robert Fox", "person"), (5, "BMW Motors Holding AG", "organisation"), (6, "SAP Software Group AG", "organisation"),
    (7, "Northwind Marine Engine Repair Services Ltd", "organisation"), (8, "Quarrystone Timber Yards Ltd", "organisation"), (9, "Quillfeather Table Yards Ltd", "organisation"),
]
NEAR_NAMES = {
    "Zhang Wie": 1, "Wei Zhang": 1, "Zhnag Wei": 1, "Zhang Wen": None, "zhangxiaomnig": 2, "Xiaoming, Zhang": 2, "Zhang Xiaomin": None, "Bob Lee": 3, "Lee, Robert": 3, "R. Lee": 3, "Robert Fxo": 4,
    "BMW Motors": 5, "SAP Software AG": 6, "NMERS": 7, "nmers ltd": 7, "NME": None, "QTY": None, "Repair Services, Northwind Marine Engine": 7, "Dr. Prof. Mr. Robert Lee": 3,
}


def test_near_names(spark, monkeypatch):
    records = spark.createDataFrame(list(enumerate(NEAR_NAMES)), "record_id bigint, counterparty_name string")
    register = spark.createDataFrame(NEAR_REGISTER, "counterparty_id bigint, registered_name string, kind string")
    for hot in (skew.HOT_ROWS, 2):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        got = {r["record_id"]: r["counterparty_id"] for r in name_link.link_records(records, register).collect()}
        assert {n: got.get(k) for k, n in enumerate(NEAR_NAMES)} == NEAR_NAMES


FIELD = "struct<raw_text:string,suggested_text:string>"


def dressed(spark, rows):
    made = [(i, None if f is None else {k: (v, "s") for k, v in f.items()}, "h", 1) for i, f in rows]
    return spark.createDataFrame(made, f"candidate_id bigint, fields map<string,{FIELD}>, h string, n int")


CASES = [
    (10, {"description": "Refund - Foundry", "transaction_amount": "1,234.50"}), (4, {"transaction_amount": "+1234.5", "description": "REFUND foundry!"}), (7, {"description": "Refund Foundry", "transaction_amount": "1234.51"}),
    (8, {"description": "Refund Foundry"}), (12, {"description": None}), (11, {"description": None}), (13, {"description": ""}), (14, None), (15, {}), (16, {"description": "Straße"}), (17, {"description": "STRASSE"}),
    (30, {"description": "x² ½ ①"}), (31, {"description": "x2 1/2 1"}), (32, {"description": "Ａ１"}), (33, {"description": "A1"}), (34, {"description": "Cafe\u0301"}), (35, {"description": "CAF\u00c9"}),
    (18, {"balance": "1O.0"}), (19, {"balance": "1o.0"}), (20, {"balance": "10"}), (20, {"balance": "10.00"}), (21, {"a": "x1", "b": "y"}), (22, {"a": "x", "b": "1y"}),
]


def test_copies(spark, monkeypatch):
    expected = {(4, 10), (11, 12), (14, 15), (16, 17), (18, 19), (34, 35)}
    got = {tuple(r) for r in dress_dedup.copy_pairs(dressed(spark, CASES)).collect()}
    assert got == expected
    counts = {r["candidate_id"]: r["copies"] for r in dress_dedup.collapse(dressed(spark, CASES)).collect()}
    assert sum(counts.values()) == len(CASES) and counts[4] == 2 and counts[20] == 2 and counts[7] == 1
    monkeypatch.setattr(skew, "HOT_ROWS", 2)
    assert {tuple(r) for r in dress_dedup.copy_pairs(dressed(spark, CASES)).collect()} == expected
    assert dress_dedup.copy_pairs(dressed(spark, CASES).limit(0)).count() == 0


def test_copies_random(spark):
    rng = random.Random(7)
    rows = [(k, {"description": "".join(rng.choice("aA b.-é") for _ in range(rng.randint(0, 4))), "balance": rng.choice(["1", "1.0", "1,00", "(1)", "x", "X.", "2"])}) for k in range(300)]

    def key(f):
        text = lambda s: "".join(c for c in unicodedata.normalize("NFC", s).casefold() if not unicodedata.category(c).startswith(("P", "Z")))
        money = {"1": 1, "1.0": 1, "1,00": 1, "(1)": -1, "2": 2}.get(f["balance"], "?" + text(f["balance"]))
        return text(f["description"]), money

    first, expected = {}, set()
    for k, f in rows:
        first.setdefault(key(f), k)
        if first[key(f)] != k:
            expected.add((first[key(f)], k))
    assert {tuple(r) for r in dress_dedup.copy_pairs(dressed(spark, rows)).collect()} == expected


def squares(gaps, capacity):
    n = {}
    for g in gaps:
        if 0 < g < capacity:
            n[g] = n.get(g, 0) + 1
    return sum(v * v for v in n.values())


def test_packing_takes_the_least_sum_of_squares():
    rng = random.Random(3)
    for _ in range(40):
        capacity, sizes = rng.randint(4, 12), []
        gaps: list[int] = []
        for _ in range(40):
            s = rng.randint(1, capacity)
            sizes.append(s)
            box = packing.pack(sizes, capacity)[-1]
            options = [squares([g - s if k == j else g for k, g in enumerate(gaps)], capacity) for j, g in enumerate(gaps) if g >= s]
            options.append(squares([*gaps, capacity - s], capacity))
            if box == len(gaps):
                gaps.append(capacity)
            gaps[box] -= s
            assert gaps[box] >= 0 and squares(gaps, capacity) == min(options)


def test_packed_documents(spark):
    rng = random.Random(4)
    texts = [None, "", " ".join("word" for _ in range(500)), *[" ".join("word" for _ in range(rng.randint(1, 60))) for _ in range(300)]]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)] + [(None, "a b", "x", 1)], "doc_id bigint, text string, container string, shard int")
    capacity = 64
    rows = packing.pack_documents(df, capacity, shard_documents=120).collect()
    used, by_doc = {}, {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["n_tokens"]))
    assert max(used.values()) <= capacity
    assert set(by_doc) == {*range(len(texts)), None} and len({r["container"].split("-")[0] for r in rows}) == 3
    for doc, pieces in by_doc.items():
        pieces.sort()
        assert [p for p, _ in pieces] == list(range(len(pieces))) and all(n == capacity for _, n in pieces[:-1])
        assert len(pieces) == 1 or sum(n for _, n in pieces) > capacity
    assert sum(n for p in by_doc.values() for _, n in p) / (len(used) * capacity) > 0.93
    assert packing.pack_documents(df.limit(0), capacity).count() == 0
    fill = packing.container_fill(packing.pack_documents(df, capacity), capacity).first()
    assert fill["fullest"] <= capacity and fill["filled"] > 0.93


EASY = ["The {0} is big.", "I see a {0}.", "We like the {0}. It is fun!", "Mum has a red {0}."]
HARD = ["Notwithstanding clause {1}, the {0} indemnifies the assignee in respect of consequential losses.", "The subordinated {0} is deemed enforceable insofar as its provisions remain severable.", "Pursuant to the aforementioned covenant, the {0} relinquishes any residual entitlement."]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        level = rng.choice([1, 5])
        pool = EASY if level == 1 else HARD
        other = HARD if level == 1 else EASY
        text = " ".join(rng.choice(pool if rng.random() < 0.8 else other).format(rng.choice(["dog", "key", "claim", "note", "tree"]), rng.randint(1, 90)) for _ in range(rng.randint(4, 14)))
        rows.append((k, text, rng.choice(["letter", "memo"]), level))
        labels.append((k, level, "g"))
    return rows, labels


def test_reading_levels_held_out(spark):
    rows, labels = corpus(160, 1)
    extra = [(1000, None, "letter", 9), (1001, " \n ", "memo", 9), (1002, "", "memo", 9), (1003, rows[0][1], "ticket_note", 9), (1004, rows[0][1], None, 9), (1005, (HARD[0].format("x", 1) + " ") * 900, "letter", 9)]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, kind string, level int")
    given = spark.createDataFrame(labels[:80] + labels[:5] + [(1, 99, "g"), (None, 3, "g")], "doc_id bigint, reading_level int, grader string")
    got = {r["doc_id"]: r for r in reading_level.reading_levels(df, given).collect()}
    assert set(got) == {k for k, *_ in rows} | {1005}
    held = [(got[k]["demanding"] > 0.5) == (level == 5) for k, _, _, level in rows[80:]]
    assert np.mean(held) > 0.95
    assert got[1005]["level"] == 5 and abs(sum(got[1005]["shares"]) - 1) < 1e-6
    assert reading_level.reading_levels(df, given.limit(0)).count() == 0
    assert reading_level.reading_levels(df.limit(0), given).count() == 0


def test_sample_is_bounded_and_whole(spark):
    rows, labels = corpus(60, 2)
    df = spark.createDataFrame([(k, t, kind) for k, t, kind, _ in rows] + [(0, "", "memo")] * 3, "doc_id bigint, text string, kind string")
    given = spark.createDataFrame(labels, "doc_id bigint, reading_level int, grader string")
    texts = {k: t for k, t, *_ in rows}
    for most, characters in ((20, 10**9), (60, 5_000), (60, 1), (0, 10**9)):
        got = reading_level.graded_sample(df, given, most, characters).collect()
        assert all(r["text"] == texts[r["doc_id"]] and sum(r["grades"]) == 1 for r in got)
        assert len(got) == {20: 20, 0: 0}.get(most, 1 if characters == 1 else len(got)) and sum(len(r["text"]) for r in got) < characters + 2_000
    assert len(reading_level.graded_sample(df, given).collect()) == 60


def test_features_are_those_of_single_texts(monkeypatch):
    texts = ["One two. Three? no.", "", "你好。再见！", "a\nb", "x" * 500, "", "Last one."]
    whole = reading_level.features(texts)
    monkeypatch.setattr(reading_level, "PASS_CHARS", 10)
    apart = reading_level.features(texts)
    assert apart.at.tolist() == whole.at.tolist() and apart.text.tolist() == whole.text.tolist() and apart.size.tolist() == whole.size.tolist()
    for k in range(len(whole.text)):
        assert sorted(apart.bucket[apart.at[k] : apart.at[k + 1]]) == sorted(whole.bucket[whole.at[k] : whole.at[k + 1]])
    model = reading_level.LevelModel(np.random.default_rng(1).normal(size=(1 << reading_level.BITS, reading_level.LEVELS)), np.zeros(reading_level.LEVELS), np.zeros((1, 1)))
    monkeypatch.setattr(reading_level, "SLICE_FEATURES", 7)
    assert np.allclose(model.levels_of(apart), model.sentence_levels(reading_level.sentences(texts)), atol=1e-5)


def test_sentences_and_passes():
    texts = ["One two. Three? no.", "", "你好。再见！", "a\nb", "x" * 500]
    s = reading_level.sentences(texts)
    assert s.text.tolist() == [0, 0, 2, 2, 3, 3, 4]
    whole, each = reading_level.sentences(texts), [reading_level.sentences([t]) for t in texts]
    sums = lambda s: sorted(int(x) for b in s.buckets for x in b)
    assert sums(whole) == sorted(x for s in each for x in sums(s))
    assert re.fullmatch(r"\d+", str(whole.size.sum()))
