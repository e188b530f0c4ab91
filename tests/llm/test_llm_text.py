from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from phenorank.llm import leakage, lookalike, mapping, packing, residue, words


def test_equal_looking_texts_become_equal():
    plain = "Khối đặc dạ dày thoáng qua type A-B"
    for other in [
        "Κһối đặс dа̣ ԁа̀y thօɑ́ոɡ️ qսа type A‑B", "Ｋhối đặc dạ　dày thoáng qua type A-B", "Khối đặc dạ dày thoáng​ qua­ type A−B ﻿", "Khối đặc dạ dày thoáng qua type A-B", "  Khối  đặc dạ dày thoáng qua type A-B",
    ]:
        assert lookalike.by_table(" ".join(other.split())).split() == plain.split(), other
    assert lookalike.by_table("ⅿôі") == "môi" and lookalike.by_table("đ") == lookalike.by_table("d̵")
    for a, b in [("gan", "gân"), ("lưới", "lưỡi"), ("Gan", "gan"), ("x²", "x2"), ("½", "1/2"), ("đ", "d"), ("o", "0")]:
        assert lookalike.by_table(a) != lookalike.by_table(b)


def test_trie_and_table_agree():
    vocabulary = ["khối", "đặc", "dạ", "dày", "thoáng"]
    speller = lookalike.Speller(vocabulary)
    rng = random.Random(1)
    alike: dict[str, list[str]] = {}
    for many, plain in lookalike.DRAWN_ALIKE:
        for odd, p in zip(many, plain):
            alike.setdefault(p, []).append(odd)
    import unicodedata

    for word in vocabulary * 20:
        odd = "".join(rng.choice(alike.get(c, [c])) + rng.choice(["", "", "​"]) * (not unicodedata.combining(c)) for c in unicodedata.normalize("NFD", word))
        assert speller.token(odd) == word == lookalike.by_table(odd.replace("​", ""))
    trie = lookalike.Trie(vocabulary)
    assert trie.spelling("khôi") is None and trie.spelling("khôi", budget=1.0) == ("khối", 1.0) and trie.spelling("dayx", budget=2.0)[0] in ("dày", "dạ")
    # a letter drawn like either of two: the table says one, the vocabulary which
    speller = lookalike.Speller(["lưỡi", "Iod", "vận", "uống", "gan"])
    for odd, right, table in [("Ιưỡi", "lưỡi", "Iưỡi"), ("Ӏưỡi", "lưỡi", "Iưỡi"), ("ӏod", "Iod", "lod"), ("υận", "vận", "uận"), ("υống", "uống", "uống"), ("զan", "gan", "qan"), ("Ιa", "Ia", "Ia")]:
        assert (speller.token(odd), lookalike.by_table(odd)) == (right, table), odd
    assert lookalike.by_table("ᴄᴏᴠ ꓐꓳ") == "cov BO"
    assert lookalike.Trie(["l", "I"]).spelling("ӏ") in (("l", 0.0), ("I", 0.0))


def test_found_edge_cases(spark):
    m = spark.createDataFrame([(1, "Gаn to", 0), (1, "Gаn to", 0), (2, "Gan to", 0), (3, None, 0), (4, "​ ", 0), (None, "Gаn to", 0), (5, "gan to", 0)], "mention_id bigint, mention_text string, canonical int")
    c = spark.createDataFrame([("H1", "Gan to"), ("H2", None), ("H3", "﻿"), (None, "Gan to")], "id string, vi string")
    assert [tuple(r) for r in lookalike.found(spark, m, c).collect()] == [(1, "H1")]
    assert lookalike.found(spark, m.limit(0), c).count() == 0 and lookalike.found(spark, m, c.limit(0)).count() == 0
    kept = lookalike.spelled(m, "mention_text", lookalike.vocabulary(c, "vi"))
    assert kept.count() == 7 and kept.columns == ["mention_id", "mention_text", "canonical"]
    long = spark.createDataFrame([("а" * 100_000,)], "t string")
    assert lookalike.spelled(long, "t", []).collect()[0].canonical == "a" * 100_000


CATALOGUE = [
    ("H1", "Phù nề xương mũi bên phải", "Right-sided swelling of the nasal bone", None, "xương mũi sưng phù bên phải|nasal bone swelling (right-sided)"),
    ("H2", "Phù nề thận mặt sau", "Posterior swelling of the kidney", None, "thận sưng phù mặt sau|kidney swelling (posterior)"),
    ("H3", "Lỗ rò gan mặt sau", "Posterior fistula of the liver", "PFL3", "gan đường thông mặt sau|liver fistula (posterior)"),
    ("H4", "Lỗ rò gân mặt sau", "Posterior fistula of the tendon", None, "gân đường thông mặt sau|tendon fistula (posterior)"),
    ("H5", "Giãn rộng thận lan rộng xuống dưới", None, None, "thận nở rộng lan rộng xuống dưới|kidney dilation (downward-extending)"),
    ("H6", "Phù nề gan lan rộng xuống dưới", "Downward-extending swelling of the liver", None, None),
]
READINGS = {
    "phu ne xuong mui": ["H1"], "PHÙ NỀ XƯƠNG MŨI BP": ["H1"], "xương mũi: bên phải, phù nề": ["H1"], "theo dõi pùh nề xưng mũi": ["H1"], "right-sided sweling of teh nasal bone": ["H1"], "phuf neef xuwowng muix": ["H1"],
    "lỗ rò gan": ["H3"], "lỗ rò gân mặt sau [+]": ["H4"], "looix rof gaan": ["H4"], "loox rof gan": ["H3"], "lo ro gan": ["H3", "H4"], "PFL3": ["H3"], "thận lan rộng xuống dưới": [], "thận bình thường": [], "blood draw by phone": [],
    "phù nề": [], "": [], "giãn rộng thận": ["H5"], "phù nề gan lan rộng xuống dưới": ["H6"],
}


def test_readings():
    reference = mapping.Reference(CATALOGUE)
    for value, want in READINGS.items():
        assert reference.read(mapping.words(value))[1] == want, value


def test_distance():
    assert mapping.distance("abc", "abc", False) == 0 and mapping.distance("acb", "abc", False) == mapping.SWAP and mapping.distance("", "ab", False) == 2
    assert mapping.distance("gan", "gân", True) == 0 and mapping.distance("gan", "gân", False) == mapping.BARE and mapping.distance("gàn", "gân", False) == mapping.ACCENT
    assert mapping.distance("abcdef", "uvwxyz", False, 2) == float("inf")
    rng = random.Random(2)
    words_ = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    index: dict[str, set[str]] = {}
    for w in words_:
        for left in mapping.deletions(w[: mapping.PREFIX], 2):
            index.setdefault(left, set()).add(w)
    for q in words_:  # the dictionary finds every word within two edits
        found = set().union(*[index.get(x, set()) for x in mapping.deletions(q[: mapping.PREFIX], 2)])
        assert {w for w in words_ if mapping.distance(q, w, False) <= 2} <= found


def test_mapped_edge_cases(spark):
    m = spark.createDataFrame(
        [(1, "phu ne xuong mui", None), (1, "phu ne xuong mui", None), (2, "thận", None), (3, None, None), (4, "​", None), (5, "lo ro gan", None), (6, "lo ro gan", None), (7, "x", "H4"), (8, "y", "H4"), (None, "x", None), (9, "w " * 3000, None)],
        "mention_id bigint, mention_text string, hpo_id string",
    )
    c = spark.createDataFrame(CATALOGUE, "id string, vi string, en string, aliases string, synonyms string")
    h = spark.createDataFrame([(5, "H3", 0.2), (5, "H1", 0.9), (None, "H3", 1.0), (6, None, None), (5, "H3", None)], "mention_id bigint, hpo_id string, score double")
    got = sorted(tuple(r) for r in mapping.found(spark, m, c, h).collect())
    assert got == [(1, "H1"), (2, "NONE"), (5, "H3"), (6, "H4"), (9, "NONE")]
    assert sorted(r.mention_id for r in mapping.misses(m, c, h).collect()) == [2, 9]
    assert mapping.found(spark, m.limit(0), c, h).count() == 0
    assert {r.hpo_id for r in mapping.found(spark, m, c.limit(0), h.limit(0)).collect()} == {"NONE"}


def test_word_hashes():
    texts = ["The <b>Quick</b> brówn-fox; đi bộ", "THE quick\nBROWN fox đi bo", ""]
    h, of, _ = words.word_hashes([words.folded(t) for t in texts])
    assert h[of == 0].tolist() == h[of == 1].tolist() and (of == 2).sum() == 0
    assert len(set(words.word_hashes([b"ab ba a b aa"])[0].tolist())) == 5


VOCABULARY = [f"w{k}x{k * k % 97}" for k in range(4000)]


def passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def test_leakage_against_plain_search(spark):
    rng = random.Random(7)
    items = [(k, passage(rng, 120)) for k in range(12)]
    docs, want = [], set()
    for d in range(160):
        words_ = passage(rng, rng.choice([20, 60, 400]))
        kind = d % 4
        item, text = rng.choice(items)
        start = rng.randrange(0, 80)
        if kind == 0:
            n = rng.choice([30, 33, 40])
            part = text[start : start + n]
            for p in rng.sample(range(2, n - 2), n // 10) if rng.random() < 0.7 else []:
                part[p] = "changed"
            words_ += part
            want.add((d, item))
        elif kind == 1:
            words_ += text[start : start + rng.choice([5, 12, 20, 24])]
        elif kind == 2:  # too many changes
            part = text[start : start + 40]
            for p in range(0, 40, 4):
                part[p] = "changed"
            words_ += part
        words_ += passage(rng, rng.choice([0, 30]))
        body = " ".join(words_)
        docs.append((d, body.upper().replace(" W", "\n> W") if d % 3 == 0 else body))
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, docs[0][1]), docs[0]], "doc_id bigint, text string")
    it = spark.createDataFrame([*[(k, " ".join(w)) for k, w in items], (99, None), (98, "too short")], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.found(spark, df, it).collect()} == want
    assert {tuple(r) for r in leakage.leaked(df.repartition(7), it.repartition(3), chunk_bytes=500).collect()} == want
    assert leakage.found(spark, df.limit(0), it).count() == 0 and leakage.found(spark, df, it.limit(0)).count() == 0


OPEN = ["Dear {{name}}, hi", "a ${patient_code} b", "by %doctor%.", "at %(site)s", "[[mã hồ sơ]]", "[INSERT date HERE]", "[điền kết luận]", "<insert name>", "<<doctor>>", "<%= x %>", "{% if a %}", "«site name»", "@@X_Y@@", "__ten__ đo", "on ________.", "#{finding.1}", "TBD(doctor)",
        "on dd/mm/yyyy.", "XX/XX/XXXX", "(chưa điền)", "Main finding: $VAR at 3", "by ............ on", "$mã hồ sơ$"]
CLOSED = ["set {a, b, c} [see figure 2]", "10% [range 5-15%]", "<5 mm> in table [3] with <em>x</em>", "`{{name}}` is code", "```\n{{x}}\n```", "with $ and # not allowed", "10% of 20% here", "A placeholder is written as {{name}} in the manual.", "« bonjour »", "costs $45", "# Title", "", "wait..."]
BAD = ["Please enable JavaScript to view this report.\nBack to start", "404 Not Found", "Lorem ipsum dolor sit amet. Magna aliqua.", "xxxx xxxx xxxx xxxx.", "Your session has expired. Log in again to continue.", "Lỗi 12: không tìm thấy trang bạn yêu cầu.", '{"status": 500, "error": "x"}',
       "Traceback (most recent call last):\n  File \"a.py\", line 7, in x\nKeyError: 'report'", "Text text text text text."]
GOOD = ["One site could not open the viewer until JavaScript was enabled, which delayed its 12 readings.", "Home | Reports | Contact", "The lung appeared normal.\n404 Not Found", "", "   ", "The page was not found in the paper archive, so the scan was repeated."]


def test_residue_rules():
    for t in OPEN:
        assert residue.has_open_field(t), t
    for t in CLOSED:
        assert not residue.has_open_field(t), t
    for t in BAD:
        assert residue.only_residue(t), t
    for t in GOOD:
        assert not residue.only_residue(t), t


def test_residue_edge_cases(spark):
    df = spark.createDataFrame([(1, "Dear {{x}}", True), (1, "Dear {{x}}", True), (2, None, True), (3, " ", True), (None, "Dear {{x}}", True), (4, "word " * 50_000 + "{{late_field}}", True)], "doc_id bigint, text string, residue boolean")
    assert sorted(r.doc_id for r in residue.found(spark, df).collect()) == [1, 4]
    assert residue.without_residue(df).columns == ["doc_id", "text"] and residue.without_residue(df).count() == 2
    assert residue.found(spark, df.limit(0)).count() == 0


def test_fill_keeps_shares():
    rng = random.Random(4)
    items = [(rng.randrange(1, 60), k, 0, 0, rng.choice("AB")) for k in range(400)]
    accounts: dict[str, float] = {}
    boxes = packing.fill(items, 100, {"A": 0.5, "B": 0.5}, accounts)
    assert sorted(i for box in boxes for i in box) == sorted(items) and max(sum(i[0] for i in box) for box in boxes) <= 100
    used = {s: 0 for s in "AB"}
    for n, box in enumerate(boxes[:-2], 1):  # carried deficits: at no time is a source further off than a container
        for i in box:
            used[i[4]] += i[0]
        assert abs(used["A"] - used["B"]) <= 120, n
    assert packing.fill([], 100, {}, {}) == []


def test_every_window_is_mixed():
    """Small items and items over the capacity: each container has the wanted shares within a few hundredths."""
    rng = random.Random(5)
    shares = {"A": 0.5, "B": 0.3, "C": 0.2}
    items = [(rng.randrange(5, 120), k, 0, 0, rng.choices("ABC", [5, 3, 2])[0]) for k in range(4000)] + [(rng.randrange(1100, 9000), 9000 + k, 0, 0, "ABC"[k % 3]) for k in range(9)]
    accounts: dict[str, float] = {}
    boxes = packing.fill(items, 1000, shares, accounts)
    far = []
    for box in boxes:
        n = sum(i[0] for i in box)
        assert n <= 1000
        far.append(sum(max(0.0, sum(i[0] for i in box if i[4] == s) / n - share) for s, share in shares.items()))
    assert sum(i[0] for box in boxes for i in box) == sum(i[0] for i in items) >= 0.99 * 1000 * len(boxes)
    assert sorted(far)[len(far) // 2] <= 0.05 and sorted(far)[int(len(far) * 0.8)] <= 0.1
    whole = {i[1]: i[0] for i in items}
    for id_, size in whole.items():  # pieces follow each other and make up the item
        parts = sorted((i[3], i[0]) for box in boxes for i in box if i[1] == id_)
        assert sum(p[1] for p in parts) == size and (size > 1000 or len(parts) == 1)
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))


def test_packed(spark):
    rng = random.Random(6)
    rows = [(k, "word " * rng.randrange(1, 300), rng.choice(["a", "b", None])) for k in range(300)] + [(900, None, "a"), (901, "", "a"), (902, "word " * 5000, "a"), (0, "word", "a"), (None, "word", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.packed(df, capacity=512, task_tokens=6000).collect()
    boxes: dict[str, list] = {}
    for r in got:
        boxes.setdefault(r.container_id, []).append((r.place, r.n_tokens))
    for inside in boxes.values():
        at = 0
        for place, n in sorted(inside):
            assert place == at
            at += n
        assert at <= 512
    counts = {r.doc_id: r.n_tokens for r in packing.with_token_counts(df.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    placed: dict[int, int] = {}
    for r in got:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_tokens
    assert {k: v for k, v in placed.items() if k} == {k: v for k, v in counts.items() if v and k}
    assert sum(placed.values()) / (512 * len(boxes)) > 0.9 and all(r.piece == 0 for r in got if r.doc_id != 902)
    parts = sorted((r.token_from, r.n_tokens, r.piece) for r in got if r.doc_id == 902)
    assert [p[2] for p in parts] == list(range(len(parts))) and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert packing.packed(df.limit(0)).count() == 0
    full = packing.filling(spark, df.drop("source").withColumn("source", F.lit("x")), 512).collect()[0]
    assert full.deviation == full.overall == 0 and full.share_used > 0.9
    assert packing.filling(spark, df.limit(0), 512).collect()[0].containers == 0
    with pytest.raises(ValueError):
        packing.packed(df, capacity=0)
