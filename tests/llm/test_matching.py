import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from versefold.functions.chinese import to_simplified_table
from versefold.llm import alignment, canonical, confusable, listings


@pytest.fixture(scope="module", autouse=True)
def look(spark):
    return confusable.installed(confusable.shared(spark))


@pytest.fixture(scope="module")
def simplify(spark):
    return to_simplified_table(spark)


# Look-alikes in eleven scripts, of one character in a Latin word, and of words.
ALIKE = [
    ("Ꮪilk", "Silk"), ("ꮯut", "cut"), ("Ꭱed", "Red"), ("Ꭲea", "Tea"), ("ꓣose", "Rose"), ("ꓢilk", "Silk"), ("ꓮpril", "April"), ("Ⲟld", "Old"), ("Ⲥut", "Cut"), ("τest", "test"), ("rοsе", "rose"),
    ("νase", "vase"), ("Ηerb", "Herb"), ("Αpril", "April"), ("Ѕilk", "Silk"), ("Јune", "June"), ("frеsh", "fresh"), ("ѕtem", "stem"), ("іris", "iris"), ("սrn", "urn"), ("հerb", "herb"), ("օld", "old"),
    ("ᴀpple", "apple"), ("ʀose", "rose"), ("ɢreen", "green"), ("𝐇𝐨𝐭", "Hot"), ("ｇｒｅｅｎ", "green"), ("ɡreen", "green"), ("人ロ", "人口"), ("二ハ月", "二八月"), ("ト居", "卜居"), ("工ト", "工ト"), ("バ一ド", "バード"), ("ハス", "ハス"), ("山一ロ", "山一口"),
    ("5μm", "5μm"), ("Розовый", "Розовый"), ("Ελλάδα", "Ελλάδα"), ("שלום", "שלום"), ("한글", "한글"), ("カーテン", "カーテン"), ("東京タワー", "東京タワー"),
]


@pytest.mark.parametrize("text,want", ALIKE)
def test_look_alikes_of_many_scripts(text, want):
    assert confusable.consistent(text) == want
    assert confusable.consistent(want) == want


def test_script_sets_are_intersected():
    assert confusable.resolved(list("rose")) == {"Latn"} and confusable.resolved(list("rоse")) == frozenset()
    assert "Jpan" in confusable.resolved(list("山ハ")) and confusable.resolved(list("한ハ")) == frozenset() and confusable.resolved(["1"]) is None


@pytest.mark.parametrize(
    "text,want",
    [
        (None, None), ("", ""), (" \n", " \n"), ("ＨＯＴ　１０支", "HOT 10支"), ("Cut Flоwеrs", "Cut Flowers"), ("60СМ", "60CM"), ("60СΜ", "60CM"), ("Vοl. Β", "Vol. B"),
        ("é", "é"), ("Étoile São", "Étoile São"), ("a​b﻿⁠c­d", "abcd"), ("a b c", "a b c"), ("⼭⽔", "山水"), ("金", "金"), ("ɑnge", "ange"),
        ("👩‍🌾 ❤️", "👩‍🌾 ❤️"), ("云‍月", "云月"), ("Роза Ρόδο バラ", "Роза Ρόδο バラ"), ("Розовый сор", "Розовый сор"), ("，。！？（）《》—…·", "，。！？（）《》—…·"),
        ("霜鈴花 龍鬚", "霜鈴花 龍鬚"), ("caд", "сад"), ("نی‌خواهم", "نی‌خواهم"), ("①", "①"),
    ],
)
def test_consistent(text, want):
    assert confusable.consistent(text) == want
    assert confusable.consistent(want) == want


def test_disguised_equals_python_on_all_cells(spark):
    cells = ["霜鈴花", "Frеsh", None, "", "ＨＯＴ", "a b", "❤️", "É", "x" * 50_000, "x" * 50_000 + "​"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id bigint, name string")
    got = {r.row_key for r in confusable.disguised(df, "t", "id", "name").collect()}
    assert got == {str(i) for i, c in enumerate(cells) if c != confusable.consistent(c)} == {"1", "4", "9"}
    norm = {r.row_key: r.normalized for r in confusable.normalized(df, "t", "id", "name").collect()}
    assert norm == {str(i): confusable.consistent(c) for i, c in enumerate(cells)}
    assert confusable.disguised(df.limit(0), "t", "id", "name").count() == 0


REFERENCE = [(1, "花名", "霜铃花", ["踏歌娘"]), (2, "花名", "月络兰", None), (3, "花名", "一捻砂", []), (4, "朝代", "昱", ["Yu"]), (5, "朝代", "朔凉", ["Shuoliang"]), (6, "月份", "十二月", ["腊月"]), (7, "月份", "正月", ["一月", "孟春"]), (8, "月份", "三月", ["季春"])]


AFFIXES = [("花名", "before", "重瓣"), ("花名", "behind", "俗名"), ("朝代", "behind", "初"), ("朝代", "behind", "dynasty"), ("月份", "behind", "之月"), ("月份", "before", "农历"), ("月份", "behind", "望日")]


def index_of(reference, simplify, affixes=()):
    return canonical.Index([(r, f, s, s == e, 0) for r, f, e, o in reference for s in [e, *(o or [])]], simplify, affixes)


@pytest.mark.parametrize(
    "field,value,want",
    [
        ("花名", "霜 铃花。", 1), ("花名", "霜鈴花", 1), ("花名", "霜花铃", 1), ("花名", "霜铃", 1), ("花名", "重瓣霜铃花", 1), ("花名", "重瓣霜铃", 1), ("花名", "踏歌娘（俗名）", 1), ("花名", "霜铃花/乙", 1), ("花名", "捻一砂", 3),
        ("花名", "海外异种", 0), ("花名", "。", 0), ("花名", " ", 0), ("花名", "未识霜铃花", 0), ("朝代", "yu", 4), ("朝代", "昱初", 4), ("朝代", "[昱]", 4), ("朝代", "朔宛", 5), ("朝代", "Shuoliang dynasty", 5), ("朝代", "海外", 0), ("朝代", "某昱", 0),
        ("月份", "12", 6), ("月份", "12 月", 6), ("月份", "十二", 6), ("月份", "腊月", 6), ("月份", "十三月", 0), ("月份", "季春之月", 8), ("月份", "农历三月", 8), ("月份", "三月望日", 8), ("月份", "01月", 7), ("月份", "四时皆宜", 0), ("月份", "閏三月", 8), ("月份", "三", 8), ("月份", "初三", 0),
    ],
)
def test_map_value(field, value, want, simplify):
    assert index_of(REFERENCE, simplify, AFFIXES).find(field, value)[0] == want


def test_lookup_equals_brute_force(simplify):
    """Random edits of spellings, dressed at random: the index finds what comparing with every spelling finds."""
    rng = random.Random(1)
    letters = "甲乙丙丁戊己庚辛"
    words = sorted({"".join(rng.choices(letters, k=rng.choice([1, 2, 3, 3, 4, 9]))) for _ in range(60)})
    rows = [(i + 1, "f", w, i % 3 > 0, rng.randint(0, 3)) for i, w in enumerate(words)]
    affixes = [("f", "before", "题"), ("f", "behind", "初")]
    index = canonical.Index(rows, simplify, affixes)
    known = canonical.spellings(rows, simplify)
    misses = 0
    for _ in range(1500):
        v = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(v))
            v[i : i + rng.randint(0, 1)] = rng.choices(letters, k=rng.randint(0, 2))
        v = rng.choice(["", "", "题"]) + "".join(v) + rng.choice(["", "", "初"])
        best = None
        for f, steps in index.forms("f", v).items():
            for (_, s), rank in known.items():
                w = canonical.weighted_distance(f, s)
                if w <= min(canonical.allowed(f), canonical.allowed(s)) and len(f) - w >= 1:
                    got = (round(w + canonical.STEP * steps, 6), *rank)
                    best = min(best, got) if best else got
        misses += best is None
        assert index.find("f", v)[0] == (best[3] if best else 0), v
    assert 0 < misses < 1500


def test_affixes_are_learned_from_the_column(spark):
    ref = spark.createDataFrame(REFERENCE, "ref_id bigint, field_name string, entry string, other_names array<string>")
    values = [(str(i), f, v) for i, (f, v) in enumerate([("花名", "野生霜铃花"), ("花名", "野生月络兰"), ("花名", "怪异一捻砂"), ("花名", "野生甲乙"), ("朝代", "昱朝代初"), ("朝代", "朔凉朝代初"), ("朝代", "怪昱")])]
    got = {r.value: r.ref_id for r in canonical.map_values(spark.createDataFrame(values, "id string, field_name string, value string"), ref).collect()}
    assert got == {"野生霜铃花": 1, "野生月络兰": 2, "怪异一捻砂": 0, "野生甲乙": 0, "昱朝代初": 4, "朔凉朝代初": 5, "怪昱": 0}


def test_map_values(spark, monkeypatch):
    ref = spark.createDataFrame(REFERENCE, "ref_id bigint, field_name string, entry string, other_names array<string>")
    rows = [("1", "霜铃花", "昱", "三月"), ("2", "霜铃", "nan", None), ("3", "", "None", "未知月份"), ("2", "霜铃", "朔亮", "x")]
    df = spark.createDataFrame(rows, "ID string, `花名` string, `朝代` string, `月份` string")
    values = canonical.entered(df, "ID", ["花名", "朝代", "月份"])
    want = sorted([("2", "花名", 1), ("2", "花名", 1), ("2", "朝代", 5), ("2", "月份", 0)])
    got = lambda: sorted((r.id, r.field_name, r.ref_id) for r in canonical.map_values(values, ref).collect())
    assert got() == want
    monkeypatch.setattr(canonical, "MOST", 4)  # several parts
    assert sorted(set(got())) == sorted(set(want))
    assert all(r.ref_id == 0 for r in canonical.map_values(values, ref.limit(0)).collect())
    assert canonical.map_values(values.limit(0), ref).count() == 0


def test_frequency_breaks_ties(simplify):
    index = canonical.Index([(1, "f", "甲乙丙", True, 3), (2, "f", "甲乙丁", True, 9)], simplify)
    assert index.find("f", "甲乙戊")[0] == 2
    assert canonical.weighted_distance("ab", "ba") == 0.9 and canonical.weighted_distance("abb", "ab") == 0.9


FLOWERS = ["倒垂金盏", "霜铃花"]


def reader(simplify, colors=()):
    return listings.Reader({f: f for f in FLOWERS}, colors, simplify, None)



@pytest.mark.parametrize(
    "name,others,want",
    [
        ("霜鈴花·湖舟席（大紅） 10枝 包靚", [None, None, None, "Length 600mm"], ("霜铃花", "red", 60, 10)),
        ("Ｆｒｅｓｈ!Ｒｅｄ 霞亭竹 倒垂金盏", [None, None, None, "2 dozen\n80公分"], ("倒垂金盏", "red", 80, 24)),
        ("限量 霜铃花 - 湖舟席", ["暗酒紅", "一束12支", None, "0.8米 / 約7日觀賞期"], ("霜铃花", "burgundy", 80, 12)),
        ("空運直送紫 霜鈴花·湖舟席", ["", None, "0.40m", "兩打"], ("霜铃花", "purple", 40, 24)),
        (None, [None] * 4, (None, None, None, None)),
        ("", ["", "", "", ""], (None, None, None, None)),
    ],
)
def test_read_listing(name, others, want, simplify):
    assert reader(simplify).read(name, others)[:4] == want


def test_listing_groups(spark):
    schema = "id bigint, supplier_id bigint, external_id string, name string, color string, unit string, size string, spec_text string"
    promo = ["今日特價", "母親節精選", "限量 ", ""]
    rows = []
    for i in range(40):
        variety = "湖舟席" if i % 2 else "泉蔚笛"
        rows.append((i, i % 5, str(i), f"{promo[i % 4]}{variety}品種霜鈴花", "Red" if i % 4 < 2 else "紅色", None, "60cm", "10枝"))
        rows.append((100 + i, i % 5, str(100 + i), f"{promo[i % 4]}{chr(0x5000 + i)}甲乙 倒垂金盏", "白", None, None, "0.6米 10支"))
    rows += [(900, 1, "1", rows[2][3], "Red", None, "60cm", "10枝"), (901, 9, "x", "霜鈴花", None, None, None, None), (902, None, None, None, None, None, None, None), (903, 9, "x", None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema).withColumn("flower", F.lit("clash"))
    ref = spark.createDataFrame([(i, "花名", f, []) for i, f in enumerate(FLOWERS)], "ref_id bigint, field_name string, entry string, other_names array<string>")
    got = {tuple(r) for r in listings.pairs(listings.groups(df, ref)).collect()}
    same = lambda ids: {(a, b) for a in ids for b in ids if a < b}
    assert got == same(range(0, 40, 2)) | same([*range(1, 40, 2), 900]) | {(901, 903)}  # two fetches of one listing
    assert listings.pairs(listings.groups(df.limit(0), ref)).count() == 0


def brute_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (alignment.MATCH if a[i - 1] == b[j - 1] else alignment.MISMATCH), h[i - 1, j] + alignment.GAP, h[i, j - 1] + alignment.GAP)
    return h.max()


def test_smith_waterman_equals_plain_table():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (30, 12)).astype(np.uint32), rng.integers(0, 4, (30, 20)).astype(np.uint32)
    la, lb = rng.integers(1, 13, 30), rng.integers(1, 21, 30)
    best, longest = alignment.smith_waterman(a, la, b, lb)
    for i in range(30):
        x, y = a[i, : la[i]], b[i, : lb[i]]
        assert best[i] == brute_score(x, y)
        runs = [k for k in range(1, len(x) + 1) if any(np.array_equal(x[p : p + k], y[q : q + k]) for p in range(len(x) - k + 1) for q in range(len(y) - k + 1))]
        assert longest[i] == max(runs, default=0)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["river", "stone", "amber", "lantern", "cold"])
    items = [(i, "".join(rng.choices("云月溪山寒霜孤灯烟雨", k=60)) if i % 2 else " ".join(word() for _ in range(14))) for i in range(20)] + [(90, None), (91, "")]
    docs = [(0, None), (1, ""), (2, "。")]
    for k in range(3, 80):
        t = items[rng.randrange(20)][1]
        a, n = rng.randrange(30), rng.randint(20, 60)
        docs.append((k, "".join(rng.choices("风雪花鸟 ，", k=200)) + "，".join(t[a : a + n]) + "".join(rng.choices("风雪花鸟", k=50))))
    docs.append((3, docs[3][1]))
    from .test_duplicates import key

    runs = {}
    for i, t in items:
        x = key(t)
        for j in range(len(x) - 29):
            runs.setdefault(x[j : j + 30], set()).add(i)
    want = sorted((k, i) for k, t in docs for i in {i for j in range(max(0, len(key(t)) - 29)) for i in runs.get(key(t)[j : j + 30], ())})
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    found = alignment.leaks(d, "doc_id", "text", e, "item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in found.where("longest_run >= 30").collect()) == want
    assert alignment.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0
    assert alignment.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    with pytest.raises(ValueError):
        alignment.leaks(d, "doc_id", "text", e, "item_id", "text", run=18)


def test_edited_passage_is_scored(spark):
    text = "".join(chr(0x4E00 + 7 * i) for i in range(80))
    edited = text[:20] + "某" + text[22:45] + text[46:]
    d = spark.createDataFrame([(1, "前" * 50 + edited + "后" * 50)], "doc_id bigint, text string")
    e = spark.createDataFrame([(5, text)], "item_id bigint, text string")
    r = alignment.leaks(d, "doc_id", "text", e, "item_id", "text").first()
    assert (r.doc_id, r.item_id) == (1, 5) and r.share > 0.9 and r.longest_run < 40


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_CHARS", 100)
    items = [(i, "".join(chr(0x4E00 + 100 * i + j) for j in range(40))) for i in range(8)]
    d = spark.createDataFrame([(k, t + items[k - 1][1]) for k, t in items], "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in alignment.leaks(d, "doc_id", "text", e, "item_id", "text").collect()}
    assert got == {(k, j % 8) for k in range(8) for j in (k, k + 7)}


def test_numbers_in_marketing_words(simplify):
    r = reader(simplify)
    assert r.read("買二送一枝棠芸品種霜鈴花", ["Burgundy", "20枝裝", None, "Length 50厘米"])[2:4] == (50, 20)
    assert r.read("買二送一 枝冷月霜鈴花 每紮12枝", ["紅", None, "50cm", None])[2:4] == (50, 12)
    assert "枝棠芸" in "".join(r.read("買二送一枝棠芸品種霜鈴花", ["Burgundy", "20枝裝", None, "Length 50厘米"])[4])


def test_words_are_cut_off_the_ends_of_longer_runs():
    c = listings.Cutter(["空运", "直送", "空运直送", "限量"])
    assert c.cut("空运直送朔溪翎限量") == ["空运直送", "朔溪翎", "限量"] and c.cut("限量") == ["限量"] and c.cut("fresh") == ["fresh"] and c.cut("限量限量") == ["限量", "限量"]


def test_combinations_equal_itertools():
    got = {c: p for c, p in listings.title_combinations(["限量", "a", "b", "a"], frozenset(["限量"]), (2, 3))}
    assert got == {("a", "限量"): 1.0, ("b", "限量"): 2.0, ("a", "b"): 1.0, ("a", "b", "限量"): 1.0}
    assert list(listings.title_combinations(["限量"], frozenset(["限量"]), (2,))) == [] and list(listings.title_combinations(["a"], frozenset(), (2,))) == [(("a",), 0.0)]


LISTING = "id bigint, supplier_id bigint, external_id string, name string, color string, unit string, size string, spec_text string"


def pairs_of(spark, rows, **how):
    ref = spark.createDataFrame([(i, "花名", f, ["踏歌娘"] if f == "霜铃花" else []) for i, f in enumerate(FLOWERS)], "ref_id bigint, field_name string, entry string, other_names array<string>")
    return {tuple(r) for r in listings.pairs(listings.groups(spark.createDataFrame(rows, LISTING), ref, **how)).collect()}


def test_listings_of_any_wording(spark):
    white = lambda i, s, name, color="白", spec="60cm, 10枝": (i, s, str(i), name, color, None, None, spec)
    rows = [
        white(1, 1, "Avalanche 霜铃花"), white(2, 2, "霜铃花 - AVALANCHE"),  # a Latin variety
        white(3, 1, "梅 霜铃花"), white(4, 2, "霜铃花（梅）"),  # of one ideograph
        white(5, 1, "湖舟席 霜铃花", "银灰"), white(6, 2, "霜铃花·湖舟席", "银灰色"), white(7, 3, "霜铃花·湖舟席", "墨綠"),  # a color of no list
        white(8, 1, "皇家贵族南方公主殿 霜铃花"), white(9, 2, "皇家贵族北方公主殿 霜铃花"), white(10, 3, "霜铃花 皇家贵族南方公主殿"),
        white(11, 1, "晨星 无名草"), white(12, 2, "无名草·晨星"),  # a flower of no list
        white(13, 1, "踏歌娘 倚云"), white(14, 2, "霜铃花 倚云"),  # another name of the flower
        white(15, 1, "长夜 霜铃花", spec="60cm"), white(16, 2, "长夜 霜铃花", spec="60cm"),  # stems unknown
        white(17, 1, "同名 霜铃花"), white(18, 2, "同名 倒垂金盏"),  # one variety of two flowers
    ]
    assert pairs_of(spark, rows) == {(1, 2), (3, 4), (5, 6), (8, 10), (11, 12), (13, 14)}


def test_fetches_always_pair(spark):
    rows = [
        (1, 1, "a", "霜铃花", None, None, None, None), (2, 1, "a", None, None, None, None, None),  # states nothing
        (3, 1, "b", "甲乙 霜铃花 60cm 10枝", "白", None, None, None), (4, 1, "b", "甲乙 霜铃花 60cm 12枝", "白", None, None, None),  # contradicts itself
        (5, 2, "c", "甲乙 霜铃花 60cm 10枝", "白", None, None, None), (6, 2, None, "丙丁 霜铃花 60cm 10枝", "白", None, None, None), (7, None, "a", None, None, None, None, None),
        (8, 3, "d", "甲乙 霜铃花", None, None, None, None), (9, 3, "d", "甲乙 霜铃花 60cm 12枝", "白", None, None, None), (9, 3, "d", "甲乙 霜铃花 60cm 12枝", "白", None, None, None),
    ]
    assert pairs_of(spark, rows) == {(1, 2), (3, 4), (3, 5), (8, 9), (4, 9), (4, 8)}


@pytest.mark.parametrize("ks", [(2,), (2, 3)])
def test_votes_equal_brute_force(spark, ks):
    """Clusters by a plain count of all combinations, over titles of random tokens with marketing words."""
    rng = random.Random(6)
    promo, rows = ["今日特價", "限量", "現貨", "Fresh", "店長之選"], []
    varieties = {f: ["".join(rng.choices("湖舟席泉蔚笛霞亭竹朔溪翎", k=rng.choice([1, 2, 3, 5]))) + x for x in "甲乙丙丁"] for f in FLOWERS}
    truth = {}
    for i in range(300):
        f = rng.choice(FLOWERS)
        v, color, stems = rng.choice(varieties[f]), rng.choice(["红", "白"]), rng.choice([5, 10])
        words = [f, v, *rng.sample(promo, rng.randint(0, 2))]
        rng.shuffle(words)
        truth.setdefault((f, v, color, stems), []).append(i)
        rows.append((i, i % 7, str(i), " ".join(words), color, None, "60cm", f"{stems}枝"))
    want = {(a, b) for ids in truth.values() for a in ids for b in ids if a < b}
    assert pairs_of(spark, rows, ks=ks) == want


def test_parts_of_other_combinations_are_merged(spark):
    """(x, flower) wins where there is a flower, (x, y) elsewhere; a listing with all three ties both parts."""
    rows = [(i, i, str(i), "霜铃花 x", "白", None, None, "60cm 10枝") for i in range(6)] + [(10 + i, i, f"b{i}", "霜铃花 x y", "白", None, None, "60cm 10枝") for i in range(12)]
    got = pairs_of(spark, rows)
    ids = [r[0] for r in rows]
    assert got == {(a, b) for a in ids for b in ids if a < b}


def test_long_and_odd_titles(spark):
    rows = [(1, 1, "a", "云" * 20000, "白", None, None, "60cm 10枝"), (2, 2, "b", " ".join(f"w{i}" for i in range(300)), "白", None, None, "60cm 10枝"), (3, 3, "c", "", "", "", "", ""), (4, 4, "d", "云" * 20000, "白", None, None, "60cm 10枝")]
    assert pairs_of(spark, rows) == {(1, 4)}


def scattered(rng, text, rate, letters):
    """Replaced, dropped and added characters, `rate` of them altogether."""
    out = []
    for c in text:
        u = rng.random()
        out += [rng.choice(letters)] if u < rate / 3 else [] if u < 2 * rate / 3 else [c, rng.choice(letters)] if u < rate else [c]
    return "".join(out)


@pytest.mark.parametrize("rate,least", [(0.02, 1.0), (0.05, 0.99), (0.1, 0.97), (0.15, 0.95)])
def test_recall_of_edited_passages(spark, small, rate, least):
    """Items planted with edits all over, against the alignment of every document with every item, at half of the item's score."""
    from .test_duplicates import key

    rng = random.Random(3)
    rows = [(r.item_id, key(r.text), r.kind) for r in spark.read.parquet(f"{small}/eval_item.parquet").collect() if key(r.text)]
    latin, han = "abcdefghijklmnopqrst", "".join(t for _, t, k in rows[:30] if k != "english")
    docs = []
    for _, t, k in rows:
        letters = latin if k == "english" else han
        docs.append("".join(rng.choices(letters, k=150)) + scattered(rng, t, rate, letters) + "".join(rng.choices(letters, k=100)))
    table = alignment.Items(np.array([i for i, _, _ in rows]), [t for _, t, _ in rows], 4)
    h, start, _, count, code = alignment.weighted_shingles(docs, alignment.SEED, False)
    offsets, size = np.concatenate(([0], np.cumsum([len(x) for x in docs]))), np.diff(table.offsets)
    found = alignment.score(table, code, offsets, *alignment.candidates(table, h, start, np.repeat(np.arange(len(count)), count), 30))
    true = got = 0
    for i in range(len(rows)):
        item = np.full(len(docs), i)
        best, _ = alignment.smith_waterman(alignment._padded(table.code, table.offsets[item], table.offsets[item + 1], 0), size[item], alignment._padded(code, offsets[:-1], offsets[1:], 1), np.diff(offsets))
        for d in np.flatnonzero(best >= alignment.MATCH * size[i] * 0.5):
            true += 1
            got += found.get((int(d), i), (0, 0))[0] >= alignment.MATCH * size[i] * 0.5
    assert true >= len(rows) * 0.95 and got >= least * true


def test_items_of_one_id_make_one_row(spark):
    text = "".join(chr(0x4E00 + 7 * i) for i in range(80))
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    e = spark.createDataFrame([(5, text), (5, text[:50] + "某某"), (5, text)], "item_id bigint, text string")
    got = alignment.leaks(d, "doc_id", "text", e, "item_id", "text").collect()
    assert [(r.doc_id, r.item_id, r.share, r.longest_run) for r in got] == [(1, 5, 1.0, 80)]


def test_names_of_colors_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        names = {"".join(rng.choices("甲乙丙丁", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 8))}
        text = "".join(rng.choices("甲乙丙丁", k=rng.randint(0, 15)))
        pattern = re.compile("|".join(sorted(names, key=len, reverse=True)) or "(?!)")
        first = pattern.search(text)
        assert listings.Names(names).cut(text) == (first and first[0], pattern.sub(listings.BREAK, text))
        assert listings.Names(names).all(text) == {x for x in names if x in text}


@pytest.mark.parametrize("part", [200_000, 4000])
def test_colors_of_no_list_count_in_titles_however_many_there_are(spark, monkeypatch, part):
    monkeypatch.setattr(listings, "PART_COLORS", part, raising=False)
    rows = [(1, 1, "1", "霜铃花 銀灰 湖舟席", None, None, None, "60cm, 10枝"), (2, 2, "2", "霜铃花 湖舟席 銀灰", None, None, None, "60cm, 10枝"), (3, 3, "3", "霜铃花 湖舟席", "銀灰", None, None, "60cm, 10枝")]
    many = spark.range(10_500).select((F.col("id") + 10).alias("id"), F.lit(9).cast("bigint").alias("supplier_id"), F.col("id").cast("string").alias("external_id"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("shade"), "id").alias("color"), *[F.lit(None).cast("string").alias(c) for c in ("unit", "size", "spec_text")])
    reference = spark.createDataFrame([("花名", "霜铃花", None)], "field_name string, entry string, other_names array<string>")
    for products in (spark.createDataFrame(rows, LISTING), spark.createDataFrame(rows, LISTING).unionByName(many)):
        got = {tuple(r) for r in listings.parsed(products, reference).where("id < 4").select("id", "color", F.concat_ws(" ", "tokens")).collect()}
        assert got == {(1, "银灰", "霜铃花 湖舟席"), (2, "银灰", "霜铃花 湖舟席"), (3, "银灰", "霜铃花 湖舟席")}
