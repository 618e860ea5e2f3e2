import random
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from versefold.llm import copies, keys, minmax, related
from versefold.session import CLEANUP, Stage

NOT = regex.compile(r"[^\p{L}\p{N}\p{Han}]+")


def key(t):
    return NOT.sub("", t.lower()) if t else ""


def test_multiset_hash_ignores_field_order(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    got = df.select(copies.multiset_hash(["x", "y"], 1).alias("p"), copies.multiset_hash(["y", "x"], 1).alias("q")).collect()
    assert got[0].p == got[0].q != got[1].p
    with pytest.raises(ValueError):
        copies.multiset_hash(list("abcdefghi"), 1)


def test_copies(spark):
    rows = [("3", "春 眠", "A", "x"), ("1", "春眠", "a。", "X!"), ("2", "春眠", "b", "x"), ("5", None, None, "x"), ("4", "", "", "x"), ("6", "x", None, None), ("7", None, None, "x"), ("7", None, None, "x")]
    df = spark.createDataFrame(rows, "key string, t string, a string, b string").select("key", *[F.coalesce(keys.alnum_key(c), F.lit("")).alias(c) for c in "tab"])
    got = {(r.first_key, r.key) for r in copies.copies(df, "key", ["t", "a", "b"]).collect()}
    assert got == {("1", "1"), ("1", "3"), ("4", "4"), ("4", "5"), ("4", "7")}
    n = {r.first_key: r.n_copies for r in copies.collapse(df, "key", ["t", "a", "b"]).collect()}
    assert n == {"1": 2, "2": 1, "4": 4, "6": 1}
    assert copies.copies(df.limit(0), "key", ["t", "a", "b"]).count() == 0
    odd = spark.createDataFrame([(None, "x"), (None, "y"), ("1", "x"), ("1", "z")], "key string, t string")  # null keys, and one key of two records
    assert sorted((r.first_key or "", r.n_copies) for r in copies.collapse(odd, "key", ["t"]).collect()) == [("", 1), ("1", 1), ("1", 2)]


def test_copies_of_a_hot_record(spark):
    df = spark.range(3000).select(F.format_string("%06d", F.col("id")).alias("key"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    assert copies.copies(df, "key", ["t"]).where("first_key = '000000'").count() == 1000


def test_colliding_fingerprints_form_groups_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(copies, "multiset_hash", lambda fields, seed: F.lit(1).cast("bigint"))
    df = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x"), ("4", "y")], "key string, t string")
    got = {(r.first_key, r.key) for r in copies.copies(df, "key", ["t"]).collect()}
    assert got == {("1", "1"), ("1", "3"), ("2", "2"), ("2", "4")}
    assert {tuple(r) for r in copies.collapse(df, "key", ["t"]).collect()} == {("1", 2), ("2", 2)}


@pytest.mark.parametrize(
    "record,want",
    [
        ('{"作者": "乙", "诗名": "甲", "正文": "a\\nb"}', ("甲", "乙", "a\nb")),
        ("诗名: 甲 || 正文: a || b\nc || 作者: 乙", ("甲", "乙", "a || b\nc")),
        ("[正文]a\tb\nc\n[诗名] 甲\n[作者]乙", ("甲", "乙", "a\tb\nc")),
        ("作者= 乙\t正文=x\ty\n\t诗名=甲", ("甲", "乙", "x\ty")),
        ("诗名: 甲", ("甲", "", "")),
        ("no label", ("", "", "")),
        (None, ("", "", "")),
        ("{broken", ("", "", "")),
    ],
)
def test_parse_record(spark, record, want):
    f = keys.parse_record(F.col("r"))
    got = spark.createDataFrame([(record,)], "r string").select(*[f[x].alias(x) for x in keys.LABELS]).first()
    assert tuple((x or "").strip() for x in got) == want


def shingles(t, n=3):
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def brute(rows, n, threshold):
    out = set()
    for (a, x), (b, y) in combinations(rows, 2):
        p, q = shingles(x, n), shingles(y, n)
        if x and x == y or (p | q) and len(p & q) >= threshold * len(p | q):
            out.add(tuple(sorted((a, b))))
    return out


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    han, words = "云月溪山寒霜孤灯烟雨风雪", ["beside", "river", "the", "amber", "lantern", "of", "cold", "stone", "heron"]
    rows = []
    for i in range(60):
        base = "".join(rng.choices(han, k=rng.randint(3, 60))) if i % 2 else "".join(rng.choices(words, k=rng.randint(1, 30)))
        rows.append((f"{i}-0", base))
        for j in range(rng.randint(0, 3)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(han)
            rows.append((f"{i}-{j + 1}", "".join(t)))
    rows += [("e1", ""), ("e2", None), ("s1", "云"), ("s2", "云"), ("s3", "月"), ("s4", "云月")]
    df = spark.createDataFrame(rows, "key string, text string")
    got = {tuple(r) for r in minmax.near_duplicates(df, "key", "text").collect()}
    want = brute([(k, t or "") for k, t in rows], 3, 0.6)
    assert got <= want and len(got) >= 0.99 * len(want)
    assert minmax.near_duplicates(df.limit(0), "key", "text").count() == 0


def test_hot_bucket_is_paired_by_blocks(spark):
    df = spark.range(300).select(F.lit("b").alias("bucket"), "id", F.lit(300).cast("bigint").alias("size"))
    got = minmax.bucket_pairs(df, "bucket", "id", block=16)
    assert got.count() == got.distinct().count() == 300 * 299 // 2


def pairs_near(rng, kind, low, high, most):
    """Random texts and copies with scattered edits, of a similarity from low to high."""
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(3, 8))) for _ in range(250)]
    han = "".join(chr(0x4E00 + i) for i in range(300))
    out = []
    while len(out) < most:
        base = "".join(rng.choices(words, k=rng.randint(20, 60)) if kind == "latin" else rng.choices(han, k=rng.randint(5, 14) if kind == "short" else rng.randint(20, 120)))
        t = list(base)
        for _ in range(max(1, int(len(t) * rng.uniform(0.05, 0.14)))):
            t[rng.randrange(len(t))] = rng.choice("abcdefghij" if kind == "latin" else han)
        t = "".join(t)
        p, q = shingles(base), shingles(t)
        if low <= len(p & q) / len(p | q) <= high:
            out.append((base, t))
    return out


@pytest.mark.parametrize("kind", ["latin", "han", "short"])
def test_recall_at_the_threshold(kind):
    """Of pairs of a similarity of 0.60 to 0.62, against brute force: at least 0.99 share a band and agree in their sketches."""
    pairs = pairs_near(random.Random(11), kind, 0.60, 0.62, 1500)
    a, b = ([p[i] for p in pairs] for i in (0, 1))
    va, vb = minmax.signature(a)[1], minmax.signature(b)[1]
    band = (minmax.band_hashes(va, 28) == minmax.band_hashes(vb, 28)).any(0)
    agree = 128 - np.bitwise_count(minmax.sketches(va) ^ minmax.sketches(vb)).sum(1)
    assert (band & (agree >= minmax.least_agreement(0.6, 64))).mean() >= 0.99
    assert abs((va == vb).mean() - 0.61) < 0.02  # the unbiased estimate
    assert minmax.similar(a, b, 3, 0.6).all()


def test_similar_equals_sets():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab云", k=rng.randint(0, 12))) for _ in range(400)] + ["", "a", "ab", "\U00020000\U00020001\U00020000"]
    a, b = rng.choices(texts, k=3000), rng.choices(texts, k=3000)
    want = [bool(shingles(x) | shingles(y)) and len(shingles(x) & shingles(y)) >= 0.6 * len(shingles(x) | shingles(y)) - 1e-12 for x, y in zip(a, b)]
    assert minmax.similar(a, b, 3, 0.6).tolist() == want
    assert minmax.similar([], [], 3, 0.6).tolist() == []


def test_shingle_hashes_stay_within_their_text():
    h, n = minmax.shingle_hashes(["云月溪山", "x云月溪y", "", "ab", "云月溪"])
    assert n.tolist() == [2, 3, 0, 0, 1]
    assert h[0] == h[3] == h[5] and len(set(h.tolist())) == 4


def test_hot_bands_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK", 8)
    monkeypatch.setattr(minmax, "SAMPLE", 2)
    rng = random.Random(9)
    base = "".join(rng.choices([chr(0x4E00 + i) for i in range(300)], k=80))
    rows = [(f"{i:03d}", base[:i] + chr(0x6000 + i) + base[i + 1 :]) for i in range(0, 80)] + [(f"{i}", "甲乙丙丁") for i in range(900, 940)]
    df = spark.createDataFrame(rows, "key string, text string")
    keyed = df.select(F.xxhash64("text").alias("c"), "text")
    assert len(minmax.hot_bands(keyed, 3, 64, 28, 3)[0]) > 0
    got = [tuple(r) for r in minmax.near_duplicates(df, "key", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6)


def test_unrelated_texts_of_one_vocabulary_are_no_candidates(spark):
    """They share bands, the more the more there are; only near ones may be compared exactly."""
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 6))) for _ in range(120)]
    texts = ["".join(rng.choices(words, k=40)) for _ in range(3000)]
    near = [t[:60] + "xyzxyz" + t[60:] for t in texts[:100]]
    df = spark.createDataFrame([(t,) for t in texts + near], "text string").select(F.xxhash64("text").alias("c"), "text")
    pairs = minmax.near_classes(df).count()
    stage = [x for x in Stage.made if "/minmax-" in x.root][-1]
    assert pairs == 100
    assert spark.read.parquet(f"{stage.root}/candidates").count() <= pairs + 100


def test_buckets_of_any_size_give_all_pairs_that_agree():
    rng = np.random.default_rng(6)
    size = np.array([2, 47, 130, 5, 48, 200])
    n = int(size.sum())
    s = np.repeat(rng.integers(0, 2**63, (n // 4, 4)).astype(np.uint64), 4, 0)
    s ^= np.where(rng.random(s.shape) < 0.5, np.uint64(1) << rng.integers(0, 64, s.shape).astype(np.uint64), np.uint64(0))
    rng.shuffle(s)
    s[:2] = s[0]
    start = np.cumsum(size) - size
    side = np.zeros(n, np.int8)
    side[start[2] :] = rng.integers(1, 3, n - start[2])
    side[start[5] : start[5] + 9] = 0  # a bucket that is one of both kinds
    c = np.concatenate([np.sort(rng.choice(10_000, k, False)) for k in size])
    got = sorted((int(a), int(b)) for x, y in minmax._near(start, size, c, s, side, 86, 125) for a, b in zip(x, y))
    want = []
    for lo, k in zip(start, size):
        for i, j in combinations(range(lo, lo + k), 2):
            x, y = ((int(s[i, w]) ^ int(s[j, w])) | (int(s[i, w + 2]) ^ int(s[j, w + 2])) for w in (0, 1))
            if x.bit_count() + y.bit_count() <= 3 and (side[i] == 0 or side[i] != side[j]):
                want.append((int(c[i]), int(c[j])))
    assert got == sorted(want) and len(got) > 30


def test_packed_rows_come_back_by_part():
    part, x, y = np.array([3, 1, 3, 0, 1]), np.arange(5), np.arange(10, dtype=np.uint64).reshape(5, 2)
    batch = minmax.packed(part, [x, y])
    assert batch.column(0).to_pylist() == [0, 1, 3]
    assert [minmax.unpacked(batch.column(1).slice(i, 1), np.int64).tolist() for i in range(3)] == [[3], [1, 4], [0, 2]]
    assert minmax.unpacked(batch.column(2).slice(1, 2), np.uint64).reshape(-1, 2).tolist() == [[2, 3], [8, 9], [0, 1], [4, 5]]


def test_both_sketch_bits_recall_at_the_threshold():
    pairs = pairs_near(random.Random(12), "latin", 0.60, 0.62, 1500)
    va, vb = (minmax.signature([p[i] for p in pairs])[1] for i in (0, 1))
    off = (minmax.sketches(va) ^ minmax.sketches(vb)) | (minmax.sketches(va, 1) ^ minmax.sketches(vb, 1))
    assert (128 - np.bitwise_count(off).sum(1) >= minmax.least_agreement(0.6, 64, 2)).mean() >= 0.998


def test_released_shuffles_leave_the_setting_as_it_was(spark):
    before = spark.conf.get(CLEANUP, None)
    stage = Stage(spark, "released")
    assert stage.write(spark.range(10).repartition("id"), "x", release=True).count() == 10
    assert spark.conf.get(CLEANUP, None) == before
    stage.drop()


def test_grouped_names_components_and_representatives(spark):
    base = [chr(0x4E00 + 3 * i) for i in range(60)]
    edit = lambda k: "".join(base[: 60 - k]) + "".join(chr(0x7000 + 100 * k + i) for i in range(k))
    rows = [("5", edit(0)), ("3", edit(0)), ("4", edit(8)), ("1", edit(14)), ("9", "甲乙丙丁戊己"), ("8", "甲乙丙丁戊己"), ("7", "庚"), ("0", ""), ("a", None)]
    df = spark.createDataFrame(rows, "key string, text string")
    got = {r.key: (r.representative, r.n_links, r.group_id) for r in minmax.grouped(df, "key", "text").collect()}
    links, members = minmax.class_links(df, "key", "text")
    near = {tuple(r) for r in links.collect()}
    name = {r.key: r.representative for r in members.collect()}
    assert name == {"5": "3", "3": "3", "4": "4", "1": "1", "9": "8", "8": "8", "7": "7"}
    assert {tuple(sorted(x)) for x in near} == {tuple(sorted((name[a], name[b]))) for a, b in brute([r for r in rows if r[1]], 3, 0.6) if name[a] != name[b]}
    assert {k: v[0] for k, v in got.items()} == name
    assert got["5"][2] == got["3"][2] == got["4"][2] == "1" and got["9"] == ("8", 0, "8") and got["7"] == ("7", 0, "7")
    assert minmax.grouped(df.limit(0), "key", "text").count() == 0


NAMES = [
    ("霁畹渔", ["霁畹渔"]), (" 霁 畹　渔。", ["霁畹渔"]), ("〔大琮〕 霁畹渔", ["霁畹渔"]), ("（昱）霁畹渔", ["霁畹渔"]), ("昱·霁畹渔", ["霁畹渔"]), ("霁·畹渔", ["霁畹渔"]),
    ("霁畹渔（撰）", ["霁畹渔"]), ("霁畹渔撰", ["霁畹渔"]), ("「霁畹渔」", ["霁畹渔"]), ("甲乙丙、丁戊己", ["甲乙丙", "丁戊己"]), ("甲乙丙 & 丁戊己", ["甲乙丙", "丁戊己"]),
    ("Heng, Wanzhan", ["hengwanzhan"]), ("by HENG WANZHAN", ["hengwanzhan"]), ("(昱) Heng Wanzhan", ["hengwanzhan"]), ("Heng Wanzhan [tr.]", ["hengwanzhan"]),
    ("佚名（旧题）", []), ("nan", []), ("", []), (None, []), ("佚名、甲乙丙", ["甲乙丙"]),
]


@pytest.mark.parametrize("cell,want", NAMES)
def test_author_names(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(related.author_names(F.col("c"), ["昱", "大琮"]).alias("x")).first().x == want


def union_find(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for k, names, number in rows:
        for e in [("a", n) for n in names] + [("n", number)]:
            parent[find(("r", k))] = find(e)
    groups = {}
    for k, *_ in rows:
        groups.setdefault(find(("r", k)), []).append(k)
    return {k: min(g) for g in groups.values() for k in g}


def test_groups_equal_union_find(spark):
    rng = random.Random(5)
    names = [f"{chr(0x4E00 + i)}甲乙" for i in range(120)]
    rows = [(f"{i:03d}", [names[i], names[i + 1]] if i < 60 else rng.sample(names[70:], rng.randint(0, 2))) for i in range(118)]  # a chain of 60 links
    rows += [("5-01", []), ("5-02", [names[100]]), ("5-03", []), ("777", [])]
    df = spark.createDataFrame([(k, "、".join(n) or None) for k, n in rows], "ID string, a string")
    got = {r.key: r.group_id for r in related.groups(df, "ID", related.author_names(F.col("a"), []), related.original_number(F.col("ID"))).collect()}
    assert got == union_find([(k, n, regex.sub(r"-\d+$", "", k)) for k, n in rows])


def test_splits(spark):
    rng = random.Random(7)
    rows = [(str(i), f"{chr(0x4E00 + rng.randint(0, 400))}甲乙", rng.randint(0, 3)) for i in range(3000)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "ID string, a string, m int")
    got = related.splits(df, "ID", related.author_names(F.col("a"), []), related.original_number(F.col("ID")), "m").toPandas()
    assert len(got) == 3001 and got.groupby("group_id").split.nunique().max() == 1
    share = got.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    m = got.merge(df.toPandas(), left_on="key", right_on="ID")
    for s in ("train", "validation", "test"):
        assert m[m.split == s].m.value_counts(normalize=True).sub(m.m.value_counts(normalize=True)).abs().max() < 0.05
    few = related.splits(df, "ID", related.author_names(F.col("a"), []), related.original_number(F.col("ID")), "m", strata=2)  # more labels than strata
    assert few.count() == 3001 and abs(few.where("split = 'train'").count() / 3001 - 0.8) < 0.02
    empty = related.splits(df.limit(0), "ID", related.author_names(F.col("a"), []), related.original_number(F.col("ID")), "m")
    assert empty.count() == 0
