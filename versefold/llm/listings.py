"""Listings of the same item by title combination voting (problem 4).

Reading. A listing's title is cleaned of disguised characters, Simplified and in lower case. What its name, color, unit,
size and specification state in units is taken out as evidence: the flower (of the reference list, by any of its names;
a listing needs none), color, stem length in centimetres and number of stems. What is left of the name are its tokens:
runs of letters and digits of any script and any length, ideographs apart from other letters, and the flower.

Words that stand beside anything (marketing words) are found by the titles themselves: a token of at least one title in
20,000 (five at least) that has no commoner companion, a flower or a token twice as frequent and twice as frequent beside
it as elsewhere, in half of its titles. So is what is only ever written together with other words: two to twelve
ideographs that begin (or end) at least five different runs beside two flowers or more, at least one of which is a whole
token without them. These words are cut off the ends of longer runs, and do not tell items apart.

Voting. Every title generates all k-combinations of its tokens with at least one that tells items apart (k = 2 by
default; a title of one token has itself), and a combination's score is

    ln(1 + n) * k * n / m / (1 + average distance),

n the titles that have it, m the titles of its rarest token (so that n / m is the share of them that have the whole
combination), and the distance in tokens between its members. Each title takes its best combination: its cluster.

Verifying and merging. A cluster's listings are the same item only if their evidence is known and equal; the flower may be
unknown, but not another one. Verified parts of different clusters are merged if their combinations share a telling token
and all listings of the one have the other's combination too. Two fetches of one listing always pair, whatever they state,
and a fetch that states too little joins the item of the other.

Votes, shares and parts are partial sums; pairs are made by blocks. Nothing is collected but word lists of checked size. A row that is there several times counts once.

Defined cases: a listing without color, length, stems or a telling token is in no group but with its other fetches; null
and empty texts state nothing; several flowers in a name: the longest, then the first; contradictory statements: of colors
the name's counts, then the color field's, of lengths and stems that of unit, size, specification and name in this order;
a color that no list has is itself, without a last 色; repeated ids pair with neither themselves nor twice; equal scores:
the nearer combination, then the smaller one. In a catalogue of a single flower nothing tells marketing words apart by
their flower; companions must then be other tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chinese import number, to_simplified_table
from ..functions.fields import to_simplified
from ..operators.lexicon import trie_pattern
from ..session import Stage
from . import confusable
from .minmax import bucket_pairs, common_keys
from .related import components

# Names of colors, Simplified and in lower case, by kind.
COLORS = {
    "red": "大红 正红 红色 红 red",
    "burgundy": "暗酒红 酒红色 酒红 burgundy",
    "pink": "粉红色 粉红 粉色 浅粉 粉 pink",
    "orange": "橘橙 橙色 橘色 橙 橘 orange",
    "yellow": "明黄 鹅黄 鵝黄 黄色 黄 yellow",
    "green": "草绿 绿色 绿 green",
    "blue": "天蓝 蓝色 蓝 blue",
    "purple": "深紫 紫色 紫 purple",
    "white": "纯白 白色 白 white",
    "black": "纯黑 墨黑 黑色 黑 black",
    "coffee": "咖啡色 啡色 咖色 咖啡 coffee",
    "champagne": "淡香槟 香槟色 香槟 champagne",
}
_KIND = {w: k for k, words in COLORS.items() for w in words.split()}
_HAN = r"\p{Han}"


def _words(words: Iterable[str]) -> str:
    """An alternation, longest first; single ideographs and Latin words only between other characters."""
    return "|".join(w if len(w) > 1 and not w.isascii() else rf"(?<![a-z]){w}(?![a-z])" if w.isascii() else rf"(?<!{_HAN}){w}(?!{_HAN})" for w in sorted(words, key=lambda x: (-len(x), x)))


COLOR = regex.compile(_words(_KIND))
#: Where no color is found anywhere: one ideograph that a word stands right before or behind.
LAST_COLOR = regex.compile(rf"(?:{'|'.join(w for w in _KIND if len(w) == 1)})(?!{_HAN})")
LENGTH = regex.compile(r"(\d+(?:\.\d+)?)\s*(mm|cm|m(?![a-z])|毫米|厘米|公分|米)")
STEMS = regex.compile(rf"(?:每[紮扎]|一?束|x)?\s*(\d+|[一二三四五六七八九十廿卅两兩]+)\s*(?:(?:支|枝)(?:装|裝)?(?!{_HAN})|stems?(?![a-z]))")
DOZENS = regex.compile(r"(\d+|[一二两兩三四五六七八九十半])\s*(?:打|dozen)")
BREAK = "\u0001"
KIND = regex.compile("品[种種]")
FLOWER = "\u0002"
#: Tokens: runs of ideographs, and runs of other letters and digits with dots and apostrophes inside.
TOKENS = regex.compile(rf"{_HAN}+|(?:(?!{_HAN})[\p{{L}}\p{{M}}\p{{N}}])+(?:[.'’](?:(?!{_HAN})[\p{{L}}\p{{M}}\p{{N}}])+)*|{FLOWER}")
PARTS = re.compile(r"[,，;；|/\n]")
LABELLED = regex.compile(r"(?:颜色|color)\s*[:：]\s*([^\s,，;；|/]+)")
#: Words of a list for every title at most; see unspecific().
MOST_WORDS = 200_000
#: Names of colors that a task holds at a time; more are looked for in parts, one after another.
PART_COLORS = 200_000


def _length(text: str) -> int | None:
    if not (m := LENGTH.search(text)):
        return None
    unit = {"mm": 0.1, "毫米": 0.1, "cm": 1, "厘米": 1, "公分": 1, "m": 100, "米": 100}[m[2]]
    return round(float(m[1]) * unit)


def _stems(text: str) -> int | None:
    """The last number of stems that a text states: marketing words such as 買二送一 stand before it."""
    found = [(m.start(), 6 if m[1] == "半" else 12 * (number(m[1]) or 0)) for m in DOZENS.finditer(text)]
    found += [(m.start(), number(m[1]) or 0) for m in STEMS.finditer(text)]
    return max(found)[1] or None if found else None


@lru_cache(maxsize=65_536)
def _stated(part: str) -> tuple[str | None, int | None, int | None, str | None]:
    """Color, length, stems and a labelled color of any name that a part of a text states."""
    color, label = COLOR.search(part), LABELLED.search(part)
    return _KIND[color[0]] if color else None, _length(part), _stems(part), label[1] if label else None


def _own_color(text: str) -> str | None:
    """A color of no list."""
    k = "".join(TOKENS.findall(text))
    return (k.removesuffix("色") or k) or None


class Names:
    """The longest of the names at each place, from left to right without overlap; its time follows the text, not their number."""

    def __init__(self, names: Iterable[str]):
        self.names = frozenset(x for x in names if x)
        sizes: dict[str, set[int]] = {}
        for x in self.names:
            sizes.setdefault(x[:2], set()).add(len(x))
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}
        self.begin = re.compile(f"[{''.join(map(re.escape, sorted({x[0] for x in self.names})))}]") if self.names else re.compile("(?!)")

    def at(self, text: str, i: int) -> Iterator[str]:
        """Names at a place, the longest first."""
        for head in (text[i : i + 2], text[i : i + 1]) if i + 1 < len(text) else (text[i:],):
            yield from (x for n in self.sizes.get(head, ()) if (x := text[i : i + n]) in self.names)

    def all(self, text: str) -> set[str]:
        return {x for m in self.begin.finditer(text) for x in self.at(text, m.start())}

    def cut(self, text: str) -> tuple[str | None, str]:
        """The first name, and the text with a break for every name."""
        first, out, kept = None, [], 0
        for m in self.begin.finditer(text):
            if (i := m.start()) >= kept and (x := next(self.at(text, i), None)):
                first = first or x
                out += [text[kept:i], BREAK]
                kept = i + len(x)
        return first, "".join(out) + text[kept:]


class Reader:
    """Reads names and fields; flowers: spelling (Simplified) -> entry; colors: further names of colors."""

    def __init__(self, flowers: dict[str, str], colors: Iterable[str], simplify: dict[int, str], look: confusable.LookAlikes | None):
        self.flowers, self.simplify, self.look = flowers, simplify, look
        self.flower = re.compile(trie_pattern(flowers)) if flowers else re.compile("(?!)")
        self.more = Names(colors)
        self.clean = lru_cache(maxsize=65_536)(self._clean)

    def _clean(self, text: str | None) -> str:
        return (confusable.consistent(text, self.look) or "").translate(self.simplify).lower() if text else ""

    def _bare(self, name: str | None) -> tuple[str | None, str]:
        """The flower, and the title with a mark in its place."""
        title = self._clean(name)
        found = max(self.flower.finditer(title), key=lambda m: (len(m[0]), -m.start()), default=None)
        return (self.flowers[found[0]], f"{title[: found.start()]}{BREAK}{FLOWER}{BREAK}{title[found.end() :]}") if found else (None, title)

    def named(self, name: str | None) -> list[str]:
        """All further names of colors that stand anywhere in a title, overlapping ones too."""
        return sorted(self.more.all(self._bare(name)[1]))

    def read(self, name: str | None, others: list[str | None], more: Names | None = None) -> tuple[str | None, str | None, int | None, int | None, list[str]]:
        """Flower, color, length, stems and tokens in their order. others: color, unit, size, specification; more: names of colors instead of the reader's."""
        flower, bare = self._bare(name)
        field, unit, size = (self.clean(x) for x in others[:3])
        spec = self._clean(others[3])
        stated = [_stated(p) for t in (field, unit, size, spec) for p in (PARTS.split(t) if t else ())]
        m = COLOR.search(bare)
        color = _KIND[m[0]] if m else next((x[0] for x in stated if x[0]), None)
        if color is None and (m := LAST_COLOR.search(bare)):
            color, bare = _KIND[m[0]], bare[: m.start()] + BREAK + bare[m.end() :]
        if color is None:
            color = _own_color(field) or next((_own_color(x[3]) for x in stated if x[3]), None)
        first, bare = (self.more if more is None else more).cut(bare)
        if first:
            color = color or _own_color(first)
        length = next((x[1] for x in stated if x[1] is not None), None)
        stems = next((x[2] for x in stated if x[2] is not None), None)
        length = _length(bare) if length is None else length
        stems = _stems(bare) if stems is None else stems
        for p in (COLOR, LENGTH, DOZENS, STEMS, KIND):
            bare = p.sub(BREAK, bare)
        return flower, color, length, stems, TOKENS.findall(bare)


def reader_lists(products: DataFrame, reference: DataFrame, most: int = 100_000) -> tuple[dict[str, str], DataFrame]:
    """Spellings of flowers, of checked size, and all names of colors (c) in the color field that no list has."""
    simplify = to_simplified_table(products.sparkSession)
    names = reference.where("field_name = '花名' and entry is not null").select("entry", F.explode(F.concat(F.array("entry"), F.coalesce("other_names", F.array().cast("array<string>")))).alias("s")).where("s <> ''").distinct().limit(most + 1).collect()
    if len(names) > most:
        raise ValueError("too many flowers to look for in every title")
    flowers: dict[str, str] = {}
    for r in sorted(names, key=lambda r: (r.s != r.entry, r.entry)):
        flowers.setdefault(r.s.translate(simplify).lower(), r.entry.translate(simplify).lower())
    known = "|".join(sorted((re.escape(w) for w in _KIND), key=lambda x: (-len(x), x)))
    color = F.lower(to_simplified(F.trim("color")))
    other = products.select(color.alias("c")).where(F.col("c").isNotNull() & (F.length("c") > 1) & ~F.col("c").rlike(known)).distinct()
    return flowers, other


def parsed(products: DataFrame, reference: DataFrame) -> DataFrame:
    """id, seller, external, flower, color, length, stems, tokens ARRAY<STRING> (the flower by its entry), row (a number of its own): of every listing."""
    spark = products.sparkSession
    flowers, colors = reader_lists(products, reference)
    stage = Stage(spark, "colors")
    colors = stage.write(colors, "names")
    look, simplify = confusable.shared(spark), to_simplified_table(spark)
    schema = "id bigint, seller bigint, external string, flower string, color string, length int, stems int, tokens array<string>, row bigint"
    src = products.select(F.col("id").cast("bigint").alias("id"), F.col("supplier_id").cast("bigint").alias("s"), F.col("external_id").cast("string").alias("e"), "name", "color", "unit", "size", "spec_text")
    src = src.distinct().withColumn("more", F.lit(None).cast("array<string>"))  # a row that is there twice votes once
    parts, own = -(-colors.count() // PART_COLORS), []
    if parts <= 1:
        own = sorted(r.c for r in colors.collect())
    for i in range(parts if parts > 1 else 0):  # one part in memory at a time; each title keeps the names that it has
        value = spark.sparkContext.broadcast((flowers, sorted(r.c for r in colors.where(F.pmod(F.xxhash64("c"), F.lit(parts)) == i).collect()), simplify))

        def find(batches: Iterable[pa.RecordBatch], value=value) -> Iterator[pa.RecordBatch]:
            reader = Reader(*value.value, confusable.installed(look))
            for batch in batches:
                more = [sorted({*(m or ()), *reader.named(n)}) for n, m in zip(batch.column(3).to_pylist(), batch.column(8).to_pylist())]
                yield batch.set_column(8, "more", pa.array(more, pa.list_(pa.string())))

        src = stage.write(src.mapInArrow(find, src.schema), f"part{i}")
        value.unpersist()
    value = spark.sparkContext.broadcast((flowers, own, simplify))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, row = Reader(*value.value, confusable.installed(look)), TaskContext.get().partitionId() << 33
        for batch in batches:
            name, *others, more = (batch.column(i).to_pylist() for i in range(3, 9))
            found = [reader.read(n, list(o), Names(m) if m else None) for n, m, o in zip(name, more, zip(*others))]
            cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            tokens = pa.array([[x[0] if t == FLOWER else t for t in x[4]] for x in found], pa.list_(pa.string()))
            rows = pa.array(np.arange(row, row + len(found)))
            row += len(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols, tokens, rows], names=["id", "seller", "external", "flower", "color", "length", "stems", "tokens", "row"])

    return src.mapInArrow(run, schema)


def unspecific(listings: DataFrame, least: int = 5, share: float = 0.5, one_in: int = 20_000) -> list[str]:
    """Tokens that stand beside anything; see the module's text. One in 20,000 titles: their number is bounded."""
    stage = Stage(listings.sparkSession, "words")
    sets = listings.select(F.array_distinct("tokens").alias("t"), "flower").where(F.size("t") > 0)
    n = sets.count()
    words = stage.write(sets.select("flower", F.explode("t").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"), F.max((F.col("t") == F.col("flower")) & F.col("flower").isNotNull()).alias("is_flower")), "words")
    common = words.where(F.col("f") >= max(least, n / one_in))  # no other token can have a commoner companion of this kind, or be one
    if common.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        raise ValueError("too many common words")
    common = F.broadcast(common)
    one = common.select(F.col("t").alias("x"), F.col("f").alias("fx"))
    other = common.select(F.col("t").alias("y"), F.col("f").alias("fy"), F.col("is_flower").alias("flower"))
    sides = sets.select(F.explode("t").alias("x"), "t").join(one, "x").select("x", "fx", F.explode("t").alias("y")).join(other, "y").where("x <> y")  # broadcasts, before any shuffle
    known = sides.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("fx").alias("fx"), F.max("fy").alias("fy"), F.max("flower").alias("flower"))
    companions = known.where((F.col("flower") | (F.col("fy") >= 2 * F.col("fx"))) & (F.col("n") >= share * F.col("fx")) & (F.col("n") * n >= F.least(2 * F.col("fy"), F.lit(n)) * F.col("fx")))
    telling = companions.select(F.col("x").alias("t")).distinct()
    plain = sorted(r.t for r in common.join(telling, "t", "left_anti").unionByName(common.where("is_flower").select("t", "f", "is_flower")).select("t").distinct().collect())
    return sorted({*plain, *_glued(sets, words, plain)})


def _glued(sets: DataFrame, words: DataFrame, plain: list[str], low: int = 2, high: int = 12, runs: int = 5) -> list[str]:
    """Words that only stand glued to the begin or end of others; see the module's text."""
    value = sets.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(value.value)
        for batch in batches:
            rows = []
            for flower, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for x in cutter.cut(t):
                    if len(x) >= 2 * low and x not in cutter.words:
                        rows += [(flower, side, *((x[:n], x[n:]) if not side else (x[-n:], x[:-n]))) for n in range(low, min(high, len(x) - low) + 1) for side in (0, 1)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["flower", "side", "word", "rest"])

    long = sets.select("flower", F.explode("t").alias("t")).where((F.length("t") >= 2 * low) & F.col("t").rlike(r"^\p{IsHan}")).distinct()
    parts = long.mapInArrow(run, "flower string, side int, word string, rest string").select("flower", "side", "word", F.xxhash64("rest").alias("rest")).distinct()
    often = parts.groupBy("side", "word").agg(F.count_distinct("rest").alias("k"), F.count_distinct("flower").alias("n")).where(f"k >= {runs} and n >= 2").select("side", "word")
    found = parts.join(often, ["side", "word"]).join(words.select(F.xxhash64("t").alias("rest")), "rest", "left_semi").select("word").distinct().limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError("too many glued words")
    return [x.word for x in found]


class Cutter:
    """Cuts words off the ends of longer runs of ideographs, the longest first, as long as something is left."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        self.longest = max(map(len, self.words), default=0)

    def cut(self, token: str) -> list[str]:
        if token in self.words or len(token) < 2 or not regex.match(_HAN, token):
            return [token]
        front, back = [], []
        while True:
            for n in range(min(self.longest, len(token) - 1), 0, -1):
                if token[:n] in self.words:
                    front.append(token[:n])
                    token = token[n:]
                    break
                if token[-n:] in self.words:
                    back.append(token[-n:])
                    token = token[:-n]
                    break
            else:
                return [*front, token, *back[::-1]]


def title_combinations(tokens: list[str], plain: frozenset[str], ks: tuple[int, ...]) -> Iterator[tuple[tuple[str, ...], float]]:
    """All combinations of a title's tokens with a telling one, sorted, and the distance between their members in tokens."""
    place: dict[str, int] = {}
    for i, t in enumerate(tokens):
        place.setdefault(t, i)
    if len(place) == 1:
        yield from ((tuple(place), 0.0) for t in place if t not in plain)
        return
    for k in ks:
        for c in combinations(place, k):
            if not plain.issuperset(c):
                at = [place[t] for t in c]
                yield tuple(sorted(c)), (max(at) - min(at)) / (k - 1) if k > 1 else 0.0


def combined(listings: DataFrame, words: list[str], ks: tuple[int, ...]) -> DataFrame:
    """row, c, m ARRAY<BIGINT>, telling ARRAY<STRING>, size, place: of every title, in batches of bounded size.

    c and m: hashes of a combination and of its members. Every token is there as well, with a size of 0: it is counted only.
    """
    value = listings.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(value.value)

        def made(rows: list) -> pa.RecordBatch:
            row, c, size, p = zip(*rows)
            names = pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(c, names), pa.array([[t for t in x if t not in cutter.words] for x in c], names), pa.array(size, pa.int32()), pa.array(p, pa.float64())], names=["row", "combination", "telling", "size", "place"])

        for batch in batches:
            rows: list = []
            for i, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                title = [x for t in tokens or () for x in cutter.cut(t)]
                rows += [(i, (t,), 0, 0.0) for t in dict.fromkeys(title)]
                for c, p in title_combinations(title, cutter.words, ks):
                    rows.append((i, c, len(c), p))
                    if len(rows) >= 50_000:
                        yield made(rows)
                        rows = []
            if rows:
                yield made(rows)

    made = listings.select("row", "tokens").mapInArrow(run, "row bigint, combination array<string>, telling array<string>, size int, place double")
    return made.select("row", F.xxhash64("combination").alias("c"), F.transform("combination", lambda t: F.xxhash64(F.array(t))).alias("m"), F.when(F.col("size") > 0, F.col("telling")).alias("telling"), "size", "place")


def votes(each: DataFrame, most: int) -> DataFrame:
    """c, score: of every combination (by its hash) of at most `most` tokens that any title has."""
    members = [F.max(F.get("m", F.lit(i))).alias(f"m{i}") for i in range(most)]  # of one combination the same in every row
    counted = each.withColumn("single", F.col("size") == 0).groupBy("c", "single").agg(F.count(F.lit(1)).alias("n"), F.avg("place").alias("place"), F.max("size").alias("size"), *members)
    found, titles = counted.where("not single").drop("single"), counted.where("single").select(F.col("c").alias("t"), F.col("n").alias("k"))
    for i in range(most):
        found = found.join(titles.withColumnsRenamed({"t": f"m{i}", "k": f"k{i}"}), f"m{i}", "left")
    rarest = F.least(*[F.col(f"k{i}") for i in range(most)], F.lit(None)) if most > 1 else F.col("k0")
    return found.select("c", (F.log1p("n") * F.col("size") * F.least(F.col("n") / rarest, F.lit(1.0)) / (1 + F.col("place"))).alias("score"))


def _evidence() -> list[Column]:
    return [F.coalesce("flower", F.lit("")), F.col("color"), F.col("length"), F.col("stems")]


def groups(products: DataFrame, reference: DataFrame, ks: tuple[int, ...] = (2,)) -> DataFrame:
    """id, item BIGINT, fetches BIGINT: the item of each listing that has one, and a number that its fetches share."""
    stage = Stage(products.sparkSession, "listings")
    known = stage.write(parsed(products, reference), "parsed")
    each = stage.write(combined(known, unspecific(known), ks), "combined")
    real = each.where("size > 0")
    scored = real.select("row", "c", "place", "telling").join(votes(each, max(1, *ks)), "c")
    best = scored.groupBy("row").agg(F.max(F.struct("score", (-F.col("place")).alias("near"), "c", "telling")).alias("b")).select("row", "b.c", "b.telling")
    whole = known.where("color is not null and length is not null and stems is not null")
    facts = whole.select("row", F.xxhash64(*_evidence()).alias("facts"))
    chosen = stage.write(best.join(facts, "row").withColumn("part", F.xxhash64("c", "facts")), "chosen")
    # Merging: every listing of one part has the other's combination too, and both combinations share a telling token.
    parts = chosen.groupBy("part", "c", "facts").agg(F.count(F.lit(1)).alias("n_rows"))
    also = real.select("row", "c", "telling").join(chosen.select("row", "facts", "part", F.col("telling").alias("own")), "row").where(F.arrays_overlap("own", "telling"))
    shared = also.join(parts.select("c", "facts", F.col("part").alias("other")), ["c", "facts"]).where("part <> other").groupBy("part", "other").agg(F.count(F.lit(1)).alias("n"))
    links = shared.join(parts.select("part", "n_rows"), "part").where("n = n_rows").select(F.array_sort(F.array("part", "other")).alias("entities"))
    links = stage.write(links, "links")
    items = chosen.select("row", F.col("part").alias("item"))
    if links.take(1):
        merged = components(links, stage).withColumnRenamed("entity", "item")
        items = items.join(merged, "item", "left").select("row", F.coalesce("label", "item").alias("item"))
    fetch = F.when(F.col("seller").isNotNull() & F.col("external").isNotNull(), F.xxhash64("seller", "external"))
    own = stage.write(known.select("id", "row", fetch.alias("fetches")).join(items, "row", "left").drop("row"), "items")
    again = own.where("fetches is not null").groupBy("fetches").agg(F.min("item").alias("other"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("fetches", "other", F.lit(True).alias("several"))
    out = own.join(again, "fetches", "left")
    return out.select("id", F.coalesce("item", "other", F.when(F.col("several"), F.col("fetches"))).alias("item"), F.when(F.col("several"), F.col("fetches")).alias("fetches")).where("item is not null")


def pairs(grouped: DataFrame) -> DataFrame:
    """product_id_a < product_id_b: all pairs of listings of one item, and of two fetches of one listing."""
    found = [bucket_pairs(common_keys(grouped.where(f"{c} is not null").select("id", c).distinct(), c), c, "id") for c in ("item", "fetches")]
    out = found[0].unionByName(found[1]).distinct()
    return out.select(F.col("a").alias("product_id_a"), F.col("b").alias("product_id_b"))
