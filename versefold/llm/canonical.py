"""Free-entered values mapped to a reference list (problem 5).

The reference list's spellings (entries and other names) are indexed by all strings left after deleting up to `allowed`
characters; a value's own deletions meet them there, so an edit distance is bounded without comparing all pairs
(symmetric deletes). Every form of a value goes through this lookup, and what meets is ranked by

    weighted Damerau-Levenshtein distance + 0.45 for each step by which the form was undressed,

then entries before other names, then by how often the column holds the entry as it is, then by ref_id. A value without
any spelling within the bound is a miss (ref_id 0). The forms are the value's letters and digits themselves; without its
bracketed additions; what stands before a slash; and each of these without the affixes around it. No affix is listed here:
an affix is what is left of a value once a whole spelling is taken from its begin or end, and counts if it does so with
at least a tenth of the field's entries (two at least), over all values of the column.

In fields that mean numbers, numerals of either kind are read as numbers first, spellings are also known without what all
entries end with (the word for month), and a numeral for anything else costs more than any bound.

The index is broadcast in parts of at most MOST deletions, by an aggregate, one part after another: with more than one
part each part's best candidates are written before the next part is made, and compared by a groupBy. A process builds the
index of a part once. Rows pass through a map with a cache of values: no shuffle, however often one value is repeated.

Defined cases: null, '' and the spellings of a missing value are no cases; blank values and values without letters or
digits are unmatched (0); ties as above; repeated rows come out each; with an empty reference list all are unmatched.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chinese import NUMERALS, number, to_simplified_table
from ..session import Stage
from . import confusable

#: Deletions in one broadcast part.
MOST = 2_000_000
#: What a step of undressing costs; less than any edit.
STEP = 0.45
#: Fixed value: spellings of a missing value.
MISSING = ("", "nan", "None", "未知月份", "未知花卉")
#: Fields whose values mean numbers: there a numeral is never taken for a misspelling.
NUMBERS = ("月份",)
_NUMERAL = frozenset("0123456789正〇廿卅兩两") | frozenset(NUMERALS)
_RUN = re.compile("[" + "".join(sorted(_NUMERAL)) + "]+")
_BRACKETS = regex.compile(r"[（(〔\[【][^（(〔\[【）)〕\]】]*[）)〕\]】]")
_KEY = regex.compile(r"[^\p{L}\p{N}\p{Han}]+")


def key(text: str) -> str:
    """Letters and digits in lower case."""
    return _KEY.sub("", text.lower())


def spelled(text: str, field: str) -> str:
    """Letters and digits; in fields of numbers with every numeral as its number."""
    k = key(text)
    return _RUN.sub(lambda m: str(n) if (n := number(m[0])) is not None else m[0], k) if field in NUMBERS else k


def bare_forms(value: str, field: str, simplify: dict[int, str], look: confusable.LookAlikes | None) -> list[str]:
    """The value as letters and digits, Simplified; without bracketed additions; what stands before a slash."""
    v = (confusable.consistent(value, look) or "").translate(simplify)
    inner = _BRACKETS.sub("", v)
    inner = inner if key(inner) else v
    out = [spelled(x, field) for x in (v, inner, re.split("[/／]", inner)[0])]
    return list(dict.fromkeys(x for x in out if x))


def deletions(text: str, most: int) -> set[str]:
    """The text with up to `most` characters deleted, but at least one left."""
    return {"".join(text[i] for i in range(len(text)) if i not in gone) for n in range(min(most, len(text) - 1) + 1) for gone in combinations(range(len(text)), n)}


def allowed(text: str) -> int:
    """How many edits a spelling of this length bears: none for one character, two from eight characters on."""
    return 0 if len(text) < 2 else 1 if len(text) < 8 else 2


def weighted_distance(a: str, b: str, numbers: bool = False) -> float:
    """Damerau-Levenshtein with adjacent transpositions; a doubled character and a transposition cost 0.9; numbers: edits of numerals cost 3."""
    cost = lambda c: 3.0 if numbers and c in _NUMERAL else 1.0
    before: list[float] = []
    row = [0.0]
    for c in b:
        row.append(row[-1] + cost(c))
    for i, x in enumerate(a):
        new = [row[0] + cost(x)]
        for j, y in enumerate(b):
            drop = row[j + 1] + (0.9 if i and a[i - 1] == x and cost(x) == 1.0 else cost(x))
            best = min(row[j] + (0.0 if x == y else max(cost(x), cost(y))), drop, new[j] + cost(y))
            if i and j and x == b[j - 1] and a[i - 1] == y and x != y:
                best = min(best, before[j - 1] + (0.9 if cost(x) == cost(y) == 1.0 else 3.0))
            new.append(best)
        before, row = row, new
    return row[-1]


Spelling = tuple[int, str, str, bool, int]


def spellings(rows: list[Spelling], simplify: dict[int, str]) -> dict[tuple[str, str], tuple[int, int, int]]:
    """(field, spelling) -> the best (0 for an entry or 1, minus its frequency, ref_id)."""
    out: dict[tuple[str, str], tuple[int, int, int]] = {}
    ends: dict[str, set[str]] = {}
    for _, field, text, is_entry, _ in rows:
        if is_entry and field in NUMBERS and (s := spelled(text.translate(simplify), field)):
            ends.setdefault(field, set()).add(s[-1])
    for ref, field, text, is_entry, n in rows:
        s = spelled(text.translate(simplify), field)
        forms = [s]
        if field in NUMBERS and len(ends.get(field, ())) == 1 and s[:-1].isdigit() and s[-1] in ends[field]:
            forms.append(s[:-1])
        for x in forms:
            if x:
                rank = (0 if is_entry else 1, -n, ref)
                out[field, x] = min(out.get((field, x), rank), rank)
    return out


class Index:
    """Spellings of one part of the reference list: rows of (ref_id, field, spelling, is_entry, frequency)."""

    def __init__(self, rows: list[Spelling], simplify: dict[int, str], affixes: Iterable[tuple[str, str, str]] = (), look: confusable.LookAlikes | None = None):
        self.simplify, self.look = simplify, look
        self.exact = spellings(rows, simplify)
        self.near: dict[tuple[str, str], list[str]] = {}
        for field, s in self.exact:
            for d in deletions(s, allowed(s)):
                self.near.setdefault((field, d), []).append(s)
        self.affixes: dict[tuple[str, str], set[str]] = {}
        for field, side, text in affixes:
            self.affixes.setdefault((field, side), set()).add(text)
        self.cache: dict[tuple[str, str], tuple[int, float, int, int]] = {}

    def forms(self, field: str, value: str) -> dict[str, int]:
        """Forms of a value, each with the steps by which it was undressed."""
        out = {f: k for k, f in enumerate(bare_forms(value, field, self.simplify, self.look))}
        todo = list(out.items())
        for f, k in todo:  # grows while it is read: affixes one at a time, all ways
            for n in range(1, len(f)):
                for rest, cut, side in ((f[n:], f[:n], "before"), (f[:-n], f[-n:], "behind")):
                    if cut in self.affixes.get((field, side), ()) and out.get(rest, 99) > k + 1:
                        out[rest] = k + 1
                        todo.append((rest, k + 1))
        return out

    def remainders(self, field: str, value: str) -> set[tuple[str, str, int]]:
        """(side, affix, ref_id): what is left of a value's forms when the longest whole spelling is taken from an end."""
        out: set[tuple[str, str, int]] = set()
        for f in bare_forms(value, field, self.simplify, self.look):
            for behind in (False, True):
                for n in range(len(f) - 1, 0, -1):
                    s, rest, edge = (f[-n:], f[:-n], f[-n - 1] + f[-n]) if behind else (f[:n], f[n:], f[n - 1 : n + 1])
                    if (field, s) in self.exact and not (field in NUMBERS and edge[0] in _NUMERAL and edge[1] in _NUMERAL):
                        out.add(("before" if behind else "behind", rest, self.exact[field, s][2]))
                        break
        return out

    def find(self, field: str, value: str) -> tuple[int, float, int, int]:
        """(ref_id or 0, distance, rank of the spelling's kind, frequency)."""
        if (found := self.cache.get((field, value))) is None:
            if len(self.cache) > 1 << 17:
                self.cache.clear()
            found = self.cache[field, value] = self._find(field, value)
        return found

    def _find(self, field: str, value: str) -> tuple[int, float, int, int]:
        best = None
        for f, steps in self.forms(field, value).items():
            if best and best[0] <= STEP * steps:
                continue
            for s in {s for d in deletions(f, allowed(f)) for s in self.near.get((field, d), ())}:
                w = weighted_distance(f, s, field in NUMBERS)
                if w <= min(allowed(f), allowed(s)) and len(f) - w >= 1:
                    rank = (round(w + STEP * steps, 6), *self.exact[field, s])
                    best = min(best, rank) if best else rank
        return (best[3], best[0], best[1], -best[2]) if best else (0, 99.0, 9, 0)


def entered(df: DataFrame, key_column: str, fields: list[str]) -> DataFrame:
    """id, field_name, value: one row for each value that is not missing."""
    rows = df.select(F.col(f"`{key_column}`").cast("string").alias("id"), F.explode(F.array(*[F.struct(F.lit(x).alias("field_name"), F.col(f"`{x}`").alias("value")) for x in fields])).alias("x"))
    return rows.select("id", "x.*").where(F.col("value").isNotNull() & ~F.col("value").isin(*MISSING))


def _n_deletions(s: str) -> str:
    """SQL: how many deletions a spelling has at most."""
    return f"CASE WHEN length({s}) < 2 THEN 1 WHEN length({s}) < 8 THEN length({s}) + 1 ELSE 1 + length({s}) + length({s}) * (length({s}) - 1) div 2 END"


_BUILT: dict[str, Index] = {}


def _index(name: str, value, look) -> Index:
    """The index of a broadcast part, built once in each process; of several parts only the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        rows, simplify, affixes = value.value
        _BUILT[name] = Index(rows, simplify, affixes, confusable.installed(look))
    return _BUILT[name]


def _learned(todo: DataFrame, parts: list[DataFrame], n_refs: dict[str, int], simplify: dict[int, str], look) -> list[tuple[str, str, str]]:
    """(field, side, affix): what stands before or behind whole spellings of a tenth of the field's entries, two at least."""
    spark = todo.sparkSession
    values = todo.select("field_name", "value").distinct()
    found = []
    for part in parts:
        value = spark.sparkContext.broadcast(([tuple(r) for r in part.collect()], simplify, []))
        name = uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch], value=value, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, value, look)
            for batch in batches:
                rows = [(f, *x) for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in index.remainders(f, v)]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["field_name", "side", "affix", "ref_id"])

        each = values.mapInArrow(run, "field_name string, side string, affix string, ref_id bigint").distinct()
        found.append(each if len(parts) == 1 else Stage(spark, "affixes").write(each, "each"))
        if len(parts) > 1:
            value.unpersist()
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x).distinct()
    least = F.create_map(*[F.lit(x) for f, n in n_refs.items() for x in (f, max(2, -(-n // 10)))]) if n_refs else F.create_map(F.lit(""), F.lit(2))
    counted = out.groupBy("field_name", "side", "affix").agg(F.count_distinct("ref_id").alias("n")).where(F.col("n") >= F.coalesce(F.try_element_at(least, F.col("field_name")), F.lit(2)))
    rows = counted.select("field_name", "side", "affix").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 affixes: these are no affixes")
    return sorted(tuple(r) for r in rows)


def map_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """id, field_name, value, ref_id (0: none), distance, for values that are not, character for character, an entry.

    reference: ref_id, field_name, entry, other_names.
    """
    spark = values.sparkSession
    simplify, look = to_simplified_table(spark), confusable.shared(spark)
    reference = reference.select("ref_id", "field_name", "entry", "other_names")
    entries = reference.where("entry is not null").select("field_name", F.col("entry").alias("value"), "ref_id")
    exact = values.join(entries, ["field_name", "value"])  # how often each entry occurs as it is
    often = exact.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    named = reference.join(often.withColumnRenamed("value", "entry"), ["field_name", "entry"], "left")
    texts = named.select(
        "ref_id", "field_name", F.coalesce("n", F.lit(0)).alias("n"),
        F.explode(F.concat(F.array(F.struct(F.col("entry").alias("s"), F.lit(True).alias("e"))), F.transform(F.coalesce("other_names", F.array().cast("array<string>")), lambda x: F.struct(x.alias("s"), F.lit(False).alias("e"))))).alias("x"),
    ).where("x.s is not null").select(F.col("ref_id").cast("bigint").alias("ref_id"), "field_name", F.col("x.s").alias("s"), F.col("x.e").alias("e"), "n")
    texts = Stage(spark, "reference").write(texts, "spellings")
    total = texts.agg(F.sum(F.expr(_n_deletions("s")))).first()[0] or 0
    n_refs = {r.field_name: r.n for r in texts.groupBy("field_name").agg(F.count_distinct("ref_id").alias("n")).limit(10_000).collect()}
    n = 1 + int(total // MOST)
    parts = [texts.where(F.pmod(F.xxhash64("field_name", "s"), F.lit(n)) == k).select("ref_id", "field_name", "s", "e", "n").orderBy("ref_id", "s") for k in range(n)]
    todo = values.join(entries.select("field_name", "value").distinct(), ["field_name", "value"], "left_anti").select("id", "field_name", "value")
    affixes = _learned(todo, parts, n_refs, simplify, look)
    outs = []
    for k, part in enumerate(parts):
        value = spark.sparkContext.broadcast(([tuple(r) for r in part.collect()], simplify, affixes))
        name = uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch], value=value, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, value, look)
            for batch in batches:
                found = [index.find(f, v) for f, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                cols = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=["id", "field_name", "value", "ref_id", "distance", "kind", "n"])

        out = todo.mapInArrow(run, "id string, field_name string, value string, ref_id bigint, distance double, kind int, n bigint")
        outs.append(out if n == 1 else Stage(spark, "mapped").write(out, f"part{k}"))
        if n > 1:
            value.unpersist()  # one part at a time
    if n == 1:
        return outs[0].select("id", "field_name", "value", "ref_id", "distance")
    out = outs[0]
    for x in outs[1:]:
        out = out.unionByName(x)
    best = out.groupBy("field_name", "value").agg(F.min(F.struct("distance", "kind", (-F.col("n")).alias("m"), "ref_id")).alias("b"))
    return todo.join(best, ["field_name", "value"]).select("id", "field_name", "value", "b.ref_id", "b.distance")
