"""Dictionary matching, sentiment by word lists, and rule labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams
from .relational import lengths_of, small

#: Fixed value: characters that negate what follows.
NEGATION = "不无莫非未休勿"


def overlap_count(text: Column, term: str, negation: str = NEGATION) -> Column:
    """Overlapping occurrences of a term that no negating character stands right before."""
    quoted = "\\Q" + term.replace("\\E", "") + "\\E"
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?<![{negation}])(?={quoted})"))


def terms_at_places(text: Column, terms: Sequence[str], negation: str = "") -> Column:
    """ARRAY<STRING>: at every place the longest of the terms that begins there, overlapping ones too, in one pass.

    negation: places right behind one of these characters do not count. For word lists that fit a pattern (some thousand
    terms); larger ones go through all_matches.
    """
    alternatives = "|".join("\\Q" + t + "\\E" for t in sorted(set(terms), key=lambda x: (-len(x), x)))
    before = f"(?<![{negation}])" if negation else ""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"{before}(?=({alternatives}))"), F.lit(1)), F.array().cast("array<string>"))


def all_matches(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """key, pos and the lexicon's columns: every occurrence of every `term`, of any length, overlapping ones too.

    An equi-join on runs of the lengths that terms have (an aggregate over the lexicon); a small lexicon meets the runs
    before anything is shuffled.
    """
    lexicon = lexicon.where(F.length("term") > 0)
    lengths = lengths_of(lexicon, "term")
    if not lengths:
        return df.select(key, F.lit(0).alias("pos")).limit(0).join(lexicon.limit(0), F.lit(True)).select(key, "pos", *lexicon.columns)
    every = F.flatten(F.array(*[F.coalesce(grams(F.col(text), k, k), F.array().cast("array<struct<pos:int,term:string>>")) for k in lengths]))
    found = df.select(key, F.explode(every).alias("x")).select(key, "x.pos", "x.term")
    return found.join(small(lexicon), "term")


def longest_at(matches: DataFrame, key: str) -> DataFrame:
    """Of the matches at one place the longest."""
    cols = [c for c in matches.columns if c not in (key, "pos")]
    best = matches.groupBy(key, "pos").agg(F.max_by(F.struct(*cols), F.length("term")).alias("m"))
    return best.select(key, "pos", "m.*")


def trie_pattern(terms: Iterable[str]) -> str:
    """A pattern that matches the longest of the terms at a place; its time follows the text, not the number of terms."""
    root: dict = {}
    for t in terms:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        if not (branches := [re.escape(c) + of(x) for c, x in sorted(node.items()) if c]):
            return ""
        inner = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
        return f"(?:{inner})?" if "" in node else inner

    return of(root)


def greedy(df: DataFrame, key: str, text: str, terms: Sequence[str], high: int = 5, low: int = 2, singles: bool = True) -> DataFrame:
    """key, pos, term, before: longest match from left to right without overlap, then single characters on uncovered places.

    before: the two characters in front. Terms of low to high characters, and of one character if `singles`: a place that
    no longer term covers takes its single character, which is what a second pass over the uncovered places gives. Places
    are needed, so texts go through one compiled pattern (a prefix tree, no loop over characters) in Arrow batches.
    """
    kept = sorted({t for t in terms if t and (low <= len(t) <= high or singles and len(t) == 1)})
    pattern = re.compile(trie_pattern(kept)) if kept else re.compile(r"(?!)")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, pos, term, before = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for m in pattern.finditer(t or ""):
                    p = m.start()
                    rows.append(i), pos.append(p + 1), term.append(m.group()), before.append(t[max(0, p - 2) : p])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(pos, pa.int32()), pa.array(term, pa.string()), pa.array(before, pa.string())], names=[key, "pos", "term", "before"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"{key} {kind}, pos int, term string, before string")


def negated_scores(toks: Column, categories: dict[str, dict[str, float]], negators: Sequence[str], reach: int = 3) -> Column:
    """STRUCT of one score for each category: a fold over the tokens, in which a negator turns the next `reach` tokens."""
    names = list(categories)
    state = F.struct(F.lit(0).alias("left"), *[F.lit(0.0).alias(n) for n in names])

    def weight(t: Column, words: dict[str, float]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(float(v)))]), t), F.lit(0.0))

    def step(s: Column, t: Column) -> Column:
        sign = F.when(s["left"] > 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.struct(F.when(t.isin(*negators), F.lit(reach)).otherwise(F.greatest(s["left"] - 1, F.lit(0))).alias("left"), *[(s[n] + F.when(t.isin(*negators), F.lit(0.0)).otherwise(sign * weight(t, categories[n]))).alias(n) for n in names])

    return F.aggregate(toks, state, step, lambda s: F.struct(*[s[n].alias(n) for n in names]))


def rule_scores(text: Column, rules: Sequence[dict]) -> Column:
    """ARRAY<STRUCT<label, score>>: weight for each trigger contained, 1.2 weight for each pattern found."""
    out = []
    for r in rules:
        parts = [F.when(F.contains(text, F.lit(t)), F.lit(float(r["weight"]))).otherwise(0.0) for t in r["triggers"]] + [F.when(text.rlike(p), F.lit(1.2 * r["weight"])).otherwise(0.0) for p in r["patterns"]]
        out.append(F.struct(F.lit(r["label"]).alias("label"), F.coalesce(sum(parts[1:], parts[0]), F.lit(0.0)).alias("score")))
    return F.array(*out)


def keyword_rules(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule of which any keyword is contained."""
    out = F.coalesce(*[F.when(sum((F.contains(text, F.lit(k)).cast("int") for k in keys[1:]), F.contains(text, F.lit(keys[0])).cast("int")) > 0, F.lit(label)) for label, keys in rules], F.lit(default))
    return out
