"""Splitting oversized texts at natural boundaries (problem 9).

A text is read as a tree of its structure: sections by the depth of their headings (Markdown, underlined or HTML headings;
volumes, chapters and sections named as such), paragraphs, lists and block elements of markup by their nesting, and below
them lines, sentences, clauses, pretokens of the tokenizer and characters. A section ends where a heading of its own or a
lesser depth begins, an item where the next item of its own or a lesser depth does; a heading stays with what follows it.
Fenced code has lines only.

Packing goes bottom-up: a node that fits is one subtree; only a node that is too large by itself is entered, its children
are packed first, and neighbouring siblings that fit are merged as long as the sum fits. Sizes are tokens. Each piece but
the first begins `overlap` tokens before the end of the piece before it, at the nearest place at or before that which does
not cut a character.

Defined cases: null, empty and blank texts and texts within the limit give no pieces. A single pretoken longer than the
limit is cut between characters. Rows with the same key are split each for itself. The pieces without their overlaps,
one after another, are the text. Structure that is not closed (a tag, a fence) ends with the text.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TOKENIZER, Encoder, encoder, may_exceed, shared, slices

#: Levels of the tree: headings by depth, paragraphs, items and elements by nesting, lines, and within lines.
DEPTHS, NESTED = 6, 8
PARAGRAPH = DEPTHS
ITEM = PARAGRAPH + 1
LINE = ITEM + NESTED
SENTENCE, CLAUSE, PRETOKEN = LINE + 1, LINE + 2, LINE + 3
INLINE = {
    SENTENCE: regex.compile(r"[。！？!?…]+[”’」』）)\"']*|\.[”’\"')]*(?=\s)"),
    CLAUSE: regex.compile(r"[；;：:，,、]+|\s(?=\S)"),
}
_NUMBER = r"[\d一二三四五六七八九十百千]+"
#: Headings that are named as such, with their depth.
NAMED = [
    (1, regex.compile(rf"[ \t　]*(?:第{_NUMBER}[卷部篇編编]|卷\s*{_NUMBER}|(?i:part|book|volume)\s+[\divxlc]+\b)")),
    (2, regex.compile(rf"[ \t　]*(?:第{_NUMBER}[章回]|(?i:chapter)\s+[\divxlc]+\b)")),
    (3, regex.compile(rf"[ \t　]*(?:第{_NUMBER}[节節]|(?i:section)\s+[\divxlc]+\b)")),
]
HASHES = regex.compile(r" {0,3}(#{1,6})(?:\s|$)")
UNDERLINE = regex.compile(r" {0,3}(=+|-{2,})[ \t]*$")
BULLET = regex.compile(rf"([ \t　]*)(?:[-*+•·◦▪]\s|\d{{1,3}}[.)](?=\s)|{_NUMBER}、|[（(]{_NUMBER}[)）])")
FENCE = regex.compile(r" {0,3}(`{3,}|~{3,})")
BLOCKS = "section|article|aside|header|footer|main|nav|div|ul|ol|li|dl|dd|table|thead|tbody|tr|p|blockquote|pre|figure|poem|chapter|body|stanza"
TAG = regex.compile(rf"<(?P<close>/)?(?:(?P<name>{BLOCKS})|h(?P<depth>[1-6]))\b[^<>]*>", regex.I)


def structure(text: str) -> dict[int, list[int]]:
    """level -> places, sorted, at which a node of this level begins; levels above SENTENCE."""
    found: dict[int, int] = {}  # place -> strongest level
    indents: list[int] = []
    fence, blank, heading, begin, before = "", False, True, 0, None
    note = lambda at, level: found.__setitem__(at, min(level, found.get(at, LINE)))
    for line in text.splitlines(keepends=True) if "\r" in text else regex.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.strip()
        mark = FENCE.match(line)
        depth = None
        if fence:
            note(begin, LINE)
            if mark and mark[1].startswith(fence):
                fence = ""
        elif not bare:
            blank = True
            begin += len(line)
            continue
        else:
            if mark:
                fence = mark[1]
            elif m := HASHES.match(line):
                depth = len(m[1])
            elif (m := UNDERLINE.match(line)) and before is not None and not blank and not heading:
                note(before, 0 if m[1][0] == "=" else 1)
                indents, heading = [], True
                note(begin, LINE)
                before, begin = None, begin + len(line)
                continue
            elif len(bare) <= 80:
                depth = next((d for d, p in NAMED if p.match(line)), None)
            if depth:
                note(begin, depth - 1)
                indents = []
            elif m := BULLET.match(line):
                width = len(m[1].expandtabs(4))
                while indents and indents[-1] >= width:
                    indents.pop()
                level = min(ITEM + len(indents), LINE - 1)
                indents.append(width)
                note(begin, LINE if heading else level)
            else:
                if blank and not line[:1].isspace():
                    indents = []
                note(begin, PARAGRAPH if blank and not heading and not (indents and line[:1].isspace()) else LINE)
        heading, blank, before = bool(depth), False, begin
        begin += len(line)
    nested = 0
    for m in TAG.finditer(text):
        if m["depth"]:
            if not m["close"]:
                note(m.start(), int(m["depth"]) - 1)
        elif not m["close"]:
            note(m.start(), min(ITEM + nested, LINE - 1))
            nested += 1
        elif nested:
            nested -= 1
            note(m.end(), min(ITEM + nested, LINE - 1))
    out: dict[int, list[int]] = {}
    for at in sorted(found):
        if 0 < at < len(text):
            out.setdefault(found[at], []).append(at)
    return out


class _Text:
    """A text with its pretokens: at: their ends in characters; tokens: ids up to there."""

    def __init__(self, text: str, words: list[str], count: np.ndarray):
        self.text = text
        self.at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))).tolist()
        self.tokens = np.concatenate(([0], np.cumsum(count))).tolist()
        self.cuts = structure(text)

    def before(self, x: int) -> float:
        """Tokens before a character; within a pretoken in proportion."""
        i = bisect_left(self.at, x)
        if self.at[i] == x:
            return self.tokens[i]
        share = (x - self.at[i - 1]) / (self.at[i] - self.at[i - 1])
        return self.tokens[i - 1] + share * (self.tokens[i] - self.tokens[i - 1])

    def size(self, a: int, b: int) -> int:
        """Tokens between two characters."""
        return ceil(self.before(b) - self.before(a))

    def edges(self, level: int, a: int, b: int) -> list[int]:
        """Inner cuts of the span at this level, strictly between its ends."""
        if level not in self.cuts:
            self.cuts[level] = [] if level < SENTENCE else [m.end() for m in INLINE[level].finditer(self.text)] if level in INLINE else self.at if level == PRETOKEN else list(range(len(self.text) + 1))
        c = self.cuts[level]
        return c[bisect_right(c, a) : bisect_left(c, b)]

    def pack(self, a: int, b: int, most: int, level: int = 0) -> list[tuple[int, int]]:
        """Spans of at most `most` tokens that fill [a, b): only oversized nodes are entered, siblings are merged bottom-up."""
        if self.size(a, b) <= most or b - a <= 1:
            return [(a, b)]
        inner = self.edges(level, a, b)
        while not inner:
            level += 1
            inner = self.edges(level, a, b)
        packed: list[tuple[int, int, bool]] = []  # begin, end, whether it is a whole subtree
        for x, y in zip([a, *inner], [*inner, b]):
            spans = self.pack(x, y, most, level + 1)
            packed += [(p, q, len(spans) == 1) for p, q in spans]
        out: list[tuple[int, int, bool]] = []
        for p, q, whole in packed:
            if out and whole and out[-1][2] and self.size(out[-1][0], q) <= most:
                out[-1] = (out[-1][0], q, True)
            else:
                out.append((p, q, whole))
        return [(p, q) for p, q, _ in out]


def _starts(enc: Encoder, text: str, ids: np.ndarray, cores: list[tuple[int, int]], overlap: int) -> list[tuple[int, int]]:
    """Of each core the piece's start in characters and the overlap's tokens."""
    ends = np.concatenate(([0], np.cumsum(enc.sizes[ids])))  # of tokens, in bytes
    data = np.frombuffer(text.encode(), np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)  # each character's first byte
    whole = np.append((data & 0xC0) != 0x80, True)[ends]  # the token begins with a character
    out = []
    for a, _ in cores:
        if not a or not overlap:
            out.append((a, 0))
            continue
        end = int(np.searchsorted(ends, first[a], "right")) - 1
        k = max(0, end - overlap)
        while not whole[k]:
            k -= 1
        out.append((int(np.searchsorted(first, ends[k])), end - k))
    return out


def pieces(enc: Encoder, texts: list[str], limit: int, overlap: int) -> list[tuple[int, list[tuple[int, int, int, int, int]]]]:
    """Of each text its tokens and, if they exceed the limit, its pieces: (core start, core end, start with overlap, overlap's tokens, tokens)."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    room = limit - overlap - 8  # what a cut inside a pretoken, or at its edge, can add
    words, counts, ids, offsets = enc.analyse(texts)
    out: list[tuple[int, list]] = [(int(b - a), []) for a, b in zip(offsets, offsets[1:])]
    trees = {i: _Text(texts[i], words[i], counts[i]) for i, (n, _) in enumerate(out) if n > limit}
    todo = {i: t.pack(0, len(t.text), room) for i, t in trees.items()}
    while todo:  # a second round only where a piece by itself has more tokens than in its text
        plan = [(i, *core, *start) for i, cores in todo.items() for core, start in zip(cores, _starts(enc, texts[i], ids[offsets[i] : offsets[i + 1]], cores, overlap))]
        sizes = np.diff(enc.texts([texts[i][start:b] for i, _, b, start, _ in plan])[1]).tolist()
        todo = {}
        for (i, a, b, start, shared_tokens), n in zip(plan, sizes):
            if n > limit and b - a > 1:
                t = trees[i]
                less = t.pack(a, b, max(1, min(room, t.size(a, b)) - (n - limit)))
                todo.setdefault(i, []).extend(less if len(less) > 1 else [(a, (a + b) // 2), ((a + b) // 2, b)])
            else:
                out[i][1].append((a, b, start, shared_tokens, n))
    for _, found in out:
        found.sort()
    return out


SCHEMA = "piece_no int, n_pieces int, core_start int, char_start int, char_end int, overlap_tokens int, n_tokens int, doc_tokens int, piece string"


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row for each piece of each text of more than `limit` tokens; see the module's text for the cases.

    Columns: key, piece_no (from 0), n_pieces, core_start, char_start, char_end (characters), overlap_tokens, n_tokens (of
    the piece encoded by itself), doc_tokens, piece. A narrow map over the scan: a text of at most `limit` bytes cannot
    exceed the limit and is left out in the JVM, before any text goes to Python.
    """
    value = shared(df.sparkSession, tokenizer)
    src = df.where(may_exceed(F.col(f"`{text}`"), limit)).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    fields = [x.rsplit(" ", 1)[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, value)
        for batch in (x for b in batches for x in slices(b, 1)):
            texts = batch.column(1).to_pylist()
            rows, cols = [], [[] for _ in fields]
            for i, (total, found) in enumerate(pieces(enc, texts, limit, overlap)):
                for no, (a, b, start, shared_tokens, n) in enumerate(found):
                    rows.append(i)
                    for c, v in zip(cols, (no, len(found), a, start, b, shared_tokens, n, total, texts[i][start:b])):
                        c.append(v)
            arrays = [pa.array(c, pa.string() if f == "piece" else pa.int32()) for f, c in zip(fields, cols)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names=[key, *fields])

    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {SCHEMA}")
