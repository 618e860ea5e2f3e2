import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from versefold.llm import bpe, splitting

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.TOKENIZER), reason="no vocabulary file here")
TEXTS = ["", " ", "\n\t 　", "云月", "Hello, world's  end", "<|endoftext|>", "é ​﻿", "👩‍🌾❤️", "观" * 3000, "ab" * 4000, "x" * 9000, " " * 5000, "\n" * 3000, "卷1 落寒书\n冷云澹水明潭留，雨雪吹衣淡锁鼓。\n" * 200]


@pytest.fixture(scope="module")
def ref():
    e = bpe.encoder(bpe.TOKENIZER)
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})


def test_equals_reference_library(ref):
    e = bpe.encoder(bpe.TOKENIZER)
    ids, offsets = e.texts([*TEXTS, None])
    for i, t in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == ref.encode_ordinary(t)
    assert offsets[-1] == offsets[-2]
    assert [len(x) for x in e.texts([])] == [0, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_random_texts(ref, texts):
    ids, offsets = bpe.encoder(bpe.TOKENIZER).texts(texts)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == ref.encode_ordinary(t)


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("ab观é'\n 1，"), min_size=513, max_size=700))
def test_long_words(ref, text):
    assert bpe.encoder(bpe.TOKENIZER).texts([text])[0].tolist() == ref.encode_ordinary(text)


def test_encode(spark, ref):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "云 cloud", "i"), (None, "x", "i")], "doc_id bigint, text string, ids string")
    got = [tuple(r) for r in bpe.encode(df, "doc_id", "text").collect()]
    assert got == [(1, None), (2, []), (2, ref.encode_ordinary("云 cloud")), (None, ref.encode_ordinary("x"))]
    assert bpe.encode(df.limit(0), "doc_id", "text").collect() == []
    assert [r.n_tokens for r in bpe.count_tokens(df, "doc_id", "text").collect()][:2] == [None, 0]


@pytest.mark.parametrize("limit,overlap", [(1024, 64), (50, 10), (20, 0)])
def test_pieces(ref, limit, overlap):
    texts = [*TEXTS, "# A\n" + "word " * 300 + "\n\n# B\n" + "one. two three.\n" * 200]
    e = bpe.encoder(bpe.TOKENIZER)
    for t, (total, found) in zip(texts, splitting.pieces(e, texts, limit, overlap)):
        assert total == len(ref.encode_ordinary(t)) and bool(found) == (total > limit)
        if found:
            assert "".join(t[a:b] for a, b, *_ in found) == t
        for a, b, start, shared, n in found:
            assert n == len(ref.encode_ordinary(t[start:b])) <= limit
            assert (start, shared) == (0, 0) if a == 0 else start <= a and (shared >= overlap or start == 0)
            if a and overlap:
                assert shared <= overlap + 4


def test_natural_boundaries():
    part = lambda n: "冷云澹水明潭留，雨雪吹衣淡锁鼓。" * n
    text = f"卷1 甲\n{part(9)}\n\n{part(9)}\n卷2 乙\n{part(9)}\n\n{part(9)}"
    e = bpe.encoder(bpe.TOKENIZER)
    total = len(e.texts([text])[0])
    found = splitting.pieces(e, [text], total * 6 // 10, 10)[0][1]
    assert [text[a : a + 3] for a, *_ in found] == ["卷1 ", "卷2 "]
    with pytest.raises(ValueError):
        splitting.pieces(e, [text], 100, 50)


def test_split_oversized(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "short"), (5, TEXTS[-1]), (5, TEXTS[-1])], "doc_id bigint, text string")
    got = splitting.split_oversized(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == {5}
    assert len(got) == 2 * got[0].n_pieces and all(r.n_tokens <= 1024 and r.piece == TEXTS[-1][r.char_start : r.char_end] for r in got)
    assert splitting.split_oversized(df.limit(0), "doc_id", "text").count() == 0


TREE = """前言

# 甲
引子
## 甲一
- 一
  - 一之一
    - 深
  - 一之二

- 二
  接着
## 甲二

段落一
第二行

段落二
乙
===
```
# 不是标题
- 不是列表
```
<div><p>x</p><ul><li>y</li></ul></div>
"""


def test_structure_of_a_hand_made_tree():
    at = {level: [TREE[i:].split("\n")[0] for i in places] for level, places in splitting.structure(TREE).items()}
    item = splitting.ITEM
    assert at[0] == ["# 甲", "乙"] and at[1] == ["## 甲一", "## 甲二"] and at[splitting.PARAGRAPH] == ["段落二"]
    assert at[item][0] == "- 二" and at[item + 1] == ["  - 一之一", "  - 一之二", "<p>x</p><ul><li>y</li></ul></div>", "<ul><li>y</li></ul></div>", "</div>"] and at[item + 2] == ["    - 深", "<li>y</li></ul></div>", "</ul></div>"]
    assert "# 不是标题" in at[splitting.LINE] and "- 不是列表" in at[splitting.LINE] and "第二行" in at[splitting.LINE]
    assert splitting.structure("") == {} and splitting.structure("\n\n") == {}
    assert splitting.structure("第一卷 a\n第二章 b\n第三节 c\n第四章 d\nPart 2\n") == {1: [6, 18], 2: [12], 0: [24]}


def spans_of(text, most):
    e = bpe.encoder(bpe.TOKENIZER)
    words, counts, *_ = e.analyse([text])
    return [text[a:b] for a, b in splitting._Text(text, words[0], counts[0]).pack(0, len(text), most)]


def test_only_oversized_nodes_are_entered():
    part = lambda head, n: head + "\n" + "word " * n + "\n"
    small, large = [part(f"## s{i}", 20) for i in range(4)], part("## big", 20) + part("### b1", 60) + part("### b2", 60)
    got = spans_of("# A\n" + small[0] + small[1] + large + small[2] + small[3], 100)
    assert got == ["# A\n" + small[0] + small[1], part("## big", 20) + part("### b1", 60), part("### b2", 60), small[2] + small[3]]


def test_lists_are_cut_between_items_of_the_least_depth():
    item = lambda i, n: f"- item {i}\n" + "".join(f"  - part {i} {j} " + "w " * n + "\n" for j in range(3))
    text = "".join(item(i, 10) for i in range(8))
    got = spans_of(text, 150)
    assert len(got) > 1 and all(x.startswith("- item") for x in got) and "".join(got) == text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "卷一", "- x", "  - y", "", "词句。又一句，半句", "<div>", "</div>", "```", "word " * 30, "===", "1. z"]), max_size=40), st.sampled_from([20, 60]))
def test_pieces_of_any_structure_fill_the_text(lines, limit):
    text = "\n".join(lines)
    e = bpe.encoder(bpe.TOKENIZER)
    total, found = splitting.pieces(e, [text], limit, 5)[0]
    if found:
        assert "".join(text[a:b] for a, b, *_ in found) == text and all(n <= limit for *_, n in found)
