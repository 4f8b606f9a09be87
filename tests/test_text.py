"""Text functions, chunking and context against small independent Python versions."""

import random
import re

from pyspark.sql import functions as F

from ravelin.functions import text as X
from ravelin.operators import chunking, fusion


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_sentences(spark):
    texts = ["甲。乙！ 丙", "", None, "no end", "a;b; ;c", "  x?  "]
    assert column(spark, texts, X.split_sentences) == [["甲。", "乙！", "丙"], [], None, ["no end"], ["a;", "b;", ";", "c"], ["x?"]]


def test_titles(spark):
    lines = ["第一章 起", "12", "十 二", "三、四", "3. x", "附录", "第一章 (12)", "", "长" * 36, "x ...... 12", "　第二章　"]
    assert column(spark, lines, X.title_level) == ["chapter", None, "section", "section", "subsection", "appendix", None, None, None, None, "chapter"]


def test_names(spark):
    names = [" 王小明先生 ", "李先生", "王君兄", "公", "abc"]
    assert column(spark, names, X.entity_name) == ["王小明", "李先生", "王君", "公", "abc"]
    assert column(spark, [" person ", "城市", "?", "ORG"], X.entity_type) == ["PERSON", "LOC", "OTHER", "ORG"]
    assert column(spark, ["嘉庚", "x"], X.standard_name) == ["陈嘉庚", "x"]
    assert column(spark, ["a", "123", "我们", "ok"], X.is_noise) == [True, True, True, False]


def test_truncate(spark):
    texts = ["短", "一二三。四五六七", "一二三，四五六七", "一二三四五六七"]
    assert column(spark, texts, lambda c: X.truncate_at_sentence(c, 5)) == ["短", "一二三。", "一二三，", "一二三四五..."]


def test_lenient_json(spark):
    raw = ['```json\n{"k": 1}\n```', "no", None, 'so {"k": 2} it is']
    assert [r and r.k for r in column(spark, raw, lambda c: X.lenient_json(c, "k int"))] == [1, None, None, 2]


def titled(s):
    s = s.strip()
    if not s or len(s) > 35 or re.search(r"[（(]\s*\d+\s*[)）]|\.{3,}\s*\d+\s*$", s) or re.fullmatch(r"\d+", s):
        return None
    for level, p in (("chapter", r"第[一二三\d]+[章节]\s*"), ("section", r"[一二三]{1,3}\s+\S"), ("section", r"[一二三]{1,3}、"), ("subsection", r"\d{1,2}\.\s+\S")):
        if re.match(p, s):
            return level
    return None


def expected_chapters(lines):
    marks = []
    for i, line in enumerate(lines):
        if titled(line) and (i == 0 or len(lines[i - 1].strip()) < 20):
            n = 0
            for later in lines[i + 1 : i + 20]:
                if titled(later):
                    n += 1
                elif len(later.strip()) > 35:
                    break
            if n < 5:
                marks.append((i, line.strip(), titled(line)))
    heads = [(0, "前言", "preface"), *marks]
    spans = [(t, level, a, (heads[k + 1][0] if k + 1 < len(heads) else len(lines)) - 1) for k, (a, t, level) in enumerate(heads)]
    return [s for s in spans if s[3] > s[2]]


def test_chapters(spark):
    rng = random.Random(5)
    kinds = ["第一章 甲", "二 乙", "1. x", "", "短行", "长" * 40, "x" * 25]
    books = [[rng.choice(kinds) for _ in range(rng.randint(1, 60))] for _ in range(60)]
    found = column(spark, ["\n".join(b) for b in books], chunking.chapters)
    assert [[tuple(c) for c in x] for x in found] == [expected_chapters(b) for b in books]


def test_body_start(spark):
    contents = ["第一章 甲"] * 160
    book = contents + ["短"] * 20 + ["长" * 30] + ["x"] * 100
    plain = contents + ["x"] * 100
    assert column(spark, ["\n".join(book), "\n".join(plain), "a\nb", ""], chunking.body_start) == [180, 175, 0, 0]


def packed(spark, sentences, **limits):
    df = spark.createDataFrame([(s,) for s in sentences], "s array<string>")
    return [r.c for r in df.select(chunking.pack_sentences(F.col("s"), **limits).alias("c")).collect()]


def plain_chunks(sentences, most, overlap, least):
    """By recursion: the chunk that begins with a text and some carried sentences, then what follows it."""

    def chunk(head, carried, at):
        end = at + 1 if at < len(sentences) and not head else at
        while end < len(sentences) and len(head) + sum(map(len, sentences[at:end])) + len(sentences[end]) <= most:
            end += 1
        end = max(end, min(at + 1, len(sentences)))  # a chunk has one sentence of its own
        text = (head + "".join(sentences[at:end])).strip()
        if end == len(sentences):
            return [text] if len(text) >= least else []
        parts = carried + sentences[at:end]
        n = max(k for k in range(len(parts) + 1) if sum(map(len, parts[len(parts) - k :])) <= overlap)
        again = "".join(parts[len(parts) - n :])
        return [text, *chunk(again, [p for p in parts if again and p in again], end)]

    return chunk("", [], 0)


def test_packing_limits(spark):
    sentences = ["甲" * n + "。" for n in (300, 300, 70, 300, 900, 20, 30, 99)]
    chunks, short = packed(spark, [sentences, ["甲" * 50]])
    assert chunks[0] == sentences[0] + sentences[1] + sentences[2]
    assert chunks[1].startswith(sentences[2])
    assert any(len(c) > 800 for c in chunks) and short == []


def test_packing_equals_recursion(spark):
    rng = random.Random(3)
    rows = [["abc"[rng.randrange(3)] * rng.choice([1, 2, 3, 5, 9, 30]) + rng.choice([".", "!"]) for _ in range(rng.randint(0, 25))] for _ in range(200)]
    for most, overlap, least in ((20, 6, 4), (12, 8, 1)):
        assert packed(spark, rows, most=most, overlap=overlap, least=least) == [plain_chunks(r, most, overlap, least) for r in rows]


def test_context_budget(spark):
    rows = [(1, [("b", "c", "一" * 500 + "。"), ("b", "c", "二" * 500 + "。" + "二" * 400), ("b", "c", "三" * 900)])]
    df = spark.createDataFrame(rows, "q int, contexts array<struct<book: string, chapter: string, text: string>>")
    out = df.select(fusion.context_text(F.col("contexts")).alias("o")).first().o
    parts, used = [], 0
    for i, (b, c, text) in enumerate(rows[0][1]):
        left = 1200 - used
        if len(text) > left:
            if left < 30:
                break
            cut = text[:left].rfind("。")
            text = text[: cut + 1] if cut >= 0 else text[:left] + "..."
        parts.append(f"[{i + 1}] 《{b}》{c}：{text}")
        used += len(parts[-1])
    assert out == "\n\n".join(parts)
