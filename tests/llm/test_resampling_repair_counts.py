"""Importance resampling, conversation repair and token counts against brute force, with odd rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from functools import lru_cache

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ravelin.llm import conversations, importance, queries, token_counts
from ravelin.llm._scratch import Scratch
from ravelin.llm.earley import ROLES, Chart, Grammar, Row, parse
from tests.llm.test_operators import ODD, documents


@pytest.fixture(scope="module")
def real(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]


# --- op11 ------------------------------------------------------------------------------------------------------------


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_buckets(text):
    ws = plain_words(text)
    return [zlib.crc32(f.encode()) % 10000 for f in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]]


def plain_resample(rows, target):
    s, t = [0] * 10000, [0] * 10000
    for _, text in rows:
        for b in plain_buckets(text):
            s[b] += 1
    for text in target:
        for b in plain_buckets(text):
            t[b] += 1
    total_s, total_t = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log(((b + 1) * (total_s + 10000)) / ((a + 1) * (total_t + 10000)))) for a, b in zip(map(float, s), map(float, t))]
    out = []
    for key, text in rows:
        found = plain_buckets(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text))))
    drawn = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = drawn[: 25 * len(drawn) // 100]
    return out, [(r[3], r[0]) for r in drawn]


@pytest.mark.parametrize("block", [importance.BLOCK_FEATURES, 300])
def test_resampling(spark, real, block):
    texts = [*real[:120], *ODD, "日本 語 ÄÖ Ä1 naïve\x00x\x7fy `Z{ " * 30, real[5], None]
    ids = [None if i == 7 else i for i in range(len(texts))]
    benchmark = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    target = spark.createDataFrame([*enumerate(benchmark), (None, None)], "item_id long, text string")
    found = importance.resample(documents(spark, texts, ids), target, Scratch(spark, "t11"), block_features=block)
    assert found.columns == ["id", "n_features", "weight", "score", "rank"]
    rows = found.collect()
    expected, drawn = plain_resample(list(zip(ids, texts)), benchmark)
    assert sorted((r.id is None, r.id or 0, r.n_features, r.weight, r.score) for r in rows) == sorted((k is None, k or 0, n, w, s) for k, n, w, s, _ in expected)
    assert [(r.score, r.id) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, len(drawn) + 1))


def test_resampling_of_nothing(spark, real):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(documents(spark, ["x"]).limit(0), empty, Scratch(spark, "t11")).count() == 0
    # Without a target, common buckets lose more; repeated rows of one id are drawn each on its own.
    rows = importance.resample(documents(spark, [real[0]] * 8, [3] * 8), empty, Scratch(spark, "t11")).collect()
    assert len({(r.weight, r.score) for r in rows}) == 1 and sorted(r["rank"] or 0 for r in rows) == [0] * 6 + [1, 2]


def test_buckets_go_on_over_cuts(monkeypatch):
    text = "One two, three-four ÄÖ five  six seven eight " * 40
    n, whole = importance.text_buckets(text)
    monkeypatch.setattr(importance, "CUT_BYTES", 13)
    m, parts = importance.text_buckets(text)
    assert n == m == len(plain_words(text)) and sorted(whole) == sorted(parts) == sorted(plain_buckets(text))


# --- op12 ------------------------------------------------------------------------------------------------------------


def plain_repair(rows, insertions=2):
    """The cheapest (cost, audit) of all edits of (letter, must go, more), by trying every one; between two rows no more
    than two insertions can be of use."""
    n = len(rows)
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(i, state, room):  # states: z nothing yet, s, u, a
        found = [] if i < n or state not in "za" else [(0, "")]
        steps = {"z": {"u": "u", "s": "s"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state]
        for letter, after in steps.items():
            if letter != "s" and room:
                found += [(c + 3, "I" + a) for c, a in best(i, after, room - 1)]
            if i < n and not rows[i][1]:
                found += [(c + rows[i][2], "K" + a) for c, a in best(i + 1, after, insertions) if rows[i][0] == letter]
                found += [(c + 3 + rows[i][2], "R" + a) for c, a in best(i + 1, after, insertions) if letter != "s"]
        if i < n:
            found += [(c + 4, "D" + a) for c, a in best(i + 1, state, insertions)]
        return [min(found)] if found else []

    return best(0, "z", insertions)[0]


def test_parser_finds_the_cheapest_edits():
    rnd = random.Random(5)
    for _ in range(1500):
        rows = [Row(rnd.choice("suat"), rnd.random() < 0.15, 3 * (rnd.random() < 0.2)) for _ in range(rnd.randint(0, 9))]
        expected = plain_repair(tuple((r.letter, r.must_go, r.more) for r in rows))
        assert parse(rows) == expected
        assert parse(rows, Grammar(ROLES.rules, ROLES.makes)) == expected  # without leaving dear items out
        chart, settled = Chart(ROLES), ""
        for row in rows:
            chart.read(row)
            settled += chart.decided()
        cost, rest = chart.result()
        assert (cost, settled + rest) == expected


def test_other_grammars_need_their_columns():
    """Balanced brackets, right and left and centre recursive: items begin in every column."""
    nested = Grammar((("G", ("B", "$")), ("B", ()), ("B", ("(", "B", ")", "B"))), frozenset("()"), delete=2, rerole=1, insert=3)
    assert parse([Row(c) for c in "(())()"], nested) == (0, "KKKKKK")
    assert parse([Row(c) for c in "(()"], nested) == (2, "DKK")
    assert parse([Row(c) for c in "(("], nested) == (1, "KR")
    assert parse([Row(c) for c in ")("], nested) == (2, "RR")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fault == 0:
            out.append((conv, turn, role, text, False))
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text, True)] * (1 + (fault == 3))
    return out


def plain_reports(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv and r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text, _ in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not words else "d" if (role, text) in seen else "t" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit = plain_repair(tuple((r[2][:1], f in ("b", "d"), 3 * (f == "t")) for r, f in zip(own, faults)))
        lines, at = [], 0
        system = False
        for edit in audit:
            role, text = ("", "") if edit == "I" else own[at][2:4]
            at += edit != "I"
            if edit == "D":
                continue
            system = system or (not lines and edit == "K" and role[:1] == "s")
            role = role if edit == "K" else "user" if (len(lines) - system) % 2 == 0 else "assistant"
            lines.append(f"{role}:{text}")
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def odd_conversations():
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", "", "user"]), rnd.choice(["Hello.", "What?", "cut off", "", " \t", "Yes!  ", "ä。"])) for c in range(120) for t in rnd.sample(range(12), rnd.randint(1, 9))]
    rows += [(None, None, None, None), (None, 1, "user", "A null conversation."), (None, None, "assistant", "No turn."), (500, None, "user", None), (501, 3, None, "x.")]
    rows += [(502, 5, "user", "Same turn."), (502, 5, "assistant", "Same turn."), (502, 5, "user", "Same turn.")]
    return rows


def conversation_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, fault long, present string").repartition(5)


def key(report):
    return (report[0] is not None, report[0] or 0)


def test_conversations(spark):
    rows = odd_conversations()
    found = conversations.repair_reports(conversations.damage(conversation_table(spark, rows)))
    assert found.columns == ["conv", *(f.split()[0] for f in conversations.REPORT.split(", "))]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_reports(plain_damage(rows)), key=key)


def test_conversation_without_rows_left(spark):
    dropped = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversations.repair_reports(conversations.damage(conversation_table(spark, [(dropped, 0, "user", "Gone.")]))).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.repair_reports(conversations.damage(conversation_table(spark, [(1, 1, "user", "x")]).limit(0))).count() == 0


@pytest.mark.parametrize("roles", ["u", "ua", "uaa", "suat", "us"])
def test_long_conversations_are_settled_as_they_come(spark, roles):
    """Beyond what is parsed at once, in several batches, with a neighbour on either side."""
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    rnd = random.Random(2)
    rows = [(1, t, names[roles[t % len(roles)]], rnd.choice([f"Turn {t}.", "again!", f"open {t}", ""])) for t in range(400)]
    rows += [(0, 0, "user", "Short."), (2, 0, "user", "Also short.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = conversations.repair_reports(conversation_table(spark, rows).withColumnsRenamed({"conv_id": "conv"}).drop("present", "fault").withColumn("present", F.lit(True)).coalesce(1))
        assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_reports([(*r, True) for r in rows]), key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repaired_messages_are_what_was_hashed(spark):
    damaged = conversations.damage(conversation_table(spark, odd_conversations()))
    own = conversations.repaired_messages(damaged).collect()
    hashes = {r.conv: r.repaired_sha256 for r in conversations.repair_reports(damaged).collect()}
    for conv, hashed in hashes.items():
        lines = sorted((r.place, r.role, r.text) for r in own if r.conv == conv)
        assert [p for p, _, _ in lines] == list(range(len(lines)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in lines))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest() == hashed


# --- op13 ------------------------------------------------------------------------------------------------------------


def library_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


HARD = [
    "word <|endoftext|> and<|endoftext|>glued <|endof text|> " * 20,
    "a1b2c3" * 400, "a  b   c\n\n\n d\t\te 　 f g\x1ch \x85i " * 60, "don't we'll I'M 're '1 'sa " * 80,
    "日本語の文。中国語，文字 " * 90, "x" * 3000, " " * 3000, "\n \n" * 900, "🙂👍🏽 ﬁ é " * 100, "1234567890" * 300, "http://a.b/c?d=e&f=g " * 90,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("piece", [token_counts.PIECE_CHARS, 37])
def test_token_counts(spark, real, name, piece):
    texts = [*real[:60], *ODD, *HARD]
    ids = [None if i == 4 else i % 50 for i in range(len(texts))]
    found = token_counts.count_tokens(documents(spark, texts, ids), public_tokenizers.path(name), call_bytes=5000, piece_chars=piece)
    assert found.columns == ["id", "n_bytes", "n_tokens"]
    expected = zip(ids, (len((t or "").encode()) for t in texts), library_counts(name, texts))
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    assert token_counts.count_tokens(documents(spark, ["x"]).limit(0), public_tokenizers.path(name)).count() == 0


def test_pieces_are_the_text_and_stay_small(real):
    rnd = random.Random(4)
    for text in [*real[:40], *HARD, "".join(rnd.choice("ab1 '\n<|>") for _ in range(5000))]:
        parts = list(token_counts.pieces(text, 50, ("<|endoftext|>",)))
        assert "".join(parts) == text and all(len(p) >= 50 for p in parts[:-1])
        assert sum(library_counts("byte_bpe_50k.json", parts)) == library_counts("byte_bpe_50k.json", [text])[0]
    assert max(map(len, token_counts.pieces("ab cd " * 10_000, 100))) < 110
    assert list(token_counts.pieces("x" * 500, 100)) == ["x" * 500]
    assert len(list(token_counts.pieces("<|endoftext|>" * 50, 100, ("<|endoftext|>",)))) == 1


def test_queries_return_what_was_agreed(spark, small):
    def names(q):
        return queries.QUERIES[q](spark, small).dtypes

    longs = lambda *cols: [(c, "bigint") for c in cols]
    assert names("op11_resampling") == longs("doc_id", "n_features", "weight", "score", "rank")
    assert names("op12_conversations") == longs("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost") + [("audit", "string"), ("repaired_sha256", "string")]
    assert names("op13_token_counts") == longs("doc_id", "n_bytes", "n_tokens") + [("over_limit", "boolean")]


def test_token_count_query(spark, small):
    rows = queries.op13_token_counts(spark, small).orderBy("doc_id").collect()
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()]
    assert [r.n_tokens for r in rows] == library_counts("byte_bpe_50k.json", texts)
    assert all(r.over_limit == (r.n_tokens > 1024) and r.n_bytes == len((t or "").encode()) for r, t in zip(rows, texts))
