"""The operators for training data against brute force, round trips and held-out accuracy, with odd rows."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ravelin.llm import automaton, bwt, packing, quality, queries, secrets, similar, simhash, substrings, suffix_tree, templates, tiling, warc, weak_rules
from ravelin.llm._graph import connected_components
from ravelin.llm._scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, `row` long"


def documents(spark, texts, ids=None):
    """Documents with further columns whose names clash with those that operators make."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), None, 1, 2) for i, t in zip(ids, texts)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]


ODD = [None, "", " \n\t", "a", "ä ö", "word " * 30000, "x" * 100_000, "same text here", "same text here"]


# --- op9 -------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, fps, distance):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: None)
    for i, k in enumerate(keys):
        if k is not None and (least[find(i)] is None or k < least[find(i)]):
            least[find(i)] = k
    return [least[find(i)] for i in range(len(fps))]


def test_simhash(spark, real):
    texts = [*real[:80], *ODD[:5], *ODD[7:], real[3], real[4] + " tail", None]
    ids = [None if i == 5 else i for i in range(len(texts))]
    found = simhash.near_duplicates(documents(spark, texts, ids)).collect()
    fps = [plain_fingerprint(t) for t in texts]
    expected = sorted(zip([str(i) for i in ids], fps, plain_components(ids, fps, 4)), key=repr)
    assert sorted(((str(r.id), r.fp % 2**64, r.component_id) for r in found), key=repr) == expected
    assert simhash.near_duplicates(documents(spark, texts).limit(0)).count() == 0


def test_links_reach_all_pairs(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for c in centres for _ in range(40)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for n in (len(fps), 10**7, 10**10):  # other block plans, the same links
        links = simhash.link_fingerprints(df, 4, n)
        roots = {r.node % 2**64: r.root for r in connected_components(spark, links, Scratch(spark, "test")).collect()}
        groups = collections.defaultdict(set)
        for f in fps:
            groups[roots.get(f, f)].add(f)
        expected = collections.defaultdict(set)
        for f, c in zip(fps, plain_components(fps, fps, 4)):
            expected[c].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_one_of_each(spark):
    docs = documents(spark, ["a b c d e", "a b c d e", "other words are here", "a b c d e", None], [3, 1, 7, 1, None])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "a b c d e"), ("7", "other words are here"), ("None", None)]


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def test_shared_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(30)]
    expected = [[len(set(x.tolist()) & set(y.tolist())) for y in sets[8:]] for x in sets[:12]]
    assert similar.shared(sets[:12], sets[8:], width=7).astype(int).tolist() == expected


@pytest.mark.parametrize("block", [256, 16])
def test_near_dedup_stage_keeps_one_of_all_that_are_similar(spark, monkeypatch, real, small, block):
    import corpus_pipeline

    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def edited(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = word()
        return " ".join(out)

    bases = [[word() for _ in range(200)] for _ in range(12)]
    texts = [*real[:100], None, "", "a", "A", *(" ".join(b) for b in bases)]
    texts += [edited(b, k) for b in bases for k in (1, 2, 3, 4, 5, 8)]
    texts += [edited(bases[0], rng.randint(2, 7)) for _ in range(90)]  # more than are compared pair by pair
    ids = rng.sample(range(10_000), len(texts))
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if plain_alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    docs = documents(spark, texts, ids)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, small)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), small).count() == 0


# --- op8 -------------------------------------------------------------------------------------------------------------


def plain_spans(text, rules):
    found = []
    for i, rule in enumerate(rules):
        for m in re.finditer(rule.exact, text or "", re.ASCII | (re.I if rule.fold else 0)):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), m.end(), i))
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_secrets(spark):
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "xyz", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "gho_", "xoxb-", "token", "passwd", "x", "a" * 36, "ſecret", "/+.=-_", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for t in texts:
        assert secrets.find_spans(t) == plain_spans(t, secrets.RULES), t
    rows = secrets.scan_secrets(documents(spark, [*texts[:50], *ODD])).collect()
    assert len(rows) == 59 and sum(len(r.spans) for r in rows) == sum(len(plain_spans(t, secrets.RULES)) for t in [*texts[:50], *ODD])
    red = secrets.redact(documents(spark, ["é password=abcdefgh0 z", None, "token = 0123456789abcdef0123456789abcdef"])).orderBy("doc_id").collect()
    assert [r.text for r in red] == ["é [REDACTED] z", None, "[REDACTED]"]


def test_armoured_keys_go_whole(spark):
    rng = random.Random(5)
    line = lambda n: "".join(rng.choice("ABCxyz0189+/") for _ in range(n))
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = [line(64), line(64), line(22) + "=="]
    bare = [line(64), line(64), line(24)]
    texts = ["\n".join(["before", head, *body, foot, "after"])]
    texts += ["\r\n".join(["before", head, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", "", *body, foot, "after"])]
    texts += ["before " + "\\n".join([head, *body, foot]) + " after"]
    texts += ["before " + " ".join([head, *bare, foot]) + " after"]
    texts += ["\n".join(["before", head, *bare, "some words after"]), "before " + "\\n".join([head, *body]) + " after", "\n".join(["before", head, *bare])]
    texts += ["\n".join(["before", head, *body, head, *body, foot, "after"]), f"before {head} some words after"]
    cleaned = [r.text for r in secrets.redact(documents(spark, texts)).orderBy("doc_id").collect()]
    for text, left in zip(texts, cleaned):
        assert left.split()[0] == "before" and "[REDACTED]" in left and "-----" not in left, left
        assert ("after" in text) == ("after" in left) and not any(x in left for x in body + bare), left
    assert cleaned[4].split("]")[1] == "\nsome words after" and cleaned[8] == "before [REDACTED] some words after"
    long = (head + "\n" + line(64) + "\n") * 20_000  # no END at all: time stays linear
    assert len(secrets.find_spans(long)) >= 20_000


def test_automaton_is_minimal_and_right():
    machine = automaton.compile_rules([("ab+c", False), ("[0-9]{3}", False), ("x|yz?", True)])
    assert machine.states <= 12
    for t in ("zabbbc", "12a345", "Y", "q", "ac", "", "12"):
        expected = sum(1 << i for i, p in enumerate(("ab+c", "[0-9]{3}", "(?i)x|yz?")) if re.search(p, t))
        got = machine.ends(t.encode())
        assert sum(1 << i for i in range(3) if any(bits >> i & 1 for _, bits in got)) == expected
        for i, p in enumerate(("ab+c", "[0-9]{3}", "(?i:x|yz?)")):
            assert [e for e, bits in got if bits >> i & 1] == [e for e in range(len(t) + 1) if re.search(f"(?:{p})\\Z", t[:e])]


def test_backward_automaton():
    machine = automaton.compile_rules([("ab*c|bc", False)], backward=True)
    for t, least, expected in (("xabbbc", 0, 1), ("xabbbc", 2, 4), ("bc", 0, 0), ("c", 0, None), ("abbc", 3, None)):
        assert machine.longest(t.encode(), len(t), least) == expected


# --- op3 -------------------------------------------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(grams)
    cover = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(cover)


def test_weak_rules(spark, real):
    texts = [*real, *ODD, "a b a b a b a b", "l\nl\n \n \nl", "a b c", "x " * 49, "one two " * 26]
    found = weak_rules.judge(documents(spark, texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = plain_measures(texts[r.id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, texts[r.id][:80]
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.base_failed and r.kept)
    assert weak_rules.judge(documents(spark, texts).limit(0)).count() == 0


def test_rules_agree_with_labels(spark, real):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    rows = [r for r in weak_rules.judge(documents(spark, real)).collect() if r.id in labels and not r.base_failed]
    assert sum(r.kept == (labels[r.id] == 1) for r in rows) >= 0.95 * len(rows)


def test_rates_are_estimated_from_votes_alone(spark):
    """Votes dealt out with known accuracies, four rules that abstain in part: the fit finds them, without labels."""
    rnd = random.Random(11)
    truth = [(0.97, 0.9), (0.9, 0.7), (0.85, 0.8), (0.95, 0.4)]
    rows = []
    for _ in range(6000):
        good = rnd.random() < 0.7
        rows.append(([0 if rnd.random() < 0.2 else (1 if good else -1) * (1 if rnd.random() < (a if good else b) else -1) for a, b in truth],))
    model = weak_rules.fit(spark.createDataFrame(rows, "votes array<int>"), 4, 60).first()
    assert abs(model.prior - 0.7) < 0.05
    assert all(abs(r.a - a) < 0.05 and abs(r.b - b) < 0.08 for r, (a, b) in zip(model.rates, truth))
    nothing = weak_rules.fit(spark.createDataFrame([], "votes array<int>"), 4).first()
    assert nothing is None or all(0 < r.a < 1 and 0 < r.b < 1 for r in nothing.rates or ())


def test_fitted_rates_are_those_of_the_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    voted = weak_rules.votes(weak_rules.measures(docs)).where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words")
    model = weak_rules.fit(voted, len(weak_rules.RULES)).first()
    bad = [r.votes for r in voted.join(labels.where("quality = 0"), F.col("id") == F.col("doc_id")).collect()]
    for k, (rule, rate) in enumerate(zip(weak_rules.RULES, model.rates)):
        said = [v[k] for v in bad if v[k]]
        assert abs(rate.b - said.count(-1) / len(said)) < 0.1, rule.name
        assert 0.9 < rate.a < 1


# --- op4 -------------------------------------------------------------------------------------------------------------


def plain_removal(rows, length):
    first = {}
    order = sorted(rows, key=lambda r: math.inf if r[0] is None else r[0])
    for key, raw in order:
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], math.inf if key is None else key)
    out = []
    for key, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (math.inf if key is None else key):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(key), len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [50, 23])
def test_substrings(spark, monkeypatch, length):
    rng = random.Random(length)
    bits = ["".join(rng.choice("ab é") for _ in range(rng.randint(5, 90))) for _ in range(25)]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 8))) for _ in range(150)] + [None, "", "ab" * 300, "ab" * 200, "a" * 49, "a" * 50, "a" * 51]
    texts += texts[:5]
    ids = [rng.choice([None, *range(400)]) for _ in texts]
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4000)
    found = substrings.remove_repeats(documents(spark, texts, ids), length=length, keep_text=True).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == plain_removal([(k, (t or "").encode()) for k, t in zip(ids, texts)], length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert substrings.remove_repeats(documents(spark, texts).limit(0)).count() == 0


def test_merge_of_transforms():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    shard, value = np.array([rng.randrange(5) for _ in texts]), np.array([rng.randrange(1000) for _ in texts])
    for length in (1, 2, 9, 12):
        best = {}
        for t, v in zip(texts, value):
            for i in range(len(t) - length + 1):
                best[t[i : i + length]] = min(v, best.get(t[i : i + length], v))
        found = bwt.repeated_prefixes(texts, shard, length, value)
        for t, row in zip(texts, found):
            assert row.tolist() == [best[t[i : i + length]] for i in range(max(0, len(t) - length + 1))]


# --- op6 -------------------------------------------------------------------------------------------------------------


def test_packing(spark, real):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = [*real[:60], *ODD, "<|endoftext|> it's İstanbul \x1c é ½ 中文", "don't", "a<|endoftext|>b c<|startoftext|>", "x <|ENDOFTEXT|> é<|endoftext|>é"]
    rows = packing.pack(documents(spark, texts), path, block_tokens=20_000, keep_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.id].append(r), sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        own = sorted(pieces[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids and own[0].doc_tokens == len(ids) // 4
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = sum(r.length for r in own)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(documents(spark, texts).limit(0), path).count() == 0


def test_other_tokenizer_files():
    tokenizers, paths = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    plain = tokenizers.Tokenizer.from_file(paths.path("byte_bpe_50k.json"))
    texts = ["Hello  there\nagain", "", "é <|endoftext|> x"]
    ids = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.word_tokenizer(paths.path("byte_bpe_50k.json"))(texts) == ids


def test_block_costs_are_balanced():
    rng = random.Random(4)
    lengths = [rng.randint(10, 1500) for _ in range(2000)]
    cost, by = packing.Cost(), collections.Counter()
    full = collections.Counter()
    for _, _, n, s, _ in packing.plan_block(lengths):
        by[s] += cost.of(n)
        full[s] += n
    whole = [by[s] for s in by if full[s] == 2048]
    assert max(whole) < 1.6 * sum(whole) / len(whole)


def test_no_document_is_cut_while_a_sequence_has_room():
    rng = random.Random(6)
    lengths = [rng.choice([rng.randint(1, 60), rng.randint(100, 900), rng.randint(900, 5000)]) for _ in range(1500)]
    cost, left = packing.Cost(), sum(lengths) - 2048 * sum((n - 1) // 2048 for n in lengths)
    whole = sum((n - 1) // 2048 for n in lengths)
    free = [2048] * (left // 2048) + [1 << b for b in range(11, -1, -1) if (left % 2048) >> b & 1]
    costs, seen = [0.0] * len(free), collections.Counter()
    for doc, _, n, s, _ in packing.plan_block(lengths)[whole:]:
        want = lengths[doc] - 2048 * ((lengths[doc] - 1) // 2048) - seen[doc]
        able = [i for i in range(len(free)) if free[i] >= want] or [i for i in range(len(free)) if free[i]]
        best = min(able, key=lambda i: (costs[i], i))
        assert (s - whole, n) == (best, min(want, free[best]))
        free[best] -= n
        costs[best] += cost.of(n)
        seen[doc] += n
    assert not any(free)


# --- op7 -------------------------------------------------------------------------------------------------------------


def plain_tree(train, depth, least):
    """(count, probability) functions of a tree that is learned from lists of symbols, context by context."""
    counts = collections.defaultdict(collections.Counter)
    for text in train:
        whole = ["<", *text]
        for j in range(1, len(whole)):
            for k in range(min(depth, j) + 1):
                counts[tuple(whole[j - k : j])][whole[j]] += 1
    root, retained = counts[()], set()

    def probability(context, symbol):
        if not context:
            return (root[symbol] + 1) / (sum(root.values()) + len(root) + 1)
        above = probability(context[1:], symbol)
        if context not in retained:
            return above
        own = counts[context]
        return (own[symbol] + len(own) * above) / (sum(own.values()) + len(own))

    for k in range(1, depth + 1):
        for context in [c for c in counts if len(c) == k]:
            own, n = counts[context], sum(counts[context].values())
            if n >= 2 and sum(c * math.log(c / n / probability(context[1:], s)) for s, c in own.items()) >= least * len(own):
                retained.add(context)
    return root, probability, retained


@pytest.mark.parametrize("depth,chunk,bucket", [(2, 800_000, 400_000), (3, 700, 500), (1, 5000, 100)])
def test_suffix_tree(spark, monkeypatch, real, depth, chunk, bucket):
    monkeypatch.setattr(suffix_tree, "SLICE", 999)
    texts = [*real[:60], *(ODD if chunk > 1000 else [x and x[:3000] for x in ODD]), "the THE the", "never-seen-word", *real[10:13], "a b c a b c a b d " * 9]
    held = F.coalesce(suffix_tree.fold(F.col("doc_id")) == 2, F.lit(False))
    rows = suffix_tree.score_texts(documents(spark, texts), ~held, depth=depth, chunk=chunk, bucket=bucket).collect()
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    train = [split(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, probability, retained = plain_tree(train, depth, suffix_tree.DIVERGENCE)
    total = sum(counts.values())
    assert sorted(r.id for r in rows) == list(range(len(texts))) and any(len(c) == depth for c in retained)
    for r in rows:
        words = split(texts[r.id])
        whole = ["<", *words]
        assert r.train == (zlib.crc32(str(r.id).encode()) % 7 != 2) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(words), sum(counts[w] > 0 for w in words))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in words), rel_tol=1e-9)
        expected = sum(math.log10(probability(tuple(whole[max(0, j - depth) : j]), whole[j])) for j in range(1, len(whole)))
        assert math.isclose(r.score, expected, rel_tol=1e-9)
    for context in [(), *list(retained)[:20]]:  # all symbols and an unseen one
        assert math.isclose(sum(probability(context, s) for s in [*counts, object()]), 1.0, rel_tol=1e-9)
    assert suffix_tree.score_texts(documents(spark, texts).limit(0), F.lit(True)).count() == 0


def test_words_of_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_tree, "SLICE", 64)
    texts = ["One  two\tTHREE", None, "", "x" * 500 + " two", " two ", "é two" + "\u00a0y " * 40, "y" * 70_000, "y" * 69_999 + "z"]
    found, sizes = suffix_tree.symbols(pa.array(texts))
    words = [w for t in texts for w in [*(t or "").encode().lower().split(), None]]
    assert sizes.tolist() == [len((t or "").encode().split()) + 1 for t in texts] and len(found) == len(words)
    by = dict(zip(words, found.tolist()))
    assert [by[w] for w in words] == found.tolist() and len(set(by.values())) == len(by)


# --- op10 ------------------------------------------------------------------------------------------------------------


def plain_tiles(text, item, least):
    in_text, in_item, out = [False] * len(text), [False] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for x in range(len(text)):
            for y in range(len(item)):
                n = 0
                while x + n < len(text) and y + n < len(item) and text[x + n] == item[y + n] and not in_text[x + n] and not in_item[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        n, x, y = best
        if n < least:
            return out
        for k in range(n):
            in_text[x + k] = in_item[y + k] = True
        out.append((x, y, n))


def test_tiling_equals_plain_greedy():
    rng = random.Random(9)
    for _ in range(300):
        text, item = [np.array([rng.randint(1, 4) for _ in range(rng.randint(0, 30))], np.int64) for _ in range(2)]
        assert tiling.tile(text, item, 3) == plain_tiles(text.tolist(), item.tolist(), 3)


def test_tiling_of_long_repetitive_texts():
    words = np.ones(200_000, np.int64)
    assert tiling.tile(words, np.ones(500, np.int64)) == [(0, 0, 500)]
    item = np.concatenate([np.ones(300, np.int64), [2], np.ones(250, np.int64)])
    assert tiling.tile(words, item) == [(0, 0, 300), (300, 301, 250)]


def test_every_item_that_is_covered_is_found(spark):
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghij")
    items = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(30)]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["a b c " * 20_000]
    expected = []
    for i, t in enumerate(texts):
        for j, x in enumerate(items):
            ids = {w: k for k, w in enumerate("abcdefghij", 1)}
            tiles = tiling.tile(*(np.array([ids[w] for w in y.split()], np.int64) for y in (t, x))) if i == 40 else plain_tiles(t.split(), x.split(), 3)
            if sum(n for *_, n in tiles) >= 0.8 * len(x.split()) and tiles:
                expected.append((i, j, sum(n for *_, n in tiles)))
    bench = spark.createDataFrame([(j, x, "clash") for j, x in enumerate([*items, items[0]])], "item_id int, text string, hash string")
    found = tiling.find_contamination(documents(spark, texts), bench, block_bytes=200).collect()
    expected += [(i, 30, n) for i, j, n in expected if j == 0]
    assert sorted((r.id, r.item, r.words) for r in found) == sorted(expected) and len(expected) >= 10


def test_contamination(spark):
    item = "One two three four five. Six seven eight nine ten, eleven twelve thirteen fourteen fifteen sixteen"
    halves = item.split(". ")
    texts = ["before " + item.upper() + " after", f"x {halves[1]} y {halves[0]} z", halves[0] + " other words stand here", None, "", item, item]
    bench = spark.createDataFrame([(5, item, 1), (6, "too short", 1), (None, None, 1)], "item_id int, text string, doc_id int")
    docs = documents(spark, texts)
    for block_bytes in (tiling.BLOCK_BYTES, 60):
        rows = tiling.find_contamination(docs, bench, block_bytes=block_bytes).collect()
        assert sorted((r.id, r.item, r.coverage) for r in rows) == [(0, 5, 1.0), (1, 5, 1.0), (5, 5, 1.0), (6, 5, 1.0)]
        assert sorted(r.doc_id for r in tiling.without_contaminated(docs, bench, block_bytes=block_bytes).collect()) == [2, 3, 4]
    assert tiling.without_contaminated(docs, bench.limit(0)).count() == 7
    assert tiling.find_contamination(docs, bench.limit(0)).count() == 0 and tiling.find_contamination(docs.limit(0), bench).count() == 0


# --- op2 -------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "x"), (2, None, None), (3, "u", ""), (4, "http://b/\r\nEvil: 1", "x"), (None, "n", "x"), (5, "l", "WARC/1.1\r\n\r\nö" * 5000), (7, "r", "same"), (7, "r", "same")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "test")
    rows = warc.archive_and_read(df, scratch).collect()
    assert len(rows) == len(pages)
    text = lambda x: None if x is None else str(x)
    found = sorted((r.metadata.notes["captureId"], r.main.record_type, r.main.digest, text(r.payload_bytes), text(r.refers_to)) for r in rows if r.metadata.notes.get("captureId"))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    expected = [("1", "revisit", digest("x"), "1", "4"), ("2", "revisit", digest(""), "0", "3"), ("3", "response", digest(""), "0", None), ("4", "response", digest("x"), "1", None), ("5", "response", digest(pages[5][2]), str(len(pages[5][2].encode())), None), ("7", "response", digest("same"), "4", None), ("7", "response", digest("same"), "4", None)]
    assert found == expected and all(r.request.id and r.request.target_uri == r.main.target_uri for r in rows)
    bodies = {r.payload for r in warc.read_records(spark, scratch.path("warc"), keep_payload=True).where("record_type = 'response'").collect()}
    assert pages[5][2].encode() in {bytes(b) for b in bodies}
    assert warc.archive_and_read(df.limit(0), Scratch(spark, "test")).count() == 0


def test_long_payloads_and_clashing_columns(spark):
    pages = [(1, "http://h.example:80/a b?q=1", "long " * 2_000_000), (2, "http://u@h/x", "long " * 2_000_000), (3, "http://[", "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "record_id": F.lit(2), "digest": F.lit(3), "main": F.lit(4)})
    rows = {int(r.metadata.notes["captureId"]): r for r in warc.archive_and_read(df, Scratch(spark, "test")).collect()}
    assert [(rows[i].main.record_type, rows[i].payload_bytes, rows[i].refers_to) for i in (1, 2, 3)] == [("revisit", 10_000_000, 2), ("response", 10_000_000, None), ("response", 1, None)]


def test_records_of_any_parts():
    records = [r for k in range(5) for r in warc.capture(k, f"http://h/{k}", b"WARC/1.1\r\n\r\n" * k, k != 3, "http://h/9")]
    whole = warc.BREAK.encode().join(records) + warc.BREAK.encode()
    expected = list(warc.parse([whole]))
    assert len(expected) == 15 and b"GET /2 HTTP/1.1\r\nHost: h\r\n\r\n" in [b for _, b in expected]
    assert [h.get("warc-refers-to-target-uri") for h, _ in expected if h["warc-type"] == "revisit"] == ["http://h/9"]
    for n in (1, 7, 100):
        assert list(warc.parse(whole[i : i + n] for i in range(0, len(whole), n))) == expected


def test_archives_of_others(spark, tmp_path):
    """Several gzip members, cut anywhere; bytes that are no UTF-8; line breaks of all kinds; an archive that is cut off."""
    bodies = [b"\xff\xfe\r\n\r\n\r\r\n\r\n\r\n\x00", b"\r\n\r\n" * 9, b"", b"\r\n\r", "ö\n".encode() * 200_000]
    whole = warc.BREAK.encode().join(r for k, b in enumerate(bodies) for r in warc.capture(k, f"http://h/{k}", b, True, None)) + warc.BREAK.encode()
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(whole[i : i + 777]) for i in range(0, len(whole), 777)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.capture(8, "u", b"left out", True, None)[0][:-1]))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(warc.BREAK.encode().join(warc.capture(9, "u", b"kept", True, None))))
    found = warc.read_records(spark, f"file://{tmp_path}", keep_payload=True)
    assert sorted(bytes(r.payload) for r in found.where("record_type = 'response'").collect()) == sorted([*bodies, b"kept"])
    assert found.count() == 18 and warc.assemble(found).where("request IS NULL OR metadata IS NULL").count() == 0


# --- op5 -------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = lambda k, body: f"<html><head><title>t</title><script>var a='</p>';</script></head><body><header>h{k}</header><nav><ul><li>m</ul></nav><div class='sidebar'>s</div>{body}<div>Imprint line</div><div id='comments'>c{k}</div><footer>f</footer></body></html>"
    rows = [(i, f"https://h.example/{i}", page(i, f"<article><h1>T{i}</h1><p>a&amp;b<b>c</b>\n d<br>e<p>z</article>")) for i in range(6)]
    rows += [(10 + i, f"http://other/{i}", page(i, f"<div><p>Body {i}</p></div>")) for i in range(6)]
    rows += [(20, None, None), (21, "x", ""), (22, "x", "plain < text"), (23, "x", "<p>cut <b>short"), (None, "x", "<style>p{}")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.id: r.text for r in templates.main_text(df).collect()}
    assert out[0] == "T0 a&bc d e z" and out[10] == "Body 0"  # "Imprint line" is in the host's template
    assert (out[20], out[21], out[23], out[None]) == ("", "", "cut short", "")
    assert templates.main_text(df.limit(0)).count() == 0


def test_template_inside_articles_long_slots_and_copies(spark):
    imprint = "Imprint of the house " * 20
    page = lambda body: f"<html><body><div><p>Top</p></div>{body}<div>Foot line</div></body></html>"
    rows = [(i, f"http://a/{i}", page(f"<article><p>Text {i}</p><div class='c-x'><p>Tell your friends</p></div></article>")) for i in range(6)]
    rows += [(10 + i, f"http://b/{i}", page(f"<div class='c-y'><p>Text {i}</p></div><div>{imprint}</div>")) for i in range(6)]
    rows += [(20 + i, f"http://c/{i}", page("<div><p>The same article</p><p>in two parts</p></div>")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.id: r.text for r in templates.main_text(df).collect()}
    assert out[0] == "Text 0" and out[11] == "Text 1"
    assert "The same article in two parts" in out[20] and len(out) == len(rows)


@pytest.mark.parametrize("wrap", ["<div class='text-widget'>{}</div>", "<form id='aspnetForm' method='post'>{}</form>", "<form class='share'><div class='related-banner'>{}</div></form>", "<aside>{}</aside>", "<div>{}</div>"])
@pytest.mark.parametrize("pages", [8, 2])
def test_marks_do_not_hide_an_article(spark, wrap, pages):
    """An article inside what usually holds none, on hosts with a template and without; what is around it stays out."""
    article = lambda i: f"<h1>Title {i}</h1><p>{f'The article of page {i} has many words that no other page has. ' * 40}</p>"
    around = lambda i: f"<nav><a href='/'>Home {i}</a></nav>{wrap.format(article(i))}<div class='comments'><p>{f'Reader {i} says something. ' * 20}</p></div><div class='share'>Share {i}</div><footer>Foot</footer>"
    rows = [(i, f"http://h/{i}", f"<html><body><div>Top</div>{around(i)}<div>Foot line</div></body></html>") for i in range(pages)]
    out = {r.id: r.text for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(pages):
        text = f"Title {i} " + f"The article of page {i} has many words that no other page has. " * 40
        assert text.strip() in out[i] and "Reader" not in out[i] and "Share" not in out[i] and "Home" not in out[i]
        assert pages == 2 or out[i] == text.strip()


def test_marked_inline_text_ends_with_its_element():
    assert templates.extract("<p>One <span class='share'>tweet</span> two</p>") == "One two"
    assert templates.extract("<p>One <span hidden>x</span>two</p><!-- <p>no</p> --><button>b</button>") == "One two"


def test_classes_are_those_of_plain_vectors(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").select(templates.host_of("url").alias("host"), "html")
    extra = [("two", f"<div class='l{'a' if i % 2 else 'b'}'><ul><li>Home</li></ul><h2>T {i}</h2><p>x{i}</p><p>Fixed foot</p><i>{i}</i></div>") for i in range(14)]
    pages = pages.unionByName(spark.createDataFrame([*extra, extra[0], ("two", None)], "host string, html string"))
    found = {}
    for host, html in {(r.host, r.html) for r in pages.collect()}:
        for (kind, path, token, _), n in collections.Counter(templates.parse(html)[0]).items():
            found.setdefault(host, {}).setdefault((kind, token, path), {})[html] = n
    expected, nests = {}, {}
    for host, vectors in found.items():
        most = max(len(v) for (kind, _, _), v in vectors.items() if kind == "tag")
        by = collections.defaultdict(list)
        for key, v in vectors.items():
            if len(v) >= 3 and len(v) >= 0.05 * most:
                by[frozenset(v.items())].append(key)
        valid = [sorted(k[:2] for k in keys) for keys in by.values() if len(keys) >= 3]
        places = {tuple(sorted(k[:2] for k in keys)): min((len(k[2]), k[2]) for k in keys)[1] for keys in by.values() if len(keys) >= 3}
        expected[host] = sorted(valid)
        for own, at in places.items():
            above = [(len(p), o) for o, p in places.items() if at.startswith(p + "/")]
            nests[host, own] = {o for n, o in above if n == max(above)[0]} if above else {None}
    rows = templates.classes(templates.vectors(pages), least_pages=3).collect()
    out, name = collections.defaultdict(list), {}
    for r in rows:
        tokens = tuple((t.kind, t.token) for t in r.tokens)
        out[r.host].append(list(tokens))
        name[r.host, r["class"]] = tokens
    assert {h: sorted(v) for h, v in out.items()} == {h: v for h, v in expected.items() if v} and out["two"]
    assert all(name.get((r.host, r.parent)) in nests[r.host, name[r.host, r["class"]]] for r in rows)


def test_main_text_without_marks(spark, monkeypatch):
    """The template alone finds the articles of real pages: no article element, no word list."""
    monkeypatch.setattr(templates, "BOILERPLATE", re.compile("(?!)"))
    monkeypatch.setattr(templates, "MARKED", 1.0)
    monkeypatch.setattr(templates, "SELDOM", frozenset())
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", templates.host_of("url").alias("host"), "html").collect()
    bare = lambda x: re.sub("<(/?)article>", r"<\1div>", x).replace("<footer>", "<div class='f'>").replace("</footer>", "</div>")
    found = {}
    for r in pages:
        for (kind, path, token, chars), n in collections.Counter(templates.parse(bare(r.html))[0]).items():
            v = found.setdefault((r.host, kind, path, token), [0, 0, 0, 0])
            v[:] = v[0] + 1, v[1] + n, v[2] + n * zlib.crc32(str(r.page_id).encode()), v[3] + n * chars
    rows = spark.createDataFrame([(*k, *v) for k, v in found.items()], "host string, kind string, path string, token string, support long, total long, vector long, weight long")
    known = {r.host: (templates.article_of({e.path: e.weight for e in r.elements}), frozenset(r.fixed)) for r in templates.deduce(rows).collect()}
    checked = 0
    for r in pages:
        if r.host in known:
            plain = templates.extract(re.search("<article>.*</article>", r.html, re.S)[0])
            checked += 1
            assert templates.extract(bare(r.html), *known[r.host]) == plain
    assert checked > 100


def test_odd_pages(spark):
    rows = [(1, "http://h/a", "<div><p>Same</p></div>", 1), (1, "http://h/a", "<div><p>Same</p></div>", 2), (2, "http://h/b", "<p>" + "long words " * 200_000, 3), (3, "http://h/c", "</p></div><<p", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host long").withColumns({"text": F.lit(1), "template": F.lit(2), "id": F.lit(3)})
    out = sorted((r.id, r.text) for r in templates.main_text(df).collect())
    assert [t for i, t in out if i == 1] == ["Same", "Same"] and out[2][1] == ("long words " * 200_000).strip() and len(out) == 4


# --- op1 -------------------------------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    x, counts, labels = rng.normal(size=(12, 5)).astype(np.float32), np.array([3, 4, 5]), np.array([1, 0, 1], np.float32)
    model = quality.train(x, counts, labels, steps=400)
    assert ((model.score(x, counts) > 0.5) == (labels == 1)).all()


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels.where(quality.fold(F.col("doc_id")) != 1))
    held = quality.score(docs, model).join(labels.where(quality.fold(F.col("doc_id")) == 1), F.col("id") == F.col("doc_id")).select(((F.col("score") >= 0.5).cast("int") == F.col("quality")).alias("ok")).collect()
    assert sum(r.ok for r in held) >= 0.97 * len(held)
    odd = quality.score(documents(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(documents(spark, ["a"]), None).collect()} == {0.5}
    assert quality.accepted(documents(spark, ODD), None).count() == len(ODD)


def test_queries_and_pipeline(spark, small):
    import corpus_pipeline

    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    packed = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_near_dedup_stage_takes_pairs_from_fingerprints(spark, monkeypatch):
    """Without bands, pairs whose fingerprints are near still meet and are decided by their sets."""
    import corpus_pipeline

    words = [f"w{i * i % 977}x{i}" for i in range(600)]
    texts = [" ".join(words), " ".join(words[:-1]), " ".join([*words, "more"]), " ".join(f"other{i}" for i in range(300))]
    fps = [simhash.of_hashes(similar.shingle_set(x)) for x in texts]
    assert all((fps[0] ^ x).bit_count() <= similar.BITS for x in fps[1:3]) and (fps[0] ^ fps[3]).bit_count() > similar.BITS
    monkeypatch.setattr(similar, "_candidates", lambda nodes: nodes.sparkSession.createDataFrame([], "a long, b long"))
    docs = documents(spark, texts)
    ids = sorted(r.doc_id for r in docs.collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [ids[0], ids[3]]
