"""Whitening, best-fit packing and conversation repair against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rostrum import llm
from rostrum.llm import bestfit, minplus, repair
from rostrum.llm.polar import eigen
from rostrum.llm.whitening import whiten
from rostrum.llm.word_ids import Memory, WordEndIds
from tests.llm.conftest import SMALL

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ---- whitening

@pytest.mark.parametrize("d", [1, 2, 3, 17, 64])
def test_eigenvectors_by_polar_factors(d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(3 * d, d)) * np.logspace(0, -3, d)
    a = x.T @ x
    values, vectors = eigen(a)
    w, u = np.linalg.eigh(a)
    assert np.allclose(values, w[::-1], rtol=1e-10, atol=1e-13 * w[-1])
    assert np.allclose(np.abs((u[:, ::-1] * vectors).sum(axis=0))[:4], 1, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)


def test_equal_and_zero_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    for spectrum in ([7] * 3 + [2] * 10 + [0] * 17, [0] * 30, [1] * 30, [5] + [0] * 29):
        a = q @ np.diag(np.array(spectrum, float)) @ q.T
        values, vectors = eigen((a + a.T) / 2)
        assert np.allclose(values, sorted(spectrum, reverse=True), atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(30), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-12)


def whole(v):
    return [int(np.floor(float(c) * 256)) for c in v]


def plain_whitening(vectors, most=4):
    x = np.array(sorted({tuple(whole(v)) for v in vectors}), object)
    n, s = len(x), x.sum(axis=0)
    c = np.array([[float(a * n - b) / n for a, b in zip(r, s)] for r in x])
    w, u = np.linalg.eigh(c.T @ c / n)
    keep = np.argsort(-w)[:most]
    return n, s, w[keep], u[:, keep], w.sum()


def test_whitening_of_all_vectors(spark, small):
    rows = {r.vec_id: r.embedding for r in small("embeddings").collect()}
    n, s, w, u, trace = plain_whitening(rows.values())
    got = {}
    for r in llm.queries()["op11_whitening"](spark, SMALL).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(rows) and all(sorted(g) == [1, 2, 3, 4] for g in got.values())
    want = np.array([[(a - float(b) / n) for a, b in zip(whole(rows[i]), s)] for i in sorted(rows)]) @ u / np.sqrt(w)
    mine = np.array([[got[i][k].whitened for k in (1, 2, 3, 4)] for i in sorted(rows)])
    assert np.allclose(np.abs((want * mine).sum(axis=0)), np.linalg.norm(want, axis=0) ** 2)
    assert np.allclose(mine * np.sign((want * mine).sum(axis=0)), want, atol=1e-9)
    for i, g in got.items():
        exact = sum((n * a - b) ** 2 for a, b in zip(whole(rows[i]), s))
        for k, r in g.items():
            assert (r.n, r.deviation) == (n, exact)
            assert abs(r.explained - w[k - 1] / trace) < 1e-12 and 0 <= r.identity_error < 1e-9


def test_whitening_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [1.0, 2.0], [0.5, -1.0], [3.0, 0.0], [1e12, 4.0], None, [None, 1.0], [nan, 1.0],
               [inf, 1.0], [1e300, 1.0], [1.0], [], [0.0, 0.0]]
    df = spark.createDataFrame(
        [(i, v, "a", 1, i) for i, v in enumerate(vectors)] + [(None, [2.0, 2.0], "b", 2, 99)],
        "vec_id long, embedding array<double>, whitened string, x_ int, key int",
    )
    out, model, names = whiten(df)
    assert out.columns == [*df.columns, "deviation", "_whitened"] and names == ["deviation", "_whitened"]
    rows = {r.key: r for r in out.collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 12, 99} and rows[0][5:] == rows[1][5:]
    n, s, w, u, trace = plain_whitening([vectors[i] for i in (0, 2, 3, 4, 12)] + [[2.0, 2.0]])
    assert model.n == n == 6 and model.sums == list(s)
    assert np.allclose(model.values / w, 1) and all(len(r["_whitened"]) == 2 for r in rows.values())
    exact = sum((n * a - b) ** 2 for a, b in zip(whole(vectors[4]), s))
    assert rows[4].deviation == (exact if exact < 1 << 63 else None)
    # Without spread, without rows, and with empty vectors only.
    same, model, _ = whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>"))
    assert [r.whitened for r in same.collect()] == [[None, None]] * 3
    assert model.explained() == [None, None] and model.identity_error is None
    for given in ([], [(1, [])], [(1, None)]):
        got, model, _ = whiten(spark.createDataFrame(given, "vec_id long, embedding array<float>"))
        assert model is None and [r.whitened for r in got.collect()] == [[]] * (given == [(1, [])])


def test_a_repeated_vector_counts_once(spark):
    rng = np.random.default_rng(2)
    some = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(40, 5)))]
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>")
    hot = df.unionAll(df.where("vec_id = 0").crossJoin(spark.range(20_000)).select("vec_id", "embedding"))
    _, a, _ = whiten(df)
    out, b, _ = whiten(hot.repartition(7))
    assert (a.n, a.sums) == (b.n, b.sums) and np.allclose(a.values, b.values)
    assert out.count() == 20_040


# ---- best-fit packing

def least_bins(items, capacity):
    """Branch and bound over all ways."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            at = bins.index(room)
            go(i + 1, [*bins[:at], room + items[i], *bins[at + 1:]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_the_reduction_keeps_the_optimum():
    random.seed(3)
    extra = 0
    for _ in range(400):
        capacity = random.choice([12, 20, 31])
        items = [random.randint(1, capacity) for _ in range(random.randint(0, 10))]
        lengths = bestfit.Lengths(Counter(items), capacity)
        fixed = bestfit.reduce_by_dominance(lengths)
        rest = [n for n in range(capacity + 1) for _ in range(lengths.left[n])]
        assert sum(t for _, t in fixed) + least_bins(rest, capacity) == least_bins(items, capacity)
        kinds = fixed + bestfit.best_fit(lengths)
        assert Counter(n for m, t in kinds for n in m * t) == Counter(items)
        assert all(sum(m) <= capacity for m, _ in kinds)
        extra += sum(t for _, t in kinds) - least_bins(items, capacity)
    assert extra <= 4


def test_the_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(0)
    n = np.minimum(2048, rng.lognormal(6, 1.2, 1_000_000).astype(int) + 1)
    small = {int(k): int(c) for k, c in zip(*np.unique(n, return_counts=True))}
    big = {k: c * 10**6 + 17 for k, c in small.items()}
    for counts in (small, big):
        rows, sequences = bestfit.plan(counts)
        assert len(rows) < 20_000
        floor = -(-sum(k * c for k, c in counts.items()) // 2048)
        assert floor <= sequences <= 1.001 * floor
        for length, c in counts.items():
            own = sorted(r[1:3] for r in rows if r[0] == length)
            assert own[0][0] == 0 and own[-1][1] == c - 1
            assert all(a[1] + 1 == b[0] for a, b in zip(own, own[1:]))


def check_packing(rows, texts, capacity=2048):
    """`rows`: doc, piece, start, length, crc, sequence, offset; `texts`: (doc, text)."""
    tokenizer, want = Tokenizer.from_file(WORD_BPE), Counter()
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for i, start in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[start:start + capacity], "<u4").tobytes()
            want[doc, i, start, len(own) // 4, zlib.crc32(own)] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r[5], []).append((r[6], r[3]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()]
        assert sum(n for _, n in own) <= capacity
    return len(places)


def test_every_document_is_packed_with_the_tokenizers_ids(spark, small):
    rows = llm.queries()["op12_bestfit"](spark, SMALL).collect()
    used = check_packing(rows, [(r.doc_id, r.text) for r in small("documents").collect()])
    left = sorted((r.length for r in rows), reverse=True)
    bins = []  # first fit, longest first
    for n in left:
        at = next((i for i, b in enumerate(bins) if b + n <= 2048), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert -(-sum(left) // 2048) <= used <= len(bins)


ODD = ["", None, "one two", "Two  blanks\n\n and a\ttab ", "don't WE'LL it's 12345 a1b2", "<|endoftext|> is <| special",
       "nul \x00 byte \x1c\x1f split", "ΟΔΟΣ Σίσυφος İstanbul ﬁ ½ ²", "été ñ", "汉字 かな 한국어", "a" * 3000,
       "!!! ... ---", "🙂🙂 ok", "x " * 5000, "caf\xe9\xa0cr\xe8me line", "ªº µ ß ǅ ŉ"]


def test_ids_of_odd_texts_equal_the_tokenizers():
    tokenizer, ids = Tokenizer.from_file(WORD_BPE), WordEndIds(WORD_BPE)
    for texts in ([t or "" for t in ODD], [t or "" for t in ODD][::-1]):
        for text, own in zip(texts, ids(texts)):
            assert np.frombuffer(own, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_new_words_equal_the_tokenizers(small):
    random.seed(4)
    letters = "abcdefghijklmnopqrstuvwxyzéèüñçABC'.,!-019s"
    words = ["".join(random.choice(letters) for _ in range(random.randint(1, 25))) for _ in range(20_000)]
    words = list(dict.fromkeys(words + [w for r in small("documents").collect() for w in r.text.split()]))
    ids, tokenizer = WordEndIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    want = tokenizer.encode_batch_fast(words, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.words(words)] == [e.ids for e in want]


def test_memory_forgets_words_that_do_not_come_back():
    asked = []

    def encode(words):
        asked.extend(words)
        return [w.encode() for w in words]

    memory = Memory(encode, most=10)
    for i in range(100):
        assert memory([["often", f"once{i}"]]) == [f"oftenonce{i}".encode()]
    assert asked.count("often") == 1 and len(asked) == 101
    assert len(memory.young) + len(memory.old) <= 26


def test_bestfit_of_awkward_rows(spark):
    texts = [*enumerate(ODD), (1, "one two"), (1, "one two"), (None, "no id"), (None, None)]
    df = spark.createDataFrame(
        [(i, t, 7, 8) for i, t in texts], "doc_id long, text string, length int, offset int").repartition(3)
    parts = bestfit.pieces(df, WORD_BPE, capacity=64, with_ids=True)
    packed = bestfit.pack(parts, 64)
    columns = ["doc", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing(packed.select(*columns).collect(), texts, 64)
    for r in bestfit.sequences(packed).collect():
        assert len(r.tokens) == r.used <= 64
    assert bestfit.pack(bestfit.pieces(df.where("false"), WORD_BPE)).count() == 0


def test_many_equal_documents_fill_their_sequences(spark):
    df = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    packed = bestfit.pack(bestfit.pieces(df.repartition(5), WORD_BPE))
    places = packed.groupBy("sequence_id").agg(F.count("*").alias("n"), F.countDistinct("offset").alias("o"))
    assert sorted(r.n for r in places.collect()) == [30_000 % 512] + [512] * (30_000 // 512)
    assert places.where("n <> o").count() == 0


# ---- conversation repair

def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """Rows of one conversation in order: the summary, by keeping the least way to each state."""
    seen, faults, symbols = set(), Counter(), []
    for _, role, text in rows:
        cut = text.strip(" \t\n\x0b\x0c\r")
        fault = ("blank" if not cut else "duplicate" if (role, text) in seen
                 else "truncated" if cut[-1] not in ".!?" else "")
        seen.add((role, text))
        faults[fault] += 1
        symbols.append((role, text, fault))
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": ""}}
    # After a pair no system turn may follow, so that state is told apart from the beginning.
    follow["p"] = {"u": "u"}
    follow["u"] = {"a": "p"}
    names = {"u": "user", "a": "assistant"}

    def least(ways, state, way):
        if state not in ways or way < ways[state]:
            ways[state] = way

    def insert(ways):
        for _ in range(3):
            for state, (c, e, r) in list(ways.items()):
                for i in "ua":
                    if i in follow[state]:
                        least(ways, follow[state][i], (c + 3, e + "I", r + (f"{names[i]}:",)))
        return ways

    ways = insert({"": (0, "", ())})
    for role, text, fault in symbols:
        after = {}
        for state, (c, e, r) in ways.items():
            least(after, state, (c + 4, e + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if role[:1] in follow[state]:
                least(after, follow[state][role[:1]], (c + more, e + "K", r + (f"{role}:{text}",)))
            for i in "ua":
                if i in follow[state]:
                    least(after, follow[state][i], (c + 3 + more, e + "R", r + (f"{names[i]}:{text}",)))
        ways = insert(after)
    cost, audit, written = min(ways[s] for s in ("", "p") if s in ways)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(written).encode()).hexdigest())


def order_of(spark, rows):
    """Rows by turn (nulls first), role and the hashes of their texts."""
    hashes = {r.text: (r.h1, r.h2) for r in spark.createDataFrame(
        [(t,) for t in {r[3] for r in rows} | {""}], "text string").select("text", *repair.hashes()).collect()}
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashes[r[3]]))


def expected(spark, given, damage=True):
    rows = plain_damage(given) if damage else given
    return {conv: plain_repair([r[1:] for r in order_of(spark, [r for r in rows if r[0] == conv])])
            for conv in {r[0] for r in given}}


CONVERSATION = "conv_id long, turn long, role string, text string"


def some_rows(seed, convs, most, least=1):
    random.seed(seed)
    texts = ["Yes.", "No", "Why?", "", "  \t", None, "Well!", "a\nb.", "end. ", "\xa0", "Yes.", "so", "then."]
    out = []
    for c in convs:
        for _ in range(random.randint(least, most)):
            role = random.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown", "User"])
            out.append((c, random.choice([None, *range(-2, most)]), role, random.choice(texts)))
    return out


def test_repair_of_random_conversations(spark):
    given = some_rows(1, [None, *range(60)], 14)
    rows = repair.damaged(spark.createDataFrame(given, CONVERSATION).repartition(5))
    got = {r[0]: tuple(r[1:]) for r in repair.repair(rows).collect()}
    assert got == expected(spark, given)


def test_repair_of_conversations_cut_between_tasks(spark):
    """Few long conversations over many ranges: each is cut, and chained again."""
    given = some_rows(2, [7, 8, 9], 400, 300)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = repair.damaged(spark.createDataFrame(given, CONVERSATION))
        stretches = repair.edits(repair.symbols(rows)).groupBy("conv").count().collect()
        assert min(r["count"] for r in stretches) >= 3
        got = {r[0]: tuple(r[1:]) for r in repair.repair(rows).collect()}
        turns = repair.repaired_turns(rows).orderBy("conv", "place").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == expected(spark, given)
    for conv in got:
        text = "\n".join(f"{r.role}:{r.text}" for r in turns if r.conv == conv)
        assert hashlib.sha256(text.encode()).hexdigest() == got[conv][-1]
        initials = "".join(r.role[:1] for r in turns if r.conv == conv)
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_repair_of_a_long_run(spark):
    """One row repeated folds to a count; equal faults in a row are one run."""
    same = spark.range(100_000).select(
        F.lit(1).cast("long").alias("conv"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"),
        F.lit("Hello.").alias("text"), F.lit(1).cast("long").alias("copies"))
    users = spark.range(3000).select(
        F.lit(2).cast("long").alias("conv"), "id", F.lit("user"), F.concat(F.col("id").cast("string"), F.lit(".")),
        F.lit(1).cast("long"))
    rows = same.unionAll(users)
    assert repair.symbols(rows).where("conv = 1").count() == 1
    got = {r[0]: r for r in repair.repair(rows).collect()}
    assert got[1].duplicate == 99_999 and got[1].audit == "K" + "D" * 99_999 + "I" and got[1].illegal == 99_999
    want = plain_repair([(i, "user", f"{i}.") for i in range(3000)])
    assert tuple(got[2][1:]) == want


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert repair.repair(repair.damaged(empty)).count() == 0
    gone = next((c, 0) for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair.repair(repair.damaged(spark.createDataFrame([(*gone, "user", "Hi.")], CONVERSATION))).first()
    assert tuple(row) == (gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_powers_equal_steps():
    random.seed(6)
    for _ in range(200):
        syms = [random.randrange(16) for _ in range(4)]
        counts = [random.randint(1, 40) for _ in syms]
        steps = minplus.UNIT
        for s, n in zip(syms, counts):
            for _ in range(n):
                steps = minplus.times(steps, minplus.power(s, 0))
        assert minplus.stretch(syms, counts) == steps
        _, cost, end = minplus.unroll(syms, counts, minplus.AT_END, minplus.NOTHING, True)
        assert end in (minplus.NOTHING, minplus.PAIR)
        assert cost == minplus.apply(steps, minplus.to_end(True, minplus.AT_END))[minplus.NOTHING]


# ---- harmonic packing

def test_little_padding_at_every_length():
    from rostrum.llm.packing import class_counts, cut
    counts = class_counts()
    for n in range(1, 1025):
        parts = cut(n)
        assert sum(length for length, _ in parts) == n
        assert all(counts[k] * length <= 1024 for length, k in parts)
        shares = sum(1024 / counts[k] for _, k in parts)
        assert 1 - n / shares <= 1 / 32


def test_packed_ids_equal_the_tokenizers(spark, small):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in small("documents").collect()}
    got = llm.queries()["op9_packing"](spark, SMALL).collect()
    for r in got:
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert (len(own) // 4, zlib.crc32(own), r.doc_tokens) == (r.length, r.ids_crc32, len(ids[r.doc_id]))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))


def test_short_documents_are_packed_with_little_padding(spark):
    from rostrum.llm.packing import CAPACITY, pack
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), (F.col("id") % 70).cast("int")).alias("text"))
    from rostrum.llm.bound import document_pieces
    packed = pack(document_pieces(df))
    used, n = packed.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert 1 - used / (n * CAPACITY) < 0.05


def test_byte_ids_of_odd_texts(small):
    from rostrum.llm.packing import ids_of
    ids = ids_of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                 public_tokenizers.PATTERN)
    random.seed(5)
    texts = [t or "" for t in ODD] + ["".join(random.choice("ab c\n\n  \t'sé.!?漢\x85\xa0 1 9<|") for _ in range(200)) for _ in range(500)]
    want = ids.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.many(texts)] == [e.ids for e in want]


# ---- toxicity

def test_equal_texts_score_the_same(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    scores = {}
    for r in llm.queries()["op10_toxicity"](spark, folder).collect():
        scores.setdefault(texts[r.doc_id], set()).add(r.score)
    assert len(texts) > len(scores) and all(len(s) == 1 for s in scores.values())


def test_terms_speak_for_either_label(spark):
    from rostrum.llm import toxicity
    rows = [(i, ("bad" if i % 2 else "good") + " common", i % 2) for i in range(40)]
    sample = spark.createDataFrame(rows, "id long, text string, y int")
    # Equal terms go by name; "bad" is too short for a beginning of its own.
    assert toxicity.choose_terms(sample, 2) == ["^goo", "bad"]
    assert {"bad", "good"} <= set(toxicity.choose_terms(sample))


def test_counts_are_of_all_terms_of_all_words():
    from rostrum.llm import toxicity
    counts = toxicity.Counts(["bad", "^bad", "good"])
    for text, want in (("Bad badly good, bad", {0: 2, 1: 1, 2: 1}), ("", {}), (None, {}), ("none", {})):
        keys, n = counts(text)
        assert dict(zip(keys.tolist(), n.tolist())) == want


def test_most_texts_of_the_table_have_evidence(spark):
    rows = llm.queries()["op10_toxicity"](spark, "/root/testdata/sf0.01").select("evidence").collect()
    assert np.mean([bool(r.evidence) for r in rows]) > 0.85


def test_held_out_toxicity_beats_the_majority(spark):
    """On the held-out fifth of labelled rows: order, recall and precision."""
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in llm.queries()["op10_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    y, s = np.array([toxic[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + (s[y == 1][:, None] == s[y == 0][None, :]).mean() / 2
    recall, wrong = (s[y == 1] >= 0.5).mean(), (s[y == 0] >= 0.5).mean()
    print(len(rows), int(y.sum()), "AUC", above, "recall", recall, "false alarms", wrong)
    assert above > 0.95 and recall > 0.85 and wrong < 0.05


def test_a_repeated_id_is_one_example(spark):
    from rostrum.llm import toxicity
    docs = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("bad "), F.col("id").cast("string")).alias("text"))
    sample = toxicity.sample_of(docs, spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int"))
    assert [tuple(r) for r in sample.collect()] == [(1, "bad 0", 1)]
