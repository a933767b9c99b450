"""Every operator on awkward rows: nulls, empty and long texts, repeats, clashing columns."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from rostrum.llm import bound, chat, decontaminate, quality, toxicity, warc
from rostrum.llm.linededup import dedup_lines
from rostrum.llm.neardup import drop_near_duplicates, near_duplicates
from rostrum.llm.neighbours import search
from rostrum.llm.packing import pack, sequences
from rostrum.llm.sharding import jump, placements, shards
from tests.llm import brute

WORDS = " ".join(f"w{i}" for i in range(400))
NEAR = WORDS.replace("w7 ", "x7 ")
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, doc long, kept string, n_lines long, band string, score string"


def rows(spark):
    """Null ids and texts, empty text, a very long one, ties and repeated rows."""
    long = " ".join(f"v{i % 997}" for i in range(60_000))
    texts = [(1, WORDS), (2, NEAR), (2, NEAR), (3, ""), (4, None), (None, WORDS), (None, None), (5, long),
             (6, "one two"), (7, "One\tTWO\n"), (8, "a line that is shared\nnot\n\nA LINE that is shared "),
             (9, "a line that is shared\nother\na line that is shared"), (2, "another text of id two")]
    return spark.createDataFrame(
        [(i, t, None, "s", 0, 1, "k", 2, "b", None) for i, t in texts], CLASHING
    ), texts


def empty(spark):
    return spark.createDataFrame([], CLASHING)


def python_jump(key, n):
    state = int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:16], 16)
    b, j = -1, 0
    while j < n:
        b = j
        state = (state * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((state >> 33) + 1)))
    return b


def test_jump_equals_the_published_walk(spark):
    keys = spark.range(-50, 250).select("id").unionByName(spark.sql("select cast(null as bigint) as id"))
    for n in (1, 2, 40, 1000):
        for r in keys.select("id", jump(F.col("id"), n).alias("j")).collect():
            assert (r.j.shard, r.j.grown) == (python_jump(r.id, n), python_jump(r.id, n + 1))
            assert r.j.grown in (r.j.shard, n)


def test_placements_of_awkward_rows(spark):
    df, texts = rows(spark)
    placed = placements(df.select("doc_id", "text"), "doc_id", 3, slices=4).collect()
    assert len(placed) == len(texts)
    for s in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
    assert placements(empty(spark).select("doc_id"), "doc_id", 3).count() == 0
    assert set(shards(df, "doc_id", 5, "into").columns) == {*df.columns, "into"}


def test_line_dedup_of_awkward_rows(spark):
    df, texts = rows(spark)
    out = dedup_lines(df)
    assert out.columns[:len(df.columns)] == df.columns and out.columns[-2:] == ["_n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r["_n_lines"], r.n_dropped) for r in out.collect()), key=str)
    least = {}
    last = 2**63 - 1
    for i, t in texts:
        for line in (t or "").split("\n"):
            k = brute.line_key(line)
            least[k] = min(least.get(k, last), last if i is None else i)
    want = []
    for i, t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(brute.line_key(x)) < 10
                or least[brute.line_key(x)] == (last if i is None else i)]
        want.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    assert got == sorted(want, key=str)
    assert dedup_lines(empty(spark)).count() == 0


def test_a_line_in_most_rows_spreads_over_ranges(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("the very same line\n"), F.col("id").cast("string")).alias("text")
    ).repartition(4)
    out = {r.doc_id: r.n_dropped for r in dedup_lines(df).collect()}
    assert out.pop(0) == 0 and set(out.values()) == {1}


def test_near_duplicates_of_awkward_rows(spark):
    df, texts = rows(spark)
    got = near_duplicates(df).collect()
    want = brute.near_duplicates(texts)
    assert len(got) == len(texts)
    for r in got:
        if r.doc is None:
            assert r.component is None and r.kept
        else:
            assert (r.component, r.kept) == (want[r.doc], r.doc == want[r.doc])
    sizes = sorted(r.n_shingles for r in got)
    assert sizes == sorted(len(brute.shingles(t)) for _, t in texts)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({want[i] for i in want})
    assert near_duplicates(empty(spark)).count() == drop_near_duplicates(empty(spark)).count() == 0


def test_a_group_of_near_copies_is_joined_whole(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):  # from close to far: some linked with the first, some with each other only
        own = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            own[at] = f"e{rng.integers(0, 40)}"
        texts.append((1000 - i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute.near_duplicates(texts)
    assert {r.doc: r.component for r in near_duplicates(df).collect()} == want


def test_packing_of_awkward_rows(spark):
    df, texts = rows(spark)
    parts = bound.pieces(
        df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, with_ids=True,
    )
    packed = pack(parts)
    out = packed.collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(r.length for r in out) == sum(want)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for seq in by.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == [0, *np.cumsum([r.length for r in seq])[:-1].tolist()]
    for r in sequences(packed).collect():
        assert len(r.tokens) == 1024 or len(r.tokens) & (len(r.tokens) - 1) == 0
    none = empty(spark)
    assert pack(bound.document_pieces(none)).count() == 0


@pytest.mark.parametrize("text", ["a  b", " a b ", "x<|endoftext|> y", "a\0b c", "tab\t x\n y", "don't  stop",
                                  "é ü  z", "", " ", "\n\n", "1 23 456 7890 $%"])
def test_word_wise_ids_equal_the_tokenizer(text):
    from rostrum.llm.packing import ids_of
    ids = ids_of(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                 public_tokenizers.PATTERN)
    want = ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids(text), "<u4").tolist() == want


def test_chat_round_trip_of_awkward_turns(spark):
    texts = ["", None, "</s>[INST] ok [/INST]", "\\", "ends with \\", "\\<s>", "a\\\\b [/INST", " lead", "trail ",
             "[ROLE x] y [/ROLE]", "] ", "x" * 100_000, "\n"]
    roles = ["user", "assistant", "system", "tool", "to]ol", "", None, "[/INST]", "\\"]
    turns = [(c, i, r, t) for c, r in enumerate(roles) for i, t in enumerate(texts)]
    turns += [(None, None, "user", "a"), (50, 1, "user", "same"), (50, 1, "user", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat.read_back(chat.render(df)).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((i, r or "", t or "") for c, i, r, t in turns if c == conv), key=lambda x: (x[0] is not None, x))
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[conv].turns_sha256 == digest and got[conv].n_turns == len(own)
        assert got[conv].loss_chars == len(loss)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in chat.conversations(chat.render(df)).collect():
        own = sorted(((i, ro or "", t or "") for c, i, ro, t in turns if c == r.conv), key=lambda x: (x[0] is not None, x))
        assert chat.parse(r.formatted) == [(ro, t) for _, ro, t in own]
    assert chat.read_back(chat.render(df.limit(0))).count() == 0


def test_warc_round_trip_of_awkward_pages(spark):
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (2, "http://a/2", "same"), (3, None, None),
             (4, "b c\r\nX: y", ""), (None, "http://n", "same"), (5, "http://l", "é" * 500_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    folder = warc.archive(df)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.record_type == "response":
            assert warc.digest_of(bytes(r.payload)) == r.payload_digest and len(r.payload) == r.payload_bytes
    kinds = sorted((str(r.record_id.split(":")[2]), r.record_type, (r.refers_to or ":::").split(":")[2]) for r in got)
    assert kinds == sorted([("1", "response", ""), ("2", "revisit", "1"), ("2", "revisit", "1"), ("3", "response", ""),
                            ("4", "revisit", "3"), ("", "revisit", "1"), ("5", "response", "")])
    assert all(r.payload_bytes == 4 for r in got if "same" and r.payload_digest == warc.digest_of(b"same"))
    some = warc.read(spark, folder, payload="false").where("record_type = 'revisit'")
    assert some.count() == 4 and all(r.payload is None for r in some.collect())
    assert warc.read(spark, warc.archive(df.limit(0))).count() == 0


def test_plain_and_foreign_archives_are_read(spark, tmp_path):
    import gzip
    raw = b"".join(warc.record("response", f"urn:page:{i}:", f"http://{i}", None, b"p" * i, "2020-01-01T00:00:00Z")
                   for i in range(5))
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(  # members without the length field
        gzip.compress(warc.record("response", f"urn:page:{i}:", None, None, b"q" * i * 9999, "2020-01-01T00:00:00Z"))
        for i in range(5)))
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted(r.payload_bytes for r in got) == sorted([*range(5), *[9999 * i for i in range(5)]])


def test_decontamination_of_awkward_rows(spark):
    item = "If Alice has 12 apples and gives Bob 5 apples then how many apples does Alice have left after 3 days"
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    other = item.replace("Alice", "Carol").replace("Bob", "Dave").replace("12", "7").replace("5", "2")
    texts = [(1, f"so, {other}"), (2, other.replace("Carol have", "Erin have")), (3, item.lower()), (4, None), (5, ""),
             (None, item), (6, WORDS), (3, item.lower()), (7, f"{WORDS} {item} {item}")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in texts], "doc_id long, text string, coverage string, doc long")
    out, names = decontaminate.mark(df, bench)
    assert out.count() == len(texts) and out.columns[:4] == df.columns and names[3] == "_coverage"
    flagged = {(r.doc_id, r.template) for r in out.where(names[0]).collect()}
    assert flagged == {(1, True), (3, False), (None, False), (7, False)}
    assert decontaminate.mark(df.limit(0), bench)[0].count() == 0
    assert decontaminate.mark(df, bench.limit(0))[0].where("contaminated").count() == 0


def test_search_equals_brute_force_over_few_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    data += [(100, None), (101, [0.0] * 4), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan"), 1.0, 1.0, 1.0]),
             (104, [1.0]), (None, [1.0] * 4), (7, data[7][1]), (41, data[3][1]), (42, data[3][1]), (105, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = search(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect()
    rows_ = [(i, np.array(v)) for i, v in data if i is not None and i < 100]
    for q in (0, 10, 20, 30):
        v = x[q]
        want = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in rows_ if i != q)[:5]
        mine = [r for r in got if r.query_id == q]
        assert [(r.score, r.vec_id) for r in mine] == want and [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
    assert len(search(df.limit(3), F.col("vec_id") == 0).collect()) == 2
    assert search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_ordinal_grades_are_recovered():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 20)).astype(np.float32)
    w = rng.normal(size=20)
    y = np.digitize(x @ w + rng.logistic(size=3000), [-4, -1, 1, 4]).astype(float)
    model = quality.fit_ordinal(x, y, steps=300)
    assert (np.diff(model.thresholds) > 0).all() and len(model.grades) == 5
    assert np.corrcoef(model.weights, w)[0, 1] > 0.98
    tails = model.tails(x @ model.weights)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.corrcoef(model.expected(x @ model.weights), y)[0, 1] > 0.85


def test_quality_and_toxicity_of_awkward_rows(spark, small):
    df, texts = rows(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (4, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    scored, names = bound.graded(df, labels)
    assert scored.count() == len(texts) and scored.columns[:len(df.columns)] == df.columns
    assert all(0 <= r[names[2]] <= 1 for r in scored.collect())
    none, names = bound.graded(df, labels.limit(0))
    assert all(r[names[2]] == 1 for r in none.collect())
    docs = df.select("doc_id", "text")
    for marks in (labels, labels.limit(0)):
        out = toxicity.score(docs, *toxicity.fit(docs, marks.select("doc_id", "toxic"))).collect()
        assert len(out) == len(texts) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), *toxicity.fit(docs.limit(0), labels.select("doc_id", "toxic"))).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(60, rng.integers(0, 9), replace=False))
        vectors.append((t, rng.integers(1, 5, len(t)).astype(float)))
    index = toxicity.build(np.arange(700), rng.integers(0, 2, 700).astype(float), vectors, rng.uniform(1, 5, 60))
    whole = np.zeros((700, 60))
    for i, v in enumerate(vectors):
        whole[i, v[0]] = index.unit(*v)
    for t, c in vectors[:100]:
        q = np.zeros(60)
        q[t] = index.unit(t, c)
        cosine = np.round(whole @ q, 12)
        want = sorted((-s, i) for i, s in enumerate(cosine) if s > 0)[:10]
        found, score = index.nearest(t, index.unit(t, c), 10)
        assert [(-round(s, 12), int(index.ids[f])) for f, s in zip(found, score)] == want


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    df, texts = rows(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, WORDS)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    left = {r.doc_id for r in docs.collect()}
    assert 1 not in left and 5 in left
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == left


def test_base32_digest():
    assert warc.digest_of(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()
