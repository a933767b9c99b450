"""The bound queries over the whole small tables, against SQL or plain Python."""

import hashlib

import numpy as np
import pytest

from rostrum import llm
from tests.llm import brute
from tests.llm.conftest import SMALL
from tests.oracle import compare, duck

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), duck(SMALL), SQL[name]) is None


def test_sharding_stays_native(spark):
    plan = QUERIES["op1_sharding"](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "ArrowEval"))


def test_near_dedup_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in small("documents").collect()]
    want = brute.near_duplicates(rows)
    got = QUERIES["op2_near_dedup"](spark, SMALL).collect()
    assert {r.doc_id: (r.component_id, r.kept) for r in got} == {i: (c, i == c) for i, c in want.items()}


def test_neighbours_reach_the_recall(spark, small):
    rows = sorted((r.vec_id, r.embedding) for r in small("embeddings").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    got = QUERIES["op3_neighbours"](spark, SMALL).collect()
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = [r for r in got if r.query_id == q]
        assert len(mine) == 10
        hits, total = hits + len(want & {r.vec_id for r in mine}), total + 10
    assert hits / total >= 0.9


def test_decontamination_equals_word_windows(spark, small):
    docs = [(r.doc_id, r.text) for r in small("documents").collect()]
    items = [(r.item_id, r.text) for r in small("benchmark").collect()]
    want = brute.contaminated(docs, items)
    got = {r.doc_id for r in QUERIES["op5_decontamination"](spark, SMALL).where("contaminated").collect()}
    assert got == want


def test_warc_equals_the_pages(spark, small):
    first, pages = {}, small("pages").collect()
    for r in pages:
        first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    got = {r.page_id: r for r in QUERIES["op7_warc"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    for r in pages:
        g, lead = got[r.page_id], first[r.html or ""]
        assert g.payload_bytes == len((r.html or "").encode())
        assert (g.record_type, g.refers_to) == (("response", None) if lead == r.page_id else ("revisit", lead))


def test_packing_holds_every_id_once(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in QUERIES["op9_packing"](spark, SMALL).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in small("documents").collect():
        n = len(tokenizer.encode(d.text, add_special_tokens=False).ids) + 1
        own = sorted(got[d.doc_id], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
        assert sum(r.length for r in own) == n == own[0].doc_tokens
    used = {}
    for own in got.values():
        for r in own:
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 1024


def test_quality_and_toxicity_on_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = QUERIES["op4_quality"](spark, folder).collect()
    assert len(out) == 1000
    right = [(r.kept == bool(labels[r.doc_id].quality)) for r in out if r.doc_id in labels]
    assert np.mean(right) > 0.95
    out = QUERIES["op10_toxicity"](spark, folder).collect()
    for r in out:
        assert r.held_out == (brute.crc(r.doc_id) % 5 == 0) and r.predicted == (r.score >= 0.5)
    right = [r.predicted == labels[r.doc_id].toxic for r in out if r.held_out and r.doc_id in labels]
    assert np.mean(right) > 0.9


def test_digests_are_lower_case_hex(spark):
    row = QUERIES["op8_chat"](spark, SMALL).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.loss_chars == len(text)
