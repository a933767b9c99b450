"""Items that are cut, dense in numbers, begin with names, are short or have no blanks."""

import corpus_pipeline
from rostrum.llm import decontaminate

SCHEMA = "doc_id long, text string"


def flagged(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)], SCHEMA)
    out, _ = decontaminate.mark(docs, bench)
    return sorted((r.doc_id, r.template) for r in out.where("contaminated").collect())


def test_rest_of_an_item_after_line_dedup(spark, tmp_path):
    lines = [" ".join(f"{c}{x}" for x in "abcdefghijklmn") for c in ("ka", "lo", "mi")]
    docs = [(1, f"first of all\n{lines[0]}"), (2, "\n".join(lines)), (3, f"else {lines[2][:36]} ends"), (4, "nothing")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "\n".join(lines))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.new_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {r.doc_id: r.text for r in left.collect()}[2] == "\n".join(lines[1:])
    kept = corpus_pipeline.uncontaminated(spark, left, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {3, 4}


def test_items_dense_in_numbers(spark):
    items = ["What is 12 + 35 - 7 times 4", "so Tom pays 3 dollars 5 cents for 7 apples 2 pears", "what is 12 + 35 - 7",
             "from a b to 1 2 3 4 5 6 7 8 9 we go c d"]
    texts = ["so what is 31 + 4 - 26 times 9", "what is 3 + 4 - 5", "today so Ann pays 8 euros 1 cent for 4 apples 6 pears",
             "What is 31 + 4 - 26 over 9", "so Ann pays 8 euros 8 cents for 4 apples 6 pears", "is 3 4 5 and 6 7 8 9",
             "3 4 5 6 7 8 9", "from a b to 9 8 7 6 5 4 3 2 1 we go c d"]
    assert flagged(spark, items[:2], texts) == [(0, True), (2, True)]
    assert flagged(spark, items[2:], texts) == [(0, True), (1, True), (3, True), (7, True)]


def test_names_that_begin_sentences(spark):
    item = "Alice has 12 apples. Bob gives Alice 5 apples. How many apples does Alice have now?"
    other = "Carol has 7 apples. Dave gives Carol 3 apples. How many apples does Carol have now?"
    texts = [other, f"Question: {other}", other.replace("does Carol", "does Erin"), "How many apples does Bob have now?"]
    assert flagged(spark, [item], texts) == [(0, True), (1, True)]


def test_short_items_and_scripts_without_blanks(spark):
    items = ["What is love?", "日本の首都はどこですか。", "กรุงเทพเป็นเมืองหลวง", "猫とは何", "", "..."]
    texts = ["What is love?", "he asked: what is love", "love is what", "問題：日本の首都はどこですか。答え：東京", "日本の首都", "",
             "ถามกรุงเทพเป็นเมืองหลวงตอบ", "これは猫とは何か", "what is", "..."]
    assert flagged(spark, items, texts) == [(0, False), (1, False), (3, False), (6, False), (7, False)]


def test_texts_of_one_id_are_judged_apart(spark):
    item = "if Alice has 12 apples and gives Bob 5 apples then how many apples does Alice have left after 3 days"
    one, two = item.replace("Alice", "Carol").replace("12", "7"), item.replace("Alice", "Erin").replace("12", "9")
    texts = [(None, one), (None, two), (None, "clean"), (None, None), (1, one), (1, two), (1, two), (1, "clean")]
    assert [i for i, _ in flagged(spark, [item], [(i if i else -1, t) for i, t in texts])] == [-1, -1, 1, 1, 1]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    out, _ = decontaminate.mark(spark.createDataFrame(texts, SCHEMA), bench)
    assert sorted(r.text for r in out.where("contaminated and doc_id is null").collect()) == sorted([one, two])
    assert out.count() == len(texts)
