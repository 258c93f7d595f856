import re
from collections import Counter

import pytest
from tallylens.llm import decontaminate as D

QUESTION = "A train leaves Boston with 120 people and after 3 hours meets another train from Albany carrying 45 km of cable. How many people are left in the first train when 20 step out"


def found(spark, docs, items=((1, QUESTION),)):
    got = D.contaminated(spark.createDataFrame(list(docs), "doc_id long, text string"), spark.createDataFrame(list(items), "item_id long, text string"))
    return {(r.doc_id, r.item_id, r.kind) for r in got.collect()}


def test_exact_and_reparameterised(spark):
    changed = QUESTION.replace("120", "75").replace("Boston", "Leeds").replace("Albany", "York").replace("45 km", "9 miles").replace("20", "11")
    mixed = QUESTION.replace("leaves Boston", "leaves Leeds").replace("from Albany", "from Boston")
    docs = [(1, "Once. " + QUESTION + " The end"), (2, "Some words before. " + changed), (3, "A train leaves early and nobody from Boston cares about it"), (4, mixed), (5, None), (6, "")]
    assert found(spark, docs) == {(1, 1, "exact"), (2, 1, "reparameterised"), (4, 1, "reparameterised")}


def test_inconsistent_slots_are_refused(spark):
    item = "pour 5 cups then wait and pour 5 cups again before the lid closes and 5 bells ring"
    good = item.replace("5", "7")
    bad = "pour 5 cups then wait and pour 7 cups again before the lid closes and 9 bells ring"
    assert found(spark, [(1, good), (2, bad)], [(9, item)]) == {(1, 9, "reparameterised")}


def test_short_items_and_odd_rows(spark, odd, empty):
    items = [(1, "one two three"), (2, "the quick brown fox jumps"), (None, QUESTION), (4, None), (5, "")]
    docs = [(1, "one two three"), (2, "see the quick brown fox jumps over"), (None, QUESTION), (2, "see the quick brown fox jumps over")]
    assert found(spark, docs, items) == {(1, 1, "exact"), (2, 2, "exact"), (None, None, "exact")}
    tiny = [(1, "Zürich"), (2, "7 km"), (3, "to be free"), (4, "be free or not"), (5, "?!")]
    docs = [(1, "In zürich, 7 KM away"), (2, "to be or not free"), (3, "TO BE FREE OR NOT"), (4, "8 km"), (5, "free to be")]
    assert found(spark, docs, tiny) == {(1, 1, "exact"), (1, 2, "exact"), (3, 3, "exact"), (3, 4, "exact")}
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as h", "2 as size", "'x' as slots")
    assert D.contaminated(odd, bench).count() == 0
    assert D.contaminated(empty, bench).count() == 0
    assert D.contaminated(odd, bench.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_items_in_documents_are_found_and_nothing_else(spark, sf):
    d = f"/root/testdata/{sf}"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(r.doc_id, i.item_id) for r in docs.collect() for i in items.collect() if plain(i.text) in plain(r.text)}
    got = Counter((r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect())
    assert set(got) == want and max(got.values()) == 1


def test_copies_in_any_case_and_with_few_literal_words(spark):
    short, numbers = "Name the largest river of the whole continent", "3 5 8 13 21 34 55 89 144 233"
    sparse = "add 11 12 13 14 to 15 16 17 18 then 19 20 21 22 halve 23 24 25 26"
    docs = [(1, "they said Name the largest river of the whole continent again"), (2, "we have 3 5 8 13 21 34 55 89 144 233 there"), (3, "see ADD" + sparse[3:].upper()), (4, "so " + sparse.replace("1", "7")), (5, "1 2 3 4 5 6 7 8 9 10 11 12")]
    assert found(spark, docs, [(1, short), (2, numbers), (3, sparse)]) == {(1, 1, "exact"), (2, 2, "exact"), (3, 3, "exact"), (4, 3, "reparameterised")}


def test_an_edit_in_the_middle_does_not_hide_a_consistent_stretch(spark):
    item = "pour 5 cups then wait and stir it very slowly until the water boils over and then add the other 5 bells"
    doc = item.replace("pour 5", "pour 7").replace("very slowly", "rather well").replace("other 5", "other 9")
    assert found(spark, [(1, doc)], [(9, item)]) == {(1, 9, "reparameterised")}
