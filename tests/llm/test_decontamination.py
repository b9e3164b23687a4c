from gaugeflow.llm import decontamination, registry

ITEM = ("A train leaves Boston at 60 mph and travels 120 miles to Albany while Alice waits in Boston "
        "for 30 minutes before calling Bob about the delay")
OTHER = ITEM.replace("Boston", "Denver").replace("Alice", "Maria").replace("60", "75").replace("120", "300")
MIXED = ITEM.replace("Boston", "Denver", 1)
FILL = "some ordinary words that nobody would ask about in any examination at all "


def found(spark, rows, items, **more):
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id BIGINT, text STRING, item_id INT")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id BIGINT, text STRING, hash STRING")
    result = decontamination.find_contamination(docs, bench, **more).collect()
    kept = decontamination.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in result if not r.contaminated)
    return sorted([(r.doc_id, r.n_items, r.item_id, r.exact) for r in result], key=repr)


def test_templates_and_slots(spark):
    rows = [(1, FILL * 3 + ITEM + ". " + FILL), (2, FILL + "\n" + OTHER), (3, FILL + MIXED), (4, FILL * 9),
            (5, " ".join(ITEM.split()[:9])), (6, ITEM.upper()), (7, FILL + "(" + ITEM + ")!")]
    expected = [(1, 1, 10, True), (2, 1, 10, False), (3, 0, None, False), (4, 0, None, False), (5, 0, None, False),
                (6, 0, None, False), (7, 1, 10, True)]
    items = [(10, ITEM), (11, "What is the capital of the country that lies north of it"), (12, ITEM)]
    assert found(spark, rows, items) == expected
    assert found(spark, rows, items, lookup_windows=0) == expected


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "... !!! " * 50), (4, "word " * 50_000 + ITEM), (None, ITEM), (5, ITEM), (5, ITEM),
            (6, "Is it so")]
    items = [(1, None), (2, ""), (3, "..."), (None, "is it so"), (7, ITEM)]
    assert found(spark, rows, items) == sorted([
        (1, 0, None, False), (2, 0, None, False), (3, 0, None, False), (4, 1, 7, True), (None, 1, 7, True),
        (5, 1, 7, True), (5, 1, 7, True), (6, 1, None, True)], key=repr)
    assert found(spark, rows, []) == sorted([(i, 0, None, False) for i, _ in rows], key=repr)
    assert found(spark, [], items) == []


def test_items_dense_in_slots_are_found_verbatim(spark):
    sums = "Compute 12 + 30 * 4 - 7"
    table = "Take 3 4 5 6 7 8 9 10 11 12 13 14 15 and add them"
    items = [(1, sums), (2, table)]
    rows = [(1, FILL + ". " + sums + ". " + FILL), (2, FILL + ". " + table), (3, FILL + ". Compute 13 + 31 * 5 - 8"),
            (4, FILL + ". Take 1 2 1 2 1 2 1 2 1 2 1 2 1 and go")]
    expected = [(1, 1, 1, True), (2, 1, 2, True), (3, 0, None, False), (4, 0, None, False)]
    assert found(spark, rows, items) == expected
    assert found(spark, rows, items, lookup_windows=0) == expected


def test_numbers_that_coincide_or_fall_apart(spark):
    item = "A box holds 12 red balls and 12 blue balls so how many of the 30 places stay free"
    rows = [(1, item.replace("30", "12")), (2, item.replace("12", "14", 1)), (3, item.replace("12", "30"))]
    assert found(spark, rows, [(1, item)]) == [(1, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False)]


def test_small_letters_and_openings(spark):
    apples = "Tom has 5 apples and eats 2"
    pasted = "Red foxes cross the frozen river"
    items = [(1, ITEM), (2, apples), (3, pasted)]
    rows = [(1, FILL + ITEM.lower()), (2, FILL + ". Peter has 7 apples and eats 3."),
            (3, FILL + "where Peter has 7 apples and eats 3."), (4, FILL + "Red foxes cross the frozen river " + FILL),
            (5, FILL + ". The has 7 apples and eats 3."), (6, FILL + ". Blue foxes cross a frozen river")]
    expected = [(1, 1, 1, True), (2, 1, 2, False), (3, 1, 2, False), (4, 1, 3, True), (5, 0, None, False),
                (6, 0, None, False)]
    assert found(spark, rows, items) == expected
    assert found(spark, rows, items, lookup_windows=0) == expected


def test_query_finds_the_planted_items(spark):
    sf = "/root/testdata/sf0.01"
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held = {}
    for i, t in texts:
        flat = " ".join(t.split())
        hits = [k for k, item in items if " ".join(item.split()) in flat]
        if hits:
            held[i] = len(hits)
    result = registry.QUERIES["op4_decontamination"](spark, sf).collect()
    assert len(result) == len(texts) and held
    assert {r.doc_id: r.n_items for r in result if r.contaminated} == held
