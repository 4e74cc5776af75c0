"""Clean rows that share an id with a contaminated one stay."""

from fraudscope.llm import decontam

LEAK = "one two three four five six seven eight nine ten eleven twelve"


def test_clean_rows_of_a_contaminated_id_stay(spark):
    texts = [(None, LEAK), (None, "clean text without an id"), (None, None), (7, "x " + LEAK), (7, "clean text of seven"), (7, ""), (8, LEAK), (8, LEAK), (9, "clean"), (9, "clean")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    bench = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench)
    order = lambda found: sorted(found, key=lambda r: tuple((x is not None, x) for x in r))
    assert kept.columns == docs.columns
    assert order(tuple(r) for r in kept.collect()) == order(t for t in texts if LEAK not in (t[1] or ""))


def test_scan_tells_its_rows_in_one_pass_and_in_several(spark):
    docs = spark.createDataFrame([(1, LEAK), (1, "clean"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{LEAK} {i}") for i in range(9)], "item_id long, text string")
    one, more = ({(r["doc_id"], bytes(r["row"]), len(r["hits"])) for r in decontam.scan_benchmark(docs, bench, block_windows=b, with_row=True).collect()} for b in (200_000, 2))
    assert one == more and len(one) == 3
