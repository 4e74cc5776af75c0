"""Repeated texts and text ends of few words go."""

from fraudscope.llm import spans


def test_repeated_texts_of_few_words_go(spark):
    short = "Thndouor. Erndsten of reor is erreenou. Oure this."
    texts = [short, "Only once here.", "Two words.", short, "Two  WORDS.", "Another start of some more words than that. And a second sentence. Yes. No. Why?", "Something else at first, also of many words. Yes. No. Why?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_sentences"], list(r["removed"])) for r in spans.span_duplicates(docs).collect()}
    assert got == {0: (3, []), 1: (1, []), 2: (1, []), 3: (3, [0, 1, 2]), 4: (1, [0]), 5: (5, []), 6: (4, [1, 2, 3])}


def test_runs_reach_the_end_of_the_text():
    parts = spans.sentences("A b. C d. E f. G h. I j.")
    assert [r[:2] for r in spans.runs(parts, 3, 12)] == [(0, 5), (1, 4), (2, 3)]
    assert [r[:2] for r in spans.runs(parts[:2], 3, 12)] == [(0, 2)] and spans.runs([], 3, 12) == []
