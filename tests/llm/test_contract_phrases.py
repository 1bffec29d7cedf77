"""The contract's phrases as it states them, not as the operator holds them."""

from lodestone.llm import licenses


def test_base_places_of_the_stated_phrases(spark):
    texts = {
        1: "the MIT license",
        2: "Under the MIT-License; under the mit license",
        3: "not under the mit licenses, under mit license",
        4: "Apache License, Version 2.0 and CC BY-NC",
        5: None,
    }
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    base = {i: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for i, r in got.items()}
    assert base == {1: (3, 0, None, None, ""), 2: (8, 2, 0, 4, "mit"), 3: (8, 0, None, None, ""), 4: (9, 2, 0, 6, "apache-2,cc-by-nc"), 5: (0, 0, None, None, "")}
