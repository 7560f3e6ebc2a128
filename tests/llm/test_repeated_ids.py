"""One row of every component stays, whatever the ids."""



from tempolith.llm import simhash

from .test_text_operators import docs



def test_repeated_and_null_ids_keep_every_component(spark):
    texts = [" ".join(f"{stem}{i}" for i in range(40)) for stem in ("ant", "bee", "cow", "dog", "eel", "fox")]
    a, b, c, d, e, f = texts
    rows = [(5, a), (5, b), (None, c), (None, d), (None, d), (5, e), (7, e), (None, f), (9, f), (9, f)]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect())
    assert kept == sorted([(5, a), (5, b), (0, c), (0, d), (5, e), (9, f)])
