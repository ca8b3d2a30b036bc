"""What must hold of the queries without SQL, over the smallest tables."""

from pyspark.sql import functions as F

from siltstone.llm import contamination, queries, tokenize
from siltstone.sources.tables import table


def test_token_ids_give_the_texts_back(spark, data):
    with open(tokenize.VOCABULARY, "rb") as f:
        encoder = tokenize.BytePairEncoder(f.read())
    ids = {r.doc_id: r.ids for r in queries.p7_ids(spark, data).collect()}
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").select("doc_id", "text").collect()}
    assert ids.keys() == texts.keys()
    for i, t in texts.items():
        assert b"".join(encoder.bytes[x] for x in ids[i]).decode() == (t or "")
        assert bool(ids[i]) == bool(t)


def test_spans_cut_what_leaked(spark, data):
    docs = table(spark, data, "documents").select("doc_id", "text")
    found = {(r.doc_id, r.item_id) for r in queries.p8_found(spark, data).collect()}
    spans = queries.p8_spans(spark, data).join(docs, "doc_id").collect()
    assert found and {a for a, _ in found} == {r.doc_id for r in spans}
    items = {r.item_id: set(contamination.words(r.text)) for r in table(spark, data, "eval_item").collect()}
    last = {}
    for r in sorted(spans, key=lambda r: (r.doc_id, r.doc_from)):
        assert 0 <= r.doc_from < r.doc_to <= len(r.text) and r.doc_from > last.get(r.doc_id, -1)
        last[r.doc_id] = r.doc_to
        cut = contamination.readings(r.text[r.doc_from : r.doc_to])[-1][0]
        own = set().union(*(items[i] for d, i in found if d == r.doc_id))
        assert len(cut) >= contamination.MIN_WORDS - contamination.SLACK - 3 and sum(w in own for w in cut) >= 0.6 * len(cut)
    # with the spans cut out, nothing is left to find
    left = docs.collect()
    cuts = {}
    for r in spans:
        cuts.setdefault(r.doc_id, []).append((r.doc_from, r.doc_to))
    rest = []
    for r in left:
        text = r.text
        for a, b in sorted(cuts.get(r.doc_id, []), reverse=True):
            text = text[:a] + "\n\n" + text[b:]
        rest.append((r.doc_id, text))
    again = contamination.leaks(spark.createDataFrame(rest, docs.schema), table(spark, data, "eval_item"), queries.work_dir(spark, "again"))
    assert again.count() == 0


def test_pages_are_told_by_their_scores(spark, data):
    scores = queries.p9_scores(spark, data)
    assert scores.count() == table(spark, data, "documents").count() == scores.select("doc_id").distinct().count()
    assert scores.where("stuffed_share < 0 or stuffed_share > 1 or stuffed_shapes < 0").count() == 0
    want = {r.doc_id for r in scores.where(F.col("stuffed_share") > 0.5).collect()}
    assert {r.doc_id for r in queries.p9_found(spark, data).collect()} == want and want


def test_error_rates_are_those_stated(spark, data):
    rows = queries.p2_error_rate(spark, data).collect()
    assert rows and sum(r.wrong for r in rows) <= 2 and all(r.filters == 0 or 0 < r.stated_rate < 1e-3 for r in rows)
    exact, approx = {r.key: r.n for r in queries.p6_exact(spark, data).collect()}, {r.key: r for r in queries.p6_counts(spark, data).collect()}
    assert exact == {k: r.n for k, r in approx.items()} and all(r.approx_n >= r.n for r in approx.values())
