"""Readiness of documents: one link must hold each chunk, and tasks hash numbers instead of sorting rows."""

from larkspur.operators import clauses


def test_one_link_of_the_own_product(spark):
    docs = spark.createDataFrame([(d, "v", "L", 0) for d in range(6)], "doc_id long, version_id string, version_label string, open_reviews int")
    chunks = spark.createDataFrame([(0, 1, "A", "v", 1, 2), (1, 1, "A", "v", 1, 2), (2, 1, "A", "v", 1, 2), (3, 1, "A", "v", 5, 6), (4, 1, "A", "v", 1, 1), (4, 1, "A", "v", 2, 2)], "doc_id long, chunk_id long, product_id string, version_id string, first_page int, last_page int")
    links = spark.createDataFrame([(0, "A", 1, 3), (1, "B", 1, 3), (2, "A", 1, 3), (2, "B", 2, 3), (3, "A", 1, 3), (4, "A", 1, None), (5, "A", 1, 1)], "doc_id long, product_id string, first_page int, last_page int")
    df = clauses.publish_readiness(docs, chunks, links)
    assert {r["doc_id"]: r["blocking"] for r in df.collect()} == {0: "", 1: "product_boundary_ambiguous", 2: "product_boundary_ambiguous", 3: "product_boundary_ambiguous", 4: "", 5: "product_binding_missing"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan
