from sectorline.llm import mixing


def test_every_domain_of_the_corpus_has_a_column(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SAMPLE", 30)
    words = {"aa": "alpha anna apart", "bb": "bob ebb bubble", "cc": "cocoa icicle accent", "dd": "dodo add daddy"}
    rows = [(i, words["aa" if i % 2 else "bb"] * 5, "aa" if i % 2 else "bb") for i in range(1000)]
    rows += [(5000 + i, words["cc"] * 5, "cc") for i in range(3)]  # labelled, but hardly ever in a sample of 30
    rows += [(6000 + i, words["dd"] * 5, "dd") for i in range(3)]  # never labelled
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0],) for r in rows if r[2] != "dd"], "doc_id long")
    domains, weights = mixing.classifier(docs, labels, "lang", 30)
    assert domains == ["aa", "bb", "cc", "dd"] and weights.shape == (65536, 4)
    out = mixing.mixed(docs, labels).filter("doc.lang in ('cc', 'dd')").collect()
    assert len(out) == 6 and all(max(r["posterior"], key=r["posterior"].get) == r["doc"]["lang"] for r in out)
