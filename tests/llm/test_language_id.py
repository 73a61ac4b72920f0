from gridspark.llm import language_id as L

SAMPLE = {
    "en": "the weather is fine and we are going to the market with our friends to buy bread and apples ",
    "de": "das wetter ist schön und wir gehen mit unseren freunden zum markt um brot und äpfel zu kaufen ",
    "fr": "le temps est beau et nous allons au marché avec nos amis pour acheter du pain et des pommes ",
}


def corpus(spark):
    rows = [(10 * i + k, s[i % 20 :] + s[: i % 30] * 2, lang, "x") for k, (lang, s) in enumerate(SAMPLE.items()) for i in range(40)]
    rows += [(9001, None, "en", "x"), (9002, "", "de", "x"), (9003, "12 34 !?", "fr", "x"), (9004, SAMPLE["de"], None, "x"), (9005, SAMPLE["en"] * 4000, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_held_out_accuracy_and_odd_rows(spark):
    docs = corpus(spark)
    model = L.fit(docs, usable=~L.held_out(L.F.col("doc_id"), 4, 2))
    assert sorted(model.names) == ["de", "en", "fr"]
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert len(got) == docs.count()
    right = [got[d].lang_pred == lang for d, lang in ((r.doc_id, r.lang) for r in docs.where("doc_id < 9000").collect())]
    assert all(right)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (9001, 9002, 9003))
    assert got[9004].lang_pred == "de" and got[9005].lang_pred == "en" and got[9005].accepted
    assert all(0 <= r.score <= 1 for r in got.values())


def test_smallest_size_wins(spark):
    model = L.fit(corpus(spark))
    compressors = model.compressors()
    for text in ("wir gehen zum markt", "avec nos amis", "going to the market"):
        sizes = [len(c.compress(L.prepared(text))) for c in compressors]
        assert L.judge(text, model, compressors)[0] == model.names[sizes.index(min(sizes))]


def test_narrow_margin_is_rejected(spark):
    model = L.fit(corpus(spark), margin=0.9)
    assert not L.judge("und the", model, model.compressors())[3]


def test_empty_table(spark):
    docs = corpus(spark).limit(0)
    model = L.fit(docs)
    assert model.names == [] and L.identify(docs, model).count() == 0
    assert L.identify(corpus(spark).limit(3), model).first().lang_pred == "und"


def test_results_equal_brute_force(spark):
    """Every dictionary built and every size taken outside Spark."""
    import zstandard

    docs = corpus(spark)
    rows = docs.collect()
    model = L.fit(docs, dictionary_bytes=3000)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", L.F.xxhash64("doc_id", L.F.lit(3)).alias("h")).collect()}
    known = [r for r in rows if r.lang and r.text and any(map(str.isalpha, r.text))]
    dictionaries = {}
    for lang in sorted({r.lang for r in known}, key=lambda x: (-sum(r.lang == x for r in known), x)):
        mine = sorted((len(r.text.encode()) + 1 > 750, hashes[r.doc_id], r.text) for r in known if r.lang == lang)
        whole = " " + "\n".join(t for _, _, t in mine).lower() + " "
        dictionaries[lang] = whole.encode()[:3000].decode("utf-8", "ignore").encode()
    assert model.names == list(dictionaries) and model.dictionaries == list(dictionaries.values())
    made = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in dictionaries.values()]
    for d in made:
        d.precompute_compress(level=7)
    made = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False) for d in made]
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for r in rows:
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id].lang_pred == "und"
            continue
        sizes = [len(m.compress(f" {r.text.lower()} ".encode())) for m in made]
        least = min(sizes)
        assert got[r.doc_id].lang_pred == model.names[sizes.index(least)]
        assert abs(got[r.doc_id].score - 1 / sum(2.718281828459045 ** -min(60, (x - least) / least**0.5) for x in sizes)) < 1e-9


def test_every_language_is_learnt(spark):
    """300 languages; one text of each, and no language falls out."""
    word = lambda k: "".join(chr(0x4E00 + (k * 37 + i * 11) % 5000) for i in range(40))
    docs = spark.createDataFrame([(k, word(k) * 3, f"l{k:03d}") for k in range(300)], "doc_id long, text string, lang string")
    model = L.fit(docs, all_bytes=300 * 1000)
    assert sorted(model.names) == [f"l{k:03d}" for k in range(300)] and max(map(len, model.dictionaries)) <= 1000
    assert {r.doc_id: r.lang_pred for r in L.identify(docs.limit(20), model).collect()} == {r.doc_id: r.lang for r in docs.limit(20).collect()}


def test_a_dictionary_ends_with_a_character():
    assert L.cut("aé".encode(), 2) == b"a" and L.cut("aé".encode(), 3) == "aé".encode()


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, SAMPLE["en"], "en", 5, "x")] * 3, "doc_id long, text string, lang string, _h long, _n string")
    assert [(r.doc_id, r.lang_pred) for r in L.identify(docs, L.fit(docs)).collect()] == [(1, "en")] * 3
