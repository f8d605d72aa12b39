from gleanery.operators.headers import edit_documents, set_translation_fields

DOC = '---\nid: "1"\ntitle: "@me - Old"\ntags: []\nnote: ""\nextract: "full"\n---\n\n# Old\n\ntitle: "not a header"\n'


def edit(spark, document, title=None, tags=None, note=None):
    docs = spark.createDataFrame([("1", "https://a/(b)", "@me - Old", document)], "id string, source string, title string, document string")
    change = spark.createDataFrame([("1", title, tags, note)], "id string, title string, tags array<string>, note string")
    return edit_documents(docs, change).first().document


def test_edits_touch_only_their_lines(spark):
    assert edit(spark, DOC) == DOC
    assert edit(spark, DOC, note="a\nb") == DOC.replace('note: ""', 'note: "a\\nb"')
    assert edit(spark, DOC, tags=["x", "y"]) == DOC.replace("tags: []", 'tags: ["x", "y"]')
    assert edit(spark, DOC, title="@me - New") == DOC.replace("@me - Old", "@me - New").replace("# Old", "# New")
    mine = DOC.replace("# Old", "# My own")
    assert edit(spark, mine, title="T") == mine.replace('"@me - Old"', '"T"')
    link = DOC.replace("# Old", "[@me - Old](https://a/%28b%29)")
    assert edit(spark, link, title="T [x]") == link.replace('"@me - Old"', '"T [x]"').replace("[@me - Old]", "[T \\[x\\]]")
    assert edit(spark, "no header", title="T") is None
    assert edit(spark, DOC.replace('note: ""\n', ""), note="n") is None


def test_translation_fields(spark):
    def run(document, lang, to, state):
        return set_translation_fields(
            spark.createDataFrame([("1", document, lang, to, state)], "id string, document string, lang string, translated_to string, translation string")
        ).first().document

    added = run(DOC, " en-US ", "zh-TW", "partial")
    assert added == DOC.replace('extract: "full"', 'extract: "full"\nlang: "en"\ntranslated_to: "zh-Hant"\ntranslation: "partial"')
    assert run(added, "fr", "zh-TW", "complete") == added.replace('"en"', '"fr"').replace('"partial"', '"complete"')
    assert run(added.replace('lang: "en"\n', ""), "en", "zh-TW", "partial") == added
    assert run(added, "", "", None) == DOC
