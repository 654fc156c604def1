import corpus_pipeline as C
from tarnmill.llm import rows
from tarnmill.llm.packing import WordBpe
from tarnmill.llm.rows import vocabulary
from tarnmill.llm.secret_scan import scan
from tests.llm import test_jaccard, test_substring


def test_stages(spark, tmp_path):
    words = [f"w{i}" for i in range(500)]
    passage = " ".join(words[100:140])
    texts = {1: " ".join(words[:60]), 2: " ".join(words[:60]), 3: " ".join([*words[:59], "x"]), 4: f"a b {passage} c", 5: f"q {passage} r  s", 6: "token = abcdef123456 rest", 7: None, 8: "", 9: "x y z you moron scum " * 3, 10: "x y z trash you moron scum idiot " * 3}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    bad = [(i, "you moron scum " + " ".join(words[i + 100 : i + 109]), "en", "s", 1) for i in range(100, 130)]
    good = [(i, " ".join(words[i : i + 9]), "en", "s", 1) for i in range(200, 290)]
    docs = docs.unionByName(spark.createDataFrame(bad + good, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(b[0], 1, 1) for b in bad] + [(g[0], 1, 0) for g in good], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    after = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        before, docs = docs, rows.stored(out, "test")
        after[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert not {9, 10} & set(after[name]) and {1, 2, 3, 4, 5, 6, 7, 8} <= set(after[name])
            assert sum(g[0] in after[name] for g in good) == len(good)
        if name == "ngram_jaccard_join":
            want = {d for d, _, c in test_jaccard.brute([(r.doc_id, r.text) for r in before.collect()]) if d == c}
            assert set(after[name]) == want
        if name == "substring_dedup":
            removed = {r[0]: r[2] for r in test_substring.brute([(r.doc_id, r.text) for r in before.collect()])}
            for d, t in after[name].items():
                n = len((t or "").split())
                assert n == len((after["ngram_jaccard_join"][d] or "").split()) - removed[d]
        if name == "secret_scans":
            assert after[name][6] == "[SECRET] rest" and not any(scan(t or "") for t in after[name].values())
    bpe = WordBpe(vocabulary("word_bpe_49k.json"))
    pieces = C.run(spark, str(tmp_path)).collect()
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == {d: len(bpe(t or "")) // 2 + 1 for d, t in after["secret_scans"].items()}
