import public_tokenizers

from tests.llm.helpers import empty, frame, hard_documents
from tessera.llm import langid

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the dog sleeps in the sun while they watch this thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund in der sonne nicht mehr auch",
    "fr": "le rapide renard brun saute par dessus le chien paresseux et puis le chien dort au soleil avec des oiseaux",
}
PATH = public_tokenizers.path("piece_bpe_32k.model")


def labelled(spark):
    rows = [(t + f" {i}", lang) for lang, t in TEXTS.items() for i in range(5)]
    return spark.createDataFrame([*rows, ("ignored", None), (None, "en")], "text string, lang string")


def test_sum_over_segmentations():
    models = langid.Models(["x"], [{"▁": 0.1, "a": 0.2, "b": 0.3, "ab": 0.05, "▁a": 0.04, "": 1e-9}], {"▁", "a", "b", "ab", "▁a"})
    import math

    want = 0.1 * 0.2 * 0.3 + 0.1 * 0.05 + 0.04 * 0.3
    assert abs(math.exp(models.forward("ab")[0]) - want) < 1e-12
    assert math.isfinite(models.forward("ab" * 20000)[0])


def test_fit_sums_to_one():
    prob = langid.fit({"abab": 3, "ab": 5, "q": 1}, {"a", "b", "ab", "▁a", "▁ab", "zz"})
    used = sum(p for k, p in prob.items() if k)
    assert 0.5 < used <= 1.0 and prob["ab"] > prob[""]


def test_languages(spark):
    models = langid.train(labelled(spark), PATH)
    assert models.langs == ["de", "en", "fr"]
    rows = [(1, "the dog and the sun"), (2, "der hund und die sonne"), (3, "le chien et le soleil"), (4, None), (5, "123 ... !"), (6, "²³"), (7, ""), (1, "the dog and the sun")]
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(frame(spark, rows), models).collect())
    assert got == [(1, "en"), (1, "en"), (2, "de"), (3, "fr"), (4, "und"), (5, "und"), (6, "und"), (7, "und")]
    hard = langid.identify(frame(spark, hard_documents()), models).collect()
    assert len(hard) == len(hard_documents()) and all(0 <= r.score <= 1 for r in hard)
    assert langid.identify(empty(spark), models).count() == 0
    none = langid.train(labelled(spark).limit(0), PATH)
    assert langid.identify(frame(spark, rows), none).filter("lang_pred <> 'und'").count() == 0


def test_query_against_brute_force(spark, tmp_path):
    """op5's rows, with every word's probability summed over all its segmentations from the end, each language by itself."""
    import math
    import zlib
    from functools import lru_cache

    rows = [(i, f"{t} {i}" if i % 7 else t.upper(), lang) for i, (lang, t) in enumerate((x for _ in range(8) for x in TEXTS.items()))]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 !", "fr"), (103, "the hund et", None), (None, TEXTS["de"], "de"), (1, rows[1][1], "de"), (104, "word " * 3000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op5_language_id(spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    models = langid.train(spark.createDataFrame([(t, lang) for d, t, lang in rows if not out(d)], "text string, lang string"), PATH)

    def log_prob(word, k):
        s = langid.START + word

        @lru_cache(None)
        def rest(i):
            if i == len(s):
                return 1.0
            return sum((models.table[s[i:j]][k] if models.table.get(s[i:j]) else models.floor[k] if j == i + 1 else 0.0) * rest(j) for j in range(i + 1, len(s) + 1))

        return math.log(rest(0))

    want = []
    for d, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            want.append((d or -1, out(d), "und", 0.0))
            continue
        totals = [sum(log_prob(w, k) for w in langid.words_of(text)) for k in range(3)]
        best = max(range(3), key=lambda k: (totals[k], -k))
        want.append((d or -1, out(d), models.langs[best], round(1 / sum(math.exp(x - totals[best]) for x in totals), 6)))
    assert sorted((r.doc_id or -1, r.held_out, r.lang_pred, round(r.score, 6)) for r in got.collect()) == sorted(want)


def test_copies_do_not_crowd_out_a_language(spark, monkeypatch):
    """A language whose labelled rows are copies of a few texts is learned, and the sample stays bounded."""
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 3)
    rows = [(TEXTS["de"], "de")] * 400 + [(TEXTS["en"] + f" {i}", "en") for i in range(50)] + [(TEXTS["fr"], "fr")] * 9
    models = langid.train(spark.createDataFrame(rows, "text string, lang string"), PATH)
    assert models.langs == ["de", "en", "fr"]


def test_held_out_accuracy(spark):
    import pytest

    from tests.llm.test_queries import SMALL, available

    if not available():
        pytest.skip("the tables are not there")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.op5_language_id(spark, SMALL).filter("held_out").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("n_chars > 60").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) > 0
