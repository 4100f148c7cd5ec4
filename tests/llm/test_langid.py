import random
import string

import numpy as np

from tessera.llm import langid


def brute(rows, text):
    """Scores of naive Bayes from counts by n-gram bucket, one n-gram at a time."""
    def grams(t):
        t = t.lower()
        for n in (1, 2, 3):
            for i in range(len(t) - n + 1):
                h = 0
                for ch in t[i : i + n]:
                    h = (h * 0x01000193 + ord(ch)) % (1 << 32)
                m = (h + n * 0x3C6EF372) * 0x9E3779B1 % (1 << 32)
                yield (m ^ m >> 15) % langid.BUCKETS
    names = sorted({g for t, g in rows if t is not None and g is not None})
    total = []
    for g in names:
        seen = np.ones(langid.BUCKETS)
        for t, own in rows:
            if own == g and t is not None:
                for b in grams(t):
                    seen[b] += 1
        log = np.log(seen / seen.sum())
        n = sum(own == g and t is not None for t, own in rows)
        total.append(np.log(n / sum(x is not None and y is not None for x, y in rows)) + sum(log[b] for b in grams(text)))
    total = np.array(total)
    return names[int(total.argmax())], 1 / np.exp(total - total.max()).sum()


def test_whole_query_against_brute_force(spark, tmp_path):
    r = random.Random(4)
    kinds = {"aa": "abcde ", "bb": "defgh ", "cc": "ghijk "}
    rows = [(i, "".join(r.choice(kinds[g]) for _ in range(r.randint(1, 40))), g) for i, g in enumerate(r.choices(list(kinds), k=90))]
    rows += [(200, None, "aa"), (201, "12 ½ ² Ⅷ", "bb"), (202, "", None), (203, "Ⅷ", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    from tessera.llm import queries

    got = {x["doc_id"]: x for x in queries.op8_language_id(spark, str(tmp_path)).collect()}
    import zlib

    fold = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    learned = [(t, g) for i, t, g in rows if not fold[i]]
    for i, t, _ in rows:
        assert got[i]["held_out"] == fold[i]
        if i >= 200 or not t.strip():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        name, score = brute(learned, t)
        assert got[i]["lang_pred"] == name and abs(got[i]["score"] - score) < 1e-9


def test_pieces_lose_and_double_no_gram(monkeypatch):
    text = "the quick brown fox jumps"
    whole = np.sort(np.concatenate(list(langid._buckets(text))))
    for piece in (1, 2, 5, 24, 25):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (np.sort(np.concatenate(list(langid._buckets(text)))) == whole).all()


def test_batches_do_not_change_scores(monkeypatch, spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model, texts = langid.train(df), [x["text"] for x in df.select("text").collect()] + [None, "", "123"]
    one = [langid.scores(model, [t]) for t in texts]
    monkeypatch.setattr(langid, "BATCH", 500)
    names, odds, _ = langid.scores(model, texts)
    assert names == [x[0][0] for x in one] and np.allclose(odds, [x[1][0] for x in one])


def test_unlearned_text_is_rejected_and_training_texts_stay(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(1)
    noise = spark.createDataFrame([(10**6 + 4 * i, "".join(r.choice(string.ascii_lowercase + "          ") for _ in range(3000))) for i in range(5)]
                                  + [(10**6 + 101, "これは日本語の文です。" * 30), (10**6 + 102, None)], "doc_id long, text string")
    both = df.unionByName(noise, allowMissingColumns=True)
    kept = {x["doc_id"] for x in langid.keep_identified(both).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10**6]
    assert len(kept) >= 0.99 * df.count()


def test_long_text_clashing_names_repeats_and_empty_table(spark):
    long = "the cat and the dog " * 120_000
    df = spark.createDataFrame([(1, long, "en", "x"), (1, long, "en", "x"), (2, "der Hund und die Katze", "de", "y")], "doc_id long, text string, lang string, __tessera_language string")
    model = langid.train(df)
    out = langid.identify(df, model)
    assert [c for c in out.columns if c in df.columns] == df.columns
    assert sorted((x["doc_id"], x["lang_pred"], x["__tessera_language"]) for x in out.collect()) == [(1, "en", "x"), (1, "en", "x"), (2, "de", "y")]
    assert langid.identify(df.limit(0), model).count() == 0 and langid.keep_identified(df.limit(0)).count() == 0
