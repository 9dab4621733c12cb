"""Language identification, toxicity and the pipeline on small planted tables."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from postloom.llm import langid, toxicity

SYLLABLES = {"aa": ["ba", "do", "ki", "re"], "bb": ["xu", "zy", "qo", "vi"], "cc": ["éa", "ño", "üs", "çe"]}


def sentence(choose, lang, n):
    return " ".join("".join(choose.choice(SYLLABLES[lang]) for _ in range(choose.randint(1, 4))) for _ in range(n))


def corpus(n=240):
    choose = random.Random(5)
    return [(i, sentence(choose, lang, choose.randint(20, 60)).capitalize(), lang)
            for i, lang in zip(range(n), itertools.cycle(SYLLABLES), strict=False)]


def test_languages_and_rejection(spark):
    rows = corpus(1800)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = langid.learn(docs)
    assert models.languages == ["aa", "bb", "cc"] and set(models.bounds) == {"aa", "bb", "cc"}
    junk = [(3000, "qwrtpsdfg hjklmnbvc wrtzpplkjh " * 20, None), (3001, None, "aa"), (3002, "", None), (3003, "12 ?!", None),
            (3004, "BADOKI " * 20000, None), (None, "xuzy qovi xuzy", None)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows + junk, docs.schema), models).collect()}
    assert all(found[i].lang_pred == lang and not found[i].rejected for i, _, lang in rows)
    assert found[3000].rejected
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (3001, 3002, 3003))
    assert found[3004].lang_pred == "aa" and found[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in found.values())


def test_a_rare_language_lets_no_junk_through(spark):
    """Four documents of one language beside many of the others: junk goes to it, and is rejected all the same."""
    choose = random.Random(11)
    rows = [r for r in corpus(900) if r[2] != "cc"] + [(5000 + i, sentence(choose, "cc", 50), "cc") for i in range(4)]
    random_letters = lambda letters: " ".join("".join(choose.choices(letters, k=6)) for _ in range(60))
    junk = [(7000 + i, random_letters(x), None) for i, x in enumerate(["qwrtpsdfghjklmnbvcz", "αβγδεζηθικλμ", "的一是不了人我在有他"] * 4)]
    more = [(8000 + i, sentence(choose, "cc", 50), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models = langid.learn(docs)
    assert set(models.bounds) == set(models.languages) == {"aa", "bb", "cc"}
    assert np.isfinite(list(models.bounds.values())).all()
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows + junk + more, docs.schema), models).collect()}
    assert all(found[i].rejected for i, _, _ in junk)
    assert not any(found[i].rejected for i, _, _ in rows + more)
    assert all(found[i].lang_pred == "cc" for i, _, _ in more)


def test_one_document_of_every_language(spark):
    docs = spark.createDataFrame([r for r in corpus(9)][3:6], "doc_id bigint, text string, lang string")
    models = langid.learn(docs)
    assert set(models.bounds) == set(models.languages) and np.isfinite(list(models.bounds.values())).all()


def test_probabilities_add_up(spark):
    """Over all characters that follow a context, the interpolated model sums to one."""
    models = langid.learn(spark.createDataFrame(corpus(60), "doc_id bigint, text string, lang string"))
    points = [ord(c) for c in "badokirexuzyqovéañüsçe"]
    points = sorted({*points, 0})
    for context in ([0, 0, 0], [0, ord("b"), ord("a")], [ord("x"), ord("u"), ord("z")], [1, 2, 3]):
        packed = context[0] << 42 | context[1] << 21 | context[2]
        values = models.log_probability(4, np.full(len(points), packed), np.array(points))
        assert np.allclose(np.exp(values).sum(axis=0), 1, atol=0.02)


def test_no_learning_documents(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    rows = langid.identify(docs, langid.learn(docs)).collect()
    assert [(r.lang_pred, r.rejected) for r in rows] == [("und", True)]
    assert langid.identify(docs.limit(0), langid.learn(docs.limit(0))).count() == 0


def test_kernel_is_the_sum_over_subsequences():
    def weights(word):
        out = {}
        for at in itertools.combinations(range(len(word)), 3):
            key = "".join(word[i] for i in at)
            out[key] = out.get(key, 0) + 0.6 ** (at[-1] - at[0] + 1)
        return out

    for a, b in (("idiot", "idxiot"), ("aaaa", "aabaa"), ("abc", "cba"), ("worthless", "wrthles")):
        left, right = weights(a), weights(b)
        want = sum(left[k] * right.get(k, 0) for k in left)
        got = toxicity.subsequence_kernel(toxicity.coded([a])[0], toxicity.coded([b])[0])[0]
        assert np.isclose(got, want, rtol=1e-4)


def test_a_letter_in_every_gap_is_seen():
    choose = random.Random(12)
    words = ["idiot", "trash", "pathetic", "worthless", "moron", "stupid"]
    landmarks = toxicity.Landmarks([f(w) for w in words for f in (toxicity.marked, lambda w: toxicity.marked(w[:4], False))])
    gaps = lambda w: "".join(c + choose.choice("bgjkqvxz") for c in w[:-1]) + w[-1]
    for k, word in enumerate(words):
        seen = landmarks.similar([gaps(word) for _ in range(60)])[:, 2 * k : 2 * k + 2].any(axis=1)
        assert seen.mean() >= 0.9
    assert not landmarks.similar(["window", "the", "of", ""]).any()


def test_values_of_the_method():
    assert (toxicity.LEAST, toxicity.SAMPLE) == (0.3, 20_000)


def labelled(n=300):
    choose = random.Random(1)
    rows = []
    for i in range(n):
        words = sentence(choose, "aa", 60).split()
        toxic = i % 5 == 0
        if toxic:
            for at in choose.sample(range(60), 4):
                words[at] = choose.choice(["gruntox", "slimefel"])
        rows.append((i, ". ".join(" ".join(words[k : k + 10]) for k in range(0, 60, 10)), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    machine = toxicity.learn(docs, toxicity.learning_labels(labels))
    extra = [(900, None), (901, ""), (902, "gruntox slimefel"), (903, "g r u n t o x badoki. And s.l.i.m.e.f.e.l dokire"),
             (904, "grunxtox badoki grunntox slimeefel"), (905, "badoki " * 30000), (None, "dokire")]
    found = toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in rows] + extra, docs.schema), machine).collect()
    score = {r.doc_id: r for r in found}
    held = [(score[i].predicted, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(p == x for p, x in held)
    assert [score[i].predicted for i in (900, 901, 902, 903, 904, 905, None)] == [0, 0, 1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in found)


def test_one_class_only(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(6)], "doc_id bigint, text string")
    for toxic in (0, 1):
        labels = docs.select("doc_id", F.lit(toxic).alias("toxic"))
        assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()} == {float(toxic)}
    none = toxicity.learn(docs, docs.select("doc_id", F.lit(0).alias("toxic")).limit(0))
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    choose = random.Random(2)
    passage = sentence(choose, "aa", 70)
    rows = labelled(200)
    docs = [(i, t, "aa", "s", len(t)) for i, t, _ in rows]
    docs += [(300 + k, f"{sentence(choose, 'aa', 80)} {passage} {sentence(choose, 'aa', 80)}", "aa", "s", 1) for k in range(2)]
    docs += [(400, docs[1][1], "aa", "s", 1), (500, None, None, None, None), (501, "", "aa", "s", 0), (502, "12 34", "aa", "s", 5)]
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    folder = str(tmp_path / "tables")
    spark.createDataFrame(docs, kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet"
    )
    at = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, folder).write.parquet(f"{folder}/out{number}")
        at = spark.read.parquet(f"{folder}/out{number}")
        kept.append({r.doc_id: r for r in at.collect()})
        if number < 4:
            assert at.schema == spark.createDataFrame([], kind).schema
    toxic = {i for i, _, x in rows if x}
    assert set(kept[0]) == {d[0] for d in docs} - toxic
    assert set(kept[1]) == set(kept[0]) - {500, 501, 502}
    assert set(kept[2]) == set(kept[1]) - {400}
    assert passage in kept[3][300].text and passage not in kept[3][301].text
    assert kept[3][301].n_chars == len(kept[3][301].text)
    assert set(kept[4]) == set(kept[3])
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == at.count()
