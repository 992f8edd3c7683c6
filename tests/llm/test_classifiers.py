import random
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from tensorloom.llm import langid, toxicity

WORDS = {"aa": ["the", "and", "thing", "house", "water", "there"], "bb": ["der", "und", "schicht", "haus", "wasser", "nicht"]}


def rows(rng, n, insults=("idiot", "scum", "moron", "trash")):
    made = []
    for i in range(n):
        lang, toxic = rng.choice(["aa", "bb"]), int(rng.random() < 0.3)
        words = [rng.choice(WORDS[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(20, 300))]
        for _ in range(toxic * (1 + len(words) // 60)):
            words[rng.randrange(len(words))] = rng.choice(insults)
        made.append((i, " ".join(words), lang, toxic))
    return made


def test_toxicity(spark):
    made = rows(random.Random(1), 900)
    df = spark.createDataFrame([(i, t, "x") for i, t, _, _ in made] + [(None, None, "x"), (5000, "", "x"), (5001, "?!", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in made] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(df, toxicity.fit_documents(df, labels)).collect()}
    assert all(got[i].score == 0 and got[i].predicted == 0 for i in (None, 5000, 5001))
    held = [(got[i], y) for i, _, _, y in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) - len(held) <= 2
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.97
    model = toxicity.fit([(y, t) for _, t, _, y in made])
    odd, plain = toxicity.score(pa.array(["the house and the idioot water", "the house and the thing water"], pa.large_string()), model)
    assert odd > 0.3 > plain  # a misspelling never seen
    assert toxicity.score_documents(df, toxicity.fit_documents(df, labels.where("toxic > 5"))).where("score <> 0").isEmpty()
    assert toxicity.score_documents(df.where(F.lit(False)), model).count() == 0


def test_language(spark):
    made = rows(random.Random(2), 600)
    extra = [(None, None, None), (5000, "", "aa"), (5001, "12 !", "aa"), (5002, "ΩΨ ΔΦ ΞΣ", None), (5003, "the x " * 20000, None)]
    df = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in made] + extra, "doc_id long, text string, lang string")
    model = langid.fit_documents(df)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (None, 5000, 5001))
    assert got[5002].rejected and got[5003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i], lang) for i, _, lang, _ in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(r.lang_pred == lang for r, lang in held) / len(held) > 0.98
    kept = langid.language_filter(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.values() if not r.rejected}
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identify(nothing, langid.fit_documents(nothing)).where("lang_pred <> 'und'").isEmpty()


SYLLABLES = {"aa": "the and ing er th on re at ou st ly in", "bb": "der ung ein sch ge en zu ich eit ver auf ö", "cc": "ción os la que es ar do mi ez ll ua ñ"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_language_rejects_what_it_has_not_learned():
    rng = random.Random(3)
    made = [(lang, prose(rng, lang, rng.choice([3, 10, 30, 100, 300, 600]))) for lang in SYLLABLES for _ in range(150)]
    rng.shuffle(made)
    known, rest = made[:300], made[300:]

    def rejected(texts, model):
        return langid.predict(pa.array(texts, pa.large_string()), model)[2]

    model = langid.fit(known)
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(n)) for n in (5, 20, 100, 500, 2000, 10000)]
    assert rejected(letters, model).all()
    assert not rejected([t for _, t in rest], model).any()
    for out in SYLLABLES:
        model = langid.fit([(lang, t) for lang, t in known if lang != out])
        assert rejected([t for lang, t in rest if lang == out], model).mean() > 0.9
        assert not rejected([t for lang, t in rest if lang != out], model).any()
    assert not rejected(["the house"], langid.fit([("aa", "the house")])).any()
