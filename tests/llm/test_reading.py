import numpy as np
import pytest
from pyspark.sql import functions as F

from vocspan.llm import reading as R
from vocspan.llm.boosting import Boosted, isotonic

EASY = "The cat sat by the door. We like the cat. It was a hot day and she had a red ball. "
HARD = "Notwithstanding the ostensibly paradigmatic character of such formulations, institutional heteroskedasticity problematises the redistribution of communicative capital. "


def test_boosting_learns_held_out_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1] ** 2 + 0.1 * rng.normal(size=3000)
    model = Boosted().fit(x[:2000], y[:2000])
    error = np.mean((model.predict(x[2000:]) - y[2000:]) ** 2)
    assert error < 0.15 * y.var()


def test_isotonic_is_monotone():
    x = np.arange(10.0)
    kx, ky = isotonic(x, np.array([1, 3, 2, 4, 3, 5, 6, 5, 7, 8.0]))
    assert (np.diff(ky) > 0).all() and (np.diff(kx) > 0).all()


def documents(spark):
    texts = [(i, (EASY if i % 2 else HARD) * (3 + i % 4), "en", f"s{i % 3}") for i in range(80)]
    texts += [(900, None, "en", "s0"), (901, "", "en", "s0"), (902, HARD * 4, "zh", None), (902, HARD * 4, "zh", None), (903, "这本书很好看。" * 60, "en", "s1"), (904, "Saya rasa buku itu sangat baru dan harganya tidak mahal untuk orang yang ada di sini. " * 6, "en", "s1"), (905, HARD, "en", "s1"), (906, EASY * 5000, "en", "s2")]
    return spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").withColumns({"y": F.lit("x"), "fold": F.lit(1), "level": F.lit("z")})


def test_levels(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 5) for i in range(60)] + [(0, "r", 5), (1, "q", None), (3, "q", 9)], "doc_id long, rater string, reading_level int")
    got = sorted(r["doc_id"] for r in R.found(docs, labels).collect())
    assert got == [i for i in range(0, 80, 2)] + [902, 902]
    levels = {r["doc_id"]: r for r in R.score(docs, R.train(docs, labels)).collect()}
    assert levels[900]["level"] is None and levels[901]["level"] is None and levels[900]["n_words"] == 0
    assert not levels[903]["english"] and not levels[904]["english"] and levels[906]["level"] == 1
    with pytest.raises(ValueError):
        R.train(docs, labels.limit(3))
    assert R.score(docs.limit(0), R.train(docs, labels)).count() == 0


def test_other_languages_are_not_english():
    plain = {
        "Spanish": "La casa de mi abuela está en el pueblo y me gusta ir a verla con mis primos en verano. No hay nada como comer a la sombra.",
        "Portuguese": "A casa da minha avó fica na vila e eu gosto de ir até lá com os meus primos no verão. Não há nada como comer a sombra.",
        "French": "La maison de ma grand-mère est dans le village et on me dit de ne pas y aller en hiver. Il y a un jardin sur la place.",
        "Italian": "La casa di mia nonna è in campagna e a me piace andare a trovarla con i miei cugini. Non ho mai visto un posto come quello.",
        "German": "Das Haus in dem Dorf ist alt, und wir waren im Sommer an dem See. Man hat es mir so gesagt, als ich hier war.",
        "Dutch": "Het huis van mijn oma is in het dorp en ik ga er in de zomer heen. We zijn daar met de hond en het was zeer mooi.",
        "Malay": "Saya suka pergi ke rumah nenek di kampung itu dengan mereka kerana ada banyak pokok di sana dan kami boleh makan.",
        "Swedish": "Huset i byn är gammalt och vi var vid sjön på sommaren. Det är en plats som jag inte har sett och vi har det bra.",
        "Turkish": "Bu ev çok eski ve biz yaz için buraya geldik. O kadar güzel bir yer ki ben daha sonra gene gelmek istiyorum.",
    }
    for language, text in plain.items():
        assert not R.describe(text)[3] and not R.describe(text * 20)[3], language
    for text in (EASY, HARD, "Please come in and tell me a story about no man or was die a name. No, not for me, a son said.", "We met at the cafe de la Paix in Paris and he had a pain au chocolat, as one does."):
        assert R.describe(text)[3]


def test_validation_has_no_part_in_its_own_figures():
    rng = np.random.default_rng(2)
    n = 240
    y = rng.integers(1, 6, n).astype(float)
    features = np.stack([y + rng.normal(0, 0.3, n), rng.normal(size=n)], axis=1)
    text = rng.permutation(n) * 7 + 1
    source = np.array(["a", "b", "c"])[np.arange(n) % 3]
    text[3:6] = text[0]  # copies of one text in all sources
    sample = R.Sample(features, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), y, source, text)
    held = np.zeros(n)
    for g in "abc":
        _, _, _, mine, guess = sample.fit_without(g)
        held[mine] = guess
    report = R.validate(sample, held).set_index("source")
    for g in "abc":  # the figures of a source follow from the curve of the others
        mine = source == g
        want = np.abs(np.interp(held[mine], *isotonic(held[~mine], y[~mine])) - y[mine]).mean()
        assert abs(report.loc[g, "mean_abs_error"] - want) < 1e-12 and report.loc[g, "n"] == mine.sum()
    changed = R.Sample(features, sample.words, sample.code, sample.counts, sample.docs, np.where(source == "a", 5.0, np.where(np.isin(text, text[source == "a"]), 5.0, y)), source, text)
    _, _, _, mine, guess = changed.fit_without("a")
    assert np.array_equal(guess, held[mine])  # neither labels of the source nor those of copies elsewhere matter


def test_many_sources(spark):
    docs = documents(spark).withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 20).cast("string"))).withColumn("text", F.concat("text", F.lit(" the "), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 5) for i in range(60)], "doc_id long, rater string, reading_level int")
    report = R.train(docs, labels).validation
    assert len(report) == 20 and report["n"].sum() == 60 and report["same_side_of_4"].mean() > 0.9
