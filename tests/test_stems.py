"""Stems, the analyser and stored postings."""

import math
from collections import Counter

import pytest

from lodestone.functions import stems
from lodestone.operators import retrieval
from lodestone.sources import postings as stored

# words and their stems as the algorithms' descriptions give them
ENGLISH = (
    "consistency consist knocking knock generously generous generate generat national nation hopping hop hoping hope happily happili skies sky flies fli ties tie "
    "relational relat conditional condit consignment consign conspiracy conspiraci knives knive kindness kind agreed agre feed feed plastered plaster sing sing troubled troubl sized size "
    "falling fall hissing hiss filing file rational ration digitizer digit radically radic differently differ analogously analog operator oper feudalism feudal decisiveness decis "
    "hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative format electricity electr hopeful hope goodness good "
    "revival reviv allowance allow inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust adoption adopt communism communism "
    "activate activ homologous homolog effective effect bowdlerize bowdler rate rate cease ceas controlling control say say cry cri by by sky sky inning inning dying die early earli"
).split()
FRENCH = (
    "continua continu continuait continu continuation continu continuel continuel continuellement continuel continuera continu continuons continuon contour contour contournant contourn "
    "contraction contract contradictoirement contradictoir mains main maintenant mainten maintenue maintenu maires mair maisons maison maître maîtr maîtresse maîtress majesté majest "
    "majestueusement majestu majestueux majestu majeure majeur majordomes majordom majorité major malades malad maladies malad maladive malad chevaux cheval mangeaient mang"
).split()


@pytest.mark.parametrize(("stem", "words"), [(stems.english, ENGLISH), (stems.french, FRENCH)])
def test_published_stems(stem, words):
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_analyser():
    assert stems.fold("Exécution des Marchés — Œuvre") == "execution des marches — oeuvre"
    assert stems.tokens("Passation des marchés de la ville") == ["passation", "marches", "ville"]
    assert stems.tokens("The state of the art") == ["state", "art"] and stems.analyze("des de la") == ([], 0)
    assert stems.analyze("marché") == stems.analyze("marchés") and stems.analyze("markets")[0] == stems.analyze("market")[0]
    assert stems.analyze("Nationaux snake_case Ünder") == (["national", "nationaux", "snak", "snake", "cas", "case", "under"], 4)


def test_stemmed_search(spark, tmp_path):
    texts = ["Passation des marchés", "Exécution des marchés", None, "", "market markets market", "the of", "Passations et exécutions"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    posts = retrieval.postings(docs, "doc_id", analyzer=stems.analyze, reference=8)
    tf = {i: (Counter(stems.analyze(t or "")[0]), stems.analyze(t or "")[1]) for i, t in enumerate(texts)}
    weight = {(i, w): n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / 8)) for i, (c, length) in tf.items() for w, n in c.items()}
    assert {(r["doc_id"], r["term"]): r["weight"] for r in posts.collect()} == pytest.approx(weight)
    stored.store(posts, f"{tmp_path}/index", buckets=4)
    words = list(dict.fromkeys(stems.analyze("passation des marchés")[0]))
    some = stored.load(spark, f"{tmp_path}/index", words, buckets=4)
    assert {(r["doc_id"], r["term"]) for r in some.collect()} == {k for k in weight if k[1] in words}
    assert stored.load(spark, f"{tmp_path}/index").count() == len(weight) and stored.load(spark, f"{tmp_path}/index", [], buckets=4).count() == 0
    asked = spark.createDataFrame([(0, w) for w in words], "query_id long, term string")
    got = {r["doc_id"]: r["score"] for r in retrieval.lexical_scores(some, asked, "doc_id", len(texts)).collect()}
    df = Counter(w for _, w in weight)
    want = {}
    for (i, w), x in weight.items():
        if w in words:
            want[i] = want.get(i, 0) + x * math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
    assert got == pytest.approx(want, abs=1e-5) and got[0] > got[1]
