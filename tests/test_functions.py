import itertools

from pyspark.sql import functions as F

from symbolpulse.functions import scores as S
from symbolpulse.functions import symbols as Y
from symbolpulse.functions import text as X

LEXICON = S.Lexicon({"up": 1, "down": -2}, {"very": 3, "much": 2}, frozenset({"not"}))


def folded(words, lexicon):
    """The scoring rule step by step: negation first, then intensity."""
    marked, i = [], 0
    hot = set(lexicon.keywords) | set(lexicon.intensities)
    while i < len(words):
        if words[i] not in lexicon.markers:
            marked.append(words[i])
            i += 1
            continue
        ahead = [j for j in (i + 1, i + 2) if j < len(words) and words[j] in hot]
        if ahead:
            marked += words[i + 1 : ahead[0]] + ["not_" + words[ahead[0]]]
            i = ahead[0] + 1
        else:
            i += 1
    values = dict(lexicon.keywords) | {"not_" + w: -v for w, v in lexicon.keywords.items()}
    total, hit, i = 0.0, False, 0
    while i < len(marked):
        factor = 1
        if marked[i] in lexicon.intensities and i + 1 < len(marked):
            factor = lexicon.intensities[marked[i]]
            i += 1
        value = values.get(marked[i])
        if value:
            hit, total = True, total + factor * value
        i += 1
    return total if hit else None


def test_lexicon_score_on_all_short_texts(spark):
    words = ["up", "down", "very", "not", "cow"]
    texts = [" ".join(t) for n in range(1, 7) for t in itertools.product(words, repeat=n)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    rows = frame.select("text", S.lexicon_score("text", LEXICON).alias("s")).collect()
    wrong = [(r.text, r.s, folded(r.text.split(), LEXICON)) for r in rows if r.s != folded(r.text.split(), LEXICON)]
    assert len(rows) == len(texts) and wrong == []


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_default_lexicon(spark):
    score = lambda text: value(spark, S.lexicon_score(F.lit(text)))
    assert score("This is a strong buy signal") == 2
    assert score("Das ist ein mega kauf") == 2
    for text in ("Bitte nicht kaufen", "nie kaufen", "nicht so bullish", "kein kauf heute"):
        assert score(text) < 0
    assert score("nicht mega kauf") == 1  # a negated intensity loses its effect
    assert score("nothing here") is None
    assert score("an accident") == -1 and score("not_buy") == -1


def test_configured_lexicon_overrides_and_extends():
    lexicon = S.DEFAULT_LEXICON.configured({"Mega": 5}, ["never"])
    assert lexicon.intensities["mega"] == 5 and lexicon.intensities["super"] == 2
    assert {"never", "nicht"} <= lexicon.markers


def test_labels_and_blend(spark):
    rows = "array(named_struct('label', ' Positive', 'score', 0.2D), named_struct('label', 'positive', 'score', 0.7D), named_struct('label', 'bearish', 'score', 0.1D))"
    assert abs(value(spark, S.label_scalar(F.expr(rows))) - 0.6) < 1e-12
    assert abs(value(spark, S.label_scalar_last(F.expr(rows))) - 0.7) < 1e-12
    assert abs(value(spark, S.blend(F.lit(0.1), F.lit(0.5), F.lit(None).cast("double"))) - 0.26) < 1e-12
    assert value(spark, S.blend(F.lit(0.9), F.lit(0.5), F.lit(9.0))) == 1


def test_cleaning(spark):
    text = "Hi @me\nsee https://x.y/z #TSLA &amp; *go*"
    assert value(spark, X.clean_for_model(F.lit(text))).split() == ["hi", "see", "tsla", "go"]
    assert value(spark, X.lexicon_tokens(F.lit("Steigst, kauft! 🚀 alte $TSLA"), {"kaufen"})) == ["steigen", "kaufen", "🚀", "alte", "$tsla"]


def test_symbols(spark):
    get = lambda fn, text: set(value(spark, fn(F.lit(text))))
    assert get(Y.cashtags, "$AAPL to the moon, # tsla") == {"AAPL", "TSLA"}
    assert get(Y.cashtags, "$ABCDEFGHIJKLM") == {"ABCDEFGHIJ"}
    assert get(Y.free_cashtags, "$ABCDEFGHIJKLM $BRK-B x$NO $TSLA-") == {"BRK-B"}
    assert get(Y.plain_symbols, "TSLA and RHM.DE but not Tesla or THE") == {"TSLA", "RHM.DE"}
    assert get(Y.cashtags, "#YOLO #ETF $CEO #usd $the") == set()
    assert get(Y.name_variants, "Apple Inc.") == {"apple inc", "apple"}
    assert get(Y.name_variants, "Foo & Bar Holding AG") == {
        "foo & bar holding ag", "foo and bar holding ag", "foo & bar holding", "foo & bar",
    }
    assert get(Y.symbol_variants, "BRK.B") == {"BRK.B", "BRK"}
    assert get(Y.master_aliases, "Novo Nordisk A/S Inc") == {"novo nordisk a/s inc", "novo nordisk a s inc", "novo nordisk a s", "novo"}
