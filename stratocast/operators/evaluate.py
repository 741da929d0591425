"""Scoring of generated against reference texts, and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.functions import extract, text
from stratocast.functions.stemming import SHORTEST, with_stem
from stratocast.operators.corpus import take_first
from stratocast.operators.scale import skew_join
from stratocast.storage import stored

# Weights of the overall score, and the report thresholds.
OVERALL = {
    "bleu": 0.2,
    "rouge_1": 0.2,
    "categorical": 0.3,
    "length": 0.1,
    "readability": 0.1,
    "rain": 0.1,
}
VERDICTS = [
    (0.7, "Excellent performance across all metrics"),
    (0.5, "Good performance with room for improvement"),
    (None, "Performance needs improvement"),
]
FLAGS = {
    "rain": "Consider improving rain prediction accuracy",
    "temperature": "Temperature predictions could be more precise",
    "readability": "Focus on improving forecast readability and style",
}
TASK_CHARS = 8_000_000  # characters whose n-grams one task counts
ROW_PART = 8  # a row of up to this part of them is counted where it lies
METRICS = [
    "bleu_score",
    "rouge_1_f",
    "rouge_2_f",
    "rouge_l_f",
    "rain_accuracy",
    "temperature_mae",
    "wind_speed_mae",
    "categorical_accuracy",
    "brier_score",
    "reliability",
    "resolution",
    "readability_score",
    "length_similarity",
    "vocabulary_diversity",
    "overall_score",
]


def prediction_table(
    test: DataFrame, generated: DataFrame, identity: str = "sample_id", n: int | None = None
) -> DataFrame:
    """Pair test rows with generated texts; rows without one are left out."""
    columns = dict.fromkeys(test.columns)

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("Unknown")) if name in columns else F.lit("Unknown")

    chosen = take_first(test, n, [identity])
    made = generated.where(F.col("generated_forecast").isNotNull()).select(identity, "generated_forecast")
    return chosen.join(made, identity).select(
        identity,
        F.col("input").alias("input_prompt"),
        "generated_forecast",
        F.col("target").alias("reference_forecast"),
        known("location").alias("location"),
        known("datetime").alias("datetime"),
    )


def score_rows(
    pred: DataFrame,
    generated: str = "generated_forecast",
    reference: str = "reference_forecast",
    bleu: str = "overlap",
    rouge: str = "fallback",
    identity: Sequence[str] = (),
) -> DataFrame:
    """Add every row-level metric and error, computed from tokens made once per row.

    bleu='overlap' takes the unigram F1, bleu='bleu4' the smoothed BLEU-4.
    rouge='fallback' leaves stopwords out and takes rouge-1 for rouge-L;
    rouge='library' keeps them and takes the longest common subsequence;
    rouge='stemmed' does so over stems, and needs the rows' `identity`.
    """
    if rouge == "stemmed" and not identity:
        raise ValueError("stems come back to their rows by identity columns")
    gen, ref = F.coalesce(F.col(generated), F.lit("")), F.coalesce(F.col(reference), F.lit(""))
    tokens = pred.withColumns(
        {
            "_g1": text.metric_tokens(gen),
            "_r1": text.metric_tokens(ref),
            "_gc": extract.extract_conditions(gen),
            "_rc": extract.extract_conditions(ref),
            "_gw": text.words(F.lower(gen)),
            "_rw": text.word_count(ref),
            "_gt": text.metric_tokens(gen) if rouge == "fallback" else text.rouge_tokens(gen),
            "_rt": text.metric_tokens(ref) if rouge == "fallback" else text.rouge_tokens(ref),
        }
    )
    if rouge == "stemmed":
        tokens = stem_tokens(tokens, identity, ["_gt", "_rt"])
    tokens = tokens.withColumns({"_g2": text.ngrams(F.col("_gt"), 2), "_r2": text.ngrams(F.col("_rt"), 2)})
    g1, r1, gc, rc = F.col("_g1"), F.col("_r1"), F.col("_gc"), F.col("_rc")
    gm, rm = extract.midpoint(gc["temperature_range"]), extract.midpoint(rc["temperature_range"])
    rain_pair = gc["rain"].isNotNull() & rc["rain"].isNotNull()
    columns = {
        "_rouge_1": text.rouge_n(F.col("_gt"), F.col("_rt"), 1),
        "_rouge_2": text.overlap_f1(F.col("_g2"), F.col("_r2")),
        "_length": text.length_ratio(F.size("_gw"), F.col("_rw")),
        "_diversity": text.distinct_share(F.col("_gw")),
        "_readability": text.readability(gen),
        "_rain_pair": rain_pair.cast("int"),
        "_rain_hit": F.when(rain_pair, (gc["rain"] == rc["rain"]).cast("int")).otherwise(0),
        "_temp_error": F.abs(gm - rm),
        "_wind_error": F.abs(gc["wind_speed"] - rc["wind_speed"]),
        "_categorical": (
            gc["rain"].eqNullSafe(rc["rain"]) & (gm.isNull() | rm.isNull() | (F.abs(gm - rm) <= 3))
        ).cast("double"),
    }
    scored = tokens.withColumns(columns)
    if bleu == "bleu4":
        bleu_score = text.bleu4(g1, r1)
    else:
        bleu_score = F.col("_rouge_1") if rouge == "fallback" else text.overlap_f1(g1, r1)
    longest = F.col("_rouge_1") if rouge == "fallback" else text.rouge_l_lcs(F.col("_gt"), F.col("_rt"))
    return scored.withColumns({"_bleu": bleu_score, "_rouge_l": longest}).drop(
        "_g1", "_r1", "_gc", "_rc", "_gw", "_rw", "_g2", "_r2", "_gt", "_rt"
    )


def stem_tokens(df: DataFrame, identity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace the tokens of array columns by their stems; tokens of three letters or fewer stay.

    Each different token is stemmed once, and the table of stems is written, so
    the plan of the join reads it and does not hold the stemmer's rules. Tokens
    travel to their stems and back with their place in the row; frequent ones
    meet them by broadcast.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("tokens")) for i, c in enumerate(columns)])
    placed = df.select(*identity, F.explode(sides).alias("_side")).select(
        *identity, F.col("_side.side").alias("_of"), F.posexplode("_side.tokens").alias("_at", "_token")
    )
    long = F.length("_token") >= SHORTEST
    stems = stored(with_stem(placed.where(long).select("_token").distinct(), "_token", "_stem"))
    found = skew_join(placed, stems, "_token")
    entry = F.struct("_of", "_at", F.coalesce("_stem", "_token").alias("token"))
    lists = found.groupBy(*identity).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))  # one row's own tokens
    joined = df.join(lists, list(identity), "left")
    entries = F.coalesce("_entries", F.expr("array()").cast("array<struct<_of:int,_at:int,token:string>>"))

    def side(i: int) -> Column:
        return F.filter(entries, lambda e: e["_of"] == i)["token"]

    return joined.withColumns({c: side(i) for i, c in enumerate(columns)}).drop("_entries")


def rain_accuracy() -> Column:
    return F.sum("_rain_hit") / F.greatest(F.sum("_rain_pair"), F.lit(1))


def temperature_mae() -> Column:
    return F.coalesce(F.avg("_temp_error"), F.lit(0.0))


def wind_mae() -> Column:
    return F.coalesce(F.avg("_wind_error"), F.lit(0.0))


def categorical_accuracy() -> Column:
    return F.coalesce(F.avg("_categorical"), F.lit(0.0))


def _overall(bleu: Column, rouge: Column, categorical: Column, length: Column, read: Column, rain: Column) -> Column:
    parts = {
        "bleu": bleu,
        "rouge_1": rouge,
        "categorical": categorical,
        "length": length,
        "readability": read,
        "rain": rain,
    }
    terms = [F.lit(OVERALL[name]) * value for name, value in parts.items()]
    return sum(terms[1:], terms[0])


def row_overall() -> Column:
    """The overall score of a single scored row: an undecided rain pair counts as 0."""
    return _overall(
        F.col("_bleu"),
        F.col("_rouge_1"),
        F.col("_categorical"),
        F.col("_length"),
        F.col("_readability"),
        F.col("_rain_hit").cast("double"),
    )


def evaluate(
    pred: DataFrame,
    by: Sequence[str] = (),
    rollup: bool = False,
    bleu: str = "overlap",
    scored: bool = False,
    rouge: str = "fallback",
    identity: Sequence[str] = (),
) -> DataFrame:
    """All metrics per group (or per rollup level) in one aggregation.

    Rows are reduced to partial sums before the shuffle, so group sizes do not
    matter. Brier score, reliability and resolution are constant 0. A rollup
    has `level`, one bit per column that is rolled up, so that a null group and
    a total can be told apart.
    """
    rows = pred if scored else score_rows(pred, bleu=bleu, rouge=rouge, identity=identity)
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    level = [F.grouping_id().cast("bigint").alias("level")] if rollup else []
    out = grouped.agg(
        *level,
        F.count(F.lit(1)).alias("predictions"),
        F.avg("_bleu").alias("bleu_score"),
        F.avg("_rouge_1").alias("rouge_1_f"),
        F.avg("_rouge_2").alias("rouge_2_f"),
        F.avg("_rouge_l").alias("rouge_l_f"),
        rain_accuracy().alias("rain_accuracy"),
        temperature_mae().alias("temperature_mae"),
        wind_mae().alias("wind_speed_mae"),
        categorical_accuracy().alias("categorical_accuracy"),
        F.avg("_readability").alias("readability_score"),
        F.avg("_length").alias("length_similarity"),
        F.avg("_diversity").alias("vocabulary_diversity"),
    ).where(F.col("predictions") > 0)
    overall = _overall(
        F.col("bleu_score"),
        F.col("rouge_1_f"),
        F.col("categorical_accuracy"),
        F.col("length_similarity"),
        F.col("readability_score"),
        F.col("rain_accuracy"),
    )
    zeros = [F.lit(0.0).alias(c) for c in ("brier_score", "reliability", "resolution")]
    return score_interval(
        out.select("*", *zeros, overall.alias("overall_score")).select(
            *by, *(["level"] if rollup else []), "predictions", *METRICS
        )
    )


def score_interval(metrics: DataFrame) -> DataFrame:
    """Add a fixed margin around the overall score, clamped to [0, 1]."""
    margin = F.when(F.col("predictions") > 10, F.lit(0.05)).otherwise(F.lit(0.10))
    score = F.col("overall_score")
    return metrics.withColumns(
        {
            "confidence_interval_low": F.greatest(F.lit(0.0), score - margin),
            "confidence_interval_high": F.least(F.lit(1.0), score + margin),
        }
    )


def brier_score(df: DataFrame, by: Sequence[str] = (), p: str = "p", outcome: str = "outcome") -> DataFrame:
    """Mean squared distance of probability and outcome; 1.0 for no rows."""
    hit = F.col(outcome).cast("int")
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.pow(F.col(p) - hit, 2.0)), F.lit(1.0)).alias("brier_score"))


def recommendations(metrics: DataFrame) -> DataFrame:
    """Add the verdict and the array of flags."""
    score = F.col("overall_score")
    verdict = F.when(score > VERDICTS[0][0], VERDICTS[0][1]).when(score > VERDICTS[1][0], VERDICTS[1][1])
    flags = F.array_compact(
        F.array(
            F.when(F.col("rain_accuracy") < 0.7, FLAGS["rain"]),
            F.when(F.col("temperature_mae") > 3.0, FLAGS["temperature"]),
            F.when(F.col("readability_score") < 0.6, FLAGS["readability"]),
        )
    )
    return metrics.withColumns({"verdict": verdict.otherwise(VERDICTS[2][1]), "flags": flags})


def render_report(metrics: DataFrame, generated_on: str, name: str = "report") -> DataFrame:
    """Add the markdown report of every group's metrics; the clock is a parameter."""
    from stratocast.functions.render import fixed_text

    rows = recommendations(metrics)

    def line(label: str, column: str, digits: int = 4, unit: str = "") -> Column:
        return F.concat(F.lit(f"- **{label}**: "), fixed_text(F.col(column), digits), F.lit(unit))

    marks = {  # Fixed values: symbols in front of the report lines.
        VERDICTS[0][1]: "✅ ",
        VERDICTS[1][1]: "✅ ",
        VERDICTS[2][1]: "⚠️ ",
        FLAGS["rain"]: "🌧️ ",
        FLAGS["temperature"]: "🌡️ ",
        FLAGS["readability"]: "📝 ",
    }
    symbols = F.create_map(*[F.lit(v) for pair in marks.items() for v in pair])
    advice = F.transform(
        F.concat(F.array(F.col("verdict")), F.col("flags")), lambda t: F.concat(F.lit("- "), symbols[t], t)
    )
    interval = F.concat(
        F.lit("- **95% Confidence Interval**: ["),
        fixed_text(F.col("confidence_interval_low"), 4),
        F.lit(", "),
        fixed_text(F.col("confidence_interval_high"), 4),
        F.lit("]"),
    )
    # Headings and notes of the report.
    body = [
        F.lit("\n# Weather Forecasting Model Evaluation Report"),
        F.lit(f"Generated on: {generated_on}\n"),
        F.lit("## Text Similarity Metrics"),
        line("BLEU Score", "bleu_score"),
        line("ROUGE-1 F1", "rouge_1_f"),
        line("ROUGE-2 F1", "rouge_2_f"),
        line("ROUGE-L F1", "rouge_l_f"),
        F.lit("\n## Meteorological Accuracy"),
        line("Rain Prediction Accuracy", "rain_accuracy"),
        line("Temperature MAE", "temperature_mae", 2, "°C"),
        line("Wind Speed MAE", "wind_speed_mae", 2, " km/h"),
        line("Categorical Accuracy", "categorical_accuracy"),
        F.lit("\n## Style and Fluency"),
        line("Readability Score", "readability_score"),
        line("Length Similarity", "length_similarity"),
        line("Vocabulary Diversity", "vocabulary_diversity"),
        F.lit("\n## Overall Performance"),
        line("Overall Score", "overall_score"),
        interval,
        F.lit("\n## Interpretation"),
        F.lit("- BLEU/ROUGE scores measure text similarity to reference forecasts"),
        F.lit("- Meteorological accuracy measures factual correctness of predictions"),
        F.lit("- Style metrics assess human-like forecast characteristics"),
        F.lit("- Overall score combines all metrics with domain-appropriate weights"),
        F.lit("\n## Recommendations"),
        F.array_join(advice, "\n"),
        F.lit(""),
    ]
    return rows.withColumn(name, F.concat_ws("\n", *body))


def overlap_f1_long(
    pairs: DataFrame, identity: Sequence[str], left: str, right: str, n: int = 1, name: str = "f1"
) -> DataFrame:
    """Overlap F1 for texts of any length: counts per (row, n-gram), linear work but for sorting.

    A row of up to a `ROW_PART` of `TASK_CHARS` is counted where it lies, and only
    its score is kept. Longer ones, and the rows of an identity that stands more than
    once (which are one text together), are written, counted by themselves, and
    meet in a shuffle on (row, n-gram), which spreads a single huge text, and one
    of partial sums on the row. The first one has a task for every `TASK_CHARS`
    characters, so a task's counts do not grow with the table. Equal to the array
    form. A job of its own reads the texts; one before reads the identities.
    """
    identity = list(identity)
    texts = pairs.select(*identity, F.col(left).alias("_a"), F.col(right).alias("_b"))
    again = stored(texts.groupBy(*identity).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*identity))
    again = again.select(*[F.col(c).alias(f"_again{i}") for i, c in enumerate(identity)], F.lit(True).alias("_again"))
    same = F.lit(True)
    for i, c in enumerate(identity):
        same = same & F.col(c).eqNullSafe(F.col(f"_again{i}"))
    size = F.lit(0).cast("bigint")
    for c in ("_a", "_b"):
        size = size + F.coalesce(F.char_length(c), F.lit(0))
    apart = F.col("_again").isNotNull() | (size > TASK_CHARS // ROW_PART)

    def counted(column: str) -> Column:
        return text.bind(text.metric_tokens(F.col(column)), lambda t: text.runs(text.ngrams(t, n)))

    def scored(a: Column, b: Column) -> Column:
        sizes = [F.aggregate(x, F.lit(0), lambda total, run: total + run["n"]) for x in (a, b)]
        return text.f1_from_sizes(text.runs_overlap(a, b), *sizes)

    here = text.bind(counted("_a"), lambda a: text.bind(counted("_b"), lambda b: scored(a, b)))
    kept = [F.when(apart, x).alias(c) for c, x in (("_size", size), ("_a", F.col("_a")), ("_b", F.col("_b")))]
    met = texts.join(again, same, "left").select(*identity, F.when(~apart, here).alias(name), *kept)
    met = stored(met)
    whole = met.where("_size IS NULL").select(*identity, name)
    dealt = met.where("_size IS NOT NULL")
    chars = dealt.agg(F.sum("_size")).first()[0]
    if chars is None:
        return whole
    tasks = chars // TASK_CHARS + 1
    sides = F.array(*[F.struct(F.lit(c == "_a").alias("side"), counted(c).alias("runs")) for c in ("_a", "_b")])
    exploded = (
        dealt.select(*identity, F.explode(sides).alias("_s"))
        .select(*identity, F.col("_s.side").alias("_left"), F.explode_outer("_s.runs").alias("_run"))
        .select(*identity, "_left", F.col("_run.item").alias("_gram"), F.col("_run.n").alias("_n"))
    )
    # explode_outer keeps a row without tokens; its NULL gram counts for neither side.
    counts = exploded.repartition(tasks, *identity, "_gram").groupBy(*identity, "_gram").agg(
        *[F.coalesce(F.sum(F.when(own, F.col("_n"))), F.lit(0)).alias(c) for c, own in (("_a", F.col("_left")), ("_b", ~F.col("_left")))]
    )
    score = text.f1_from_sizes(F.sum(F.least("_a", "_b")), F.sum("_a"), F.sum("_b"))
    return whole.unionByName(counts.groupBy(*identity).agg(score.alias(name)))


def bleu4_long(pairs: DataFrame, identity: Sequence[str], left: str, right: str, name: str = "bleu4") -> DataFrame:
    """BLEU-4 of token arrays of any length: clipped counts per (row, n, n-gram).

    The work is linear in the texts: one shuffle on (row, n, n-gram), one of
    partial sums on the row. Equal to the array form, `text.bleu4`.
    """
    sizes = pairs.select(*identity, F.size(left).alias("_size_a"), F.size(right).alias("_size_b"))
    sides = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(own).alias("own"), text.ngrams(F.col(column), n).alias("grams"))
            for n in (1, 2, 3, 4)
            for own, column in ((True, left), (False, right))
        ]
    )
    grams = pairs.select(*identity, F.explode(sides).alias("_s")).select(
        *identity, F.col("_s.n").alias("_n"), F.col("_s.own").alias("_own"), F.explode("_s.grams").alias("_gram")
    )
    counts = grams.groupBy(*identity, "_n", "_gram").agg(
        F.count_if("_own").alias("_a"), F.count_if(~F.col("_own")).alias("_b")
    )
    clipped = F.least("_a", "_b")
    sums = counts.groupBy(*identity).agg(
        *[F.sum(F.when(F.col("_n") == n, clipped).otherwise(0)).alias(f"_hits{n}") for n in (1, 2, 3, 4)]
    )
    score = text.bleu4_from_counts([F.coalesce(f"_hits{n}", F.lit(0)) for n in (1, 2, 3, 4)], F.col("_size_a"), F.col("_size_b"))
    return sizes.join(sums, list(identity), "left").select(*identity, score.alias(name))


def overlap_f1_any(
    pairs: DataFrame, identity: Sequence[str], left: str, right: str, long_words: int = 2000, name: str = "f1"
) -> DataFrame:
    """Overlap F1 by the array form for short texts and by the exploded form for long ones."""
    longest = F.greatest(text.word_count(F.coalesce(F.col(left), F.lit(""))), text.word_count(F.coalesce(F.col(right), F.lit(""))))
    sized = pairs.select(*identity, left, right, longest.alias("_longest"))
    short = sized.where(F.col("_longest") <= long_words).select(
        *identity, text.overlap_f1(text.metric_tokens(F.col(left)), text.metric_tokens(F.col(right))).alias(name)
    )
    return short.unionByName(overlap_f1_long(sized.where(F.col("_longest") > long_words), identity, left, right, name=name))
