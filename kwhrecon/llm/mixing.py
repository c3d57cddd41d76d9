"""Mixing to target weights: domain posteriors, then rates by projected gradients.

1. A naive Bayes model over a labelled table gives each document a posterior
   over domains. Its features are shares of characters and of repeated words,
   cut into ``BINS`` bins, and ``WORDS`` words learned as telling.
2. Each document gets a rate r >= ``least``. Projected gradient steps fit the
   rates so that the expected domain totals, sum of r * tokens * posterior, match
   target totals in least squares, each domain relative to its size. In these
   units the largest curvature is 1, so unit steps converge, and crisp
   posteriors need only a few.
3. With ``least`` above 0 no total can fall below its share of the input, so the
   mix is made as large as the targets need, and larger where documents belong
   to several domains. A target that is missed all the same is named in a warning.

Native: DataFrame functions only. Learning aggregates a sample of at most
``SAMPLE`` documents per domain (the first by a hash of their id) to a table
bounded by features x bins x domains. A step is one aggregate of the stored
(tokens, posteriors) rows to one total per domain; a rate is a fold over the
steps' residuals, so no state is kept per step and lost executors recompute
from the stored table. Nothing is shuffled but partial sums, and a domain or
source with any share of the rows costs nothing extra.

Edge cases: null and empty texts have no tokens; they keep their rate but add
nothing. Documents labelled twice with different domains teach neither. Domains
without labels get no posterior, and their targets are left out. Without any
label every rate is 1. An empty table gives no rows. Repeated rows are rows of
their own, and extra columns of any name pass through.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, stored

SAMPLE, BINS, WORDS, LIFT, STEPS, EXACT = 1000, 12, 64, 4.0, 60, 1e-6

#: A target counts as met if its share is this near; sizes tried, and what each adds to the last.
MET, TRIES, WIDER = 1e-3, 6, 1.25

#: Target weights of the registered query.
TARGETS = {"clean": 0.8, "low": 0.1, "toxic": 0.1}

#: Characters whose share in a text is a feature.
MARKS = {"symbols": "#$%&*", "bangs": "!|", "digits": "0123456789", "capitals": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(documents: DataFrame) -> DataFrame:
    """Adds _tokens, one bin per feature, and _bag, the distinct lower-case words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = documents.withColumn("_words", F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumn("_tokens", F.size("_words").cast("long"))
    out = out.withColumn("_bag", F.array_distinct(F.transform("_words", lambda w: F.rtrim(w, F.lit(".,;:!?")))))
    share = {k: (F.length(text) - F.length(F.translate(text, m, ""))) / F.greatest(F.length(text), F.lit(1)) for k, m in MARKS.items()}
    share["repeats"] = 1 - F.size("_bag") / F.greatest(F.col("_tokens"), F.lit(1))
    for name, value in share.items():
        # bins are finer near zero
        out = out.withColumn(f"_bin_{name}", F.least(F.floor(F.sqrt(value) * BINS), F.lit(BINS - 1)).cast("int"))
    return out.drop("_words")


BIN_COLUMNS = [f"_bin_{k}" for k in [*MARKS, "repeats"]]


def learn(documents: DataFrame, labelled: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> dict:
    """The model from (doc_id, text) and (doc_id, domain)."""
    clean = (labelled.where("doc_id is not null and domain is not null").groupBy("doc_id")
             .agg(F.min("domain").alias("domain"), F.max("domain").alias("_most")).where("domain = _most").drop("_most"))
    names = sorted(r["domain"] for r in clean.groupBy("domain").count().collect())  # one row per domain
    prior = {r["domain"]: r["count"] for r in clean.groupBy("domain").count().collect()}
    chosen = None
    for name in names:
        part = clean.where(F.col("domain") == name).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return {"names": [], "prior": [], "bins": {}, "words": {}}
    rows = stored(features(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most sample x domains rows
                  .select("domain", "_bag", *BIN_COLUMNS))
    size = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    bins = rows.select("domain", F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("b")) for c in BIN_COLUMNS])).alias("x"))
    counts = {(r["f"], r["b"], r["domain"]): r["n"] for r in
              bins.groupBy("x.f", "x.b", "domain").agg(F.count("*").alias("n")).collect()}  # features x bins x domains
    per = [F.sum((F.col("domain") == d).cast("int")).alias(f"n{i}") for i, d in enumerate(names)]
    held = rows.select("domain", F.explode("_bag").alias("word")).groupBy("word").agg(*per)
    # a telling word is much likelier in one domain than in any other
    rate = [(F.col(f"n{i}") + 0.5) / (size.get(d, 0) + 1) for i, d in enumerate(names)]
    spread = F.greatest(*rate) / F.sort_array(F.array(*rate), asc=False)[1] if len(names) > 1 else F.lit(1.0)
    gain = F.greatest(*rate) * F.log(spread) if len(names) > 1 else F.lit(0.0)
    top = held.withColumn("gain", F.round(gain, 9)).where(spread >= LIFT).orderBy(F.desc("gain"), "word").limit(words).collect()
    logs = lambda x: math.log(x)
    return {
        "names": names,
        "prior": [logs(prior[d] / sum(prior.values())) for d in names],
        "bins": {c: [[logs((counts.get((c, b, d), 0) + 0.5) / (size.get(d, 0) + 0.5 * BINS)) for d in names] for b in range(BINS)]
                 for c in BIN_COLUMNS},
        "words": {r["word"]: [((r[f"n{i}"] or 0) + 0.5) / (size.get(d, 0) + 1) for i, d in enumerate(names)] for r in top},
    }


def posteriors(documents: DataFrame, model: dict) -> DataFrame:
    """Adds _tokens and _p, the posterior of each of the model's domains."""
    out = features(documents)
    known = sorted(model["words"])
    found = F.array_intersect("_bag", F.array(*[F.lit(w) for w in known])) if known else F.array().cast("array<string>")
    out = out.withColumn("_found", found)
    logit: list[Column] = []
    for i in range(len(model["names"])):
        base = model["prior"][i] + sum(math.log(1 - model["words"][w][i]) for w in known)
        value = F.lit(base)
        for c, table in model["bins"].items():
            value = value + F.element_at(F.array(*[F.lit(row[i]) for row in table]), F.col(c) + 1)
        if known:
            gain = F.create_map(*[x for w in known for x in (F.lit(w), F.lit(math.log(model["words"][w][i] / (1 - model["words"][w][i]))))])
            value = value + F.aggregate(F.transform("_found", lambda w: F.element_at(gain, w)), F.lit(0.0), lambda s, x: s + x)  # noqa: B023
        logit.append(value)
    out = out.withColumn("_logit", F.array(*logit)).withColumn("_top", F.array_max("_logit"))
    out = out.withColumn("_e", F.transform("_logit", lambda x: F.exp(x - F.col("_top"))))
    total = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return out.withColumn("_p", F.transform("_e", lambda x: F.round(x / total, 9))).drop("_logit", "_top", "_e", "_found", "_bag", *BIN_COLUMNS)


def rate_of(residuals: list[list[float]], least: float) -> Column:
    """The rate after some steps: from 1, against each step's residuals, never below ``least``."""
    rate = F.lit(max(1.0, least))
    if not residuals:
        return rate
    steps = F.array(*[F.array(*[F.lit(float(u)) for u in step]) for step in residuals])
    dot = lambda u: F.aggregate(F.zip_with(F.col("_p"), u, lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(steps, rate, lambda r, u: F.greatest(F.lit(float(least)), r - dot(u)))


def fit(rows: DataFrame, names: list[str], targets: dict[str, float], least: float = 0.0, growth: float = 1.0,
        steps: int = STEPS) -> tuple[list[list[float]], list[float], list[float]]:
    """(residuals of the steps, totals reached, target totals) over rows (_tokens, _p).

    The mix has ``growth`` times the tokens of the input. A ``least`` above 0 may
    keep a total above its target; the others are then met as well as can be.
    """
    weight = [targets.get(d, 0.0) for d in names]
    if not sum(weight):
        return [], [], []
    weight = [w / sum(weight) for w in weight]
    totals = lambda rate: [float(x or 0.0) for x in rows.agg(
        *[F.sum(F.col("_tokens") * rate * F.col("_p")[i]) for i in range(len(names))]).first()]
    natural = totals(F.lit(1.0))
    budget = growth * sum(natural)
    goal = [budget * w for w in weight]
    residuals: list[list[float]] = []
    reached = totals(rate_of(residuals, least))
    for _ in range(steps):
        if sum(natural) == 0 or max(abs(a - t) for a, t in zip(reached, goal)) <= EXACT * budget:
            break
        residuals.append([(a - t) / n if n else 0.0 for a, t, n in zip(reached, goal, natural)])
        now = totals(rate_of(residuals, least))
        if max(abs(a - b) for a, b in zip(now, reached)) <= EXACT * budget / 100:
            reached = now
            break
        reached = now
    return residuals, reached, goal


def gap(reached: list[float], goal: list[float]) -> float:
    """The largest difference between the shares reached and the target shares."""
    if not sum(reached) or not sum(goal):
        return 0.0
    return max(abs(a / sum(reached) - t / sum(goal)) for a, t in zip(reached, goal))


def reach(rows: DataFrame, names: list[str], targets: dict[str, float], least: float = 0.0,
          growth: float = 1.0) -> tuple[list[list[float]], list[float], list[float]]:
    """As ``fit``, at the least size from ``growth`` on that was found to meet every target.

    With ``least`` above 0 a domain needs a mix of least * natural total / weight;
    documents that belong to several domains need more, which is tried step by
    step as long as each step takes a quarter off the largest difference.
    """
    weight = [targets.get(d, 0.0) for d in names]
    if least and sum(weight):
        natural = [float(x or 0.0) for x in rows.agg(*[F.sum(F.col("_tokens") * F.col("_p")[i]) for i in range(len(names))]).first()]
        growth = max([growth, *(least * n / sum(natural) * sum(weight) / w for n, w in zip(natural, weight) if w and sum(natural))])
    best = fit(rows, names, targets, least, growth)
    for _ in range(TRIES if least else 0):
        if gap(best[1], best[2]) <= MET:
            break
        growth *= WIDER
        wider = fit(rows, names, targets, least, growth)
        if gap(wider[1], wider[2]) > 0.75 * gap(best[1], best[2]):
            break
        best = wider
    return best


def mix(documents: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0,
        growth: float = 1.0) -> tuple[DataFrame, dict, list[list[float]]]:
    """((doc_id, domain, posterior, n_tokens, rate), model, residuals of the steps).

    The model also has the totals reached and the target totals, by domain. With
    ``least`` above 0 the mix has at least ``growth`` times the tokens of the input.
    """
    model = learn(documents, labelled)
    if not model["names"]:
        tokens = features(documents.select("doc_id", "text"))
        return tokens.select("doc_id", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("posterior"),
                             F.col("_tokens").alias("n_tokens"), F.lit(1.0).alias("rate")), model, []
    rows = stored(posteriors(documents.select("doc_id", "text"), model).drop("text"))
    residuals, reached, goal = reach(rows, model["names"], targets, least, growth)
    model = model | {"reached": dict(zip(model["names"], reached)), "goal": dict(zip(model["names"], goal))}
    if gap(reached, goal) > MET:
        shares = ", ".join(f"{d} {a / sum(reached):.3f} for {t / sum(goal):.3f}" for d, a, t in zip(model["names"], reached, goal))
        warnings.warn(f"the mix misses its targets: {shares}", stacklevel=2)
    best = F.array_max("_p")
    names = F.array(*[F.lit(n) for n in model["names"]])
    out = rows.select("doc_id", F.element_at(names, F.array_position("_p", best).cast("int")).alias("domain"), F.round(best, 6).alias("posterior"),
                      F.col("_tokens").alias("n_tokens"), F.round(rate_of(residuals, least), 6).alias("rate"))
    return out, model, residuals


def mixed(documents: DataFrame, model: dict, residuals: list[list[float]], least: float) -> DataFrame:
    """The documents, each as often as its rate says: the whole part, and one more for a hash below the rest."""
    if not model["names"]:
        return documents
    packed = documents.select("doc_id", "text", F.struct("*").alias("_row"))
    rows = posteriors(packed, model).withColumn("_rate", rate_of(residuals, least))
    # rows without an id draw by their text; a null adds nothing to the hash
    lot = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit("mix")), F.lit(1 << 20).cast("long")) / float(1 << 20)
    copies = F.floor("_rate") + (lot < F.col("_rate") - F.floor("_rate")).cast("long")
    return (rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("_row.*"))


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labels table: low quality, else toxic, else clean."""
    return labels.select(F.col("doc_id").cast("long"), F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic")
                         .when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean").alias("domain"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: rates of all ``documents`` for ``TARGETS`` over the domains of ``labels``."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return mix(docs, domains(read(spark, sf_dir, "labels")), TARGETS)[0]
