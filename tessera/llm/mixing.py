"""Soft-membership mixing, in DataFrame operations throughout.

A Bernoulli naive Bayes classifier over hashed words, learned from a bounded sample of the
labelled table (about ``per_domain`` documents of each domain), predicts for every document
the posterior over domains. Only buckets count that a share ``support`` of a domain's
documents hold and whose document frequency there is more than ``sigmas`` deviations above
what the whole sample lets expect; frequencies are shrunk to that expectation, and what is
absent counts as well as what is present. Rates
r >= 0 then minimise

    1/2 sum_d (m_d - t_d)^2 / s_d  +  ridge/2 sum_i (n_i / N) (r_i - c_i)^2

where n_i are tokens, p_id posteriors, N = sum n_i, m_d = sum_i r_i n_i p_id / N, s_d = m_d
at r = 1, t_d = factor_d x s_d the target and c_i = sum_d factor_d p_id the rate a document
would have by membership alone (also the start). In the metric of token shares the gradient
of r_i is sum_d (m_d - t_d) / s_d p_id + ridge (r_i - c_i), its Lipschitz constant at most
1 + ridge (the Gram matrix scaled by 1 / s_d has column sums 1), so the projected step
1 / (1 + ridge) converges. A step is one aggregation over all documents; only the totals,
a few numbers a domain, reach the driver. Where no rate is 0, and as c_i is linear in p_i, a
step changes every rate r_i = l . p_i alike, so the steps between two projections act on the
vector l and on the Gram matrix of the documents with positive rates; then the projection
r_i = max(0, l . p_i) is made anew over all documents, at full length if that lowers the
projected gradient and at half of it, a quarter, ... if not. It ends when the projected
gradient is below ``tolerance`` for every domain; a fit that has not settled after ``most``
projections raises an error.

The totals reached differ from the targets where the posteriors leave no choice: a domain
whose target is 0 keeps what soft memberships of wanted documents give it, and a domain that
is wanted more than documents of it are there pays the ridge. ``fit_rates`` returns both.

Rows that share an id, or have none, form one unit with one rate, the tokens of all and the
words of each. Null or empty text has no tokens and takes the prior. Labels with a null part
are not used; an id labelled twice has its first domain. Without labels every rate is 1. Very
long texts are split whole; an empty table gives an empty result; other columns of ``docs``
pass through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable

BUCKETS, MAX_DOMAINS = 1 << 16, 16
#: Where a text is cut: at white space, and where a word meets what is no letter.
TOKEN = r"\s+|(?<=\p{L})(?=[^\p{L}\s])"
#: Tokens wanted of each labelled domain (quality, toxic), as a factor of what is there.
FACTORS = {"q1_t0": 1.1, "q0_t0": 0.5, "q1_t1": 0.0, "q0_t1": 0.0}
#: Domain names, their log odds when nothing is present, and (b, w0, w1, ...): what a present bucket adds.
Model = tuple[list[str], list[float], DataFrame | None]


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled table."""
    name = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("_t"), F.col("toxic").cast("string"))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("domain")).filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))


def _words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per different word of a row with its hash bucket, the row's token count with its first
    one and 0 with the others; rows without words give one null bucket."""
    split = docs.select(*keep, F.split(F.lower("text"), TOKEN).alias("w"))
    # Splitting leaves an empty string before leading white space and after trailing.
    blank = F.when(F.element_at("w", 1) == "", 1).otherwise(0) + F.when((F.size("w") > 1) & (F.element_at("w", -1) == ""), 1).otherwise(0)
    tokens = F.coalesce(F.size("w") - blank, F.lit(0)).cast("long")
    each = split.select(*keep, tokens.alias("n"), F.posexplode_outer(F.array_distinct("w")).alias("at", "w"))
    return each.select(*keep, F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n")).otherwise(0).alias("n"), F.when(F.col("w") != "", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")).alias("b"))


def train(docs: DataFrame, labels: DataFrame, per_domain: int = 1500, sigmas: float = 4.0, support: float = 0.02, shrink: float = 2.0) -> Model:
    """Model of the labelled documents; its table has at most BUCKETS rows."""
    named = domains_of(labels)
    total = {r["domain"]: r["n"] for r in named.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).limit(MAX_DOMAINS + 1).collect()}
    if len(total) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    names = sorted(total)
    if not names:
        return [], [], None
    rate = F.coalesce(*[F.when(F.col("domain") == d, F.lit(min(1.0, per_domain / total[d]))) for d in names])
    draw = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = named.filter(draw < rate)
    # The draw keeps about per_domain ids of each domain; it is broadcast only if it did.
    if chosen.count() <= 2 * per_domain * len(names):
        chosen = F.broadcast(chosen)
    present = durable(_words(docs.select("doc_id", "text").join(chosen, "doc_id"), ["doc_id", "domain"]).select("doc_id", "domain", "b").distinct())
    size = {r["domain"]: r["n"] for r in present.groupBy("domain").agg(F.count_distinct("doc_id").alias("n")).collect()}
    every = sum(size.values())
    if not every:
        return [], [], None
    df = [F.count_if(F.col("domain") == d).cast("double").alias(f"f{i}") for i, d in enumerate(names)]
    by_bucket = present.filter("b is not null").groupBy("b").agg(*df)
    share = sum(F.col(f"f{i}") for i in range(len(names))) / float(every)
    out, keep = [], F.lit(False)
    for i, d in enumerate(names):
        expected = share * float(size.get(d, 0))
        keep = keep | ((F.col(f"f{i}") - expected > sigmas * F.sqrt(expected + 1.0)) & (F.col(f"f{i}") >= support * size.get(d, 0)))
        own = F.least(F.lit(0.99), share * (F.col(f"f{i}") + shrink) / (expected + shrink))
        top = F.least(F.lit(0.99), share)
        out += [F.ln(own / top).alias(f"p{i}"), F.ln((1.0 - own) / (1.0 - top)).alias(f"a{i}")]
    telling = durable(by_bucket.filter(keep).select("b", *out))
    absent = telling.agg(*[F.sum(f"a{i}").alias(f"a{i}") for i in range(len(names))]).first()
    base = [math.log(total[d] / sum(total.values())) + (absent[f"a{i}"] or 0.0) for i, d in enumerate(names)]
    return names, base, telling.select("b", *[(F.col(f"p{i}") - F.col(f"a{i}")).alias(f"w{i}") for i in range(len(names))])


def memberships(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, p array) per id. The telling buckets, at most BUCKETS rows, are
    broadcast."""
    names, base, table = model
    words = _words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    told = words.join(F.broadcast(table), "b", "left") if table is not None else words
    sums = told.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), *[F.sum(f"w{i}").alias(f"s{i}") for i in range(len(names))])
    logits = F.array(*[F.lit(base[i]) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(len(names))]) if names else F.array().cast("array<double>")
    top = sums.select("doc_id", "n_tokens", logits.alias("z")).withColumn("m", F.array_max("z"))
    odds = top.select("doc_id", "n_tokens", F.transform("z", lambda x: F.exp(x - F.col("m"))).alias("e"))
    return odds.select("doc_id", "n_tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y)).alias("p"))


def _unprojected(gram: list[list[float]], at: list[float], start: list[float], goal: list[float], factors: list[float], ridge: float) -> list[float]:
    """Where gradient steps lead while the documents with positive rates stay the same."""
    eta, k = 1.0 / (1.0 + ridge), range(len(at))
    # The gradient shrinks by the ridge's share at least, so this many steps end below 1e-12.
    for _ in range(int(60 * (1.0 + ridge) / ridge)):
        pull = [(sum(gram[d][e] * at[e] for e in k) - goal[d]) / start[d] + ridge * (at[d] - factors[d]) for d in k]
        if max(map(abs, pull)) < 1e-12:
            return at
        at = [x - eta * g for x, g in zip(at, pull)]
    return at


def fit_rates(units: DataFrame, factors: list[float], ridge: float = 0.02, tolerance: float = 1e-6, most: int = 100) -> tuple[DataFrame, list[float], list[float]]:
    """``units`` (n_tokens, p) with a ``rate`` column; shares reached and shares wanted, of
    all tokens that were there."""
    k = range(len(factors))
    cells = [F.element_at("p", d + 1) for d in k]
    sums = units.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * c).alias(f"s{d}") for d, c in enumerate(cells)]).first()
    n_all = sums["n"] or 0
    if not n_all or not factors:
        return units.withColumn("rate", F.lit(1.0)), [], []
    start = [float(sums[f"s{d}"]) / n_all for d in k]
    goal = [f * s for f, s in zip(factors, start)]
    own = [max(s, 1e-300) for s in start]
    weight = F.col("n_tokens") / float(n_all)
    linear = lambda at: sum((F.lit(float(x)) * c for x, c in zip(at, cells)), F.lit(0.0))

    def projected(at: list[float]) -> tuple[list[list[float]], float]:
        """Gram matrix of the documents with positive rates, and the projected gradient."""
        row = units.filter(linear(at) > 0).agg(*[F.sum(weight * cells[d] * cells[e]).alias(f"g{d}_{e}") for d in k for e in k if e <= d]).first()
        gram = [[float(row[f"g{max(d, e)}_{min(d, e)}"] or 0.0) for e in k] for d in k]
        return gram, max(abs((sum(gram[d][e] * at[e] for e in k) - goal[d]) / own[d] + ridge * (at[d] - factors[d])) for d in k if start[d] > 0)

    at = [float(f) for f in factors]
    gram, left = projected(at)
    length = 1.0
    for _ in range(most):
        if left < tolerance:
            return units.withColumn("rate", F.greatest(F.lit(0.0), linear(at))), [sum(gram[d][e] * at[e] for e in k) for d in k], goal
        if length == 1.0:
            ahead = _unprojected(gram, at, own, goal, factors, ridge)
        trial = [x + length * (y - x) for x, y in zip(at, ahead)]
        there, rest = projected(trial)
        if rest < left:
            at, gram, left, length = trial, there, rest, 1.0
        else:
            length /= 2.0
    raise RuntimeError(f"rates have not settled after {most} projections: gradient {left}, wanted {goal}")


def fitted(docs: DataFrame, labels: DataFrame, factors: dict[str, float] | None = None) -> tuple[DataFrame, list[str], list[float], list[float]]:
    """Rates as ``document_rates``, the domains, and the token shares reached and wanted."""
    model = train(docs, labels)
    units = durable(memberships(docs, model)) if model[0] else memberships(docs, ([], [], None))
    wanted = FACTORS if factors is None else factors
    rates, reached, goal = fit_rates(units, [wanted.get(d, 1.0) for d in model[0]])
    return rates, model[0], reached, goal


def document_rates(docs: DataFrame, labels: DataFrame, factors: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_tokens, p, rate) for every id of ``docs``."""
    return fitted(docs, labels, factors)[0]


def mix(docs: DataFrame, labels: DataFrame, factors: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row repeated at its rate: the whole part always, the rest by a
    hash of the id, so a rate of 0 drops a row and a rate of 1 or more keeps it. Rows with
    a null id stay as they are."""
    rates = document_rates(docs, labels, factors).select(F.col("doc_id").alias("__mix_id"), F.col("rate").alias("__mix_rate"))
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.when(F.col("__mix_rate").isNull(), 1).otherwise(F.floor(F.col("__mix_rate") + draw).cast("int"))
    joined = docs.join(rates, F.col("doc_id").cast("long") == F.col("__mix_id"), "left")
    return joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
