"""Texts cut off by field limits or in transfer.

Two kinds of evidence are combined. The length: for each source a lognormal law of lengths is fitted by maximum
likelihood, right-censored at every candidate limit, which are its greatest length and the lengths at which texts pile up. The law says
how many texts would have a length by nature, and the excess there is the posterior probability that a text of that length
was censored. Lengths are taken in characters and in bytes, with and without the mark or note that a source
adds, per source and over all sources (a transfer breaks off at block sizes whatever the source). The ending:
whether the text closes its sentences, formulas and environments (``endings``), in a dozen classes.

How much an ending says isn't set but estimated on the same corpus: an EM over length posteriors and endings gives the
share of each class among texts that were cut and among whole ones. Texts of one limit, or of one source where no limit is near, form a
group; its share of cut texts starts from the length posterior and is corrected by the endings found in the group. A text's log odds are
those of its group plus those of its ending. A closed ending is no case, however likely its length makes a cut: padding
and complete files of just that size aren't cut texts.

Lengths and endings are counted before they are shuffled, and laws are fitted on histograms, so a source with a
third of all texts costs no more than any other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col
from millrace.functions.joins import join_measured
from millrace.llm.endings import CLOSED, ENDINGS, OPEN, REMARK, UNSURE, detail, without_mark
from millrace.sources import workspace
from millrace.sources.workers import ship

#: Where the EM starts: the share of each class of endings among cut and among whole texts. That is worth ``WORTH`` texts, but for open
#: ends of whole texts as many as there are: that a whole text hardly ever looks open is what tells cuts in transfer from them.
START, WORTH = {OPEN: (0.15, 2e-5), UNSURE: (0.05, 0.05), REMARK: (0.005, 0.02)}, 10.0
#: The share of texts with an ellipsis: cut where no limit is near, cut at a limit, and whole; of closed texts cut and whole.
MARKED, CLOSED_MARKED = (0.01, 0.3, 0.001), (0.01, 1e-6)
#: Prior probability that any one length is a limit, and that a source has a limit at its greatest length; share of cut texts where
#: no limit is near, before any is seen, and how many texts such a prior is worth.
LIMIT_PRIOR, TOP_PRIOR, CUT_PRIOR, GROUP_WORTH = 1e-3, 0.05, 0.02, 5.0
#: Different texts of one length that make it a candidate limit; one or two say nothing where the law fits badly.
FEWEST = 3
#: Units below a limit in which a text ends that is cut back to a word; bins per unit of log length; posterior that matters.
BACK, BINS, LEAST = 24, 64, 0.02
#: Length posteriors that are told apart while endings are weighed.
GRADES = (0.1, 0.3, 0.5, 0.8, 0.95)
ROUNDS = 60


def _normal(z: np.ndarray) -> np.ndarray:
    """The normal law's density."""
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _tail(z: np.ndarray) -> np.ndarray:
    """The chance to exceed each of some standard scores."""
    return np.array([0.5 * math.erfc(min(x, 36.0) / math.sqrt(2)) for x in z])


def censored_lognormal(logs: np.ndarray, counts: np.ndarray, limits: np.ndarray, censored: np.ndarray, start: tuple[float, float] | None = None) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood (EM): ``counts`` texts of known length, and of each limit ``censored``
    texts of which only that is known that they exceed it."""
    limits, censored = np.atleast_1d(np.asarray(limits, float)), np.atleast_1d(np.asarray(censored, float))
    n, n_cut = counts.sum(), censored.sum()
    if n == 0:
        return (float(limits.max()), 1.0) if len(limits) else (0.0, 1.0)
    first, second = float((logs * counts).sum()), float((logs**2 * counts).sum())
    mean, s = start or (first / n, math.sqrt(max(1e-6, second / n - (first / n) ** 2)))
    for _ in range(200 if n_cut else 1):
        z = np.minimum((limits - mean) / s, 6.0)
        hazard = _normal(z) / np.maximum(_tail(z), 1e-12)
        beyond, beyond_squared = mean + s * hazard, mean**2 + s**2 + s * hazard * (limits + mean)
        new = (first + float((censored * beyond).sum())) / (n + n_cut)
        s_new = math.sqrt(max(1e-6, (second + float((censored * beyond_squared).sum())) / (n + n_cut) - new**2))
        done = abs(new - mean) + abs(s_new - s) < 1e-6
        mean, s = new, s_new
        if done:
            break
    return mean, max(s, 1e-3)


def _evidence_for_limit(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log Bayes factors of limits where ``n`` texts lie and ``expected`` would by nature (Poisson)."""
    expected = np.maximum(expected, 1e-3)
    return np.where(n > expected, n * np.log(np.maximum(n, 1e-9) / expected) - (n - expected), 0.0)


def limits_of(logs: np.ndarray, counts: np.ndarray, lengths: np.ndarray, n: np.ndarray, top: int) -> np.ndarray:
    """The posterior that a text of each candidate length was censored there.

    ``logs, counts`` is the histogram of the other lengths and ``n`` the texts of each candidate in ``lengths``. Law and posteriors
    determine each other, so they are found in turns. Texts up to ``BACK`` below the greatest length ``top`` count as one limit: some
    sources cut back to the end of a word.
    """
    lengths, n = np.asarray(lengths, float), np.asarray(n, float)
    near = lengths >= top - BACK
    total, at = counts.sum() + n.sum(), np.log(np.maximum(lengths, 1.0))
    edge = math.log(max(1.0, top - BACK))
    posterior, law = np.zeros(len(n)), None
    for _ in range(20):
        whole = n * (1 - posterior)
        law = censored_lognormal(np.concatenate([logs, at]), np.concatenate([counts, whole]), np.where(near, edge, at), n * posterior, law)
        mean, s = law
        natural = total * _normal((at - mean) / s) / (np.maximum(lengths, 1.0) * s)
        spike = 1 / (1 + np.exp(-np.clip(math.log(LIMIT_PRIOR / (1 - LIMIT_PRIOR)) + _evidence_for_limit(n, natural), -60, 60)))
        new = np.where(n >= FEWEST, spike * np.maximum(0.0, 1 - natural / np.maximum(n, natural)), 0.0)
        # all that lies near the top together; below the top itself it takes several texts of one length
        low, high = _tail(np.array([(edge - mean) / s, (math.log(top + 1.0) - mean) / s]))
        n_near, expected = n[near].sum(), total * (low - high)
        odds = math.log(TOP_PRIOR / (1 - TOP_PRIOR)) + float(_evidence_for_limit(np.array([n_near]), np.array([expected]))[0])
        of_top = max(0.0, 1 - expected / max(1.0, n_near)) / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        new = np.where(near & ((lengths == top) | (n >= FEWEST)), np.maximum(new, of_top), new)
        done = np.abs(new - posterior).max(initial=0.0) < 1e-4
        posterior = new
        if done:
            break
    return posterior


def _features(text: pd.Series) -> pd.DataFrame:
    out = []
    for t in text:
        if t is None:
            out.append((UNSURE, False, 0, 0))
            continue
        body, marked = without_mark(t)
        out.append((detail(body), marked and "\\end{document}" not in body[-40:], len(body), len(body.encode(errors="surrogatepass"))))
    return pd.DataFrame(out, columns=["ending", "marked", "body_chars", "body_bytes"])


def features(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: its ending and its lengths. Reads each whole text once."""
    ship(documents.sparkSession)
    udf = F.pandas_udf(_features, "ending string, marked boolean, body_chars long, body_bytes long")
    rows = documents.select(col(id).alias("id"), col(source).alias("source"), F.length(col(text)).alias("chars"), F.octet_length(col(text)).alias("bytes"), F.xxhash64(col(text)).alias("hash"), udf(col(text)).alias("f"))
    return rows.select("id", "source", "chars", "bytes", "hash", "f.*")


def _own(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("?"))


def _measures(scopes: Column) -> Column:
    """The lengths of a document that may be a limit, in each of some scopes."""
    lengths = {"chars": "chars", "bytes": "bytes", "body chars": "body_chars", "body bytes": "body_bytes"}
    return F.flatten(F.transform(scopes, lambda s: F.array(*[F.struct(s.alias("scope"), F.lit(m).alias("measure"), F.col(c).cast("long").alias("len")) for m, c in lengths.items()])))


def limits(feats: DataFrame) -> DataFrame:
    """Lengths at which texts were censored: ``scope, measure, len, n, posterior`` above ``LEAST``; scope ``*`` is all sources.

    Equal texts of one scope count once, or copies of one article would look like a limit.
    """
    texts = feats.filter("chars > 0").groupBy("hash", "chars", "bytes", "body_chars", "body_bytes").agg(F.collect_set(_own(F.col("source"))).alias("sources"))
    rows = texts.select(F.explode(_measures(F.concat("sources", F.array(F.lit("*"))))).alias("m")).select("m.*")
    exact = rows.groupBy("scope", "measure", "len").agg(F.count("*").alias("n"))
    log = F.log(F.greatest(F.col("len"), F.lit(1)).cast("double"))
    exact = workspace.keep(exact.withColumn("bin", F.floor(log * BINS)), "lengths")
    key = ["scope", "measure"]
    bins = exact.groupBy(*key, "bin").agg(F.sum("n").alias("in_bin"))
    width = F.greatest(F.floor(F.exp((F.col("bin") + 1) / BINS)) - F.floor(F.exp(F.col("bin") / BINS)), F.lit(1))
    tops = exact.groupBy(*key).agg(F.max("len").alias("top"))
    # a candidate holds several times what its neighbours do, or lies near the top; what's no candidate tells only of the law
    around = (F.col("in_bin") - F.col("n")) / F.greatest(width - 1, F.lit(1))
    graded = exact.join(bins, [*key, "bin"]).join(tops, key).withColumn("candidate", (F.col("len") >= F.col("top") - BACK) | (F.col("n") >= FEWEST) & (F.col("n") > 3 * around))
    plain = F.sum(F.when(~F.col("candidate"), F.col("n")))
    hist = graded.groupBy(*key, "bin").agg(plain.alias("n"), (F.sum(F.when(~F.col("candidate"), F.col("n") * log)) / plain).alias("log"), F.collect_list(F.when(F.col("candidate"), F.struct("len", "n"))).alias("c"))
    hist = hist.groupBy(*key).agg(F.collect_list(F.when(F.col("n") > 0, F.struct("log", "n"))).alias("b"), F.sort_array(F.flatten(F.collect_list("c"))).alias("c")).join(tops, key)

    def fit(logs: pd.Series, counts: pd.Series, lengths: pd.Series, n: pd.Series, top: pd.Series) -> pd.Series:
        return pd.Series([limits_of(np.asarray(a, float), np.asarray(b, float), c, d, t).tolist() for a, b, c, d, t in zip(logs, counts, lengths, n, top, strict=True)])

    fit.__annotations__ = {}
    found = hist.select(*key, "c", F.pandas_udf(fit, "array<double>")("b.log", "b.n", "c.len", "c.n", "top").alias("p"))
    found = found.select(*key, F.explode(F.arrays_zip("c", "p")).alias("z")).select(*key, "z.c.len", "z.c.n", F.col("z.p").alias("posterior"))
    return found.filter(F.col("posterior") > LEAST)


# -- endings ------------------------------------------------------------------------------------------------


def _start(endings: list[str]) -> np.ndarray:
    """Shares of each ending among cut and whole texts to start from; a closed end without a mark is no case by what a case is."""
    known = {CLOSED: (0.0, 1.0), CLOSED + "+": CLOSED_MARKED}
    return np.array([known.get(e) or START[e.partition(" ")[0]] for e in endings]).T


def weigh(grades: np.ndarray, classes: list[str], counts: np.ndarray) -> tuple[dict[str, float], dict[str, float], float]:
    """What each class of endings says of a cut, as log odds, where no limit is near and at a limit, by EM; and the share of cut texts
    where none is near.

    ``counts`` has a row per grade of length posteriors and a column per class; ``grades`` are the mean posteriors, the first that of no
    limit. A class is an ending, with a plus if an ellipsis follows; sources add those at their limits, so how often a cut
    text has one depends on whether a limit is near, while its ending doesn't.
    """
    if not classes:
        return {}, {}, CUT_PRIOR
    marked = np.array([c.endswith("+") and not c.startswith(CLOSED) for c in classes])
    free = np.array([not c.startswith(CLOSED) for c in classes])
    endings = sorted({*ENDINGS, *(c.rstrip("+") if f else c for c, f in zip(classes, free, strict=True))})
    of = np.array([endings.index(c.rstrip("+") if f else c) for c, f in zip(classes, free, strict=True)])
    start, is_open = _start(endings), np.array([e.startswith(OPEN) for e in endings])
    shares, marks, alpha = start.copy(), list(MARKED), np.clip(np.asarray(grades, float), 1e-3, 0.999)

    def with_mark(m: float) -> np.ndarray:
        return np.where(free, np.where(marked, m, 1 - m), 1.0)

    def likelihoods() -> tuple[np.ndarray, np.ndarray]:
        cut = np.array([with_mark(marks[0])] + [with_mark(marks[1])] * (len(alpha) - 1)) * shares[0][of]
        return cut, with_mark(marks[2]) * shares[1][of]

    for _ in range(ROUNDS):
        cut, whole = likelihoods()
        cut, whole = alpha[:, None] * cut, (1 - alpha[:, None]) * whole
        of_cut = counts * cut / np.maximum(cut + whole, 1e-300)
        of_whole = counts - of_cut
        alpha[0] = (of_cut[0].sum() + CUT_PRIOR * GROUP_WORTH) / (counts[0].sum() + GROUP_WORTH)
        for k, weight in enumerate((of_cut.sum(axis=0), of_whole.sum(axis=0))):
            worth = np.where(is_open & (k == 1), weight.sum() + WORTH, WORTH)
            shares[k] = (np.bincount(of, weight, len(endings)) + worth * start[k]) / (weight.sum() + worth)
            shares[k] /= shares[k].sum()
        for k, weight in enumerate((of_cut[0], of_cut[1:].sum(axis=0), of_whole.sum(axis=0))):
            marks[k] = (weight[marked].sum() + WORTH * MARKED[k]) / (weight[free].sum() + WORTH)
    cut, whole = likelihoods()
    says = np.clip(np.log(np.maximum(cut, 1e-300)) - np.log(np.maximum(whole, 1e-300)), -60, 60)
    return dict(zip(classes, says[0].tolist(), strict=True)), dict(zip(classes, says[-1].tolist(), strict=True)), float(alpha[0])


def _share(prior: float, says: np.ndarray, counts: np.ndarray) -> float:
    """The share of cut texts in a group, from its prior and the endings in it (EM)."""
    alpha = prior
    for _ in range(ROUNDS):
        odds = np.clip(math.log(alpha / (1 - alpha)) + says, -60, 60)
        new = (float((counts / (1 + np.exp(-odds))).sum()) + GROUP_WORTH * prior) / (counts.sum() + GROUP_WORTH)
        done, alpha = abs(new - alpha) < 1e-9, min(max(new, 1e-9), 1 - 1e-9)
        if done:
            break
    return alpha


def truncated(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lengths: bool = True) -> DataFrame:
    """Per document ``id, source, evidence, posterior, odds, is_cut``.

    ``posterior`` is that of the length, ``odds`` the combined log odds. A null or empty text isn't cut. Documents without a
    source are taken as one source. ``id`` must be unique and not null. Without ``lengths`` the length evidence is left out, to
    see what it decides.
    """
    feats = workspace.keep(features(documents, id, text, source), "endings")
    found = limits(feats) if lengths else limits(feats).limit(0)
    found = workspace.keep(found.select("scope", "measure", "len", "posterior"), "length-limits")
    places = feats.select("id", F.explode(_measures(F.array(_own(F.col("source")), F.lit("*")))).alias("m")).select("id", "m.*")
    best = F.max(F.struct("posterior", "scope", "measure", "len")).alias("best")
    hits = join_measured(places, found, ["scope", "measure", "len"], "inner").groupBy("id").agg(best).select("id", "best.posterior", F.concat_ws(" ", "best.scope", "best.measure", F.col("best.len").cast("string")).alias("place"))
    prior = F.coalesce("posterior", F.lit(0.0))
    grade = sum((F.when(prior > g, 1).otherwise(0) for g in (LEAST, *GRADES)), F.lit(0))
    rows = feats.filter("chars > 0").join(hits, "id", "left").select(
        "id", "hash", "source", F.concat("ending", F.when(F.col("marked"), "+").otherwise("")).alias("class"), prior.alias("posterior"), grade.alias("grade"), F.coalesce("place", _own(F.col("source"))).alias("group")
    )
    rows = workspace.keep(rows, "graded-endings")
    # equal texts of one group count once here as well
    texts = workspace.keep(rows.groupBy("group", "class", "grade", "posterior", "hash").agg(F.lit(1)).groupBy("group", "class", "grade", "posterior").agg(F.count("*").alias("n")), "ending-counts")
    # at most as many rows as there are grades and classes
    table = texts.groupBy("grade", "class").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("posterior")).alias("p")).toPandas()
    classes = sorted(set(table["class"]))
    counts = np.zeros((len(GRADES) + 2, len(classes)))
    if classes:
        counts[table["grade"], [classes.index(c) for c in table["class"]]] = table["n"]
    sums = table.groupby("grade")["p"].sum().reindex(range(len(counts)), fill_value=0.0).to_numpy()
    means = np.where(counts.sum(axis=1) > 0, sums / np.maximum(counts.sum(axis=1), 1), 0.5)
    means[0] = CUT_PRIOR
    apart, at_limit, usual = weigh(means, classes, counts)

    def share(posterior: pd.Series, kinds: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for p, ks, c in zip(posterior, kinds, n, strict=True):
            says = at_limit if p > 0 else apart
            out.append(_share(min(max(p if p > 0 else usual, 1e-3), 0.999), np.array([says[k] for k in ks]), np.asarray(c, float)))
        return pd.Series(out, dtype=float)

    share.__annotations__ = {}
    held = texts.groupBy("group", "class").agg(F.sum("n").alias("n"), F.max("posterior").alias("p")).groupBy("group").agg(F.collect_list(F.struct("class", "n")).alias("c"), F.max("p").alias("p"))
    shares = workspace.keep(held.select("group", F.pandas_udf(share, "double")("p", "c.class", "c.n").alias("share")), "cut-shares")
    weight = F.coalesce(F.lit(None).cast("double"), *[F.when((F.col("class") == k) & near, F.lit(w)) for near, says in ((F.col("posterior") > 0, at_limit), (F.col("posterior") == 0, apart)) for k, w in says.items()], F.lit(0.0))
    odds = join_measured(rows, shares, ["group"], "left").select("id", "source", F.split("class", "[ +]")[0].alias("evidence"), "posterior", (F.log(F.col("share") / (1 - F.col("share"))) + weight).alias("odds"))
    none = feats.filter("chars is null or chars = 0").select("id", "source", F.lit(UNSURE).alias("evidence"), F.lit(0.0).alias("posterior"), F.lit(-60.0).alias("odds"))
    out = odds.unionByName(none)
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "evidence", "posterior", "odds", (F.col("odds") > 0).alias("is_cut"))


def by_source(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each source truncates: ``source, n_docs, n_cut, share``."""
    rows = truncated(documents, id, text, source).groupBy(col(source)).agg(F.count("*").alias("n_docs"), F.count_if("is_cut").alias("n_cut"))
    return rows.withColumn("share", F.col("n_cut") / F.col("n_docs"))
