import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import truncation as T
from millrace.llm.endings import CLOSED, OPEN, REMARK, UNSURE, ending, without_mark

DOC = "\\documentclass{article}\n\\begin{document}\nWords come first.\n\n"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("A sentence.", CLOSED), ("Is it?\n", CLOSED), ("As shown~\\cite{a}.", CLOSED), ("It ends (here.)", CLOSED), (DOC + "More words.", CLOSED), (DOC + "no stop\n\\end{document}\n% old ending: the beam and", CLOSED),
        ("Done.\n\n\\clearpage", CLOSED), ("Done.\n\\bibliographystyle{plain}\n\\bibliography{refs}\n", CLOSED), ("Done.\n\\input{sections/x}", CLOSED), ("Done.\n%%%%%%%%%%", CLOSED), ("Done.\n% A remark that ends.", CLOSED), ("Done.\n% a long remark\n% over two lines.\n\\endinput", CLOSED),
        ("\\begin{equation}\na = b\n\\end{equation}", CLOSED), ("Costs 5\\% and \\$3.", CLOSED), ("A broken $\\sum_{i} Each whole word follows here.", CLOSED), ("Broken {\\bf here\n\nbut fine later.", CLOSED), ("\\begin{figure}\nlost\n\\section{Next}\nAll is well.", CLOSED),
        ("It ends in a wo", OPEN), ("It ends without", OPEN), ("A comma,", OPEN), ("About 7\\%", OPEN), ("with $a = b", OPEN), ("with $a = b.", OPEN), ("\\begin{figure}\n\\caption{A whole sentence.}\n", OPEN), ("\\begin{thebibliography}{9}\n\\bibitem{a} A. Bee, 3 (2004).", OPEN),
        ("Words.\n\n\\section{Disc", OPEN), ("Words.\n\\bi", OPEN), ("\\section{Data}\\label", OPEN), ("Done.\n\\bibliography", OPEN), ("\\section{Data}\\label{sec:d}\n\nDone.", CLOSED), ("Words.\n\\end{docu", OPEN), ("\\iffalse\nA draft.", OPEN), ("\\documentclass{article}\n\\usepackage{x}", OPEN), ("No stop\n% end of file", OPEN), ("% a draft line\nSome words\n% more", OPEN),
        ("Done.\n% end of section\n", REMARK), ("Done.\n\n% the mild beam", REMARK), ("", UNSURE), ("   \n", UNSURE), ("% only a remark", UNSURE),
    ],
)
def test_ending(text, kind):
    assert ending(text) == kind


def test_marks():
    assert without_mark("cut her...") == ("cut her", True) and without_mark("cut her […]")[1] and without_mark("cut her…\n")[1]
    assert without_mark("cut her [truncated]")[0] == "cut her" and without_mark("cut her\n% -- copied 2020-01-02") == ("cut her", False)
    assert without_mark("All is said.") == ("All is said.", False)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8])
def test_maximum_likelihood_finds_the_law_behind_a_limit(share):
    r = np.random.default_rng(1)
    logs = r.normal(7.5, 0.6, 20_000)
    limit = float(np.quantile(logs, 1 - share)) if share else 99.0
    seen = logs[logs < limit]
    mean, s = T.censored_lognormal(seen, np.ones(len(seen)), limit, float((logs >= limit).sum()))
    assert abs(mean - 7.5) < 0.05 and abs(s - 0.6) < 0.05


def test_law_and_several_limits_are_found_together():
    r = np.random.default_rng(2)
    lengths = np.exp(r.normal(7.5, 0.6, 30_000)).astype(int)
    subject = r.choice([10**9, 1500, 3000], len(lengths), p=[0.5, 0.2, 0.3])
    held = np.minimum(lengths, subject)
    size, n = np.unique(held, return_counts=True)
    atoms = (n > 60) | (size >= size.max() - T.BACK)
    posterior = dict(zip(size[atoms], T.limits_of(np.log(size[~atoms]), n[~atoms].astype(float), size[atoms], n[atoms], int(size.max())), strict=True))
    for limit in (1500, 3000):
        natural = (lengths == limit).sum()
        true = 1 - natural / (held == limit).sum()
        assert abs(posterior[limit] - true) < 0.02
    assert max(p for x, p in posterior.items() if x not in (1500, 3000)) < 0.5


def test_weights_of_endings_are_estimated():
    classes = ["closed", "open word", "open word+", "remark part"]
    # where no limit is near 2 % are cut; at a limit most are, and bear a mark there; remarks don't depend on length
    counts = np.array([[9500, 195, 5, 300], [20, 300, 660, 1]], float)
    apart, at_limit, share = T.weigh(np.array([0.02, 0.98]), classes, counts)
    assert 0.01 < share < 0.03 and apart["closed"] == -60
    assert apart["open word"] > 5 and at_limit["open word+"] > at_limit["open word"] > 5 and apart["remark part"] < -2


def sentence(r):
    return " ".join(r.choice(["the", "beam", "field", "yields", "a", "small", "größere", "phase"]) for _ in range(r.randrange(6, 14))) + "."


def corpus(seed=1, n=900):
    """Three sources: one with a limit, one with a limit in bytes that adds an ellipsis, one without. Returns rows and the cut."""
    r, rows, cut = random.Random(seed), [], set()
    for i in range(n):
        source = ("clean", "hard", "dots")[i % 3]
        target = math.exp(r.gauss(6.3, 0.7))
        t = sentence(r)
        while len(t) < target:
            t += r.choice([" ", "\n\n"]) + sentence(r)
        if r.random() < 0.2:
            t += "\n\n% end of section\n"
        if source == "hard" and len(t) > 700:
            t = t[:700]
        elif source == "dots" and len(t.encode()) > 900:
            t = t.encode()[:897].decode(errors="ignore") + "..."
        elif source == "clean" and r.random() < 0.03:
            t = t[: len(t) * 2 // 3]
        else:
            rows.append((i, t, source, 1))
            continue
        rows.append((i, t, source, 1))
        if ending(without_mark(t)[0]) != CLOSED or t.endswith("..."):
            cut.add(i)
    return rows, cut


def test_cut_texts_and_shares_per_source(spark):
    rows, cut = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, evidence int")
    out = {r.doc_id: r for r in T.truncated(docs).collect()}
    assert {i for i, r in out.items() if r.is_cut} == cut and len(cut) > 150
    shares = {r.source: r for r in T.by_source(docs).collect()}
    for s in ("clean", "hard", "dots"):
        mine = [r for r in rows if r[2] == s]
        assert shares[s].n_docs == len(mine) and shares[s].n_cut == sum(r[0] in cut for r in mine)
    limits = {(r.scope, r.measure, r.len): r.posterior for r in T.limits(T.features(docs)).collect()}
    assert limits["=hard", "chars", 700] > 0.9 and limits["=dots", "bytes", 900] > 0.9
    assert max((p for (s, _, n), p in limits.items() if s == "=clean" and n < 900), default=0) < 0.9


def test_a_remark_counts_as_cut_only_at_a_limit(spark):
    r = random.Random(2)
    rows = [(i, ("A full sentence stands here. " * 40)[:600], "s") for i in range(3)]
    rows += [(10 + i, " ".join(r.choice(["one", "two", "three"]) for _ in range(900))[:2000], "s") for i in range(60)]
    body = "One sentence ends here.\n% a remark and "
    rows += [(100, body + "x" * (2000 - len(body)), "s"), (101, body + "more", "s"), (102, "Short one.\n% end", "s")]
    rows += [(200 + i, sentence(r) * r.randrange(1, 30), "s") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in T.truncated(docs).collect()}
    # without the lengths nothing tells this remark from others
    assert {x.doc_id for x in T.truncated(docs, lengths=False).collect() if x.is_cut != got[x.doc_id].is_cut} == {100}
    assert got[100].is_cut and got[100].evidence == REMARK and not got[101].is_cut and not got[102].is_cut


def test_one_open_end_among_very_many_whole_texts_is_no_cut_unless_at_a_limit(spark):
    r = random.Random(5)
    whole = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("All is said in text "), "id", F.lit(" "), F.repeat(F.lit("y"), (F.col("id") * 7919 % 3001).cast("int")), F.lit(" here.")).alias("text"), F.lit("big").alias("source"))
    few = [(10**6, "It ends in a wo", "big"), (10**6 + 1, "It ends in a wo", "small")]
    few += [(10**7 + i, " ".join(r.choice(["one", "two", "three"]) for _ in range(900))[:2000], "small") for i in range(60)]
    few += [(2 * 10**7 + i, sentence(r) * r.randrange(1, 30), "small") for i in range(80)]
    docs = whole.unionByName(spark.createDataFrame(few, "doc_id long, text string, source string"))
    cut = {x.doc_id for x in T.truncated(docs).filter("is_cut").collect()}
    assert cut == {10**6 + 1, *range(10**7, 10**7 + 60)}


def test_padding_at_the_limit_is_no_cut(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["one", "two"]) for _ in range(400))[:1000], "s") for i in range(40)] + [(50, "All is said.\n" + "%" * 987, "s")]
    assert {x.doc_id for x in T.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("not is_cut").collect()} == {50}


def test_nulls_empty_and_very_long(spark):
    schema = "doc_id long, text string, source string, posterior double"
    assert T.truncated(spark.createDataFrame([], schema)).count() == 0 and T.by_source(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "s", 0.0), (2, "", None, None), (3, "It ends in a wo", None, 0.0), (4, "All is said.", None, 0.0), (5, "x " * 1_000_000 + "end.", "s", 0.0), (6, "{" * 300_000, "s", 0.0), (7, "% " * 100_000, "s", 0.0), (8, "\\clearpage" * 2000, "s", 0.0), (9, "% a\n" * 20_000, "s", 0.0)]
    got = {r.doc_id: r.is_cut for r in T.truncated(spark.createDataFrame(rows, schema)).collect()}
    assert not got[1] and not got[2] and got[3] and not got[4] and not got[5] and got[6]


def test_copies_of_one_text_are_no_limit(spark):
    rows = [(i, "One sentence ends here.\n% end of section", "s") for i in range(500)] + [(1000 + i, sentence(random.Random(i)) * (1 + i % 20), "s") for i in range(300)]
    assert T.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("is_cut").count() == 0
