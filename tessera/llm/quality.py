"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far each rule is to be trusted.

Rules are not independent: those that see the same kind of junk fire together. So a text is good or one of `KINDS` of junk, and each of
these has its own chance, per rule, that the rule's vote is bad. EM finds all of them and how common each kind is, from the
votes alone; priors say what a rule is written for and keep chances off 0 and 1, and nothing is held within bounds. A text
is kept if the posterior of good is a half at least.

Everything here is DataFrame expressions. The EM works on the table of vote patterns, which has at most
3 ** len(RULES) rows whatever the corpus holds, so each of its steps is one small aggregation and only
3 * len(RULES) rows of sums reach the driver.

Defined cases: a null text counts as empty, has no words, and fails (too short); equal rows get equal
results; an empty table gives an empty result (the priors then stand); other columns are passed through
by `quality_filter` and ignored by `score_quality`.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import materialise

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
ITERATIONS, CLOSE = 20, 1e-3  # EM stops after so many turns, or when no chance moves by more
GOOD, BAD, ABSTAIN = 1, -1, 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside `WINDOW`-word windows that occur at least twice in the text, first occurrences included."""

    def pairs(h: Column, apart: int) -> Column:
        """Hashes of twice as many words: each joined with the one `apart` further on."""
        return let(h, lambda x: F.slice(F.zip_with(x, F.slice(x, F.lit(apart + 1), F.size(x)), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size(x) - apart, F.lit(0))))

    def doubled(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        beside = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        starts = let(placed, lambda s: F.array_sort(F.transform(beside(s), lambda x: x["i"])))
        gaps = let(starts, lambda p: F.transform(p, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(p, k - 1)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    # A repeated window of eight words holds a repeated window of four: without one of those, nothing more is hashed.
    fours = pairs(pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2)
    counted = let(fours, lambda f: F.when(F.size(F.array_distinct(f)) == F.size(f), 0).otherwise(doubled(pairs(f, 4))))
    return F.when(F.size(words) < WINDOW, 0).otherwise(counted)


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measures that the rules read; `prefix` keeps them clear of columns that docs has."""
    p, t = prefix, F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn(f"{p}words", F.array_remove(F.split(t, SPACE), ""))
    words, bare = F.col(f"{p}words"), F.regexp_replace(t, SPACE, "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    return out.select(
        *[F.col(c) for c in docs.columns],
        long(F.size(words)).alias(f"{p}n_words"),
        long(F.length(bare)).alias(f"{p}word_chars"),
        long(F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))).alias(f"{p}n_symbols"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias(f"{p}n_dup_lines"),
        long(repeated_words(words)).alias(f"{p}n_repeat_words"),
        long(F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))).alias(f"{p}n_upper"),
        long(F.length(F.regexp_replace(t, r"[^!?]+", ""))).alias(f"{p}n_marks"),
        long(F.size(F.array_distinct(words))).alias(f"{p}n_distinct"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


#: Each rule, over the measures of one text: a vote for bad, for good, or neither. Thresholds are parameters of the rule set.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "length": lambda m: _vote(m("n_words") < 20, m("n_words") >= 60),
    "word_length": lambda m: _vote((m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 14 * m("n_words")), m("word_chars").between(3 * m("n_words"), 9 * m("n_words"))),
    "symbols": lambda m: _vote(10 * m("n_symbols") > m("n_words"), 100 * m("n_symbols") <= m("n_words")),
    "dup_lines": lambda m: _vote((m("n_dup_lines") >= 3) & (40 * m("n_dup_lines") > m("n_words")), m("n_dup_lines") == 0),
    "repeats": lambda m: _vote(10 * m("n_repeat_words") > 3 * m("n_words"), 100 * m("n_repeat_words") <= 5 * m("n_words")),
    "capitals": lambda m: _vote(10 * m("n_upper") > 4 * m("word_chars"), 100 * m("n_upper") <= 15 * m("word_chars")),
    "marks": lambda m: _vote(5 * m("n_marks") > m("n_words"), 50 * m("n_marks") <= m("n_words")),
    "variety": lambda m: _vote((m("n_words") >= 20) & (5 * m("n_distinct") < m("n_words")) & (m("n_distinct") < 200), (2 * m("n_distinct") >= m("n_words")) | (m("n_distinct") >= 300)),
}


def votes(measured: DataFrame, prefix: str = "") -> DataFrame:
    return measured.withColumns({f"{prefix}vote_{name}": rule(lambda c: F.col(prefix + c)) for name, rule in RULES.items()})


#: Kinds of junk and the rules written for each.
KINDS = {"fragment": ("length", "word_length"), "markup": ("symbols",), "repetition": ("dup_lines", "repeats", "variety"), "shouting": ("capitals", "marks")}
#: Beta priors of a bad vote, as (mean, votes that it weighs as much as): on good texts, on the kind that the rule is written for, on others.
PRIOR_GOOD, PRIOR_OWN, PRIOR_OTHER = (0.005, 100), (0.6, 20), (0.05, 20)


def _prior(kind: str, rule: str) -> tuple[float, float]:
    return PRIOR_GOOD if kind == "good" else PRIOR_OWN if rule in KINDS[kind] else PRIOR_OTHER


class Trust:
    """share: how common good and each kind are; bad: per kind and rule, the chance that the rule's vote, if it has one, is bad."""

    def __init__(self, sums: dict[tuple[str, int, str], float] | None = None) -> None:
        """sums: (rule, vote, kind) -> texts, in parts as the posterior of the kind has it."""
        got = sums or {}
        texts = {kind: sum(n for (rule, _, k), n in got.items() if k == kind and rule == next(iter(RULES))) for kind in ("good", *KINDS)}
        total = sum(texts.values()) + len(texts)
        self.share = {kind: (n + 1) / total for kind, n in texts.items()}
        self.bad = {}
        for kind in texts:
            for rule in RULES:
                mean, weight = _prior(kind, rule)
                bad, fine = (got.get((rule, v, kind), 0.0) for v in (BAD, GOOD))
                self.bad[kind, rule] = (bad + mean * weight) / (bad + fine + weight)

    def apart(self, other: Trust) -> float:
        """The largest difference of two estimates."""
        return max(*(abs(x - other.bad[k]) for k, x in self.bad.items()), *(abs(x - other.share[k]) for k, x in self.share.items()))

    def posterior(self, prefix: str = "") -> str:
        """SQL for the array of the probabilities of good and of each kind, in this order, given the votes."""
        like = []
        for kind, share in self.share.items():
            chances = {rule: self.bad[kind, rule] for rule in RULES}
            of_votes = [f"CASE `{prefix}vote_{r}` WHEN {BAD} THEN {log(p)!r}D WHEN {GOOD} THEN {log(1 - p)!r}D ELSE 0D END" for r, p in chances.items()]
            like.append(" + ".join([f"{log(share)!r}D", *of_votes]))
        return f"transform(array(array({', '.join(like)})), x -> transform(x, one -> 1D / aggregate(x, 0D, (total, y) -> total + exp(y - one))))[0]"


def _first_guess(prefix: str) -> str:
    """No bad vote: good. Else mostly junk, of the kinds whose rules say so. SQL, as of `Trust.posterior`."""
    hits = [" + ".join(f"CAST(`{prefix}vote_{rule}` = {BAD} AS DOUBLE)" for rule in rules) for rules in KINDS.values()]
    total = "aggregate(x, 0D, (total, y) -> total + y)"
    return f"transform(array(array({', '.join(hits)})), x -> if({total} > 0, concat(array(0.1D), transform(x, y -> 0.9D * y / {total})), concat(array(1D), transform(x, y -> 0D))))[0]"


def fit_trust(voted: DataFrame, prefix: str = "", iterations: int = ITERATIONS) -> Trust:
    """EM over the counts of vote patterns."""
    voted_by = [f"{prefix}vote_{name}" for name in RULES]
    patterns = voted.groupBy(*voted_by).agg(F.count(F.lit(1)).alias("n")).coalesce(1).checkpoint()
    trust, guess, names = Trust(), _first_guess(prefix), list(RULES)
    stacked = f"posexplode(array({', '.join(f'`{c}`' for c in voted_by)})) AS (rule, vote)"
    for _ in range(iterations):
        sums = [F.expr(f"sum(n * guess[{k}])").alias(kind) for k, kind in enumerate(trust.share)]
        rows = patterns.selectExpr("n", f"{guess} AS guess", stacked).groupBy("rule", "vote").agg(*sums).collect()  # 3 * len(RULES) rows at most
        before, trust = trust, Trust({(names[r["rule"]], r["vote"], kind): r[kind] for r in rows for kind in trust.share})
        guess = trust.posterior(prefix)
        if trust.apart(before) < CLOSE:
            break
    return trust


def _verdict(trust: Trust, prefix: str = "") -> tuple[Column, Column, Column]:
    m = lambda c: F.col(prefix + c)
    failed = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    good = F.expr(trust.posterior(prefix))[0]
    return failed, good, ~failed & (good >= 0.5)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its measures, base_failed, quality (posterior probability of good) and kept. Reads the texts once."""
    measured = materialise(votes(measure(docs.select(F.col(id_col), F.col(text)), text)).drop(text), "quality")
    failed, good, kept = _verdict(fit_trust(measured))
    return measured.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), F.round(good, 6).alias("quality"))


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns of docs only. Rows are written with their votes, so that no text is measured twice."""
    p = "_quality_"
    while any(c.lower().startswith(p) for c in docs.columns):
        p = f"_{p}"
    voted = votes(measure(docs, text, p), p)
    voted = materialise(voted.select(*docs.columns, f"{p}n_words", f"{p}n_repeat_words", *[f"{p}vote_{n}" for n in RULES]), "voted")
    _, _, kept = _verdict(fit_trust(voted, p), p)
    return voted.where(kept).select(*[F.col(c) for c in docs.columns])
