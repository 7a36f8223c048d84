r"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document; see RULES. Expectation-maximisation over the counts of all vote patterns
estimates, for either class, how often each rule votes what (smoothed by pseudo-counts under which a vote is
right thirty times in thirty-one), and so each rule's accuracy; a document's verdict is the posterior probability of quality, not that all rules pass.
The patterns are at most 3^rules (59049) and in fact a few dozen; their counts cover every document and are gathered in one row, on which
a SQL `aggregate` runs the rounds. The few numbers that it gives go into the plan of the scoring as literals.

Base figures: words are runs of characters other than 0x20 and 0x09-0x0D. `n_repeat_words` sorts the hashes of a text's three-word
windows with their positions; a window is repeated if a neighbour in that order is equal, and a word is counted if one covers it.

Defined cases: a null text has no words, and an empty or null text fails the base rule; an input of no documents gives an empty result
(the model stays at its pseudo-counts); repeated rows vote as often as they occur; other columns pass unchanged through `judged`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

WS = r"[\x20\x09-\x0D]+"
ROUNDS = 30


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more."""

    def windows(h: Column, with_place: bool) -> Column:
        one = lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
        return F.slice(F.transform(h, (lambda x, i: F.struct(one(x, i).alias("h"), i.alias("i"))) if with_place else one), 1, F.size(h) - 2)

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, first, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(p - a.last, F.lit(3))).alias("n")), lambda a: a.n)

    def of(h: Column) -> Column:
        again = lambda s: F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
        return _let(F.sort_array(windows(h, True)), lambda s: covered(F.array_sort(F.transform(again(s), lambda x: x.i))))

    none = F.lit(0).cast("long")
    distinct = lambda h: _let(windows(h, False), lambda g: F.size(F.array_distinct(g)) == F.size(g))
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 4, none).otherwise(_let(hashed, lambda h: F.when(distinct(h), none).otherwise(of(h))))


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and other figures that the rules use, all of the whole text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.withColumn("__w", F.array_remove(F.split(t, WS), "")).withColumn("__l", lines)
    long = lambda c: c.cast("long")
    only = lambda what: long(F.length(F.regexp_replace(t, what, "")))  # noqa: E731  what it takes away are long runs, which is cheap
    d = d.withColumns({
        "n_words": long(F.size("__w")), "word_chars": only(WS), "n_symbols": only(r"[^#*$%&|<>]+"), "n_lines": long(F.size("__l")), "n_dup_lines": long(F.size("__l") - F.size(F.array_distinct("__l"))),
        "n_repeat_words": _repeat_words(F.col("__w")), "n_upper": only(r"\P{Lu}+"), "n_letters": only(r"\P{L}+"), "n_shouts": only(r"[^!?]+"), "n_stops": only(r"[^.]+"),
    })
    return d.drop("__w", "__l")


def _vote(bad: Column, good: Column | None = None) -> Column:
    v = F.when(bad, -1)
    return (v if good is None else v.when(good, 1)).otherwise(0)


def _rules() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    calm = (c("n_upper") * 100 <= 15 * c("n_letters")) & (c("n_shouts") * 50 <= n) & (c("n_symbols") * 100 <= 4 * n)
    plain = ((c("n_dup_lines") < 3) | (100 * c("n_dup_lines") <= 30 * c("n_lines"))) & (100 * c("n_repeat_words") <= 30 * n) & (10 * c("n_letters") >= 8 * c("word_chars"))
    return {
        "length": _vote(n < 50),
        "word_length": _vote((c("word_chars") > 20 * n) | (c("word_chars") < 2 * n)),
        "symbols": _vote(100 * c("n_symbols") > 10 * n),
        "dup_lines": _vote((c("n_dup_lines") > 2) & (100 * c("n_dup_lines") > 30 * c("n_lines"))),
        "repeats": _vote(100 * c("n_repeat_words") > 50 * n),
        "capitals": _vote(100 * c("n_upper") > 40 * c("n_letters")),
        "shouting": _vote(100 * c("n_shouts") > 30 * n),
        "letters": _vote(10 * c("n_letters") < 7 * c("word_chars")),
        "sentences": _vote(c("n_stops") * 200 < n, (c("n_stops") * 40 >= n) & (c("n_stops") * 2 <= n)),
        "prose": _vote(F.lit(False), (n >= 50) & calm & plain),
    }


#: Names of the rules, in the order of a pattern's votes.
RULES = ("length", "word_length", "symbols", "dup_lines", "repeats", "capitals", "shouting", "letters", "sentences", "prose")


def voted(based: DataFrame) -> DataFrame:
    rules = _rules()
    return based.withColumn("votes", F.array(*[rules[k].cast("int") for k in RULES]))


# Posterior log-odds of one pattern x under a model m: its prior and, by rule and by vote + 1, the log-ratio of the classes' vote shares.
_ODDS = "aggregate(sequence(0, {k} - 1), ln(m.p / (1 - m.p)), (s, j) -> s + ln(m.g[j][x.v[j] + 1] / m.b[j][x.v[j] + 1]))"


def _em_sql(k: int, rounds: int, weight: float) -> str:
    """SQL over `pats` (array of (v votes, n count)): the model after the rounds."""
    prior_g, prior_b = (0.01 * weight, 0.69 * weight, 0.3 * weight), (0.3 * weight, 0.69 * weight, 0.01 * weight)
    odds = _ODDS.format(k=k)
    arr = lambda p: "array(" + ", ".join(f"{x / sum(p)}D" for x in p) + ")"
    start = f"named_struct('p', 0.8D, 'g', array_repeat({arr(prior_g)}, {k}), 'b', array_repeat({arr(prior_b)}, {k}))"
    posterior = f"transform(pats, x -> named_struct('v', x.v, 'a', x.n * (1D / (1D + exp(-greatest(-30D, least(30D, {odds}))))), 'n', x.n))"
    part = lambda take, p: f"transform(sequence(0, {k} - 1), j -> transform(sequence(0, 2), u -> (aggregate(q, 0D, (s, x) -> s + if(x.v[j] + 1 = u, {take}, 0D)) + array({', '.join(f'{x}D' for x in p)})[u]) / (aggregate(q, 0D, (s, x) -> s + {take}) + {sum(p)}D)))"
    step = f"transform(array({posterior}), q -> named_struct('p', (aggregate(q, 0D, (s, x) -> s + x.a) + 8D) / (aggregate(q, 0D, (s, x) -> s + x.n) + 10D), 'g', {part('x.a', prior_g)}, 'b', {part('(x.n - x.a)', prior_b)}))[0]"
    return f"aggregate(sequence(1, {rounds}), {start}, (m, r) -> {step})"


def model(voted: DataFrame, rounds: int = ROUNDS, weight: float = 20.0) -> tuple[float, list[list[float]], list[list[float]]]:
    """Prior of quality and, for good and bad documents, the share of each vote (-1, 0, 1) of each rule."""
    pats = voted.groupBy("votes").count().agg(F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("count").cast("double").alias("n")))).alias("pats"))
    m = pats.select(F.expr(_em_sql(len(RULES), rounds, weight)).alias("m")).first()["m"]
    return m["p"], [list(x) for x in m["g"]], [list(x) for x in m["b"]]


def accuracies(m: tuple[float, list[list[float]], list[list[float]]]) -> dict[str, float]:
    """How often each rule is right when it votes, by the model."""
    p, g, b = m
    return {k: (p * g[j][2] + (1 - p) * b[j][0]) / (p * (g[j][0] + g[j][2]) + (1 - p) * (b[j][0] + b[j][2])) for j, k in enumerate(RULES)}


def posterior(m: tuple[float, list[list[float]], list[list[float]]]) -> Column:
    """Posterior probability of quality, of the column votes."""
    p, g, b = m
    odds = F.log(F.lit(p / (1 - p)))
    for j in range(len(RULES)):
        v = F.col("votes")[j]
        odds = odds + F.when(v == -1, F.log(F.lit(g[j][0] / b[j][0]))).when(v == 0, F.log(F.lit(g[j][1] / b[j][1]))).otherwise(F.log(F.lit(g[j][2] / b[j][2])))
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with the base figures, votes, quality_probability, base_failed and kept. docs should be a written table or a scan: it is read
    once, and its figures are written (with all columns of docs) before the model is fitted."""
    t = store.written(voted(base(docs, text)), "votes")
    return t.withColumn("quality_probability", posterior(model(t))).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))


def digest(documents: DataFrame) -> DataFrame:
    t = store.written(voted(base(documents.select("doc_id", "text"))).drop("text"), "votes")
    t = t.withColumn("quality_probability", posterior(model(t))).withColumn("base_failed", base_failed())
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality_probability") >= 0.5)).alias("kept"), "quality_probability")
