"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at counts of a text and votes good (1), bad (-1) or abstains (0). No rule decides alone: expectation-maximisation over
all documents estimates, without labels, how often texts are good, how often each rule that votes is right about good texts, and how often about bad ones.
Given whether the text is good, votes count as independent and an abstention as no evidence. A text is kept if its posterior probability of being good reaches ``keep_at``.

Texts pass by once: their counts are stored, and documents with equal votes are one row of a table of at most 3^rules rows, which is all that the
iterations read. So the estimates are those over all documents, and only these few counts and parameters reach the driver.

Words are runs between ASCII blanks. Two rules are absolute and stand before the votes (base_failed): fewer than ten words, or more than 20 % of
the words in repeated five-word windows; windows are told apart by 64-bit hashes of their words' hashes. A null text counts as an empty one: no words, failed. Each row is judged by
itself, so repeated rows and rows of one id get equal verdicts if their texts are equal; null ids are ordinary values. Texts of any length are read whole: windows are sorted in their
row, none is shuffled. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecatlas.llm.common import documents, stash

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_ends", "n_runs"]


@dataclass(frozen=True)
class Rule:
    """A vote by SQL conditions on the counts of a text: good where ``good`` holds, else bad where ``bad`` holds, else none."""

    name: str
    good: str
    bad: str


RULES = [
    Rule("length", "n_words BETWEEN 50 AND 100000", "n_words < 20"),
    Rule("word length", "word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("repeated lines", "n_lines >= 2 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated words", "100 * n_repeat_words <= 2 * n_words", "100 * n_repeat_words > 10 * n_words"),
    Rule("letters", "100 * n_letters >= 93 * word_chars", "100 * n_letters < 88 * word_chars"),
    Rule("capitals", "10 * n_capitals <= 2 * n_letters", "10 * n_capitals > 5 * n_letters"),
    Rule("sentences", "100 * n_ends BETWEEN 2 * n_words AND 34 * n_words", "n_words >= 50 AND (n_ends = 0 OR 10 * n_ends > 6 * n_words)"),
    Rule("runs of signs", "100 * n_runs <= n_words", "10 * n_runs > n_words"),
]
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
ROUNDS, PRIOR, KEEP_AT = 40, (8.0, 2.0), 0.5
START = (0.8, 0.98, 0.4)  # most texts are good; a rule rarely finds fault with them, and sees two in five bad texts, each kind of fault having its own rules


@dataclass(frozen=True)
class Model:
    """The share of good texts, and how often each rule's votes are right about good and about bad texts."""

    good: float
    on_good: list[float]
    on_bad: list[float]

    def evidence(self) -> tuple[float, list[float], list[float]]:
        """Log odds before any vote, and what a vote for good and one for bad adds."""
        pairs = list(zip(self.on_good, self.on_bad, strict=True))
        return math.log(self.good / (1 - self.good)), [math.log(g / (1 - b)) for g, b in pairs], [math.log((1 - g) / b) for g, b in pairs]


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS of every text."""
    own = documents(docs, id_col, text_col)
    trimmed = F.btrim("text", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    rows = own.select(
        "doc_id",
        words.alias("w"),
        lines.alias("lines"),
        F.length(F.translate("text", BLANKS, "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        left(r"[^\p{L}]+").alias("n_letters"),
        left(r"[^\p{Lu}]+").alias("n_capitals"),
        F.regexp_count(F.concat("text", F.lit(" ")), F.lit(r"[.!?][ \t\n\x0B\f\r]")).alias("n_ends"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{N} \t\n\x0B\f\r]{2,}")).alias("n_runs"),
    )
    rows = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    five = ", ".join(f"h[i + {j}]" for j in range(5))
    rows = rows.withColumn("windows", F.expr(f"if(size(h) < 5, cast(array() as array<bigint>), transform(sequence(0, size(h) - 5), i -> xxhash64({five})))"))
    rows = rows.withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    rows = rows.withColumn("n_words", F.size("w")).drop("w", "lines", "h")
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x: bigint, i: int>>")
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none)).drop("windows")
    again = "filter(placed, (p, k) -> (k > 0 AND placed[k - 1].x = p.x) OR (k < size(placed) - 1 AND placed[k + 1].x = p.x))"
    rows = rows.withColumn("at", F.expr(f"sort_array(transform({again}, p -> p.i))")).drop("placed")
    covered = "aggregate(at, named_struct('last', -5, 'n', 0), (s, i) -> named_struct('last', i, 'n', s.n + least(5, i - s.last)), s -> s.n)"
    return rows.withColumn("n_repeat_words", F.expr(covered)).select("doc_id", *(F.col(c).cast("long").alias(c) for c in COUNTS))


def _vote(rule: Rule) -> str:
    return f"CASE WHEN {rule.good} THEN 1 WHEN {rule.bad} THEN -1 ELSE 0 END"


def estimate(patterns: list[tuple[list[int], float]], n_rules: int, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the numbers of texts by their votes; PRIOR counts as so many right and wrong votes, or good and bad texts."""
    right, wrong = PRIOR
    model = Model(START[0], [START[1]] * n_rules, [START[2]] * n_rules)
    for _ in range(rounds):
        base, yes, no = model.evidence()
        total, good = 0.0, 0.0
        hits = [[0.0, 0.0, 0.0, 0.0] for _ in range(n_rules)]  # votes for good and all votes on good texts, votes for bad and all votes on bad ones
        for votes, n in patterns:
            odds = base + sum(y if v > 0 else b for v, y, b in zip(votes, yes, no, strict=True) if v)
            q = n / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            total, good = total + n, good + q
            for h, v in zip(hits, votes, strict=True):
                if v:
                    h[0], h[1], h[2], h[3] = h[0] + q * (v > 0), h[1] + q, h[2] + (n - q) * (v < 0), h[3] + n - q
        model = Model((good + right) / (total + right + wrong), [(h[0] + right) / (h[1] + right + wrong) for h in hits], [(h[2] + right) / (h[3] + right + wrong) for h in hits])
    return model


def fit(counted: DataFrame, rules: list[Rule] = RULES, rounds: int = ROUNDS) -> Model:
    """The model of a table with COUNTS."""
    names = [f"v{k}" for k in range(len(rules))]
    votes = counted.select(*(F.expr(_vote(r)).alias(c) for r, c in zip(rules, names, strict=True)))
    rows = votes.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # at most 3^rules rows
    return estimate([([r[c] for c in names], r["n"]) for r in rows], len(rules), rounds)


def posterior(model: Model, rules: list[Rule] = RULES) -> Column:
    """Probability that a text is good, by its counts."""
    base, yes, no = model.evidence()
    odds = F.lit(base)
    for rule, y, b in zip(rules, yes, no, strict=True):
        odds = odds + F.when(F.expr(rule.good), F.lit(y)).when(F.expr(rule.bad), F.lit(b)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(doc_id, COUNTS, base_failed, votes, posterior, kept) for every row; votes has a sign for each rule (+, - or 0)."""
    counted = stash(counts(docs, id_col, text_col), "text-counts")
    p = posterior(fit(counted, rules), rules)
    signs = F.concat(*(F.when(F.expr(r.good), F.lit("+")).when(F.expr(r.bad), F.lit("-")).otherwise(F.lit("0")) for r in rules))
    rows = counted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("votes", signs).withColumn("posterior", p)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
