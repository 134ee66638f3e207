"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a condition under which a document fails, over counts of its text. On a bounded sample each rule's cost and
the documents that it rejects are found; rules are then tried in descending rejection per cost, where a count that an
earlier rule has made costs nothing more and a document that an earlier rule rejects counts for none. In ``passing``
the cascade is one nested expression: a count is made where its first rule is reached, once, and not at all for a
document that failed before. The verdict is the same in every order; only the time to reach it is not.

Costs are steps, not seconds, so that the order and ``failed_rule`` are the same in every run: the sample's characters, words
and lines times the steps that each count takes on them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most rows of the sample on which costs and rejections are found.
SAMPLE_ROWS = 500

Bound = dict[str, Column]


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.when(F.btrim(text, F.lit(SPACE)) == "", F.array().cast("array<string>")).otherwise(F.split(F.btrim(text, F.lit(SPACE)), SPACE_CLASS))


def lines_of(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row even where the optimizer inlines columns into lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def window_hashes(words: Column, width: int = 5) -> Column:
    """A 64-bit hash of each window of ``width`` words, in order; ``words`` must be bound by ``let``."""
    at = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def covered(hashes: Column, width: int) -> Column:
    """Words in windows whose hash occurs more than once; ``hashes`` must be bound by ``let``.

    Sorting (hash, place) brings equal windows together. In ascending order each repeated place
    covers up to the next one, at most ``width`` words.
    """
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = let(ordered, lambda o: F.sort_array(F.transform(F.filter(o, lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"])), lambda x: x["i"])))
    steps = let(places, lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(width)), F.lit(width))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words covered by windows of ``width`` words that the text has more than once; ``words`` must be bound by ``let``."""
    return let(window_hashes(words, width), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h, width)).otherwise(F.lit(0).cast("long")))


@dataclass(frozen=True)
class Count:
    """A value of a text: what it is made from, how, and its steps a character, a word and a line."""

    of: tuple[str, ...]
    make: Callable[[Bound], Column]
    steps: tuple[float, float, float]


COUNTS = {
    "words": Count(("text",), lambda b: words_of(b["text"]), (3, 2, 0)),
    "lines": Count(("text",), lambda b: lines_of(b["text"]), (2, 0, 2)),
    "n_words": Count(("words",), lambda b: F.size(b["words"]).cast("long"), (0, 0, 0)),
    "n_lines": Count(("lines",), lambda b: F.size(b["lines"]).cast("long"), (0, 0, 0)),
    "word_chars": Count(("text",), lambda b: F.length(without(b["text"], SPACE)).cast("long"), (1, 0, 0)),
    "n_symbols": Count(("text",), lambda b: (F.length(b["text"]) - F.length(without(b["text"], SYMBOLS))).cast("long"), (1, 0, 0)),
    "capitals": Count(("text",), lambda b: F.length(b["text"]) - F.length(without(b["text"], UPPER)), (1, 0, 0)),
    "letters": Count(("text",), lambda b: F.length(b["text"]) - F.length(without(b["text"], UPPER + UPPER.lower())), (1, 0, 0)),
    "n_dup_lines": Count(("lines",), lambda b: (F.size(b["lines"]) - F.size(F.array_distinct(b["lines"]))).cast("long"), (1, 0, 2)),
    "n_repeat_words": Count(("words",), lambda b: repeated_words(b["words"]), (0, 40, 0)),
}
REPORTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def needed(counts: tuple[str, ...], bound: set[str] | Bound) -> list[str]:
    """What has to be made for ``counts`` beyond ``bound``, each after what it is made from."""
    out: list[str] = []
    for c in counts:
        out += [x for x in [*needed(COUNTS[c].of, bound), c] if x not in out] if c not in bound else []
    return out


def bind(counts: list[str], bound: Bound, body: Callable[[Bound], Column]) -> Column:
    """``body`` of ``bound`` and ``counts``, each made once."""
    if not counts:
        return body(bound)
    return let(COUNTS[counts[0]].make(bound), lambda x: bind(counts[1:], bound | {counts[0]: x}, body))


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition over the counts that ``reads`` names."""

    name: str
    reads: tuple[str, ...]
    fails: Callable[[Bound], Column]


#: The rules that every verdict has.
BASE = [
    Rule("few_words", ("n_words",), lambda b: b["n_words"] < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda b: b["n_repeat_words"] * 100 > b["n_words"] * 20),
]


def rules(symbol_percent: int = 10, line_percent: int = 50, caps_percent: int = 70, mean_word: tuple[float, float] = (1.5, 20.0)) -> list[Rule]:
    """The rules in no particular order, ``BASE`` included. Thresholds are shares, so they hold for texts of any length."""
    return [
        *BASE,
        Rule("symbols", ("n_symbols", "word_chars"), lambda b: b["n_symbols"] * 100 > b["word_chars"] * symbol_percent),
        Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda b: b["n_dup_lines"] * 100 > b["n_lines"] * line_percent),
        Rule("capitals", ("n_words", "capitals", "letters"), lambda b: (b["n_words"] >= 10) & (b["capitals"] * 100 > b["letters"] * caps_percent)),
        Rule("word_length", ("n_words", "word_chars"), lambda b: (b["n_words"] > 0) & ~b["word_chars"].between(b["n_words"] * mean_word[0], b["n_words"] * mean_word[1])),
    ]


def text_of() -> Bound:
    return {"text": F.coalesce(F.col("text"), F.lit(""))}


def cascade(trial: list[Rule], bound: Bound) -> Column:
    """The name of the first rule of ``trial`` that fails, null if none does; counts are made where they are first read."""
    if not trial:
        return F.lit(None).cast("string")
    rule, *rest = trial
    return bind(needed(rule.reads, bound), bound, lambda b: F.when(rule.fails(b), F.lit(rule.name)).otherwise(cascade(rest, b)))


def with_base(trial: list[Rule] | None) -> list[Rule]:
    trial = rules() if trial is None else trial
    return [*trial, *(r for r in BASE if r not in trial)]


def ordered(docs: DataFrame, trial: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by descending rejection per cost on the first ``sample_rows`` rows at most; one small job."""
    every = {r.name: r for r in trial}
    sample = docs.select("text").limit(sample_rows)
    every_count = needed(tuple(c for r in trial for c in r.reads), text_of())
    all_counts = [*every_count, *[c for c in ("words", "lines") if c not in every_count]]
    seen = sample.select(bind(all_counts, text_of(), lambda b: F.struct(F.length(b["text"]).alias("chars"), F.size(b["words"]).alias("words"), F.size(b["lines"]).alias("lines"), F.array(*[r.fails(b) for r in trial]).alias("fails"))).alias("x")).select("x.*").collect()
    totals = [sum(r[k] for r in seen) for k in ("chars", "words", "lines")]
    open_rows, done, out = [dict(zip(every, r["fails"], strict=True)) for r in seen], {"text"}, []
    while every:
        def worth(rule: Rule) -> float:
            cost = sum(s * n for c in needed(rule.reads, done) for s, n in zip(COUNTS[c].steps, totals, strict=True))
            return (sum(r[rule.name] for r in open_rows) + 1) / (cost + len(seen) + 1)

        best = min(every.values(), key=lambda r: (-worth(r), r.name))
        out.append(every.pop(best.name))
        done |= set(needed(best.reads, done))
        open_rows = [r for r in open_rows if not r[best.name]]
    return out


def passing(docs: DataFrame, trial: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns only, of whatever names.

    Empty and null texts fail; an empty table gives an empty one; repeated rows are judged alike. The sample is taken when this is called.
    """
    return docs.where(cascade(ordered(docs, with_base(trial), sample_rows), text_of()).isNull())


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts ``REPORTED``, each made once; clashing columns of the input are replaced. A null text counts as empty."""
    made = bind(needed(tuple(REPORTED), text_of()), text_of(), lambda b: F.struct(*[b[c].alias(c) for c in REPORTED]))
    return docs.withColumn("counts", made).withColumns({c: F.col("counts")[c] for c in REPORTED}).drop("counts")


def judged(docs: DataFrame, trial: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with all counts, base_failed, failed_rule (the first in cascade order) and kept.

    Empty and null texts fail; an empty table gives an empty one; repeated rows are judged alike. Columns of these
    names, ``counts`` too, are replaced. The sample is taken when this is called.
    """
    trial = ordered(docs, with_base(trial), sample_rows)
    bound = text_of() | {c: F.col(c) for c in REPORTED}
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return counted(docs.drop("counts")).withColumn("failed_rule", cascade(trial, bound)).withColumn("base_failed", base).withColumn("kept", F.col("failed_rule").isNull())


def report(docs: DataFrame) -> DataFrame:
    """The verdict and its counts per document."""
    return judged(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, trim(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) AS s, row_number() OVER () AS r FROM documents),
w AS (SELECT *, CASE WHEN s = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(s, '[\x20\x09-\x0D]+') END AS ws,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, chr(32)||chr(9)||chr(11)||chr(12)||chr(13)) <> '') AS ls FROM d),
g AS (SELECT r, i, ws[i:i+4] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
q AS (SELECT r, sum(least(5, coalesce(n - i, 5)))::BIGINT AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM p) GROUP BY r),
f AS (SELECT doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN q USING (r)),
b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_symbols * 100 <= word_chars * 10 AND n_dup_lines * 100 <= n_lines * 50
  AND length(regexp_replace(t, '[^A-Z]', '', 'g')) * 100 <= length(regexp_replace(t, '[^A-Za-z]', '', 'g')) * 70
  AND word_chars BETWEEN n_words * 1.5 AND n_words * 20 AS kept
FROM b
"""
