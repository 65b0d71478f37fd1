"""Secret scans with DataFrame functions alone: three patterns, and sliding-window entropy over candidate strings.

Patterns match leftmost and without overlap; matches that are too short are dropped after matching, as they use up
their text. Positions are code points from 0, ends exclusive, and follow from the lengths of matches and of what lies
between them. Candidates for entropy are runs of token characters with a letter and a digit. A window of ENTROPY_WINDOW
characters slides over each; its character counts change by the one that enters and the one that leaves, and with them
the sum of c log2 c that gives the Shannon entropy. A candidate's span runs from its first to its last window above the
threshold of its character class. Words of the allow-list end a candidate, so what stands beside them is scanned; candidates
without a digit (such as paths of words) or within a pattern's span are left out.

Null and empty texts have no spans. Rows are looked at one by one, so repeated rows have equal results and empty tables
none; ties in the order of spans are by kind. Nothing is shuffled; texts of any length are scanned whole, in time
proportional to their length. Other columns, whatever their names, are passed through by `redacted`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns by kind, and the fewest characters of the match or of its value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # one run of 16 characters or more, as AKIA[A-Z0-9]+ takes the whole run
HEX = r"[0-9a-f]{32,}"  # likewise
KINDS = ("assign", "access", "hex", "entropy")
LEAST_VALUE = 8

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"  # ENTROPY_WINDOW characters or more
#: A run with a digit, a letter and 20 characters, looked at from its start alone, so that long runs take linear time.
LIKELY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20}"
ENTROPY_WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits a character from which a window counts, by character class (digits and a-f; letters and digits; all).
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
ALLOWED = ("example", "placeholder", "changeme", "xxxxxxxx", "0123456789", "abcdefgh", "00000000")

_NONE = "array<struct<start:int,kind:int,end:int,text:string,value:string>>"


def found(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """(start, kind, end, match, value) of all matches, in order."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.char_length(x["before"])
        end = at + F.char_length(F.coalesce(x["match"], F.lit("")))
        hit = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("text"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull(), F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step)["out"]).otherwise(F.array().cast(_NONE))


def _f(c: Column) -> Column:
    """c log2 c for the counts that a window can hold, and one less and one more."""
    return F.element_at(F.array(*[F.lit(float(i * math.log2(i)) if i > 0 else 0.0) for i in range(-1, ENTROPY_WINDOW + 2)]), c + 2)


#: The counts of a window lie in longs, PER characters of the alphabet in each, of 5 bits (a window has less than 32).
BITS, PER = 5, 12
WORDS = -(-len(ALPHABET) // PER)


def windows(chars: Column, threshold: Column) -> Column:
    """(first start, last end) of the windows of an array of characters whose entropy reaches the threshold.

    A step changes the count of the character that enters and of the one that leaves, and nothing else.
    """
    w = ENTROPY_WINDOW
    at = F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c).cast("int") - 1)
    left = F.concat(F.array_repeat(F.lit(None).cast("int"), w), F.slice(at, 1, F.greatest(F.size(at) - w, F.lit(0))))
    # what a step needs is in its element: a state that held the whole array would be copied at each step
    moves = F.arrays_zip(at.alias("enters"), left.alias("leaves"))

    def count(s: Column, p: Column) -> Column:
        held = F.element_at(F.array(*[s[f"c{k}"] for k in range(WORDS)]), F.call_function("div", p, F.lit(PER)).cast("int") + 1)
        return F.call_function("shiftright", held, p % PER * BITS).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    def one(p: Column, k: int) -> Column:
        return F.when((p >= k * PER) & (p < (k + 1) * PER), F.call_function("shiftleft", F.lit(1).cast("long"), p % PER * BITS)).otherwise(0)

    def slide(s: Column, x: Column) -> Column:
        enters, leaves, i = x["enters"], F.coalesce(x["leaves"], F.lit(0)), s["i"] + 1
        full = x["leaves"].isNotNull()
        gone, now = count(s, leaves), count(s, enters)
        more = _f(now + 1) - _f(now)
        total = s["sum"] + F.when(~full, more).when(enters == leaves, 0.0).otherwise(_f(gone - 1) - _f(gone) + more)
        hit = (i >= w) & (F.lit(math.log2(w)) - total / w >= s["least"])
        return F.struct(
            i.alias("i"),
            s["least"].alias("least"),
            *[(s[f"c{k}"] + one(enters, k) - F.when(full, one(leaves, k)).otherwise(0)).alias(f"c{k}") for k in range(WORDS)],
            total.alias("sum"),
            F.when(hit & (s["old"] < 0), i - w).otherwise(s["old"]).alias("old"),
            F.when(hit, i).otherwise(s["new"]).alias("new"),
        )

    begin = F.struct(
        F.lit(0).alias("i"),
        threshold.cast("double").alias("least"),
        *[F.lit(0).cast("long").alias(f"c{k}") for k in range(WORDS)],
        F.lit(0.0).alias("sum"),
        F.lit(-1).alias("old"),
        F.lit(-1).alias("new"),
    )
    return F.aggregate(moves, begin, slide, lambda s: F.struct(s["old"].alias("old"), s["new"].alias("new")))


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of high entropy that no span of `base` holds."""
    masked = text  # as long as the text, so that positions stay
    for word in ALLOWED:
        masked = F.regexp_replace(masked, f"(?i){word}", " " * len(word))
    likely = F.when(text.rlike(LIKELY), masked).otherwise(F.lit(""))
    wanted = F.filter(found(likely, CANDIDATE, 3), lambda x: x["text"].rlike("[0-9]") & x["text"].rlike("[A-Za-z]"))
    wanted = F.filter(wanted, lambda x: ~F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))

    def scan(x: Column) -> Column:
        t = x["text"]
        least = F.when(t.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(t.rlike("^[0-9A-Za-z]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
        return F.struct(x["start"].alias("start"), windows(F.split(t, ""), least).alias("w"))

    def span(x: Column) -> Column:  # apart from `scan`, so that windows slide once
        return F.struct((x["start"] + x["w"]["old"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["w"]["new"]).alias("end"), (x["w"]["new"] > 0).alias("hit"))

    kept = F.filter(F.transform(F.transform(wanted, scan), span), lambda s: s["hit"])
    outside = F.filter(kept, lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
    return F.transform(outside, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and then kind."""
    assign = F.filter(found(text, ASSIGN, 0, 1), lambda x: F.char_length(x["value"]) >= LEAST_VALUE)
    every = F.concat(assign, found(text, ACCESS, 1), found(text, HEX, 2))
    return F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def scanned(docs: DataFrame, text: str = "text", base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """docs with the columns `base` and `every`: arrays of (start, kind, end), kind by its place in KINDS."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(base, base_spans(t)).withColumn(every, F.array_sort(F.concat(base, entropy_spans(t, F.col(base)))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the patterns' spans, and all spans."""
    base, every = F.col("base_spans"), F.col("all_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long")

    return scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans")
    )


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by a mark; overlapping spans share one."""
    own = docs.select([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])  # names of extra columns can't clash
    at = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    t = F.coalesce(F.col(at[text]).cast("string"), F.lit(""))

    def step(s: Column, x: Column) -> Column:
        inside = x["start"] < s["at"]
        before = F.substring(s["text"], s["at"] + 1, x["start"] - s["at"])
        return F.struct(s["text"].alias("text"), F.greatest(s["at"], x["end"]).alias("at"), F.when(inside, s["out"]).otherwise(F.concat(s["out"], before, F.lit(mark))).alias("out"))

    begin = F.struct(t.alias("text"), F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate("spans", begin, step, lambda s: F.concat(s["out"], F.substring(s["text"], s["at"] + 1, F.char_length(s["text"]))))
    told = scanned(own, at[text], "base", "spans")
    return told.select([(F.when(F.size("spans") > 0, new).otherwise(F.col(at[c])) if c == text else F.col(at[c])).alias(c) for c in docs.columns])
